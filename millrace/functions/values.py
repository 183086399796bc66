"""Column types and values: every value of a row is bits, and equal bits are equal values.

Floats are normalised when they are encoded (one NaN, no negative zero), so NaN equals NaN and the zeros are one value.
"""

from __future__ import annotations

import math
import struct
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType


class ColumnType(IntEnum):
    """All column types. The number is the type's id."""

    UINT32 = 0
    UINT64 = 1
    INT32 = 2
    INT64 = 3
    FLOAT32 = 4
    FLOAT64 = 5
    BOOL = 6
    OBJECT = 7


#: Bits of each type, in the order of ids. An object column's bits are the repository's; this is the most.
WHOLE_BITS = (32, 64, 32, 64, 32, 64, 1, 32)
#: The bounds that float comparisons and canonicalisation use.
ABSOLUTE_TOLERANCE = RELATIVE_TOLERANCE = 1e-12

#: Fixed value: a message that callers match.
NO_MATCH = "Value does not match the column type."
NO_FIT = "the value does not fit the column's type."
NO_CONVERSION = "the value does not convert to the column's type."

_RANGES = {
    ColumnType.UINT32: (0, 2**32 - 1), ColumnType.UINT64: (0, 2**64 - 1), ColumnType.INT32: (-(2**31), 2**31 - 1), ColumnType.INT64: (-(2**63), 2**63 - 1),
}
_SPARK = (LongType(), DecimalType(20, 0), IntegerType(), LongType(), FloatType(), DoubleType(), BooleanType(), LongType())


def column_type(type_id: int) -> ColumnType:
    """The type of an id, or ValueError."""
    if isinstance(type_id, bool) or not isinstance(type_id, int) or not 0 <= type_id < len(ColumnType):
        raise ValueError(f"no column type has the id {type_id!r}")
    return ColumnType(type_id)


def spark_type(type_id: int) -> DataType:
    """What Spark holds a type in: unsigned types in the next wider one."""
    return _SPARK[column_type(type_id)]


def column_bits(type_id: int, object_bits: int = 32) -> int:
    """Stored bits of a column; IndexError for an id that is no type."""
    if not 0 <= type_id < len(ColumnType):
        raise IndexError(f"no column type has the id {type_id!r}")
    return object_bits if type_id == ColumnType.OBJECT else WHOLE_BITS[type_id]


def to_uint(n: int) -> int:
    """n as an unsigned 32-bit number, or OverflowError."""
    if not 0 <= n < 2**32:
        raise OverflowError(f"{n} does not fit 32 bits")
    return n


# One value, on the driver ------------------------------------------------------------------------------------------------


class ObjectIndex(int):
    """The index of an object: a number that only object columns take."""


def type_of(value: bool | int | float) -> ColumnType:
    """The type a Python value has by itself: bool before int, int64 before uint64."""
    if isinstance(value, bool):
        return ColumnType.BOOL
    if isinstance(value, ObjectIndex):
        return ColumnType.OBJECT
    if isinstance(value, int):
        for t in (ColumnType.INT64, ColumnType.UINT64):
            if _RANGES[t][0] <= value <= _RANGES[t][1]:
                return t
        raise OverflowError("the value has more than 64 bits")
    if isinstance(value, float):
        return ColumnType.FLOAT64
    raise TypeError(NO_MATCH)


def _float_bits(value: float, kind: ColumnType) -> int:
    code, size = (("<f", 4) if kind == ColumnType.FLOAT32 else ("<d", 8))
    if math.isnan(value):
        return 0x7FC00000 if size == 4 else 0x7FF8000000000000
    try:
        raw = struct.pack(code, value + 0.0)
    except OverflowError:  # a double too large for a float
        raw = struct.pack(code, math.copysign(math.inf, value))
    return int.from_bytes(raw, "little")


def encode(value: bool | int | float, type_id: int | None = None) -> int:
    """Bits of a value in a column: unsigned, in the column's width.

    No type: the value's own. Integers fit or are refused; integers become floats unchecked; nothing else converts.
    """
    own = type_of(value)
    kind = own if type_id is None else column_type(type_id)
    if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64):
        if own in (ColumnType.BOOL, ColumnType.OBJECT):
            raise ValueError(NO_CONVERSION)
        return _float_bits(float(value), kind)
    if kind in _RANGES:
        if own not in (ColumnType.INT64, ColumnType.UINT64):
            raise ValueError(NO_CONVERSION)
        low, high = _RANGES[kind]
        if not low <= value <= high:
            raise ValueError(NO_FIT)
        return value % 2 ** WHOLE_BITS[kind]
    if own != kind:
        raise ValueError(NO_CONVERSION)
    return to_uint(int(value)) if kind == ColumnType.OBJECT else int(value)


def decode(bits: int, type_id: int) -> bool | int | float:
    """The value of bits in a column."""
    kind = column_type(type_id)
    if kind == ColumnType.BOOL:
        return bits != 0
    width = WHOLE_BITS[kind]
    bits %= 2**width
    if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64):
        return struct.unpack("<f" if width == 32 else "<d", bits.to_bytes(width // 8, "little"))[0]
    if kind in (ColumnType.INT32, ColumnType.INT64) and bits >= 2 ** (width - 1):
        bits -= 2**width
    return ObjectIndex(bits) if kind == ColumnType.OBJECT else bits


def cast_value(value: object, type_id: int) -> bool | int | float:
    """A Python value for a column of a type, or TypeError."""
    kind = column_type(type_id)
    try:
        encode(value, kind)  # type: ignore[arg-type]
    except (ValueError, OverflowError):
        raise TypeError(NO_MATCH) from None
    return float(value) if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64) else value  # type: ignore[arg-type, return-value]


# Columns -----------------------------------------------------------------------------------------------------------------


def _whole(n: int) -> Column:
    """A whole number of any size."""
    return F.lit(str(n)).cast("decimal(38,0)")


def normalised(c: Column, type_id: int) -> Column:
    """A column as rows hold it: floats without negative zero. NaNs are one value to Spark's joins and groups already."""
    kind = column_type(type_id)
    if kind == ColumnType.FLOAT64:
        return c + F.lit(0.0)
    return c + F.lit(0.0).cast("float") if kind == ColumnType.FLOAT32 else c


def encode_column(c: Column, type_id: int) -> Column:
    """Bits of a typed column as BIGINT (unsigned 64-bit numbers as the signed number of the same bits). Null stays null.

    Reflection isn't code-generated: compare typed columns where that serves, and encode only what must show its bits.
    """
    kind = column_type(type_id)
    if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64):
        box, to = ("java.lang.Float", "floatToIntBits") if kind == ColumnType.FLOAT32 else ("java.lang.Double", "doubleToLongBits")
        wide = "float" if kind == ColumnType.FLOAT32 else "double"
        safe = F.coalesce(c.cast(wide), F.lit(0.0).cast(wide)) + F.lit(0.0).cast(wide)
        bits = F.reflect(F.lit(box), F.lit(to), safe).cast("long")
        return F.when(c.isNotNull(), bits.bitwiseAND(F.lit(0xFFFFFFFF)) if kind == ColumnType.FLOAT32 else bits)
    if kind == ColumnType.BOOL:
        return c.cast("int").cast("long")
    if kind == ColumnType.UINT64:
        half = _whole(2**63)
        return F.when(c >= half, (c - half - half).cast("long")).otherwise(c.cast("long"))
    wide = c.cast("long")
    return wide.bitwiseAND(F.lit(0xFFFFFFFF)) if WHOLE_BITS[kind] == 32 else wide


def decode_column(bits: Column, type_id: int) -> Column:
    """The typed column of BIGINT bits. Null stays null."""
    kind = column_type(type_id)
    if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64):
        safe = F.coalesce(bits, F.lit(0))
        if kind == ColumnType.FLOAT32:
            low = safe.bitwiseAND(F.lit(0xFFFFFFFF))
            signed = low.bitwiseXOR(F.lit(2**31)) - F.lit(2**31)
            return F.when(bits.isNotNull(), F.reflect(F.lit("java.lang.Float"), F.lit("intBitsToFloat"), signed.cast("int")).cast("float"))
        return F.when(bits.isNotNull(), F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), safe.cast("long")).cast("double"))
    if kind == ColumnType.BOOL:
        return bits != 0
    if kind == ColumnType.UINT64:
        wide = bits.cast("decimal(20,0)")
        return F.when(bits < 0, (wide + _whole(2**64)).cast("decimal(20,0)")).otherwise(wide)
    if kind == ColumnType.INT64:
        return bits.cast("long")
    low = bits.bitwiseAND(F.lit(0xFFFFFFFF))
    return (low.bitwiseXOR(F.lit(2**31)) - F.lit(2**31)).cast("int") if kind == ColumnType.INT32 else low


def fits(c: Column, type_id: int, object_bits: int = 32) -> Column:
    """Whether an integer column's value is in a type's range."""
    kind = column_type(type_id)
    low, high = (0, 2**object_bits - 1) if kind == ColumnType.OBJECT else _RANGES[kind]
    wide = c.cast("decimal(38,0)")
    return wide.between(_whole(low), _whole(high))


def encode_checked(c: Column, type_id: int) -> Column:
    """Bits of an integer column in an integer type; null where the value is out of its range."""
    kind = column_type(type_id)
    if kind not in _RANGES:
        raise ValueError(NO_CONVERSION)
    return F.when(fits(c, kind), encode_column(c.cast("long") if WHOLE_BITS[kind] == 32 else c, kind))


def tolerance(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))


def canonical_float(c: Column) -> Column:
    """NaN and infinities as they are; else the nearest multiple of the absolute tolerance, halves away from zero.

    A value too large to be divided by the tolerance becomes infinite.
    """
    special = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(special, c).otherwise(F.round(c / F.lit(ABSOLUTE_TOLERANCE)) * F.lit(ABSOLUTE_TOLERANCE))


def _whole_part(nanoseconds: Column, unit: int) -> Column:
    """Whole units, towards zero, in whole numbers throughout."""
    return F.call_function("div", nanoseconds.cast("long"), F.lit(unit).cast("long"))


def microseconds(nanoseconds: Column) -> Column:
    """Whole microseconds, towards zero."""
    return _whole_part(nanoseconds, 1000)


def milliseconds(nanoseconds: Column) -> Column:
    """Whole milliseconds, towards zero."""
    return _whole_part(nanoseconds, 1_000_000)


def nanoseconds(c: Column, unit: str = "us") -> Column:
    """Nanoseconds of a whole number of microseconds (us), milliseconds (ms) or nanoseconds (ns)."""
    return c.cast("long") * F.lit({"ns": 1, "us": 1000, "ms": 1_000_000}[unit])


def values_text(*columns: Column) -> Column:
    """A row's values as text, a space between each."""
    return F.concat_ws(" ", *(c.cast("string") for c in columns))


def layout_text(label: Column, type_id: Column) -> Column:
    return F.concat(label.cast("string"), F.lit(":"), type_id.cast("string"))


def row_key_text(pool: Column, row: Column) -> Column:
    return F.concat(F.lit("<"), pool.cast("string"), F.lit(","), row.cast("string"), F.lit(">"))
