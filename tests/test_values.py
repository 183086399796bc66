import math
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import values as V
from millrace.functions.values import ColumnType as T


def test_types_have_the_fixed_ids_and_bits():
    assert [t.name for t in T] == ["UINT32", "UINT64", "INT32", "INT64", "FLOAT32", "FLOAT64", "BOOL", "OBJECT"]
    assert [V.column_bits(t, 12) for t in T] == [32, 64, 32, 64, 32, 64, 1, 12]
    with pytest.raises(IndexError):
        V.column_bits(8)
    with pytest.raises(ValueError):
        V.column_type(-1)


@given(st.floats(allow_nan=False))
def test_doubles_come_back_and_zero_has_no_sign(x):
    bits = V.encode(x)
    assert V.decode(bits, T.FLOAT64) == x
    assert bits == struct.unpack("<Q", struct.pack("<d", x + 0.0))[0]


@given(st.integers(-(2**31), 2**31 - 1))
def test_int32_is_twos_complement_in_its_own_width(x):
    assert V.encode(x, T.INT32) == x % 2**32
    assert V.decode(V.encode(x, T.INT32), T.INT32) == x


def test_encoding_is_strict():
    assert V.encode(-1, T.INT32) == 0xFFFFFFFF
    assert V.encode(3, T.FLOAT64) == V.encode(3.0)
    assert V.encode(float("nan"), T.FLOAT32) == 0x7FC00000 and V.encode(-0.0) == V.encode(0.0)
    for value, kind in ((True, T.INT32), (1.5, T.INT32), (1, T.BOOL), (1.0, T.BOOL), (True, T.FLOAT64), (1, T.OBJECT), (V.ObjectIndex(1), T.INT32)):
        with pytest.raises(ValueError, match="does not convert"):
            V.encode(value, kind)
    for value, kind in ((-1, T.UINT32), (2**32, T.UINT32), (2**31, T.INT32), (-1, T.UINT64), (2**63, T.INT64)):
        with pytest.raises(ValueError, match="does not fit"):
            V.encode(value, kind)
    with pytest.raises(TypeError):
        V.cast_value("x", T.INT32)
    assert V.cast_value(3, T.FLOAT64) == 3.0
    with pytest.raises(OverflowError):
        V.to_uint(2**32)


def test_columns_encode_like_the_driver(spark):
    rows = [(0.0, 0.0, -1, True), (-0.0, -0.0, 2**31 - 1, False), (float("nan"), float("nan"), -(2**31), None), (math.inf, -math.inf, 0, True), (1.5, -2.25, 7, False)]
    df = spark.createDataFrame(rows, "d double, f float, i int, b boolean")
    out = df.select(V.encode_column(F.col("d"), T.FLOAT64), V.encode_column(F.col("f"), T.FLOAT32), V.encode_column(F.col("i"), T.INT32), V.encode_column(F.col("b"), T.BOOL)).collect()
    for (d, f, i, b), got in zip(rows, out, strict=True):
        assert got[0] % 2**64 == V.encode(d) and got[1] == V.encode(f, T.FLOAT32) and got[2] == V.encode(i, T.INT32)
        assert got[3] == (None if b is None else int(b))
    back = df.select(V.decode_column(V.encode_column(F.col("d"), T.FLOAT64), T.FLOAT64), V.decode_column(V.encode_column(F.col("f"), T.FLOAT32), T.FLOAT32), V.decode_column(V.encode_column(F.col("i"), T.INT32), T.INT32)).collect()
    for (d, f, i, _), got in zip(rows, back, strict=True):
        assert (got[0] == d or math.isnan(d) and math.isnan(got[0])) and (got[1] == f or math.isnan(f)) and got[2] == i


def test_unsigned_64_bits(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal(2**64 - 1),), (Decimal(2**63),), (Decimal(5),)], "u decimal(20,0)")
    bits = df.select(V.encode_column(F.col("u"), T.UINT64).alias("b"), "u")
    got = bits.select("b", "u", V.decode_column(F.col("b"), T.UINT64).alias("back")).collect()
    assert [r["b"] for r in got] == [-1, -(2**63), 5] and all(r["u"] == r["back"] for r in got)


def test_float_tolerance(spark):
    df = spark.createDataFrame([(1.23e-13,), (2.5e-12,), (float("inf"),), (float("nan"),), (1e300,)], "x double")
    got = [r[0] for r in df.select(V.canonical_float(F.col("x"))).collect()]
    assert got[0] == 0 and got[1] == pytest.approx(3e-12) and got[2] == math.inf and math.isnan(got[3]) and got[4] == math.inf
    t = spark.range(1).select(V.tolerance(F.lit(2e6), F.lit(-3e6)), V.tolerance(F.lit(0.0), F.lit(0.1))).first()
    assert t[0] == pytest.approx(3e-6) and t[1] == 1e-12
    d = spark.range(1).select(V.microseconds(F.lit(1999)), V.milliseconds(F.lit(-1_999_999)), V.layout_text(F.lit("a"), F.lit(3)), V.row_key_text(F.lit(1), F.lit(2))).first()
    assert tuple(d) == (1, -1, "a:3", "<1,2>")
