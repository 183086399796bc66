"""Reads of rows by position: columns are checked when the plan is made, not when it runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ColumnType, column_type, encode_column


def value_column(types: Sequence[int], i: int) -> str:
    """The name of a row's i-th column."""
    if not 0 <= i < len(types):
        raise IndexError(f"a row of {len(types)} columns has no such one")
    return f"c{i}"


def value_bits(types: Sequence[int], i: int) -> Column:
    """The i-th value's bits."""
    return encode_column(F.col(value_column(types, i)), types[i])


def all_bits(types: Sequence[int]) -> Column:
    """All values' bits, in order."""
    return F.array(*[value_bits(types, i).cast("long") for i in range(len(types))]) if types else F.array().cast("array<long>")


def typed(types: Sequence[int], kind: int, first: int = 0, last: int | None = None) -> list[str]:
    """The columns first .. last-1, all of which must have the type: nothing is converted."""
    last = len(types) if last is None else last
    if not 0 <= first <= last <= len(types):
        raise IndexError(f"a row of {len(types)} columns has no such one")
    if any(column_type(t) != column_type(kind) for t in types[first:last]):
        raise ValueError("a column has another type")
    return [f"c{i}" for i in range(first, last)]


def with_objects(rows: DataFrame, types: Sequence[int], objects: DataFrame, id_name: str = "id") -> DataFrame:
    """rows with each object column's record beside it, as struct o<i>; an id without a record raises when it is read."""
    for i, t in enumerate(types):
        if t == ColumnType.OBJECT:
            named = objects.select(F.col(id_name).alias(f"__id{i}"), F.struct(*objects.columns).alias(f"o{i}"))
            rows = rows.join(named, F.col(f"c{i}") == F.col(f"__id{i}"), "left")
            lost = F.raise_error(F.concat(F.lit("no object has the index "), F.col(f"c{i}").cast("string"))).cast(named.schema[f"o{i}"].dataType)
            rows = rows.withColumn(f"o{i}", F.when(F.col(f"__id{i}").isNull(), lost).otherwise(F.col(f"o{i}"))).drop(f"__id{i}")
    return rows
