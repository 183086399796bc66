"""Interning: each distinct record once, numbered densely in the order in which it first came.

A DataFrame has no order of its own, so every operator that numbers takes the column that gives it. Nulls are values:
a null equals a null, in identities and in lookups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import committed

#: New records that one task may number. Above, ranges of them are numbered side by side.
ONE_TASK = 1 << 20


def dense_ids(records: DataFrame, order: str, base: int = 0, id_name: str = "row_id", count: int | None = None, one_task: int = ONE_TASK, ties: Sequence[str] = ()) -> DataFrame:
    """records with dense ids from base in the order of a column; rows that tie in it go by the columns `ties`.

    The records are computed once, and written unless their number is given (count) and small. Up to one_task of them are
    numbered in one task: the number is known. Above, they are dealt into sorted ranges of about one_task rows and
    written; a range's ids begin after what the ranges before it hold, so a row's id is a sum.
    """
    keys = [order, *(c for c in ties if c != order)]
    if count is None:
        records = committed(records, "records")
        count = records.count()
    if count <= one_task:
        return records.withColumn(id_name, (F.row_number().over(Window.orderBy(*keys)) - 1 + base).cast("long"))
    dealt = records.repartitionByRange(-(-count // one_task), *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    dealt = committed(dealt, "ranges").withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(starts, "__part").withColumn(id_name, (F.col("__start") + place + base).cast("long")).drop("__part", "__start", "__at")


def first_seen(records: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
    """Each distinct record (its identity columns) with the least value of the order column, as `first_seen`."""
    return records.groupBy(*identity).agg(F.min(order).alias("first_seen"))


def intern(records: DataFrame, identity: Sequence[str], order: str, base: int = 0, id_name: str = "row_id") -> DataFrame:
    """Each distinct record with its dense id, from base in first-seen order (ties by the identity); also its first_seen."""
    return dense_ids(first_seen(records, identity, order), "first_seen", base, id_name, ties=identity)


def with_created(records: DataFrame, identity: Sequence[str], order: Sequence[str], name: str = "created") -> DataFrame:
    """records with a flag: whether this row is the first of its record.

    Rows of one record are not gathered: the first is found by a partial aggregate and joined, so a record that a third of
    the rows repeat makes no large task but a skewed join, which Spark splits. The order columns must tell rows of a record apart.
    """
    first = records.groupBy(*identity).agg(F.min(F.struct(*order)).alias("__first"))
    own = records.withColumn("__order", F.struct(*order))
    both = own.alias("r").join(first.alias("f"), [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in identity])
    return both.select(*[F.col(f"r.{c}") for c in records.columns], (F.col("r.__order") == F.col("f.__first")).alias(name))


def _match(a: DataFrame, b: DataFrame, on: Sequence[str]) -> list[Column]:
    return [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]


def find(records: DataFrame, table: DataFrame, on: Sequence[str], id_name: str = "row_id") -> DataFrame:
    """records with the id that the table gives them, null if it has none. NaN finds NaN, and null finds null."""
    ids = table.select(*on, id_name)
    return records.alias("a").join(ids.alias("b"), _match(records, ids, on), "left").select("a.*", f"b.{id_name}")


def contained(records: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """The records that the table has."""
    return records.alias("a").join(table.select(*on).alias("b"), _match(records, table, on), "left_semi")


def missing(records: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """The records that the table does not have."""
    return records.alias("a").join(table.select(*on).alias("b"), _match(records, table, on), "left_anti")


def owner_of(ids: Column, bases: Sequence[int]) -> Column:
    """The layer of an id, from the layers' ends in order: the first whose end is above it; null if none is, or for negative ids."""
    out = F.lit(None).cast("int")
    for layer in range(len(bases) - 1, -1, -1):
        out = F.when(ids < bases[layer], layer).otherwise(out)
    return F.when(ids >= 0, out)


def rows_view(ids: DataFrame, table: DataFrame, id_name: str = "row_id", position: str = "pos") -> DataFrame:
    """The table's row for each (position, id); an id that the table lacks raises when it is read."""
    joined = ids.alias("i").join(table.withColumn("__there", F.lit(True)).alias("t"), F.col(f"i.{id_name}") == F.col(f"t.{id_name}"), "left")
    checked = F.when(F.col("t.__there"), F.col(f"i.{id_name}")).otherwise(F.raise_error(F.concat(F.lit("no row with the id "), F.col(f"i.{id_name}").cast("string"))).cast("long"))
    return joined.select(F.col(f"i.{position}"), checked.alias(id_name), *[F.col(f"t.{c}") for c in table.columns if c != id_name])
