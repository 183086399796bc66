"""Relation builders: sets of rows with positions 0..n-1, changed by making new frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ColumnType, column_bits, fits, normalised
from ..sources.tables import committed
from .columns import ColumnLayout, Columns, columns_of, frame_schema, types_of
from .interning import contained, dense_ids, find, first_seen, missing


def swap_erased(rows: DataFrame, position: int, n: int, name: str = "pos") -> DataFrame:
    """rows without the one at a position; the last of the n rows takes its place."""
    return rows.where(F.col(name) != position).withColumn(name, F.when(F.col(name) == n - 1, F.lit(position)).otherwise(F.col(name)).cast("long"))


class RelationBuilder:
    """A set of rows of labelled, typed columns. The set of no columns holds the empty row or not: it is true or false."""

    def __init__(self, spark: SparkSession, columns: Sequence[ColumnLayout | tuple[str, int]] = (), object_bits: int = 32):
        self.spark, self.object_bits = spark, object_bits
        self.initialize(columns)

    def initialize(self, columns: Sequence[ColumnLayout | tuple[str, int]]) -> None:
        """Drop all rows and take other columns."""
        self.columns: Columns = columns_of(columns)
        self.clear()

    def clear(self) -> None:
        """Drop all rows, keep the columns."""
        self._truth, self._n = False, 0
        self.frame = self.spark.createDataFrame([], frame_schema(self.columns)).withColumn("pos", F.lit(0).cast("long")) if self.columns else None

    @property
    def labels(self) -> list[str]:
        return [c.label for c in self.columns]

    @property
    def arity(self) -> int:
        return len(self.columns)

    def widths(self) -> list[int]:
        """Stored bits of each column."""
        return [column_bits(t, self.object_bits) for t in types_of(self.columns)]

    def memory_usage(self) -> int:
        """Bytes that the plan of the rows is estimated at."""
        return 0 if self.frame is None else int(str(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    @property
    def size(self) -> int:
        return self._n if self.columns else int(self._truth)

    @property
    def empty(self) -> bool:
        return self.size == 0

    def _checked(self, rows: DataFrame, order: str | None) -> DataFrame:
        names = [c for c in rows.columns if c != order]
        if len(names) != self.arity:
            raise ValueError(f"the relation has {self.arity} columns, the rows have {len(names)}")
        bad = F.lit(False)
        for name, t in zip(names, types_of(self.columns), strict=True):
            bad = bad | F.col(name).isNull()
            if t in (ColumnType.UINT32, ColumnType.UINT64, ColumnType.INT32, ColumnType.INT64, ColumnType.OBJECT):
                bad = bad | ~fits(F.col(name), t, column_bits(t, self.object_bits))
        if not rows.where(bad).isEmpty():
            raise IndexError("a value does not fit its column")
        own = [normalised(F.col(n), t).alias(c.label) for n, t, c in zip(names, types_of(self.columns), self.columns, strict=True)]
        return rows.select(*own, *([F.col(order).alias("__order")] if order else []))

    def insert(self, rows: DataFrame, order: str) -> DataFrame:
        """Add rows (the columns by position, and the order column); (labels..., pos) of each distinct one, where it was or now is."""
        if not self.columns:
            if [c for c in rows.columns if c != order]:
                raise ValueError("the relation has no columns")
            self._truth = self._truth or not rows.isEmpty()
            return self.spark.range(int(self._truth)).select(F.col("id").alias("pos"))
        seen = first_seen(self._checked(rows, order), self.labels, "__order")
        fresh = committed(missing(seen, self.frame, self.labels), "added")
        n = fresh.count()
        placed = committed(dense_ids(fresh, "first_seen", self._n, "pos", count=n, ties=self.labels).drop("first_seen"), "placed")
        self.frame, self._n = self.frame.unionByName(placed), self._n + n
        return contained(self.frame, seen, self.labels)

    def find(self, rows: DataFrame) -> DataFrame:
        """rows with pos, null where the set doesn't hold the row. Rows of another arity are not found."""
        if not self.columns or len(rows.columns) != self.arity:
            return rows.withColumn("pos", F.lit(0 if not rows.columns and self._truth else None).cast("long"))
        keyed = rows.toDF(*self.labels).select(*[normalised(F.col(c.label), c.type).alias(c.label) for c in self.columns])
        return find(keyed, self.frame, self.labels, "pos")

    def contains(self, rows: DataFrame) -> DataFrame:
        """The rows that the set holds."""
        return self.find(rows).where("pos is not null").drop("pos")

    def at(self, position: int) -> DataFrame:
        """The row at a position; none if it is not below the size."""
        return self.frame.where(F.col("pos") == position)

    def erase(self, position: int) -> None:
        """Drop the row at a position; the last row moves into its place."""
        if not 0 <= position < self.size:
            raise IndexError("no row has this position")
        if not self.columns:
            self._truth = False
            return
        self.frame = swap_erased(self.frame, position, self._n)
        self._n -= 1

    def rename(self, columns: Sequence[ColumnLayout | tuple[str, int]]) -> None:
        """Other labels for the same types; rows stay."""
        own = columns_of(columns)
        if types_of(own) != types_of(self.columns):
            raise ValueError("renaming keeps number and types of the columns")
        if own:
            self.frame = self.frame.select(*[F.col(a.label).alias(b.label) for a, b in zip(self.columns, own, strict=True)], "pos")
        self.columns = own

    def rows(self) -> DataFrame:
        """(labels..., pos). The relation without columns has no frame: ask for its size."""
        if not self.columns:
            raise ValueError("the relation has no columns")
        return self.frame
