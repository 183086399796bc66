"""A repository of relations as a program sees it: one schema, list of columns, row or relation at a time, by index, data and view.

It stands on a layer. Each insert here is a job of its own, so rows by the million go through the layer's insert_rows and
insert_relations; what they stored is read here all the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.values import ColumnType, cast_value, column_type, encode, spark_type
from .builder import RelationBuilder
from .columns import ColumnLayout, Columns, columns_of, types_of
from .layers import Layer, RelationView


class SchemaIndex(int):
    """A list of column types."""


class ColumnsIndex(int):
    """A list of labelled, typed columns."""


class RowIndex(NamedTuple):
    """A row: its pool's schema, and its place in the pool."""

    schema: int
    row: int


class RelationIndex(int):
    """A relation."""


@dataclass(frozen=True)
class SchemaData:
    types: tuple[int, ...]


@dataclass(frozen=True)
class ColumnsData:
    columns: Columns

    def __init__(self, columns: Sequence[ColumnLayout | tuple[str, int]]):
        object.__setattr__(self, "columns", columns_of(columns))


@dataclass(frozen=True)
class RowData:
    schema: int
    values: tuple[bool | int | float, ...]


@dataclass(frozen=True)
class RelationData:
    """Rows of a schema's pool, by their places in it, under columns of the schema's types."""

    schema: int
    columns: int
    rows: tuple[int, ...]


@dataclass(frozen=True)
class SchemaView:
    index: SchemaIndex
    types: tuple[int, ...]

    @property
    def arity(self) -> int:
        return len(self.types)


@dataclass(frozen=True)
class ColumnsView:
    index: ColumnsIndex
    columns: Columns

    @property
    def arity(self) -> int:
        return len(self.columns)


@dataclass(frozen=True)
class RowView:
    """A row's values. index: None for a row that is not stored."""

    index: RowIndex | None
    types: tuple[int, ...]
    values: tuple[bool | int | float, ...]

    @property
    def arity(self) -> int:
        return len(self.types)

    def _at(self, i: int) -> int:
        if not 0 <= i < len(self.types):
            raise IndexError(f"a row of {len(self.types)} columns has no such one")
        return i

    def get_values(self) -> list[int]:
        """All values' bits."""
        return [self.value(i) for i in range(self.arity)]

    def value(self, i: int) -> int:
        """A value's bits."""
        v, t = self.values[self._at(i)], self.types[i]
        return int(v) if t == ColumnType.OBJECT else encode(v, t)

    def type(self, i: int) -> ColumnType:
        return column_type(self.types[self._at(i)])

    def get(self, i: int, kind: int | None = None) -> bool | int | float:
        """A value; of that type, if one is asked for: nothing is converted."""
        if kind is not None and self.type(i) != column_type(kind):
            raise ValueError("a column has another type")
        return self.values[self._at(i)]


class RelationRepository:
    """Its length is the number of relations."""

    def __init__(self, spark: SparkSession, num_objects: int | None = None):
        self.layer = Layer(spark, num_objects=num_objects)
        self._columns: list[Columns] = []

    def __len__(self) -> int:
        return len(self.layer)

    def __bool__(self) -> bool:
        return True

    def clear(self) -> None:
        """Drop rows and relations; schemas and lists of columns stay."""
        self.layer.clear_rows()

    def schema(self, types: Sequence[int | ColumnLayout | tuple[str, int]]) -> tuple[SchemaView, bool]:
        """The schema of types, or of columns' types, and whether it is new."""
        i, new = self.layer.schema(types)
        return SchemaView(SchemaIndex(i), self.layer.schema_types(i)), new

    def insert(self, data: SchemaData | ColumnsData | RowData | RelationData) -> tuple[SchemaView | ColumnsView | RowView | RelationView, bool]:
        """A view of what now is stored, and whether it is new."""
        if isinstance(data, SchemaData):
            return self.schema(data.types)
        if isinstance(data, ColumnsData):
            new = data.columns not in self._columns
            if new:
                self._columns.append(data.columns)
            return self.view(ColumnsIndex(self._columns.index(data.columns))), new
        if isinstance(data, RowData):
            return self._insert_row(data)
        columns = self.view(ColumnsIndex(data.columns)).columns  # type: ignore[union-attr]
        ids = self.layer.spark.createDataFrame([(i,) for i in data.rows], "id long")
        i, new = self.layer.insert_relation(f"schema/{data.schema}", columns, ids)
        return self.layer.relation(i), new

    def _insert_row(self, data: RowData) -> tuple[RowView, bool]:
        types = self.layer.schema_types(data.schema)
        if len(data.values) != len(types):
            raise ValueError(f"the pool has {len(types)} columns, the rows have {len(data.values)}")
        values = [int(v) if t == ColumnType.OBJECT else cast_value(v, t) for v, t in zip(data.values, types, strict=True)]
        fields = [StructField(f"v{i}", LongType() if t in (ColumnType.UINT32, ColumnType.INT32, ColumnType.OBJECT) else spark_type(t)) for i, t in enumerate(types)]
        row = self.layer.spark.createDataFrame([(*values, 0)], StructType([*fields, StructField("o", LongType())]))
        out = self.layer.insert_rows(f"schema/{data.schema}", row, [f.name for f in fields], "o").first()
        return self.view(RowIndex(data.schema, out["id"])), bool(out["created"])

    def view(self, what: SchemaIndex | ColumnsIndex | RowIndex | RelationIndex | RowData) -> SchemaView | ColumnsView | RowView | RelationView:
        """A view of an index; IndexError if nothing has it. Of a row's data: a view of the row without storing it."""
        if isinstance(what, RowData):
            types = self.layer.schema_types(what.schema)
            return RowView(None, types, tuple(cast_value(v, t) if t != ColumnType.OBJECT else int(v) for v, t in zip(what.values, types, strict=True)))
        if isinstance(what, RowIndex):
            pool = f"schema/{what.schema}"
            if not 0 <= what.row < self.layer.pool_size(pool):
                raise IndexError(f"the pool {pool!r} has no row {what.row}")
            row = self.layer.rows(pool).where(F.col("id") == what.row).first()
            return RowView(what, self.layer.types(pool), tuple(row[c] for c in self.layer.pool_columns(pool)))
        if isinstance(what, SchemaIndex):
            return SchemaView(what, self.layer.schema_types(what))
        if isinstance(what, ColumnsIndex):
            if not 0 <= what < len(self._columns):
                raise IndexError(f"no list of columns has the index {int(what)}")
            return ColumnsView(what, self._columns[what])
        return self.layer.relation(int(what))

    def contains(self, what: SchemaIndex | ColumnsIndex | RowIndex | RelationIndex) -> bool:
        try:
            self.view(what)
        except IndexError:
            return False
        return True

    def get_relation_builder(self, columns: Sequence[ColumnLayout | tuple[str, int]]) -> RelationBuilder:
        return self.layer.builder(columns)

    def insert_builder(self, builder: RelationBuilder) -> tuple[RelationView, bool]:
        """The relation of a builder's rows, all at once: its schema, its columns and its rows are interned."""
        schema, _ = self.schema(types_of(builder.columns))
        self.insert(ColumnsData(builder.columns))
        pool, labels = f"schema/{schema.index}", builder.labels
        if not labels:
            rows = self.layer.spark.range(builder.size).select(F.col("id").alias("pos"))
            self.layer.insert_rows(pool, rows, [], "pos")
            i, new = self.layer.insert_relation(pool, (), rows.select(F.col("pos").alias("id")))
            return self.layer.relation(i), new
        self.layer.insert_rows(pool, builder.rows(), labels, "pos")
        i, new = self.layer.insert_relation(pool, builder.columns, self.layer.find_rows(pool, builder.rows(), labels).select("id"))
        return self.layer.relation(i), new
