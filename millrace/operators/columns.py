"""Labels and types of columns, and their checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql.types import StructField, StructType

from ..functions.values import column_type, spark_type


@dataclass(frozen=True)
class ColumnLayout:
    label: str
    type: int

    def __str__(self) -> str:
        return f"{self.label}:{int(self.type)}"


Columns = tuple[ColumnLayout, ...]


def columns_of(layouts: Sequence[ColumnLayout | tuple[str, int]]) -> Columns:
    """Checked columns: first the types, then that no label repeats."""
    out = tuple(c if isinstance(c, ColumnLayout) else ColumnLayout(*c) for c in layouts)
    for c in out:
        column_type(int(c.type))
    if len({c.label for c in out}) < len(out):
        raise ValueError("a label repeats")
    return out


def types_of(columns: Columns) -> tuple[int, ...]:
    return tuple(int(c.type) for c in columns)


def frame_schema(columns: Columns) -> StructType:
    return StructType([StructField(c.label, spark_type(c.type)) for c in columns])
