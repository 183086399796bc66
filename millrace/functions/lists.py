"""Canonical lists: sorted, and without repeats where asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonicalized(a: Column, dedup: bool = True) -> Column:
    """Sorted (and without repeats); null stays null. Floats must be without negative zero."""
    return F.array_sort(F.array_distinct(a) if dedup else a)


def is_canonical(a: Column, dedup: bool = True) -> Column:
    return a == canonicalized(a, dedup)
