"""A permutation that is the same on every machine, for sequences on the driver, and a scalable order for tables."""

from __future__ import annotations

from collections.abc import Callable, MutableSequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform_index(draw: Callable[[], int], bound: int, low: int = 0, high: int = 2**64 - 1) -> int:
    """A uniform number below bound from a generator of uniform numbers low..high; the first draws that would bias it are refused."""
    size = high - low + 1
    if bound < 1:
        raise ValueError("bound must be positive")
    if bound > size:
        raise ValueError("bound exceeds the generator's range")
    refused = size % bound
    while (x := draw() - low) < refused:
        pass
    return x % bound


def portable_shuffle(items: MutableSequence, draw: Callable[[], int], low: int = 0, high: int = 2**64 - 1) -> None:
    """Permute items in place, filling the last place first."""
    for last in range(len(items) - 1, 0, -1):
        pick = uniform_index(draw, last + 1, low, high)
        items[last], items[pick] = items[pick], items[last]


def shuffled(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """df in an order drawn from its keys and the seed: another permutation than portable_shuffle()'s, without a driver."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)
