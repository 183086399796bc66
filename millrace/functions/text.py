"""Text of values, and indentation of what is printed."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import TextIO
from weakref import WeakKeyDictionary

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of what isn't there.
NO_VALUE, NO_POINTEE, NO_ALTERNATIVE, EMPTY_ALTERNATIVE = "<nullopt>", "<nullptr>", "<invalid>", "monostate"
INDENT_WIDTH = 4

_levels: WeakKeyDictionary = WeakKeyDictionary()


def to_string(c: Column) -> Column:
    return c.cast("string")


def to_strings(a: Column) -> Column:
    """The text of each element of an array."""
    return F.transform(a, lambda x: x.cast("string"))


def optional_text(c: Column, absent: str = NO_VALUE) -> Column:
    return F.coalesce(c.cast("string"), F.lit(absent))


def pointer_text(c: Column) -> Column:
    """Text of what a pointer points to."""
    return optional_text(c, NO_POINTEE)


def variant_text(alternatives: Mapping[str, Column], which: Column) -> Column:
    """Text of the alternative that `which` names; a null among them is the empty one, and a name that isn't there is invalid."""
    out = F.lit(NO_ALTERNATIVE)
    for name, c in alternatives.items():
        out = F.when(which == name, optional_text(c, EMPTY_ALTERNATIVE)).otherwise(out)
    return out


def indent_up(out: TextIO) -> None:
    _levels[out] = _levels.get(out, 0) + 1


def indent_down(out: TextIO) -> None:
    """A level less; not below none."""
    _levels[out] = max(0, _levels.get(out, 0) - 1)


def print_indent(out: TextIO) -> TextIO:
    out.write(" " * (INDENT_WIDTH * _levels.get(out, 0)))
    return out


@contextmanager
def indented(out: TextIO) -> Iterator[TextIO]:
    """A level more within the block. Each stream has its own level."""
    indent_up(out)
    try:
        yield out
    finally:
        indent_down(out)
