"""Rows of nested records as text tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a cell may not hold as it is, and how it is written.
ESCAPES = {"\\": r"\\", "|": r"\|", "\r": r"\r", "\n": r"\n", "\t": r"\t"}
#: Characters that make a list's item ambiguous without quotes.
AMBIGUOUS = ',[]{}"\\|\r\n\t'

_escape = str.maketrans(ESCAPES)


def flatten_record(record: Mapping[str, object]) -> dict[tuple[str, ...], object]:
    """A record's values by path; empty records have none."""
    out: dict[tuple[str, ...], object] = {}
    todo = [((str(k),), v) for k, v in reversed(record.items())]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [((*path, str(k)), v) for k, v in reversed(value.items())]
        else:
            out[path] = value
    return out


def _plain(item: object) -> bool:
    return isinstance(item, (str, int, float)) and (s := str(item)) != "" and s.strip() == s and not set(s) & set(AMBIGUOUS)


def cell(value: object) -> str:
    """A value in one cell: nothing for None, `[a,b]` for lists of plain items, compact JSON for other lists."""
    if isinstance(value, list):
        value = f"[{','.join(map(str, value))}]" if all(map(_plain, value)) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return "" if value is None else str(value).translate(_escape)


class _Header:
    """A tree of columns: a name's own column comes before those below it, names in the order in which they came."""

    def __init__(self) -> None:
        self.below: dict[str, _Header] = {}
        self.is_column = False

    def add(self, path: tuple[str, ...]) -> None:
        node = self
        for name in path:
            node = node.below.setdefault(name, _Header())
        node.is_column = True

    def walk(self, path: tuple[str, ...] = ()) -> Iterable[tuple[str, ...]]:
        if self.is_column:
            yield path
        for name, node in self.below.items():
            yield from node.walk((*path, name))


def render_table(rows: Iterable[Mapping[str, object]], *, prefix: str | None = None, aligned: bool = False) -> str:
    """Cells between pipes under header rows, one for each level of nesting; a group's name stands over its first column.

    prefix: a first column `id` of the prefix and the row's number. aligned: cells are padded to equal widths.
    """
    records = [flatten_record(r) for r in rows]
    tree = _Header()
    for r in records:
        for path in r:
            tree.add(path)
    paths = list(tree.walk())
    if not records or not paths and prefix is None:
        return ""
    levels = max([len(p) for p in paths], default=1)
    table = [[""] * len(paths) for _ in range(levels)]
    last: tuple[str, ...] = ()
    for x, path in enumerate(paths):
        table[-1][x] = cell(path[-1])
        for y in range(len(path) - 1):
            if path[: y + 1] != last[: y + 1] or len(last) <= y + 1:
                table[y][x] = cell(path[y])
        last = path
    table += [[cell(r.get(p)) for p in paths] for r in records]
    if prefix is not None:
        ids = [""] * (levels - 1) + ["id"] + [cell(f"{prefix}{i}") for i in range(len(records))]
        table = [[i, *line] for i, line in zip(ids, table, strict=True)]
    if not aligned:
        return "\n".join("|".join(line) for line in table)
    widths = [max(len(line[x]) for line in table) for x in range(len(table[0]) - 1)] + [0]
    return "\n".join(" | ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)) for line in table)


def flat_columns(schema: StructType, sep: str = ".") -> list[tuple[str, Column]]:
    """(name, column) of every leaf of nested structs, the name with its path."""
    out = []
    for f in schema.fields:
        quoted = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StructType):
            out += [(f"{f.name}{sep}{name}", _get(quoted, path)) for name, path in _leaves(f.dataType, sep)]
        else:
            out.append((f.name, quoted))
    return out


def _leaves(t: StructType, sep: str) -> list[tuple[str, tuple[str, ...]]]:
    out: list[tuple[str, tuple[str, ...]]] = []
    for f in t.fields:
        if isinstance(f.dataType, StructType):
            out += [(f"{f.name}{sep}{n}", (f.name, *p)) for n, p in _leaves(f.dataType, sep)]
        else:
            out.append((f.name, (f.name,)))
    return out


def _get(c: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        c = c.getField(name)
    return c


def flatten_structs(df: DataFrame, sep: str = ".") -> DataFrame:
    """df with a column for each leaf of its structs."""
    return df.select(*[c.alias(name) for name, c in flat_columns(df.schema, sep)])


def render_frame(df: DataFrame, **how: object) -> str:
    """A frame as a text table, row by row; for tables that a reader can read."""
    return render_table((r.asDict(recursive=True) for r in df.toLocalIterator()), **how)  # type: ignore[arg-type]
