"""Dictionaries: an object graph as one table a type, with references between them.

The registry here walks objects on the driver, in the order that gives ids before their contents are visited. What makes two
objects one is what their type says (`identity`), else equality where they can be hashed, else their fields' values where they
are dataclasses that compare, else that they are the same object; the registry keeps those, so that an id stays theirs.
dictionary_refs() does the same for a table of records whose order a column gives.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interning import find, intern


@dataclasses.dataclass
class _Registered:
    name: str
    prefix: str
    fields: tuple[str, ...] | None
    project: Callable[[object], Mapping[str, object]] | None
    identity: Callable[[object], object] | None
    rows: list[dict | None] = dataclasses.field(default_factory=list)
    ids: dict[object, int] = dataclasses.field(default_factory=dict)
    kept: list[object] = dataclasses.field(default_factory=list)

    def key(self, value: object) -> object:
        """What the ids go by. A value that is told apart by place alone is kept: its place isn't used again."""
        if self.identity:
            return self.identity(value)
        try:
            hash(value)
        except TypeError:
            if dataclasses.is_dataclass(value) and type(value).__eq__ is not object.__eq__:
                return _Compared(value)
            self.kept.append(value)
            return ("place", id(value))
        return value


class _Compared:
    """A value that can't be hashed but compared: it is found among the values of its type by equality."""

    def __init__(self, value: object):
        self.value = value

    def __hash__(self) -> int:
        return hash(type(self.value))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Compared) and (self.value is other.value or self.value == other.value)


class Dictionaries:
    """Types are registered before the first serialize(). A serialize() that raises ends the registry: every later call raises."""

    def __init__(self) -> None:
        self._types: dict[type, _Registered] = {}
        self._started = self._failed = False

    def register_table(self, cls: type, name: str, prefix: str, fields: Sequence | None = None, project: Callable | None = None, identity: Callable | None = None) -> None:
        """fields: those to keep, as strings or enum members with string values; project: an object's row instead; identity: what makes two objects one.

        Names and prefixes are not empty and not used twice; a prefix doesn't end in a digit.
        """
        self._usable()
        if self._started:
            raise RuntimeError("tables are registered before the first serialize()")
        if not name or not prefix or prefix[-1].isdigit():
            raise ValueError("a table needs a name, and a prefix that doesn't end in a digit")
        if cls in self._types or any(name == t.name or prefix == t.prefix for t in self._types.values()):
            raise ValueError("a type, a name and a prefix are registered once")
        if isinstance(fields, str):
            raise TypeError("fields are a sequence of names")
        names = None if fields is None else tuple(getattr(f, "value", f) for f in fields)
        self._types[cls] = _Registered(name, prefix, names, project, identity)

    def serialize(self, value: object) -> object:
        """value as JSON values, objects of registered types as references."""
        self._usable()
        self._started = True
        try:
            return self._convert(value)
        except BaseException:
            self._failed = True
            raise

    def table(self, cls: type) -> list[dict]:
        """A copy of a type's rows, by id."""
        self._usable()
        return json.loads(json.dumps(self._types[cls].rows))

    def tables(self) -> dict[str, dict]:
        self._usable()
        return {t.name: {"prefix": t.prefix, "rows": self.table(cls)} for cls, t in self._types.items()}

    def _usable(self) -> None:
        if self._failed:
            raise RuntimeError("a serialization failed; the registry can't be used")

    def _convert(self, value: object) -> object:
        if value is None or isinstance(value, (bool, int, float, str)):
            if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**64:
                raise OverflowError("an integer of more than 64 bits")
            return value
        if type(value) in self._types:
            return self._reference(value, self._types[type(value)])
        if (other := getattr(value, "serialize_as", None)) is not None and callable(other) and not isinstance(value, type):
            return self._convert(other())
        if isinstance(value, Enum):
            return self._convert(value.value)
        if isinstance(value, Mapping):
            return {self._key(k): self._convert(v) for k, v in value.items()}
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            raise ValueError(f"{type(value).__name__} is not registered")
        if isinstance(value, Iterable):
            return [self._convert(v) for v in value]
        raise ValueError(f"{type(value).__name__} is not registered")

    @staticmethod
    def _key(k: object) -> str:
        if not isinstance(k, str):
            raise TypeError("keys are strings")
        return k

    def _reference(self, value: object, t: _Registered) -> str:
        key = t.key(value)
        if key not in t.ids:
            i = t.ids[key] = len(t.rows)
            t.rows.append(None)  # the id is taken before the contents are visited
            if t.project:
                own = t.project(value)
                if not isinstance(own, dict):
                    raise TypeError("project returns a dict with string keys")
            else:
                own = described(value)
                if t.fields is not None:
                    own = {k: own[k] for k in t.fields}
            t.rows[i] = {self._key(k): self._convert(v) for k, v in own.items()}
        return f"{t.prefix}{t.ids[key]}"


def described(value: object) -> dict[str, object]:
    """An object's fields by name: those that its describe_fields() names or gives, else the declared ones without a leading underscore.

    describe_fields() returns names, or pairs of name and value. A value of several possible types goes under the one
    field `variant`, by returning [("variant", value)].
    """
    if callable(own := getattr(value, "describe_fields", None)):
        return dict(f if isinstance(f, tuple) else (f, getattr(value, f)) for f in own())
    own = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)} if dataclasses.is_dataclass(value) else vars(value)  # type: ignore[arg-type]
    return {k: v for k, v in own.items() if not k.startswith("_")}


def field_names(cls: type) -> list[str]:
    """Declared field names in order."""
    return [f.name for f in dataclasses.fields(cls)] if dataclasses.is_dataclass(cls) else list(getattr(cls, "__annotations__", {}))


def dictionary_refs(records: DataFrame, entities: DataFrame, identity: Sequence[str], order: str, prefix: str, name: str = "ref") -> tuple[DataFrame, DataFrame]:
    """The entities' table with dense ids in first-seen order, and records with a reference `prefix + id` to the entity of their identity columns."""
    if not prefix or prefix[-1].isdigit():
        raise ValueError("a prefix is not empty and doesn't end in a digit")
    table = intern(entities, identity, order, id_name="id").drop("first_seen")
    refs = find(records, table, identity, "id").withColumn(name, F.concat(F.lit(prefix), F.col("id").cast("string"))).drop("id")
    return table, refs
