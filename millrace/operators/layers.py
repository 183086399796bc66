"""Layers: a catalogue of records, row pools and relations over a frozen parent.

A layer holds what was inserted into it and reads what its ancestors hold. Ids are dense and go on from the parent's. An
insert is checked, then committed as a whole: what fails leaves the layer as it was. Tables stay distributed; the driver
keeps their numbers of rows. Threads may insert into one layer at the same time: what is new is told apart and published
under a lock, after the costly part.
"""

from __future__ import annotations

import itertools
import json
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.values import ColumnType, column_bits, column_type, normalised
from ..functions.values import fits as value_fits
from ..sources.tables import committed
from .builder import RelationBuilder
from .columns import ColumnLayout, Columns, columns_of, types_of
from .interning import contained, dense_ids, find, first_seen, missing, owner_of, rows_view

_numbers = itertools.count()
#: Tables that one table may be read from before they are written as one.
MOST_PARTS = 16
KeyTypes = Sequence[int] | Callable[[Row], Sequence[int]]


@dataclass
class _Table:
    """What one layer holds of a table: its own rows with their ids, and the ids' range [base, end)."""

    frame: DataFrame | None
    base: int
    end: int
    parts: int = 0

    def add(self, rows: DataFrame, n: int) -> None:
        """Take committed rows with the next n ids."""
        self.frame, self.parts = (rows, 1) if self.frame is None else (self.frame.unionByName(rows), self.parts + 1)
        if self.parts > MOST_PARTS:
            self.frame, self.parts = committed(self.frame, "table"), 1
        self.end += n


class Layer:
    def __init__(self, spark: SparkSession, parent: Layer | None = None, num_objects: int | None = None):
        """num_objects: objects that object columns can tell apart; None: as many as the parent, or 32 bits."""
        if num_objects is not None and num_objects > 2**32 - 1:
            raise ValueError("an object column has 32 bits at most")
        least = parent.object_bits if parent else 1
        self.object_bits = (parent.object_bits if parent else 32) if num_objects is None else max(least, max(1, (max(num_objects, 1) - 1).bit_length()))
        self.spark, self.parent, self.number = spark, parent, next(_numbers)
        self.prepare: dict[str, Callable[[DataFrame], DataFrame]] = dict(parent.prepare) if parent else {}
        self._tables: dict[tuple[str, str], _Table] = {}
        self._identity: dict[tuple[str, str], tuple[str, ...]] = {}
        self._schemas: list[tuple[int, ...]] = []
        self._declared: dict[str, tuple[int, ...]] = {}
        self._key_types: dict[str, KeyTypes] = {}
        self._lock = threading.RLock()

    # Chain -------------------------------------------------------------------------------------------------------------

    def chain(self) -> Iterator[Layer]:
        """This layer and its ancestors, this one first."""
        layer: Layer | None = self
        while layer:
            yield layer
            layer = layer.parent

    @property
    def depth(self) -> int:
        return sum(1 for _ in self.chain()) - 1

    def _end(self, key: tuple[str, str]) -> int:
        return next((x._tables[key].end for x in self.chain() if key in x._tables), 0)

    def _names(self, key: tuple[str, str]) -> tuple[str, ...]:
        for x in self.chain():
            if key in x._identity:
                return x._identity[key]
        raise IndexError(f"nothing of {key[1]!r} was inserted")

    def _frame(self, key: tuple[str, str]) -> DataFrame | None:
        """All rows along the chain, with layer: how many layers lie below the one that holds the row."""
        out = None
        for x in self.chain():
            t = x._tables.get(key)
            if t and t.frame is not None:
                own = t.frame.withColumn("layer", F.lit(x.depth))
                out = own if out is None else out.unionByName(own)
        return out

    def _insert(self, key: tuple[str, str], rows: DataFrame, identity: Sequence[str], order: str) -> DataFrame:
        """Commit what is new; rows' distinct records with id, layer and created. What fails before it is published leaves no trace."""
        distinct = committed(first_seen(rows, identity, order), "distinct")
        with self._lock:
            before, base = self._frame(key), self._end(key)
            new = distinct if before is None else committed(missing(distinct, before, identity), "new")
            n = new.count()
            fresh = committed(dense_ids(new, "first_seen", base, "id", count=n, ties=identity).drop("first_seen"), "own")
            self._identity.setdefault(key, tuple(identity))
            self._tables.setdefault(key, _Table(None, base, base)).add(fresh, n)
        created = fresh.withColumn("layer", F.lit(self.depth)).withColumn("created", F.lit(True))
        if before is None:
            return created
        old = contained(before, distinct, identity).withColumn("created", F.lit(False))
        return old.unionByName(created)

    # Symbols -----------------------------------------------------------------------------------------------------------

    def insert(self, kind: str, records: DataFrame, identity: Sequence[str], order: str, key_types: KeyTypes | None = None) -> DataFrame:
        """Records of a kind: (identity..., id, layer, created) of each distinct one.

        A record that an ancestor holds keeps its id and layer. prepare[kind] is applied to the records once, before. key_types: each record
        keys a row pool, `kind/id`; its columns are these, or what a function gives for the record's row. Other key_types or
        identity columns than before are refused before anything is stored.
        """
        known = next((x._identity["symbol", kind] for x in self.chain() if ("symbol", kind) in x._identity), tuple(identity))
        if known != tuple(identity):
            raise ValueError(f"records of {kind!r} are told apart by {', '.join(known)}")
        if key_types is not None:
            own = key_types if callable(key_types) else tuple(column_type(t) for t in key_types)
            if (held := self._keyed(kind)) is not None and held != own or held is None and self.size(kind):
                raise ValueError(f"records of {kind!r} key other pools")
        if kind in self.prepare:
            records = self.prepare[kind](records)
        out = self._insert(("symbol", kind), records, identity, order)
        if key_types is not None:
            self._key_types[kind] = own
        return out

    def _keyed(self, kind: str) -> KeyTypes | None:
        return next((x._key_types[kind] for x in self.chain() if kind in x._key_types), None)

    def find(self, kind: str, records: DataFrame) -> DataFrame:
        """records with the id of each, null if no layer holds it."""
        table = self._frame(("symbol", kind))
        return records.withColumn("id", F.lit(None).cast("long")) if table is None else find(records, table, self._names(("symbol", kind)), "id")

    def records(self, kind: str, ids: DataFrame | None = None) -> DataFrame:
        """Records with id and layer: all along the chain, or those of ids (pos, id); a missing id raises when it is read."""
        table = self._frame(("symbol", kind))
        if table is None:
            raise IndexError(f"nothing of {kind!r} was inserted")
        return table if ids is None else rows_view(ids, table, "id")

    def contains(self, kind: str, ids: DataFrame) -> DataFrame:
        """The ids (column id) that some layer holds."""
        return ids.where((F.col("id") >= 0) & (F.col("id") < self._end(("symbol", kind))))

    def size(self, kind: str) -> int:
        return self._end(("symbol", kind))

    def owner(self, kind: str, ids: DataFrame, of: str = "symbol") -> DataFrame:
        """ids with owner: the depth of the layer whose own table holds the id, null if none does."""
        layers = [x for x in reversed(list(self.chain())) if (of, kind) in x._tables]
        depth = owner_of(F.col("id"), [x._tables[of, kind].end for x in layers])
        names = F.lit(None).cast("int")
        for i, x in enumerate(layers):
            names = F.when(depth == i, x.depth).otherwise(names)
        return ids.withColumn("owner", names)

    def owner_layer(self, kind: str, i: int, of: str = "symbol") -> Layer | None:
        return next((x for x in self.chain() if (t := x._tables.get((of, kind))) and t.base <= i < t.end), None)

    def holds(self, kind: str, i: int, owner: Layer) -> bool:
        """Whether this chain holds the record of this index and owner: equal indices of other layers don't count."""
        return self.owner_layer(kind, i) is owner

    def memory_usage(self, kind: str, of: str = "symbol") -> int:
        """Bytes that the plan of this layer's own table is estimated at."""
        t = self._tables.get((of, kind))
        return 0 if t is None or t.frame is None else int(str(t.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    # Schemas and pools -------------------------------------------------------------------------------------------------

    def schemas(self) -> list[tuple[int, ...]]:
        return [s for x in reversed(list(self.chain())) for s in x._schemas]

    def schema(self, types: Sequence[int | ColumnLayout | tuple[str, int]]) -> tuple[int, bool]:
        """Index of a list of types, or of columns' types, and whether it is new; its pool, `schema/index`, is declared."""
        key = tuple(column_type(t) for t in types) if all(isinstance(t, int) for t in types) else types_of(columns_of(types))  # type: ignore[arg-type]
        with self._lock:
            known = self.schemas()
            i, new = (known.index(key), False) if key in known else (len(known), True)
            if new:
                self._schemas.append(key)
        return i, new

    def contains_schema(self, i: int) -> bool:
        return 0 <= i < len(self.schemas())

    def schema_types(self, i: int) -> tuple[int, ...]:
        """The types of a schema's index; IndexError if there is none."""
        if not self.contains_schema(i):
            raise IndexError(f"no schema has the index {i}")
        return self.schemas()[i]

    def schema_of(self, pool: str) -> int | None:
        """The index of the schema that a pool has, None if it has none: undeclared, or declared with types that are no schema."""
        try:
            types = self.types(pool)
        except IndexError:
            return None
        return self.schemas().index(types) if types in self.schemas() else None

    def declare(self, pool: str, types: Sequence[int]) -> None:
        """Give a pool its columns; once given they can't change. Pools of schemas and of key records have theirs already."""
        key = tuple(column_type(t) for t in types)
        with self._lock:
            try:
                if self.types(pool) != key:
                    raise ValueError(f"the pool {pool!r} has other columns")
            except IndexError:
                kind = pool.split("/")[0]
                if "/" in pool and (kind == "schema" or self._keyed(kind) is not None):
                    raise ValueError(f"the name {pool!r} is kept for pools of a {kind}") from None
                self._declared[pool] = key

    def types(self, pool: str) -> tuple[int, ...]:
        """A pool's types; IndexError if it isn't declared, or if there is no such schema or key record."""
        for x in self.chain():
            if pool in x._declared:
                return x._declared[pool]
        kind, _, number = pool.partition("/")
        if number.isdigit():
            i = int(number)
            if kind == "schema" and self.contains_schema(i):
                return self.schemas()[i]
            if (own := self._keyed(kind)) is not None and i < self.size(kind):
                if not callable(own):
                    return own  # type: ignore[return-value]
                record = self.records(kind).where(F.col("id") == i).first()
                types = tuple(column_type(t) for t in own(record))
                self.owner_layer(kind, i)._declared[pool] = types  # type: ignore[union-attr]
                return types
        raise IndexError(f"the pool {pool!r} is not declared")

    def pool_columns(self, pool: str) -> list[str]:
        return [f"c{i}" for i in range(len(self.types(pool)))]

    def _checked(self, pool: str, rows: DataFrame, values: Sequence[str]) -> DataFrame:
        """rows with columns c0.. of the pool's types; raises before anything is stored."""
        types = self.types(pool)
        if len(values) != len(types):
            raise ValueError(f"the pool has {len(types)} columns, the rows have {len(values)}")
        bad = F.lit(False)
        for name, t in zip(values, types, strict=True):
            bad = bad | F.col(name).isNull()
            if t in (ColumnType.UINT32, ColumnType.UINT64, ColumnType.INT32, ColumnType.INT64, ColumnType.OBJECT):
                bad = bad | ~value_fits(F.col(name), t, column_bits(t, self.object_bits))
        if values and not rows.where(bad).isEmpty():
            raise IndexError("a value does not fit its column")
        return rows.withColumns({f"c{i}": normalised(F.col(v), t) for i, (v, t) in enumerate(zip(values, types, strict=True))})

    def insert_rows(self, pool: str, rows: DataFrame, values: Sequence[str], order: str) -> DataFrame:
        """(c0..., id, layer, created) of each distinct row. IndexError: no such pool, or a value that doesn't fit; ValueError: another arity."""
        checked = self._checked(pool, rows, values)
        if not values:
            checked = checked.withColumn("c", F.lit(True))
        return self._insert(("row", pool), checked, self.pool_columns(pool) or ["c"], order)

    def find_rows(self, pool: str, rows: DataFrame, values: Sequence[str]) -> DataFrame:
        """rows with the id of each, null if no layer holds it or it has another arity: looking up what can't be stored finds nothing."""
        table, types = self._frame(("row", pool)), self.types(pool)
        if table is None or len(values) != len(types):
            return rows.withColumn("id", F.lit(None).cast("long"))
        own = rows.withColumns({f"__c{i}": normalised(F.col(v), t) for i, (v, t) in enumerate(zip(values, types, strict=True))})
        named = table.select(*[F.col(f"c{i}").alias(f"__c{i}") for i in range(len(types))], "id")
        return find(own, named, [f"__c{i}" for i in range(len(types))], "id").drop(*[f"__c{i}" for i in range(len(types))])

    def rows(self, pool: str, ids: DataFrame | None = None) -> DataFrame:
        """A pool's rows with id and layer: all along the chain, or those of ids (pos, id)."""
        self.types(pool)
        table = self._frame(("row", pool))
        if table is None:
            raise IndexError(f"the pool {pool!r} has no rows")
        return table if ids is None else rows_view(ids, table, "id")

    def pool_size(self, pool: str) -> int:
        return self._end(("row", pool))

    def resolve_rows(self, records: DataFrame, pool: str, field: str) -> DataFrame:
        """records with the row, as a struct `field_row`, that each row id in a column names; an id that the pool lacks raises when it is read."""
        rows = self.rows(pool)
        named = rows.select(F.col("id").alias("__id"), F.struct(*[c for c in rows.columns if c != "layer"]).alias(f"{field}_row"))
        both = records.join(named, F.col(field) == F.col("__id"), "left")
        wrong = F.col(field).isNotNull() & F.col("__id").isNull()
        lost = F.raise_error(F.concat(F.lit("no row with the id "), F.col(field).cast("string"))).cast(named.schema[f"{field}_row"].dataType)
        return both.withColumn(f"{field}_row", F.when(wrong, lost).otherwise(F.col(f"{field}_row"))).drop("__id")

    def view(self, outside: DataFrame | RelationBuilder) -> OutsideView:
        """Records or a builder's rows that this layer doesn't hold, read as if they were its own; nothing is stored."""
        return OutsideView(self, outside)

    # Relations ---------------------------------------------------------------------------------------------------------

    def builder(self, columns: Sequence[ColumnLayout | tuple[str, int]] = ()) -> RelationBuilder:
        return RelationBuilder(self.spark, columns_of(columns), self.object_bits)

    def insert_relation(self, pool: str, columns: Sequence[ColumnLayout | tuple[str, int]], row_ids: DataFrame) -> tuple[int, bool]:
        """Index of the relation of these labelled columns and row ids (column id), and whether it is new. See insert_relations."""
        empty = self.spark.range(1).select(F.lit(0).alias("key"), F.lit(None).cast("long").alias("id"))
        row = self.insert_relations(pool, columns, row_ids.select(F.lit(0).alias("key"), F.col("id").cast("long").alias("id")).unionByName(empty), "key").first()
        return int(row["relation"]), bool(row["created"])

    def insert_relations(self, pool: str, columns: Sequence[ColumnLayout | tuple[str, int]], rows: DataFrame, key: str) -> DataFrame:
        """(key, relation, created): for each key of rows (key, id) the index of the relation of its ids, all at once.

        Repeats and order of the ids don't matter; other labels are another relation; a null id is none, so that a key may have no
        row. New relations are numbered in the order of their least keys; created marks that key. IndexError: undeclared pool
        or ids that it lacks; ValueError: other types, or a repeated label. Relations are told apart by a digest of the ids that
        no task has to hold: number, sum and two xors of hashes. Equal digests are compared id by id, in a join.
        """
        own: Columns = columns_of(columns)
        if types_of(own) != tuple(map(int, self.types(pool))):
            raise ValueError("the columns' types are not the pool's")
        rows = rows.select(F.col(key).alias("key"), F.col("id").cast("long").alias("id"))
        if not rows.where(~((F.col("id") >= 0) & (F.col("id") < self.pool_size(pool)))).isEmpty():
            raise IndexError("a row is not in the pool")
        rows = committed(rows.distinct(), "relations")
        labels = "|".join([pool, *map(str, own)])
        digest = [
            F.count("id").alias("n"), F.coalesce(F.sum(F.col("id").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"),
            F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
        ]
        heads = committed(rows.groupBy("key").agg(*digest), "digests")
        same = ["n", "total", "x", "y"]
        with self._lock:
            base, known = self._end(_HEADS), self._frame(_HEADS)
            found = heads.select("key", F.lit(None).cast("long").alias("relation")).limit(0)
            if known is not None:
                labelled = known.where((F.col("pool") == pool) & (F.col("columns") == labels))
                pairs = heads.alias("a").join(labelled.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]).select("a.key", F.col("b.id").alias("relation"), "a.n")
                found = committed(_equal(pairs, rows, self._frame(_ROWS).select("relation", F.col("id").alias("row"))), "found")
            left, placed = heads.join(found, "key", "left_anti"), found.withColumn("created", F.lit(False))
            while True:  # a digest's least key stands for it; keys of that digest with other ids, if hashes ever collide, wait for a turn of their own
                left = committed(left, "left")
                first = committed(left.groupBy(*same).agg(F.min("key").alias("stands")), "first")
                n = first.count()
                if not n:
                    break
                numbered = committed(dense_ids(first, "stands", base, "id", count=n), "numbered")
                pairs = left.alias("a").join(numbered.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same]).select("a.key", F.col("b.id").alias("relation"), "a.n")
                body = rows.join(numbered.select(F.col("stands").alias("key"), F.col("id").alias("relation")), "key").where("id is not null").select("relation", "id")
                body = committed(body, "relationrows")
                equal = committed(_equal(pairs, rows, body.select("relation", F.col("id").alias("row"))), "equal")
                marked = equal.join(numbered.select(F.col("id").alias("relation"), "stands"), "relation").select("key", "relation", (F.col("key") == F.col("stands")).alias("created"))
                placed = placed.unionByName(marked)
                text = F.to_json(F.array(*[F.struct(F.lit(c.label).alias("label"), F.lit(int(c.type)).alias("type")) for c in own])) if own else F.lit("[]")
                heads_new = committed(numbered.select("id", F.lit(pool).alias("pool"), F.lit(labels).alias("columns"), text.alias("layout"), *same), "heads")
                self._tables.setdefault(_HEADS, _Table(None, base, base)).add(heads_new, n)
                self._tables.setdefault(_ROWS, _Table(None, 0, 0)).add(body, 0)
                base += n
                if equal.count() == left.count():
                    break
                left = left.join(equal, "key", "left_anti")
        return placed.select(F.col("key").alias(key), "relation", "created")

    def relations(self) -> DataFrame | None:
        """(id, pool, columns, layout, n, ..., layer) of all relations along the chain; None if there is none."""
        return self._frame(_HEADS)

    def relation(self, i: int) -> RelationView:
        if not 0 <= i < len(self):
            raise IndexError(f"no relation has the index {i}")
        return RelationView(self, i)

    def __len__(self) -> int:
        """Relations along the chain."""
        return self._end(_HEADS)

    def __bool__(self) -> bool:
        return True

    # Clearing ----------------------------------------------------------------------------------------------------------

    def clear(self) -> None:
        """Drop what this layer holds but the records that key pools; schemas and declarations stay."""
        self._tables = {k: t for k, t in self._tables.items() if k[0] == "symbol" and self._keyed(k[1]) is not None}

    def clear_rows(self) -> None:
        """Drop this layer's rows and relations; symbols, schemas and declarations stay."""
        self._tables = {k: t for k, t in self._tables.items() if k[0] == "symbol"}

    def clear_all(self) -> None:
        """Drop everything this layer holds, schemas and declarations too: a pool may then be declared with other columns."""
        self._tables.clear()
        self._identity.clear()
        self._schemas.clear()
        self._declared.clear()
        self._key_types.clear()


_HEADS, _ROWS = ("relation", "heads"), ("relation", "rows")


def _equal(pairs: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (key, relation, n) those whose ids are the same: key's in rows (key, id), relation's in held (relation, row); both have n."""
    shared = pairs.join(rows.where("id is not null"), "key").join(held.withColumnRenamed("row", "id"), ["relation", "id"]).groupBy("key", "relation").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(shared, ["key", "relation"], "left").where(F.coalesce("shared", F.lit(0)) == F.col("n")).groupBy("key").agg(F.min("relation").alias("relation"))


class OutsideView:
    """Records or a builder, read through a layer that doesn't hold them."""

    def __init__(self, layer: Layer, outside: DataFrame | RelationBuilder):
        self.layer, self.outside = layer, outside

    def rows(self) -> DataFrame:
        return self.outside.rows() if isinstance(self.outside, RelationBuilder) else self.outside

    def find(self, kind: str) -> DataFrame:
        """The records with the id that the layer gives each, null where it holds none."""
        return self.layer.find(kind, self.rows())

    def find_rows(self, pool: str) -> DataFrame:
        """A builder's rows with the id that the layer's pool gives each."""
        rows = self.rows()
        return self.layer.find_rows(pool, rows, [c for c in rows.columns if c != "pos"])


class RelationView:
    """A relation of a layer, read lazily. Rows are in the order of their ids."""

    def __init__(self, layer: Layer, index: int):
        self.layer, self.index = layer, index
        head = layer.relations().where(F.col("id") == index).first()
        self.pool, self.columns = head["pool"], columns_of([(c["label"], c["type"]) for c in json.loads(head["layout"])])
        self.row_ids = layer._frame(_ROWS).where(F.col("relation") == index).select("id")

    @property
    def arity(self) -> int:
        return len(self.columns)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RelationView) and self.index == other.index and self.layer.owner_layer("heads", self.index, "relation") is other.layer.owner_layer("heads", other.index, "relation")

    __hash__ = None  # type: ignore[assignment]

    def size(self) -> int:
        return self.row_ids.count()

    def rows(self) -> DataFrame:
        """(id, labels...), in no order."""
        table = self.layer.rows(self.pool)
        return contained(table, self.row_ids, ["id"]).select("id", *[F.col(f"c{i}").alias(c.label) for i, c in enumerate(self.columns)])

    def row(self, i: int) -> DataFrame:
        """The i-th row by id; IndexError if there is none."""
        if i < 0 or (at := self.row_ids.orderBy("id").offset(i).limit(1)).isEmpty():
            raise IndexError(f"the relation has no row {i}")
        return contained(self.rows(), at, ["id"])

    def contains(self, values: DataFrame, names: Sequence[str]) -> DataFrame:
        """values with held: whether the relation has the row. A row that can't be stored isn't held."""
        found = self.layer.find_rows(self.pool, values, names).withColumnRenamed("id", "__id")
        marked = self.row_ids.select(F.col("id").alias("__own"))
        return found.join(marked, F.col("__id") == F.col("__own"), "left").withColumn("held", F.col("__own").isNotNull()).drop("__id", "__own")

    def contains_rows(self, layer: Layer, pool: str, ids: DataFrame) -> DataFrame:
        """Rows of any pool, by (pos, id), with held: whether this relation has a row of the same values. Rows of other types aren't held. The rows' ids are called row."""
        rows = layer.rows(pool, ids).withColumnRenamed("id", "row")
        if layer.types(pool) != self.layer.types(self.pool):
            return rows.withColumn("held", F.lit(False))
        return self.contains(rows, layer.pool_columns(pool))


def canonical_rows(rows: DataFrame, by: Sequence[str], item: str, name: str = "row_ids") -> DataFrame:
    """Each group's distinct items as a sorted array: for groups that one row may hold. Use insert_relation() for larger ones."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(name))
