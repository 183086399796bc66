"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a span of words: it hashes the positions that it cares for and ignores the rest. A span of twelve
words has the masks of two out of four blocks, so whichever two words differ, some mask sees only equal ones: no overlap
with so few substitutions in a span is lost. Seeds of test items and of documents meet in a join on their hashes, after a
bit array of the test seeds has kept out nearly all others; what meets is verified word by word.

Equal spans of one text are one: a text that repeats itself costs what its distinct spans cost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import as_bytes, map_batches, text_key, written

#: Words of a span at most, and how many of so many words may differ.
SPAN, SUBSTITUTIONS = 12, 2
#: Items with fewer words are no evidence of a leak: they find nothing. A parameter of overlaps().
LEAST_WORDS = 5
#: Words of documents that are hashed at a time; distinct words that a worker remembers.
CHUNK_WORDS, CACHE = 1 << 18, 1 << 18
#: Bits for each test seed, and log2 of the bits in all, at least and at most, and in a piece that a task makes. A seed sets three of them.
SEED_BITS, LEAST_BITS, MOST_BITS, PIECE_BITS = 32, 10, 30, 19
#: Test seeds up to which their hashes and their table are sent to the documents' tasks; a larger table is joined by shuffling what passed the bit array.
SENT_SEEDS = 1 << 20

#: Runs of letters, digits and underscores.
_word = re.compile(r"\w+")
_mul = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64)) for i in range(SPAN)]
_codes: dict[str, int] = {}


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


def substitutions(span: int) -> int:
    """How many words of a span may differ: as many in proportion as of SPAN, rounded down."""
    return span * SUBSTITUTIONS // SPAN


def masks(span: int = SPAN) -> list[list[int]]:
    """Positions that each mask cares for: half of twice as many blocks as words may differ, or all words if none may."""
    n = substitutions(span)
    if not n:
        return [list(range(span))]
    cuts = [span * i // (2 * n) for i in range(2 * n + 1)]
    return [[p for b in keep for p in range(cuts[b], cuts[b + 1])] for keep in combinations(range(2 * n), n)]


def word_codes(text: str) -> np.ndarray:
    """A text's words as 64-bit hashes."""
    own = words(text)
    if len(_codes) > CACHE:
        _codes.clear()
    get = _codes.get
    return np.array([get(w) or _codes.setdefault(w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))) for w in own], np.uint64)


def seeds(codes: np.ndarray, span: int, number: int, mask: list[int]) -> np.ndarray:
    """Hashes of the seeds that start at each word of a run: those whose span doesn't fit are wrong."""
    n = max(0, len(codes) - span + 1)
    h = np.full(n, (span * 64 + number + 1) * 0x632BE59BD9B4E019 % 2**64, np.uint64)
    for p in mask:
        h += codes[p : p + n] * _mul[p]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class KnownSeeds:
    """Which hashes may be of test seeds: a bit array in which a hash has three places, and the sorted hashes themselves if they are few."""

    def __init__(self, bits: int):
        self.bits, self.bytes = bits, np.zeros(1 << (bits - 3), np.uint8)
        self.hashes: np.ndarray | None = None

    def which(self, h: np.ndarray) -> np.ndarray:
        """Where in h there is one."""
        found, low = None, np.uint64((1 << self.bits) - 1)
        for cell in (lambda x: x >> np.uint64(64 - self.bits), lambda x: x & low, lambda x: (x >> np.uint64(17)) & low):
            at = cell(h if found is None else h[found]).astype(np.int64)
            own = np.flatnonzero((self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            found = own if found is None else found[own]
        if self.hashes is not None and len(found):
            at = np.minimum(np.searchsorted(self.hashes, h[found]), len(self.hashes) - 1)
            found = found[self.hashes[at] == h[found]] if len(self.hashes) else found[:0]
        return found


def _known_seeds(table: DataFrame, n: int) -> KnownSeeds:
    """Of the n hashes (h) of a table. Tasks make pieces of the bit array, so the driver gets its bytes, 2^MOST_BITS bits at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (SEED_BITS * n).bit_length()))
    out, piece_bits = KnownSeeds(bits), min(bits, PIECE_BITS)

    def piece(rows: pa.Table) -> pa.Table:
        own = rows.column("cell").to_numpy()
        marks = np.zeros(1 << piece_bits, bool)
        marks[own & (len(marks) - 1)] = True
        return pa.table({"at": [int(own[0]) >> piece_bits], "bytes": [np.packbits(marks, bitorder="little").tobytes()]})

    low = F.lit((1 << bits) - 1)
    cells = F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 17).bitwiseAND(low))
    cells = table.select(F.explode(cells).alias("cell")).distinct()
    size = 1 << (piece_bits - 3)
    for r in cells.groupBy(F.shiftright("cell", piece_bits).alias("part")).applyInArrow(piece, "at long, bytes binary").toLocalIterator():
        out.bytes[r["at"] * size : (r["at"] + 1) * size] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    if n <= SENT_SEEDS:
        out.hashes = np.unique(table.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    return out


def _distinct_spans(codes: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct spans (a row each) among those that start at `at`, and where each starts."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, span)[at])
    own, back = np.unique(rows.view(f"V{8 * span}").ravel(), return_inverse=True)
    by = np.argsort(back, kind="stable")
    return own.view(np.uint64).reshape(-1, span), np.split(at[by], np.cumsum(np.bincount(back, minlength=len(own)))[:-1])


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _seed_rows(docs: DataFrame, keys: Sequence[str], spans: Sequence[int], known) -> DataFrame:
    """Of each row of docs (keys, t) its seeds that `known`, a broadcast KnownSeeds, may have, each distinct span once: (keys, h, span, own, at)."""
    families = [(n, i, m) for n in spans for i, m in enumerate(masks(n))]
    fields = [StructField("h", LongType()), StructField("span", IntegerType()), StructField("own", ArrayType(LongType())), StructField("at", ArrayType(IntegerType()))]
    schema = StructType([*(docs.schema[k] for k in keys), *fields])

    def look(chunk: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Hash texts side by side; spans that reach into the next text are left out. Row, h, span, own, at and numbers of at, of each distinct span."""
        codes = np.concatenate([c for _, c in chunk])
        texts = np.array([i for i, _ in chunk])
        starts = np.cumsum([0] + [len(c) for _, c in chunk])
        for n, i, m in families:
            h = seeds(codes, n, i, m)
            hit = known.value.which(h)
            doc = np.searchsorted(starts, hit, "right") - 1
            fits = hit + n <= starts[doc + 1]
            hit, doc = hit[fits], doc[fits]
            if not len(hit):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(codes, n)[hit]
            whole = np.zeros(len(hit), np.uint64)
            for p in range(n):
                whole = (whole ^ (whole >> np.uint64(31)) ^ rows[:, p]) * _mul[p]
            order = np.lexsort((hit, whole, doc))
            hit, doc, rows = hit[order], doc[order], rows[order]
            new = np.ones(len(hit), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            yield texts[doc[first]], h[hit[first]].view(np.int64), np.full(len(first), n), rows[first].ravel().view(np.int64), hit - starts[doc], np.diff(np.append(first, len(hit)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            chunk, size, last = [], 0, b.num_rows - 1
            for i, t in enumerate(b.column(b.num_columns - 1)):
                chunk.append((i, word_codes(t.as_py().decode("utf-8", "replace"))))
                size += len(chunk[-1][1])
                if size < CHUNK_WORDS and i < last:
                    continue
                row, h, span, own, at, times = [list(c) for c in zip(*look(chunk), strict=True)] or [[]] * 6
                chunk, size = [], 0
                row, span = _joined(row, np.int64), _joined(span, np.int32)
                cols = [pa.array(_joined(h, np.int64)), pa.array(span), _lists(_joined(own, np.int64), span), _lists(_joined(at, np.int32), _joined(times, np.int64))]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in range(len(keys))), *cols], schema.names)
        _codes.clear()  # the worker goes on to other stages

    return map_batches(docs.select(*keys, "t"), run, schema)


def overlaps(docs: DataFrame, tests: DataFrame, item_key: str = "item_id", keys: Sequence[str] = ("doc_id",), least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each document and test item that overlap: the keys, text_hash, item_id, first_word, n_words, item_words.

    Words are runs of letters, digits and underscores in lower case. A document overlaps an item if a span of SPAN words of
    the item (all of an item with fewer) lies in it with at most substitutions() other words: 2 of 12, 1 of 6 to 11, none of
    fewer. first_word: where the first such span begins in the document, from 0; n_words: words of the document in any.
    Null and empty texts, and items of fewer than least_words words, have none. Items of equal words are one: of their ids the
    smallest (null only if all are). Rows of equal keys with unlike texts are told apart by text_hash; equal rows are one. Empty
    tables give an empty table; columns besides the keys and the text are ignored.

    The documents are read once, however many items there are, and aren't shuffled. What the documents' tasks hold is the bit
    array, and the test seeds themselves up to SENT_SEEDS of them.
    """
    spark = docs.sparkSession
    items = tests.select(F.col(item_key).cast("long").alias("item_id"), as_bytes("text").alias("t"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [word_codes(t.as_py().decode("utf-8", "replace")) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in own], pa.binary()), pa.array([len(c) for c in own], pa.int32())], ["item_id", "codes", "item_words"])

    coded = map_batches(items, read, "item_id long, codes binary, item_words int").where(F.col("item_words") >= least_words)
    coded = written(coded.groupBy("codes", "item_words").agg(F.min("item_id").alias("item_id")), "items")
    lengths = [r[0] for r in coded.select(F.least("item_words", F.lit(SPAN))).distinct().collect()]
    names = [*keys, "text_hash", "item_id", "first_word", "n_words", "item_words"]

    def spans(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            item, total, h_, other = [], [], [], []
            for k, raw, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = np.frombuffer(raw, np.uint64)
                span = min(n, SPAN)
                for i, m in enumerate(masks(span)):
                    h = seeds(codes, span, i, m)
                    for one, at in zip(*_distinct_spans(codes, np.arange(len(h)), span), strict=True):
                        item.append(k)
                        total.append(n)
                        h_.append(h[at[0]])
                        other.append(one.view(np.int64))
            cols = [pa.array(item, pa.int64()), pa.array(total, pa.int32()), pa.array(np.array(h_, np.uint64).view(np.int64)), pa.array(other, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["item_id", "item_words", "h", "other"])

    held = written(map_batches(coded.select("item_id", "codes", "item_words"), spans, "item_id long, item_words int, h long, other array<long>"), "testspans")
    # a span that many items hold meets the documents once
    classes = held.select("h", "other").distinct()
    n = classes.count()
    own = docs.select(*keys, text_key().alias("text_hash"), as_bytes("text").alias("t")).where("octet_length(t) > 0")
    known = spark.sparkContext.broadcast(_known_seeds(classes, n))
    met = _seed_rows(own, [*keys, "text_hash"], sorted(lengths), known)
    met = met.join(F.broadcast(classes) if n <= SENT_SEEDS else classes, "h")
    equal = F.aggregate(F.zip_with("own", "other", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    allowed = sum((F.when(F.col("span") == s, substitutions(s)).otherwise(0) for s in lengths), F.lit(0))
    good = met.where((F.size("own") == F.size("other")) & (F.col("span") - equal <= allowed)).select(*keys, "text_hash", "span", "at", "other").distinct()
    members = held.select("other", "item_id", "item_words").distinct()
    found = good.join(F.broadcast(members) if n <= SENT_SEEDS else members, "other")
    whole = found.groupBy(*keys, "text_hash", "item_id", "item_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.max("span").alias("span"))
    steps = F.zip_with(F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.col("span")))
    return whole.withColumn("n_words", (F.col("span") + F.aggregate(steps, F.lit(0), lambda a, b: a + b)).cast("long")).select(
        *[F.col(c) for c in names[: len(keys) + 2]], F.element_at("at", 1).cast("long").alias("first_word"), "n_words", F.col("item_words").cast("long").alias("item_words")
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of documents with benchmark: doc_id, item_id, first_word, n_words, item_words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


#: Blocks of four words instead of seeds: of the three in a span, two substitutions leave one. Items of fewer than SPAN words aren't
#: looked for; the tables have none.
OP3_SQL = r"""
with docs as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where text is not null),
items as (select min(item_id) as item_id, w from (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from benchmark where text is not null) where len(w) >= 12 group by w),
doc_blocks as (select doc_id, p, array_to_string(w[p + 1 : p + 4], ' ') as block from (select doc_id, w, unnest(range(len(w) - 3)) as p from docs where len(w) >= 12)),
item_blocks as (select item_id, s, array_to_string(w[s + 1 : s + 4], ' ') as block from (select item_id, w, unnest(range(len(w) - 3)) as s from items)),
pairs as (
  select distinct doc_id, item_id, p - o as p, s - o as s
  from doc_blocks join item_blocks using (block) cross join (select unnest([0, 4, 8]) as o)
),
good as (
  select distinct doc_id, item_id, p, len(i.w) as item_words
  from pairs join docs d using (doc_id) join items i using (item_id)
  where p >= 0 and s >= 0 and p + 12 <= len(d.w) and s + 12 <= len(i.w)
    and list_sum([cast(d.w[p + k] = i.w[s + k] as integer) for k in range(1, 13)]) >= 10
),
steps as (select *, least(12, coalesce(lead(p) over (partition by doc_id, item_id order by p) - p, 12)) as more from good)
select doc_id, item_id, min(p) as first_word, cast(sum(more) as bigint) as n_words, cast(max(item_words) as bigint) as item_words from steps group by doc_id, item_id
"""
