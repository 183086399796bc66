"""Links between documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band of MinHash values; their sets are then compared exactly. Sets of up to LARGE shingles meet by a
function for each value; larger ones by the least hash in each of as many ranges of the hashes, which costs a lookup a
range. Sets near the border have both. Buckets of more than CHUNK texts are dealt into chunks, in each band by another hash,
so that no task holds a large group and texts of one group still meet in most bands.

In a bucket, sets are told apart by their marks, the parities of their hashes' counts in about as many places as they have
shingles: marks differ in no more places than the sets in shingles. Pairs that the marks let pass are few; the texts
of these alone are read again, and their sets compared exactly.

Bands and chunks leave some similar sets apart, so an exact search follows between what they have not joined. In any one order
of all shingles, two similar sets of sizes m and n share one of the first m // 5 + 1 and n // 5 + 1. The order is that of the
hashes, but shingles in which many unjoined sets meet, and those that are frequent in a sample of these sets, come last. The first shingle that two similar sets share has, in either
one, at least as many after it as they must share; so an unjoined pair meets only in shingles of which this holds. Pairs
that meet are compared unless their marks tell that they can't be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, passing, sent_if_small, text_key, written
from .components import connected
from .simhash import digests, fingerprint

WIDTH, LEAST = 5, 0.8
#: A pair at the least similarity shares a band with probability 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5
#: Distinct shingles up to which a set has a value from each function; from LEAST times as many on it has one from each range.
LARGE = 480
#: Texts that are compared with one another at most, links by bands that a text keeps; shingles that meet the hash functions at a time.
CHUNK, LINKS, STEP = 64, 3, 1 << 10
#: How often shingles are put last, how many at most, and for how many pairs a row; texts, about, of which all shingles are counted for it, and the least count.
ROUNDS, LAST, MEET, SAMPLE, FREQUENT = 4, 1 << 20, 8, 1 << 12, 8
#: Rows of one shingle in a part of a join.
DEALT = 1 << 10

_rng = np.random.default_rng(17)
_factors = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_masks = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_mixers = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_salts = _rng.integers(0, 2**63, (2, BANDS), dtype=np.uint64)
#: Where the ranges of hashes begin.
_ranges = np.array([i * 2**64 // (BANDS * ROWS) for i in range(BANDS * ROWS + 1)][:-1], np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles of a text with A-Z lower-cased; a shorter text is one shingle."""
    parts = [x.view(np.uint64).ravel() for x in digests(text.lower().split(), width, 43)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _least_by_function(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), STEP):
        np.minimum(least, ((own[None, i : i + STEP] ^ _masks[:, None]) * _factors[:, None]).min(axis=1), out=least)
    return least


def _least_by_range(own: np.ndarray) -> np.ndarray:
    """The least hash of each range; an empty range takes the next one's that has any, marked with how far that is."""
    at = np.searchsorted(own, _ranges)
    ends = np.append(at[1:], len(own))
    full = np.flatnonzero(at < ends)
    after = np.searchsorted(full, np.arange(len(at)))
    there = full[after % len(full)]
    away = (there - np.arange(len(at))) % len(at)
    return own[at[there]] + away.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of a set's values; none for an empty set."""
    out = []
    for kind, values in enumerate((_least_by_function, _least_by_range)):
        if (0 < len(own) <= LARGE) if kind == 0 else len(own) >= LEAST * LARGE:
            mixed = values(own).reshape(BANDS, ROWS)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _mixers
            key = (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) + _salts[kind]
            out.append(((key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def first(own: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Of a set, the hashes of which a similar set's first ones have one: the least, those in last (sorted) after all others."""
    n = len(own) // 5 + 1
    if last is None or not len(last):
        return own[:n]
    late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
    return np.concatenate([own[~late], own[late]])[:n]


def least_shared(m: int, n: int) -> int:
    """The least number of shingles that similar sets of sizes m and n share."""
    return (4 * (m + n) + 8) // 9


def marks(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls to each of 2^k places, packed: more than the set has, at least 8."""
    places = max(8, 1 << len(own).bit_length())
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places).astype(np.uint8) & 1)


def may_be_similar(x: np.ndarray, m: int, y: np.ndarray, n: int) -> bool:
    """Whether sets of sizes m and n can be similar by their marks x and y; true of all that are."""
    if 5 * min(m, n) < 4 * max(m, n):
        return False
    while len(x) != len(y):
        x, y = sorted((x, y), key=len)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= m + n - 2 * least_shared(m, n)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, fp (operator 8's fingerprint), h (a hash of the text), keys (of the bands), size, first and marks (of the set) for each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps, keys, sizes, firsts, marked = [], [], [], [], []
            for t in b.column(2):
                own = t.as_py()
                fps.append(int.from_bytes(fingerprint(own), "big", signed=True))
                own = shingles(own)
                keys.append(bands(own))
                sizes.append(len(own))
                firsts.append(first(own).view(np.int64))
                marked.append(marks(own).tobytes())
            cols = [b.column(0), pa.array(fps, pa.int64()), b.column(1), _lists(keys), pa.array(sizes, pa.int32()), _lists(firsts), pa.array(marked, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "h", "keys", "size", "first", "marks"])

    own = docs.select(F.col("doc_id").cast("long"), text_key().alias("h"), as_bytes("text").alias("t"))
    return map_batches(own, run, "doc_id long, fp long, h long, keys array<long>, size int, first array<long>, marks binary")


def sketched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp, h) of docs, and members: sketches of the distinct texts; both written, to last."""
    with passing(docs.sparkSession):
        t = written(sketches(docs), "sketches")
        return written(t.select("doc_id", "fp", "h"), "rows", lasting=True), written(t.drop("doc_id").dropDuplicates(["h"]), "members", lasting=True)


def forest(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Pairs (later, earlier) of rows (fp, size, marks) whose marks let them pass, that join all such pairs and equal fingerprints; what is joined already isn't compared."""
    fps, sizes, marked = rows["fp"].tolist(), rows["size"].tolist(), [np.frombuffer(x, np.uint8) for x in rows["marks"]]
    alike: dict[int, int] = {}
    top = [alike.setdefault(fp, i) for i, fp in enumerate(fps)]

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    kept = []
    for i in range(len(top)):
        for j in range(i):
            if root(i) != root(j) and may_be_similar(marked[i], sizes[i], marked[j], sizes[j]):
                top[root(i)] = root(j)
                kept.append((i, j))
    return kept


def _texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, t) of the rows of docs whose texts' hashes (h) are asked, written."""
    return docs.select(text_key().alias("h"), as_bytes("text").alias("t")).join(sent_if_small(asked), "h", "left_semi")


def _sets_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(h, own) of the texts asked: the set of shingles as bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["h", "own"])

    return map_batches(_texts_of(docs, asked).dropDuplicates(["h"]), run, "h long, own binary")


def _similar(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of written pairs of texts' hashes a, b, which stand for ra, rb: (ra, rb) as (a, b) of those whose sets are similar."""
    sets = written(_sets_of(docs, written(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct(), "asked")), "sets")
    both = pairs.join(sets.withColumnsRenamed({"h": "a", "own": "x"}), "a").join(sets.withColumnsRenamed({"h": "b", "own": "y"}), "b").select("ra", "rb", "x", "y")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            similar = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= LEAST for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(similar, pa.bool_()))

    return map_batches(both, verify, "a long, b long")


def _by_bands(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of similar sets that share a band's bucket, or a chunk of a large one: of a text, to LINKS others before it."""
    each = members.select("h", "fp", F.explode("keys").alias("key"))
    buckets = each.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("h").alias("lo"), F.bit_xor("h").alias("x"), F.min("fp").alias("f0"), F.max("fp").alias("f1"))
    # buckets of one fingerprint need no link; small buckets of the same texts are compared once
    buckets = buckets.where("f0 <> f1").withColumn("own", F.when(F.col("n") > CHUNK, F.col("key")).otherwise(0))
    buckets = written(buckets.groupBy("n", "lo", "x", "own").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    chunk = F.pmod(F.xxhash64("h", "key"), F.ceil(F.col("n") / CHUNK)).cast("int").alias("chunk")
    dealt = each.join(sent_if_small(buckets), "key").select("h", "key", chunk)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        pairs = np.array(forest(rows), np.int64).reshape(-1, 2)
        h, fps = rows["h"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64)
        return pd.DataFrame({"a": h[pairs[:, 0]], "b": h[pairs[:, 1]], "ra": fps[pairs[:, 0]], "rb": fps[pairs[:, 1]]})

    met = dealt.join(members.select("h", "fp", "size", "marks"), "h").groupBy("key", "chunk").applyInPandas(meet, "a long, b long, ra long, rb long").distinct()
    # a large group's texts meet others in each band, and a few links join it; what they leave apart, the exact search joins
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b"), "b"))
    return _similar(written(met.withColumn("nth", nth).where(F.col("nth") <= LINKS).drop("nth"), "pairs"), docs)


def _tokens(sets: DataFrame) -> DataFrame:
    return sets.select("h", F.posexplode("first").alias("at", "key"))


def _meeting(rows: DataFrame) -> DataFrame:
    """(key, n, pairs) of the keys that rows of several roots share: their rows, and pairs of unlike roots of which one set may be the smaller."""
    counts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("9 * at <= size")).alias("s"))
    counts = counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("s")).alias("own"))
    return counts.select("key", "n", (F.col("n") * F.col("s") - F.col("own")).alias("pairs")).where("pairs > 0")


def _shared(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (h, key, at, size, root) of first shingles that several sets share, written. sets: (h, first); roots: (h, size, root), written."""
    n = F.count(F.lit(1)).over(Window.partitionBy("key"))
    with passing(sets.sparkSession):
        rows = written(_tokens(sets).withColumn("n", n).where("n > 1").drop("n"), "shared")
        return written(rows.join(sent_if_small(roots), "h").select("h", "key", "at", "size", "root"), "sharing", lasting=True)


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, ra, rb) of unjoined texts that meet in one of the written rows (of _shared) so that it can be the first they share: a's set is the smaller."""
    parts = F.ceil(F.col("n") / DEALT).cast("int")
    keyed = rows.join(sent_if_small(written(_meeting(rows), "meeting")), "key")
    # a similar set's shingles after the ninth part of a smaller one's are too few
    left = keyed.where("9 * at <= size").select("key", F.pmod(F.xxhash64("h"), parts).cast("int").alias("part"), F.col("h").alias("a"), F.col("at").alias("i"), F.col("root").alias("ra"), F.col("size").alias("m"))
    right = keyed.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("h").alias("b"), F.col("at").alias("j"), F.col("root").alias("rb"), F.col("size").alias("n"))
    may = "ra <> rb and 5 * m >= 4 * n and (m < n or (m = n and a < b)) and least(m - i, n - j) >= (4 * (m + n) + 8) div 9"
    return left.join(right, ["key", "part"]).where(may).select("a", "b", "ra", "rb").distinct()


def _holding(sets: DataFrame, keys: np.ndarray) -> DataFrame:
    """h of the sets whose first shingles hold one of keys, written."""
    sent = F.broadcast(sets.sparkSession.createDataFrame(pa.table({"key": keys})))
    return written(_tokens(sets).join(sent, "key", "left_semi").select("h").distinct(), "asked")


def _common(docs: DataFrame, asked: DataFrame, most: int) -> np.ndarray:
    """Shingles, up to `most`, that are frequent in about SAMPLE of the texts asked (written), if there are more: those of passages that many share, of which first shingles show a few only."""
    n = asked.count()
    if n <= SAMPLE:
        return np.zeros(0, np.int64)
    some = asked.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(-(-n // SAMPLE))) == 0)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py()).view(np.int64) for t in b.column(1)])], ["h", "keys"])

    each = map_batches(_texts_of(docs, some).dropDuplicates(["h"]), run, "h long, keys array<long>").select(F.explode("keys").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(FREQUENT, 2 * MEET * SAMPLE // n))
    return counts.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()["key"].to_numpy()


def _left_apart(members: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Links (a, b) between roots of links' components: of all similar sets that links don't join, none is left out."""
    spark = members.sparkSession
    roots = connected(links).select(F.col("node").alias("fp"), "root")
    some = members.where("size > 0")
    roots = written(some.select("h", "fp", "size").join(sent_if_small(roots), "fp", "left").select("h", "size", F.coalesce("root", "fp").alias("root")), "roots")
    now = some.select("h", "first")
    rows = seen = _shared(now, roots)
    # shingles in which more than MEET pairs a row meet come last in the order; any order finds all, so how many do is free
    last = np.zeros(0, np.int64)
    updates = touched = None
    for _ in range(ROUNDS):
        known = spark.createDataFrame(pa.table({"key": last}))
        many = _meeting(seen).where(F.col("pairs") > F.col("n") * MEET).join(F.broadcast(known), "key", "left_anti")
        new = many.orderBy(F.desc("pairs"), "key").limit(LAST - len(last)).select("key").toArrow()["key"].to_numpy()
        if not len(new):
            break
        asked = _holding(now, new)
        also = np.setdiff1d(_common(docs, asked, LAST - len(last) - len(new)), last)
        if len(also):
            # all sets follow one order: those that hold any of what is put last now are read again
            new = np.union1d(new, also)
            asked = _holding(now, new)
        last = np.union1d(last, new)
        sent = spark.sparkContext.broadcast(np.sort(last.view(np.uint64)))

        def again(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([first(shingles(t.as_py()), sent.value).view(np.int64) for t in b.column(1)])], ["h", "first"])

        fresh = written(map_batches(_texts_of(docs, asked), again, "h long, first array<long>").dropDuplicates(["h"]), "first")
        sent.destroy()
        updates = fresh if updates is None else updates.join(sent_if_small(asked), "h", "left_anti").unionByName(fresh)
        touched = asked if touched is None else touched.union(asked)
        now = some.select("h", "first").join(sent_if_small(touched), "h", "left_anti").unionByName(updates)
        # what has come into the first shingles is all in fresh sets; their keys alone are counted again
        seen = _tokens(fresh).join(sent_if_small(roots), "h")
    if updates is not None:
        rows = _shared(now, roots)
    pairs = _met(rows)
    own = members.select("h", "size", "marks")
    both = pairs.join(own.withColumnsRenamed({"h": "a", "size": "m", "marks": "x"}), "a").join(own.withColumnsRenamed({"h": "b", "size": "n", "marks": "y"}), "b").select("a", "b", "ra", "rb", "x", "m", "y", "n")

    def by_marks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = ([np.frombuffer(v, np.uint8) for v in b.column(c).to_pylist()] for c in ("x", "y"))
            may = [may_be_similar(*pair) for pair in zip(x, b.column("m").to_pylist(), y, b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], ["a", "b", "ra", "rb"]).filter(pa.array(may, pa.bool_()))

    return _similar(written(map_batches(both, by_marks, "a long, b long, ra long, rb long"), "pairs"), docs)


def similar_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of texts of docs whose closure is that of all similar sets of shingles. members: of sketched(docs).

    Only keys, hashes and marks are shuffled to find the candidates; texts and sets of candidates alone follow. The links are
    written, to last.
    """
    spark = members.sparkSession
    with passing(spark):
        with passing(spark):
            links = written(_by_bands(members, docs).where("a <> b").distinct(), "links", lasting=True)
        return written(links.unionByName(_left_apart(members, docs, links)), "links", lasting=True)
