"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits have a point within r bits of both. So each fingerprint emits its ball of radius r, the
shuffle brings equal points together, and what shares a point is a colliding pair. Points are shuffled in a compact form: a
fingerprint goes once to each prefix that its ball touches, and the prefix's task makes the ball's points itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, ship, written
from .components import connected

#: Points of balls that a task has in memory at a time.
POINTS = 1 << 19
#: Fingerprints that a prefix stands for, about.
PER_PREFIX = 512
#: Parts that a component's fingerprints are dealt into where they meet their component's least id.
SALTS = 32
#: A fingerprint of more than one in HOT of all rows is treated as hot.
HOT = 1024
#: Shingles that are hashed at a time.
SLICE = 1 << 16


def digests(words: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """Of a text's width-word shingles (of all words, if there are fewer), 8 bytes a row, SLICE rows at a time."""
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, digest = max(1, len(words) - width + 1) if words else 0, xxhash.xxh64_digest
    last = ends[min(width, len(words)) :]
    for i in range(0, n, SLICE):
        raw = b"".join([digest(joined[s : e - 1], seed) for s, e in zip(ends[i : min(n, i + SLICE)], last[i : i + SLICE], strict=False)])
        yield np.frombuffer(raw, np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> bytes:
    """The 64-bit SimHash, highest bit first, of the width-word shingles of a text with A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    n, ones = max(1, len(words) - width + 1), np.zeros(64, np.int64)
    for raw in digests(words, width, seed):
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for each row. Null, empty and blank texts: 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [int.from_bytes(fingerprint(t.as_py(), width, seed), "big", signed=True) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("t")), run, "doc_id long, fp long")


def _ball(v: np.ndarray, r: int, bit: int) -> np.ndarray:
    """All points up to r flips away in the bits from bit on; a row a value."""
    one = np.uint64(1)
    flips = [np.uint64(0)] + [one << np.uint64(i) for i in range(bit, 64)] if r else [np.uint64(0)]
    if r > 1:
        flips += [(one << np.uint64(i)) | (one << np.uint64(j)) for i, j in combinations(range(bit, 64), 2)]
    return v[:, None] ^ np.array(flips, np.uint64)[None, :]


def _points(n: int, r: int, bit: int) -> int:
    k = 64 - bit
    return n * (1 + (k if r else 0) + (k * (k - 1) // 2 if r > 1 else 0))


def _meet(v: np.ndarray, own: np.ndarray, r: np.ndarray, bit: int, out: list[np.ndarray]) -> None:
    """Add pairs (owner of the least index, other owner) of owners whose points are equal. v: values whose bits below bit are done."""
    if len(v) < 2:
        return
    if bit < 64 and sum(_points(int((r == k).sum()), k, bit) for k in (0, 1, 2)) > POINTS:
        is_one, flip = (v >> np.uint64(bit)) & np.uint64(1), np.uint64(1) << np.uint64(bit)
        for want in (0, 1):
            same = is_one == want
            near = ~same & (r > 0)
            _meet(np.concatenate([v[same], v[near] ^ flip]), np.concatenate([own[same], own[near]]), np.concatenate([r[same], r[near] - 1]), bit + 1, out)
        return
    balls, owners = [], []
    for k in (0, 1, 2):
        if (at := r == k).any():
            ball = _ball(v[at], k if bit < 64 else 0, bit)
            balls.append(ball.ravel())
            owners.append(np.repeat(own[at], ball.shape[1]))
    points, owner = np.concatenate(balls), np.concatenate(owners)
    order = np.sort(points)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
    hit = np.zeros(1 << 20, bool)
    hit[((twice * mix) >> shift).astype(np.int64)] = True
    at = np.flatnonzero(hit[((points * mix) >> shift).astype(np.int64)])
    points, owner = points[at], owner[at]
    by = np.lexsort((owner, points))
    points, owner = points[by], owner[by]
    start = np.concatenate([[True], points[1:] != points[:-1]])
    head = owner[np.flatnonzero(start)][np.cumsum(start) - 1]
    pair = head != owner
    if pair.any():
        out.append(np.unique(np.stack([head[pair], owner[pair]]), axis=1))


def forest(fps: np.ndarray, bucket: int, bits: int, radius: int) -> np.ndarray:
    """Links that join what is linked within a prefix: of the fingerprints whose balls touch it, a pair for each link kept.

    Every pair within 2 * radius bits that meets at a point with this prefix is linked by those kept, directly or not.
    """
    low = np.uint64((1 << bits) - 1)
    flips = np.bitwise_count((fps & low) ^ np.uint64(bucket)).astype(np.int64)
    found: list[np.ndarray] = []
    _meet((fps & ~low) | np.uint64(bucket), np.arange(len(fps)), radius - flips, bits, found)
    top: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := top.get(i, i)) != i:
            top[i] = i = top.get(j, j)
        return i

    kept = []
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        near = np.bitwise_count(fps[pairs[0]] ^ fps[pairs[1]]) <= 2 * radius
        for a, b in pairs[:, near].T.tolist():
            x, y = root(a), root(b)
            if x != y:
                top[max(x, y)] = min(x, y)
                kept.append((a, b))
    return fps[np.array(kept, np.int64).reshape(-1, 2)]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose closure is that of all pairs within 2 * radius bits."""
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2")
    spark = fps.sparkSession
    ship(spark)
    bits = min(24, max(0, (fps.count() // PER_PREFIX).bit_length()))
    masks = [0] + [1 << i for i in range(bits)] + ([(1 << i) | (1 << j) for i, j in combinations(range(bits), 2)] if radius > 1 else [])

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = forest(rows["fp"].to_numpy(np.int64).view(np.uint64), int(key[0]), bits, radius)
        return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

    prefix = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    return (
        fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
        .select("fp", prefix.bitwiseXOR(F.col("m")).alias("prefix"))
        .groupBy("prefix")
        .applyInPandas(meet, "a long, b long")
    )


def with_components(docs: DataFrame, width: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs.

    Rows link at 2 * radius or fewer differing bits of their fingerprints; component_id is the smallest doc_id that links
    reach, the row's own included (null only if all there are null). Texts without words have fingerprint 0 and link like any
    other. Rows with equal ids each have their fingerprint and component. An empty table gives an empty table.

    Equal fingerprints are one node, so copies never meet pairwise. What shares a point lies within 2 * radius of one
    another; one of it is linked to the rest, in numbers linear in the points.
    """
    return components_of(written(fingerprints(docs, width), "simhash"), radius)


def roots_of(nodes: DataFrame, radius: int = 2, more: DataFrame | None = None) -> DataFrame:
    """(fp, root) of the fingerprints (column fp, distinct) that a link reaches; the others are alone. more: further links (a, b)."""
    near = links(nodes.select("fp"), radius)
    return connected(near if more is None else near.union(more)).select(F.col("node").alias("fp"), "root")


def least_of(nodes: DataFrame, roots: DataFrame, least: str) -> DataFrame:
    """nodes with `least` as the least of its component. A component's rows are dealt into SALTS parts by fingerprint, so a hub fills no task."""
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    linked = written(nodes.join(roots, "fp").select("fp", least, "root", salt), "rooted")
    lowest = linked.groupBy("root").agg(F.min(least).alias("__least")).select("root", "__least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    named = linked.join(lowest, ["root", "salt"]).select("fp", "__least")
    return nodes.join(named, "fp", "left").withColumn(least, F.coalesce("__least", least)).drop("__least")


def components_of(t: DataFrame, radius: int = 2, more: DataFrame | None = None) -> DataFrame:
    """As with_components, of rows (doc_id, fp). more: further links (a, b) between fingerprints."""
    nodes = written(t.groupBy("fp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "nodes")
    named = written(least_of(nodes, roots_of(nodes, radius, more), "component_id"), "named")
    # fingerprints of over 1/HOT of all rows: fewer than HOT of them, so they are broadcast and none fills a task
    hot = F.col("n") * HOT > max(1, t.count())
    large = F.broadcast(named.where(hot))
    both = t.join(large, "fp").unionByName(t.join(large, "fp", "left_anti").join(named.where(~hot), "fp"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, fingerprint, component_id."""
    return with_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
