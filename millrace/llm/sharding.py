"""Sharding by rendezvous hashing: stable keys over weighted shards, in DataFrame functions only.

Every shard draws a number for every key from a hash of key and shard number; the shard with the best number, given its
weight, holds the key. A new shard can only win keys, so adding one moves rows into it and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task numbers at a time, about.
SLOT_ROWS = 50_000


def rendezvous(key: Sequence[Column], shards: int, weights: Sequence[float] | None = None, seed: int = 0) -> Column:
    """The shard 0 .. shards-1 of a key. Weights must be over 0; none: all equal.

    With weights the draw is -ln(u)/w with u uniform in (0, 1), the least wins; with equal weights that is the largest
    hash, which needs no logarithm. A null in the key counts as a value of its own.
    """
    if shards < 1 or weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("at least one shard, and a weight over 0 for each")
    if len({*(weights or [1])}) == 1:
        draw = lambda s: F.struct((-(F.xxhash64(*key, s, F.lit(seed)).bitwiseAND(F.lit(2**62 - 1)))).alias("d"), s.alias("s"))
    else:
        each = F.array(*[F.lit(float(w)) for w in weights])
        u = lambda s: (F.xxhash64(*key, s, F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)) + 0.5) / float(2**52)
        draw = lambda s: F.struct((-F.log(u(s)) / F.element_at(each, s + 1)).alias("d"), s.alias("s"))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), draw))["s"]


def with_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None, seed: int = 0) -> DataFrame:
    """docs with its own columns and size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 16 (null text: 16). slot: gapless from 0 within each shard, dealt in the order of a
    hash of the row. grown_shard: the shard with one more shard (of the mean weight). Null keys share one shard; equal
    rows get different slots; an empty table gives an empty table. Columns of docs with the names of the new ones go.

    A shard can hold any number of rows, so slots are not counted in one task a shard: rows are dealt to parts of about
    SLOT_ROWS, the parts are counted, and a row's slot is what lies in the parts before it and its place in its own.
    """
    out = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    rows = docs.count()
    parts = max(16, min(1 << 16, rows // (shards * SLOT_ROWS)))
    k = [F.col(key)]
    grown = None if weights is None else [*weights, sum(weights) / len(weights)]
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    own = docs.drop(*(c for c in out if c in docs.columns and c not in (key, text)))
    base = (
        own.withColumn("__size", F.octet_length(raw).cast("long") + 16)
        .withColumn("__crc", F.crc32(raw))
        .withColumn("__shard", rendezvous(k, shards, weights, seed))
        .withColumn("__grown", rendezvous(k, shards + 1, grown, seed))
        .withColumn("__h", F.xxhash64(F.col(key), F.col("__crc"), F.col("__size")))
        .withColumn("__part", F.pmod(F.col("__h"), F.lit(parts)).cast("int"))
    )
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = base.groupBy("__shard", "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = Window.partitionBy("__shard", "__part").orderBy("__h", key, "__crc", "__size")
    return (
        base.join(starts, ["__shard", "__part"])
        .withColumn("__slot", F.col("__start") + F.row_number().over(place) - 1)
        .select(*own.columns, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("__shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.col("__grown").cast("int").alias("grown_shard"))
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_shards(docs).drop("text")
