"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), a <> b: root is the least node of its component, for the root too.

    Each round is written to the shared folder; the rounds end when the edges are stars around the roots. Only counts and
    one checksum a round come to the driver. No edges: an empty table. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    path = scratch(spark, "edges")
    edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().write.parquet(path)
    now = spark.read.schema("a long, b long").parquet(path)
    was = mark(now)
    for _ in range(rounds if was[0] else 0):
        _small_star(_large_star(now)).write.parquet(new := scratch(spark, "edges"))
        now = spark.read.schema("a long, b long").parquet(new)
        discard(spark, path)
        path = new
        if (is_ := mark(now)) == was:
            break
        was = is_
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
