"""A corpus pipeline: quality, near-dedup, decontamination, mixing and sharding of documents, in this order.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and its decisions take effect: rows go
or are repeated. All but the last return the columns of documents. A stage's result is written to the shared folder and
read again for the next; tables that a stage writes on its way go as soon as its decisions are written.

Decisions are of rows, told apart by id and text: rows of equal ids, or without one, are documents of their own if their
texts differ, and copies if not. They are made on ids and hashes; texts are shuffled only where rows are counted
out (mixing, sharding), or where more rows go than may be broadcast. Null and empty texts, repeated rows, empty tables and
further columns, whatever their names, pass through as the operators' docstrings say; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, id_key, passing, sent_if_small, text_key, written
from millrace.llm.decontamination import overlaps
from millrace.llm.mixing import with_taken
from millrace.llm.quality import train, with_scores
from millrace.llm.sharding import with_shards
from millrace.llm.similar import similar_links, sketched
from millrace.llm.simhash import least_of, roots_of

#: Documents whose probability of label 1 is below this go. Half: a document goes if label 0 is likelier.
QUALITY_LEAST = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to a sample of the labelled ones, doesn't reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = fresh(docs, "score"), fresh(docs, "predicted")
    return with_scores(docs, model, names=(score, predicted)).where(F.col(score) >= QUALITY_LEAST).select(*docs.columns)


def _keyed(docs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, str]:
    """docs joined (left) with decisions (id, h, what...), a row a key; the decision's columns get names that docs lacks. Also what `what` is called now."""
    k, h, what = (fresh(docs, n) for n in ("__id", "__h", "__what"))
    own = docs.withColumns({k: id_key(), h: text_key()})
    return own.join(decisions.select(F.col("id").alias(k), F.col("h").alias(h), F.col("what").alias(what)), [k, h], "left"), what


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document: of the smallest id, a null id last, then of the smallest hash of the text.

    Near copies have a Jaccard similarity of 0.8 or more of their 5-word shingles, or fingerprints within 4 bits. Of equal
    rows (id and text) of that document one stays.
    """
    with passing(spark):
        t, members = sketched(docs)
        rank = F.struct(F.col("doc_id").isNull().alias("last"), id_key().alias("id"), F.col("h").alias("h"))
        nodes = written(t.groupBy("fp").agg(F.min(rank).alias("first")), "nodes")
        first = least_of(nodes, roots_of(nodes, more=similar_links(members, docs)), "first").select(F.col("first.id").alias("id"), F.col("first.h").alias("h")).distinct()
        rows = t.groupBy(id_key().alias("id"), "h").agg(F.count(F.lit(1)).alias("n")).join(first.withColumn("stays", F.lit(True)), ["id", "h"], "left")
        decided = rows.where("stays is null or n > 1").select("id", "h", F.coalesce("stays", F.lit(False)).alias("what"))
        decided = written(decided, "decided", lasting=True)
    own, what = _keyed(docs, sent_if_small(decided))
    once = own.where(F.col(what)).dropDuplicates([c for c in own.columns if c not in docs.columns])
    return own.where(F.col(what).isNull()).unionByName(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    with passing(spark):
        hits = overlaps(docs.select(id_key().alias("id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keys=("id",))
        leaked = written(hits.select("id", F.col("text_hash").alias("h"), F.lit(True).alias("what")).distinct(), "leaked", lasting=True)
    own, what = _keyed(docs, sent_if_small(leaked))
    return own.where(F.col(what).isNull()).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most three times; documents without words stay once. Equal rows share their copies out."""
    taken = with_taken(docs.select("doc_id", "text", "source"))
    n = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    shared = taken.groupBy(id_key().alias("id"), F.col("text_hash").alias("h")).agg(F.struct(F.count(F.lit(1)).alias("rows"), F.sum(n).alias("copies")).alias("what"))
    own, what = _keyed(docs, shared)
    rows, copies = F.col(f"{what}.rows"), F.col(f"{what}.copies")
    place, copy = fresh(own, "__place"), fresh(own, "__copy")
    keys = [c for c in own.columns if c not in docs.columns and c != what]
    own = own.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])))
    times = F.floor(copies / rows).cast("int") + F.when(F.col(place) <= copies % rows, 1).otherwise(0)
    return own.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, text_crc32, law, shard, slot and grown_shard."""
    return with_shards(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL: DuckDB has neither the hashes of fingerprints and shards nor the classifier. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = written(stage(spark, docs, sf_dir), name, lasting=True)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
