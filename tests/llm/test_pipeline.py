"""The pipeline's stages on the small tables, each against a plain computation over its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm import mixing, simhash
from millrace.llm.common import written

from .test_decontamination import brute
from .test_operators import DOCS, brute_fingerprint, components, rows
from .test_similar import brute_shingles


@pytest.fixture(scope="module")
def inputs(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumn("extra", F.lit(1))
    out = [docs]
    for name, f in P.STAGES:
        out.append(written(f(spark, out[-1], tables), name))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_names_and_columns(inputs):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    for df in inputs[1:5]:
        assert df.columns == inputs[0].columns
    assert set(inputs[0].columns) | {"shard", "slot"} <= set(inputs[5].columns)


def test_quality_keeps_most(inputs, spark, tables):
    kept = set(ids(inputs[1]))
    labels = spark.read.parquet(f"{tables}/labels.parquet").collect()
    good = [r["doc_id"] for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.2 * len(bad)


def test_near_dedup_keeps_one_of_each_group(inputs):
    texts = {r["doc_id"]: r["text"] for r in inputs[1].collect()}
    prints, sets = {d: brute_fingerprint(t) for d, t in texts.items()}, {d: brute_shingles(t) for d, t in texts.items()}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    roots = components(set(texts), [(a, b) for a in texts for b in texts if a < b and alike(a, b)])
    assert ids(inputs[2]) == sorted(set(roots.values()))


def test_decontamination_drops_what_overlaps(inputs, spark, tables):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in brute([(r["doc_id"], r["text"]) for r in inputs[2].collect()], items)}
    assert leaked and set(ids(inputs[2])) - set(ids(inputs[3])) == leaked


def test_mixing_and_sharding_take_effect(inputs):
    counts = [r["count"] for r in inputs[4].groupBy("doc_id").count().collect()]
    assert max(counts) <= 3 and inputs[5].count() == inputs[4].count()
    for r in inputs[5].groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("last"), F.count_distinct("slot").alias("d")).collect():
        assert r["n"] == r["last"] + 1 == r["d"]


def test_odd_rows_pass(spark, tables):
    docs = spark.createDataFrame(rows(), DOCS)
    for _, f in P.STAGES:
        assert f(spark, docs, tables).count() <= 3 * docs.count()
        assert f(spark, docs.limit(0), tables).count() == 0
    kept = P.near_dedup(spark, docs, tables)
    assert kept.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    assert simhash.with_components(kept).select("fingerprint").distinct().count() == kept.count()


def test_rows_of_equal_ids_are_told_apart(spark, tables):
    leak = spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"]
    texts = [f"{w} " * 3 + " ".join(f"{w}{i * j % 71}" for i in range(90)) for j, w in enumerate(("stone", "river", "cloud", "grain"), 3)]
    data = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, leak), (None, "innocent words"), (6, leak), (6, "other innocent words"), (9, texts[0])]
    docs = spark.createDataFrame([(d, t, "en", "web", 1, "own", "p", "k", 7) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, __id string, __what int")
    names = lambda df: sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in df.collect())
    rank = lambda keep: sorted((d is None, d, t) for d, t in keep)
    out = P.near_dedup(spark, docs, tables)
    assert out.columns == docs.columns and names(out) == rank([(9, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (6, leak), (None, "innocent words"), (6, "other innocent words")])
    assert names(P.decontamination(spark, docs, tables)) == rank([x for x in data if x[1] != leak])
    kept = P.quality(spark, docs, tables)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} <= {"own"} and kept.schema["score"] == docs.schema["score"]


def test_equal_rows_share_the_copies_of_the_mix(spark, tables):
    data = [(1, "one two three four", "a")] * 40 + [(2, "x " * 30, "b"), (3, "y " * 200, "b"), (None, "", "b"), (None, "", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken = mixing.with_taken(docs).groupBy("doc_id").agg(F.sum("copies")).collect()
    got = dict(P.mixing(spark, docs, tables).groupBy("doc_id").count().collect())
    assert got.get(None) == 2 and all(got.get(d, 0) == n for d, n in taken if d is not None)
