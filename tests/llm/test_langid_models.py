"""Models of operator 7 that are computed in Spark and held in parts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid

from .test_plain_models import PlainKneserNey


def corpus():
    rng = random.Random(8)
    large = ["kala", "mala", "sala", "lak", "kalama", "salak"]
    return [(" ".join(rng.choices(large, k=40)), "aa") for _ in range(60)] + [("zrut krutz", "bb"), ("été où", "cc")]


def test_a_small_language_keeps_its_model(spark):
    data = corpus()
    models = langid.train(spark.createDataFrame(data, "text string, lang string"))
    alphabet = len({c for t, _ in data for c in t} - {" "}) + 2
    assert models.langs == ["aa", "bb", "cc"] and len(models.parts) == 1
    for lang in models.langs:
        plain = PlainKneserNey(Counter(g for t, x in data if x == lang for r in langid.letter_runs(t) for g in langid.grams(r)), alphabet)
        rows = models.table.where((F.col("lang") == lang) & (F.col("kind") == 0)).select("h", "value").collect()
        want = {g for n in range(1, langid.ORDER + 1) for g in plain.counts[n]}
        assert len(rows) == len(want)
        got = {r["h"] % 2**64: r["value"] for r in rows}
        for g in want:
            assert got[int(langid.last_hashes([g])[0])] == pytest.approx(np.log(plain.p(g[:-1], g[-1])), rel=1e-6, abs=1e-6)


def test_parts_add_up_to_the_whole(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), "text string, lang string")
    odd = spark.createDataFrame([(1, "Malak SALAK été"), (2, "utzkrut"), (3, None), (4, ""), (5, "123"), (6, "ПРИВЕТ мир"), (7, "kala " * 30000), (7, "kala")], "doc_id long, text string").withColumn("nats", F.lit("own")).withColumn("score", F.lit(1))
    table = lambda m: sorted((r["doc_id"], len(r["text"] or ""), r["lang_pred"], round(r["score"], 4), r["rejected"], r["nats"]) for r in langid.with_language(odd, m).collect())
    whole = langid.train(frame)
    want = table(whole)
    monkeypatch.setattr(langid, "PART_ENTRIES", 60)
    parts = langid.train(frame)
    assert len(parts.parts) > 3 and all(parts.limits[x] == pytest.approx(whole.limits[x], rel=1e-5) for x in whole.langs)
    assert table(parts) == want
    sizes = [sum(len(m.h) + len(m.ctx) for m in parts.part(k).models if m) for k in range(len(parts.parts))]
    assert max(sizes) < sum(len(m.h) + len(m.ctx) for m in whole.part(0).models)


def test_limits_come_from_all_training_texts(spark):
    rng = random.Random(2)
    data = [(" ".join(rng.choices(["kala", "mala", "zrut", "lak", "q" * rng.randrange(1, 5)], k=rng.randrange(1, 6))), "aa" if i % 9 else "bb") for i in range(9000)]
    models = langid.train(spark.createDataFrame([*data, ("123", "aa"), (None, "aa")], "text string, lang string").repartition(5))
    for k, lang in enumerate(models.langs):
        h, _ = models.part(0).entropies([t for t, x in data if x == lang])
        assert models.limits[lang] == pytest.approx(np.quantile(h[:, k], langid.PASS_SHARE) * 1.05, rel=1e-9)


def test_op7_rejects_by_limits_of_all_training_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = ["kala", "mala", "zrut", "lak"]
    data = [(i, " ".join([*rng.choices(words, k=rng.randrange(1, 4)), "".join(rng.choices("kalzrut", k=4))]), ("aa", "bb")[i % 2]) for i in range(6000)]
    spark.createDataFrame([*data, (6000, None, "aa"), (6000, "12", None), (None, "kala", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda d: sorted((str(r["doc_id"]), r["lang_pred"], r["rejected"], r["score"]) for r in d.collect())
    want = rows(langid.with_language(docs, langid.train(docs, langid.crc_mod(4) != 2)))
    assert len(want) == 6003
    for entries in (langid.PART_ENTRIES, 2000):
        monkeypatch.setattr(langid, "PART_ENTRIES", entries)
        got = rows(langid.op7_langid(spark, str(tmp_path)))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-4)


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(langid, "BINS", 3)
    rng = np.random.default_rng(1)
    own = {"a": rng.normal(size=500), "b": np.repeat([1.0, 2.0, np.nextafter(2.0, 3)], 7), "c": np.array([-0.5]), "d": rng.integers(0, 4, 300) * 1e-300}
    frame = spark.createDataFrame([(k, float(x)) for k, v in own.items() for x in v], "lang string, x double")
    for share in (0.0, 0.37, 0.999, 1.0):
        got = langid.quantiles(frame, share)
        assert got.keys() == own.keys() and all(got[k] == pytest.approx(np.quantile(v, share), rel=1e-12) for k, v in own.items())
