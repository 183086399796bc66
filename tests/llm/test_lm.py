"""Operator 4: the model against plain computations, and what it learns from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm


def blocks(rng, sizes, ids=lm.VOCABULARY):
    """Texts of these many ids laid out as Subwords.laid_out() does."""
    parts = []
    for n in sizes:
        room = -(-n // lm.BLOCK) * lm.BLOCK
        x, y = np.zeros((2, room), np.int64)
        y[: n - 1] = rng.integers(1, ids, n - 1)
        x[1:n] = y[: n - 1]
        parts.append((x, y, (np.arange(room) < n).astype(np.float32), np.arange(room // lm.BLOCK) == 0))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def plain_log_prob(w, ids, at):
    """Of the id after ids[at], by loops and dictionaries of numbers alone: the whole text is ids, the end mark first."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    first = max(0, at // lm.BLOCK * lm.BLOCK - lm.CONTEXT)
    logits = [w["query"][ids[at]] @ w["key"][ids[j]] + w["near"][at - j] for j in range(first, at + 1)]
    a = np.exp(logits) / np.exp(logits).sum()
    h = w["embed"][ids[at]] + sum(p * w["value"][ids[j]] for p, j in zip(a, range(first, at + 1), strict=True))
    c = h @ w["wc"] + w["bc"]
    return h, c - np.log(np.exp(c).sum())


def plain_text_score(w, ids):
    """Natural log-probability of a text's ids and its end."""
    x, y, out = [lm.END, *ids], [*ids, lm.END], 0.0
    for at, t in enumerate(y):
        h, classes = plain_log_prob(w, x, at)
        z = h @ w["wu"][t // lm.PER_CLASS].astype(np.float64) + w["bu"][t // lm.PER_CLASS]
        out += classes[t // lm.PER_CLASS] + z[t % lm.PER_CLASS] - np.log(np.exp(z).sum())
    return out


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.new_weights(rng.integers(1, 50, lm.VOCABULARY)).items()}
    x, y, real, begins = blocks(rng, (40, 5, 60), 60)
    g, _ = lm.gradients(w, x, y, real, begins, 1, len(begins) - 1)
    for name in lm.SHAPES:
        for at in (np.unravel_index(np.abs(g[name]).argmax(), g[name].shape), tuple(0 for _ in g[name].shape)):
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = lm.gradients(w, x, y, real, begins, 1, len(begins) - 1)[1]
            w[name][at] = old - 1e-5
            down = lm.gradients(w, x, y, real, begins, 1, len(begins) - 1)[1]
            w[name][at] = old
            assert (up - down) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-8)


def test_scores_are_the_plain_ones_and_add_up_to_one():
    rng = np.random.default_rng(1)
    w = lm.new_weights(rng.integers(1, 50, lm.VOCABULARY))
    for k in ("query", "key", "value", "near", "wc"):
        w[k] += rng.normal(0, 0.7, w[k].shape).astype(np.float32)
    sizes = (1, 16, 17, 70)
    x, y, real, begins = blocks(rng, sizes)
    logs = lm.log_probs(w, x, y, begins) * real
    starts = np.flatnonzero(begins) * lm.BLOCK
    for n, start, got in zip(sizes, starts, np.add.reduceat(logs, starts), strict=True):
        assert got == pytest.approx(plain_text_score(w, y[start : start + n - 1].tolist()), rel=1e-4)
    ids = [lm.END, *y[starts[3] : starts[3] + 69].tolist()]
    for at in (0, 20, 69):
        here = starts[3] + at
        total = 0.0
        for t in range(lm.VOCABULARY):
            other = y.copy()
            other[here] = t
            lo = here // lm.BLOCK * lm.BLOCK
            total += float(np.exp(lm.log_probs(w, x[lo - lm.BLOCK : lo + lm.BLOCK], other[lo - lm.BLOCK : lo + lm.BLOCK], begins[lo // lm.BLOCK - 1 : lo // lm.BLOCK + 1])[here - lo + lm.BLOCK]))
        assert total == pytest.approx(1, abs=1e-4) and ids[at] == x[here]


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    w = lm.new_weights(rng.integers(1, 50, lm.VOCABULARY))
    x, y, _, begins = blocks(rng, (50, 33))
    whole, k = lm.log_probs(w, x, y, begins), 64
    assert np.allclose(whole[k:], lm.log_probs(w, x[k:], y[k:], begins[k // lm.BLOCK :]), atol=1e-5)


def corpus(spark, n=300):
    words = F.array([F.lit(x) for x in ("some words", "other words", "stone river", "Straße é", "x")])
    text = F.concat_ws(" ", F.element_at(words, (F.col("id") % 5 + 1).cast("int")), F.element_at(words, (F.col("id") % 3 + 1).cast("int")), "id")
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit("long " * 40000)).otherwise(text).alias("text"))


def test_every_text_trains_the_model_once(spark, monkeypatch):
    docs, read = corpus(spark), []

    def noted(texts, w, subwords, rate, until, own=lm._trained):
        if rate in lm.RATES:
            read.extend(bytes(r["ids"]) for r in texts.collect())
        return own(texts, w, subwords, rate, until)

    monkeypatch.setattr(lm, "_trained", noted)
    monkeypatch.setattr(lm, "PART_IDS", 2000)
    lm.with_lm_scores(docs, F.col("doc_id") % 5 == 1).count()
    ids = lm.read_texts(docs.where("doc_id % 5 <> 1").select("doc_id", F.lit(False).alias("held_out"), F.encode("text", "UTF-8").alias("t")), lm.TOKENIZER)
    assert sorted(read) == sorted(bytes(r["ids"]) for r in ids.where("kind = 0").collect())


def test_the_split_of_the_table_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_IDS", 5000)
    docs = corpus(spark)
    a, b = ({r["doc_id"]: r["score"] for r in lm.with_lm_scores(docs.repartition(n, "text"), F.col("doc_id") % 5 == 1).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4) for k in a)


def test_whole_texts_are_scored(spark):
    """The operator's score is the plain one of its own model's ids, and training makes likely what it has seen."""
    docs = corpus(spark, 60)
    t = docs.select("doc_id", (F.col("doc_id") % 5 == 1).alias("held_out"), F.encode("text", "UTF-8").alias("t"))
    read = lm.read_texts(t, lm.TOKENIZER).where("kind in (0, 2)").collect()
    pieces = {}
    for r in read:
        if r["kind"] == 2:
            pieces[r["key"]] = pieces.get(r["key"], 0) + r["n"]
    texts = lm.read_texts(t, lm.TOKENIZER).where("kind = 0 and not held_out").select(F.xxhash64("doc_id", "ids").alias("h"), "ids")
    w, subwords = lm.fit(texts, pieces)
    got = {r["doc_id"]: r["score"] for r in lm.with_lm_scores(docs, F.col("doc_id") % 5 == 1).collect()}
    for r in read:
        if r["kind"] == 0 and r["doc_id"] % 7 == 3:
            own = [i for p in np.frombuffer(bytes(r["ids"]), np.uint16) for i in subwords.flat[subwords.start[p] : subwords.start[p] + subwords.size[p]].tolist()]
            assert got[r["doc_id"]] == pytest.approx(plain_text_score(w, own) / np.log(10), rel=1e-3)
    untrained = lm.new_weights(np.ones(lm.VOCABULARY))
    assert got[3] > plain_text_score(untrained, subwords.laid_out([bytes(next(r["ids"] for r in read if r["doc_id"] == 3))])[1].tolist()) / np.log(10)


def test_most_frequent_counts_stay_below_the_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [3] * 20 + [2**40] * 30)], "key long, n long")
    for most in (10, 29, 30, 49, 50, 99, 100):
        assert counts.where(F.col("n") >= lm.most_frequent(counts, most)).count() == max(k for k in (0, 30, 50, 100) if k <= most)


def test_words_are_split_at_blanks_and_texts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", " ", "One two", "ÉTÉ é\u00a0x\ty\x0bz", "x" * 5000 + " yy", "a\nb " * 500] + ["".join(rng.choice(["aB", " ", "\t", "é", "Z"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    for split, chunk in ((1 << 18, 1 << 22), (64, 300), (7, 1)):
        monkeypatch.setattr(lm, "SPLIT_BYTES", split)
        monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
        got, of = [], {}
        for a, e, h, begin, end, data, lengths in lm.word_groups(pa.array(["skip", *(t.encode() for t in texts)], pa.binary()).slice(1)):
            assert sum(lengths) == len(h) and len(lengths) == e - a
            own = [data[b:c].tobytes().lower() for b, c in zip(begin, end, strict=True)]
            got += own
            for w, x in zip(own, h.tolist(), strict=True):
                assert of.setdefault(w, x) == x
        assert got == [w for t in texts for w in t.encode().lower().split()] and len(set(of.values())) == len(of)
        values, one, back = lm.distinct(h)
        assert np.array_equal(values[back], h) and np.array_equal(h[one], values)


def test_forgotten_words_are_counted(spark, monkeypatch):
    docs = corpus(spark, 100).select("doc_id", F.lit(False).alias("held_out"), F.encode("text", "UTF-8").alias("t")).coalesce(1)
    count = lambda: sorted(map(tuple, lm.read_texts(docs, lm.TOKENIZER).where("kind > 0").groupBy("kind", "key").agg(F.sum("n")).collect()))
    whole, name = count(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    batch = spark.conf.get(name)
    monkeypatch.setattr(lm, "CACHE", 10)
    try:
        spark.conf.set(name, 7)
        assert count() == whole
    finally:
        spark.conf.set(name, batch)
