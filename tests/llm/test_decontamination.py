"""Operator 3 against brute force over all pairs of spans, and against its SQL."""

import random
import time
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontamination as D

ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog near a river bank today"), (2, "short item of six words here"), (3, None), (4, "two words"), (5, ""),
    (None, "null keyed item with a number of other words in it to be found"), (9, "The QUICK brown fox, jumps over the lazy dog near a river bank today!"), (6, "exactly these five words here"),
]


def brute(docs, items, least=D.LEAST_WORDS):
    """(doc, item, first word, words covered) of all pairs of spans, word by word."""
    of, out = {}, set()
    for k, t in items:
        if len(w := tuple(D.words(t or ""))) >= least:
            of[w] = min(of.get(w, (True, None)), (k is None, k))
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int32)
    items = [(code(item), k) for item, (_, k) in of.items()]
    for doc, t in docs:
        own = code(D.words(t or ""))
        for item, k in items:
            n = min(len(item), D.SPAN)
            if len(own) < n:
                continue
            spans, good = np.lib.stride_tricks.sliding_window_view(own, n), np.zeros(len(own) - n + 1, bool)
            for s in range(len(item) - n + 1):
                good |= (spans != item[s : s + n]).sum(axis=1) <= n * D.SUBSTITUTIONS // D.SPAN
            if good.any():
                at = np.flatnonzero(good)
                out.add((doc, k, int(at[0]), len({p + i for p in at.tolist() for i in range(n)})))
    return out


def found(spark, docs, items, parts=3, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, n_words string").repartition(parts)
    return {tuple(r) for r in D.overlaps(d, spark.createDataFrame(items, "item_id long, text string"), **options).select("doc_id", "item_id", "first_word", "n_words").collect()}


def test_odd_rows(spark):
    text = ITEMS[0][1]
    ws = text.split()
    swapped = [" ".join("zzz" if i in out else w for i, w in enumerate(ws)) for out in ((3, 8), (2, 6, 10), (0, 13), (0, 1, 2, 3))]
    docs = [
        (1, f"before {text.upper()} after"), *((2 + i, s) for i, s in enumerate(swapped)), (10, "x, " * 3000 + text), (11, "Short item, of six WORDS here."), (12, "short item of other words here"), (13, "short any of other words here"),
        (14, None), (15, ""), (16, "two words"), (17, " ".join(ws[1:])), (18, f"{text} {text}"), (None, text), (None, "innocent words"), (19, "exactly these five words here"), (20, "exactly those five words here"), (11, text), (1, f"before {text.upper()} after"),
    ]
    want = brute(docs, ITEMS)
    assert found(spark, docs, ITEMS) == want and found(spark, docs, ITEMS, parts=1) == want
    assert {w[0] for w in want if w[1] == 1} == {1, 2, 4, 5, 10, 11, 17, 18, None} and {w[0] for w in want if w[1] == 2} == {11, 12}
    assert found(spark, docs, ITEMS, least_words=2) == brute(docs, ITEMS, 2) > want
    assert found(spark, [], ITEMS) == found(spark, docs, []) == set()


def test_substitutions_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for i in range(25)]
    docs = []
    for i in range(200):
        ws = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 2:
            own = rng.choice(items)[1].split()
            a = rng.randrange(len(own))
            ws += [w if rng.random() > 0.1 else "zz" for w in own[a : a + 20]] + rng.choices(vocabulary, k=5)
        docs.append((i, " ".join(ws)))
    want = brute(docs, items)
    assert len(want) > 40 and found(spark, docs, items) == want
    monkeypatch.setattr(D, "SENT_SEEDS", 0)
    monkeypatch.setattr(D, "CHUNK_WORDS", 50)
    monkeypatch.setattr(D, "PIECE_BITS", 6)
    assert found(spark, docs, items) == want


def test_masks_lose_no_substitutions():
    for span in range(1, D.SPAN + 1):
        for out in combinations(range(span), D.substitutions(span)):
            assert any(not set(m) & set(out) for m in D.masks(span))


def test_repetitive_texts_are_cheap(spark):
    began = time.time()
    items = [(i, f"{'word ' * 400}{i}") for i in range(20)]
    got = found(spark, [(1, "word " * 4000), (2, "word " * 60000 + "19"), (3, "other " * 4000)], items)
    assert {(d, i) for d, i, _, _ in got} == {(d, i) for d in (1, 2) for i in range(20)} and {n for d, _, _, n in got if d == 1} == {4000}
    assert time.time() - began < 30


def test_sql(spark, tables):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"create view {name} as from '{tables}/{name}.parquet'")
    got = D.op3_decontamination(spark, tables)
    assert sorted(map(tuple, got.select("doc_id", "item_id", "first_word", "n_words", "item_words").collect())) == sorted(c.sql(D.OP3_SQL).fetchall()) and got.count() > 0


def test_rows_without_ids_are_told_apart(spark):
    docs = spark.createDataFrame([(None, ITEMS[0][1]), (None, "innocent")], "doc_id long, text string")
    got = D.overlaps(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    assert got.select("text_hash").distinct().count() == 1 == docs.where(F.xxhash64(F.col("text").cast("binary")).isin([r["text_hash"] for r in got.collect()])).count()
