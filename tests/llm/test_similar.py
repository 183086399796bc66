"""Near copies of the pipeline by 5-word shingles, against all pairs."""

import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as P
from millrace.llm import similar
from millrace.llm.common import CLEANUP, shared_dir

from .test_operators import DOCS, brute_fingerprint, components


def brute_shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_similar(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)


def near_copies(groups=12, copies=3):
    rng = random.Random(5)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(90, 140))]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            w[rng.randrange(len(w))] = f"y{rng.randrange(9)}"
            out.append(" ".join(w))
    return out


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], DOCS)


def expected(texts):
    prints = [brute_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if brute_similar(texts[i], texts[j])]
    least = lambda e: sorted(set(components(set(range(len(texts))), e).values()))
    return least(near), least(near + alike)


def test_near_dedup_reaches_similar_shingles(spark, tables):
    texts = [*near_copies(), "", "one two", "one two three"]
    by_bits, by_both = expected(texts)
    assert len(by_both) < len(by_bits)
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == by_both


def test_a_bucket_of_many_texts_is_dealt_out_and_joined(spark, tables, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 8)
    texts = near_copies(1, 60)
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == expected(texts)[1]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 3000])
def test_shingles_are_those_of_a_plain_split(n):
    text = " ".join(f"w{i % 1700}" for i in range(n)).upper().encode()
    own = similar.shingles(text)
    assert len(own) == len(brute_shingles(text.decode())) and len(similar.bands(own)) == (similar.BANDS if n else 0)
    assert similar.jaccard(own, own) == (1 if n else 0) and np.array_equal(own, np.unique(own))


def test_large_sets_and_those_near_the_border_meet():
    rng, lost, pairs = np.random.default_rng(9), 0, 0
    for n in (200, 380, 400, 470, 481, 500, 590, 700, 4000):
        for _ in range(40):
            own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            other = np.unique(np.concatenate([own[rng.permutation(n)[: int(n * 0.9)]], rng.integers(0, 2**64, int(n * 0.08), dtype=np.uint64)]))
            assert similar.jaccard(own, other) >= 0.8
            pairs += 1
            lost += not set(similar.bands(own).tolist()) & set(similar.bands(other).tolist())
    assert lost <= pairs * 0.003


def apart(seed):
    """Two texts whose sets have a similarity of exactly 0.8."""
    rng = random.Random(seed)
    w = [f"w{rng.randrange(3000)}" for _ in range(13)]
    return [" ".join(w), " ".join([*w[:-1], "x"])]


def test_similar_sets_that_share_no_band_are_linked(spark, tables):
    texts = [t for seed in (22799, 78596, 88822) for t in apart(seed)]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        own, other = similar.shingles(a.encode()), similar.shingles(b.encode())
        assert similar.jaccard(own, other) == 0.8 and not set(similar.bands(own).tolist()) & set(similar.bands(other).tolist())
    by_bits, by_both = expected(texts)
    assert len(by_bits) == 6 and len(by_both) == 3
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == by_both


def test_similar_sets_among_many_with_a_common_passage_are_linked(spark, tables, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 2)
    monkeypatch.setattr(similar, "MEET", 1)
    monkeypatch.setattr(similar, "DEALT", 5)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(3000)}' for _ in range(rng.randrange(30, 50)))}" for _ in range(40)]
    texts += [f"{t} {t.split()[-1]}x y" for t in texts[:20]] + [t for seed in (22799, 78596) for t in apart(seed)] + [passage, f"{passage} x"]
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == expected(texts)[1]


def test_similar_sets_share_a_first_shingle_in_any_order():
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 333, 1000]:
        for extra in range(n // 4 + 1):
            own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = rng.integers(0, (n - 4 * extra) // 5 + 1) if n >= 4 * extra else 0
            other = np.unique(np.concatenate([rng.permutation(own)[: n - gone], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
            if similar.jaccard(own, other) < 0.8:
                continue
            last = np.unique(rng.permutation(np.union1d(own, other))[: rng.integers(0, n + 1)])
            assert set(similar.first(own, last).tolist()) & set(similar.first(other, last).tolist())
            assert np.array_equal(similar.first(own), own[: n // 5 + 1])


def sets_around_a_passage(n, passage, own):
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**64, passage, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 2**64, own, dtype=np.uint64)])) for _ in range(n)]


def test_sets_that_cannot_be_similar_do_not_meet_in_a_common_passage(spark):
    # each two share 100 of 118: their first shingles hold the passage's when it comes last, but too few follow
    sets = sets_around_a_passage(60, 100, 18)
    last = np.sort(np.intersect1d(sets[0], sets[1]))
    assert similar.jaccard(sets[0], sets[1]) < 0.8 and set(similar.first(sets[0], last).tolist()) & set(last.tolist())
    rows = [(i, int(key), at, len(s), i) for i, s in enumerate(sets) for at, key in enumerate(similar.first(s, last).view(np.int64).tolist())]
    met = similar._met(spark.createDataFrame(rows, "h long, key long, at int, size int, root long"))
    assert met.count() == 0


def test_similar_sets_meet_in_the_first_shingle_that_they_share_and_pass_by_marks(spark):
    rng, rows, pairs = np.random.default_rng(8), [], 0
    for n in [*range(1, 30), 333]:
        for extra in range(n // 4 + 1):
            own = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = (n - 4 * extra) // 5 if n >= 4 * extra else 0
            other = np.unique(np.concatenate([rng.permutation(own)[: n - gone], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
            if similar.jaccard(own, other) < 0.8:
                continue
            both = len(np.intersect1d(own, other))
            assert both >= similar.least_shared(len(own), len(other))
            assert similar.may_be_similar(similar.marks(own), len(own), similar.marks(other), len(other))
            last = np.unique(rng.permutation(np.union1d(own, other))[: rng.integers(0, n + 1)])
            for h, s in ((2 * pairs, own), (2 * pairs + 1, other)):
                rows += [(h, int(key), at, len(s), h) for at, key in enumerate(similar.first(s, last).view(np.int64).tolist())]
            pairs += 1
    met = similar._met(spark.createDataFrame(rows, "h long, key long, at int, size int, root long")).collect()
    assert sorted(min(r["a"], r["b"]) // 2 for r in met) == list(range(pairs))


def test_near_dedup_leaves_only_its_decisions_on_disk(spark, tables):
    shared = Path(shared_dir(spark).removeprefix("file://")) / "millrace"
    before = {p.name for p in shared.glob("*")}
    was = spark.conf.get(CLEANUP)
    P.near_dedup(spark, docs_of(spark, near_copies(3)), tables).collect()
    assert [p.name.split("-")[0] for p in shared.glob("*") if p.name not in before] == ["decided"] and spark.conf.get(CLEANUP) == was


def test_a_group_that_few_links_join_is_whole(spark, tables, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 8)
    monkeypatch.setattr(similar, "LINKS", 1)
    texts = near_copies(2, 40)
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == expected(texts)[1]


def test_a_common_passage_is_found_in_a_sample_and_comes_last(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 20)
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(3000)}' for _ in range(20))}" for _ in range(100)]
    docs = docs_of(spark, texts)
    asked = docs.select(similar.text_key().alias("h"))
    shared = similar.shingles(passage.encode()).view(np.int64)
    assert set(shared.tolist()) <= set(similar._common(docs, asked, 1 << 20).tolist())
    assert len(similar._common(docs, asked, 5)) == 5 and not len(similar._common(docs, asked.limit(20), 1 << 20))


def test_an_exact_search_by_a_sample_misses_nothing(spark, tables, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 2)
    monkeypatch.setattr(similar, "MEET", 1)
    monkeypatch.setattr(similar, "SAMPLE", 4)
    monkeypatch.setattr(similar, "FREQUENT", 2)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(3000)}' for _ in range(rng.randrange(8, 20)))}" for _ in range(30)]
    texts += [f"{t} {t.split()[-1]}x y" for t in texts[:10]] + [t for seed in (22799, 78596) for t in apart(seed)] + [passage, f"{passage} x"]
    got = sorted(r[0] for r in P.near_dedup(spark, docs_of(spark, texts), tables).select("doc_id").collect())
    assert got == expected(texts)[1]
