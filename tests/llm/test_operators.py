"""The corpus operators against brute force on small fixtures that hold the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm import chat, langid, linededup, lm, media, mixing, quality, sharding, simhash
from millrace.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
LONG_LINE = "a line of more than twenty characters"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "straße", "ПРИВЕТ"]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = make(300)
    out = [(i, make(rng.randint(1, 60)), "en", f"s{i % 4}", 0) for i in range(40)]
    out += [(50 + i, base, "en", "s0", 0) for i in range(12)]
    out += [(70 + i, base.replace("w7 ", "w8 ", i), "fr", None, 0) for i in range(6)]
    out += [(90 + i, f"{make(3)}\n  {LONG_LINE.upper() if i % 2 else LONG_LINE}\t\n{make(2)}\n{LONG_LINE}", "de", "s1", 0) for i in range(5)]
    out += [(100, None, None, "s2", None), (101, "", "en", "s2", 0), (102, " \t\n", None, None, 3), (103, "one", "en", "é", 1), (104, "x " * 20000, "en", "s3", 1), (105, "1234 ,.!", "en", "s3", 1)]
    out += [(106, "line\n\nline\n", "en", "s3", 1)] + [(7, out[7][1], "en", "s3", 0)] * 2 + [(None, "no id here " * 9, "en", "s1", 0), (None, None, "fr", "s1", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).withColumn("score", F.lit("extra")).withColumn("row", F.lit(1)).withColumn("size", F.lit("x")).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return tuple((x is None, x) for x in r)


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def test_line_dedup(spark, docs, none, monkeypatch):
    holders, own = {}, rows()
    strip = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda d: -1 if d is None else d
    for d, t, *_ in own:
        for line in (t or "").split("\n"):
            if len(strip(line)) >= 20:
                holders.setdefault(strip(line), set()).add(rank(d))
    want = []
    for d, t, *_ in own:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(strip(x), ())) >= 3 and max(h) != rank(d))]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches, fanout, sent in ((1, 2, 1 << 20), (4, 2, 1 << 20), (4, 2, 0), (7, 3, 0)):
        monkeypatch.setattr(linededup, "SENT_KEYS", sent)
        got = linededup.dedup_lines(docs, batches=batches, fanout=fanout)
        assert table(got, "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=key)
    assert any(w[2] for w in want) and linededup.dedup_lines(none).count() == 0


def test_line_dedup_sql(spark, tables):
    c = duckdb.connect()
    c.sql(f"create view documents as from '{tables}/documents.parquet'")
    got = linededup.op1_linededup(spark, tables)
    assert table(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(c.sql(linededup.OP1_SQL).fetchall(), key=key)


def test_runs_compact(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    make = lambda *r: spark.createDataFrame(r, "h1 long, h2 long, docs long, holder long")
    for batch in (make((1, 1, 2, 90), (2, 2, 1, 80)), make((1, 1, 1, 50), (3, 3, 1, 60)), make((3, 3, 4, 20), (1, 1, 1, 10))):
        runs.add(batch)
    assert table(runs.totals(), "h1", "docs", "holder") == [(1, 4, 90), (2, 1, 80), (3, 5, 60)]
    assert [len(x) for x in runs.levels] == [1, 1]
    plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    runs.close()
    assert runs.totals().count() == 0


def test_targets_and_fill():
    goal = mixing.targets({"b": 100, "a": 1, None: 1000, "c": 0})
    assert goal["a"] == 3 and goal["c"] == 0 and sum(goal.values()) == pytest.approx(1101) and goal["b"] <= 300
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    rng = random.Random(1)
    for _ in range(60):
        lengths = np.array(sorted({rng.randint(1, 30) for _ in range(6)}))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, 90)
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        taken = mixing.fill(lengths, counts, budget)
        assert (taken <= counts).all() and (taken * lengths).sum() == min(sums, key=lambda s: (abs(s - budget), s))


def test_budgets_beyond_the_dynamic_program_are_met():
    def off(lengths, counts, target):
        passes, taken = mixing.plan_source(np.array(lengths), np.array(counts), target)
        assert (0 <= taken).all() and (taken <= counts).all()
        return passes * sum(x * n for x, n in zip(lengths, counts, strict=True)) + int((taken * lengths).sum()) - round(target)

    assert off([3, 5_000_000], [7, 40], 450_000_021.0) == 21  # the nearest sum there is
    assert off([3_000_000], [2], 3_000_000.0) == off([1, 3_000_000], [900_000, 1], 3_300_000.0) == 0
    assert off([2_100_000, 3_000_000], [1, 1], 5_000_000.0) == 100_000
    rng = random.Random(12)
    lengths = sorted({rng.randint(1, 20_000) for _ in range(500)} | {rng.randint(1, 10**7) for _ in range(30)})
    counts = [rng.randint(1, 40) for _ in lengths]
    size = sum(x * n for x, n in zip(lengths, counts, strict=True))
    assert all(off(lengths, counts, round(size * share)) == 0 for share in (0.013, 0.4, 1.7, 2.2))


def test_mixing(docs, none):
    got = mixing.with_taken(docs).collect()
    own = rows()
    sizes = Counter()
    for _, t, _, s, _ in own:
        sizes[s] += len(WORD.findall(t or ""))
    goal = mixing.targets(dict(sizes))
    assert len(got) == len(own) and sum(r["size"] for r in got) == sum(sizes.values())
    by = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        k = (r["source_size"], r["target"])
        by[k] = by.get(k, 0) + r["taken"]
    assert set(by) == {(sizes[s], goal[s]) for s in sizes}
    longest = {(sizes[s], goal[s]): max(len(WORD.findall(t or "")) for _, t, _, x, _ in own if x == s) for s in sizes}
    for k, taken in by.items():
        assert abs(taken - k[1]) <= longest[k] / 2 + 1
    again = mixing.with_taken(docs.repartition(3)).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, map(tuple, again)))
    assert mixing.with_taken(none).count() == 0


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good, bad = [f"good{i}" for i in range(30)], ["BUY!!", "now$$", "***"]
    data = [(i, " ".join(rng.choices(good if i % 3 else good[:5] + bad, k=30)), int(i % 3 > 0)) for i in range(300)]
    d, marks = spark.createDataFrame(data, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (999, None)], "doc_id long, quality int")
    held = F.col("doc_id") % 4 == 2
    model = quality.train(d, marks, where=~held)
    out = quality.with_scores(d, model).collect()
    assert all((r["score"] >= 0.7) == (r["predicted"] == 1) == (r["y"] == 1) for r in out if r["doc_id"] % 4 == 2)
    odd = quality.with_scores(docs, model)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").isEmpty() and odd.columns.count("score") == 1
    assert quality.with_scores(none, model).count() == 0
    empty = quality.train(none, marks)
    assert quality.with_scores(docs, empty).select("score").distinct().count() == 1


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((40, 3)), np.where(rng.random(40) < 0.5, 1, -1)
    rows_, values = [np.arange(3)] * 40, list(x)
    w, b = quality.dual_coordinate_descent(rows_, values, y, np.full(40, 0.5), epochs=2000)
    cost = lambda w, b: 0.5 * (w @ w + b * b) + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = cost(w[:3], b)
    for _ in range(300):
        assert best <= cost(w[:3] + rng.normal(0, 0.05, 3), b + rng.normal(0, 0.05)) + 1e-3


def test_sharding(docs, none):
    got = sharding.with_shards(docs, 5).collect()
    own = rows()
    assert len(got) == len(own) and {r["law"] for r in got} == {"key"}
    want = sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for _, t, *_ in own)
    assert sorted((r["text_crc32"], r["size"]) for r in got) == want
    for s in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    by = {}
    for r in got:
        assert by.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert sharding.with_shards(none).count() == 0


def test_shards_are_those_of_a_plain_draw(docs):
    def shard(key, shards):
        def draw(s):
            h = 42
            for part in ([] if key is None else [key.to_bytes(8, "little", signed=True)]) + [s.to_bytes(4, "little"), bytes(4)]:
                h = xxhash.xxh64_intdigest(part, h)
            return -(h % 2**62), s

        return min(map(draw, range(shards)))[1]

    for r in sharding.with_shards(docs, 7).select("doc_id", "shard", "grown_shard").collect():
        assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], 7), shard(r["doc_id"], 8))


def test_rendezvous(spark):
    t = spark.range(20000)
    shares = dict(t.groupBy(sharding.rendezvous([F.col("id")], 4, [1, 1, 2, 4]).alias("s")).count().collect())
    assert all(abs(shares[i] / 20000 - w / 8) < 0.02 for i, w in enumerate((1, 1, 2, 4)))
    moved = t.where(sharding.rendezvous([F.col("id")], 4, [1, 1, 2, 4]) != sharding.rendezvous([F.col("id")], 5, [1, 1, 2, 4, 2]))
    assert abs(moved.count() / 20000 - 0.2) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous([F.col("id")], 2, [1, 0])


def test_language_id(spark, docs, none):
    rng = random.Random(3)
    words = {"aa": ["kala", "mala", "sala", "lak"], "bb": ["zrut", "krut", "trz", "utz"]}
    data = [(i, " ".join(rng.choices(words[g], k=30)), g) for i in range(120) for g in [("aa", "bb")[i % 2]]] + [(500, "kala", None), (501, None, "aa")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    models = langid.train(d, F.col("doc_id") % 4 != 2)
    odd = spark.createDataFrame([(1, "Malak SALAK"), (2, "utzkrut"), (3, None), (4, ""), (5, "123 _ ..."), (6, "ПРИВЕТ мир"), (7, "kala " * 50000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.with_language(odd.withColumn("score", F.lit(1)), models).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert got[6]["rejected"] and not got[7]["rejected"] and got[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    out = langid.with_language(d.where("lang is not null and text is not null"), models)
    assert out.where("lang <> lang_pred").isEmpty()
    assert langid.with_language(none, models).count() == 0 and langid.with_language(docs, models).count() == docs.count()
    nothing = langid.train(none)
    assert {r["lang_pred"] for r in langid.with_language(odd, nothing).collect()} == {"und"}


def brute_fingerprint(text):
    ws = WORD.findall(lower(text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in near:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_simhash(docs, none):
    own = rows()
    prints = [(d, brute_fingerprint(t)) for d, t, *_ in own]
    nodes = {f for _, f in prints}
    roots = components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {r: min((d for d, f in prints if roots[f] == r and d is not None), default=None) for r in set(roots.values())}
    want = sorted(((d, f"{f:016x}", least[roots[f]]) for d, f in prints), key=key)
    assert table(simhash.with_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.with_components(none).count() == 0


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**64, 150, dtype=np.uint64)
    fps = set(centres.tolist())
    for c in centres[:60].tolist():
        for _ in range(8):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                c ^= 1 << int(b)
            fps.add(c)
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for bits, points in ((64, 1 << 20), (4, 3000)):
        old = simhash.PER_PREFIX, simhash.POINTS
        try:
            simhash.PER_PREFIX, simhash.POINTS = 2**bits, points
            edges = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
        finally:
            simhash.PER_PREFIX, simhash.POINTS = old
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in edges]
        assert all((a ^ b).bit_count() <= 4 for a, b in edges) and components(fps, edges) == want
        simhash.PER_PREFIX = 16
        more = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
        simhash.PER_PREFIX = old[0]
        assert components(fps, [(r["a"] % 2**64, r["b"] % 2**64) for r in more]) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo\\"), (2, 1, "assistant", "b"), (2, 0, "system", None), (2, 2, "user", ""), (3, 0, "critic</s>", "[INST]\\[/INST]"), (3, 0, "critic</s>", "[INST]\\[/INST]"), (3, None, None, "<|role|>x<|text|>"), (None, 5, "user", "q"), (4, 0, "user", "long " * 40000), (4, 1, "tool", "<<SYS>>\\"), (4, 2, "assistant", "</s>[INST] ok [/INST]")]


def test_chat(spark):
    d = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(d.repartition(4))).collect()}
    by = {}
    for c in sorted(CHATS, key=lambda r: tuple((x is not None, x) for x in r)):
        by.setdefault(c[0], []).append((c[2] or "", c[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learnt) and got[c]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["error"].startswith("turn 1") and got[None]["error"] == "ends after user"
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


def test_chat_sql(spark, tables, tmp_path):
    cols = "conv_id long, turn long, role string, text string"
    odd = [r for r in CHATS if r[0] is not None]
    whole = spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").union(spark.createDataFrame([(10**6 + c, *r) for c, *r in odd], cols))
    whole.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c = duckdb.connect()
    c.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op9_chat(spark, str(tmp_path))
    want = c.sql(chat.OP9_SQL)
    assert table(got, *want.columns) == sorted(want.fetchall(), key=key) and got.count() > 4


def test_chat_escapes_are_reversible():
    rng = random.Random(7)
    t = chat.INSTRUCT
    for _ in range(3000):
        s = "".join(rng.choice([*t.controls, "\\", "<", "s", ">", "[", "a"]) for _ in range(rng.randint(0, 8)))
        e = t.escape(s)
        assert t.unescape(e) == s and not any(c in e for c in t.controls)
        assert t.parse("".join(x for _, x, _ in t.turn("assistant", s))) == ("assistant", s)
        assert t.parse("".join(x for _, x, _ in t.turn(s + "r", s))) == (s + "r", s)


def test_media(spark, docs, none):
    got = table(media.with_media(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    want = []
    for d, t, *_ in rows():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        png = media.encode_png(payload, len(raw))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(png), hashlib.sha256(png).hexdigest(), media.features(np.frombuffer(payload, np.uint8).reshape(-1, 64))))
    assert got == sorted(want, key=key)
    assert media.with_media(none).count() == 0
    with pytest.raises(ValueError):
        media.decode_png(b"GIF89a")


def test_media_are_plain_pngs_with_plain_features():
    rng = random.Random(11)
    for n in (0, 1, 63, 64, 65, 1000, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        payload = media.to_payload(text)
        png, at, data = media.encode_png(payload, n), 8, b""
        assert payload[:n] == text and not any(payload[n:]) and len(payload) % 64 == 0 and len(payload) > 0 and png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
        while at < len(png):
            size, kind = int.from_bytes(png[at : at + 4], "big"), png[at + 4 : at + 8]
            body = png[at + 8 : at + 8 + size]
            assert int.from_bytes(png[at + 8 + size : at + 12 + size], "big") == zlib.crc32(kind + body)
            if kind == b"IHDR":
                assert (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), body[8:]) == (64, len(payload) // 64, bytes([8, 0, 0, 0, 0]))
            data += body if kind == b"IDAT" else b""
            at += 12 + size
        lines = zlib.decompress(data)
        rows = [lines[i + 1 : i + 65] for i in range(0, len(lines), 65)]
        assert b"".join(rows) == payload and not any(lines[::65])
        cuts = [len(rows) * i // 8 for i in range(9)]
        means = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = rows[min(a, len(rows) - 1) : max(min(a, len(rows) - 1) + 1, b)]
            means += [sum(x for r in own for x in r[c : c + 8]) / (8 * len(own)) for c in range(0, 64, 8)]
        middle = (sorted(means)[31] + sorted(means)[32]) / 2
        bits = int("".join("1" if m > middle else "0" for m in means), 2)
        counts = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in counts.values())
        got = media.features(np.frombuffer(payload, np.uint8).reshape(-1, 64)).split(":")
        assert got[0] == f"{bits:016x}" and float(got[1]) == pytest.approx(sum(payload) / len(payload), abs=6e-4) and float(got[2]) == pytest.approx(entropy, abs=6e-4)


def test_media_ranges_grow_with_the_archives():
    archives = [("a", 100), ("b", 7), ("c", 0), ("d", 250)]
    for size, most in ((10, 1000), (10, 3), (1000, 5), (64, 7)):
        plan = media.planned(archives, size, most)
        assert len(plan) <= most and all(plan)
        for name, n in archives:
            own = [(a, b) for p in plan for x, a, b in p if x == name]
            assert sum(b - a for a, b in own) == n and all(b == c for (_, b), (c, _) in zip(own, own[1:], strict=False))
    assert media.planned([], 10, 3) == []


def test_media_retries_members_alone(spark, tmp_path):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("00000000.1.png", b"first" * 100)
        z.writestr("00000001.2.png", b"other" * 100)
    raw = bytearray(buffer.getvalue())
    infos = zipfile.ZipFile(io.BytesIO(bytes(raw))).infolist()
    fails = iter([True, False])

    class Flaky(io.BytesIO):
        def read(self, n=-1):
            if next(fails, False):
                raise OSError("lost")
            return super().read(n)

    assert media.read_member(lambda: Flaky(bytes(raw)), infos[1], None) == b"other" * 100
    raw[infos[0].header_offset + 30 + len("00000000.1.png") + 3] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(raw))
    manifest = str(tmp_path / "manifest")
    spark.createDataFrame([(str(tmp_path / "a.zip"), 2, len(raw))], "path string, n_members long, bytes long").write.parquet(manifest)
    kept = {r["doc_id"]: r for r in media.read_archives(spark, manifest, errors="keep").collect()}
    assert kept[1]["media"] is None and "checksum" in kept[1]["error"] and kept[2]["media"] == b"other" * 100
    with pytest.raises(Exception, match="checksum"):
        media.read_archives(spark, manifest).collect()


def test_lm_scores(spark, docs, none):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    own = rows()
    split = lambda t: WORD.findall(lower(t or ""))
    out = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 5 == 1
    counts = Counter(w for d, t, *_ in own if not out(d) for w in [*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, *_ in own:
        ws = [*split(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want.append((d, out(d), len(ws), sum(w in counts for w in ws), n, round(base, 6)))
    old = lm.KNOWN_WORDS
    for known in (old, 10):
        lm.KNOWN_WORDS = known
        got = lm.with_lm_scores(docs, held).cache()
        lm.KNOWN_WORDS = old
        assert table(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)) == sorted(want, key=key)
        assert got.where("score is null or score >= 0").isEmpty()
    assert lm.with_lm_scores(none).count() == 0


def test_lm_scores_an_empty_training_set(docs):
    got = lm.with_lm_scores(docs.limit(5), F.lit(True)).collect()
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0}
