"""Operators 5 and 7 against plain versions with dictionaries and loops."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import langid, quality


class PlainKneserNey:
    """Interpolated Kneser-Ney by its recursion, straight from counts of the longest n-grams."""

    def __init__(self, counts, alphabet):
        self.counts, self.alphabet = [Counter() for _ in range(langid.ORDER + 1)], alphabet
        for g, n in counts.items():
            self.counts[len(g)][g] += n
        for n in range(langid.ORDER, 1, -1):
            before = defaultdict(set)
            for g in self.counts[n]:
                before[g[1:]].add(g[0])
            for g, those in before.items():
                self.counts[n - 1][g] += len(those)
        self.discounts = [0.0]
        for n in range(1, langid.ORDER + 1):
            ones, twos = (sum(c == k for c in self.counts[n].values()) for k in (1, 2))
            self.discounts.append(min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9))

    def p(self, context, char):
        n = len(context) + 1
        after = {g: c for g, c in self.counts[n].items() if g[:-1] == context}
        lower = self.p(context[1:], char) if n > 1 else 1 / (self.alphabet + 1)
        if not after:
            return lower
        total, d = sum(after.values()), self.discounts[n]
        return max(after.get(context + char, 0) - d, 0) / total + d * len(after) / total * lower


def spark_model(spark, counts):
    """The one language's model that Spark makes of these counts."""
    rows = langid.kneser_ney(spark.createDataFrame([("x", g, n) for g, n in counts.items()], "lang string, gram string, n long")).collect()
    tables = [[(r["gram"], r["value"]) for r in rows if r["kind"] == k] for k in (0, 1)]
    arrays = [(langid.last_hashes([g for g, _ in t]), np.array([v for _, v in t], np.float32)) for t in tables]
    return langid.KneserNey(*arrays, next(r["value"] for r in rows if r["kind"] == 2))


def test_language_models_are_the_plain_ones(spark):
    rng = random.Random(4)
    runs = ["".join(rng.choices("abcdé", (5, 3, 2, 1, 1), k=rng.randint(1, 9))) for _ in range(120)]
    counts = Counter(g for r in runs for g in langid.grams(r))
    plain, model = PlainKneserNey(counts, 7), spark_model(spark, counts)  # five letters and two marks
    assert 0.1 < plain.discounts[langid.ORDER] < 0.9
    for r in [*runs[:15], *("".join(rng.choices("abcdéxyß", k=6)) for _ in range(15))]:
        s = langid.START + r + langid.END
        points = np.array([ord(c) for c in s])
        h, at = langid._hashes(points), np.arange(1, len(s))
        got = model.log_probs([x[at] for x in h], [x[at - 1] for x in h], np.minimum(at + 1, langid.ORDER))
        want = [math.log(plain.p(s[max(0, i - langid.ORDER + 1) : i], s[i])) for i in at]
        assert got == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_the_plain_model_adds_up_to_one():
    counts = Counter(g for r in ("banana", "bandana", "nab", "ban") for g in langid.grams(r))
    plain = PlainKneserNey(counts, 5)
    for context in ("", "b", "ban", "anan", langid.START + "ba", "zzzz"):
        seen = sum(plain.p(context, c) for c in [*"abdn", langid.END])
        assert seen + plain.p(context, "?") == pytest.approx(1)  # alphabet of 5 and one share for what isn't in it


def test_entropies_are_sums_over_runs(spark):
    rng = random.Random(6)
    data = [(" ".join("".join(rng.choices(x, k=rng.randint(2, 6))) for _ in range(12)), lang) for lang, x in (("aa", "kalmi"), ("bb", "zrutk")) for _ in range(20)]
    models = langid.train(spark.createDataFrame(data, "text string, lang string"))
    alphabet = len({c for t, _ in data for c in t} - {" "}) + 2
    text = "Kala zruk, mila; 7 UTK"
    h, chars = models.part(0).entropies([text])
    for k, lang in enumerate(models.langs):
        plain = PlainKneserNey(Counter(g for t, x in data if x == lang for r in langid.letter_runs(t) for g in langid.grams(r)), alphabet)
        total = n = 0
        for r in re.findall("[a-z]+", text.lower()):
            s = langid.START + r + langid.END
            total -= sum(math.log(plain.p(s[max(0, i - langid.ORDER + 1) : i], s[i])) for i in range(1, len(s)))
            n += len(s) - 1
        assert n == chars[0] and h[0, k] == pytest.approx(total / n, rel=1e-5)


def plain_features(text):
    tokens = re.findall(r"[!-/:-@\[-`{-~]+|[^\x00-\x20!-/:-@\[-`{-~]+", text)
    return {*tokens, *zip(tokens, tokens[1:], strict=False)}


def plain_margins(train, y, texts, c=1.0):
    """Margins of the optimum of the hinge loss over naive Bayes features, by dual ascent on a full matrix until it stands still."""
    names = sorted({f for t in train for f in plain_features(t)}, key=str)
    at = {f: i for i, f in enumerate(names)}
    has = np.zeros((len(train), len(names)))
    for i, t in enumerate(train):
        has[i, [at[f] for f in plain_features(t)]] = 1
    counts = [1 + has[y == k].sum(axis=0) for k in (1, -1)]
    rest = [(1 << quality.BITS) - len(names)] * 2
    ratios = np.log(counts[0] / (counts[0].sum() + rest[0])) - np.log(counts[1] / (counts[1].sum() + rest[1]))
    unseen = math.log((counts[1].sum() + rest[1]) / (counts[0].sum() + rest[0]))
    scaled = lambda x, extra: x * ratios / math.sqrt(((x * ratios) ** 2).sum() + extra * unseen**2 + 1e-12)
    x = np.stack([scaled(row, 0) for row in has])
    full, cost, alpha = np.hstack([x, np.ones((len(x), 1))]), np.array([c * len(y) / (2 * (y == k).sum()) for k in y]), np.zeros(len(y))
    w = np.zeros(full.shape[1])
    for _ in range(3000):
        moved = 0.0
        for i in range(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ full[i]) - 1) / (full[i] @ full[i]), 0), cost[i])
            w += (new - alpha[i]) * y[i] * full[i]
            moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-9:
            break
    out = []
    for t in texts:
        own = plain_features(t)
        row = np.zeros(len(names))
        row[[at[f] for f in own if f in at]] = 1
        out.append(scaled(row, len([f for f in own if f not in at])) @ w[:-1] + w[-1])
    return np.array(out)


def test_quality_margins_are_the_plain_ones(monkeypatch):
    rng = random.Random(7)
    good, bad = [f"good{i}" for i in range(25)], [f"bad{i}" for i in range(15)] + ["!!", "$"]
    make = lambda y: " ".join(rng.choices(good if y > 0 else good[:12] + bad, k=rng.randint(3, 15)))
    y = np.array([1 if i % 3 else -1 for i in range(90)])
    train, texts = [make(k) for k in y], [make(k) for k in (1, -1) * 20] + ["", "never seen words", "good1"]
    plain = plain_margins(train, y, texts)
    monkeypatch.setattr(quality.dual_coordinate_descent, "__defaults__", (3000, 5))
    rows = [quality.document_features(t.encode()) for t in train]
    model = quality.fit(rows, (y > 0).astype(int))
    assert model.margins([t.encode() for t in texts]) == pytest.approx(plain, abs=0.02)
    assert model.scores([t.encode() for t in texts]) == pytest.approx(1 / (1 + np.exp(-(model.a * plain + model.b))), abs=0.02)
