"""Language ID by interpolated Kneser-Ney character models, one a language.

A text is its runs of letters in lower case; each run is scored with a start and an end mark, so what a run costs does not
depend on its place and is computed once. Counts of character n-grams cover all training texts. Continuation counts, discounts
and probabilities are computed from them in Spark, and no n-gram is left out of the models, which are sorted hash arrays.

A character's probability needs the n-grams that end with it and their contexts, all of which share the character before.
So models of any size are held in parts, by language and class of that character: each part is sent by itself, and a text's
score is the sum of what the parts give.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import crc_mod, fresh, map_batches, written

ORDER = 5
#: The share of each language's training texts that the rejection thresholds are set to let pass (5 % above), and bins by which it is found.
PASS_SHARE, BINS = 0.999, 1 << 12
#: Distinct runs that a worker remembers; distinct runs that are counted before they are sent on.
CACHE, FLUSH = 1 << 20, 1 << 19
#: Runs that are scored at a time.
CHUNK = 1 << 18
#: Entries of models that a task holds at a time, and classes of characters by which a language's model is parted.
PART_ENTRIES, CLASSES = 1 << 24, 64
#: Characters that count as evidence for the score at most.
EVIDENCE = 64
UNKNOWN = "und"
START, END = "\x02", "\x03"

#: Runs of word characters without decimal digits and underscores; letter_runs() keeps those with a letter.
_run = re.compile(r"[^\W\d_]+")
_powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(ORDER)], np.uint64)


def letter_runs(text: str) -> list[str]:
    runs = _run.findall(text.lower())
    return runs if not runs or runs[0].isalpha() and text.isascii() else [r for r in runs if any(map(str.isalpha, r))]


def grams(run: str) -> list[str]:
    """For each character after the start mark, the longest n-gram that ends with it."""
    s = START + run + END
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


def _hashes(points: np.ndarray) -> list[np.ndarray]:
    """By n - 1: of each position, the hash of the n characters that end there (wrong where fewer are there)."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(ORDER):
        part = np.zeros(len(x), np.uint64)
        part[n:] = x[: max(0, len(x) - n)] * _powers[n]
        h = h + part
        y = h ^ np.uint64(n + 1)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(y ^ (y >> np.uint64(32)))
    return out


def _class_of(points: np.ndarray) -> np.ndarray:
    """The class of characters by their code points."""
    return ((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)


def last_hashes(grams: list[str]) -> np.ndarray:
    """The hash of each n-gram (1 to ORDER characters)."""
    sizes = np.array([len(g) for g in grams], np.int64)
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.choose(sizes - 1, [x[np.cumsum(sizes) - 1] for x in _hashes(points)]) if grams else np.zeros(0, np.uint64)


class KneserNey:
    """A part of one language's model: sorted hashes of n-grams with their log-probability, and of contexts with the log of what they leave to shorter ones."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], unseen: float, classes: np.ndarray | None = None):
        """grams, contexts: hashes and logs, in any order. unseen: log-probability of a character that was never seen. classes: whose characters' followers this part scores; None: all."""
        (self.h, self.logs), (self.ctx, self.lefts) = (tuple(x[np.argsort(t[0])] for x in t) for t in (grams, contexts))
        self.unseen, self.classes = unseen, classes

    @staticmethod
    def _find(where: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(where, h), len(where) - 1)
        return at, where[at] == h

    def log_probs(self, hashes: list[np.ndarray], before: list[np.ndarray], longest: np.ndarray) -> np.ndarray:
        """hashes, before: by n - 1, of the n characters that end at, and just before, each place; longest: the n that are there."""
        p = np.full(len(longest), self.unseen, np.float32)
        for n in range(1, ORDER + 1):
            own = np.flatnonzero(longest >= n)
            if not len(own):
                break
            if n > 1 and len(self.ctx):
                ctx, known = self._find(self.ctx, before[n - 2][own])
                p[own] += np.where(known, self.lefts[ctx], 0)
            at, there = self._find(self.h, hashes[n - 1][own])
            p[own[there]] = self.logs[at[there]]
        return p


class Models:
    """All languages' models, or parts of them, and the cross-entropy up to which each language accepts a text."""

    def __init__(self, langs: list[str], models: dict[str, KneserNey]):
        """models: of those languages that this part scores."""
        self.langs, self.models = langs, [models.get(x) for x in langs]
        self.limits = {x: float("inf") for x in langs}
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)), np.float32)
        self.chars = np.zeros(0, np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": self.table[:0], "chars": self.chars[:0]}

    def _learn(self, runs: list[str]) -> None:
        points = np.frombuffer("".join(f"{START}{r}{END}" for r in runs).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(r) + 2 for r in runs])
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        hashes, longest = _hashes(points), np.minimum(place + 1, ORDER)
        at = np.flatnonzero(place > 0)
        key = np.choose(longest[at] - 1, [h[at] for h in hashes])
        _, one, back = np.unique(key, return_index=True, return_inverse=True)
        pick = at[one]
        own, before = [h[pick] for h in hashes], [h[pick - 1] for h in hashes]
        kinds = _class_of(points[pick - 1])
        each = np.zeros((len(pick), len(self.langs)), np.float32)
        for k, m in enumerate(self.models):
            if m is not None:
                each[:, k] = m.log_probs(own, before, longest[pick])
                if m.classes is not None:
                    each[~m.classes[kinds], k] = 0
        each = each[back]
        first = np.cumsum(sizes - 1) - (sizes - 1)
        self.table = np.concatenate([self.table, np.add.reduceat(each, first, axis=0)])
        self.chars = np.concatenate([self.chars, sizes - 1])
        self.known |= {r: i for i, r in enumerate(runs, len(self.known))}

    def nats(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats under each language's model, or what this part has of them, and characters (0: no letter), of each text."""
        h, chars = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        flat: list[str] = []
        parts: list[tuple[int, int]] = []

        def settle() -> None:
            if not flat:
                return
            if new := list(dict.fromkeys(r for r in flat if r not in self.known)):
                if len(self.known) + len(new) > CACHE:
                    self.reset()
                    new = list(dict.fromkeys(flat))
                self._learn(new)
            at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            starts = np.cumsum([0, *(n for _, n in parts)])[:-1]
            own = np.array([i for i, _ in parts])
            np.add.at(h, own, -np.add.reduceat(self.table[at], starts, axis=0, dtype=np.float64))
            np.add.at(chars, own, np.add.reduceat(self.chars[at], starts))
            flat.clear()
            parts.clear()

        for i, t in enumerate(texts):
            runs = letter_runs(t)
            for k in range(0, len(runs), CHUNK):
                part = runs[k : k + CHUNK]
                flat += part
                parts.append((i, len(part)))
                if len(flat) >= CHUNK:
                    settle()
        settle()
        return h, chars

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character under each language's model, and characters, of each text."""
        h, chars = self.nats(texts)
        return h / np.maximum(chars, 1)[:, None], chars

    def decide(self, nats: np.ndarray, chars: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether its model rejects the text, from each text's nats and characters."""
        if not self.langs:
            return [UNKNOWN] * len(chars), np.zeros(len(chars)), np.ones(len(chars), bool)
        h = nats / np.maximum(chars, 1)[:, None]
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp((low[:, None] - h) * np.minimum(chars, EVIDENCE)[:, None]).sum(axis=1)
        names = [self.langs[b] if n else UNKNOWN for b, n in zip(best, chars, strict=True)]
        rejected = np.array([n == 0 or x > self.limits[self.langs[b]] for x, b, n in zip(low, best, chars, strict=True)], bool)
        return names, np.where(chars > 0, score, 0.0), rejected


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        lang, gram, n = [], [], []
        for x, own in runs.items():
            counts: dict[str, int] = defaultdict(int)
            for r, k in own.items():
                for g in grams(r):
                    counts[g] += k
            lang += [x] * len(counts)
            gram += counts
            n += counts.values()
        runs.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    for b in it:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            runs[lang].update(letter_runs(text.as_py()))
            if sum(map(len, runs.values())) >= FLUSH:
                yield flush()
    yield flush()


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, kind, gram, value) of every language's model, from counts (lang, gram, n) of the longest n-grams, all in Spark.

    kind 0: an n-gram and its log-probability; 1: a context and the log of what it leaves to shorter ones; 2: no gram, the
    log-probability of a character never seen. Shorter n-grams count the distinct characters before them, if there can be one.
    """
    spark, tail = counts.sparkSession, lambda g: F.substring(g, 2, ORDER)
    size = F.char_length("gram")
    by: list[DataFrame] = [counts.where(size == ORDER)]
    for n in range(ORDER - 1, 0, -1):
        longer = by[0].select("lang", tail(F.col("gram")).alias("gram"), F.lit(1).cast("long").alias("n"))
        by.insert(0, written(counts.where(size == n).unionByName(longer).groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"grams{n}"))
    alphabet = by[0].select("gram").distinct().count() + 1  # every character ends some n-gram but the start mark
    discounts = {}
    for n, t in enumerate(by, 1):
        for r in t.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect():
            discounts[r["lang"], n] = min(max(r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] else 0.5, 0.1), 0.9)
    uniform, out, lower = 1.0 / (alphabet + 1), None, None
    for n, t in enumerate(by, 1):
        d = spark.createDataFrame([(x, d) for (x, k), d in discounts.items() if k == n], "lang string, d double")
        own = t.withColumn("ctx", F.expr("substring(gram, 1, char_length(gram) - 1)"))
        contexts = own.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).join(F.broadcast(d), "lang")
        contexts = written(contexts.select("lang", "ctx", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("left")), f"contexts{n}")
        both = own.join(contexts, ["lang", "ctx"])
        less = F.lit(uniform)
        if n > 1:
            both, less = both.withColumn("tail", tail(F.col("gram"))).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("less")), ["lang", "tail"]), F.col("less")
        lower = written(both.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * less).alias("p")), f"probabilities{n}")
        left = F.log("left").alias("value")
        more = contexts.select("lang", F.lit(1).alias("kind"), F.col("ctx").alias("gram"), left) if n > 1 else contexts.select("lang", F.lit(2).alias("kind"), F.col("ctx").alias("gram"), (F.log("left") + float(np.log(uniform))).alias("value"))
        more = more.unionByName(lower.select("lang", F.lit(0).alias("kind"), "gram", F.log("p").alias("value")))
        out = more if out is None else out.unionByName(more)
    return out


class Trained:
    """Models in their table, and the plan of their parts: sent() makes one part at a time ready for the workers."""

    def __init__(self, langs: list[str], table: DataFrame | None, parts: list[list[tuple[str, int]]], unseen: dict[str, float]):
        self.langs, self.table, self.parts, self.unseen = langs, table, parts, unseen
        self.limits = {x: float("inf") for x in langs}

    def part(self, k: int) -> Models:
        """The k-th part's models, read from the table: PART_ENTRIES entries at most, or those of one class of one language."""
        own: dict[str, np.ndarray] = {}
        for lang, kind in self.parts[k]:
            own.setdefault(lang, np.zeros(CLASSES, bool))[kind] = True
        asked = F.lit(False)
        for lang, kinds in own.items():
            asked = asked | ((F.col("lang") == lang) & (F.col("class").isin(np.flatnonzero(kinds).tolist()) | (F.col("class") < 0)))
        models = {}
        rows = self.table.where(asked).select("lang", "kind", "h", "value").toArrow()
        for lang, kinds in own.items():
            mine = rows.filter(pc.equal(rows["lang"], lang))
            tables = []
            for kind in (0, 1):
                t = mine.filter(pc.equal(mine["kind"], kind))
                tables.append((t["h"].to_numpy().view(np.uint64), t["value"].to_numpy()))
            models[lang] = KneserNey(*tables, self.unseen[lang], None if kinds.all() else kinds)
        out = Models(self.langs, models)
        out.limits = self.limits
        return out


def _nats(texts: DataFrame, models: Trained, keep: str) -> DataFrame:
    """Of each row of texts (keep, text): keep, nats by language, chars. One pass over texts for each part of the models."""
    spark, schema = texts.sparkSession, StructType([texts.schema[keep], StructField("nats", ArrayType(DoubleType())), StructField("chars", LongType())])

    def passed(k: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(models.part(k))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                h, chars = sent.value.nats([t or "" for t in b.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * h.shape[1]), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(chars)], schema.names)

        return map_batches(texts.select(keep, "text"), run, schema)

    if len(models.parts) == 1:
        return passed(0)
    out = None
    for k in range(len(models.parts)):
        own = written(passed(k), "nats")
        out = own if out is None else out.unionByName(own)
    sums = [F.sum(F.get("nats", F.lit(i))).alias(f"n{i}") for i in range(len(models.langs))]
    return out.groupBy(keep).agg(*sums, F.max("chars").alias("chars")).select(keep, F.array(*[f"n{i}" for i in range(len(sums))]).alias("nats"), "chars")


def _nats_beside(docs: DataFrame, models: Trained) -> DataFrame:
    """Of each row of docs: row (a struct of its columns but text, and a number), nats by language, chars; written. Models of more than one part: docs are written first."""
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*others, F.monotonically_increasing_id().alias(fresh(docs, "k"))).alias("row"), "text")
    return written(_nats(written(own, "texts") if len(models.parts) > 1 else own, models, "row"), "nats")


def quantiles(values: DataFrame, share: float) -> dict[str, float]:
    """By lang, the quantile of x over all rows of values (lang, x), interpolated as numpy's: each turn keeps the bin that holds the rank."""
    spark, found, schema = values.sparkSession, {}, "lang string, side int, rank long, lo double, hi double"
    now, between = [], {}
    for r in values.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():
        at = (r["n"] - 1) * share
        between[r["lang"]] = at - int(at)
        now += [(r["lang"], side, min(int(at) + side, r["n"] - 1), r["lo"], r["hi"]) for side in (0, 1)]
    while now:
        found |= {(lang, side): lo for lang, side, _, lo, hi in now if lo == hi}
        if not (now := [t for t in now if t[3] < t[4]]):
            break
        kept = values.join(F.broadcast(spark.createDataFrame(now, schema)), "lang").where("x between lo and hi")
        spot = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = kept.groupBy("lang", "side", "rank", spot).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("lang", "side").orderBy("bin")))
        left = upto.where("rank < upto and rank >= upto - n").select("lang", "side", F.expr("rank - upto + n"), "lo", "hi")
        now = [tuple(r) for r in left.collect()]
    return {lang: found[lang, 0] + (found[lang, 1] - found[lang, 0]) * t for lang, t in between.items()}


def calibrate(models: Trained, nats: DataFrame) -> None:
    """Set the models' limits from nats (row with lang, nats, chars) of all training texts."""
    x = F.get("nats", F.array_position(F.array(*map(F.lit, models.langs)), F.col("row.lang").cast("string")).cast("int") - 1) / F.col("chars")
    values = nats.where("chars > 0").select(F.col("row.lang").cast("string").alias("lang"), x.alias("x")).where("x is not null")
    models.limits |= {k: v * 1.05 for k, v in quantiles(values, PASS_SHARE).items()}


def train(docs: DataFrame, where: Column | None = None, calibrated: bool = True) -> Trained:
    """Models of the languages (column lang, null: no label) of the texts that `where` keeps.

    n-gram counts and limits are of all these texts, and the models hold every n-gram. They stay in a table; the driver reads
    one part of PART_ENTRIES at a time, to send it. calibrated: score these texts for the limits; if not, none is rejected
    until calibrate() is called.
    """
    own = (docs if where is None else docs.where(where)).where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = map_batches(own, _count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = kneser_ney(written(counts, "grams"))

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            grams, kinds = b.column(2).to_pylist(), b.column(1).to_numpy()
            # the character before the n-gram's last one, or a context's last one; n-grams of one character go with every class
            before = [g[-2:-1] if k == 0 else g[-1:] for g, k in zip(grams, kinds.tolist(), strict=True)]
            points = np.array([ord(x) if x else 0 for x in before], np.uint32)
            classes = np.where([bool(x) for x in before], _class_of(points), -1).astype(np.int32)
            h = np.zeros(len(grams), np.uint64)
            some = np.flatnonzero([bool(g) for g in grams])
            h[some] = last_hashes([grams[i] for i in some.tolist()])
            cols = [b.column(0), b.column(1), pa.array(classes), pa.array(h.view(np.int64)), pa.array(b.column(3).to_numpy().astype(np.float32))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "kind", "class", "h", "value"])

    table = written(map_batches(model, hashed, "lang string, kind int, class int, h long, value float"), "models")
    sizes = sorted((r["lang"], r["class"], r["count"]) for r in table.groupBy("lang", "class").count().collect())
    langs = sorted({x for x, _, _ in sizes})
    unseen = {r["lang"]: float(r["value"]) for r in table.where("kind = 2").collect()}
    entries, parts, room = {(x, k): n for x, k, n in sizes}, [], 0
    for lang in langs:
        for k in range(CLASSES):
            n = entries.get((lang, k), 0)
            if not parts or room < n:
                parts.append([])
                room = PART_ENTRIES
            parts[-1].append((lang, k))
            room -= n
    out = Trained(langs, table, parts, unseen)
    if langs and calibrated:
        calibrate(out, _nats_beside(own, out))
    return out


def _decided(rows: DataFrame, models: Trained, schema: StructType) -> DataFrame:
    """rows, whose last columns are nats and chars, with lang_pred, score and rejected in their place."""
    decider = Models(models.langs, {})
    decider.limits = models.limits

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h = np.array(b.column(b.num_columns - 2).to_pylist(), float).reshape(b.num_rows, len(decider.langs))
            found = decider.decide(h, b.column(b.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *map(pa.array, found)], schema.names)

    return map_batches(rows, decide, schema)


def with_language(docs: DataFrame, models: Trained, text: str = "text") -> DataFrame:
    """docs with lang_pred (the language of the least cross-entropy), score (0 to 1) and rejected.

    Null texts and texts without a letter get `und`, score 0, and are rejected, as is all where no language was learnt.
    rejected: the cross-entropy is above what the language's model calibrated. Columns of docs with these names go.
    Models of more than one part: docs are written first, then read once a part.
    """
    own = docs.drop("lang_pred", "score", "rejected")
    schema = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    decider = Models(models.langs, {})
    decider.limits = models.limits
    names = [*own.schema.names, "lang_pred", "score", "rejected"]
    if len(models.parts) > 1:
        k = fresh(own, "__row")
        rows = written(own.withColumn(k, F.monotonically_increasing_id()), "texts")
        nats = _nats(rows.select(k, F.col(text).alias("text")), models, k).withColumnsRenamed({"nats": fresh(rows, "__nats"), "chars": fresh(rows, "__chars")})
        return _decided(rows.join(nats, k).drop(k), models, schema)
    sent = docs.sparkSession.sparkContext.broadcast(models.part(0) if models.parts else decider)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            found = sent.value.decide(*sent.value.nats(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found[0], pa.string()), *map(pa.array, found[1:])], names)

    return map_batches(own, run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, lang_pred, score, rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models, held_out = train(docs, crc_mod(4) != 2, calibrated=False), (crc_mod(4) == 2).alias("held_out")
    if not models.langs:
        return with_language(docs.select("doc_id", "text"), models).select("doc_id", held_out, "lang_pred", "score", "rejected")
    # the training texts are scored anyhow, so one pass over all gives the limits and the results
    nats = _nats_beside(docs.select("doc_id", "lang", held_out, "text"), models)
    calibrate(models, nats.where("not row.held_out"))
    schema = StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return _decided(nats.select("row.doc_id", "row.held_out", "nats", "chars"), models, schema)
