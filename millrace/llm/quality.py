"""Quality classifier: support vectors over naive Bayes features.

Features are hashed 1- and 2-grams of tokens, each present or not. Each is scaled by its class log-count ratio; a linear
hinge-loss model is fitted to the scaled, length-normalised features by dual coordinate descent, and its margin becomes a
probability by a logistic curve fitted to margins of folds that the model had not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import as_bytes, crc_mod, map_batches, written

#: log2 of the number of hashed features.
BITS = 18
#: The bounded sample of labelled rows that the model is fitted to: documents, and features of them in all.
SAMPLE_DOCS, SAMPLE_FEATURES = 6000, 6_000_000
#: Tokens whose features are sorted at a time.
CHUNK_TOKENS = 1 << 19
#: Distinct tokens that a worker remembers.
CACHE = 1 << 18

#: Runs of ASCII punctuation, or of other bytes that aren't blank.
_token = re.compile(rb"[!-/:-@\[-`{-~]+|[^\x00-\x20!-/:-@\[-`{-~]+")
_codes: dict[bytes, int] = {}


def _code(token: bytes) -> int:
    if len(_codes) >= CACHE:
        _codes.clear()
    return _codes.setdefault(token, xxhash.xxh3_64_intdigest(token))


def _token_codes(text: bytes) -> np.ndarray:
    """A text's tokens as hashes. Case counts; a token is hashed as it is."""
    get = _codes.get
    return np.array([get(t) or _code(t) for t in _token.findall(text)], np.uint64)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a run of tokens: of each token, and of each pair."""
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    one = (codes * mix) >> shift
    two = ((codes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (codes[1:] ^ (codes[1:] >> np.uint64(31)))) * mix) >> shift
    return one.astype(np.int64), two.astype(np.int64)


def document_features(text: bytes) -> np.ndarray:
    """The distinct hashed features of a text, sorted; none for a text without tokens."""
    codes, found = _token_codes(text), []
    for i in range(0, len(codes), CHUNK_TOKENS):
        found.append(np.unique(np.concatenate(_features(codes[max(0, i - 1) : i + CHUNK_TOKENS]))))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of each feature's share of the positive class's counts over its share of the negative's."""
    counts = [smooth + np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS) for c in (1, -1)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i * max(0, 1 - y_i (w x_i + b)), the bias as a weight of its own."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    norm = np.array([1 + (v * v).sum() for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            slope = y[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of P(1) = 1 / (1 + exp(-(a m + b))), by Newton's method on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margins * margins).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-7:
            break
    return max(float(a), 1e-6), float(b)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, texts: Iterable[bytes], n: int | None = None) -> np.ndarray:
        """Of n texts; n may be left out for a list."""
        out = np.empty(len(texts) if n is None else n)  # type: ignore[arg-type]
        for i, t in enumerate(texts):
            f = document_features(t)
            r = self.ratios[f]
            out[i] = (self.weights[f] * r).sum() / np.sqrt((r * r).sum() + 1e-12) + self.bias
        return out

    def scores(self, texts: Iterable[bytes], n: int | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margins(texts, n) + self.b, -30, 30)))


def _fit_margin(rows: list[np.ndarray], y: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray, float]:
    ratios = log_count_ratios(rows, y)
    values = [ratios[f] / np.sqrt((ratios[f] ** 2).sum() + 1e-12) for f in rows]
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    w, bias = dual_coordinate_descent(rows, values, y, c * share)
    return ratios.astype(np.float32), w.astype(np.float32), bias


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, folds: int = 3) -> Model:
    """The model of documents' features and 0/1 labels. With fewer than two of a class it answers the share of ones."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if min((y > 0).sum(), (y < 0).sum()) < 2:
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    fold, margins = np.zeros(len(y), int), np.zeros(len(y))
    for k in (1, -1):
        at = np.flatnonzero(y == k)
        fold[at] = np.arange(len(at)) % folds
    for k in range(folds):
        own = np.flatnonzero(fold != k)
        ratios, w, bias = _fit_margin([rows[i] for i in own], y[own], c)
        for i in np.flatnonzero(fold == k):
            r = ratios[rows[i]]
            margins[i] = (w[rows[i]] * r).sum() / np.sqrt((r * r).sum() + 1e-12) + bias
    return Model(*_fit_margin(rows, y, c), *logistic(margins, y))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", where=None) -> Model:
    """Fit to a sample of the labelled documents that `where`, a condition on doc_id, keeps; by text and label alone.

    The sample is the first SAMPLE_DOCS labelled ids in the order of a hash of the id, less what goes beyond SAMPLE_FEATURES features. It is
    chosen by ids alone; then its texts are found in one pass, beside which nothing is shuffled, and only their
    features come to the driver. Null labels and ids are no labels; of an id's labels the largest counts. Rows of an id with
    the same features count once.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = [document_features(t.as_py()).astype(np.int32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), *b.columns[1:]], ["f", "y", "h"])

    own = docs if where is None else docs.where(where)
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = own.select("doc_id").distinct().join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    sample = own.select("doc_id", as_bytes("text").alias("t")).join(F.broadcast(ids), "doc_id").select("t", "y", "h")
    found = written(map_batches(sample, run, "f array<int>, y int, h long").dropDuplicates(["h", "f"]), "sample")
    sizes = sorted((r[0], r[1]) for r in found.groupBy("h").agg(F.sum(F.size("f") + 1)).collect())
    total = np.cumsum([n for _, n in sizes])
    last = sizes[min(int(np.searchsorted(total, SAMPLE_FEATURES)), len(sizes) - 1)][0] if sizes else 0
    kept = found.where(F.col("h") <= last).toArrow()
    rows = [x.values.to_numpy().astype(np.int64) for x in kept.column("f")]
    h, y = kept.column("h").to_pylist(), np.array(kept.column("y").to_pylist(), int)
    order = sorted(range(len(rows)), key=lambda i: (h[i], y[i], rows[i].tobytes()))
    return fit([rows[i] for i in order], y[order])


def with_scores(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0), under these names.

    Null and empty texts have no features; they get the score of the bias. Columns of docs with these names go.
    """
    spark = docs.sparkSession
    own = docs.drop(*names)
    sent = spark.sparkContext.broadcast(model)
    schema = StructType([*own.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at = b.schema.get_field_index(text)
            s = sent.value.scores(((t.as_py() or "").encode("utf-8", "replace") for t in b.column(at)), b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, *names])
        _codes.clear()  # the worker goes on to other stages

    return map_batches(own, run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=crc_mod(4) != 2)
    return with_scores(docs, model).select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", "predicted")
