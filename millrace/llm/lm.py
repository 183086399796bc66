"""LM scoring: a causal self-attention model over subword ids, trained here in numpy.

A text begins a new block of BLOCK ids, and its blocks follow one another. A block is scored against its own causal part
and the CONTEXT ids before it, so windows overlap in their context and each id is scored once; a mask keeps texts apart and
an id's score doesn't depend on what else is scored. The next id is predicted in two steps, its class and then the id
within the class, so a step costs two short softmaxes.

Words go to public subword ids; ids outside the model's vocabulary are spelt in bytes, so every text has a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, as_bytes, crc_mod, map_batches, written

#: One of the public vocabularies; a parameter of all that reads it.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK, CONTEXT, WIDTH, HEAD = 16, 8, 16, 8
CLASSES = PER_CLASS = 32
#: PER_CLASS as a shift and a mask.
_SHIFT, _LOW = 5, PER_CLASS - 1
VOCABULARY = CLASSES * PER_CLASS
#: Id of the end of a text, which also begins it; ids of bytes follow it, then subwords.
END, BYTES = 0, 1
#: Blocks that are scored, and trained on, at a time.
SCORE_BLOCKS = TRAIN_BLOCKS = 512
#: The first weights come from about START_IDS ids, of training texts drawn by a hash. Then all training texts train the model: in
#: ROUNDS rounds, each at its rate, in parts of about PART_IDS ids (of more where there would be over PARTS of them).
START_IDS, START_RATE, RATES = 4_000_000, 2e-2, (1e-2, 5e-3)
PART_IDS, PARTS = 8_000_000, 20_000
#: Words whose counts are looked up in memory; counts of the others are joined. Distinct words whose ids a worker remembers.
KNOWN_WORDS, CACHE = 1 << 20, 1 << 20
#: Bytes that are split into words at a time, and of texts whose words are looked up at a time; ids that are scored or trained on at a time.
SPLIT_BYTES, CHUNK_BYTES, CHUNK_IDS = 1 << 16, 1 << 21, 1 << 18
#: Groups that trained weights are averaged in, first and then.
SUM_GROUPS = (1024, 8)


# Words -------------------------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(23)
#: A number for each byte, the same for A-Z and a-z; blanks have none. A word's hash is the sum of its bytes' numbers, each times a power by its place.
_numbers = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_numbers[65:91] = _numbers[97:123]
_factor = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(_factor), -1, 2**64))
_is_blank = np.zeros(256, bool)
_is_blank[list(BLANK)] = True
_is_letter = ~_is_blank
_powers: dict[np.uint64, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        own = np.full(n, base, np.uint64)
        own[0] = 1
        _powers[base] = np.multiply.accumulate(own)
    return _powers[base][:n]


def _split(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of bytes begin and end, and their hashes. cuts: places where a word ends whatever is there."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    _is_letter.take(data, out=word[1:-1], mode="clip")
    apart = np.zeros(n + 1, bool)
    apart[cuts] = True
    begin = np.flatnonzero(word[1:] & (~word[:-1] | apart))
    end = np.flatnonzero(word[:-1] & (~word[1:] | apart))
    sums = np.zeros(n + 1, np.uint64)
    own = _numbers.take(data, mode="clip")
    own *= _powers_of(_factor, n)
    np.cumsum(own, out=sums[1:])
    h = (sums[end] - sums[begin]) * _powers_of(_inverse, n)[begin]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return begin, end, h ^ (h >> np.uint64(32))


def word_groups(texts: pa.BinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, words' hashes, begins, ends, the texts' bytes, the texts' lengths in words) of about CHUNK_BYTES of texts at a time."""
    if not len(texts):
        return
    where = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(where, where[first] + CHUNK_BYTES, "right")) - 1)
        data, bounds = every[where[first] : where[last]], where[first : last + 1] - where[first]
        parts, at = [], 0
        while at < len(data):
            to = min(len(data), at + SPLIT_BYTES)
            if to < len(data):  # back to a blank or the end of a text, or on to one
                blanks = np.flatnonzero(_is_blank[data[at:to]])
                text = int(bounds[np.searchsorted(bounds, to, "right") - 1])
                if len(blanks) or text > at:
                    to = max(at + int(blanks[-1]) + 1 if len(blanks) else 0, text)
                else:
                    text = int(bounds[np.searchsorted(bounds, to, "left")])
                    more = _is_blank[data[to:text]]
                    to = to + int(more.argmax()) if more.any() else text
            cuts = bounds[np.searchsorted(bounds, at, "left") : np.searchsorted(bounds, to, "right")] - at
            begin, end, h = _split(data[at:to], cuts)
            parts.append((begin + at, end + at, h))
            at = to
        begin, end, h = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        yield first, last, h, begin, end, data, np.diff(np.searchsorted(begin, bounds))
        first = last


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, where one of each is, and the number of each in the distinct ones."""
    order = np.argsort(h)
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    back = np.empty(len(s), np.int64)
    back[order] = np.cumsum(new) - 1
    return s[new], order[new], back


# The model ---------------------------------------------------------------------------------------------------------------

SHAPES = {
    "embed": (VOCABULARY, WIDTH), "query": (VOCABULARY, HEAD), "key": (VOCABULARY, HEAD), "value": (VOCABULARY, WIDTH), "near": (BLOCK + CONTEXT,),
    "wc": (WIDTH, CLASSES), "bc": (CLASSES,), "wu": (CLASSES, WIDTH, PER_CLASS), "bu": (CLASSES, PER_CLASS),
}
_back = CONTEXT + np.arange(BLOCK)[:, None] - np.arange(BLOCK + CONTEXT)[None, :]
#: A query's distance to each key; what lies after it is masked.
_near, _after = np.clip(_back, 0, None), _back < 0
#: Bounds that keep exp() of attention finite without a search for the largest logit.
_NORM, _BIAS, _MASKED = 6.0, 20.0, np.float32(-1e9)
Weights = dict[str, np.ndarray]


def new_weights(counts: np.ndarray, seed: int = 11) -> Weights:
    """Small random weights, and biases that answer the shares of the ids' counts."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * (0.1 if s[0] == VOCABULARY else s[-2] ** -0.5 * 0.5)).astype(np.float32) for k, s in SHAPES.items() if k not in ("near", "bc", "bu")}
    p = (counts + 0.5).reshape(CLASSES, PER_CLASS)
    w["near"] = np.zeros(SHAPES["near"], np.float32)
    w["bc"] = np.log(p.sum(axis=1) / p.sum()).astype(np.float32)
    w["bu"] = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
    return bounded(w)


def bounded(w: Weights) -> Weights:
    for k in ("query", "key"):
        w[k] *= np.minimum(1, _NORM / (np.sqrt(np.einsum("ij,ij->i", w[k], w[k])) + 1e-9))[:, None].astype(w[k].dtype)
    np.clip(w["near"], -_BIAS, _BIAS, out=w["near"])
    return w


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> Weights:
    """Views of a flat array of all weights."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


def _windows(x: np.ndarray) -> np.ndarray:
    """(blocks, columns, CONTEXT + BLOCK): of each block the rows of its context and its own."""
    return np.lib.stride_tricks.sliding_window_view(x, CONTEXT + BLOCK, axis=0)[::BLOCK]


def _exp(z: np.ndarray) -> np.ndarray:
    """exp() in place, of logits less their largest where one is large: a softmax's numerators."""
    if z.size and z.max() > 60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = (targets >> _SHIFT).astype(np.int8)
    return np.argsort(c, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(c, minlength=CLASSES))])


def _prepared(w: Weights) -> Weights:
    """With a column of ones beside the values, which sums the attention, and the logits of distance and mask."""
    ones = np.ones((VOCABULARY, 1), w["value"].dtype)
    return w | {"values": np.concatenate([w["value"], ones], axis=1), "bias": np.where(_after, _MASKED, w["near"][_near])}


def _attend(w: Weights, inputs: np.ndarray, begins: np.ndarray, first: int, n: int) -> tuple[np.ndarray, ...]:
    """Of n blocks from block `first`: attention before it is divided, its sums of values, queries, keys, values, ids of windows and blocks."""
    lo = first * BLOCK - CONTEXT
    ids = inputs[first * BLOCK : (first + n) * BLOCK]
    ext = np.concatenate([np.zeros(max(0, -lo), inputs.dtype), inputs[max(0, lo) : (first + n) * BLOCK]])
    q, k, v = w["query"].take(ids, axis=0).reshape(n, BLOCK, HEAD), w["key"].take(ext, axis=0), w["values"].take(ext, axis=0)
    a = q @ _windows(k)
    a += w["bias"]
    np.exp(a, out=a)
    a[np.flatnonzero(begins[first : first + n]), :, :CONTEXT] = 0
    return a, (a @ _windows(v).transpose(0, 2, 1)).reshape(-1, WIDTH + 1), q, k, v, ext, ids


def _within(w: Weights, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logits within the class of rows in the order of their classes."""
    z = np.empty((len(h), PER_CLASS), h.dtype)
    for i in np.flatnonzero(np.diff(at)):
        np.matmul(h[at[i] : at[i + 1]], w["wu"][i], out=z[at[i] : at[i + 1]])
        z[at[i] : at[i + 1]] += w["bu"][i]
    return z


def log_probs(w: Weights, inputs: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Natural log-probability of each target, given its input and what is before it in its text. begins: of each block, whether it begins a text."""
    w, out = _prepared(w), np.empty(len(inputs), np.float32)
    ones = np.ones(PER_CLASS, np.float32)
    for first in range(0, len(begins), SCORE_BLOCKS):
        n = min(SCORE_BLOCKS, len(begins) - first)
        _, o, _, _, _, _, ids = _attend(w, inputs, begins, first, n)
        h = o[:, :WIDTH] / o[:, WIDTH:]
        h += w["embed"].take(ids, axis=0)
        here = slice(first * BLOCK, (first + n) * BLOCK)
        own, rows = targets[here], np.arange(n * BLOCK)
        order, at = _by_class(own)
        c = h @ w["wc"]
        c += w["bc"]
        z = _within(w, h.take(order, axis=0), at)
        for logits in (c, z):
            if logits.max() > 60:
                logits -= logits.max(axis=1, keepdims=True)
        p = c.ravel().take(rows * CLASSES + (own >> _SHIFT))
        p -= np.log(np.exp(c, out=c) @ ones)
        of_class = z.ravel().take(rows * PER_CLASS + (own & _LOW).take(order))
        of_class -= np.log(np.exp(z, out=z) @ ones)
        p[order] += of_class
        out[here] = p
    return out


def gradients(w: Weights, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, begins: np.ndarray, first: int, n: int) -> tuple[Weights, float]:
    """Gradients of the mean negative log-probability of the real targets (1; padding: 0) of n blocks, and that mean."""
    w = _prepared(w)
    kind = w["value"].dtype
    a, o, q, k, v, ext, ids = _attend(w, inputs, begins, first, n)
    here = slice(first * BLOCK, (first + n) * BLOCK)
    own, weight, size = targets[here], real[here].astype(kind), n * BLOCK
    weight /= weight.sum()
    rows, ones, every = np.arange(size), np.ones(PER_CLASS, kind), np.ones(size, kind)
    inverse = 1 / o[:, WIDTH:]
    seen = o[:, :WIDTH] * inverse
    h = seen + w["embed"].take(ids, axis=0)
    g = {}

    c = h @ w["wc"]
    c += w["bc"]
    total, pick = _exp(c) @ ones, rows * CLASSES + (own >> _SHIFT)
    loss = np.log(c.ravel().take(pick) / total + 1e-30) @ weight
    c *= (weight / total)[:, None]
    c.ravel()[pick] -= weight
    g["wc"], g["bc"], dh = h.T @ c, every @ c, c @ w["wc"].T

    order, at = _by_class(own)
    hs = h.take(order, axis=0)
    z, weight = _within(w, hs, at), weight.take(order)
    total, pick = _exp(z) @ ones, rows * PER_CLASS + (own & _LOW).take(order)
    loss += np.log(z.ravel().take(pick) / total + 1e-30) @ weight
    z *= (weight / total)[:, None]
    z.ravel()[pick] -= weight
    g["wu"], g["bu"], ds = np.zeros_like(w["wu"]), np.zeros_like(w["bu"]), np.empty_like(hs)
    for i in np.flatnonzero(np.diff(at)):
        b, e = at[i], at[i + 1]
        np.matmul(hs[b:e].T, z[b:e], out=g["wu"][i])
        np.matmul(every[b:e], z[b:e], out=g["bu"][i])
        np.matmul(z[b:e], w["wu"][i].T, out=ds[b:e])
    back = np.empty_like(order)
    back[order] = rows
    dh += ds.take(back, axis=0)

    do = np.empty((size, WIDTH + 1), kind)
    np.multiply(dh, inverse, out=do[:, :WIDTH])
    do[:, WIDTH] = -np.einsum("ij,ij->i", do[:, :WIDTH], seen)
    do = do.reshape(n, BLOCK, WIDTH + 1)
    da = do @ _windows(v)
    da *= a
    g["near"] = np.bincount(_near.ravel(), np.where(_after, 0, (np.ones(n, kind) @ da.reshape(n, -1)).reshape(_near.shape)).ravel(), minlength=BLOCK + CONTEXT).astype(kind)
    dk, dv = da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do[:, :, :WIDTH]
    # a row for each id of ext: what its embed, query, key and value get; as a key and value it is in its own block and the next
    rows_of = np.empty((len(ext), 2 * WIDTH + 2 * HEAD), kind)
    rows_of[:CONTEXT] = 0
    rows_of[CONTEXT:, :WIDTH] = dh
    rows_of[CONTEXT:, WIDTH : WIDTH + HEAD] = (da @ _windows(k).transpose(0, 2, 1)).reshape(-1, HEAD)
    for d, to in ((dk, rows_of[:, WIDTH + HEAD : WIDTH + 2 * HEAD]), (dv, rows_of[:, WIDTH + 2 * HEAD :])):
        to[CONTEXT:] = d[:, CONTEXT:].reshape(size, -1)
        to[:size].reshape(n, BLOCK, -1)[:, :CONTEXT] += d[:, :CONTEXT]
    by = np.argsort(ext.astype(np.int16), kind="stable")
    s = ext[by]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    tables = np.zeros((VOCABULARY, rows_of.shape[1]), kind)
    tables[s[start]] = np.add.reduceat(rows_of.take(by, axis=0), start, axis=0)
    g["embed"], g["query"], g["key"], g["value"] = np.split(tables, [WIDTH, WIDTH + HEAD, WIDTH + 2 * HEAD], axis=1)
    return g, -float(loss)


class Trainer:
    """Adam steps over texts laid out in blocks, TRAIN_BLOCKS blocks a step."""

    def __init__(self, w: Weights, rate: float, until: int = 0):
        """until: ids by which the rate has fallen to a tenth; 0: it stays."""
        self.flat, self.rate, self.until, self.steps, self.seen = flat(w), rate, until, 0, 0
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.w = shaped(self.flat)
        self.losses: list[float] = []

    def feed(self, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, begins: np.ndarray) -> None:
        for first in range(0, len(begins), TRAIN_BLOCKS):
            n = min(TRAIN_BLOCKS, len(begins) - first)
            g, loss = gradients(self.w, inputs, targets, real, begins, first, n)
            self.losses.append(loss)
            self.steps, self.seen = self.steps + 1, self.seen + n * BLOCK
            rate = self.rate * min(1, self.steps / 20) * (max(0.1, 1 - self.seen / self.until) if self.until else 1)
            rate *= (1 - 0.99**self.steps) ** 0.5 / (1 - 0.9**self.steps)
            d = flat(g)
            self.m += np.float32(0.1) * (d - self.m)
            d *= d
            d -= self.v
            d *= np.float32(0.01)
            self.v += d
            np.sqrt(self.v, out=d)
            d += np.float32(1e-8)
            np.divide(self.m, d, out=d)
            d *= np.float32(rate)
            self.flat -= d
            if self.steps % 8 == 0 or first + n == len(begins):
                bounded(self.w)


# Texts to ids ------------------------------------------------------------------------------------------------------------


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Pieces:
    """Distinct words, by hashes, as the tokenizer's ids, one after another; times: how often each word was counted."""

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.end = 0
        self.flat, self.size, self.start, self.times = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, h: np.ndarray, words: Callable[[int], bytes]) -> np.ndarray:
        """The rows of distinct hashes; those not met yet are read: words(i) is the i-th."""
        own, get = h.tolist(), self.rows.get
        rows = np.array([get(x, -1) for x in own], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            n = len(self.rows)
            ids = self.sp.encode([words(i).lower().decode("utf-8", "replace") for i in new.tolist()], num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            end = self.end + int(size.sum())
            self.flat, self.size, self.start, self.times = _grown(self.flat, end), _grown(self.size, n + len(new)), _grown(self.start, n + len(new)), _grown(self.times, n + len(new))
            self.flat[self.end : end] = np.fromiter(chain.from_iterable(ids), np.uint16, end - self.end)
            self.size[n : n + len(new)] = size
            self.start[n : n + len(new)] = self.end + np.cumsum(size) - size
            self.end, rows[new] = end, np.arange(n, n + len(new))
            self.rows.update(zip(h[new].tolist(), range(n, n + len(new)), strict=True))
        return rows

    def of(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        return self.flat[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def read_texts(t: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of three kinds from texts (doc_id, held_out, binary t). 0: a text with the tokenizer's ids (uint16) of its words.

    1: a word, by its 64-bit hash, and how often a worker counted it in texts not held out; 2: an id of the tokenizer, likewise.
    """
    with open(tokenizer, "rb") as f:
        proto = f.read()
    names = ["kind", "doc_id", "held_out", "t", "ids", "key", "n"]
    types = [pa.int8(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def batch(kind: int, rows: int, **own: pa.Array) -> pa.RecordBatch:
        cols = [pa.array(np.full(rows, kind, np.int8)) if k == "kind" else own.get(k, pa.nulls(rows, x)) for k, x in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total, out = Pieces(proto), np.zeros(0, np.int64), []

        def count() -> None:
            nonlocal total
            known = len(pieces.rows)
            n = pieces.times[:known]
            own = np.flatnonzero(n)
            keys = np.fromiter(pieces.rows, np.uint64, known)
            out.append(batch(1, len(own), key=pa.array(keys[own].view(np.int64)), n=pa.array(n[own])))
            seen = np.bincount(pieces.flat[: pieces.end], np.repeat(n, pieces.size[:known])).astype(np.int64)
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen

        for b in it:
            held = b.column(1).to_numpy(zero_copy_only=False)
            for a, e, h, begin, end, data, lengths in word_groups(b.column(2)):
                h, one, back = distinct(h)
                if pieces.rows and len(pieces.rows) + len(h) > CACHE:
                    count()
                    pieces.clear()
                raw, begin, end = data.tobytes(), begin[one], end[one]
                rows = pieces.learn(h, lambda i, raw=raw, begin=begin, end=end: raw[begin[i] : end[i]])
                pieces.times[rows] += np.bincount(back[np.repeat(~held[a:e], lengths)], minlength=len(rows))
                at = rows[back]
                ids = pieces.of(at)
                ends = np.concatenate([[0], np.cumsum(pieces.size[at])])[np.concatenate([[0], np.cumsum(lengths)])]
                binary = pa.Array.from_buffers(pa.binary(), e - a, [None, pa.py_buffer((2 * ends).astype(np.int32)), pa.py_buffer(ids)])
                yield batch(0, e - a, doc_id=b.column(0).slice(a, e - a), held_out=b.column(1).slice(a, e - a), t=b.column(2).slice(a, e - a), ids=binary)
                yield from out
                out.clear()
        count()
        own = np.flatnonzero(total)
        yield from [*out, batch(2, len(own), key=pa.array(own), n=pa.array(total[own]))]

    return map_batches(t, run, "kind byte, doc_id long, held_out boolean, t binary, ids binary, key long, n long")


class Subwords:
    """The tokenizer's ids as ids of the model: those of `pieces` have one, in order, and others are spelt in bytes."""

    def __init__(self, tokenizer: str, pieces: list[int]):
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        own = {p: BYTES + 256 + i for i, p in enumerate(pieces)}

        def ids(p: int) -> list[int]:
            if p in own:
                return [own[p]]
            raw = bytes([int(sp.id_to_piece(p)[1:-1], 16)]) if sp.is_byte(p) else sp.id_to_piece(p).replace("▁", " ").encode()
            return [BYTES + b for b in raw]

        every = [ids(p) for p in range(sp.get_piece_size())]
        self.flat, self.size = np.array([i for x in every for i in x], np.int32), np.array([len(x) for x in every], np.int32)
        self.start = np.cumsum(self.size) - self.size
        self.first, self.more = self.flat[self.start], (self.size - 1).astype(np.uint8)

    def laid_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and whether they are real of texts (tokenizer's ids), whether each block begins a text, and where each text begins."""
        p = np.frombuffer(b"".join(texts), np.uint16)
        more = self.more.take(p)
        many = np.flatnonzero(more)
        place = np.cumsum(more, dtype=np.int64)
        ends = np.cumsum([0, *(len(t) // 2 for t in texts)])
        n = np.diff(ends + np.concatenate([[0], place])[ends])
        room = (n + BLOCK) // BLOCK * BLOCK
        starts = np.cumsum(room) - room
        inputs, targets, real = np.zeros(room.sum(), np.int32), np.zeros(room.sum(), np.int32), np.ones(room.sum(), np.float32)
        # where an id's first (mostly only) id of the model goes: after the ids before it, in its text's room
        place += np.arange(len(p))
        place -= more
        place += np.repeat(starts - (np.cumsum(n) - n), np.diff(ends))
        targets[place] = self.first.take(p)
        if len(many):
            k = more[many].astype(np.int64)
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + 1
            targets[np.repeat(place[many], k) + step] = self.flat[np.repeat(self.start[p[many]], k) + step]
        inputs[1:] = targets[:-1]
        pad = room - n - 1
        real[np.repeat(starts + n + 1 - (np.cumsum(pad) - pad), pad) + np.arange(pad.sum())] = 0
        inputs[starts] = END
        begins = np.zeros(len(inputs) // BLOCK, bool)
        begins[starts // BLOCK] = True
        return inputs, targets, real, begins, starts

    def chunks(self, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """laid_out() of about CHUNK_IDS ids at a time."""
        own: list[bytes] = []
        n = 0
        for t in texts:
            own.append(t)
            n += len(t) // 2 + BLOCK
            if n >= CHUNK_IDS:
                yield self.laid_out(own)
                own, n = [], 0
        if own:
            yield self.laid_out(own)


# Training ----------------------------------------------------------------------------------------------------------------

_KIND = "part int, mean binary, seen long"


def _trained(texts: DataFrame, w: Weights, subwords: Subwords, rate: float, until: int) -> DataFrame:
    """(part, mean, seen): for each partition of texts (h, ids), in the order of h, the weights trained on it from w, and ids seen."""
    sent = texts.sparkSession.sparkContext.broadcast((flat(w), subwords))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own = sent.value
        trainer = Trainer(shaped(start.copy()), rate, until)
        for chunk in own.chunks(t.as_py() for b in it for t in b.column(0)):
            trainer.feed(*chunk[:4])
        if trainer.seen:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([trainer.flat.tobytes()], pa.binary()), pa.array([trainer.seen], pa.int64())], ["part", "mean", "seen"])

    return map_batches(texts.sortWithinPartitions("h", "ids").select("ids"), run, _KIND)


def _mean(rows: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, int]:
    total = sum(n for _, _, n in rows)
    return (sum(np.frombuffer(x, np.float32) * np.float64(n) for _, x, n in sorted(rows)) / total).astype(np.float32), total


def _averaged(means: DataFrame, w: Weights) -> Weights:
    """The mean of the parts' weights by ids seen, in two steps; w if there is none."""

    def merge(groups: int):
        def run(table: pa.Table) -> pa.Table:
            rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "mean", "seen")), strict=True))
            mean, seen = _mean(rows)
            return pa.table({"part": pa.array([rows[0][0] % groups], pa.int32()), "mean": [mean.tobytes()], "seen": [seen]})

        return run

    for groups in SUM_GROUPS:
        means = means.groupBy(F.pmod("part", F.lit(groups))).applyInArrow(merge(groups), _KIND)
    rows = [(r["part"], bytes(r["mean"]), r["seen"]) for r in means.collect()]
    return bounded(shaped(_mean(rows)[0])) if rows else w


def fit(texts: DataFrame, pieces: dict[int, int], tokenizer: str = TOKENIZER) -> tuple[Weights, Subwords]:
    """Weights and subwords of a model of texts (h, ids). pieces: how often each of the tokenizer's ids occurs in them.

    The vocabulary is of all texts' counts. The first weights come from about START_IDS ids, of the texts of the least h. Then every
    text trains the model once: each round deals its texts by h into parts, trains each part from the same weights
    and averages them by ids. h decides the parts and their order, so how the table is split doesn't matter. What
    is learnt from is all texts, in parts as many as the ids ask for, and the driver gets a few averages.
    """
    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    order = sorted((p for p in pieces if not own.is_byte(p)), key=lambda p: (-pieces[p], p))
    subwords, total = Subwords(tokenizer, order[: VOCABULARY - BYTES - 256]), sum(pieces.values())
    counts = np.zeros(VOCABULARY)
    for p, n in pieces.items():
        np.add.at(counts, subwords.flat[subwords.start[p] : subwords.start[p] + subwords.size[p]], n)
    w = new_weights(counts)
    share = 1.0 if total <= START_IDS else START_IDS / total
    first = texts.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).repartition(1)
    w = _averaged(_trained(first, w, subwords, START_RATE, START_IDS), w)
    parts = max(1, min(PARTS, -(-total // (PART_IDS * len(RATES)))))
    for k, rate in enumerate(RATES):
        dealt = texts.where(F.pmod(F.shiftright("h", 31), F.lit(len(RATES))) == k).repartition(parts, "h")
        w = _averaged(_trained(dealt, w, subwords, rate, 0), w)
    return w, subwords


# Scoring -----------------------------------------------------------------------------------------------------------------


def most_frequent(counts: DataFrame, most: int) -> int:
    """The least count, of steps of an eighth of a power of two, that at most `most` rows (n) reach."""
    least, total = 1, 0
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("last")).orderBy(F.desc("s"))
    for r in steps.collect():
        total += r["k"]
        if total > most:
            return r["last"] + 1
    return least


def with_lm_scores(docs: DataFrame, held_out=None, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z) and split at white space, and end with an end token; null and empty texts are that token. The
    model and the base learn from rows that held_out (a column) doesn't mark. base_score: sum of log10((c + 0.5) / (N + 0.5 (V + 1)))
    over the tokens; score: the model's log10 probability of the words' subwords and the end. Rows with equal or null ids
    are scored one by one. Without training rows N and V are 0. An empty table gives an empty table; other columns are ignored.

    Counts are of all training words, by 64-bit hashes. Those of the most frequent, KNOWN_WORDS at most, are sent to the
    workers; rarer words' counts are joined, from all of them.
    """
    spark = docs.sparkSession
    mark = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("held_out"), as_bytes("text").alias("t"))
    read = written(read_texts(t, tokenizer), "read", "zstd")
    texts = read.where("kind = 0").select("doc_id", "held_out", "t", "ids")
    train = texts.where("not held_out").select(F.xxhash64("doc_id", "ids").alias("h"), "ids")
    ends = train.count()
    counts = written(read.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (1 if ends else 0)
    floor = n + 0.5 * (v + 1)
    least = most_frequent(counts, KNOWN_WORDS)
    top = counts.where(F.col("n") >= least).toArrow()
    hashes = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    pieces = {r["key"]: r["n"] for r in read.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    w, subwords = fit(train, pieces, tokenizer)
    sent = spark.sparkContext.broadcast((hashes[order], top.column("n").to_numpy()[order], flat(w), subwords))
    end_base = float(np.log10((ends + 0.5) / floor))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, weights, own = sent.value
        weights, row = shaped(weights), TaskContext.get().partitionId() << 36
        for b in it:
            scores = np.empty(b.num_rows)
            at = 0
            for inputs, targets, real, begins, starts in own.chunks(x.as_py() for x in b.column(3)):
                logs = log_probs(weights, inputs, targets, begins)
                scores[at : at + len(starts)] = np.add.reduceat(logs * real, starts, dtype=np.float64) / np.log(10)
                at += len(starts)
            for a, e, h, _, _, _, lengths in word_groups(b.column(2)):
                h, _, back = distinct(h)
                c = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    c = np.where(known[at] == h, times[at], 0)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                sums = np.concatenate([[0.0], np.cumsum(np.where(c > 0, np.log10((c + 0.5) / floor), 0.0)[back])])
                rest = np.flatnonzero((c == 0)[back])
                cuts = np.searchsorted(rest, bounds).astype(np.int32)
                cols = [
                    pa.array(row + np.arange(e - a)), b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.array(lengths + 1), pa.array(lengths - np.diff(cuts) + (ends > 0)),
                    pa.array(np.diff(sums[bounds]) + end_base), pa.array(scores[a:e]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[back[rest]].view(np.int64))),
                ]
                row += e - a
                yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    s = written(map_batches(texts, run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"), "scored")
    rare = s.select("row", F.explode("rare").alias("key")).join(counts.where(F.col("n") < least), "key", "left")
    more = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)).alias("rare_base"))
    return s.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op4_lm(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """All documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_lm_scores(docs, crc_mod(5) == 1, tokenizer)
