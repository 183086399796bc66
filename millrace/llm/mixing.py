"""Mixing sources to target weights: subset-sum budget fitting over the histogram of exact lengths.

A source's target is met by whole passes over the source and a part of one more. For that part each length gives its
share of documents, rounded down; a bounded-knapsack dynamic program over the lengths left fills the rest to the word.
Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, ship, text_key, written

#: Sums that the dynamic program tells apart: each number of words up to this budget, beyond it cells of equally many words.
DP_WORDS = 1 << 20
#: Words that whole documents leave to the dynamic program where they are short enough: so many sums it can still meet to the word.
FILL_WORDS = 1 << 18
#: Documents that are put in order at a time, about.
DRAW_ROWS = 100_000


def word_count(c: str | Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Each source's target: weights repeat over the sources by code point, null last, and share all of the sizes.

    A target stops at `most` times its source's size; the excess is shared anew by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out = dict.fromkeys(order, 0.0)
    left, active = float(sum(sizes.values())), list(order)
    while active and left > 0:
        total = sum(w[s] for s in active)
        share = {s: left * w[s] / total for s in active}
        above = [s for s in active if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        active = [s for s in active if s not in above]
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (at most its count) sum to the number nearest to budget, the lower of two, by dynamic programming.

    first[x] is the item that made the sum x reachable, so the memory is that of the budget and a length, whatever the items.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    end = budget + int(min(budget, lengths[counts > 0].max(initial=0)))  # a sum beyond is no nearer than none
    first = np.full(end + 1, -1, np.int32)
    reach = np.zeros(end + 1, bool)
    reach[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        x, most = int(lengths[i]), int(min(counts[i], end // max(1, lengths[i])))
        if x < 1 or most < 1:
            continue
        k, now = 1, reach.copy()
        while most > 0:
            k = min(k, most)
            step = k * x
            now[step:] |= now[:-step].copy()
            most -= k
            k *= 2
        first[now & ~reach] = i
        reach = now
        if reach[budget]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        i = int(first[at])
        while at and first[at] == i:
            at -= int(lengths[i])
            taken[i] += 1
    return taken


def fill_coarse(lengths: np.ndarray, counts: np.ndarray, budget: int, cells: int, slack: int = 0) -> list[np.ndarray]:
    """Two selections for a large budget: the sum nearest to it that was found, and the largest that is not above it.

    Sums fall into about `cells` cells up to the budget; of each cell the first sum found is kept, exactly, with the
    documents that make it. So the work is that of the cells, and any length and budget can be met. It ends once a sum is
    at most slack below the budget.
    """
    unit = -(-budget // cells)
    end = 2 * budget // unit + 1
    sums, item, times = np.full(end, -1, np.int64), np.zeros(end, np.int32), np.zeros(end, np.int64)
    sums[0] = 0
    for i in [i for i in np.argsort(-lengths, kind="stable") if counts[i] > 0]:
        x, most, k = int(lengths[i]), int(min(counts[i], 2 * budget // max(1, lengths[i]))), 1
        while x > 0 and most > 0:
            k = min(k, most)
            new = sums[sums >= 0] + k * x
            new = new[new < end * unit]
            cell, one = np.unique(new // unit, return_index=True)
            free = sums[cell] < 0
            cell, new = cell[free], new[one][free]
            sums[cell], item[cell], times[cell] = new, i, k
            most -= k
            k *= 2
        if ((sums >= budget - slack) & (sums <= budget)).any():
            break
    reached = np.flatnonzero(sums >= 0)
    below = reached[sums[reached] <= budget]
    out = []
    for at in (reached[np.abs(sums[reached] - budget).argmin()], below[sums[below].argmax()]):
        taken = np.zeros(len(lengths), np.int64)
        while at:
            taken[item[at]] += times[at]
            at = (sums[at] - times[at] * lengths[item[at]]) // unit
        out.append(taken)
    return out


def _rest(lengths: np.ndarray, counts: np.ndarray, shares: np.ndarray, left: int) -> np.ndarray:
    """How many of each length fill what is left: the largest shares first while it is much, then the dynamic program."""
    taken = np.zeros(len(lengths), np.int64)
    for i in np.argsort(-shares, kind="stable") if left > FILL_WORDS else []:
        if left - lengths[i] >= FILL_WORDS // 2 and counts[i] > 0:
            taken[i] += 1
            left -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable") if left > FILL_WORDS else []:  # lengths that differ little
        n = int(min(counts[i] - taken[i], max(0, left - FILL_WORDS // 2) // max(1, lengths[i])))
        taken[i] += n
        left -= n * int(lengths[i])
    return taken + fill(lengths, counts - taken, left) if left <= DP_WORDS else taken


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = 3) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and how many documents of each length the pass after them takes.

    Documents of over half of DP_WORDS words are chosen first where the rest of the target is larger than DP_WORDS, by cells; then the
    shorter ones fill what is left. So no length is out of reach.
    """
    size, goal = int((lengths * counts).sum()), round(target)
    none = np.zeros(len(lengths), np.int64)
    if size == 0:
        return 0, none
    passes = min(most, goal // size)
    rest = goal - passes * size
    if passes >= most or rest <= 0:
        return passes, none
    exact = [int(c) * rest for c in counts]
    taken = np.array([e // size for e in exact], np.int64)
    shares = np.array([e % size / size for e in exact])
    left = rest - int((lengths * taken).sum())
    if left <= DP_WORDS:
        return passes, taken + _rest(lengths, counts - taken, shares, left)
    long, plans = lengths > DP_WORDS // 2, []
    free = counts - taken
    short, given = np.where(long, 0, free), np.where(long, 0, taken)
    nearest, below = fill_coarse(lengths, np.where(long, free, 0), left, DP_WORDS, min(DP_WORDS, int((lengths * short).sum())))
    for first in [nearest] if (nearest == below).all() else [nearest, below]:
        over = left - int((lengths * first).sum())
        more = first + _rest(lengths, short, shares, over) if over > 0 else first - _rest(lengths, given, 1 - shares, -over)
        plans.append((abs(left - int((lengths * more).sum())), more))
    return passes, taken + min(plans, key=lambda p: p[0])[1]


def with_taken(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """One row for each row of docs: key, text_hash, size, source_size, target, copies, taken (copies times size).

    size: words of the text; null or blank: 0. Null sources are one source, last in the order of weights. Rows of size 0
    take no words; they are copied with the whole passes of their source. Equal rows are drawn one by one. An empty table gives
    an empty table. text_hash tells rows of one key apart.

    The sources' sizes come to the driver: as many numbers as the mix has weighted sources. A source's lengths go to one
    task: as many rows as it has distinct lengths, not documents. Documents of one length are drawn in parts of about
    DRAW_ROWS, so no task gets a whole source or length.
    """
    spark = docs.sparkSession
    ship(spark)
    t = written(
        docs.select(
            F.col(key).alias("key"),
            text_key(text).alias("text_hash"),
            F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("src"),
            word_count(text).alias("size"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "key", "text_hash")),
        "mix",
    )
    hist = written(t.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mixhist")
    sizes = {r["src"]: int(r["words"] or 0) for r in hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    goal = targets({(None if s == "n" else s[1:]): w for s, w in sizes.items()}, weights, most)
    goals = {s: float(goal[None if s == "n" else s[1:]]) for s in sizes}

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        src = rows["src"].iloc[0]
        passes, taken = plan_source(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), goals[src], most)
        return pd.DataFrame({"src": src, "size": rows["size"], "passes": passes, "more": taken, "source_size": sizes[src], "target": goals[src]})

    plans = hist.groupBy("src").applyInPandas(plan, "src string, size long, passes long, more long, source_size long, target double")
    parts = max(16, min(4096, t.count() // DRAW_ROWS))
    t = t.withColumn("part", F.pmod(F.shiftright("h", 7), F.lit(parts)).cast("int"))
    before = Window.partitionBy("src", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        t.groupBy("src", "size", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(plans, ["src", "size"])
        .select("src", "size", "part", "passes", "source_size", "target", (F.col("more") - F.col("before")).alias("take"))
    )
    place = Window.partitionBy("src", "size", "part").orderBy("h", "key", "text_hash")
    return (
        t.join(cuts, ["src", "size", "part"])
        .withColumn("copies", F.col("passes") + F.when(F.row_number().over(place) <= F.col("take"), 1).otherwise(0))
        .select(F.col("key").alias(key), "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_taken(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
