"""Line dedup over levelled sorted runs of line hashes.

Runs hold a row a key: in how many documents a batch had it, and, in the run that saw the key first, who holds it. Each new
batch is merge-anti-joined with the runs to find its new keys and then adds a run of its own; a full level is compacted
into one run of the next. Batches go by falling document id, so who holds a key first is the largest id that holds it.

All runs have the same buckets of a key's hash, each sorted, and Spark knows it: a batch's keys are dealt into these buckets once,
and then joins, compactions and totals read the runs bucket by bucket, without a shuffle. Texts are not shuffled
either where the keys that lose lines are few enough to be sent to them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, as_bytes, discard, id_key, map_batches, scratch, written


#: Pairs of key and document for a bucket of the runs, about.
BUCKET_PAIRS = 1 << 20
#: Keys that lose lines, up to which they are sent to the texts (20 bytes each); more of them are joined by document.
SENT_KEYS = 1 << 20
#: A key with more than one in HOT of all pairs of key and document is treated as hot.
HOT = 1024


def line_key(line: bytes) -> bytes:
    """A line without white space at both ends, A-Z lower-cased."""
    return line.strip(BLANK).lower()


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128 bits of a line's key, or None if the key is shorter than min_chars code points."""
    k = line_key(line)
    if len(k) < min_chars or not k.isascii() and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return struct.unpack("<qq", xxhash.xxh3_128_digest(k))


class LineRuns:
    """Levels of sorted runs (h1, h2, docs, holder) in the shared folder, as bucketed tables. holder is null but in the run that saw the key first."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int = 8):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[tuple[str, str]]] = [[]]

    def runs(self) -> list[tuple[str, str]]:
        return [r for level in self.levels for r in level]

    def merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Runs as one, a row a key: merged in pairs by joins, whose sides have the same buckets."""
        out = None
        for name, _ in runs:
            own = self.spark.table(name)
            if out is None:
                out = own
                continue
            more = own.withColumnsRenamed({"docs": "__docs", "holder": "__holder"}).hint("merge")
            docs, both = F.coalesce("docs", F.lit(0)) + F.coalesce("__docs", F.lit(0)), out.join(more, ["h1", "h2"], "full")
            out = both.select("h1", "h2", docs.alias("docs"), F.greatest("holder", "__holder").alias("holder"))
        return self.spark.createDataFrame([], "h1 long, h2 long, docs long, holder long") if out is None else out

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"millrace_run_{uuid.uuid4().hex}", scratch(self.spark, f"run{level}")
        rows.select("h1", "h2", "docs", "holder").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"drop table if exists {name}")
            discard(self.spark, path)

    def add(self, keys: DataFrame) -> None:
        """A batch's (h1, h2, docs, holder), a row a key: known keys add to the counts, new keys also set the holder."""
        keys = keys.repartition(self.buckets, "h1", "h2")
        for i, (name, _) in enumerate(self.runs()):
            seen = self.spark.table(name).where("holder is not null").select("h1", "h2", F.lit(True).alias(f"seen{i}"))
            keys = keys.join(seen.hint("merge"), ["h1", "h2"], "left").withColumn("holder", F.when(F.col(f"seen{i}").isNull(), F.col("holder"))).drop(f"seen{i}")
        self._write(keys, 0)
        for n in range(len(self.levels)):
            if len(self.levels[n]) >= self.fanout:
                self.compact(n)

    def compact(self, n: int) -> None:
        """Merge the runs of a level into one of the next."""
        old, self.levels[n] = self.levels[n], []
        self._write(self.merged(old), n + 1)
        self._drop(old)

    def totals(self) -> DataFrame:
        return self.merged(self.runs())

    def close(self) -> None:
        """Drop all runs."""
        self._drop(self.runs())
        self.levels = [[]]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, kept_text.

    A text is split at \\n; null and empty texts are one empty line. A line whose key (see line_key) has min_chars code
    points or more and lies in min_docs documents or more is dropped, with its repeats, but in the largest doc_id that has it. A
    document is a doc_id: rows with the same id count once and are treated alike; null ids are one document, below all
    others. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession

    def lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            batch, doc, h1, h2 = [], [], [], []
            for n, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for h in {line_hash(x, min_chars) for x in t.split(b"\n")} - {None}:
                    batch.append(n)
                    doc.append(d)
                    h1.append(h[0])
                    h2.append(h[1])
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), *(pa.array(x, pa.int64()) for x in (doc, h1, h2))], ["batch", "doc", "h1", "h2"])

    t = docs.select(id_key().alias("doc"), as_bytes("text").alias("t"))
    cuts = t.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)])).first()[0] or [] if batches > 1 else []
    number = sum((F.when(F.col("doc") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)).cast("int")
    table = written(map_batches(t.select(number.alias("batch"), "doc", "t"), lines, "batch int, doc long, h1 long, h2 long").select("doc", "h1", "h2", "batch"), "lines", by="batch")
    pairs = table.count()
    runs = LineRuns(spark, fanout, max(8, min(8192, pairs // BUCKET_PAIRS)))
    for n in range(len(set(cuts)) + 1):
        runs.add(table.where(F.col("batch") == n).groupBy("h1", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("holder")))
    frequent = written(runs.totals().where(F.col("docs") >= min_docs), "frequent")
    runs.close()
    schema, names = "doc_id long, n_lines long, n_dropped long, kept binary", ["doc_id", "n_lines", "n_dropped", "kept"]

    def kept_rows(ids: pa.Array, total: list[int], dropped: list[int], kept: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("doc"), as_bytes("text").alias("t"))
    if frequent.count() <= SENT_KEYS:
        known = frequent.select("h1", "h2", "holder").orderBy("h1").toArrow()
        arrays = [known[c].to_numpy() for c in ("h1", "h2", "holder")]
        if (arrays[0][1:] != arrays[0][:-1]).all():
            sent = spark.sparkContext.broadcast(arrays)

            def keep_known(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                h1s, h2s, holders = sent.value
                for b in it:
                    total, dropped, kept = [], [], []
                    for doc, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                        text = t.as_py()
                        lines = text.split(b"\n")
                        total.append(len(lines))
                        own = [(i, *h) for i, x in enumerate(lines) if (h := line_hash(x, min_chars))]
                        gone: set[int] = set()
                        if own and len(h1s):
                            place, h1, h2 = (np.array(c, np.int64) for c in zip(*own, strict=True))
                            at = np.minimum(np.searchsorted(h1s, h1), len(h1s) - 1)
                            gone = set(place[(h1s[at] == h1) & (h2s[at] == h2) & (holders[at] != doc)].tolist())
                        dropped.append(len(gone))
                        kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text)
                    yield kept_rows(b.column(0), total, dropped, kept)

            return map_batches(texts, keep_known, schema).select(*names[:3], F.col("kept").cast("string").alias("kept_text"))
    # keys with over 1/HOT of all pairs of key and document: fewer than HOT of them, so they are broadcast and none fills a task
    hot = F.col("docs") * HOT > max(1, pairs)
    heavy = frequent.where(hot).select("h1", "h2", F.col("holder").alias("hot_holder"))
    seen = table.drop("batch").join(F.broadcast(heavy), ["h1", "h2"], "left")
    rest = seen.where("hot_holder is null").join(frequent.where(~hot).select("h1", "h2", "holder"), ["h1", "h2"]).where("doc <> holder")
    gone = seen.where("doc <> hot_holder").select("doc", "h1", "h2").union(rest.select("doc", "h1", "h2"))
    drops = gone.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            total, dropped, kept = [], [], []
            for t, drop in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines = t.split(b"\n")
                total.append(len(lines))
                if drop:
                    gone = {(x["h1"], x["h2"]) for x in drop}
                    lines = [x for x in lines if line_hash(x, min_chars) not in gone]
                    t = b"\n".join(lines)
                dropped.append(total[-1] - len(lines))
                kept.append(t)
            yield kept_rows(b.column(0), total, dropped, kept)

    return map_batches(texts.join(drops, "doc", "left").select("doc_id", "t", "drop"), keep, schema).select(*names[:3], F.col("kept").cast("string").alias("kept_text"))


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
with lines as (
  select doc_id, i, line, length(k) >= 20 as long, k
  from (
    select doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from (select doc_id, generate_subscripts(l, 1) as i, unnest(l) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents))
  )
),
frequent as (select k, max(doc_id) as holder from lines where long group by k having count(distinct doc_id) >= 3),
marked as (select lines.doc_id, i, line, f.k is not null and lines.doc_id <> f.holder as gone from lines left join frequent f on lines.k = f.k and lines.long)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
