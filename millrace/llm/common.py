"""What the operators of this subpackage share: scratch tables, shipping of the code, ids and byte-level text rules."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside an operator: lower than any real id.
NULL_ID = -(2**63)
#: `[\x20\x09-\x0D]`: what bytes.split() and bytes.strip() take as white space.
BLANK = b" \t\n\x0b\x0c\r"
#: A word, as Java's and DuckDB's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
#: Paths of the tables of each scope of passing() that is open.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str, lasting: bool = False) -> str:
    """A new path in the shared folder. It goes with the innermost scope of passing(), if lasting with the next outer one; without a scope, when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if scopes := _scopes.get()[: -1 if lasting else None]:
        scopes[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A scope: tables written in it, but for the lasting ones, go when it ends, and files of its shuffles with each query. What is read after it must not come from them."""
    was, paths = spark.conf.get(CLEANUP, None), []
    token = _scopes.set((*_scopes.get(), paths))
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        _scopes.reset(token)
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
        for path in paths:
            discard(spark, path)


def written(df: DataFrame, label: str, compression: str = "snappy", by: str | None = None, lasting: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and a lost executor loses nothing. by: a column of few values whose rows are read apart. lasting: it outlives passing()."""
    path = scratch(df.sparkSession, label, lasting)
    df.write.parquet(path, compression=compression, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sent_if_small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table, marked to be broadcast if it has `most` rows or fewer; otherwise Spark joins it by shuffling."""
    return F.broadcast(df) if df.count() <= most else df


def text_key(c: str = "text") -> Column:
    """A hash of a text; null: of the empty text."""
    return F.xxhash64(as_bytes(c))


def as_bytes(c: str | Column) -> Column:
    """UTF-8 of a text; null: empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("binary"), F.lit(b""))


def id_key(c: str = "doc_id") -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(NULL_ID))


def crc_mod(n: int, c: str = "doc_id") -> Column:
    """crc32(id as text) mod n; null: of the empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df through f in Arrow batches; the code is shipped first."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
