"""Media columns: payloads as images in archives, read by a data source that plans byte ranges.

Archives are ZIP files whose directories list the members. A partition is byte ranges of archives that lie next to each other
and reads the members that begin in them, found in the directories; each member is read by its offset, checked, and tried
again alone if that fails. Ranges grow with the archives, so that there are PARTITIONS partitions at most.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import as_bytes, map_batches, scratch, ship

WIDTH = 64
#: Bytes of an archive, of a partition and of an Arrow batch, about; a member is whole in each.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 8 << 20
#: Partitions that are planned at most; members are tried so often.
PARTITIONS, TRIES = 50_000, 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey PNG with the payload as samples, WIDTH a row; the unpadded length is a text chunk."""
    rows = len(payload) // WIDTH
    samples = np.zeros((rows, WIDTH + 1), np.uint8)
    samples[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows by WIDTH) and unpadded length of what encode_png() wrote; anything else is a ValueError."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, parts, shape, n_bytes = len(SIGNATURE), [], None, None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt":
            n_bytes = int(data.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(data)
        at += size + 12
    if shape is None or n_bytes is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:], n_bytes


def features(samples: np.ndarray) -> str:
    """A mean hash of 8 by 8 blocks, the mean sample and the entropy of the samples, as text."""
    rows = np.linspace(0, len(samples), 9).astype(int)
    blocks = np.array([[samples[a : max(a + 1, b)][:, c : c + 8].mean() for c in range(0, WIDTH, 8)] for a, b in zip(np.minimum(rows[:-1], len(samples) - 1), rows[1:], strict=True)])
    bits = np.packbits((blocks > np.median(blocks)).ravel()).tobytes().hex()
    p = np.bincount(samples.ravel(), minlength=256) / samples.size
    p = p[p > 0]
    return f"{bits}:{samples.mean():.3f}:{-(p * np.log2(p)).sum() + 0.0:.3f}"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(docs: DataFrame, to: str) -> DataFrame:
    """Write each document's payload as a member of an archive below `to`; the archives (path, n_members, bytes) that count.

    An attempt of a task names its archives anew, and only those that a finished task returns are listed: a task that was
    lost leaves archives that nobody reads. Memory: one archive of ARCHIVE_BYTES, or one larger member.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(to)
        store.create_dir(base, recursive=True)
        buffer, archive, n = None, None, 0

        def close() -> pa.RecordBatch:
            nonlocal buffer, archive
            archive.close()
            name = f"{uuid.uuid4().hex}.zip"
            with store.open_output_stream(f"{base}/{name}.part") as f:
                f.write(buffer.getbuffer())
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([f"{to}/{name}"]), pa.array([n], pa.int64()), pa.array([buffer.tell()], pa.int64())], ["path", "n_members", "bytes"])
            buffer = archive = None
            return row

        for b in it:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if archive is None:
                    buffer = io.BytesIO()
                    archive, n = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED), 0
                raw = text.as_py()
                archive.writestr(zipfile.ZipInfo(f"{n:08d}.{'' if key is None else key}.png"), encode_png(to_payload(raw), len(raw)))
                n += 1
                if buffer.tell() >= ARCHIVE_BYTES:
                    yield close()
        if archive is not None:
            yield close()

    return map_batches(docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("t")), run, "path string, n_members long, bytes long")


class Ranges(InputPartition):
    """Members of archives that begin from byte `first` up to, not including, byte `end`: a list of (path, first, end)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        self.pieces = pieces


def planned(archives: list[tuple[str, int]], range_bytes: int, most: int) -> list[list[tuple[str, int, int]]]:
    """Archives (path, bytes) dealt in order into ranges of range_bytes, or more where there would be over `most` of them."""
    size = max(range_bytes, -(-sum(n for _, n in archives) // most))
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, n in archives:
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = size
            end = min(n, at + room)
            out[-1].append((path, at, end))
            room, at = room - (end - at), end
    return out


def read_member(open_again, info: zipfile.ZipInfo, f) -> bytes:
    """A stored member by its offset; open_again() gives a new handle when a try fails. OSError after TRIES tries."""
    for k in range(TRIES):
        try:
            f = f or open_again()
            f.seek(info.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError("no member at this offset")
            names, extra = struct.unpack("<HH", head[26:30])
            f.seek(info.header_offset + 30 + names + extra)
            data = f.read(info.compress_size)
            if zlib.crc32(data) != info.CRC:
                raise OSError("the checksum differs")
            return data
        except (OSError, struct.error, pa.ArrowException) as e:
            why, f = e, None
            time.sleep(0.05 * 2**k if k + 1 < TRIES else 0)
    raise OSError(f"{info.filename} at {info.header_offset}: {why}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.keep_errors = options["manifest"], options.get("errors", "raise") == "keep"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        store, base = _open(self.manifest)
        archives: list[tuple[str, int]] = []
        for x in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda x: x.path):
            if x.path.endswith(".parquet"):
                t = pq.read_table(store.open_input_file(x.path), columns=["path", "bytes"])
                archives += zip(t["path"].to_pylist(), t["bytes"].to_pylist(), strict=True)
        return [Ranges(p) for p in planned(archives, self.range_bytes, PARTITIONS)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            rows.clear()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "archive", "offset", "media", "error"])

        size = 0
        for archive, first, end in partition.pieces:
            store, path = _open(archive)
            again = lambda store=store, path=path: store.open_input_file(path)
            f = again()
            for info in zipfile.ZipFile(f).infolist():
                if not first <= info.header_offset < end:
                    continue
                key = info.filename.split(".")[1]
                try:
                    media, error = read_member(again, info, f), None
                except OSError as e:
                    if not self.keep_errors:
                        raise
                    media, error = None, str(e)
                rows.append((int(key) if key else None, archive, info.header_offset, media, error))
                size += len(media or b"")
                if size >= BATCH_BYTES:
                    yield batch()
                    size = 0
        yield batch()


class ArchiveSource(DataSource):
    """Members of the archives that the manifest lists. Options: manifest; errors: raise, or keep for rows with media null and error set."""

    @classmethod
    def name(cls) -> str:
        return "millrace_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, errors: str = "raise") -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("manifest", manifest).option("errors", errors).load()


def with_media(docs: DataFrame) -> DataFrame:
    """A row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The text's UTF-8 (null: empty) is padded with bytes 0 to a positive multiple of WIDTH, stored as a PNG in an archive in the shared
    folder, and read back. Equal texts give equal values; rows with equal or null ids are members of their own. An
    empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    manifest = scratch(spark, "manifest")
    write_archives(docs, scratch(spark, "archives")).write.parquet(manifest)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for key, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                samples, n = decode_png(raw := media.as_py())
                payload = samples.tobytes()
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), features(samples)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return map_batches(read_archives(spark, manifest).select("doc_id", "media"), run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through stored media: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return with_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
