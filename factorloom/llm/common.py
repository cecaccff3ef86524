"""Helpers shared by the training-data operators: shared storage, Arrow text views, vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only a plain local session, where driver and executors are one process, may go without the setting; then a
    temporary folder is made once per session. A cluster without it is an error, not a silent local folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    place = "file://" + tempfile.mkdtemp(prefix="factorloom-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed by ``release``, or else when the driver's Python ends."""
    path = f"{shared_dir(spark)}/factorloom-{uuid.uuid4().hex}/{name}"
    if not _scratch:
        atexit.register(release, spark)
    _scratch.append(path.rpartition("/")[0])
    return path


_scratch: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all scratch paths made so far; call it when the results that were built on them are written."""
    while _scratch:
        _remove(spark, _scratch.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BUCKET_BYTES = 256 << 20  # of the input as stored


def buckets(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Hash buckets for blob shuffles: the session's shuffle partitions, or more where ``docs`` is large by the planner's estimate."""
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if docs is not None else 0
    return max(n, -(-size // BUCKET_BYTES)) if size < 1 << 55 else n  # beyond that it is no estimate but "unknown"


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text, or one row: bounds the working memory."""
    for batch in batches:
        _, offsets = text_view(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    trim()


def trim() -> None:
    """Give freed memory back to the system: workers are reused, and keep what their largest task took otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct contents of raw[start:end], and the number among them of each span; none empty, ascending, not overlapping.

    Contents are told apart by their bytes, in Arrow's dictionary, not by a hash of them.
    """
    if len(starts) == 0:
        return [], np.zeros(0, np.int64)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    _, bounds, data = spans.dictionary.buffers()
    at, data = np.frombuffer(bounds, np.int64, len(spans.dictionary) + 1).tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(at[:-1], at[1:])], spans.indices.to_numpy(zero_copy_only=False)


_KEY = b"factorloom words"


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keyed BLAKE2b of each raw[start:end]; each distinct content is hashed once.

    Among d distinct words any two share a hash with a chance of about d * d / 2**65: 1e-5 at 20 million words.
    """
    distinct, number = distinct_spans(raw, starts, ends)
    digests = b"".join([blake2b(x, digest_size=8, key=_KEY).digest() for x in distinct])
    return np.frombuffer(digests, "<u8").astype(U64)[number]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, none across texts: (starts, ends, first word of each text)."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and the first gram of each text.

    A text with fewer words than k but at least one has its whole sequence as one gram; without words it has none.
    """
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    gram_first = np.concatenate([[0], np.cumsum(per)])
    total = int(gram_first[-1])
    at = np.repeat(first[:-1] - gram_first[:-1], per) + np.arange(total)
    length = np.repeat(np.minimum(counts, k), per)
    out = np.zeros(total, U64)
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    for j in range(k):
        out = np.where(j < length, mix(out * U64(0xD1342543DE82EF95) + padded[at + j]), out)
    return out, gram_first
