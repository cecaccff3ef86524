"""Token ids as flat binary files with document offsets (operator 8).

A store is a folder with two files for each part and a manifest:

* ``<part>.bin``: the ids of the part's documents, one after another, little-endian unsigned; 2 bytes each if the
  vocabulary fits, else 4.
* ``<part>.idx``: eight 64-bit little-endian words (magic, version, bytes an id, documents, ids, 3 spare), then
  documents + 1 unsigned 64-bit offsets counted in ids from the start of the part, then the signed 64-bit document
  ids, then one byte each that is 1 if the id is not null.
* the manifest, one row a part: number, file names, documents, ids, and the base (ids of all parts before it), a
  prefix sum over the parts. Offset in the store = base + offset in the part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, scratch, text_view
from .fragments import encoder

MAGIC, VERSION = 0x464C544F4B454E53, 1


@dataclass(frozen=True)
class TokenStore:
    """Where a store is, and its parts: (number, bin, idx, documents, ids, base); a row for each written partition."""

    path: str
    width: int
    parts: list[tuple[int, str, str, int, int, int]]


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode ``docs`` in ascending id order (nulls first; rows of one id in the order of their texts' hash) to a store.

    One range exchange of (id, text); each task then streams its ids to files named for its attempt, so that a task
    that runs again after a loss can't mix with the first try: only what the finished attempt reports is listed.
    Null text counts as empty; with ``end_id`` every document, empty ones too, ends with it. Repeated rows are
    written as often as they occur. An empty table gives a store without parts. Other columns are ignored.
    """
    import os

    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    _fs(path)[0].create_dir(_fs(path)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get()
        number = task.partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        store, folder = _fs(path)
        sizes, ids_of, valid, total, out = [], [], [], 0, None
        for batch in pieces(batches, "text", 4 << 20):
            out = out or store.open_output_stream(os.path.join(folder, f"{name}.bin"))
            ids, first = enc.encode(*text_view(batch.column("text")))
            lens = np.diff(first)
            if end_id is not None:
                ids = np.insert(ids, first[1:], end_id)
                lens = lens + 1
            out.write(ids.astype(f"<u{width}").tobytes())
            total += len(ids)
            sizes.append(lens)
            keys = batch.column("id").cast(pa.int64())
            valid.append(np.asarray(keys.is_valid(), dtype=np.uint8))
            ids_of.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        sizes = np.concatenate(sizes)
        head = np.array([MAGIC, VERSION, width, len(sizes), total, 0, 0, 0], "<u8")
        with store.open_output_stream(os.path.join(folder, f"{name}.idx")) as f:
            for x in (head, np.concatenate([[0], np.cumsum(sizes)]).astype("<u8"), np.concatenate(ids_of).astype("<i8"), np.concatenate(valid)):
                f.write(x.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [number], "bin": [f"{name}.bin"], "idx": [f"{name}.idx"], "docs": [len(sizes)], "ids": [total]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    done = rows.mapInArrow(run, "part long, bin string, idx string, docs long, ids long").collect()  # a row a partition
    parts, base = [], 0
    for r in sorted(done, key=lambda r: r.part):
        parts.append((r.part, r.bin, r.idx, r.docs, r.ids, base))
        base += r.ids
    return TokenStore(path, width, parts)


def _open(store: TokenStore | str, name: str, dtype: str, offset: int, count: int) -> np.ndarray:
    """A memory map of a local or mounted file; the bytes asked for from any other file system."""
    system, folder = _fs(store if isinstance(store, str) else store.path)
    size = np.dtype(dtype).itemsize
    if count == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype, "r", offset, (count,))
    with system.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read_at(count * size, offset), dtype)


def part_documents(path: str, width: int, part: tuple, step: int = 4096) -> Iterator[tuple]:
    """(document id or None, start in the store, ids) of each document of a part, a few of them mapped at a time."""
    _, name, index, docs, total, base = part
    head = _open(path, index, "<u8", 0, 8)
    assert head[0] == MAGIC and head[2] == width and head[3] == docs and head[4] == total, f"{index} is damaged"
    offsets = _open(path, index, "<u8", 64, docs + 1)
    keys = _open(path, index, "<i8", 64 + 8 * (docs + 1), docs)
    valid = _open(path, index, "u1", 64 + 8 * (2 * docs + 1), docs)
    for a in range(0, docs, step):
        at = np.asarray(offsets[a : a + step + 1]).astype(np.int64)
        ids = _open(path, name, f"<u{width}", int(at[0]) * width, int(at[-1] - at[0]))
        for i in range(len(at) - 1):
            yield (int(keys[a + i]) if valid[a + i] else None, base + int(at[i]), ids[at[i] - at[0] : at[i + 1] - at[0]])


def read(spark: SparkSession, store: TokenStore, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The store's documents from its files: ``id_col, start, n_tokens, ids_crc32`` and, if asked, ``ids``; a task a part.

    Cases: a null id comes back null, repeated documents as often as they were written, empty ones with the end id
    alone; a store without parts gives no rows; a file that doesn't fit the manifest is an error.
    """
    path, width = store.path, store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows: list[tuple] = []
                for key, start, ids in part_documents(path, width, (r["part"], r["bin"], r["idx"], r["docs"], r["ids"], r["base"])):
                    rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                    if len(rows) == 2048:
                        yield _batch(rows, id_col, with_ids)
                        rows = []
                yield _batch(rows, id_col, with_ids)

    schema = "part long, bin string, idx string, docs long, ids long, base long"
    parts = spark.createDataFrame(store.parts, schema).repartition(max(1, len(store.parts)))
    return parts.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _batch(rows: list[tuple], id_col: str, with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[4] for r in rows], pa.list_(pa.int64()))] * with_ids
    return pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a store in the shared folder and read it back. Cases: as for ``write`` and ``read``."""
    return read(spark, write(spark, docs, scratch(spark, "tokens"), tokenizer, end_id))
