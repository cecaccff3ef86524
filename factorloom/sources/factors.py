"""Factors and biases in raw binary files: rows one after another, little-endian floats, row r for id r + 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 4 << 20  # bytes that a task reads, about


def read_binary(spark: SparkSession, path: str, rank: int, double: bool = False) -> DataFrame:
    """``id, features`` from a file in a folder that all executors see; each task reads a range of whole rows."""
    width, kind = rank * (8 if double else 4), "<f8" if double else "<f4"
    size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    rows, step = size // width, max(1, CHUNK // width)
    ranges = spark.range(0, max(1, -(-rows // step)), 1, max(1, min(4096, -(-rows // step)))).select((F.col("id") * step).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for first in batch.column("first").to_pylist():
                n = min(step, rows - first)
                if n <= 0:
                    continue
                with system.open_input_file(at) as f:
                    table = np.frombuffer(f.read_at(n * width, first * width), kind)
                values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rank), pa.array(table))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + 1, first + n + 1, dtype=np.int32)), values], ["id", "features"])

    return ranges.mapInArrow(run, f"id int, features array<{'double' if double else 'float'}>")


def read_biases(spark: SparkSession, path: str, double: bool = False) -> DataFrame:
    """``id, bias`` from a file of one number an id, as it lies beside the factors of a model with biases."""
    return read_binary(spark, path, 1, double).select("id", F.element_at("features", 1).alias("bias"))
