"""Intermediate tables: written and reread, so that no step is done twice and none keeps what it sent on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet, reread. The shuffle files of the write go with its end.

    Left to itself, Spark deletes them once the driver collects garbage, which may be after the last step.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a frame that ``write`` gave, when nothing reads it any more; other frames are left alone."""
    path = df.__dict__.get("_written")
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
