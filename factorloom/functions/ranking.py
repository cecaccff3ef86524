"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, bucket: Column, order: list, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in the order of (bucket, *order); ``bucket`` must be monotone in that order.

    Rows are numbered within their bucket; only the buckets' counts, one row each, are summed in one place. ``parts``:
    tasks for the buckets, else the session's number.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = df.repartition(parts, "_bucket") if parts else df
    numbered = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)))
    out = numbered.join(counts.select("_bucket", before.alias("_before")), "_bucket")
    return out.withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_own", "_before")
