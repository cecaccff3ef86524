"""Connected components of an edge list too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest node, at most one edge a node."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.link(x, y)
    pairs = [(x, r) for x in list(forest.parent) if (r := forest.root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["hi", "lo"])


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for the nodes of ``edges`` (two long columns) that have a link.

    Partitions are first contracted on their own; then large-star and small-star rounds, each written to the shared
    folder, until every component is a star. Only joins on keys and sums combined before the shuffle: a hub's edges
    are never in one task. Edges with a null end and loops count for nothing; an empty list gives no rows.
    """
    a, b = edges.columns
    e = edges.select(F.col(a).cast("long").alias("hi"), F.col(b).cast("long").alias("lo")).filter("hi is not null and lo is not null and hi <> lo")
    e = materialize(spark, e.distinct().mapInArrow(_contract, "hi long, lo long").distinct(), "edges")
    for _ in range(rounds):
        ends = e.select(F.col("hi").alias("node"), F.lit(1).alias("upper"), "lo").unionByName(e.select(F.col("lo").alias("node"), F.lit(0).alias("upper"), F.lit(None).cast("long").alias("lo")))
        ends = ends.groupBy("node").agg(F.min("upper").alias("u0"), F.max("upper").alias("u1"), F.min("lo").alias("l0"), F.max("lo").alias("l1"))
        if not ends.filter("u0 <> u1 or l0 <> l1").limit(1).count():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        least = e.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "at")
        # large star: a node's larger neighbours go to its smallest one
        large = e.join(least, e["lo"] == least["at"], "left").select("hi", F.coalesce("least", "lo").alias("lo")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("hi").agg(F.min("lo").alias("least")).withColumnRenamed("hi", "at")
        joined = large.join(least, large["hi"] == least["at"]).select("hi", "lo", "least")
        small = joined.select("hi", F.col("least").alias("lo")).unionByName(joined.filter("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo")))
        e = materialize(spark, small.distinct().mapInArrow(_contract, "hi long, lo long").distinct(), "edges")
    raise RuntimeError(f"no star forest after {rounds} rounds")
