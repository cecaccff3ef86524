"""Alternating least squares: MLlib by default, an own loop for warm starts and unequal regularisation.

Each half-step solves, for every row with n ratings, (F'F + reg * n * I) x = F'r over the fixed side's factors. For
the own loop the ratings are laid out once in blocks of rows (``layout``); a half-step then moves only factors, each
to the blocks that hold a rating of it, once a block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT = 100_000  # ratings of one row from which its sums are taken in several blocks
BLOCK_VALUES = 16 << 20  # factor values that the ratings of one block may ask for: bounds a task's memory (128 MB)
BLOCK_RATINGS = 1_000_000  # ratings of a block, about: at low ranks they take more memory than the factors
SOLVED_AT_ONCE = 1 << 21  # values of the normal equations that are solved together


def train_mllib(ratings: DataFrame, rank: int, iterations: int, reg: float, seed: int = 42, blocks: int | None = None, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) as ``id, features``. The columns are swapped since MLlib solves its user side last.

    One side's factors are checkpointed in each iteration: MLlib then deletes what the iteration before sent, which
    is a factor for about each rating and half-step. ``place``: where to, if the session has no folder for it.
    """
    sc = ratings.sparkSession.sparkContext
    if place and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, userCol="item_id", itemCol="user_id", ratingCol="rating", seed=seed, coldStartStrategy="drop", checkpointInterval=1)
    if blocks:
        als = als.setNumBlocks(blocks)
    model = als.fit(ratings.select("user_id", "item_id", F.col("rating").cast("float").alias("rating")))
    return model.itemFactors, model.userFactors


def random_factors(ids: DataFrame, rank: int, seed: int, old: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """``id, features`` for ``ids`` (a column id): old factors where there are any, else normal with deviation 1/rank.

    The draw depends on the id, the position and the seed alone (Box-Muller over hashes), not on partitions.
    ``first`` (``id, avg_rating``): the first factor of fresh rows is the average rating.
    """
    unit = lambda j, k: (F.pmod(F.xxhash64("id", F.lit(j), F.lit(k), F.lit(seed)), F.lit(1 << 52)).cast("double") + 1.0) / float((1 << 52) + 1)
    normal = [F.sqrt(-2.0 * F.log(unit(j, 0))) * F.cos(2.0 * np.pi * unit(j, 1)) / float(rank) for j in range(rank)]
    rows = ids.select("id").distinct()
    if first is not None:
        rows = rows.join(first.select("id", F.col("avg_rating").alias("_avg")), "id", "left")
        normal[0] = F.coalesce(F.col("_avg"), normal[0])
    rows = rows.select("id", F.array(*normal).alias("features"))
    if old is not None:
        rows = rows.join(old.select("id", F.col("features").alias("_old")), "id", "left").select("id", F.coalesce("_old", "features").alias("features"))
    return rows


@dataclass(frozen=True)
class Layout:
    """Ratings of one side: ``cells`` (``block, part, key, other, rating``) and ``links`` (``other, block``), each written once."""

    cells: DataFrame
    links: DataFrame
    split: bool  # whether some row lies in several blocks
    blocks: int  # their number, at most: a half-step has a task for each


def layout(ratings: DataFrame, key: str, other: str, rank: int, save: Callable[[DataFrame, str], DataFrame], hot: int = HOT) -> Layout:
    """Deal ratings into blocks by row, by their number and the rank; a row with more than ``hot`` ratings into several.

    A block is a range of rows. Ids that arose together often rate the same, and then a factor goes to few blocks.
    ``part`` is -1 for a whole row, else the number of its piece.
    """
    n = ratings.count()
    blocks = max(1, -(-n * rank // BLOCK_VALUES), -(-n // BLOCK_RATINGS), ratings.sparkSession.sparkContext.defaultParallelism)
    counts = ratings.groupBy(key).agg(F.count("*").alias("_n"))
    big = save(counts.filter(F.col("_n") > hot).select(F.col(key).alias("_key"), F.ceil(F.col("_n") / hot).cast("int").alias("_parts")), "large")
    rows = ratings.join(big, ratings[key] == big["_key"], "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(other), F.col("_parts"))).otherwise(F.lit(-1)).cast("int")
    rows = rows.select(part.alias("part"), F.col(key).cast("int").alias("key"), F.col(other).cast("int").alias("other"), F.col("rating").cast("float").alias("rating"))
    rows = rows.repartitionByRange(blocks, "key", "part").sortWithinPartitions("key", "part", "other")
    cells = save(rows.select(F.spark_partition_id().alias("block"), "part", "key", "other", "rating"), "cells")
    links = save(cells.select("other", "block").distinct(), "links")
    return Layout(cells, links, big.limit(1).count() > 0, blocks)


def _solve(a: np.ndarray, b: np.ndarray, n: np.ndarray, reg: float) -> np.ndarray:
    return np.linalg.solve(a + (reg * n)[:, None, None] * np.eye(b.shape[1]), b[:, :, None])[:, :, 0]


def half_step(plan: Layout, fixed: DataFrame, reg: float) -> DataFrame:
    """``id, features`` of the laid out side from ``fixed`` (``id, features`` of the other side).

    A block sums each row's normal equations and solves many at once. Pieces of one row are added up first. Each block
    is a task: dealt by hash into as many tasks as the session sets, a task would get more blocks as the input grows.
    """
    sent = plan.links.join(fixed.select(F.col("id").alias("other"), F.col("features").cast("array<double>").alias("features")), "other")

    def solve(cells: pa.Table, factors: pa.Table) -> pa.Table:
        empty = {"id": pa.array([], pa.int32()), "features": pa.array([], pa.list_(pa.float64())), "sums": pa.array([], pa.binary())}
        if not cells.num_rows or not factors.num_rows:
            return pa.table(empty)
        ids = factors.column("other").to_numpy()
        rank = len(factors.column("features")[0])
        f = factors.column("features").combine_chunks().flatten().to_numpy().reshape(-1, rank)
        by = np.argsort(ids)
        key, part, other, r = (cells.column(c).to_numpy() for c in ("key", "part", "other", "rating"))
        at = np.minimum(np.searchsorted(ids, other, sorter=by), len(ids) - 1)
        known = ids[by[at]] == other  # an id without factors has no say
        key, part, at, other, r = key[known], part[known], by[at[known]], other[known], r[known].astype(np.float64)
        order = np.lexsort((other, part, key))
        key, part, at, r = key[order], part[order], at[order], r[order]
        if not len(key):
            return pa.table(empty)
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        ends, step = np.append(cuts[1:], len(key)), max(1, SOLVED_AT_ONCE // (rank * rank))
        out: list[pa.Table] = []
        for first in range(0, len(cuts), step):
            starts, stops = cuts[first : first + step], ends[first : first + step]
            a, b = np.empty((len(starts), rank, rank)), np.empty((len(starts), rank))
            for i, (x, y) in enumerate(zip(starts.tolist(), stops.tolist())):
                rows = f[at[x:y]]
                a[i], b[i] = rows.T @ rows, r[x:y] @ rows
            n, whole = (stops - starts).astype(np.float64), part[starts] < 0
            solved = _solve(a[whole], b[whole], n[whole], reg)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(solved) + 1, dtype=np.int32) * rank), pa.array(solved.ravel()))
            out.append(pa.table({"id": pa.array(key[starts][whole], pa.int32()), "features": lists, "sums": pa.nulls(len(solved), pa.binary())}))
            raw = [np.concatenate([[n[i]], a[i].ravel(), b[i]]).tobytes() for i in np.flatnonzero(~whole)]
            out.append(pa.table({"id": pa.array(key[starts][~whole], pa.int32()), "features": pa.nulls(len(raw), pa.list_(pa.float64())), "sums": pa.array(raw, pa.binary())}))
        return pa.concat_tables(out)

    by_block = lambda df: df.repartitionById(plan.blocks, F.col("block")).groupBy("block")
    out = by_block(plan.cells).cogroup(by_block(sent)).applyInArrow(solve, "id int, features array<double>, sums binary")
    if not plan.split:
        return out.select("id", "features")

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
        k = int((np.sqrt(4 * len(total) - 3) - 1) / 2)
        solved = _solve(total[None, 1 : 1 + k * k].reshape(1, k, k), total[None, 1 + k * k :], total[:1], reg)
        return pa.table([pa.array([table.column("id")[0].as_py()], pa.int32()), pa.array([solved[0].tolist()])], ["id", "features"])

    pieces = out.filter("features is null").select("id", "sums").groupBy("id").applyInArrow(add, "id int, features array<double>")
    return out.filter("features is not null").select("id", "features").unionByName(pieces)


def train_own(spark: SparkSession, ratings: DataFrame, rank: int, iterations: int, user_reg: float, item_reg: float, save, seed: int = 42, old: tuple[DataFrame, DataFrame] | None = None, first_is_avg: bool = False) -> tuple[DataFrame, DataFrame]:
    """(user factors, item factors) after ``iterations`` of user, then item steps. ``save(df, name)`` writes and rereads
    a step's result, which cuts lineage and survives lost executors."""
    ratings = save(ratings.select("user_id", "item_id", "rating"), "ratings")
    by_user, by_item = layout(ratings, "user_id", "item_id", rank, save), layout(ratings, "item_id", "user_id", rank, save)
    ids = ratings.select(F.col("item_id").alias("id"))
    first = ratings.groupBy(F.col("item_id").alias("id")).agg(F.avg("rating").alias("avg_rating")) if first_is_avg else None
    items = save(random_factors(ids, rank, seed, old[1] if old else None, first), "items")
    users = None
    for _ in range(iterations):
        users = save(half_step(by_user, items, user_reg), "users")
        items = save(half_step(by_item, users, item_reg), "items")
    return users, items
