"""Scans that feed a training: ratings of used users or items, ordered pages, portions, lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.vectors import shuffle_key
from ..schema import FITTED


def by_side(ratings: DataFrame, side: DataFrame, key: str, sets: tuple[int, ...] = FITTED, above: int | None = None, to: int | None = None) -> DataFrame:
    """Ratings of the given sets whose ``key`` is used for training and within (above, to]; the other side's flag isn't asked.

    ``side``: a column of ids named like ``key`` with ``is_used_for_train``. Filters reach the scans on both sides.
    """
    within = lambda df: df.filter((F.col(key) > above) if above is not None else F.lit(True)).filter((F.col(key) <= to) if to is not None else F.lit(True))
    rows = within(ratings.filter(F.col("dataset_type").isin(*sets)))
    return rows.join(within(side.filter("is_used_for_train").select(key)), key, "left_semi").select("user_id", "item_id", "rating")


def sgd_order(ratings: DataFrame, epoch: int, seed: int = 42, sets: tuple[int, ...] = FITTED) -> DataFrame:
    """Ratings of the given sets with ``shuffled``: a random order that changes with the epoch."""
    rows = ratings.filter(F.col("dataset_type").isin(*sets))
    return rows.select("user_id", "item_id", "rating", shuffle_key("user_id", "item_id", seed + epoch).alias("shuffled"))


def _prefix(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def sgd_page(ratings: DataFrame, epoch: int, page: int, size: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """Rows page*size+1 to (page+1)*size of the shuffled order, with their ``position``; ``parts``: tasks for it."""
    rows = global_row_number(sgd_order(ratings, epoch, seed), _prefix(F.col("shuffled")), ["shuffled", "user_id", "item_id"], "position", parts)
    return rows.filter((F.col("position") > page * size) & (F.col("position") <= (page + 1) * size)).select("position", "user_id", "item_id", "rating")


def portions(counts: DataFrame, key: str, capacity: int, threads: int = 1) -> DataFrame:
    """Ranges of ids packed to at most ``capacity`` ratings (``portion, id_to, n_rows, n_ratings``).

    Ids are walked in order and a portion closes when the next id would overfill it; capacity is at least the largest
    row, and at most what gives each thread a portion. Where a portion ends depends on all before it, so one task
    walks over the sorted (id, count) pairs as they stream by and holds the open portion only. Spark's own
    partitioning takes the place of portions in a training, this is for reports and parity.
    """
    rows = counts.filter("ratings_count > 0").select(F.col(key).cast("long").alias("id"), F.col("ratings_count").cast("long").alias("n"))
    size = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    cap = max(-(-size.total // threads) if size.total < capacity * threads else capacity, size.most)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, n_rows, total = 0, 0, 0, 0
        names = ["portion", "id_to", "n_rows", "n_ratings"]
        for batch in batches:
            done = []
            for i, n in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist()):
                if n_rows and total + n > cap:
                    done.append((number, last, n_rows, total))
                    number, n_rows, total = number + 1, 0, 0
                last, n_rows, total = i, n_rows + 1, total + n
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], names)
        if n_rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, last, n_rows, total)], names)

    return rows.orderBy("id").coalesce(1).mapInArrow(walk, "portion long, id_to long, n_rows long, n_ratings long")


def lookup_user(users: DataFrame, extra: DataFrame, login: str | None = None, user_id: int | None = None) -> DataFrame:
    """The user of that login (blanks at its end aside) or id, or no row, with what else is stored about them."""
    rows = users.filter(F.rtrim("login") == login.rstrip()) if login is not None else users.filter(F.col("id") == user_id) if user_id is not None else users
    more = extra.select("id", "unrated_items", "most_rated_items")
    return rows.join(more, "id", "left").select("id", F.rtrim("login").alias("login"), "list_id", "unrated_items", "most_rated_items")


def factor_row(factors: DataFrame, key: int) -> DataFrame:
    """The factors of one id; the filter is pushed to the scan of a stored model."""
    return factors.filter(F.col("id") == key)
