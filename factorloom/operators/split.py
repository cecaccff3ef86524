"""Reproducible per-user splits into train, validate and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import shuffle_key
from ..schema import NEW, TEST, TRAIN, UNASSIGNED, VALIDATE


def _ceil_pct(n: Column, pct: int) -> Column:
    """ceil(n * pct / 100) in whole numbers."""
    return F.floor((n.cast("long") * pct + 99) / 100).cast("long")


def resplit(ratings: DataFrame, pcts: tuple[int, int, int] = (85, 10, 5), seed: int = 42) -> DataFrame:
    """Every rating but the new ones assigned anew: of a user's, in random order, ceil(p1 n) to train, up to ceil((p1+p2) n) to validate.

    One exchange by user serves the count, the order and whatever groups by user next.
    """
    w = W.partitionBy("user_id")
    rows = ratings.filter(F.col("dataset_type") != NEW).withColumn("_k", shuffle_key("user_id", "item_id", seed))
    rows = rows.withColumn("_n", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy("_k", "item_id")))
    kind = F.when(F.col("_at") <= _ceil_pct(F.col("_n"), pcts[0]), TRAIN).when(F.col("_at") <= _ceil_pct(F.col("_n"), pcts[0] + pcts[1]), VALIDATE).otherwise(TEST)
    return rows.withColumn("dataset_type", kind.cast("short")).select(*ratings.columns)


def profile(ratings: DataFrame) -> DataFrame:
    """Per user: sorted unassigned items and the sizes of the three sets."""
    of = lambda k: F.count_if(F.col("dataset_type") == k).cast("long")
    free = F.array_sort(F.collect_list(F.when(F.col("dataset_type") == UNASSIGNED, F.col("item_id"))))
    return ratings.filter(F.col("dataset_type") != NEW).groupBy("user_id").agg(free.alias("free_items"), of(TRAIN).alias("n_train"), of(VALIDATE).alias("n_validate"), of(TEST).alias("n_test"))


def incremental(ratings: DataFrame, users: DataFrame | None = None, pcts: tuple[int, int, int] = (85, 10, 5), seed: int = 42) -> DataFrame:
    """Unassigned ratings of used users assigned so that the sets come to their targets; assigned ones stay.

    Targets: ceil(p1 n), ceil((p1+p2) n) less the first, and the rest. What a set lacks is filled in the order train,
    validate, test, from a user's unassigned ratings in random order; a surplus goes to train.
    """
    w = W.partitionBy("user_id")
    have = lambda k: F.count_if(F.col("dataset_type") == k).over(w)
    rows = ratings.withColumn("_k", shuffle_key("user_id", "item_id", seed)).withColumn("_open", (F.col("dataset_type") == UNASSIGNED).cast("int"))
    total, free = F.count_if(F.col("dataset_type") != NEW).over(w), F.sum("_open").over(w)
    rows = rows.select("*", total.alias("_n"), free.alias("_free"), *[have(k).alias(f"_h{k}") for k in (TRAIN, VALIDATE, TEST)], F.row_number().over(w.orderBy(F.desc("_open"), "_k", "item_id")).alias("_at"))
    first, both = _ceil_pct(F.col("_n"), pcts[0]), _ceil_pct(F.col("_n"), pcts[0] + pcts[1])
    goal = {TRAIN: first, VALIDATE: both - first, TEST: F.col("_n") - both}
    need = {k: F.greatest(g - F.col(f"_h{k}"), F.lit(0)) for k, g in goal.items()}
    surplus = F.greatest(F.col("_free") - need[TRAIN] - need[VALIDATE] - need[TEST], F.lit(0))
    to_train = need[TRAIN] + surplus
    kind = F.when(F.col("_at") <= to_train, TRAIN).when(F.col("_at") <= to_train + need[VALIDATE], VALIDATE).otherwise(TEST)
    if users is not None:
        used = users.filter("is_used_for_train and list_id is not null").select(F.col("list_id").alias("user_id"), F.lit(True).alias("_used"))
        rows = rows.join(used, "user_id", "left")
    else:
        rows = rows.withColumn("_used", F.lit(True))
    assign = F.coalesce(F.col("_used"), F.lit(False)) & (F.col("_open") == 1)
    return rows.withColumn("dataset_type", F.when(assign, kind).otherwise(F.col("dataset_type")).cast("short")).select(*ratings.columns)


def quality(ratings: DataFrame, pcts: tuple[int, int, int] = (85, 10, 5)) -> DataFrame:
    """One row: sizes and shares of the sets, and whether each is within one point of its target with none unassigned."""
    of = lambda k: F.count_if(F.col("dataset_type") == k).cast("long")
    row = ratings.agg(of(UNASSIGNED).alias("n_unassigned"), of(TRAIN).alias("n_train"), of(VALIDATE).alias("n_validate"), of(TEST).alias("n_test"))
    total = F.col("n_train") + F.col("n_validate") + F.col("n_test")
    names = ("n_train", "n_validate", "n_test")
    pct = [(F.col(c) * 100).cast("double") / F.nullif(total, F.lit(0)) for c in names]
    near = (total > 0) & (F.col("n_unassigned") == 0)
    for p, goal in zip(pct, pcts):
        near = near & F.coalesce(F.abs(p - goal) <= 1, F.lit(False))
    return row.select("*", *[p.alias(f"pct_{c[2:]}") for p, c in zip(pct, names)], near.cast("int").alias("acceptable"))
