"""Counts and averages of ratings, sizes of the model, and the key-value statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ASSIGNED


def per_key(ratings: DataFrame, key: str, sets: tuple[int, ...] = ASSIGNED) -> DataFrame:
    """``key, ratings_count, avg_rating`` over the given sets."""
    rows = ratings.filter(F.col("dataset_type").isin(*sets))
    return rows.groupBy(key).agg(F.count("*").alias("ratings_count"), F.avg("rating").alias("avg_rating"))


def totals(users: DataFrame, items: DataFrame) -> DataFrame:
    """One row: the largest internal ids (0 if none) and how many users and items a training uses."""
    u = users.select(F.col("list_id").alias("u"), (F.col("is_used_for_train") & F.col("list_id").isNotNull()).cast("int").alias("nu"), F.lit(None).cast("int").alias("i"), F.lit(0).alias("ni"))
    i = items.select(F.lit(None).cast("int").alias("u"), F.lit(0).alias("nu"), F.col("id").alias("i"), F.col("is_used_for_train").cast("int").alias("ni"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return u.unionAll(i).agg(zero(F.max("u")).cast("long").alias("max_user"), zero(F.max("i")).cast("long").alias("max_item"), zero(F.sum("nu")).cast("long").alias("used_users"), zero(F.sum("ni")).cast("long").alias("used_items"))


def extremes(ratings: DataFrame) -> DataFrame:
    """One row: most ratings of a user and of an item, and the numbers of ratings, users and items, over the assigned sets."""
    rows = ratings.filter(F.col("dataset_type").isin(*ASSIGNED))
    keys = rows.select(F.explode(F.array(F.struct(F.lit("u").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("i").alias("kind"), F.col("item_id").alias("id")))).alias("k"))
    counts = keys.groupBy("k.kind", "k.id").count()
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("count"))).cast("long")
    return counts.agg(of("u", F.max).alias("max_user_ratings"), of("i", F.max).alias("max_item_ratings"), of("u", F.sum).alias("n_ratings"), of("u", F.count).alias("n_users"), of("i", F.count).alias("n_items"))


def dataset_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("dataset_type").agg(F.count("*").alias("n"))


def global_avg(ratings: DataFrame) -> DataFrame:
    return ratings.filter(F.col("dataset_type").isin(*ASSIGNED)).agg(F.avg("rating").alias("avg_rating"), F.count("*").alias("n"))


def changed(table: DataFrame, key: str, fresh: DataFrame) -> DataFrame:
    """Rows of ``table`` (``key, ratings_count, avg_rating``) whose numbers differ from ``fresh``, averages at 6 decimals.

    Keys that ``fresh`` lacks keep their old numbers.
    """
    new = fresh.select(key, F.col("ratings_count").alias("new_count"), F.col("avg_rating").alias("new_avg"))
    joined = table.join(new, key)
    differs = ~F.col("ratings_count").eqNullSafe(F.col("new_count")) | ~F.round("avg_rating", 6).eqNullSafe(F.round("new_avg", 6))
    return joined.filter(differs).select(key, F.col("new_count").cast("long").alias("ratings_count"), F.col("new_avg").alias("avg_rating"))


def upsert_stats(stats: DataFrame, news: DataFrame) -> DataFrame:
    """``key, val`` with the values of ``news`` over those of ``stats``."""
    return stats.join(news.select("key"), "key", "left_anti").select("key", "val").unionByName(news.select("key", "val"))


def stat_values(stats: DataFrame) -> DataFrame:
    """``key, val, num``: values that look like numbers as doubles; a null value counts as 0."""
    return stats.select("key", "val", F.when(F.col("val").isNull(), F.lit(0.0)).otherwise(F.expr("try_cast(val as double)")).alias("num"))


def most_rated(ratings: DataFrame, max_rating: float) -> DataFrame:
    """Per user, the sorted items rated at 90 % of the scale or more."""
    top = ratings.filter(F.col("rating") >= max_rating * 0.9)
    return top.groupBy("user_id").agg(F.array_sort(F.collect_list("item_id")).alias("most_rated_items"))


def most_rated_updates(extra: DataFrame, fresh: DataFrame) -> DataFrame:
    """Users whose stored list differs from the fresh one, with the fresh one."""
    old = extra.select(F.col("id").alias("user_id"), F.col("most_rated_items").alias("_old"))
    return fresh.join(old, "user_id", "left").filter(~F.col("_old").eqNullSafe(F.col("most_rated_items"))).drop("_old")


def rated_csv(ratings: DataFrame) -> DataFrame:
    """Per user, the items of any rating in ascending order, joined by commas."""
    return ratings.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("rated_items"))


def dense_ids(first_seen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``id, list_id`` from ``id, pos long``: new ids numbered by first appearance after the largest known number."""
    from ..functions.ranking import global_row_number

    firsts = first_seen.groupBy("id").agg(F.min("pos").alias("pos"))
    start = 0
    if known is not None:
        firsts = firsts.join(known.select("id"), "id", "left_anti")
        start = known.agg(F.coalesce(F.max("list_id"), F.lit(0))).first()[0]
    out = global_row_number(firsts, F.floor(F.col("pos") / 65536), ["pos", "id"], "list_id")
    return out.select("id", (F.col("list_id") + start).cast("int").alias("list_id"))


