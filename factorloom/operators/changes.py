"""Change log, training flags and ratings that arrive during a training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NEW, UNASSIGNED


def apply_changes(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings after the log: 0 deletes, any other value replaces; changes that match no rating count for nothing."""
    log = changes.select("user_id", "item_id", F.col("rating").alias("_new"))
    out = ratings.join(log, ["user_id", "item_id"], "left").filter("_new is null or _new <> 0")
    return out.withColumn("rating", F.coalesce("_new", "rating")).select(*ratings.columns)


def deleted_by_changes(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """The ratings that the log deletes."""
    return ratings.join(changes.filter("rating = 0").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def promote_new(ratings: DataFrame) -> DataFrame:
    """Ratings that came during a training become unassigned ones."""
    return ratings.withColumn("dataset_type", F.when(F.col("dataset_type") == NEW, UNASSIGNED).otherwise(F.col("dataset_type")).cast("short"))


def fix_flags(users: DataFrame, items: DataFrame, everything: bool) -> tuple[DataFrame, DataFrame]:
    """Users (with an internal id) and items marked for the coming training, and their modified flags cleared.

    Either all of them, or those with modified ratings, to which the flags are cleared.
    """

    def fixed(df: DataFrame, able) -> DataFrame:
        chosen = able if everything else able & F.col("are_ratings_modified")
        return df.withColumn("is_used_for_train", F.when(chosen, True).otherwise(F.col("is_used_for_train"))).withColumn("are_ratings_modified", F.when(chosen, False).otherwise(F.col("are_ratings_modified")))

    return fixed(users, F.col("list_id").isNotNull()), fixed(items, F.lit(True))


def modified_counts(users: DataFrame, items: DataFrame) -> DataFrame:
    """One row: users with an internal id and items whose ratings were modified, and whether there are any."""
    u = users.filter("list_id is not null and are_ratings_modified").select(F.lit(1).alias("u"), F.lit(0).alias("i"))
    i = items.filter("are_ratings_modified").select(F.lit(0).alias("u"), F.lit(1).alias("i"))
    sums = u.unionAll(i).agg(F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("modified_users"), F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("modified_items"))
    return sums.withColumn("any_modified", (F.col("modified_users") + F.col("modified_items") > 0).cast("int"))


def fix_for_train(users: DataFrame, items: DataFrame, ratings: DataFrame, changes: DataFrame, everything: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, items, ratings) ready for a training; the log is empty afterwards."""
    return (*fix_flags(users, items, everything), promote_new(apply_changes(ratings, changes)))


def unfix_for_train(users: DataFrame, items: DataFrame, ratings: DataFrame, changes: DataFrame, everything: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, items, ratings) after a training: what came meanwhile is taken in; used flags go unless all are used."""
    clear = lambda df: df if everything else df.withColumn("is_used_for_train", F.lit(False))
    return clear(users), clear(items), promote_new(apply_changes(ratings, changes))
