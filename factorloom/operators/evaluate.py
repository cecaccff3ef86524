"""Predictions and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..schema import ASSIGNED


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, shift: float | Column = 0.0) -> DataFrame:
    """``pairs`` (user_id, item_id, ...) with ``predict`` = dot of both factors + shift, for pairs that have both.

    ``users`` and ``items``: ``id, features``. Predictions aren't clamped to the scale.
    """
    u = users.select(F.col("id").alias("user_id"), F.col("features").alias("_u"))
    i = items.select(F.col("id").alias("item_id"), F.col("features").alias("_i"))
    rows = pairs.join(u, "user_id").join(i, "item_id")
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    return rows.select(*pairs.columns, (dot(F.col("_u"), F.col("_i")) + shift).alias("predict"))


def predict_biased(pairs: DataFrame, users: DataFrame, items: DataFrame, bias: float, check: bool = True) -> DataFrame:
    """Global bias + user's + item's + dot; a result that is no number raises: the learning rate was too large."""
    u = users.select(F.col("id").alias("user_id"), F.col("features").alias("_u"), F.col("bias").alias("_bu"))
    i = items.select(F.col("id").alias("item_id"), F.col("features").alias("_i"), F.col("bias").alias("_bi"))
    p = F.lit(float(bias)) + F.col("_bu") + F.col("_bi") + dot(F.col("_u"), F.col("_i"))
    rows = pairs.join(u, "user_id").join(i, "item_id").select(*pairs.columns, p.alias("predict"))
    if check:
        rows = rows.withColumn("predict", F.when(F.isnan("predict"), F.raise_error(F.lit("prediction is not a number: try a smaller learning rate")).cast("double")).otherwise(F.col("predict")))
    return rows


def rmse(predicted: DataFrame, dataset: int, shift: float | Column = 0.0) -> DataFrame:
    """One row: ``n, mean_predict, rmse`` of one set of ``predicted`` (rating, dataset_type, predict)."""
    shift = shift if isinstance(shift, Column) else F.lit(float(shift))
    rows = predicted.filter(F.col("dataset_type") == dataset).withColumn("_p", F.col("predict") + shift)
    e = F.col("_p") - F.col("rating")
    return rows.agg(F.count("*").alias("n"), F.avg("_p").alias("mean_predict"), F.sqrt(F.sum(e * e) / F.count("*")).alias("rmse"))


def global_shift(predicted: DataFrame, dataset: int) -> DataFrame:
    """One row: average rating of all assigned sets less the average prediction on one set."""
    means = predicted.agg(F.avg(F.when(F.col("dataset_type").isin(*ASSIGNED), F.col("rating"))).alias("r"), F.avg(F.when(F.col("dataset_type") == dataset, F.col("predict"))).alias("p"))
    return means.select((F.col("r") - F.col("p")).alias("shift"))


def shift_of(average: DataFrame, predicted: DataFrame, dataset: int) -> DataFrame:
    """``global_shift`` where only some sets were predicted: ``average`` is one row with ``avg_rating`` of all of them."""
    mean = predicted.filter(F.col("dataset_type") == dataset).agg(F.avg("predict").alias("p"))
    both = average.select(F.col("avg_rating").alias("r"), F.lit(None).cast("double").alias("p")).unionByName(mean.select(F.lit(None).cast("double").alias("r"), "p"))
    return both.agg((F.max("r") - F.max("p")).alias("shift"))
