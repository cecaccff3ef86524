"""The change log as a stream: each micro-batch of changes is applied to the stored ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import apply_changes
from ..sources.store import Store

PARTS = 64  # of the ratings, by user; a batch rewrites those of its users


def follow(store: Store, stream: DataFrame, checkpoint: str, parts: int = PARTS, **trigger) -> StreamingQuery:
    """Start applying ``stream`` (user_id, item_id, rating, seq) to the ratings; of a pair, the highest seq of a batch counts.

    Applying a batch twice has the same result as once, so that a replay after a failure does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("user_id", "item_id").agg(F.max_by("rating", "seq").alias("rating"))
        store.change("ratings", "user_id", last, apply_changes, parts)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
