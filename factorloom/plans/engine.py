"""The engine: ingest, train, evaluate, store and recommend over one store of tables and models."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import als, changes, evaluate, recommend, scans, sgd, split, stats
from ..schema import TEST, UNASSIGNED, VALIDATE, Options
from ..sources import movielens, scratch
from ..sources.store import Store, can_reuse


class Engine:
    """Status goes "" -> ready -> preparing -> training -> ready, and "destroyed" at the end."""

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.options, self.store = spark, options or Options(), Store(spark, root)
        self.options.scale  # an unknown scale is an error at the start
        self.status = "ready"
        self._scratch = f"{self._shared()}/factorloom-engine-{uuid.uuid4().hex}"

    def _shared(self) -> str:
        place = self.spark.conf.get("spark.checkpoint.dir", None)
        if place:
            return place.rstrip("/")
        if not self.spark.sparkContext.master.startswith("local[") and self.spark.sparkContext.master != "local":
            return f"{self.store.root}/scratch"
        return "file://" + tempfile.mkdtemp(prefix="factorloom-")

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        return scratch.write(df, f"{self._scratch}/{name}-{uuid.uuid4().hex}")

    def _drop_scratch(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._scratch)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # ingest

    def import_movielens(self, kind: str, path: str) -> dict[str, int]:
        """Replace all data by a MovieLens data set (``100k`` or ``1m``) found under ``path``."""
        users, items, ratings = movielens.read(self.spark, movielens.local_folder(path, kind), kind)
        self.wipe()
        flags = lambda df: df.withColumn("are_ratings_modified", F.lit(True)).withColumn("is_used_for_train", F.lit(False)).withColumn("ratings_count", F.lit(0)).withColumn("avg_rating", F.lit(0.0))
        saved = (self.store.save("users", flags(users)), self.store.save("items", flags(items)), self.store.save("ratings", ratings))
        return movielens.counts(*saved).first().asDict()

    def add_ratings(self, news: DataFrame) -> None:
        """Append ``id, item_id, rating`` (external user ids); a pair that exists is an error. First-time users get list ids."""
        users, ratings = self.store.load("users"), self.store.load("ratings")
        rows = news.select("id", "item_id", F.col("rating").cast("short").alias("rating"), F.monotonically_increasing_id().alias("pos"))
        known = users.filter("list_id is not null").select("id", "list_id")
        ids = known.unionByName(stats.dense_ids(rows, known))
        rows = rows.join(ids, "id").select(F.col("list_id").alias("user_id"), "item_id", "rating", F.lit(4 if self.status == "training" else UNASSIGNED).cast("short").alias("dataset_type"), "id")
        if rows.join(ratings, ["user_id", "item_id"], "left_semi").limit(1).count() or rows.groupBy("user_id", "item_id").count().filter("count > 1").limit(1).count():
            raise ValueError("a rating of that user and item exists")
        touched = rows.select("id").distinct().withColumn("_t", F.lit(True))
        rows = self._save(rows, "new")
        users = users.drop("list_id").join(ids, "id", "left").join(touched, "id", "left").withColumn("are_ratings_modified", F.coalesce("_t", "are_ratings_modified")).drop("_t")
        items = self.store.load("items").join(rows.select(F.col("item_id").alias("id"), F.lit(True).alias("_t")).distinct(), "id", "left").withColumn("are_ratings_modified", F.coalesce("_t", "are_ratings_modified")).drop("_t")
        users, items = self._save(users, "users"), self._save(items, "items")
        self.store.save("ratings", ratings.unionByName(rows.drop("id")))
        self.store.save("users", users)
        self.store.save("items", items)

    def wipe(self) -> None:
        """Delete all tables and models."""
        self.store.wipe()

    # statistics

    def set_stat(self, key: str, value: Any) -> None:
        news = self.spark.createDataFrame([(key, None if value is None else str(value))], "key string, val string")
        self.store.save("stats", stats.upsert_stats(self.store.load("stats"), news))

    def get_stat(self, key: str) -> float | str | None:
        row = stats.stat_values(self.store.load("stats").filter(F.col("key") == key)).first()
        return None if row is None else row["num"] if row["num"] is not None else row["val"]

    # training

    def can_train(self) -> str | None:
        """Why no training can start now, or None."""
        if self.status == "ready":
            return None
        return "already training" if self.status in ("preparing", "training") else f"status is {self.status}"

    def train(self) -> dict[str, Any]:
        """Fix the data, split, train, evaluate and publish a model; returns its description with the errors per set."""
        if reason := self.can_train():
            raise RuntimeError(reason)
        self.status = "preparing"
        try:
            return self._train()
        finally:
            if self.status != "destroyed":
                self.status = "ready"
            self._drop_scratch()

    def _train(self) -> dict[str, Any]:
        o, store, spark = self.options, self.store, self.spark
        empty = spark.createDataFrame([], "user_id int, item_id int, rating short")
        users, items, ratings = changes.fix_for_train(store.load("users"), store.load("items"), store.load("ratings"), store.load("ratings_changes"), o.train_all)
        users, items, ratings = self._save(users, "u"), self._save(items, "i"), self._save(ratings, "r")
        store.save("ratings_changes", empty)
        size = stats.totals(users, items).first()
        if not size.used_users and not size.used_items:
            raise ValueError("no_data")
        info = store.model_info() or {}
        if info and tuple(info.get("split", ())) != o.split:  # other percentages: all assignments are made anew
            ratings = self._save(split.resplit(ratings, o.split, o.seed), "split")
        elif not split.quality(ratings, o.split).first().acceptable:
            ratings = self._save(split.incremental(ratings, users, o.split, o.seed), "split")
        users = self._refresh(users, "list_id", stats.per_key(ratings, "user_id"), "user_id")
        items = self._refresh(items, "id", stats.per_key(ratings, "item_id"), "item_id")
        store.save("ratings", ratings)
        users, items = store.save("users", users), store.save("items", items)
        if self.status != "destroyed":
            self.status = "training"
        fitted = scans.by_side(ratings, users.select(F.col("list_id").alias("user_id"), "is_used_for_train"), "user_id", o.train_sets)
        bias, shift, result = 0.0, 0.0, {}
        asked = ratings.filter(F.col("dataset_type").isin(VALIDATE, TEST))  # no measure looks at the others' predictions
        if o.alg == "als":
            old = store.load_model() if can_reuse(info, o.alg, o.db_type, o.rank, o.double_precision) else None
            if old is None and o.user_reg == o.item_reg and not o.first_factor_is_avg:
                uf, itf = als.train_mllib(fitted, o.rank, o.iterations, o.user_reg, o.seed, place=self._scratch)
            else:
                uf, itf = als.train_own(spark, fitted, o.rank, o.iterations, o.user_reg, o.item_reg, self._save, o.seed, old[:2] if old else None, o.first_factor_is_avg)
            predicted = evaluate.predict(asked, uf, itf)
        else:
            uf, itf, bias = sgd.train(spark, fitted, o.rank, o.iterations, o.learning_rate, o.sgd_regs, self._save, None, o.sgd_blocks, o.seed)
            predicted = evaluate.predict_biased(asked, uf, itf, bias)
        predicted = self._save(predicted, "predicted")
        if o.split[1]:
            result["rmse_validate"] = evaluate.rmse(predicted, VALIDATE).first().rmse
        if o.split[2]:
            result["rmse_test"] = evaluate.rmse(predicted, TEST).first().rmse
            if o.alg == "als":
                shift = evaluate.shift_of(stats.global_avg(ratings), predicted, TEST).first().shift or 0.0
                result["rmse_test_shifted"] = evaluate.rmse(predicted, TEST, shift).first().rmse
        result |= {"alg": o.alg, "db_type": o.db_type, "rank": o.rank, "double_precision": o.double_precision, "split": list(o.split), "iterations": o.iterations, "users": size.max_user, "items": size.max_item, "calc_count": int(info.get("calc_count", 0)) + 1, "calc_date": datetime.datetime.now(datetime.UTC).isoformat(), "global_shift": shift, "global_bias": bias}
        if not o.double_precision:
            single = lambda df: df.withColumn("features", F.col("features").cast("array<float>"))
            uf, itf = single(uf), single(itf)
        store.save_model(uf, itf, result)
        out = changes.unfix_for_train(users, items, store.load("ratings"), store.load("ratings_changes"), o.train_all)
        for name, df in zip(("users", "items", "ratings"), [self._save(df, "after") for df in out]):
            store.save(name, df)
        return result

    @staticmethod
    def _refresh(table: DataFrame, key: str, fresh: DataFrame, fresh_key: str) -> DataFrame:
        new = fresh.select(F.col(fresh_key).alias("_k"), F.col("ratings_count").cast("int").alias("_n"), F.col("avg_rating").alias("_a"))
        out = table.join(new, table[key] == new["_k"], "left")
        return out.withColumn("ratings_count", F.coalesce("_n", "ratings_count")).withColumn("avg_rating", F.coalesce("_a", "avg_rating")).drop("_k", "_n", "_a")

    # serving

    def can_predict(self) -> str | None:
        """Why no prediction can be made now, or None: the status must be ready, and there must be a model."""
        if self.status != "ready":
            return f"status is {self.status}"
        return None if self.store.model_info() else "no model"

    def predict(self, user_id: int, item_id: int) -> float | None:
        """The predicted rating of a pair of internal ids, or None if either has no factors."""
        if reason := self.can_predict():
            raise RuntimeError(reason)
        users, items, info = self.store.load_model()
        u, i = scans.factor_row(users, user_id).first(), scans.factor_row(items, item_id).first()
        if u is None or i is None:
            return None
        value = sum(float(x) * float(y) for x, y in zip(u.features, i.features))
        return value + (info["global_shift"] if info["alg"] == "als" else info["global_bias"] + u.bias + i.bias)

    def recommend(self, login: str | None = None, user_id: int | None = None, limit: int | None = None) -> list[dict[str, Any]]:
        """The best items for a user, by login or external id, as [{"predict": .., "id": ..}]; KeyError if there is no such user.

        A user who never rated, or who came after the model, gets an empty list.
        """
        if reason := self.can_predict():
            raise RuntimeError(reason)
        extra = self.store.load("users_extra")
        user = scans.lookup_user(self.store.load("users"), extra, login, user_id).first()
        if user is None:
            raise KeyError("User not found")
        if user.list_id is None:
            return []
        users, items, info = self.store.load_model()
        mine, shift = scans.factor_row(users, user.list_id), info["global_shift"]
        if info["alg"] != "als":  # biases as two more factors
            one = F.array(F.lit(1.0))
            mine = mine.withColumn("features", F.concat(F.col("features").cast("array<double>"), F.array(F.col("bias").cast("double")), one))
            items = items.withColumn("features", F.concat(F.col("features").cast("array<double>"), one, F.array(F.col("bias").cast("double"))))
            shift = info["global_bias"]
        gone = self.store.load("ratings").filter(F.col("user_id") == user.list_id).select("user_id", "item_id")
        unwanted = extra.filter(F.col("id") == user.id).select(F.lit(user.list_id).cast("int").alias("user_id"), F.explode("unrated_items").alias("item_id"))
        gone = gone.unionByName(unwanted)
        best = recommend.top_n(self.spark, mine, items, recommend.exclusions(gone), self.options.scale[1], limit or self.options.limit, shift)
        return [{"predict": r.predict, "id": r.item_id} for r in best.orderBy("rank").collect()]

    def update_most_rated(self) -> DataFrame:
        """Refresh each user's list of best rated items and, where it changed, its time; returns the rows that changed."""
        extra = self.store.load("users_extra")
        lists = stats.most_rated(self.store.load("ratings"), self.options.scale[0])
        ids = self.store.load("users").filter("list_id is not null").select(F.col("id").alias("_id"), F.col("list_id").alias("user_id"))
        lists = lists.join(ids, "user_id").select(F.col("_id").alias("user_id"), "most_rated_items")  # by external id, as users_extra is
        fresh = self._save(stats.most_rated_updates(extra, lists), "most")
        new = fresh.select(F.col("user_id").alias("id"), F.col("most_rated_items").alias("_new"))
        out = extra.join(new, "id", "full").withColumn("most_rated_items", F.coalesce("_new", "most_rated_items")).drop("_new")
        users = self.store.load("users")
        if "most_rated_items_update_ts" not in users.columns:
            users = users.withColumn("most_rated_items_update_ts", F.lit(None).cast("timestamp_ntz"))
        users = users.join(new.select("id", F.lit(True).alias("_changed")), "id", "left")
        users = users.withColumn("most_rated_items_update_ts", F.when(F.col("_changed"), F.localtimestamp()).otherwise(F.col("most_rated_items_update_ts"))).drop("_changed")
        users, out = self._save(users, "users"), self._save(out, "extra")
        self.store.save("users_extra", out)
        self.store.save("users", users)
        return fresh

    def version(self) -> str:
        """That the session answers: the version of Spark."""
        return self.spark.sql("select version()").first()[0]

    def gather(self) -> str:
        """Workers join and leave through Spark's master: there is nothing to do."""
        return "ok"

    def destroy(self) -> None:
        self.status = "destroyed"
