"""Engine tables derived from the star-schema tables of a directory, for queries and tests."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.split import resplit

TASK_ROWS = 500_000  # order lines that a task should get, about: with all steps by user some 250 MB


class Views:
    """Lazy views over ``<sf_dir>/<table>.parquet``; each names the columns it needs, so scans read no others."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def parts(self) -> int:
        """Tasks for a step over all order lines, by their number, which the files' footers tell."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_ROWS))

    @property
    def many(self) -> bool:
        return self.parts > self.spark.sparkContext.defaultParallelism

    @property
    def blocks(self) -> int | None:
        """Blocks of a side in MLlib's training; few ratings are left to its own number (10)."""
        return max(10, self.parts) if self.many else None

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` by hash of ``key`` for a join by it; few rows are left to Spark, which may broadcast them."""
        return df.repartition(self.parts, key) if self.many else df

    def raw(self) -> DataFrame:
        """user_id, item_id, rating, dataset_type 0: the best quantity of a part that a customer ordered, in steps of 10.

        One exchange by user after the join: the grouping and every per-user window that follows reuse it. Its number
        of tasks follows the number of rows: left to the session, tasks would grow with the input.
        """
        lines = self.dealt(self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity"), "l_orderkey")
        orders = self.dealt(self.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
        rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.select((F.col("o_custkey") + 1).cast("int").alias("user_id"), (F.col("l_partkey") + 1).cast("int").alias("item_id"), "l_quantity")
        rows = rows.repartition(self.parts, "user_id").groupBy("user_id", "item_id").agg(F.max("l_quantity").alias("q"))
        return rows.select("user_id", "item_id", F.ceil(F.col("q") / 10).cast("short").alias("rating"), F.lit(0).cast("short").alias("dataset_type"))

    def ratings(self) -> DataFrame:
        return resplit(self.raw())

    def mixed_ratings(self) -> DataFrame:
        """Ratings of which every fifth pair is unassigned and every 23rd is new."""
        s = F.col("user_id") + F.col("item_id")
        kind = F.when(s % 23 == 0, 4).when(s % 5 == 0, 0).otherwise(F.col("dataset_type"))
        return self.ratings().withColumn("dataset_type", kind.cast("short"))

    def users(self) -> DataFrame:
        lines, orders = self.dealt(self.table("lineitem").select("l_orderkey"), "l_orderkey"), self.dealt(self.table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
        rated = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select((F.col("o_custkey") + 1).cast("int").alias("_rated")).distinct()
        rows = self.table("customer").select((F.col("c_custkey") + 1).cast("int").alias("id"), F.col("c_name").alias("login"))
        rows = rows.join(rated, rows["id"] == rated["_rated"], "left")
        return rows.select("id", "login", F.col("_rated").alias("list_id"), (F.col("id") % 7 == 0).alias("are_ratings_modified"), (F.col("id") % 10 != 0).alias("is_used_for_train"))

    def items(self) -> DataFrame:
        rows = self.table("part").select((F.col("p_partkey") + 1).cast("int").alias("id"), F.col("p_name").alias("name"))
        return rows.withColumn("are_ratings_modified", F.col("id") % 11 == 0).withColumn("is_used_for_train", F.col("id") % 9 != 0)

    def n_items(self) -> DataFrame:
        return self.table("part").agg(F.count("*").cast("int").alias("n"))

    def extra(self) -> DataFrame:
        """Users with id % 3 = 0: two items they want no recommendation of."""
        n = self.n_items().first().n
        rows = self.table("customer").select((F.col("c_custkey") + 1).cast("int").alias("id")).filter("id % 3 = 0")
        return rows.select("id", F.array((1 + F.col("id") % n).cast("int"), (1 + (F.col("id").cast("long") * 7) % n).cast("int")).alias("unrated_items"), F.lit(None).cast("array<int>").alias("most_rated_items"))

    def changes(self) -> DataFrame:
        """Deletions, new values, and a row for every 50th user that matches no rating."""
        n = self.n_items().first().n
        r = self.raw()
        s = F.col("user_id") + F.col("item_id")
        rows = r.filter((s % 17 == 0) | (s % 19 == 0)).select("user_id", "item_id", F.when(s % 17 == 0, 0).otherwise(1 + F.col("rating") % 5).cast("short").alias("rating"))
        lone = self.table("customer").select((F.col("c_custkey") + 1).cast("int").alias("user_id")).filter("user_id % 50 = 0")
        return rows.unionByName(lone.select("user_id", F.lit(n + 1).cast("int").alias("item_id"), F.lit(3).cast("short").alias("rating")))

    def factors(self, ids: DataFrame) -> DataFrame:
        """Two factors an id that are whole sixteenths, so that sums of products are exact in any order."""
        f = [((F.col("id").cast("long") * (7 + 2 * k) + 3 * k) % 16 + 1).cast("double") / F.lit(16.0) for k in (0, 1)]
        return ids.select("id", f[0].alias("f0"), f[1].alias("f1"), F.array(*f).alias("features"))

    def user_factors(self) -> DataFrame:
        return self.factors(self.table("customer").select((F.col("c_custkey") + 1).cast("int").alias("id")))

    def item_factors(self) -> DataFrame:
        return self.factors(self.table("part").select((F.col("p_partkey") + 1).cast("int").alias("id")))


# The same views in SQL.
RAW = "raw AS (SELECT CAST(o_custkey + 1 AS INTEGER) user_id, CAST(l_partkey + 1 AS INTEGER) item_id, CAST(ceil(max(l_quantity) / 10) AS SMALLINT) rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
RATINGS = RAW + """, placed AS (SELECT user_id, item_id, rating, count(*) OVER (PARTITION BY user_id) n, row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws(':', user_id, item_id, 42)), item_id) rn FROM raw),
r AS (SELECT user_id, item_id, rating, CAST(CASE WHEN rn <= (n * 85 + 99) // 100 THEN 1 WHEN rn <= (n * 95 + 99) // 100 THEN 2 ELSE 3 END AS SMALLINT) dataset_type FROM placed)"""
MIXED = RATINGS + ", m AS (SELECT user_id, item_id, rating, CAST(CASE WHEN (user_id + item_id) % 23 = 0 THEN 4 WHEN (user_id + item_id) % 5 = 0 THEN 0 ELSE dataset_type END AS SMALLINT) dataset_type FROM r)"
USERS = "u AS (SELECT CAST(c_custkey + 1 AS INTEGER) id, c_name login, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) THEN CAST(c_custkey + 1 AS INTEGER) END list_id, (c_custkey + 1) % 7 = 0 are_ratings_modified, (c_custkey + 1) % 10 <> 0 is_used_for_train FROM customer)"
ITEMS = "i AS (SELECT CAST(p_partkey + 1 AS INTEGER) id, p_name AS name, (p_partkey + 1) % 11 = 0 are_ratings_modified, (p_partkey + 1) % 9 <> 0 is_used_for_train FROM part)"
EXTRA = "x AS (SELECT CAST(c_custkey + 1 AS INTEGER) id, [CAST(1 + (c_custkey + 1) % (SELECT count(*) FROM part) AS INTEGER), CAST(1 + ((c_custkey + 1) * 7) % (SELECT count(*) FROM part) AS INTEGER)] unrated_items FROM customer WHERE (c_custkey + 1) % 3 = 0)"
CHANGES = "c AS (SELECT user_id, item_id, CAST(CASE WHEN (user_id + item_id) % 17 = 0 THEN 0 ELSE 1 + rating % 5 END AS SMALLINT) rating FROM raw WHERE (user_id + item_id) % 17 = 0 OR (user_id + item_id) % 19 = 0 UNION ALL SELECT CAST(c_custkey + 1 AS INTEGER), CAST((SELECT count(*) FROM part) + 1 AS INTEGER), CAST(3 AS SMALLINT) FROM customer WHERE (c_custkey + 1) % 50 = 0)"
_F = "CAST((id * 7) % 16 + 1 AS DOUBLE) / CAST(16 AS DOUBLE) f0, CAST((id * 9 + 3) % 16 + 1 AS DOUBLE) / CAST(16 AS DOUBLE) f1"
FACTORS = f"uf AS (SELECT CAST(id AS INTEGER) id, {_F} FROM (SELECT c_custkey + 1 id FROM customer)), itf AS (SELECT CAST(id AS INTEGER) id, {_F} FROM (SELECT p_partkey + 1 id FROM part))"
