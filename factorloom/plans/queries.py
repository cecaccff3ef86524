"""The engine's operators as named queries over a directory of tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import als, changes, evaluate, recommend, scans, sgd, split, stats
from ..schema import TEST, VALIDATE
from ..sources import movielens, scratch
from . import fixtures as fx
from .fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _root(v: Views) -> str:
    """A fresh path in the shared folder, or in a local one in a plain local session."""
    place = v.spark.conf.get("spark.checkpoint.dir", None)
    master = v.spark.sparkContext.master
    if not place and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(place or 'file://' + tempfile.mkdtemp(prefix='factorloom-')).rstrip('/')}/factorloom-{uuid.uuid4().hex}"


def _saver(v: Views):
    """Write and reread under a fresh path."""
    root = _root(v)

    def save(df: DataFrame, name: str) -> DataFrame:
        return scratch.write(df, f"{root}/{name}-{uuid.uuid4().hex}")

    return save


# statistics


@_query(f"WITH {fx.USERS}, {fx.ITEMS} SELECT (SELECT CAST(max(list_id) AS BIGINT) FROM u) max_user, (SELECT CAST(max(id) AS BIGINT) FROM i) max_item, (SELECT count(*) FROM u WHERE is_used_for_train AND list_id IS NOT NULL) used_users, (SELECT count(*) FROM i WHERE is_used_for_train) used_items")
def totals(v: Views) -> DataFrame:
    return stats.totals(v.users(), v.items())


@_query(f"WITH {fx.RATINGS} SELECT user_id, count(*) ratings_count, avg(rating) avg_rating FROM r WHERE dataset_type IN (1, 2, 3) GROUP BY 1")
def user_stats(v: Views) -> DataFrame:
    return stats.per_key(v.ratings(), "user_id")


@_query(f"WITH {fx.RATINGS} SELECT item_id, count(*) ratings_count, avg(rating) avg_rating FROM r WHERE dataset_type IN (1, 2, 3) GROUP BY 1")
def item_stats(v: Views) -> DataFrame:
    return stats.per_key(v.ratings(), "item_id")


@_query(f"WITH {fx.RATINGS} SELECT user_id, count(*) ratings_count, avg(rating) avg_rating FROM r WHERE dataset_type IN (1, 2) GROUP BY 1")
def user_stats_train(v: Views) -> DataFrame:
    return stats.per_key(v.ratings(), "user_id", (1, 2))


@_query(f"WITH {fx.RATINGS}, a AS (SELECT count(*) n FROM r GROUP BY user_id), b AS (SELECT count(*) n FROM r GROUP BY item_id) SELECT (SELECT max(n) FROM a) max_user_ratings, (SELECT max(n) FROM b) max_item_ratings, (SELECT CAST(sum(n) AS BIGINT) FROM a) n_ratings, (SELECT count(*) FROM a) n_users, (SELECT count(*) FROM b) n_items")
def rating_extremes(v: Views) -> DataFrame:
    return stats.extremes(v.ratings())


@_query(f"WITH {fx.MIXED} SELECT dataset_type, count(*) n FROM m GROUP BY 1")
def dataset_counts(v: Views) -> DataFrame:
    return stats.dataset_counts(v.mixed_ratings())


@_query(f"WITH {fx.MIXED} SELECT avg(rating) avg_rating, count(*) n FROM m WHERE dataset_type IN (1, 2, 3)")
def global_avg(v: Views) -> DataFrame:
    return stats.global_avg(v.mixed_ratings())


def _stored(v: Views, key: str) -> DataFrame:
    """Numbers of an earlier state: right for odd ids, off by a little or a lot for the others."""
    fresh = stats.per_key(v.ratings(), key)
    off = F.when(F.col(key) % 4 == 0, 1).otherwise(0)
    return fresh.select(key, (F.col("ratings_count") + off).alias("ratings_count"), (F.col("avg_rating") + F.when(F.col(key) % 4 == 2, F.lit(0.25)).when(F.col(key) % 2 == 1, F.lit(1e-9)).otherwise(F.lit(0.0))).alias("avg_rating"))


_CHANGED = "WITH {r}, f AS (SELECT {k}, count(*) n, avg(rating) a FROM r GROUP BY 1) SELECT {k}, n ratings_count, a avg_rating FROM f WHERE {k} % 2 = 0"


@_query(_CHANGED.format(r=fx.RATINGS, k="user_id"))
def stats_changed_users(v: Views) -> DataFrame:
    return stats.changed(_stored(v, "user_id"), "user_id", stats.per_key(v.ratings(), "user_id"))


@_query(_CHANGED.format(r=fx.RATINGS, k="item_id"))
def stats_changed_items(v: Views) -> DataFrame:
    return stats.changed(_stored(v, "item_id"), "item_id", stats.per_key(v.ratings(), "item_id"))


@_query("SELECT key, val, CASE WHEN val IS NULL THEN CAST(0 AS DOUBLE) ELSE try_cast(val AS DOUBLE) END num FROM (SELECT n_name AS key, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey * 10 + 5 AS VARCHAR) ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE CAST(n_nationkey AS VARCHAR) END END val FROM nation)")
def stats_kv(v: Views) -> DataFrame:
    n = v.table("nation")
    old = n.select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise(F.col("n_nationkey").cast("string")).alias("val"))
    news = n.filter("n_nationkey % 2 = 0 or n_nationkey % 5 = 0").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 5 == 0, None).otherwise((F.col("n_regionkey") * 10 + 5).cast("string")).alias("val"))
    return stats.stat_values(stats.upsert_stats(old, news))


@_query(f"WITH {fx.RATINGS} SELECT user_id, array_to_string(list(item_id ORDER BY item_id), ',') most_rated FROM r WHERE rating >= 4.5 GROUP BY 1")
def most_rated_items(v: Views) -> DataFrame:
    return stats.most_rated(v.ratings(), 5.0).select("user_id", F.array_join(F.transform("most_rated_items", lambda x: x.cast("string")), ",").alias("most_rated"))


@_query(f"WITH {fx.RAW} SELECT user_id, array_to_string(list(item_id ORDER BY item_id), ',') rated_items FROM raw GROUP BY 1")
def rated_items_csv(v: Views) -> DataFrame:
    return stats.rated_csv(v.raw())


@_query("WITH s AS (SELECT CAST(o_custkey + 1 AS INTEGER) id, min(CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT id, CAST(row_number() OVER (ORDER BY pos, id) AS INTEGER) list_id FROM s")
def dense_user_ids(v: Views) -> DataFrame:
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber").join(v.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return stats.dense_ids(rows.select((F.col("o_custkey") + 1).cast("int").alias("id"), (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("pos")))


# split


@_query(f"WITH {fx.RATINGS} SELECT user_id, item_id, rating, dataset_type FROM r")
def split_resplit(v: Views) -> DataFrame:
    return v.ratings()


@_query(f"WITH {fx.MIXED} SELECT user_id, array_to_string(list(item_id ORDER BY item_id) FILTER (WHERE dataset_type = 0), ',') free_items, count(*) FILTER (WHERE dataset_type = 1) n_train, count(*) FILTER (WHERE dataset_type = 2) n_validate, count(*) FILTER (WHERE dataset_type = 3) n_test FROM m WHERE dataset_type <> 4 GROUP BY 1")
def split_profile(v: Views) -> DataFrame:
    free = F.when(F.size("free_items") > 0, F.array_join(F.transform("free_items", lambda x: x.cast("string")), ","))
    return split.profile(v.mixed_ratings()).withColumn("free_items", free)


_INCREMENTAL = f"""WITH {fx.MIXED}, {fx.USERS}, p AS (SELECT m.*, count(*) FILTER (WHERE dataset_type <> 4) OVER w n, count(*) FILTER (WHERE dataset_type = 0) OVER w free, count(*) FILTER (WHERE dataset_type = 1) OVER w h1, count(*) FILTER (WHERE dataset_type = 2) OVER w h2, count(*) FILTER (WHERE dataset_type = 3) OVER w h3,
row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN dataset_type = 0 THEN 0 ELSE 1 END, md5(concat_ws(':', user_id, item_id, 42)), item_id) rn FROM m WINDOW w AS (PARTITION BY user_id)),
t AS (SELECT *, (n * 85 + 99) // 100 g1, (n * 95 + 99) // 100 g12 FROM p),
q AS (SELECT *, greatest(g1 - h1, 0) n1, greatest(g12 - g1 - h2, 0) n2, greatest(n - g12 - h3, 0) n3 FROM t),
k AS (SELECT *, n1 + greatest(free - n1 - n2 - n3, 0) c1 FROM q)
SELECT user_id, item_id, rating, CAST(CASE WHEN dataset_type <> 0 OR user_id NOT IN (SELECT list_id FROM u WHERE is_used_for_train AND list_id IS NOT NULL) THEN dataset_type WHEN rn <= c1 THEN 1 WHEN rn <= c1 + n2 THEN 2 ELSE 3 END AS SMALLINT) dataset_type FROM k"""


@_query(_INCREMENTAL)
def split_incremental(v: Views) -> DataFrame:
    return split.incremental(v.mixed_ratings(), v.users())


@_query(f"WITH {fx.RATINGS}, s AS (SELECT count(*) FILTER (WHERE dataset_type = 0) n_unassigned, count(*) FILTER (WHERE dataset_type = 1) n_train, count(*) FILTER (WHERE dataset_type = 2) n_validate, count(*) FILTER (WHERE dataset_type = 3) n_test FROM r), p AS (SELECT *, CAST(n_train * 100 AS DOUBLE) / (n_train + n_validate + n_test) pct_train, CAST(n_validate * 100 AS DOUBLE) / (n_train + n_validate + n_test) pct_validate, CAST(n_test * 100 AS DOUBLE) / (n_train + n_validate + n_test) pct_test FROM s) SELECT *, CASE WHEN n_unassigned = 0 AND abs(pct_train - 85) <= 1 AND abs(pct_validate - 10) <= 1 AND abs(pct_test - 5) <= 1 THEN 1 ELSE 0 END acceptable FROM p")
def split_quality(v: Views) -> DataFrame:
    return split.quality(v.ratings())


# change log


@_query(f"WITH {fx.RATINGS}, {fx.CHANGES} SELECT r.user_id, r.item_id, coalesce(c.rating, r.rating) rating, r.dataset_type FROM r LEFT JOIN c ON r.user_id = c.user_id AND r.item_id = c.item_id WHERE c.rating IS NULL OR c.rating <> 0")
def apply_changes(v: Views) -> DataFrame:
    return changes.apply_changes(v.ratings(), v.changes())


@_query(f"WITH {fx.RATINGS}, {fx.CHANGES} SELECT r.* FROM r JOIN c ON r.user_id = c.user_id AND r.item_id = c.item_id WHERE c.rating = 0")
def apply_changes_deleted(v: Views) -> DataFrame:
    return changes.deleted_by_changes(v.ratings(), v.changes())


@_query(f"WITH {fx.MIXED} SELECT user_id, item_id, rating, CAST(CASE WHEN dataset_type = 4 THEN 0 ELSE dataset_type END AS SMALLINT) dataset_type FROM m")
def promote_new(v: Views) -> DataFrame:
    return changes.promote_new(v.mixed_ratings())


def _flags(v: Views, everything: bool) -> DataFrame:
    users, items = changes.fix_flags(v.users(), v.items(), everything)
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "is_used_for_train", "are_ratings_modified")
    return one(users, "user").unionByName(one(items, "item"))


@_query(f"WITH {fx.USERS}, {fx.ITEMS} SELECT 'user' kind, id, CASE WHEN list_id IS NOT NULL THEN true ELSE is_used_for_train END is_used_for_train, CASE WHEN list_id IS NOT NULL THEN false ELSE are_ratings_modified END are_ratings_modified FROM u UNION ALL SELECT 'item', id, true, false FROM i")
def fix_for_train_all(v: Views) -> DataFrame:
    return _flags(v, True)


@_query(f"WITH {fx.USERS}, {fx.ITEMS} SELECT 'user' kind, id, (list_id IS NOT NULL AND are_ratings_modified) OR is_used_for_train is_used_for_train, are_ratings_modified AND list_id IS NULL are_ratings_modified FROM u UNION ALL SELECT 'item', id, are_ratings_modified OR is_used_for_train, false FROM i")
def fix_for_train_modified(v: Views) -> DataFrame:
    return _flags(v, False)


@_query(f"WITH {fx.USERS}, {fx.ITEMS} SELECT 'user' kind, id, false is_used_for_train, are_ratings_modified FROM u UNION ALL SELECT 'item', id, false, are_ratings_modified FROM i")
def unfix_for_train(v: Views) -> DataFrame:
    users, items, _ = changes.unfix_for_train(v.users(), v.items(), v.raw(), v.changes(), False)
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "is_used_for_train", "are_ratings_modified")
    return one(users, "user").unionByName(one(items, "item"))


@_query(f"WITH {fx.USERS}, {fx.ITEMS}, s AS (SELECT (SELECT count(*) FROM u WHERE list_id IS NOT NULL AND are_ratings_modified) modified_users, (SELECT count(*) FROM i WHERE are_ratings_modified) modified_items) SELECT *, CASE WHEN modified_users + modified_items > 0 THEN 1 ELSE 0 END any_modified FROM s")
def modified_counts(v: Views) -> DataFrame:
    return changes.modified_counts(v.users(), v.items())


# scans


@_query(f"WITH {fx.USERS}, {fx.EXTRA} SELECT u.id, rtrim(login) login, list_id, array_to_string(unrated_items, ',') unrated FROM u LEFT JOIN x ON u.id = x.id")
def user_lookup(v: Views) -> DataFrame:
    rows = scans.lookup_user(v.users(), v.extra())
    return rows.select("id", "login", "list_id", F.array_join(F.transform("unrated_items", lambda x: x.cast("string")), ",").alias("unrated"))


@_query(f"WITH {fx.RATINGS}, {fx.USERS} SELECT user_id, item_id, rating FROM r WHERE dataset_type IN (1, 2) AND user_id IN (SELECT list_id FROM u WHERE is_used_for_train) AND user_id > 100 AND user_id <= 900")
def portion_scan_user(v: Views) -> DataFrame:
    side = v.users().filter("list_id is not null").select(F.col("list_id").alias("user_id"), "is_used_for_train")
    return scans.by_side(v.ratings(), side, "user_id", above=100, to=900)


@_query(f"WITH {fx.RATINGS}, {fx.ITEMS} SELECT user_id, item_id, rating FROM r WHERE dataset_type IN (1, 2) AND item_id IN (SELECT id FROM i WHERE is_used_for_train) AND item_id > 100 AND item_id <= 900")
def portion_scan_item(v: Views) -> DataFrame:
    side = v.items().select(F.col("id").alias("item_id"), "is_used_for_train")
    return scans.by_side(v.ratings(), side, "item_id", above=100, to=900)


@_query(f"WITH {fx.RATINGS} SELECT user_id, item_id, rating, md5(concat_ws(':', user_id, item_id, 45)) shuffled FROM r WHERE dataset_type IN (1, 2)")
def sgd_order(v: Views) -> DataFrame:
    return scans.sgd_order(v.ratings(), 3)


@_query(f"WITH {fx.RATINGS}, o AS (SELECT user_id, item_id, rating, row_number() OVER (ORDER BY md5(concat_ws(':', user_id, item_id, 45)), user_id, item_id) AS position FROM r WHERE dataset_type IN (1, 2)) SELECT position, user_id, item_id, rating FROM o WHERE position > 2000 AND position <= 3000")
def sgd_page(v: Views) -> DataFrame:
    return scans.sgd_page(v.ratings(), 3, 2, 1000, parts=v.parts)


@_query(f"""WITH RECURSIVE {fx.RATINGS}, s AS (SELECT user_id id, count(*) n, row_number() OVER (ORDER BY user_id) k FROM r GROUP BY 1),
cap AS (SELECT greatest(CASE WHEN sum(n) < 10000 * 8 THEN CAST(ceil(sum(n) / 8) AS BIGINT) ELSE 10000 END, max(n)) c FROM s),
w AS (SELECT k, id, n, CAST(0 AS BIGINT) portion, CAST(n AS BIGINT) total FROM s WHERE k = 1 UNION ALL SELECT s.k, s.id, s.n, CASE WHEN w.total + s.n > c THEN w.portion + 1 ELSE w.portion END, CASE WHEN w.total + s.n > c THEN s.n ELSE w.total + s.n END FROM w JOIN s ON s.k = w.k + 1, cap)
SELECT portion, CAST(max(id) AS BIGINT) id_to, count(*) n_rows, CAST(sum(n) AS BIGINT) n_ratings FROM w GROUP BY 1""")
def portion_packing(v: Views) -> DataFrame:
    return scans.portions(stats.per_key(v.ratings(), "user_id"), "user_id", 10_000, 8)


# model


@_query(f"WITH {fx.FACTORS} SELECT id, f0, f1 FROM itf WHERE id = 77")
def factor_row_lookup(v: Views) -> DataFrame:
    return scans.factor_row(v.item_factors(), 77).select("id", "f0", "f1")


_PREDICTED = f"WITH {fx.RATINGS}, {fx.FACTORS}, p AS (SELECT user_id, item_id, rating, dataset_type, uf.f0 * itf.f0 + uf.f1 * itf.f1 AS predict FROM r JOIN uf ON uf.id = user_id JOIN itf ON itf.id = item_id)"


def _sides(v: Views) -> tuple[DataFrame, DataFrame]:
    """Factors of both sides; dealt by item too, so that the join by item has as many tasks as the one by user."""
    return v.user_factors(), v.dealt(v.item_factors(), "id")


def _predicted(v: Views) -> DataFrame:
    return evaluate.predict(v.ratings(), *_sides(v))


@_query(f"{_PREDICTED} SELECT user_id, item_id, predict + CAST(0.5 AS DOUBLE) AS predict FROM p")
def predict_als(v: Views) -> DataFrame:
    return evaluate.predict(v.ratings().select("user_id", "item_id"), *_sides(v), 0.5)


@_query(f"{_PREDICTED} SELECT user_id, item_id, CAST(2.5 AS DOUBLE) + CAST(user_id % 8 AS DOUBLE) / 8 + CAST(item_id % 4 AS DOUBLE) / 8 + predict AS predict FROM p")
def predict_sgd(v: Views) -> DataFrame:
    bias = lambda df, m: df.withColumn("bias", (F.col("id") % m).cast("double") / 8)
    users, items = _sides(v)
    return evaluate.predict_biased(v.ratings().select("user_id", "item_id"), bias(users, 8), bias(items, 4), 2.5)


_RMSE = "SELECT count(*) n, avg({p}) mean_predict, sqrt(sum(({p} - rating) * ({p} - rating)) / count(*)) rmse FROM p WHERE dataset_type = {k}"


@_query(f"{_PREDICTED} {_RMSE.format(p='predict', k=2)}")
def rmse_validate(v: Views) -> DataFrame:
    return evaluate.rmse(_predicted(v), VALIDATE)


@_query(f"{_PREDICTED} {_RMSE.format(p='predict', k=3)}")
def rmse_test(v: Views) -> DataFrame:
    return evaluate.rmse(_predicted(v), TEST)


@_query(f"{_PREDICTED} SELECT (SELECT avg(rating) FROM p) - (SELECT avg(predict) FROM p WHERE dataset_type = 3) shift")
def global_avg_shift(v: Views) -> DataFrame:
    return evaluate.global_shift(_predicted(v), TEST)


@_query(f"{_PREDICTED} {_RMSE.format(p='(predict + CAST(1.75 AS DOUBLE))', k=3)}")
def rmse_test_shifted(v: Views) -> DataFrame:
    return evaluate.rmse(_predicted(v), TEST, 1.75)


_STEP = "WITH {r}, {f}, s AS (SELECT {k} id, CAST(count(*) AS DOUBLE) / 16 d, sum(f0 * f0) aa, sum(f0 * f1) ab, sum(f1 * f1) bb, sum(f0 * rating) ar, sum(f1 * rating) br FROM r JOIN {o} ON {o}.id = {j} WHERE dataset_type IN (1, 2) GROUP BY 1) SELECT id, round((ar * (bb + d) - ab * br) / ((aa + d) * (bb + d) - ab * ab), 6) f0, round(((aa + d) * br - ab * ar) / ((aa + d) * (bb + d) - ab * ab), 6) f1 FROM s"


def _step(v: Views, key: str, other: str, fixed: DataFrame) -> DataFrame:
    """The half-step that trainings run, at rank 2; a row of more than 50 ratings is summed in pieces."""
    save = _saver(v)
    ratings = save(v.ratings().filter("dataset_type in (1, 2)").select("user_id", "item_id", "rating"), "ratings")
    plan = als.layout(ratings, key, other, 2, save, hot=50)
    out = als.half_step(plan, fixed.select("id", "features"), 1 / 16)
    return out.select("id", *[F.round(F.element_at("features", k + 1), 6).alias(f"f{k}") for k in (0, 1)])


@_query(_STEP.format(r=fx.RATINGS, f=fx.FACTORS, k="user_id", o="itf", j="item_id"))
def als_user_step(v: Views) -> DataFrame:
    return _step(v, "user_id", "item_id", v.item_factors())


@_query(_STEP.format(r=fx.RATINGS, f=fx.FACTORS, k="item_id", o="uf", j="user_id"))
def als_item_step(v: Views) -> DataFrame:
    return _step(v, "item_id", "user_id", v.user_factors())


@_query(f"WITH {fx.FACTORS} SELECT id, CASE WHEN id % 3 <> 0 THEN f0 END f0, CASE WHEN id % 3 <> 0 THEN f1 END f1, id % 3 = 0 fresh FROM uf")
def warm_extend(v: Views) -> DataFrame:
    known = v.user_factors().filter("id % 3 <> 0")
    out = als.random_factors(v.user_factors(), 2, 1, known.select("id", "features"))
    fresh = F.col("id") % 3 == 0  # drawn anew; that their values are small random numbers is for the tests
    return out.select("id", *[F.when(~fresh, F.element_at("features", k + 1)).alias(f"f{k}") for k in (0, 1)], (fresh & (F.size("features") == 2)).alias("fresh"))


_TOP = f"""WITH {fx.RAW}, {fx.EXTRA}, {fx.FACTORS}, gone AS (SELECT user_id, item_id FROM raw UNION SELECT id, unnest(unrated_items) FROM x),
s AS (SELECT uf.id user_id, itf.id item_id, uf.f0 * itf.f0 + uf.f1 * itf.f1 + CAST(2.5 AS DOUBLE) AS predict FROM uf, itf),
k AS (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY predict DESC, s.item_id) AS rank FROM s ANTI JOIN gone ON gone.user_id = s.user_id AND gone.item_id = s.item_id WHERE predict >= 3.5)"""


def _top(v: Views) -> DataFrame:
    return recommend.top_n(v.spark, v.user_factors(), v.item_factors(), recommend.exclusions(v.raw(), v.extra()), 3.5, 20, 2.5, save=_saver(v))


@_query(f"{_TOP} SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, predict FROM k WHERE rank <= 20")
def recommend_topn(v: Views) -> DataFrame:
    return _top(v)


@_query(f"""{_TOP} SELECT user_id, '[' || string_agg('{{"predict":' || CAST(predict AS VARCHAR) || ',"id":' || item_id || '}}', ',' ORDER BY rank) || ']' items FROM k WHERE rank <= 20 GROUP BY 1""")
def recommend_json(v: Views) -> DataFrame:
    return recommend.as_json(_top(v))


@_query(f"WITH {fx.RAW} SELECT (SELECT count(*) FROM customer) n_users, (SELECT count(*) FROM part) n_items, (SELECT count(*) FROM raw) n_ratings")
def ingest_counts(v: Views) -> DataFrame:
    return movielens.counts(v.table("customer"), v.table("part"), v.raw())


def _ingested(v: Views, kind: str) -> DataFrame:
    """Write a data set in its published format, read it back, and count by the users' own ids."""
    root = _root(v)

    def write(name: str, df: DataFrame) -> None:
        file, sep, schema = movielens.FORMATS[kind][name]
        rest = [F.lit("0")] * (len(schema.split(", ")) - len(df.columns))
        df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns], *rest)).write.text(f"{root}/{file}")

    write("users", v.table("customer").select((F.col("c_custkey") + 1).alias("id")))
    write("items", v.table("part").select((F.col("p_partkey") + 1).alias("id"), "p_name"))
    write("ratings", v.raw().select("user_id", "item_id", "rating"))
    users, items, ratings = movielens.read(v.spark, root, kind)
    rows = ratings.join(users.select("id", F.col("list_id").alias("user_id")), "user_id").join(items.select(F.col("id").alias("item_id"), "name"), "item_id")
    return rows.groupBy("id").agg(F.count("*").alias("n_ratings"), F.sum("rating").alias("sum_rating"), F.min("name").alias("first_name"))


_INGESTED = f"WITH {fx.RAW} SELECT user_id id, count(*) n_ratings, CAST(sum(rating) AS BIGINT) sum_rating, min(p_name) first_name FROM raw JOIN part ON p_partkey + 1 = item_id GROUP BY 1"


@_query(_INGESTED)
def ingest_100k(v: Views) -> DataFrame:
    return _ingested(v, "100k")


@_query(_INGESTED)
def ingest_1m(v: Views) -> DataFrame:
    return _ingested(v, "1m")


# trainings: what must hold of a result whatever the draws; then the results themselves, without an SQL form


def _fitted(v: Views) -> DataFrame:
    return v.ratings().filter("dataset_type in (1, 2)")


_FITTED = f"WITH {fx.RATINGS}, t AS (SELECT * FROM r WHERE dataset_type IN (1, 2)) SELECT (SELECT count(DISTINCT user_id) FROM t) n_users, (SELECT count(DISTINCT item_id) FROM t) n_items, (SELECT count(*) FROM t) n_predicted, 1 complete, 1 better_than_mean"


def _check(fitted: DataFrame, users: DataFrame, items: DataFrame, rank: int, predict) -> DataFrame:
    """Rows of both sides, predictions of all ``fitted`` ratings, whether all factors are there, and whether they beat the mean."""
    side = lambda df: df.agg(F.count("*").alias("n"), F.count_if((F.size("features") == rank) & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x))).alias("whole"))
    u, i, mean = side(users).first(), side(items).first(), fitted.agg(F.avg("rating")).first()[0]
    e, m = F.col("predict") - F.col("rating"), F.col("rating") - F.lit(mean)
    return predict(fitted).agg(F.lit(u.n).cast("long").alias("n_users"), F.lit(i.n).cast("long").alias("n_items"), F.count("*").alias("n_predicted"), F.lit(int(u.whole == u.n and i.whole == i.n)).alias("complete"), (F.sum(e * e) < F.sum(m * m)).cast("int").alias("better_than_mean"))


@_query(_FITTED)
def als_train_check(v: Views) -> DataFrame:
    """MLlib's training at rank 10."""
    save = _saver(v)
    fitted = save(_fitted(v), "fitted")
    users, items = (save(df, "factors") for df in als.train_mllib(fitted, 10, 5, 0.05, blocks=v.blocks, place=_root(v)))
    return _check(fitted, users, items, 10, lambda rows: evaluate.predict(rows, users, items))


@_query(_FITTED)
def als_train_custom_check(v: Views) -> DataFrame:
    """The own loop at rank 10."""
    save = _saver(v)
    fitted = save(_fitted(v), "fitted")
    users, items = als.train_own(v.spark, fitted, 10, 3, 0.05, 0.1, save, first_is_avg=True)
    return _check(fitted, users, items, 10, lambda rows: evaluate.predict(rows, users, items))


@_query(_FITTED)
def sgd_train_check(v: Views) -> DataFrame:
    """Two epochs of stochastic gradient descent at rank 10."""
    save = _saver(v)
    fitted = save(_fitted(v), "fitted")
    users, items, bias = sgd.train(v.spark, fitted, 10, 2, 0.01, (0.02, 0.02, 0.02, 0.02), save)
    return _check(fitted, users, items, 10, lambda rows: evaluate.predict_biased(rows, users, items, bias))


@_query("SELECT CAST(20 AS BIGINT) most, CAST(0 AS BIGINT) already_rated, CAST(0 AS BIGINT) out_of_order")
def train_and_recommend_check(v: Views) -> DataFrame:
    """Of the whole way: the longest list, and items that should not be there or stand in the wrong place."""
    save = _saver(v)
    best, rated = save(train_and_recommend(v), "best"), save(v.raw().select("user_id", "item_id"), "rated")
    again = best.join(rated, ["user_id", "item_id"], "left_semi").agg(F.count("*")).first()[0]
    lists = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "predict"))).alias("l"))
    wrong = F.exists(F.transform("l", lambda x, k: (x["rank"] != k + 1) | F.coalesce(x["predict"] > F.get(F.col("l"), k - 1)["predict"], F.lit(False))), lambda x: x)
    return lists.agg(F.max(F.size("l")).cast("long").alias("most"), F.lit(again).cast("long").alias("already_rated"), F.count_if(wrong).alias("out_of_order"))


@_query()
def als_train(v: Views) -> DataFrame:
    """Factors by MLlib at rank 10, five iterations."""
    users, items = als.train_mllib(_saver(v)(_fitted(v), "fitted"), 10, 5, 0.05, blocks=v.blocks, place=_root(v))
    return users.withColumn("kind", F.lit("user")).unionByName(items.withColumn("kind", F.lit("item")))


@_query()
def als_train_custom(v: Views) -> DataFrame:
    """Factors by the own loop with unequal regularisation and the average as first factor."""
    users, items = als.train_own(v.spark, _fitted(v), 10, 3, 0.05, 0.1, _saver(v), first_is_avg=True)
    return users.withColumn("kind", F.lit("user")).unionByName(items.withColumn("kind", F.lit("item")))


@_query()
def sgd_train(v: Views) -> DataFrame:
    """Factors and biases after an epoch in four blocks."""
    users, items, _ = sgd.train(v.spark, _fitted(v), 10, 1, 0.01, (0.02, 0.02, 0.02, 0.02), _saver(v))
    return users.withColumn("kind", F.lit("user")).unionByName(items.withColumn("kind", F.lit("item")))


@_query()
def train_and_recommend(v: Views) -> DataFrame:
    """The whole way: split, MLlib factors, shift, and the best items for every user."""
    save = _saver(v)
    ratings = save(v.ratings(), "ratings")
    users, items = als.train_mllib(ratings.filter("dataset_type in (1, 2)"), 10, 5, 0.05, blocks=v.blocks, place=_root(v))
    users, items = save(users, "users"), save(items, "items")
    known = ratings.select("user_id", "item_id", "rating", "dataset_type")
    for side, key in ((users, "user_id"), (items, "item_id")):
        known = known.join(side.select(F.col("id").alias(key)), key, "left_semi")
    tested = evaluate.predict(ratings.filter(F.col("dataset_type") == TEST), users, items)
    shift = evaluate.shift_of(stats.global_avg(known), tested, TEST).first().shift or 0.0  # only the tested ratings move with factors
    return recommend.top_n(v.spark, users, items, recommend.exclusions(ratings), 3.5, 20, shift, save=save)
