"""Small hand-made cases and properties of the engine's operators."""

import os
import time
import urllib.parse

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions.ranking import global_row_number
from factorloom.functions.vectors import human_size, random_int, same_elements
from factorloom.operators import als, changes, evaluate, recommend, scans, sgd, split, stats
from factorloom.plans import fixtures, queries
from factorloom.plans.fixtures import Views
from factorloom.schema import Options
from factorloom.sources import scratch
from factorloom.sources.factors import read_binary

R = "user_id int, item_id int, rating short, dataset_type short"


def make(spark, n_users=30, n_items=20, seed=0):
    rng = np.random.default_rng(seed)
    u, i = rng.normal(size=(n_users, 2)), rng.normal(size=(n_items, 2))
    rows = [(a + 1, b + 1, int(np.clip(round(3 + u[a] @ i[b]), 1, 5)), 1) for a in range(n_users) for b in range(n_items) if rng.random() < 0.6]
    return spark.createDataFrame(rows, R)


@pytest.fixture
def save(tmp_path, spark):
    n = iter(range(10**6))

    def f(df, name):
        path = f"{tmp_path}/{name}-{next(n)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return f


def test_changes(spark):
    r = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 4, 4), (2, 1, 3, 2)], R)
    c = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (9, 9, 1)], "user_id int, item_id int, rating short")
    out = changes.promote_new(changes.apply_changes(r, c))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 2, 0), (2, 1, 3, 2)]


def test_split_targets(spark):
    r = spark.createDataFrame([(1, i, 3, 0) for i in range(20)] + [(2, 1, 3, 0)], R)
    out = {(x.user_id, x.dataset_type): x["count"] for x in split.resplit(r).groupBy("user_id", "dataset_type").count().collect()}
    assert out == {(1, 1): 17, (1, 2): 2, (1, 3): 1, (2, 1): 1}
    assert split.quality(split.resplit(r)).first().acceptable == 1 and split.quality(r).first().acceptable == 0


def test_incremental_keeps_what_is_assigned(spark):
    r = spark.createDataFrame([(1, i, 3, 1 if i < 8 else 0) for i in range(20)], R)
    out = split.incremental(r)
    assert out.filter("item_id < 8 and dataset_type <> 1").count() == 0
    assert {x.dataset_type: x["count"] for x in out.groupBy("dataset_type").count().collect()} == {1: 17, 2: 2, 3: 1}


def test_dense_ids_by_first_appearance(spark):
    seen = spark.createDataFrame([(30, 5), (10, 900000), (20, 70000), (30, 1), (40, 3)], "id int, pos long")
    assert dict(map(tuple, stats.dense_ids(seen).collect())) == {30: 1, 40: 2, 20: 3, 10: 4}
    known = spark.createDataFrame([(30, 7)], "id int, list_id int")
    assert dict(map(tuple, stats.dense_ids(seen, known).collect())) == {40: 8, 20: 9, 10: 10}


def test_global_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    out = global_row_number(df, F.floor(F.col("k") / 100), ["k"], "n").orderBy("k").collect()
    assert [r.n for r in out] == list(range(1, 1001))


def test_half_step_solves_the_normal_equations(spark, save):
    r = make(spark)
    rng = np.random.default_rng(1)
    fixed = spark.createDataFrame([(i + 1, rng.normal(size=3).tolist()) for i in range(20)], "id int, features array<double>")
    f = {x.id: np.array(x.features) for x in fixed.collect()}
    for hot in (10**6, 4):  # whole rows, and rows cut in parts
        out = {x.id: np.array(x.features) for x in als.half_step(als.layout(r, "user_id", "item_id", 3, save, hot), fixed, 0.1).collect()}
        rows = r.collect()
        for u, x in out.items():
            m = np.array([f[t.item_id] for t in rows if t.user_id == u])
            y = np.array([t.rating for t in rows if t.user_id == u], float)
            assert np.allclose((m.T @ m + 0.1 * len(y) * np.eye(3)) @ x, m.T @ y)
        assert len(out) == len({t.user_id for t in rows})


def test_trainings_lower_the_error(spark, save):
    r = make(spark)
    mean = r.agg(F.stddev_pop("rating")).first()[0]
    for users, items in (als.train_mllib(r, 3, 8, 0.05), als.train_own(spark, r, 3, 4, 0.05, 0.1, save)):
        assert evaluate.rmse(evaluate.predict(r, users, items), 1).first().rmse < 0.8 * mean
    users, items, bias = sgd.train(spark, r, 3, 6, 0.05, (0.01,) * 4, save, blocks=2)
    assert evaluate.rmse(evaluate.predict_biased(r, users, items, bias), 1).first().rmse < mean


def test_sgd_single_block_is_sequential(spark, save):
    r = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 1, 1), (2, 1, 4, 1)], R)
    users, items, bias = sgd.train(spark, r, 2, 1, 0.1, (0.0,) * 4, save, blocks=1)
    start = {k: {x.id: np.array(x.features) for x in als.random_factors(r.select(F.col(c).alias("id")), 2, s).collect()} for k, c, s in (("u", "user_id", 42), ("i", "item_id", 43))}
    u, i, bu, bi = start["u"], start["i"], {1: 0.0, 2: 0.0}, {1: 0.0, 2: 0.0}
    for x in scans.sgd_order(r, 0).orderBy("shuffled").collect():
        a, b = x.user_id, x.item_id
        e = x.rating - (bias + bu[a] + bi[b] + u[a] @ i[b])
        bu[a] += 0.1 * e
        bi[b] += 0.1 * e
        u[a] = u[a] + 0.1 * e * i[b]
        i[b] = i[b] + 0.1 * e * u[a]
    for x in users.collect():
        assert np.allclose(x.features, u[x.id]) and np.isclose(x.bias, bu[x.id])
    for x in items.collect():
        assert np.allclose(x.features, i[x.id]) and np.isclose(x.bias, bi[x.id])


def test_sgd_cells_come_in_batches(spark, save, monkeypatch):
    """No task gets a cell as a whole, portions change nothing, and more factors make more blocks."""
    r, got = make(spark), []
    names, plans = [], []

    def noted(df, name):
        names.append(name)
        plans.append(df._jdf.queryExecution().toString() if name == "stratum" else "MapInArrow")
        return save(df, name)

    for most in (10_000, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        users, items, _ = sgd.train(spark, r, 3, 2, 0.05, (0.01,) * 4, noted, blocks=3)
        got.append([sorted(map(tuple, side.select("id", "bias", "features").collect())) for side in (users, items)])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] and [len(x) for x in got[0]] == [30, 20]
    assert all("MapInArrow" in p and "FlatMapGroups" not in p for p in plans)
    names.clear()
    monkeypatch.setattr(sgd, "CELL_VALUES", 25)
    sgd.train(spark, r, 3, 1, 0.05, (0.01,) * 4, noted)
    assert names.count("stratum") == 6  # 50 rows of 3 factors


def test_prediction_that_is_no_number_raises(spark):
    bad = spark.createDataFrame([(1, float("nan"), [1.0])], "id int, bias double, features array<double>")
    pairs = spark.createDataFrame([(1, 1)], "user_id int, item_id int")
    with pytest.raises(Exception, match="learning rate"):
        evaluate.predict_biased(pairs, bad, bad, 0.0).collect()


@pytest.mark.parametrize("small", [None, 0])
def test_recommendations_match_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(2)
    u, i = rng.integers(-4, 5, (7, 3)) / 4, rng.integers(-4, 5, (50, 3)) / 4
    users = spark.createDataFrame([(a + 1, x.tolist()) for a, x in enumerate(u)], "id int, features array<double>")
    items = spark.createDataFrame([(2 * b + 1, x.tolist()) for b, x in enumerate(i)], "id int, features array<double>")
    rated = spark.createDataFrame([(1, 1), (1, 3), (2, 99), (2, 1000)], "user_id int, item_id int")
    monkeypatch.setattr(recommend, "ITEM_BLOCK", 8)
    monkeypatch.setattr(recommend, "USER_CHUNK", 3)
    got = recommend.top_n(spark, users, items, recommend.exclusions(rated), 0.25, 5, 0.25, small).collect()
    gone = {(1, 1), (1, 3), (2, 99)}
    for a in range(7):
        best = sorted(((-(u[a] @ i[b] + 0.25), 2 * b + 1) for b in range(50) if (a + 1, 2 * b + 1) not in gone and u[a] @ i[b] + 0.25 >= 0.25))[:5]
        assert [(r.item_id, r.predict) for r in sorted((r for r in got if r.user_id == a + 1), key=lambda r: r.rank)] == [(b, -p) for p, b in best]


def test_lookup_trims_login(spark):
    users = spark.createDataFrame([(1, "ann   ", None)], "id int, login string, list_id int")
    extra = spark.createDataFrame([], "id int, unrated_items array<int>, most_rated_items array<int>")
    assert scans.lookup_user(users, extra, login="ann").first().login == "ann"
    assert scans.lookup_user(users, extra, user_id=2).first() is None


def test_small_functions(spark):
    row = spark.range(1).select(human_size(F.lit(1536)).alias("s"), same_elements(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))).alias("e")).first()
    assert row.s == "1.5 kB" and row.e


def test_options():
    with pytest.raises(ValueError):
        Options(db_type="other").scale
    assert Options(db_type="other", max_rating=10).scale == (10, 7.0)
    assert Options().merged({"rank": 5}, {"rank": 7}).rank == 7


def test_random_int(spark):
    got = {r.x for r in spark.range(500).select(random_int(3, 5, 1).alias("x")).collect()}
    assert got == {3, 4, 5}


@pytest.mark.parametrize("double", [False, True])
def test_binary_factors(spark, tmp_path, monkeypatch, double):
    monkeypatch.setattr("factorloom.sources.factors.CHUNK", 100)
    table = np.arange(105, dtype="<f8" if double else "<f4").reshape(35, 3)
    table.tofile(tmp_path / "users.bin")
    got = {r.id: r.features for r in read_binary(spark, str(tmp_path / "users.bin"), 3, double).collect()}
    assert got == {i + 1: x.tolist() for i, x in enumerate(table)}


def test_waves_equal_the_sequence():
    """Visits in waves give what visits one by one give."""
    rng = np.random.default_rng(3)
    x, y, r = rng.integers(0, 12, 400), rng.integers(0, 9, 400), rng.integers(1, 6, 400).astype(float)
    regs = (0.01, 0.02, 0.03, 0.04)
    u, i, bu, bi = rng.normal(size=(12, 3)), rng.normal(size=(9, 3)), rng.normal(size=12), rng.normal(size=9)
    want = [a.copy() for a in (u, i, bu, bi)]
    sgd._visit(x, y, r, u, i, bu, bi, 3.0, 0.05, regs)
    wu, wi, wbu, wbi = want
    for a, b, s in zip(x, y, r):
        e = s - (3.0 + wbu[a] + wbi[b] + wu[a] @ wi[b])
        wbu[a] += 0.05 * (e - regs[0] * wbu[a])
        wbi[b] += 0.05 * (e - regs[1] * wbi[b])
        wu[a] += 0.05 * (e * wi[b] - regs[2] * wu[a])
        wi[b] += 0.05 * (e * wu[a] - regs[3] * wi[b])
    assert all(np.allclose(a, b) for a, b in zip((u, i, bu, bi), want))
    assert len(sgd.waves(x[:0], y[:0])) == 0
    w = sgd.waves(x, y)
    assert all(len(set(x[w == k])) == (w == k).sum() == len(set(y[w == k])) for k in set(w))


def test_shift_from_part_of_the_predictions(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 2, 3), (2, 1, 3, 3), (2, 2, 4, 0)], R).withColumn("predict", F.col("rating") + 0.5)
    want = evaluate.global_shift(rows, 3).first().shift
    assert evaluate.shift_of(stats.global_avg(rows), rows.filter("dataset_type = 3"), 3).first().shift == pytest.approx(want)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, and the rows stay the same."""
    sf = "/root/testdata/sf0.001"
    want = sorted(map(tuple, Views(spark, sf).mixed_ratings().collect()))
    users = sorted(map(tuple, Views(spark, sf).users().select("id", "list_id").collect()), key=str)
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    v = Views(spark, sf)
    lines = v.table("lineitem").count()
    assert v.parts == -(-lines // 500) > spark.sparkContext.defaultParallelism
    assert v.mixed_ratings().rdd.getNumPartitions() == v.parts
    assert sorted(map(tuple, v.mixed_ratings().collect())) == want
    assert sorted(map(tuple, v.users().select("id", "list_id").collect()), key=str) == users


def test_predictions_by_item_have_as_many_tasks(spark, monkeypatch):
    """The join by item follows the rows as the one by user does, whatever the session's number of tasks."""
    sf = "/root/testdata/sf0.001"
    names = ("rmse_test", "rmse_test_shifted", "rmse_validate", "predict_als", "predict_sgd", "global_avg_shift")
    of = lambda n: sorted(tuple(round(x, 9) for x in r) for r in queries.QUERIES[n](spark, sf).collect())
    want = {n: of(n) for n in names}
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, sf)
        assert queries._predicted(v).rdd.getNumPartitions() == v.parts != int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert {n: of(n) for n in names} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_mllib_blocks_follow_the_ratings(spark, monkeypatch):
    """More ratings make more blocks of MLlib's training, so that none grows with them."""
    sf, asked, train = "/root/testdata/sf0.001", [], als.train_mllib
    monkeypatch.setattr(als, "train_mllib", lambda *a, **k: asked.append(k.get("blocks")) or train(*a, **k))
    few = queries.QUERIES["als_train"](spark, sf).count()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 400)
    parts = Views(spark, sf).parts
    many = queries.QUERIES["als_train"](spark, sf)
    assert many.count() == few and many.filter("size(features) = 10").count() == few
    assert asked == [None, parts] and parts > 10


def test_half_step_has_a_task_for_each_block(spark, save, monkeypatch):
    """More ratings make more tasks of a half-step, whatever the session's number, and factors stay the same."""
    r = make(spark)
    fixed = save(als.random_factors(r.select(F.col("item_id").alias("id")), 3, 1), "fixed")
    step = lambda: als.half_step(als.layout(r, "user_id", "item_id", 3, save), fixed, 0.1)
    want = {x.id: x.features for x in step().collect()}
    monkeypatch.setattr(als, "BLOCK_RATINGS", 30)
    out = step()
    blocks = -(-r.count() // 30)
    assert out.rdd.getNumPartitions() == blocks > 4
    got = {x.id: x.features for x in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_page_has_as_many_tasks_as_asked(spark):
    ratings = Views(spark, "/root/testdata/sf0.001").ratings()
    few, many = scans.sgd_page(ratings, 3, 2, 1000), scans.sgd_page(ratings, 3, 2, 1000, parts=9)
    assert many.rdd.getNumPartitions() == 9
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 1000


@pytest.mark.parametrize("small", [None, 40 * 32, 0])
@pytest.mark.parametrize("common", [0.0, 3.0])
def test_bounds_lose_no_recommendation(spark, save, monkeypatch, small, common):
    """Many equal items, a head in blocks, users whose list it settles and others: all as brute force has it."""
    rng = np.random.default_rng(5)
    u, i = rng.integers(-8, 9, (90, 4)) / 8.0, rng.integers(-8, 9, (200, 4)) / 8.0
    u[:, 0] += common
    u[3] = 0.0
    i[::3] = i[0]
    i[100:120] *= 4
    users = spark.createDataFrame([(a + 1, x.tolist()) for a, x in enumerate(u)], "id int, features array<double>")
    items = spark.createDataFrame([(3 * b + 1, x.tolist()) for b, x in enumerate(i)], "id int, features array<double>")
    gone = {(a + 1, 3 * int(b) + 1) for a in range(90) for b in rng.choice(200, a % 7, replace=False)} | {(5, 3 * b + 1) for b in range(0, 150)}
    monkeypatch.setattr(recommend, "HEAD_BLOCK", 16)
    monkeypatch.setattr(recommend, "ITEM_BLOCK", 32)
    rated = spark.createDataFrame(sorted(gone), "user_id int, item_id int")
    got = recommend.top_n(spark, users, items, recommend.exclusions(rated), 0.25, 6, 0.25, small, save).collect()
    for a in range(90):
        best = sorted(((-(u[a] @ i[b] + 0.25), 3 * b + 1) for b in range(200) if (a + 1, 3 * b + 1) not in gone and u[a] @ i[b] + 0.25 >= 0.25))[:6]
        own = sorted((r for r in got if r.user_id == a + 1), key=lambda r: r.rank)
        assert [(r.rank, r.item_id, r.predict) for r in own] == [(k + 1, b, -p) for k, (p, b) in enumerate(best)]


def test_few_items_are_left_of_equal_ones(spark, save, monkeypatch):
    """Of 5,000 equal items a user with two exclusions can be given the first five of three, so no more are searched."""
    seen = []
    head = recommend._head
    monkeypatch.setattr(recommend, "FEW", 0)
    monkeypatch.setattr(recommend, "_head", lambda axis, ids, table, rest: seen.append(len(ids)) or head(axis, ids, table, rest))
    users = spark.createDataFrame([(1, [1.0])], "id int, features array<double>")
    items = spark.range(1, 5001).select(F.col("id").cast("int").alias("id"), F.array(F.lit(1.0)).alias("features"))
    rated = spark.createDataFrame([(1, 1), (1, 3)], "user_id int, item_id int")
    assert [r.item_id for r in recommend.top_n(spark, users, items, recommend.exclusions(rated), 0.0, 3, save=save).orderBy("rank").collect()] == [2, 4, 5]
    assert seen == [5]


def test_blocks_are_ranges_of_few_ratings(spark, save, monkeypatch):
    """Blocks are bounded by ratings, and groups of neighbours that share items ask for each factor about once."""
    monkeypatch.setattr(als, "BLOCK_RATINGS", 100)
    rows = [(g * 10 + a + 1, g * 10 + b + 1, 3, 1) for g in range(16) for a in range(10) for b in range(10)]
    plan = als.layout(spark.createDataFrame(rows, R), "user_id", "item_id", 2, save)
    sizes = [r["count"] for r in plan.cells.groupBy("block").count().collect()]
    assert sum(sizes) == 1600 and max(sizes) <= 400
    assert plan.links.count() <= 2 * 160 + 40


def shuffled(spark, want=lambda n: True):
    """Bytes of shuffle files, once they are as wanted (their deletion is not waited for by Spark) or after a while."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        found = files.getAllFiles().toList()
        n = sum(f.length() for f in (found.apply(k) for k in range(found.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))
        if want(n):
            break
        time.sleep(0.1)
    return n


def test_written_steps_leave_no_shuffle_files(spark, tmp_path):
    df = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 700).alias("k")).count()
    for name in ("a", "b"):
        before = shuffled(spark)
        out = scratch.write(df, f"{tmp_path}/{name}")
        assert shuffled(spark, lambda n: n <= before) <= before
        assert out.count() == 700 and out.agg(F.sum("count")).first()[0] == 5000
    assert spark.conf.get(scratch.CLEANUP) == "false" and df.count() == 700


def test_mllib_checkpoints_each_iteration(spark, save, monkeypatch, tmp_path):
    """MLlib deletes what an iteration sent at the next checkpoint, if there is a folder for it."""
    asked, cls, r = [], als.ALS, save(make(spark), "ratings")
    monkeypatch.setattr(als, "ALS", lambda **k: asked.append(cls(**k)) or asked[-1])
    als.train_mllib(r, 3, 3, 0.05, place=str(tmp_path / "points"))
    place = urllib.parse.urlparse(spark.sparkContext.getCheckpointDir()).path
    assert [a.getCheckpointInterval() for a in asked] == [1] and any(n.startswith("rdd-") for n in os.listdir(place))


@pytest.mark.parametrize("name", ["als_train_check", "als_train_custom_check", "sgd_train_check"])
def test_checks_derive_the_ratings_once(spark, monkeypatch, name):
    """What is fitted is what is checked, written once: the views' exchanges run no second time."""
    made, views = [], Views.ratings
    monkeypatch.setattr(Views, "ratings", lambda v: made.append(1) or views(v))
    row = queries.QUERIES[name](spark, "/root/testdata/sf0.001").first()
    assert made == [1] and row.complete == row.better_than_mean == 1


def test_recommending_leaves_no_files_of_trainings(spark, monkeypatch):
    """MLlib has a folder for its checkpoints wherever it trains, and the exchanges of the check are deleted with it."""
    places, names, train, write = [], [], als.train_mllib, scratch.write
    monkeypatch.setattr(als, "train_mllib", lambda *a, **k: places.append(k.get("place")) or train(*a, **k))
    monkeypatch.setattr(scratch, "write", lambda df, path: names.append(path.rsplit("/", 1)[1].split("-")[0]) or write(df, path))
    row = queries.QUERIES["train_and_recommend_check"](spark, "/root/testdata/sf0.001").first()
    assert (row.already_rated, row.out_of_order) == (0, 0) and len(places) == 1 and places[0]
    assert {"ratings", "users", "items", "best", "rated"} <= set(names)


def test_sgd_moves_portions_and_deletes_earlier_steps(spark, tmp_path):
    """A stratum gets and gives portions of flat arrays, not a row a rating; of all steps only the last one's files stay."""
    names, frames = iter(range(1000)), []

    def write(df, name):
        frames.append((name, scratch.write(df, f"{tmp_path}/{name}-{next(names)}")))
        if name in ("factors", "stratum", "visits"):
            rows = frames[-1][1].agg(F.count("*").alias("portions"), F.sum("n").alias("rows")).first()
            assert rows.portions <= 9 and rows.rows == (r.count() if name == "visits" else 50)
        return frames[-1][1]

    r = make(spark)
    users, items, _ = sgd.train(spark, r, 3, 2, 0.05, (0.01,) * 4, write, blocks=3)
    assert [n for n, _ in frames if n in ("visits", "stratum")] == (["visits"] + ["stratum"] * 3) * 2
    assert users.count() == 30 and items.count() == 20
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["items", "ratings", "stratum", "users"]
