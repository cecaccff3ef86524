"""The engine from files to recommendations."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from factorloom.operators import stats
from factorloom.plans.engine import Engine
from factorloom.plans.serve import respond, serve
from factorloom.schema import Options
from factorloom.sources.store import Store
from factorloom.streaming.changes import follow


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data") / "ml-1m"
    root.mkdir()
    users = [f"{u}::M::25::1::00000" for u in range(1, 41)]
    movies = [f"{m}::Cafё {m} (2000)::Drama" for m in range(1, 31)]
    rows = [f"{u}::{m}::{1 + (u * m) % 5}::{m}" for u in range(40, 1, -1) for m in range(1, 31) if (u + m) % 3]
    for name, lines in (("users.dat", users), ("movies.dat", movies), ("ratings.dat", rows)):
        (root / name).write_bytes("\n".join(lines).encode("windows-1251"))
    return root.parent


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('root')}", Options(rank=4, iterations=3, min_recommend=0.5))
    assert e.import_movielens("1m", str(folder)) == {"n_users": 40, "n_items": 30, "n_ratings": 780}
    return e


def test_import(engine):
    assert engine.version().startswith("4.")
    users = engine.store.load("users")
    assert users.filter("id = 40").first().list_id == 1 and users.filter("id = 1").first().list_id is None
    assert engine.store.load("items").filter("id = 3").first().name == "Cafё 3 (2000)"


def test_train_and_recommend(engine, spark):
    with pytest.raises(RuntimeError):
        Engine(spark, engine.store.root + "/none").recommend(user_id=1)
    info = engine.train()
    assert engine.status == "ready" and 0 < info["rmse_validate"] < 2 and "rmse_test_shifted" in info
    got = engine.recommend(user_id=40, limit=3)
    rated = {r.item_id for r in engine.store.load("ratings").filter("user_id = 1").collect()}
    assert 0 < len(got) <= 3 and not rated & {g["id"] for g in got}
    assert [g["predict"] for g in got] == sorted((g["predict"] for g in got), reverse=True)
    assert engine.predict(1, got[0]["id"]) == pytest.approx(got[0]["predict"])
    assert engine.recommend(login="1") == []
    with pytest.raises(KeyError):
        engine.recommend(login="nobody")
    assert engine.train()["calc_count"] == 2  # starts from the stored model


def test_late_user_and_stats(engine, spark):
    engine.add_ratings(spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "id int, item_id int, rating int"))
    assert engine.store.load("users").filter("id = 1").first().list_id == 40
    assert engine.recommend(user_id=1) == []
    with pytest.raises(ValueError):
        engine.add_ratings(spark.createDataFrame([(1, 1, 5)], "id int, item_id int, rating int"))
    engine.set_stat("a", 3)
    engine.set_stat("b", None)
    engine.set_stat("a", "x1")
    assert engine.get_stat("a") == "x1" and engine.get_stat("b") == 0 and engine.get_stat("c") is None
    first = engine.update_most_rated().count()
    assert first and engine.update_most_rated().count() == 0


def test_http(engine):
    server = serve(engine, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert urllib.request.urlopen(f"{at}/status").read() == b"ready"
    assert len(json.load(urllib.request.urlopen(f"{at}/userid/40/recommend?limit=2"))) == 2
    with pytest.raises(urllib.error.HTTPError, match="404"):
        urllib.request.urlopen(f"{at}/user/nobody/recommend")
    server.shutdown()
    engine.status = "training"
    assert respond(engine, "/train")[0] == 406
    engine.status = "ready"


def test_sgd_engine(spark, folder, tmp_path):
    e = Engine(spark, f"file://{tmp_path}", Options(alg="sgd", rank=3, iterations=1, sgd_blocks=2, min_recommend=0.5))
    with pytest.raises(ValueError, match="no_data"):
        e.train()
    e.import_movielens("1m", str(folder))
    assert e.train()["rmse_test"] > 0
    assert len(e.recommend(user_id=40, limit=2)) == 2
    e.wipe()
    assert e.can_predict() and e.store.load("ratings").count() == 0


def test_change_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    store.save("ratings", spark.createDataFrame([(1, 1, 5, 1), (1, 2, 4, 1)], "user_id int, item_id int, rating short, dataset_type short"))
    schema = "user_id int, item_id int, rating short, seq long"
    for seq, row in enumerate([(1, 1, 2, 1), (1, 1, 0, 2), (1, 2, 3, 3)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        if seq != 1:
            follow(store, spark.readStream.schema(schema).parquet(f"{tmp_path}/log"), f"{tmp_path}/check").awaitTermination()
    assert [(r.item_id, r.rating) for r in store.load("ratings").collect()] == [(2, 3)]


def test_stats_kv_values(spark):
    df = spark.createDataFrame([("a", "1.5"), ("b", None), ("c", "x")], "key string, val string")
    assert [r.num for r in stats.stat_values(df).orderBy("key").collect()] == [1.5, 0.0, None]
    assert df.filter(F.col("key") == "a").count() == 1
