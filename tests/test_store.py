"""What a store holds after crashes, changes by parts, and further trainings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators.changes import apply_changes
from factorloom.plans.engine import Engine
from factorloom.schema import Options
from factorloom.sources import movielens
from factorloom.sources.factors import read_biases
from factorloom.sources.store import Store

R = "user_id int, item_id int, rating short, dataset_type short"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}")
    first, second = spark.createDataFrame([(1, 1, 5, 1)], R), spark.createDataFrame([(2, 2, 4, 1)], R)
    assert store.load("ratings").count() == 0
    store.save("ratings", first)
    with monkeypatch.context() as m:  # after the data, before the pointer
        m.setattr(store, "_write_text", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.save("ratings", second)
    assert rows(store.load("ratings")) == rows(first)
    with monkeypatch.context() as m:  # after the pointer, before the old version goes
        m.setattr(store, "_delete", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        for df in (second, first, second):
            try:
                store.save("ratings", df)
            except OSError:
                pass
            assert rows(store.load("ratings")) == rows(df)
    store.save("ratings", first)
    assert rows(store.load("ratings")) == rows(first) and len(store._pointers("tables", "ratings")) == 2


def test_readers_of_the_version_before_go_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    old = store.save("ratings", spark.createDataFrame([(1, 1, 5, 1)], R))
    store.save("ratings", spark.createDataFrame([(2, 2, 4, 1)], R))
    assert rows(old) == [(1, 1, 5, 1)]


def test_data_without_a_pointer_is_an_error(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.save("ratings", spark.createDataFrame([(1, 1, 5, 1)], R))
    for p in store._pointers("tables", "ratings"):
        store._delete("tables", "ratings", p)
    with pytest.raises(OSError, match="no pointer"):
        store.load("ratings")


def test_changes_write_only_their_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    ratings = spark.createDataFrame([(u, i, 1 + (u * i) % 5, 1) for u in range(1, 30) for i in range(1, 5)], R)
    store.save("ratings", ratings)
    for news in ([(3, 1, 0), (3, 2, 5)], [(4, 1, 2), (99, 1, 3)]):
        changes = spark.createDataFrame(news, "user_id int, item_id int, rating short")
        before, want = store._current("tables", "ratings"), rows(apply_changes(store.load("ratings"), changes))
        store.change("ratings", "user_id", changes, apply_changes, 8)
        after = store._current("tables", "ratings")
        assert rows(store.load("ratings")) == want and store.load("ratings").columns == ratings.columns
        if "by" in before:
            assert 0 < sum(a != b for a, b in zip(before["folders"], after["folders"])) <= 2
    assert rows(ratings.filter("user_id = 3 and item_id = 1")) and store.load("ratings").filter("user_id = 3 and item_id = 1").count() == 0
    Store(spark, f"file://{tmp_path}/none").change("ratings", "user_id", changes, apply_changes)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/root", Options(rank=2, iterations=2))
    flags = [F.lit(True).alias("are_ratings_modified"), F.lit(False).alias("is_used_for_train"), F.lit(0).alias("ratings_count"), F.lit(0.0).alias("avg_rating")]
    e.store.save("users", spark.range(1, 21).select(F.col("id").cast("int"), F.col("id").cast("string").alias("login"), F.col("id").cast("int").alias("list_id"), *flags))
    e.store.save("items", spark.range(1, 31).select(F.col("id").cast("int"), F.col("id").cast("string").alias("name"), *flags))
    e.store.save("ratings", spark.createDataFrame([(u, i, 1 + (u + i) % 5, 0) for u in range(1, 21) for i in range(1, 31) if (u + i) % 4], R))
    return e


def test_other_percentages_split_anew(spark, engine):
    share = lambda: [engine.store.load("ratings").filter(F.col("dataset_type") == k).count() for k in (1, 2, 3)]
    engine.train()
    a = share()
    engine.options = engine.options.merged({"split": (50, 25, 25)})
    engine.train()
    b = share()
    assert sum(a) == sum(b) and a[0] / sum(a) > 0.8 and abs(b[0] / sum(b) - 0.5) < 0.05


def test_status_and_times(spark, engine, monkeypatch):
    engine.train()
    assert engine.can_predict() is None
    engine.status = "training"
    assert engine.can_predict() == "status is training"
    engine.status = "ready"
    first = engine.update_most_rated()
    stamped = engine.store.load("users").filter("most_rated_items_update_ts is not null")
    assert {r.id for r in stamped.collect()} == {r.user_id for r in first.collect()} and first.count()
    monkeypatch.setattr(engine, "_train", lambda: engine.destroy())
    engine.train()
    assert engine.status == "destroyed" and engine.can_train()


def test_biases_and_damaged_lines(spark, tmp_path):
    np.array([0.5, -1.0, 2.0], "<f4").tofile(tmp_path / "bias")
    assert rows(read_biases(spark, f"{tmp_path}/bias")) == [(1, 0.5), (2, -1.0), (3, 2.0)]
    folder = tmp_path / "ml-1m"
    folder.mkdir()
    (folder / "users.dat").write_text("1::M::25::1::00000\nbad::\n2::F::1::1::0")
    (folder / "movies.dat").write_text("1::A (2000)::Drama")
    (folder / "ratings.dat").write_text("1::1::5::1\n1::x::5::1\n2::1::3::2")
    assert movielens.damaged(spark, str(folder), "1m").first().asDict() == {"users": 1, "items": 0, "ratings": 1}
    assert [df.count() for df in movielens.read(spark, str(folder), "1m")] == [2, 1, 2]
