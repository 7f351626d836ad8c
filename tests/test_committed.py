"""Commits: atomic over several tables, a lost writer changes nothing, of two writers one wins."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from yieldspark.sources import registry
from yieldspark.sources.committed import Conflict, Store, retire


@pytest.fixture
def store(spark, tmp_path):
    out = Store(spark, f"file://{tmp_path}/store")
    change = out.begin()
    change.create("t", "k long, v string")
    change.create("log", "n long")
    assert change.commit() == 0
    return out


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_create_refresh_append(spark, store):
    change = store.begin()
    change.create("t", "k long, v string")
    with pytest.raises(ValueError, match="schema"):
        change.create("t", "k long")
    change.refresh("t", rows(spark, (1, "a"), (2, "b")))
    change.append("log", spark.createDataFrame([(2,)], "n long"))
    assert store.read("t").isEmpty() and content(change.read("t")) == [(1, "a"), (2, "b")]  # not yet, but for the writer
    assert change.commit() == 1
    change = store.begin()
    change.refresh("t", store.read("t").where("k = 2"))  # reads what it replaces
    change.append("t", rows(spark, (3, None)), "k")
    change.commit()
    assert content(store.read("t")) == [(2, "b"), (3, None)] and content(store.read("log")) == [(2,)]
    assert content(store.read("t", 1)) == [(1, "a"), (2, "b")] and store.versions() == [0, 1, 2]
    with pytest.raises(ValueError, match="no table"):
        store.read("other")


@pytest.mark.parametrize("bad", [[(2, "x")], [(None, "x")], [(7, "x"), (7, "y")]])
def test_guarded_append_is_all_or_nothing(spark, store, bad):
    change = store.begin()
    change.append("t", rows(spark, (2, "b")), "k")
    change.commit()
    change = store.begin()
    change.append("log", spark.createDataFrame([(9,)], "n long"))
    with pytest.raises(ValueError, match="k "):
        change.append("t", rows(spark, (8, "new"), *bad), "k")
    assert content(store.read("t")) == [(2, "b")] and store.read("log").isEmpty()


def test_a_lost_writer_leaves_the_old_version(spark, store, monkeypatch):
    change = store.begin()
    change.refresh("t", rows(spark, (1, "a")))
    change.commit()
    change = store.begin()
    change.refresh("t", rows(spark, (2, "b")))
    monkeypatch.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        change.commit()
    monkeypatch.undo()
    assert content(store.read("t")) == [(1, "a")] and store.versions() == [0, 1]
    failing = F.udf(lambda k: 1 // 0, "long")
    change = store.begin()
    with pytest.raises(Exception, match="ZeroDivision"):
        change.refresh("t", store.read("t").withColumn("k", failing("k")))
    assert content(store.read("t")) == [(1, "a")]


def test_a_stale_writer_fails(spark, store):
    one, two = store.begin(), store.begin()
    one.append("t", rows(spark, (1, "a")))
    two.append("t", rows(spark, (2, "b")))
    assert one.commit() == 1
    with pytest.raises(Conflict):
        two.commit()
    assert content(store.read("t")) == [(1, "a")]
    with pytest.raises(RuntimeError):
        one.commit()


def test_of_writers_at_once_one_wins(spark, store, monkeypatch):
    changes = [store.begin() for _ in range(6)]
    for k, c in enumerate(changes):
        c.append("t", rows(spark, (k, "x")))
    monkeypatch.setattr(Store, "versions", lambda self: [0])  # all of them look before any has written

    def attempt(change):
        try:
            return change.commit()
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(attempt, changes))
    monkeypatch.undo()
    assert sorted(x is not None for x in got) == [False] * 5 + [True]
    assert content(store.read("t")) == [(got.index(1), "x")]


def test_upsert_update_delete_touch_only_their_folders(spark, store):
    for part in (((1, "a"), (2, "b")), ((3, "c"),), ((4, "d"), (5, None))):
        change = store.begin()
        change.append("t", rows(spark, *part), "k")
        change.commit()
    before = store.tables()["t"]["folders"]
    change = store.begin()
    change.upsert("t", spark.createDataFrame([(2,), (6,)], "k long"), "k")
    change.commit()
    assert content(store.read("t")) == [(1, "a"), (2, None), (3, "c"), (4, "d"), (5, None), (6, None)]
    assert set(before) & set(store.tables()["t"]["folders"]) == set(before[1:])
    with pytest.raises(ValueError, match="twice"):
        store.begin().upsert("t", rows(spark, (1, "x"), (1, "y")), "k")
    change = store.begin()
    change.delete("t", F.col("v") == "d")
    change.update("t", F.col("k") == 3, {"v": F.lit("new")})
    change.update("t", F.col("k") == 99, {"v": F.lit("none")})
    change.commit()
    assert content(store.read("t")) == [(1, "a"), (2, None), (3, "new"), (5, None), (6, None)]


def test_vacuum_removes_only_what_no_kept_version_names(spark, store, tmp_path):
    for k in range(3):
        change = store.begin()
        change.refresh("t", rows(spark, (k, "x")))
        change.append("log", spark.createDataFrame([(k,)], "n long"))
        change.commit()
    pending = store.begin()
    pending.append("t", rows(spark, (9, "y")))
    gone = store.vacuum(keep=2)
    assert len(gone) == 1 and not os.path.exists(f"{tmp_path}/store/{gone[0]}") and store.versions() == [2, 3]
    assert content(store.read("t", 2)) == [(1, "x")] and content(store.read("log")) == [(0,), (1,), (2,)]
    pending.commit()
    assert content(store.read("t")) == [(2, "x"), (9, "y")]


def test_registry_changes_are_commits(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/r")
    change = store.begin()
    change.create("registry", registry.REGISTRY)
    change.append("registry", spark.createDataFrame([("s001", "feature_raw", "active", 1, 0.0, None, None), ("s002", "feature_raw", "active", 2, 0.0, None, None)], registry.REGISTRY), "column_name")
    change.commit()
    change = store.begin()
    change.upsert("registry", spark.createDataFrame([("f_x", "feature_eng", "active")], "column_name string, role string, status string"), "column_name")
    retire(change, "registry", ["s001"], "constant")
    change.commit()
    assert registry.active_columns(store.read("registry")) == ["s002", "f_x"] and registry.active_columns(store.read("registry", 0)) == ["s001", "s002"]
