"""The log-structured store: merges, commits, lost writers, repeated batches."""

import pytest
from pyspark.sql import functions as F

from heliodor import streaming
from heliodor.operators import store as stores
from heliodor.operators.store import PointStore
from heliodor.storage import Conflict


def rows(spark, some, schema="id long, v string, n int"):
    return spark.createDataFrame(some, schema)


def held(store, **more):
    return {r.id: r.v for r in store.read(**more).collect()}


def test_merge_on_read_and_versions(spark, tmp_path):
    s = PointStore(spark, str(tmp_path), "x", buckets=4)
    s.upsert(rows(spark, [(i, f"v{i}", 0) for i in range(50)]))
    s.upsert(rows(spark, [(3, "new", 1), (3, "newer", 2), (60, "more", 0), (None, "no key", 0)]), order="n")
    s.delete(ids=rows(spark, [(5, "", 0), (777, "", 0)]))
    s.delete(where=F.col("v") == "v6")
    s.upsert(rows(spark, [(6, "back", 0)]))
    want = {i: f"v{i}" for i in range(50)} | {3: "newer", 60: "more", 6: "back"}
    del want[5]
    assert held(s) == want
    assert held(s, version=0) == {i: f"v{i}" for i in range(50)} and 6 not in held(s, version=3)
    s.compact()
    assert held(s) == want and len(s.log.read()["files"]) == 1
    s.vacuum(seconds=0, versions=1)
    assert held(s) == want and len([n for n in s.folder.names() if n.startswith("data-")]) == 1
    assert {r.id for r in s.existing(rows(spark, [(5, "", 0), (6, "", 0), (999, "", 0)])).collect()} == {6}
    assert {r.id for r in s.missing(rows(spark, [(5, "", 0), (6, "", 0)])).collect()} == {5}
    assert [r.id for r in s.scroll(F.col("n") == 0, 3).collect()] == [0, 1, 2]


def test_an_upsert_writes_its_own_rows_alone(spark, tmp_path):
    s = PointStore(spark, str(tmp_path), "x")
    big = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(1).alias("n"))
    s.upsert(big)
    base = s.folder.size(s.log.read()["files"][0])
    s.upsert(big.where("id % 100 = 7").withColumn("n", F.lit(2)))
    assert s.folder.size(s.log.read()["files"][1]) < 0.02 * base
    assert s.read().agg(F.sum("n"), F.count("*")).first()[:] == (202_000, 200_000)


def test_same_rows_whatever_the_partitions(spark, tmp_path):
    got = []
    for k in (1, 4):
        s = PointStore(spark, str(tmp_path), f"x{k}")
        s.upsert(rows(spark, [(i % 3, f"v{i}", 0) for i in range(30)]).repartition(k))
        got.append(held(s))
    assert got[0] == got[1] and len(got[0]) == 3


def test_a_lost_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    s = PointStore(spark, str(tmp_path), "x")
    s.upsert(rows(spark, [(1, "a", 0)]))
    with monkeypatch.context() as m:
        m.setattr(PointStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.upsert(rows(spark, [(1, "b", 0)]))
    assert held(s) == {1: "a"}
    s.vacuum()  # what may be a writer's that is still at work stays
    assert len([n for n in s.folder.names() if n.startswith("data-")]) == 2
    s.vacuum(seconds=0)
    assert len([n for n in s.folder.names() if n.startswith("data-")]) == 1 and held(s) == {1: "a"}


def test_two_writers(spark, tmp_path, monkeypatch):
    a, b = (PointStore(spark, str(tmp_path), "x") for _ in range(2))
    a.upsert(rows(spark, [(1, "a", 0)]))
    name = a._write(rows(spark, [(1, "mine", 0)]).withColumn("__deleted", F.lit(False)), 16)
    b.upsert(rows(spark, [(2, "b", 0)]))
    a._commit(name, a.schema(), None)
    assert held(a) == {1: "mine", 2: "b"}
    read = a.read
    monkeypatch.setattr(a, "read", lambda *x: (b.compact(), read(*x))[1])  # another writer compacts while a does
    a.compact()
    assert held(b) == {1: "mine", 2: "b"} and len(b.log.read()["files"]) == 1
    with pytest.raises(Conflict):
        a.create("id long, v string, n int")


def test_repeated_batches(spark, tmp_path):
    s = PointStore(spark, str(tmp_path), "x")
    assert s.upsert(rows(spark, [(1, "a", 0)]), batch=("stream", 0))
    assert s.upsert(rows(spark, [(1, "b", 0)]), batch=("stream", 1))
    assert not s.upsert(rows(spark, [(1, "a", 0)]), batch=("stream", 0))
    assert not s.upsert(rows(spark, [(1, "c", 0)]), batch=("stream", 1))
    assert s.upsert(rows(spark, [(2, "d", 0)]), batch=("other", 0)) and held(s) == {1: "b", 2: "d"}


def test_deltas_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MOST_DELTAS", 3)
    s = PointStore(spark, str(tmp_path), "x", buckets=2)
    for i in range(6):
        s.upsert(rows(spark, [(i, str(i), 0), (0, f"last {i}", 0)]), batch=("w", i))
    assert held(s) == {0: "last 5"} | {i: str(i) for i in range(1, 6)} and len(s.log.read()["files"]) <= 3
    assert s.log.read()["batches"] == {"w": 5}


def test_schema_and_dimensions(spark, tmp_path):
    s = PointStore(spark, str(tmp_path), "x")
    s.create("id long, vector array<float>, note string", {"vector": 2})
    assert s.exists() and s.read().count() == 0
    s.upsert(rows(spark, [(1, [1.0, 2.0]), (2, None)], "id long, vector array<float>"))
    assert {(r.id, tuple(r.vector or ()), r.note) for r in s.read().collect()} == {(1, (1.0, 2.0), None), (2, (), None)}
    with pytest.raises(Exception, match="has not 2 numbers but 3"):
        s.upsert(rows(spark, [(3, [1.0, 2.0, 3.0])], "id long, vector array<float>"))
    with pytest.raises(ValueError, match="no columns"):
        s.upsert(rows(spark, [(3, "x")], "id long, other string"))
    with pytest.raises(ValueError, match="id is string"):
        s.upsert(rows(spark, [("3", "x")], "id string, note string"))
    assert s.read().count() == 2
    free = PointStore(spark, str(tmp_path), "y")
    free.upsert(rows(spark, [(1, "a")], "id long, v string"))
    free.upsert(rows(spark, [(2, 7)], "id long, n int"))
    assert {tuple(r) for r in free.read().select("id", "v", "n").collect()} == {(1, "a", None), (2, None, 7)}
    with pytest.raises(ValueError, match="no collection"):
        PointStore(spark, str(tmp_path), "z").read()


def test_a_stream_that_runs_a_batch_again(spark, tmp_path):
    source, s = tmp_path / "files", PointStore(spark, str(tmp_path), "points")
    chunk = lambda df: df.select(F.md5("text").alias("id"), "text")
    for part in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(t,) for t in part], "text string").write.mode("append").json(str(source))
        stream = spark.readStream.schema("text string").json(str(source))
        streaming.index_batches(stream, s, chunk, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    files = s.log.read()["files"]
    # the same numbers from a stream that lost its checkpoint
    streaming.index_batches(spark.readStream.schema("text string").json(str(source)), s, chunk, str(tmp_path / "again")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.text for r in s.read().collect()) == ["a", "b", "c"] and s.log.read()["files"] == files
