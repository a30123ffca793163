"""The stored full-text index against scores of the texts, and the log of commits."""

import math
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from heliodor.functions.text import porter
from heliodor.operators.textindex import TextIndex
from heliodor.storage import CommitLog, Conflict


def texts(n=400, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["running", "runs", "nation", "national", "caresses", "on", "a", *(f"w{i}" for i in range(150))]
    return {i * 7: " ".join(rnd.choice(vocabulary[: rnd.choice([9, 60, 157])]) for _ in range(rnd.choice([0, 3, 40, 200]))) for i in range(n)}


def plain(docs, queries, k, allowed=None):
    stem = lambda t: [porter(w) if len(w) >= 3 else w for w in t.split()]
    tf = {i: Counter(stem(t)) for i, t in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(c.total() for c in tf.values()) / len(tf)
    out = []
    for q, text in queries.items():
        scored = []
        for i, c in tf.items():
            if allowed is not None and i not in allowed:
                continue
            score = sum(math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in set(stem(text)) if c[w])
            if score > 0:
                scored.append((-round(score, 4), i))
        out += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


QUERIES = {1: "running nationals w3", 2: "w149 w148 w3 w3", 3: "", 4: "unseen", 5: " ".join(f"w{i}" for i in range(60))}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, f"f{i % 3}") for i, t in docs.items()], "id long, text string, file string").repartition(3)


def got(index, spark, k, **more):
    asked = spark.createDataFrame(list(QUERIES.items()), "query_id long, text string")
    return sorted((r.query_id, r.id, r.score, r.rank) for r in index.search(asked, k, **more).collect())


def same(a, b):
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in sorted(b)]
    assert all(abs(x[2] - y[2]) < 2e-4 for x, y in zip(a, sorted(b), strict=True))


def test_index_of_parts_is_that_of_the_whole(spark, tmp_path):
    docs = texts()
    ids = list(docs)
    parts, whole = TextIndex(spark, str(tmp_path / "parts")), TextIndex(spark, str(tmp_path / "whole"))
    whole.add(frame(spark, docs))
    for a, b in ((0, 150), (150, 151), (151, 400)):
        parts.add(frame(spark, {i: docs[i] for i in ids[a:b]}))
    want = plain(docs, QUERIES, 10)
    same(got(whole, spark, 10), want)
    assert got(parts, spark, 10) == got(whole, spark, 10)
    parts.merge()
    parts.vacuum()
    assert got(parts, spark, 10) == got(whole, spark, 10) and len(parts.folder.names()) == 2
    allowed = {i for i in ids if i % 3}
    only = spark.createDataFrame([(i,) for i in allowed], "id long")
    same(got(whole, spark, 10, only=only), plain(docs, QUERIES, 10, allowed))
    assert {r.file for r in whole.search(spark.createDataFrame([(1, "w3")], "query_id long, text string"), 50, keep=["file"]).collect()} == {"f0", "f1", "f2"}


def test_newer_versions_hide_older_ones(spark, tmp_path):
    docs, newer = texts(200), {i: t for i, t in texts(30, 9).items()}
    index = TextIndex(spark, str(tmp_path / "x"), buckets=5)
    index.add(frame(spark, docs))
    index.add(frame(spark, newer))
    assert index.documents().count() == 200
    want = plain(docs | newer, QUERIES, 15)
    same(got(index, spark, 15), want)
    index.merge()
    assert not index.log.read()["overlaid"]
    same(got(index, spark, 15), want)


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    from heliodor.operators import textindex

    monkeypatch.setattr(textindex, "STRIPE", 20)
    rnd = random.Random(3)
    docs = {i: " ".join(rnd.choice(["rare"] * (i % 97 == 0) + ["common"] * 3 + [f"x{rnd.randrange(500)}"]) for _ in range(rnd.randrange(5, 120))) for i in range(3000)}
    index = TextIndex(spark, str(tmp_path / "x"), "words")
    index.add(frame(spark, docs))
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    blocks, scored = index.skips(asked, 3)
    assert 0 < scored < 0.7 * blocks
    best = index.search(asked, 3).collect()
    assert [r.id for r in sorted(best, key=lambda r: r.rank)] == [i for _, i, _, _ in plain(docs, {1: "rare common"}, 3)]


def test_search_reads_segments_alone(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "x"))
    index.add(frame(spark, texts(50)))
    found = index.search(spark.createDataFrame([(1, "w3")], "query_id long, text string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = plan.split("FileScan parquet")[1:]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*bucket", scan) for scan in scans)
    assert all("/blocks/bucket=" in file for file in found.inputFiles())


def test_empty_index(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "x"))
    assert got(index, spark, 5) == []
    index.add(frame(spark, texts(3)).limit(0))
    assert got(index, spark, 5) == [] and index.documents().count() == 0
    index.add(frame(spark, texts(3)).unionByName(frame(spark, {1: "w3"}).withColumn("id", F.lit(None).cast("long"))))
    assert index.documents().count() == 3
    with pytest.raises(ValueError, match="stems"):
        TextIndex(spark, str(tmp_path / "x"), "words")


def test_of_two_writers_one_makes_a_version(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.commit({"n": 0}, -1) == 0
    with pytest.raises(Conflict):
        log.commit({"n": 9}, -1)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: log.update(lambda state: {"n": state["n"] + 1}, 100), range(12)))
    assert log.read() == {"n": 12} and log.version() == 12 and log.read(3) == {"n": 3}
    assert log.update(lambda state: None) == {"n": 12} and log.version() == 12


def test_scores_of_many_queries_in_bounded_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from heliodor.operators import textindex

    rng = np.random.default_rng(1)
    n_terms, stripes, docs, queries = 200, 10, 100, 100
    held = type("Held", (), {"value": textindex._Asked([(q, f"t{t}", 1.0 + t / 7) for q in range(queries) for t in range(n_terms)])})()
    rows = [(s, f"t{t}", rng.integers(1, 9, docs).astype(np.int32)) for s in range(stripes) for t in range(n_terms)]
    ids = [np.arange(docs) + 1000 * s for s, _, _ in rows]
    columns = {"segment": pa.array([0] * len(rows), pa.int32()), "term": [t for _, t, _ in rows], "stripe": pa.array([s for s, _, _ in rows]), "n": pa.array([docs] * len(rows), pa.int32()), "max_tf": pa.array([int(f.max()) for *_, f in rows], pa.int32()), "min_dl": pa.array([50] * len(rows), pa.int32()), "ids": ids, "tfs": [f for *_, f in rows], "dls": [np.full(docs, 50, np.int32) for _ in rows]}
    batch = pa.RecordBatch.from_pydict(columns)
    run = lambda: [r for b in textindex._scorer(held, 5, 4, 50.0, "bm25", False)(iter([batch])) for r in b.to_pylist()]
    tracemalloc.start()
    try:
        found = run()
        assert tracemalloc.get_traced_memory()[1] < 200e6  # a posting for each query of its term, all at once, takes some 500 MB
    finally:
        tracemalloc.stop()
    assert len(found) == 5 * queries and {r["id"] for r in found[:5]} == {r["id"] for r in found[-5:]}
    monkeypatch.setattr(textindex, "HELD_POSTINGS", 3000)
    assert run() == found
    lists = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3, 4]), "stripe": pa.array([0, 0, 0, 0]), "tokens": pa.array([["a"] * 2000 + ["b"] * 1500, ["b", "a", "b"], None, ["c"] * 4000])})
    made = [(r["id"], r["term"], r["tf"], r["dl"]) for b in textindex._postings(iter([lists])) for r in b.to_pylist()]
    assert sorted(made) == [(1, "a", 2000, 3500), (1, "b", 1500, 3500), (2, "a", 1, 3), (2, "b", 2, 3), (4, "c", 4000, 4000)]
