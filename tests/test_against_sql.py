"""Queries against their SQL on tables where they once differed."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from heliodor import catalog
from heliodor.functions import scalars


def both(spark, folder, name, *tables):
    """Sorted rows of a query and of its SQL over the tables of a folder."""
    sql = duckdb.connect()
    for t in tables:
        sql.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = sql.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in catalog.QUERIES[name](spark, str(folder)).collect()]
    order = lambda rows: sorted(rows, key=lambda r: str(sorted(r.items())))
    return order(got), order(want)


def vectors(spark, folder, x, name="embeddings"):
    rows = [(i, v.tolist(), i % 10) for i, v in enumerate(x.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_human_size_rounds_halves_to_even(spark):
    sizes = [128 * k for k in range(8, 9000)] + [1024**2 * k // 8 for k in range(8, 900)]
    shown = {r.n: r.s for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", scalars.human_size(F.col("n")).alias("s")).collect()}
    assert shown[1152] == "1.12 KB" and shown[1408] == "1.38 KB" and shown[1024**2 * 9 // 8] == "1.12 MB"
    assert shown == {n: f"{n / 1024:.2f} KB" if n < 1024**2 else f"{n / 1024**2:.2f} MB" for n in sizes}


def test_token_similarity_of_a_last_pair_without_a_truth(spark, tmp_path):
    vectors(spark, tmp_path, np.random.default_rng(5).standard_normal((62, 64)))
    got, want = both(spark, tmp_path, "token_similarity", "embeddings")
    assert got == want and len(got) == 3


def test_distinct_users_carry_no_sketches(spark, tmp_path):
    rows = [(i, f"t{i % 3}" if i % 7 else None, i % 211 if i % 5 else None) for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, tmp_path, "distinct_users", "events")
    assert got == want and len(got) == 4
    plan = catalog.QUERIES["distinct_users"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    sketched = [line for line in plan.splitlines() if "Aggregate" in line and "approx_count_distinct" in line]
    assert len(sketched) == 1
    plan = catalog.QUERIES["distinct_users"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "user_id" in line.split("functions=")[0] and "approx_count_distinct" in line]


def test_sparse_scores_move_no_postings(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.4, n) % 60)
    docs = [(i, text(int(rng.integers(1, 40))), "src0") for i in range(500)] + [(7, "w1 w2 w1 only", "src1"), (7, "w1", "src1"), (600, None, "src1"), (601, " .", "src1"), (602, "no word of theirs", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, text(12)) for i in range(30)] + [(30, ""), (31, None), (32, "only w1 ones")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr("heliodor.operators.search.HELD_NUMBERS", 3000)
    for name in ("sparse_ip_topk", "sparse_idf_topk"):
        got, want = both(spark, tmp_path, name, "documents", "benchmark")
        assert got == want and len(got) > 300
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan.split("MapInArrow")[0]
