"""Small functions around plans, metrics and reports."""

from pyspark.sql import functions as F

from heliodor.functions import scalars
from heliodor.operators import metrics, rank, reports


def test_evaluations_from_minus_one(spark):
    reply = "Document 1: score=-0.4, reason=x\nDocument 2: score=-7\nDocument 3: score=0.9"
    rows = spark.createDataFrame([(i, reply) for i in range(1, 5)], "i int, reply string")
    assert [r[0] for r in rows.orderBy("i").select(rank.grade_from_reply(F.col("reply"), F.col("i"), low=-1.0, default=0.0)).collect()] == [-0.4, -1.0, 0.9, 0.0]
    assert [r[0] for r in rows.orderBy("i").select(rank.grade_from_reply(F.col("reply"), F.col("i"))).collect()] == [0.0, 0.0, 0.9, 0.5]


def test_resumed_batches(spark):
    queries = spark.createDataFrame([("1", "who" + "o" * 200), ("2", "what"), ("10", "when"), ("a", "why")], "query_id string, question string")
    done = lambda *rows: spark.createDataFrame(list(rows), "query_id string, question string")
    found = lambda *rows: sorted(r.query_id for r in rank.resume_mismatches(queries, done(*rows)).collect())
    assert found(("1", "who" + "o" * 180), ("2", "other"), ("10", "when")) == []  # 2 stands between the ends
    assert found(("1", "x"), ("10", "when?")) == ["1", "10"] and found(("77", "who")) == ["77"] and found(("2", None)) == [] and found() == []
    assert sorted(r.query_id for r in rank.resume(queries, done(("1", "x"), ("a", "y"))).collect()) == ["10", "2"]


def test_lists_without_a_truth(spark):
    rows = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, [], ["a"]), (3, None, ["a"]), (4, ["a"], None)], "i int, truth array<string>, found array<string>")
    got = {r.i: r.m for r in rows.select("i", metrics.list_prf_if_known(F.col("truth"), F.col("found")).alias("m")).collect()}
    assert got[1].precision == 0.5 and got[1].recall == 1.0 and got[2] is None and got[3] is None and got[4].f1 == 0.0


def test_types_and_scalars(spark):
    notes = spark.createDataFrame([(1, "fact"), (2, ""), (3, None), (1, "fact")], "id long, QA_type string")
    assert [tuple(r) for r in reports.qa_types(notes).collect()] == [("1", "fact")]
    row = spark.createDataFrame([("aGVs\nbG8=", "?", 0.0123456, {"b": 1, "a": 2})], "x string, y string, t double, m map<string,int>")
    got = row.select(scalars.base64_bytes(F.col("x")), scalars.base64_bytes(F.col("y")), scalars.milliseconds(F.col("t")), scalars.sorted_json(F.col("m"))).first()
    assert bytes(got[0]) == b"hello" and got[1] is None and got[2] == 12.35 and got[3] == '{"a":2,"b":1}'
