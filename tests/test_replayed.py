"""Recursive plans against the loops that save each step."""

from pyspark.sql import functions as F

from heliodor import plans
from heliodor.plans import replayed
from heliodor.plans.providers import ReplayGenerator

CHUNKS = [(i, t, 10 + i // 3, 0, i) for i, t in enumerate(["the cat sat on the mat", "a dog ran in the park", "stock prices fell today", "the cat and the dog", "rain fell in the park today", "bread is made of flour", "the mat was made of wool", "prices of flour rose", "a park has trees"])]
QUESTIONS = [(1, "where did the cat sit"), (2, "what fell"), (3, "bread"), (4, "the park"), (5, "wool")]
THOUGHTS = [(1, 0, "The cat likes wool."), (1, 1, "So the answer is: a mat."), (2, 0, "Thus prices fell."), (2, 1, "Rain in the park."), (2, 2, "Trees too."), (3, 0, ""), (4, 0, "Dogs run. They run far."), (4, 1, "Flour rose."), (4, 2, "A mat."), (5, 1, "Never asked.")]


def talk(spark):
    chunks = spark.createDataFrame(CHUNKS, "id long, text string, file_id long, page int, chunk_index int")
    queries = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    replies = spark.createDataFrame([(q, "thought", s, r) for q, s, r in THOUGHTS], "query_id long, stage string, step int, reply string")
    return chunks, queries, replies


def test_interleaved(spark):
    chunks, queries, replies = talk(spark)
    corpus = plans.Corpus(chunks, generator=ReplayGenerator(replies))
    steps = replayed.asks(queries, replies, 3)
    asked = steps.withColumn("own", F.col("query_id") * 10 + F.col("step"))
    hits = corpus.dense(asked.select(F.col("own").alias("query_id"), "ask"), 2, "ask").select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).cast("int").alias("step"), "id", "rank")
    for cap in (15, 4):
        got = {r.query_id: r for r in replayed.interleaved(replayed.with_ids(steps, hits), 3, cap).collect()}
        loop = {}
        for r in plans.interleaved(queries, corpus, 2, 3, cap).orderBy("query_id", "rank").collect():
            loop.setdefault(r.query_id, []).append(r.id)
        assert {q: r.ids for q, r in got.items()} == loop
        assert (got[1].exit, got[1].steps) == ("answer", 2) and (got[3].exit, got[3].steps) == ("empty", 1) and (got[5].exit, got[5].steps) == ("empty", 1)
        assert (got[4].exit, got[4].steps) == (("steps", 3) if cap == 15 else ("cap", len(loop[4]) // 2)) or got[4].exit == "steps"


def test_graded(spark):
    steps = spark.createDataFrame([(1, 0, [4, 5], []), (1, 1, [6, 7], [7]), (1, 2, [8], [8]), (2, 0, [1], [1]), (3, 0, [1, 2, 3], []), (3, 1, [9, 8, 7], []), (3, 2, [6, 5, 4], [])], "query_id long, step int, ids array<long>, good array<long>")
    got = {r.query_id: (r.steps, r.exit, r.ids) for r in replayed.graded(steps, 3, 2).collect()}
    assert got == {1: (2, "relevant", [7]), 2: (1, "relevant", [1]), 3: (3, "rewrites", [6, 5])}


def test_search_loop_and_its_loop_of_steps(spark):
    chunks, queries, _ = talk(spark)
    said = [(1, 0, "<search>cat mat</search>"), (1, 1, "hm"), (1, 2, "ok <answer> mat </answer>"), (2, 0, "<answer></answer>"), (2, 1, "<answer>rain</answer>"), (3, 0, "<search>bread</search>"), (3, 1, "<search>flour</search>"), (3, 2, "<search>x</search>")]
    replies = spark.createDataFrame([(q, "react", s, r) for q, s, r in said], "query_id long, stage string, step int, reply string")
    steps = replies.withColumn("ids", F.array((F.col("query_id") * 10 + F.col("step")).cast("long"), F.lit(7).cast("long")))
    got = {r.query_id: (r.turns, r.exit, r.answer, r.ids) for r in replayed.search_loop(steps, plans.tagged_action(F.col("reply")), 3).collect()}
    assert got == {1: (3, "answer", "mat", [10, 7]), 2: (2, "answer", "rain", []), 3: (3, "turns", None, [30, 7, 31, 32])}
    loop = {r.query_id: (r.answer, r.turns) for r in plans.tagged_loop(queries.where("query_id < 4"), plans.Corpus(chunks, generator=ReplayGenerator(replies)), 3).collect()}
    assert loop == {1: ("mat", 3), 2: ("rain", 2), 3: (None, 3)}


def test_simple_plan_takes_ten_times_the_candidates(spark, tmp_path):
    from heliodor.operators.textindex import TextIndex

    chunks, queries, _ = talk(spark)
    index = TextIndex(spark, str(tmp_path / "x"))
    index.add(chunks.select("id", "text"))
    got = plans.simple(queries, plans.Corpus(chunks, index=index), 3).collect()
    assert {r.query_id for r in got} == {1, 2, 3, 4, 5} and max(r.rank for r in got) == 3
    both = plans.Corpus(chunks, index=index).bm25(queries, 5).orderBy("query_id", "rank").collect()
    assert next(r.id for r in both if r.query_id == 5) == 6


def test_steps_are_made_once(spark):
    """A recursive query made its steps, and so the search behind them, anew for every step."""
    rows = [(q, s, "", "no tag", [q], []) for q in range(3) for s in range(4)]
    steps = spark.createDataFrame(rows, "query_id long, step int, said string, reply string, ids array<long>, good array<long>")
    steps = steps.mapInArrow(lambda batches: batches, steps.schema)
    for walked in (replayed.interleaved(steps, 4), replayed.graded(steps, 4), replayed.search_loop(steps, plans.tagged_action(F.col("reply")), 4)):
        assert "MapInArrow" not in walked._jdf.queryExecution().optimizedPlan().toString()
        assert walked.count() == 3
