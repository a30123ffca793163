"""Iterative plans over stored replies, as one recursive query each.

Where a model's replies are stored, every question that a loop may come to ask is known before:
the original one, and what each reply makes of it. All of them are retrieved in one
batch, and a recursive query walks each question's steps until it ends and says why. The loops of
the package itself, which save each step, stay for models that are asked as they go.

Steps are written once, below the shared folder: a recursive query makes what it reads anew for every step.
The walk has a row for each step of each question; sessions whose spark.sql.cteRecursionRowLimit is lower have to raise it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliodor.functions import text
from heliodor.storage import written


def asks(queries: DataFrame, replies: DataFrame, steps: int) -> DataFrame:
    """query_id, step, ask, said: what is asked at each step and the first sentence of the reply to it ('' if there is none).

    queries: query_id, question; replies: query_id, step, reply. The next step asks what was said, or the question again where that is reasoning."""
    every = queries.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    said = every.join(replies.select("query_id", "step", "reply"), ["query_id", "step"], "left").withColumn("said", text.first_sentence(F.coalesce("reply", F.lit(""))))
    before = said.select("query_id", (F.col("step") + 1).alias("step"), F.col("said").alias("__said"))
    again = F.col("__said").isNull() | text.is_reasoning(F.col("__said")) | (F.col("__said") == "")
    return said.join(before, ["query_id", "step"], "left").select("query_id", "step", F.when(again, F.col("question")).otherwise(F.col("__said")).alias("ask"), "said")


def with_ids(steps: DataFrame, hits: DataFrame) -> DataFrame:
    """steps with `ids`, those of its hits (query_id, step, id, rank) by rank."""
    listed = hits.groupBy("query_id", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    return steps.join(listed, ["query_id", "step"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def interleaved(steps: DataFrame, most: int = 10, cap: int = 15) -> DataFrame:
    """query_id, steps, exit, ids of retrieval interleaved with thoughts: steps has query_id, step, said, ids.

    exit: `answer` when a thought holds one, `empty` when there is none, `cap` with so many passages, else `steps`. ids: in the order in which they were first seen."""
    spark = steps.sparkSession
    told = written(steps.where(F.col("step") < most).select("query_id", F.col("step").cast("int").alias("step"), "ids", F.when(text.answer_found(F.col("said")).isNotNull(), "answer").when(F.col("said") == "", "empty").alias("ends")), "told")
    out = lambda ids, step: f"coalesce(ends, CASE WHEN size({ids}) >= {cap} THEN 'cap' WHEN {step} = {most - 1} THEN 'steps' END)"
    return spark.sql(
        f"""WITH RECURSIVE walk AS (
              SELECT query_id, step, slice(array_distinct(ids), 1, {cap}) AS ids, {out('array_distinct(ids)', 'step')} AS exit FROM {{told}} WHERE step = 0
              UNION ALL
              SELECT w.query_id, s.step, slice(array_union(w.ids, s.ids), 1, {cap}), {out('array_union(w.ids, s.ids)', 's.step')}
              FROM walk w JOIN {{told}} s ON s.query_id = w.query_id AND s.step = w.step + 1 WHERE w.exit IS NULL)
            SELECT query_id, step + 1 AS steps, exit, ids FROM walk WHERE exit IS NOT NULL""",
        told=told,
    )


def graded(steps: DataFrame, most: int = 2, keep: int = 5) -> DataFrame:
    """query_id, steps, exit, ids of retrieval with grades: steps has query_id, step, ids and `good`, the ids that were graded relevant.

    exit: `relevant` at the first step with one, else `rewrites`, with the first `keep` hits of the last step."""
    spark = steps.sparkSession
    told = written(steps.where(F.col("step") < most).select("query_id", F.col("step").cast("int").alias("step"), "ids", "good"), "told")
    return spark.sql(
        f"""WITH RECURSIVE walk AS (
              SELECT query_id, step, ids, good FROM {{told}} WHERE step = 0
              UNION ALL
              SELECT s.query_id, s.step, s.ids, s.good FROM walk w JOIN {{told}} s ON s.query_id = w.query_id AND s.step = w.step + 1 WHERE size(w.good) = 0)
            SELECT query_id, step + 1 AS steps, CASE WHEN size(good) > 0 THEN 'relevant' ELSE 'rewrites' END AS exit, CASE WHEN size(good) > 0 THEN good ELSE slice(ids, 1, {keep}) END AS ids
            FROM walk WHERE size(good) > 0 OR step = {most - 1}""",
        told=told,
    )


def search_loop(steps: DataFrame, parse: Column, turns: int = 10) -> DataFrame:
    """query_id, turns, exit, answer, ids of a loop that searches or finishes: steps has query_id, step, reply and ids, of what the reply searches.

    parse: struct<action, argument> of a reply, as plans.last_action or plans.tagged_action give it. exit: `answer`, or `turns`; a malformed reply costs its turn."""
    spark = steps.sparkSession
    told = steps.where(F.col("step") < turns).withColumn("act", parse)
    told = written(told.select("query_id", F.col("step").cast("int").alias("step"), F.when(F.col("act.action") == "finish", F.coalesce("act.argument", F.lit(""))).alias("answer"), F.when(F.col("act.action") == "search", F.col("ids")).otherwise(F.array().cast("array<bigint>")).alias("ids")), "told")
    out = lambda step: f"CASE WHEN answer IS NOT NULL THEN 'answer' WHEN {step} = {turns - 1} THEN 'turns' END"
    return spark.sql(
        f"""WITH RECURSIVE walk AS (
              SELECT query_id, step, array_distinct(ids) AS ids, answer, {out('step')} AS exit FROM {{told}} WHERE step = 0
              UNION ALL
              SELECT w.query_id, s.step, array_union(w.ids, s.ids), s.answer, {out('s.step').replace('answer IS', 's.answer IS')}
              FROM walk w JOIN {{told}} s ON s.query_id = w.query_id AND s.step = w.step + 1 WHERE w.exit IS NULL)
            SELECT query_id, step + 1 AS turns, exit, answer, ids FROM walk WHERE exit IS NOT NULL""",
        told=told,
    )
