"""Plans over stored replies: conversations are the questions and replies, and each ask has a stored vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliodor import plans
from heliodor.operators import rank, search
from heliodor.plans import replayed
from heliodor.queries import load, query

#: Steps of a plan; a question's reply at a step is the conversation's text of that number among its assistant's.
STEPS = 4

_TALK = f"""q AS (SELECT conv_id AS query_id, arg_min(text, turn) AS question FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS step, turn, coalesce(text, '') AS text FROM conversations),
every AS (SELECT query_id, step FROM q, range({STEPS}) AS t(step)),
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM e),
near AS (SELECT query_id, step, p.vec_id AS id, row_number() OVER (PARTITION BY query_id, step ORDER BY round(list_cosine_similarity(a.v, p.v), 6) DESC, p.vec_id) AS rank
  FROM every, n JOIN e a ON a.vec_id = (query_id * 31 + step * 7) % n.n, e p QUALIFY rank <= 6),
h AS (SELECT query_id, step, list(id ORDER BY rank) AS ids FROM near GROUP BY ALL)"""


def _talk(spark, sf_dir):
    """Questions, replies and each step's hits: the six vectors nearest to the one that is stored for it."""
    talks, points = load(spark, sf_dir, "conversations", "embeddings")
    queries = talks.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"))
    place = F.row_number().over(search.Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    replies = talks.select(F.col("conv_id").alias("query_id"), place.alias("step"), "turn", F.coalesce("text", F.lit("")).alias("reply"))
    vectors = points.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    n = vectors.agg(F.count("*").alias("n"))
    every = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    at = (F.col("query_id") * 31 + F.col("step") * 7) % F.col("n")
    # equal vectors are searched once
    placed = every.crossJoin(F.broadcast(n)).withColumn("at", at).drop("n")
    asked = placed.select("at").distinct().join(vectors.withColumnRenamed("id", "at"), "at").select(F.col("at").alias("query_id"), "vector")
    found = search.dense_topk(vectors, asked, 6).select(F.col("query_id").alias("at"), "id", "rank")
    return queries, replies, placed.join(found, "at").select("query_id", "step", "id", "rank")


_ANSWER = "regexp_extract(said, '(?i).*answer is:?\\s*(.*?)\\.', 0) <> ''"


@query(f"""WITH RECURSIVE {_TALK}, s AS (SELECT query_id, step, trim(coalesce(text, '')) AS t FROM every LEFT JOIN r USING (query_id, step)),
w AS (SELECT query_id, step, CASE WHEN length(trim(regexp_extract(t, '^([^.!?]+[.!?])', 1))) > 0 THEN trim(regexp_extract(t, '^([^.!?]+[.!?])', 1)) ELSE left(t, 200) END AS said FROM s),
z AS (SELECT query_id, step, said, coalesce(ids, []) AS ids FROM w LEFT JOIN h USING (query_id, step)),
f(query_id, step, ids, exit) AS (
  SELECT query_id, -1::BIGINT, []::BIGINT[], NULL::VARCHAR FROM q
  UNION ALL
  SELECT f.query_id, z.step, list_concat(f.ids, list_filter(z.ids, lambda x: NOT list_contains(f.ids, x)))[1:12],
    CASE WHEN {_ANSWER} THEN 'answer' WHEN said = '' THEN 'empty' WHEN len(list_distinct(list_concat(f.ids, z.ids))) >= 12 THEN 'cap' WHEN z.step = {STEPS - 1} THEN 'steps' END
  FROM f JOIN z ON z.query_id = f.query_id AND z.step = f.step + 1 WHERE f.exit IS NULL)
SELECT query_id, CAST(step + 1 AS INTEGER) AS steps, exit, array_to_string(ids, ',') AS ids FROM f WHERE exit IS NOT NULL""")
def plan_interleaved(spark, sf_dir):
    queries, replies, hits = _talk(spark, sf_dir)
    steps = replayed.with_ids(replayed.asks(queries, replies, STEPS), hits)
    out = replayed.interleaved(steps, STEPS, 12)
    return out.select("query_id", "steps", "exit", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(f"""WITH RECURSIVE {_TALK}, g AS (SELECT query_id, step, id, rank, 'Document 1: score=0.' || (query_id * 3 + step) % 5 || ', reason=a' || chr(10) || 'Document 3: score=0.' || (query_id + step * 5) % 9 || ', reason=b' || chr(10) || 'Document 4: none' AS reply FROM near),
k AS (SELECT query_id, step, id, rank, coalesce(CAST(nullif(regexp_extract(reply, 'Document ' || rank || ': score=([0-9.]+)', 1), '') AS DOUBLE), 0.4) >= 0.5 AS good FROM g),
z AS (SELECT query_id, step, list(id ORDER BY rank) AS ids, coalesce(list(id ORDER BY rank) FILTER (good), []) AS good FROM k WHERE step < 3 GROUP BY ALL),
f AS (SELECT query_id, step, ids, good FROM z WHERE step = 0 UNION ALL SELECT z.query_id, z.step, z.ids, z.good FROM f JOIN z ON z.query_id = f.query_id AND z.step = f.step + 1 WHERE len(f.good) = 0)
SELECT query_id, CAST(step + 1 AS INTEGER) AS steps, CASE WHEN len(good) > 0 THEN 'relevant' ELSE 'rewrites' END AS exit, array_to_string(CASE WHEN len(good) > 0 THEN good ELSE ids[1:5] END, ',') AS ids FROM f WHERE len(good) > 0 OR step = 2""")
def plan_graded(spark, sf_dir):
    _, _, hits = _talk(spark, sf_dir)
    text = lambda c: c.cast("string")
    q, s = F.col("query_id"), F.col("step")
    reply = F.concat(F.lit("Document 1: score=0."), text((q * 3 + s) % 5), F.lit(", reason=a\nDocument 3: score=0."), text((q + s * 5) % 9), F.lit(", reason=b\nDocument 4: none"))
    named = F.rlike(reply, F.concat(F.lit("Document "), text(F.col("rank")), F.lit(": score=")))
    judged = hits.withColumn("grade", F.when(named, rank.grade_from_reply(reply, F.col("rank"))).otherwise(0.4)).withColumn("good", F.when(F.col("grade") >= 0.5, F.struct("rank", "id")))
    steps = judged.groupBy("query_id", "step").agg(*[F.transform(F.array_sort(F.collect_list(c)), lambda x: x["id"]).alias(name) for c, name in ((F.struct("rank", "id"), "ids"), ("good", "good"))])
    out = replayed.graded(steps, 3)
    return out.select("query_id", "steps", "exit", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


_TAGGED = "CASE WHEN (query_id + step) % 5 = 2 THEN 'so <answer> ' || left(text, 30) || ' </answer>' WHEN (query_id + step) % 7 = 3 THEN 'no tag in ' || text ELSE 'I look: <search>' || left(text, 40) || '</search>' END"


@query(f"""WITH RECURSIVE {_TALK}, s AS (SELECT query_id, step, coalesce(text, '') AS text FROM every LEFT JOIN r USING (query_id, step)), t AS (SELECT query_id, step, {_TAGGED} AS reply FROM s),
a AS (SELECT query_id, step, trim(nullif(regexp_extract(reply, '(?s)<answer>(.*?)</answer>', 1), '')) AS answer, CASE WHEN reply LIKE '%</search>%' AND reply NOT LIKE '%</answer>%' AND reply NOT LIKE '%<search></search>%' THEN ids ELSE [] END AS ids FROM t LEFT JOIN h USING (query_id, step)),
f(query_id, step, ids, answer, exit) AS (
  SELECT query_id, -1::BIGINT, []::BIGINT[], NULL::VARCHAR, NULL::VARCHAR FROM q
  UNION ALL
  SELECT f.query_id, a.step, list_concat(f.ids, list_filter(a.ids, lambda x: NOT list_contains(f.ids, x))), a.answer, CASE WHEN a.answer IS NOT NULL THEN 'answer' WHEN a.step = {STEPS - 1} THEN 'turns' END
  FROM f JOIN a ON a.query_id = f.query_id AND a.step = f.step + 1 WHERE f.exit IS NULL)
SELECT query_id, CAST(step + 1 AS INTEGER) AS turns, exit, answer, array_to_string(ids, ',') AS ids FROM f WHERE exit IS NOT NULL""")
def plan_search_loop(spark, sf_dir):
    queries, replies, hits = _talk(spark, sf_dir)
    every = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    said = every.join(replies.select("query_id", "step", F.col("reply").alias("text")), ["query_id", "step"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    steps = replayed.with_ids(said.withColumn("reply", F.expr(_TAGGED)), hits)
    out = replayed.search_loop(steps, plans.tagged_action(F.col("reply")), STEPS)
    return out.select("query_id", "turns", "exit", "answer", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
