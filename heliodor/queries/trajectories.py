"""Agent log queries and windows over step records."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliodor import streaming
from heliodor.operators import trajectory
from heliodor.queries import load, query

_SAID = "CASE turn % 4 WHEN 0 THEN '<think>x</think><TOOL>{{\"name\": \"terminal\", \"arguments\": {{\"command\": \"return_txt a/' || conv_id || '.txt\"}}}}</tool>' WHEN 1 THEN '<answer> done ' || conv_id || '</answer>' WHEN 2 THEN 'note {{\"command\": \"grep -n x docs/' || turn || '.md\"}} end' ELSE 'nothing' END".replace("{{", "{").replace("}}", "}")


def _replies(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("reply"))


@query(f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{\"name\": \"terminal\", \"arguments\": {{\"command\": \"return_txt a/' || conv_id || '.txt\"}}}}' WHEN 2 THEN '{{\"command\": \"grep -n x docs/' || turn || '.md\"}}' ELSE '' END AS object FROM conversations")
def first_json_object(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", trajectory.first_json("reply").alias("object"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN ' done ' || conv_id ELSE '' END AS answer, CASE WHEN turn % 4 = 0 THEN 'x' ELSE '' END AS think FROM conversations")
def tag_block(spark, sf_dir):
    r = _replies(spark, sf_dir)
    return r.select("conv_id", "turn", trajectory.tag_block(F.col("reply"), "answer").alias("answer"), trajectory.tag_block(F.col("reply"), "think").alias("think"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'terminal' WHEN 1 THEN 'answer' WHEN 2 THEN 'terminal' ELSE 'error' END AS action, CASE turn % 4 WHEN 0 THEN 'return_txt a/' || conv_id || '.txt' WHEN 1 THEN 'done ' || conv_id WHEN 2 THEN 'grep -n x docs/' || turn || '.md' ELSE 'no tool or answer' END AS argument FROM conversations")
def action_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", trajectory.action("reply").alias("a")).select("conv_id", "turn", "a.*")


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a/' || conv_id || '.txt' WHEN 2 THEN 'docs/' || turn || '.md' ELSE '' END AS files FROM conversations")
def touched_files(spark, sf_dir):
    a = _replies(spark, sf_dir).select("conv_id", "turn", trajectory.action("reply").alias("a"))
    facts = trajectory.command_facts(F.when(F.col("a.action") == "terminal", F.col("a.argument")).otherwise(""))
    return a.select("conv_id", "turn", facts.alias("f")).select("conv_id", "turn", F.array_join("f.files", ",").alias("files"))


_STEPS = "s AS (SELECT user_id AS session, event_id AS step, event_type AS pattern, CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 AS matched FROM events)"


@query(f"""WITH {_STEPS}, c AS (SELECT *, CASE WHEN lag(pattern) OVER w IS NULL OR lag(pattern) OVER w <> pattern OR lag(matched) OVER w OR matched THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY session ORDER BY step)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY step) AS run FROM c), k AS (SELECT *, CASE WHEN NOT matched THEN row_number() OVER (PARTITION BY session, run ORDER BY step) ELSE 0 END AS streak FROM r)
SELECT session, step, pattern, matched, CAST(streak AS INTEGER) AS streak, streak >= 3 AS notice FROM k""")
def no_match_streak(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("pattern"), (F.get_json_object("props", "$.k").cast("long") % 7 == 0).alias("matched"))
    return trajectory.streaks(steps, 3)


_TOKENS = 't AS (SELECT user_id % 20 AS session, event_id AS step, CAST(floor(epoch(ts)) AS BIGINT) AS "at", CAST(json_extract(props, \'$.k\') AS BIGINT) * 3 AS tokens FROM events)'


def _tokens(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("session"), F.col("event_id").alias("step"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (F.get_json_object("props", "$.k").cast("long") * 3).alias("tokens"))


@query(f"""WITH {_TOKENS}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY session ORDER BY "at" RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS used, lead(tokens) OVER (PARTITION BY session ORDER BY "at", step) AS next FROM t)
SELECT session, step, "at", tokens, CAST(used AS BIGINT) AS used, coalesce(used + next > 300, false) AS wait FROM u""")
def rolling_token_budget(spark, sf_dir):
    return trajectory.token_windows(_tokens(spark, sf_dir), 400, 300, 3600)


@query(f"""WITH {_TOKENS}, c AS (SELECT *, first(tokens) OVER (PARTITION BY session ORDER BY step) AS head, sum(tokens) OVER (PARTITION BY session ORDER BY step DESC) AS after, row_number() OVER (PARTITION BY session ORDER BY step) AS n, row_number() OVER (PARTITION BY session ORDER BY step DESC) AS back FROM t)
SELECT session, step AS place, tokens FROM c WHERE n = 1 OR back = 1 OR after + head <= 2000""")
def history_compaction(spark, sf_dir):
    return trajectory.compact_history(_tokens(spark, sf_dir).select("session", F.col("step").alias("place"), "tokens"), 2000)


@query("""WITH RECURSIVE t AS (SELECT conv_id AS session, turn AS place, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
f(session, i, place, chunk, used) AS (
  SELECT session, 1, place, 0, size FROM t WHERE i = 1
  UNION ALL
  SELECT f.session, t.i, t.place, f.chunk + CASE WHEN f.used > 0 AND f.used + t.size > 1500 THEN 1 ELSE 0 END, CASE WHEN f.used > 0 AND f.used + t.size > 1500 THEN t.size ELSE f.used + t.size END
  FROM f JOIN t ON t.session = f.session AND t.i = f.i + 1)
SELECT session, CAST(place AS BIGINT) AS place, chunk, 1 + max(chunk) OVER (PARTITION BY session) AS total, chunk < max(chunk) OVER (PARTITION BY session) AS has_more FROM f""")
def output_slices(spark, sf_dir):
    items = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("place"), F.length("text").cast("long").alias("size"))
    return trajectory.fit_slices(items, 1500)


_B64 = "left(text, 20) || repeat('QUJD', 200) || ' ' || text"


@query("SELECT conv_id, turn, md5(CASE WHEN length(s) > 400 THEN left(s, 400) || '...' ELSE s END) AS out FROM (SELECT conv_id, turn, 'x ' || '<base64:800 chars>' || ' ' || text AS s FROM conversations)")
def output_compaction(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("x "), F.repeat(F.lit("QUJD"), F.lit(200)), F.lit(" "), "text").alias("s"))
    return c.select("conv_id", "turn", F.md5(trajectory.compact_output(F.col("s"), 400)).alias("out"))


@query("SELECT event_id, CASE WHEN 3000 - k * 30 - 200 <= 64 THEN 800 ELSE greatest(800, least(9000, CAST(trunc((3000 - k * 30 - 200) * 3.8) AS INTEGER))) END AS budget FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def output_budget(spark, sf_dir):
    used = F.get_json_object("props", "$.k").cast("long") * 30
    return load(spark, sf_dir, "events").select("event_id", trajectory.output_budget(used, 3000, 200, 9000).alias("budget"))


@query("""WITH s AS (SELECT user_id AS session, event_id AS step, event_type AS command, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS chunk FROM events)
SELECT session, step, command, CAST(chunk AS INTEGER) AS chunk, CASE WHEN chunk < 3 THEN command || '#' || chunk END AS content, chunk >= 3 AS complete FROM s""")
def paged_output(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.col("event_type").alias("command"))
    chunks = e.select(F.col("event_type").alias("command")).distinct().withColumn("chunk", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("content", F.concat("command", F.lit("#"), F.col("chunk").cast("string")))
    return trajectory.page_sessions(steps, chunks)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.tumbling(e, "1 day", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) - CAST(i AS INTEGER) * INTERVAL 6 HOUR AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) AS t(i) GROUP BY 1")
def sliding_window(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sliding(e, "24 hours", "6 hours").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""")
def session_window(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))
