"""Evaluation, report and difficulty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliodor.functions import scalars
from heliodor.operators import metrics, quantiles, reports
from heliodor.queries import load, query
from heliodor.storage import written


def _lists(spark, sf_dir):
    """Of each order: suppliers of its lines as truth, parts' suppliers in the same numbering as found."""
    lines = load(spark, sf_dir, "lineitem")
    truth = F.array_sort(F.collect_set((F.col("l_suppkey") % 12).cast("string")))
    found = F.array_sort(F.collect_set(F.when(F.col("l_linenumber") > 1, (F.col("l_partkey") % 12).cast("string"))))
    return lines.groupBy("l_orderkey").agg(truth.alias("truth"), found.alias("found"))


_LISTS = """lists AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_suppkey % 12 AS VARCHAR)))) AS truth, list_sort(list_distinct(coalesce(list(CAST(l_partkey % 12 AS VARCHAR)) FILTER (l_linenumber > 1), []))) AS found FROM lineitem GROUP BY l_orderkey),
prf AS (SELECT l_orderkey, truth, found, len(list_intersect(truth, found)) AS hit, CASE WHEN len(found) = 0 THEN 0.0 ELSE len(list_intersect(truth, found)) / len(found) END AS p, CASE WHEN len(truth) = 0 THEN 0.0 ELSE len(list_intersect(truth, found)) / len(truth) END AS r FROM lists),
m AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM prf)"""


@query(f"WITH {_LISTS} SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM m")
def file_list_prf(spark, sf_dir):
    out = _lists(spark, sf_dir).select("l_orderkey", metrics.list_prf(F.col("truth"), F.col("found")).alias("m"))
    return out.select("l_orderkey", *[F.round(f"m.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_LISTS} SELECT 'skip' AS policy, count(*) FILTER (len(found) > 0) AS n, round(avg(p) FILTER (len(found) > 0), 6) AS precision, round(avg(r) FILTER (len(found) > 0), 6) AS recall, round(avg(f) FILTER (len(found) > 0), 6) AS f1 FROM m UNION ALL SELECT 'count', count(*), round(avg(p), 6), round(avg(r), 6), round(avg(f), 6) FROM m")
def file_list_batch(spark, sf_dir):
    # Both policies on empty lists; here the side that may be empty is the truth.
    rows = _lists(spark, sf_dir).select(F.col("found").alias("truth"), F.col("truth").alias("found"))
    both = [metrics.list_batch(rows, skip).select(F.lit(name).alias("policy"), "n", F.round("recall", 6).alias("precision"), F.round("precision", 6).alias("recall"), F.round("f1", 6).alias("f1")) for name, skip in (("skip", "empty"), ("count", "null"))]
    return both[0].unionByName(both[1])


@query(f"WITH {_LISTS}, h AS (SELECT l_orderkey, list_min(list_filter(list_transform(range(1, len(found) + 1), lambda i: CASE WHEN list_contains(truth, found[i]) THEN i END), lambda x: x IS NOT NULL)) AS i FROM m) SELECT l_orderkey, coalesce(round(1.0 / i, 6), 0.0) AS rr FROM h")
def retrieval_mrr(spark, sf_dir):
    return _lists(spark, sf_dir).select("l_orderkey", F.round(metrics.reciprocal_rank(F.col("truth"), F.col("found")), 6).alias("rr"))


@query("""WITH c AS (SELECT l_orderkey, list(CAST(l_suppkey AS VARCHAR)) AS a, list('p' || (l_partkey % 5)) AS b FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, list_distinct(list_concat(a, b)) AS s FROM c)
SELECT l_orderkey, len(s) AS n, round(len(list_intersect(s, ['p1', 'p3', '7'])) / len(s), 6) AS precision, round(len(list_intersect(s, ['p1', 'p3', '7'])) / 3.0, 6) AS recall FROM s""")
def retrieval_prf(spark, sf_dir):
    chunk = F.struct(F.col("l_suppkey").cast("string").alias("source_id"), F.concat(F.lit(" p"), (F.col("l_partkey") % 5).cast("string")).alias("file_path"), F.lit("").alias("file_id"))
    s = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(metrics.sources(F.collect_list(chunk)).alias("s"))
    m = metrics.list_prf(F.array(F.lit("p1"), F.lit("p3"), F.lit("7")), F.col("s"))
    return s.select("l_orderkey", F.size("s").cast("long").alias("n"), m.alias("m")).select("l_orderkey", "n", F.round("m.precision", 6).alias("precision"), F.round("m.recall", 6).alias("recall"))


def _judged(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents", "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("query_id"), "lang", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("pred"), (F.col("quality") * 3 + F.col("toxic") + F.col("doc_id") % 2).cast("double").alias("score"), ((F.col("n_chars") % 977) - 40).cast("double").alias("latency"))


_JUDGED = "j AS (SELECT doc_id AS query_id, lang, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS pred, CAST(quality * 3 + toxic + doc_id % 2 AS DOUBLE) AS score, CAST(n_chars % 977 - 40 AS DOUBLE) AS latency FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_JUDGED} SELECT count(*) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, count(*) FILTER (pred = 'yes') AS yes, count(*) FILTER (pred = 'no') AS no, round(count(*) FILTER (pred = 'yes') / count(*), 6) AS pass_rate, round(avg(latency) FILTER (latency > 0), 6) AS latency FROM j")
def judge_aggregate(spark, sf_dir):
    out = reports.judge_summary(_judged(spark, sf_dir))
    return out.select("n", F.round("mean", 6).alias("mean"), "min", "max", "yes", "no", F.round("pass_rate", 6).alias("pass_rate"), F.round("latency", 6).alias("latency"))


@query(f"WITH {_JUDGED} SELECT CASE WHEN lang = 'en' THEN 'unknown' ELSE lang END AS qa_type, count(*) AS total, count(*) FILTER (pred = 'yes') AS yes, round(count(*) FILTER (pred = 'yes') / count(*), 4) AS accuracy, round(avg(score), 4) AS mean_score, round(avg(score / 5), 4) AS precision, round(avg(score / 6), 4) AS recall, round(avg(score / 7), 4) AS f1, round(avg(latency), 2) AS latency FROM j GROUP BY 1")
def qa_type_breakdown(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    types = judged.where("lang <> 'en'").select("query_id", F.col("lang").alias("qa_type"))
    rows = judged.select("query_id", "pred", "score", "latency", (F.col("score") / 5).alias("precision"), (F.col("score") / 6).alias("recall"), (F.col("score") / 7).alias("f1"))
    return reports.type_breakdown(rows, types)


@query(f"WITH {_JUDGED}, s AS (SELECT 'score' AS metric, score FROM j UNION ALL SELECT 'latency', latency FROM j) SELECT metric, count(score) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max FROM s GROUP BY metric")
def metric_summary(spark, sf_dir):
    j = _judged(spark, sf_dir)
    each = j.select(F.lit("score").alias("metric"), "score").unionByName(j.select(F.lit("latency").alias("metric"), F.col("latency").alias("score")))
    return reports.metric_summary(each).withColumn("mean", F.round("mean", 6))


@query("WITH e AS (SELECT event_type || '_ms' AS key, value FROM events UNION ALL SELECT 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events) SELECT key, count(*) AS n, round(avg(value), 4) AS mean FROM e WHERE value IS NOT NULL GROUP BY key")
def map_mean_latency(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    entries = F.create_map(F.concat("event_type", F.lit("_ms")), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    return reports.map_means(events.select(entries.alias("m")), "m").withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_stats(spark, sf_dir):
    out = reports.latency_stats(load(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def json_props_group(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _features(spark, sf_dir):
    docs, items = load(spark, sf_dir, "documents", "benchmark")
    n = items.agg(F.count("*").alias("n"))
    joined = docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(items.withColumnRenamed("text", "truth"), "item_id")
    d = F.col("doc_id")
    return joined.select(
        "doc_id", "lang", (1 + d % 5).cast("double").alias("evidence_files"), (1 + d % 3).cast("double").alias("modality_count"), (1 + d % 4).cast("double").alias("file_type_count"), (1 + d % 7).cast("double").alias("evidence_items"),
        (d % 9).cast("double").alias("reasoning_steps"), scalars.token_count(F.col("truth")).cast("double").alias("question_tokens"), scalars.token_count(F.col("text")).cast("double").alias("answer_tokens"), ((d * 37) % 400).cast("double").alias("time_span_days"),
    )


_TOKENS = "CAST(len(regexp_extract_all({0}, '([A-Za-z0-9_]+|[一-鿿])', 1)) AS DOUBLE)"
_FEATURES = f"""f AS (SELECT doc_id, lang, CAST(1 + doc_id % 5 AS DOUBLE) AS evidence_files, CAST(1 + doc_id % 3 AS DOUBLE) AS modality_count, CAST(1 + doc_id % 4 AS DOUBLE) AS file_type_count, CAST(1 + doc_id % 7 AS DOUBLE) AS evidence_items,
CAST(doc_id % 9 AS DOUBLE) AS reasoning_steps, {_TOKENS.format('b.text')} AS question_tokens, {_TOKENS.format('d.text')} AS answer_tokens, CAST((doc_id * 37) % 400 AS DOUBLE) AS time_span_days
FROM documents d, (SELECT count(*) AS n FROM benchmark) c JOIN benchmark b ON b.item_id = d.doc_id % c.n)"""
_P = ", ".join(f"quantile_cont({k}, 0.9) AS a_{k}, quantile_cont({k}, 0.98) AS b_{k}" for k in reports.WEIGHTS)
_G = ", ".join(f"CASE WHEN a_{k} <= 0 THEN 1.0 ELSE a_{k} END AS {k}_p90, CASE WHEN b_{k} <= 0 THEN CASE WHEN a_{k} <= 0 THEN 1.0 ELSE a_{k} END ELSE b_{k} END AS {k}_p98" for k in reports.WEIGHTS)
_N = ", ".join(f"greatest(0.0, least(ln(1 + {k}) / ln(1 + {k}_p90), greatest(1.0, ln(1 + {k}_p98) / ln(1 + {k}_p90)) + 0.25)) AS n_{k}" for k in reports.WEIGHTS)
_RAW = " + ".join([f"{w} * n_{k}" for k, w in reports.WEIGHTS.items()] + [f"{w} * sqrt(n_{a} * n_{b})" for w, a, b in reports.INTERACTIONS])
_HARD = " + ".join(f"CAST(n_{k} >= 0.85 AS INTEGER)" for k in reports.HARD)
_DIFFICULTY = f"""{_FEATURES}, p AS (SELECT {_P} FROM f), g AS (SELECT {_G} FROM p), n AS (SELECT doc_id, lang, {_N} FROM f, g),
r AS (SELECT doc_id, lang, {_RAW} + CASE WHEN {_HARD} >= 3 THEN 0.08 WHEN {_HARD} >= 2 THEN 0.05 ELSE 0.0 END + CASE WHEN n_question_tokens >= 0.9 AND n_answer_tokens >= 0.9 THEN 0.02 ELSE 0.0 END AS raw FROM n),
d AS (SELECT doc_id, lang, round(greatest(1.0, least(99.0, 100 / (1 + exp(-4.4 * (raw - 0.70))))), 4) AS difficulty FROM r)"""


def _difficulty(spark, sf_dir):
    return reports.difficulty(_features(spark, sf_dir)).select("doc_id", "lang", F.round("difficulty", 4).alias("difficulty"))


@query(f"WITH {_FEATURES} SELECT * FROM f")
def difficulty_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query(f"WITH {_FEATURES}, p AS (SELECT {_P} FROM f), g AS (SELECT {_G} FROM p) SELECT {', '.join(f'round({k}_{p}, 6) AS {k}_{p}' for k in reports.WEIGHTS for p in ('p90', 'p98'))} FROM g")
def difficulty_percentiles(spark, sf_dir):
    out = reports.feature_stats(_features(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {_DIFFICULTY} SELECT * FROM d")
def difficulty_score(spark, sf_dir):
    return _difficulty(spark, sf_dir)


@query(f"WITH {_DIFFICULTY}, h AS (SELECT least(CAST(floor(difficulty / 5) AS BIGINT), 19) AS bin, count(*) AS n FROM d GROUP BY 1) SELECT b AS bin, coalesce(n, 0) AS n FROM range(20) AS t(b) LEFT JOIN h ON h.bin = b")
def difficulty_hist(spark, sf_dir):
    return reports.histogram(_difficulty(spark, sf_dir), "difficulty")


@query(f"WITH {_DIFFICULTY}, j AS (SELECT doc_id, difficulty, CAST(quality * 3 + toxic AS DOUBLE) AS score FROM d JOIN labels USING (doc_id)) SELECT floor(difficulty / 5) * 5 + 2.5 AS center, count(*) AS n, round(avg(score), 6) AS mean FROM j GROUP BY 1")
def difficulty_vs_score_bins(spark, sf_dir):
    d = _difficulty(spark, sf_dir).withColumn("place", F.lit(0))
    results = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), (F.col("quality") * 3 + F.col("toxic")).cast("double").alias("score"))
    # Even ids are found by id, odd ones by their question.
    by_id = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), "place", "difficulty")
    by_text = d.where("doc_id % 2 = 1").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question"), "place", "difficulty")
    return reports.binned_mean(reports.fallback_join(results, by_id, by_text)).withColumn("mean", F.round("mean", 6))


@query("WITH c AS (SELECT source, doc_id % 40 AS b, count(*) AS n FROM documents GROUP BY 1, 2), q AS (SELECT CAST(ceil(quantile_cont(n, 0.9)) AS BIGINT) AS c FROM c) SELECT CASE WHEN n <= c THEN CAST(n AS VARCHAR) ELSE '>' || c END AS bin, count(*) AS n FROM c, q GROUP BY 1")
def tail_merged_counter(spark, sf_dir):
    counts = load(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 40).alias("b")).agg(F.count("*").alias("size"))
    return reports.tail_merged(counts, "size", 0.9)


@query(f"WITH {_DIFFICULTY} SELECT lang, count(*) AS n, round(avg(difficulty), 4) AS mean, round(quantile_cont(difficulty, 0.5), 4) AS median, round(avg(CAST(difficulty >= 70 AS INTEGER)), 6) AS hard_share FROM d GROUP BY ROLLUP (lang)")
def profile_rollup(spark, sf_dir):
    out = reports.summary_line(_difficulty(spark, sf_dir), "lang")
    return out.select("lang", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("hard_share", 6).alias("hard_share"))


@query("""WITH p AS (SELECT doc_id AS id, 'd' || (doc_id % 30) || '/f' || (doc_id % 90) AS path FROM documents), m AS (SELECT 'd' || (event_id % 30) || '/f' || (event_id % 60) AS path, ts FROM events),
e AS (SELECT path, min(ts) AS lo, max(ts) AS hi, count(ts) AS n FROM m GROUP BY 1), b AS (SELECT split_part(path, '/', 2) AS base, min(ts) AS lo, max(ts) AS hi, count(ts) AS n FROM m GROUP BY 1),
j AS (SELECT id, CASE WHEN e.n IS NOT NULL THEN e.lo ELSE b.lo END AS lo, CASE WHEN e.n IS NOT NULL THEN e.hi ELSE b.hi END AS hi, coalesce(e.n, b.n, 0) AS n FROM p LEFT JOIN e USING (path) LEFT JOIN b ON b.base = split_part(path, '/', 2))
SELECT id, CASE WHEN n >= 2 THEN round(CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) / 86400000000, 6) ELSE 0.0 END AS days FROM j""")
def time_span_days(spark, sf_dir):
    docs, events = load(spark, sf_dir, "documents", "events")
    path = lambda c, a, b: F.concat(F.lit("d"), (F.col(c) % a).cast("string"), F.lit("/f"), (F.col(c) % b).cast("string"))
    out = reports.time_spans(docs.select(F.col("doc_id").alias("id"), path("doc_id", 30, 90).alias("path")), events.select(path("event_id", 30, 60).alias("path"), "ts"))
    return out.withColumn("days", F.round("days", 6))


_EXT = "CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'png' WHEN 3 THEN 'mp3' ELSE 'tar' END"


@query(f"WITH f AS (SELECT {_EXT} AS ext, CAST(length(html) AS BIGINT) AS bytes FROM pages), m AS (SELECT ext, CASE ext WHEN 'pdf' THEN 'Documents' WHEN 'txt' THEN 'Text' WHEN 'png' THEN 'Images' WHEN 'mp3' THEN 'Audio' END AS modality, bytes FROM f) SELECT modality, ext, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM m WHERE modality IS NOT NULL GROUP BY 1, 2")
def size_by_extension(spark, sf_dir):
    f = load(spark, sf_dir, "pages").select(F.expr(_EXT).alias("ext"), F.length("html").cast("long").alias("bytes"))
    return reports.sizes(f.withColumn("modality", scalars.modality(F.col("ext"))))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_report(spark, sf_dir):
    return reports.months(load(spark, sf_dir, "orders"), "o_orderdate")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_type, round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, min(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS low, max(value) FILTER (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS high, count(*) AS n FROM events JOIN q USING (event_type) GROUP BY event_type""")
def boxplot_stats(spark, sf_dir):
    out = reports.box_plot(load(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "low", "high", "n")


@query("""SELECT CAST(year(ts) AS INTEGER) AS year, event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY ALL""")
def sketch_year(spark, sf_dir):
    """Sketches of each month, stored, then merged into years: whether the distinct users are within 5 % of the exact count, and the median's rank within 3 % of the middle."""
    events = load(spark, sf_dir, "events").withColumn("month", F.trunc(F.col("ts").cast("date"), "month"))
    months = written(quantiles.sketched(events, "month", "event_type", distinct="user_id", value="value"), "month-sketches")
    years = quantiles.merged(months.withColumn("year", F.year("month")), "year", "event_type")
    told = years.select("year", "event_type", "n", quantiles.sketch_count(F.col("users")).alias("about"), quantiles.sketch_quantile("values", 0.5).alias("middle"))
    exact = events.withColumn("year", F.year("month")).join(F.broadcast(told.select("year", "event_type", "middle")), ["year", "event_type"])
    exact = exact.groupBy("year", "event_type").agg(F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= F.col("middle")).cast("double")).alias("rank"))
    near = (F.abs(F.col("about") - F.col("users")) <= 0.05 * F.col("users")).alias("users_near")
    return told.join(exact, ["year", "event_type"]).select("year", "event_type", "n", "users", near, (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_near"))


@query("""WITH d AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders)
SELECT o_orderkey, round(greatest(0.0, least(1.0, CASE WHEN d <= 1500 THEN d / 1500 * 0.3 ELSE 0.3 + (d - 1500) / 1100 * 0.7 END)), 6) AS x FROM d""")
def piecewise_time_scale(spark, sf_dir):
    d = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    x = scalars.piecewise_year(d, F.lit(1500.0), F.lit(2600.0), F.lit(0.0), 0.3)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(x, 6).alias("x"))


@query()
def impute_dates(spark, sf_dir):
    paths = load(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.concat("source", F.lit("/"))).otherwise(F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path")).distinct()
    return reports.impute_dates(paths.withColumn("created", F.lit(None).cast("timestamp")))
