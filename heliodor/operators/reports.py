"""Grouped reports, question difficulty and file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliodor.functions.scalars import f1, log_scaled, ratio
from heliodor.operators.quantiles import quantile_columns, quantiles
from heliodor.storage import written

# Features of a question, their weights, and how they interact.
WEIGHTS = {"evidence_files": 0.19, "modality_count": 0.10, "file_type_count": 0.08, "evidence_items": 0.18, "reasoning_steps": 0.20, "question_tokens": 0.10, "answer_tokens": 0.07, "time_span_days": 0.08}
INTERACTIONS = ((0.10, "evidence_files", "reasoning_steps"), (0.07, "modality_count", "file_type_count"), (0.06, "evidence_items", "time_span_days"))
HARD, HARD_AT, LONG_AT = ("evidence_files", "evidence_items", "reasoning_steps"), 0.85, 0.90
SLOPE, MIDDLE = 4.4, 0.70


def metric_summary(scores: DataFrame) -> DataFrame:
    """metric, n, mean, min, max of (metric, score)."""
    return scores.groupBy("metric").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))


def judge_summary(judged: DataFrame) -> DataFrame:
    """n, mean, min, max, yes, no, pass_rate and the mean of positive latencies of (pred, score, latency)."""
    yes, no = F.count_if(F.col("pred") == "yes"), F.count_if(F.col("pred") == "no")
    return judged.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), yes.alias("yes"), no.alias("no"), ratio(yes, yes + no).alias("pass_rate"), F.coalesce(F.avg(F.when(F.col("latency") > 0, F.col("latency"))), F.lit(0.0)).alias("latency"))


def map_means(rows: DataFrame, column: str) -> DataFrame:
    """key, n, mean over the entries of a map column."""
    return rows.select(F.explode(column).alias("key", "value")).where("value IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def latency_stats(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    c = F.col(column)
    return rows.where(c.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


def type_breakdown(results: DataFrame, types: DataFrame) -> DataFrame:
    """Per question type: totals, accuracy, mean score, list metrics and latency; unknown types are `unknown`."""
    joined = results.join(types, "query_id", "left").withColumn("qa_type", F.coalesce("qa_type", F.lit("unknown")))
    yes, no = F.count_if(F.col("pred") == "yes"), F.count_if(F.col("pred") == "no")
    return joined.groupBy("qa_type").agg(
        F.count("*").alias("total"), yes.alias("yes"), F.round(ratio(yes, yes + no), 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("mean_score"),
        *[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")], F.round(F.avg("latency"), 2).alias("latency"),
    )


def first_bench(rows: DataFrame) -> DataFrame:
    """The first non-empty bench name, lower-cased, by place."""
    return rows.where(F.trim("bench") != "").agg(F.lower(F.min_by("bench", "place")).alias("bench"))


def time_spans(paths: DataFrame, meta: DataFrame) -> DataFrame:
    """id, days between the first and last date of its paths: by exact path, else by base name; under two dates 0.

    paths: id, path; meta: path, ts."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    stats = lambda df, key: df.groupBy(key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("ts").alias("n"))
    exact = stats(meta, "path").select("path", F.struct("lo", "hi", "n").alias("exact"))
    named = stats(meta.withColumn("base", base(F.col("path"))), "base").select("base", F.struct("lo", "hi", "n").alias("named"))
    met = paths.join(exact, "path", "left").withColumn("base", base(F.col("path"))).join(named, "base", "left").withColumn("s", F.coalesce("exact", "named"))
    out = met.groupBy("id").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi"), F.coalesce(F.sum("s.n"), F.lit(0)).alias("n"))
    days = (F.unix_micros(F.col("hi").cast("timestamp")) - F.unix_micros(F.col("lo").cast("timestamp"))) / 86_400_000_000
    return out.select("id", F.when(F.col("n") >= 2, days).otherwise(0.0).alias("days"))


def feature_stats(features: DataFrame, keys: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """One row: p90 and p98 of each feature (exact, interpolated), guarded against zeros. All features are selected from counted values at once."""
    long = features.select(*(F.col(k).cast("double").alias(k) for k in keys)).unpivot([], list(keys), "feature", "v")
    found = quantiles(long, "v", [0.9, 0.98], "feature")
    at = lambda k, p: F.max(F.when((F.col("feature") == k) & (F.col("prob") == p), F.col("quantile")))
    raw = found.agg(*[F.array(at(k, 0.9), at(k, 0.98)).alias(k) for k in keys])
    p90 = lambda k: F.when(F.col(k)[0] <= 0, 1.0).otherwise(F.col(k)[0])
    return raw.select(*[x for k in keys for x in (p90(k).alias(f"{k}_p90"), F.when(F.col(k)[1] <= 0, p90(k)).otherwise(F.col(k)[1]).alias(f"{k}_p98"))])


def difficulty(features: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """features with `difficulty`, 1 to 99."""
    if stats is None:
        features = written(features, "features")  # made once, for the statistics and the scores
        stats = feature_stats(features)
    both = features.crossJoin(F.broadcast(stats))  # one row
    n = {k: F.col(f"__{k}") for k in WEIGHTS}
    both = both.select(*features.columns, *[log_scaled(F.col(k).cast("double"), F.col(f"{k}_p90"), F.col(f"{k}_p98")).alias(f"__{k}") for k in WEIGHTS])
    raw = sum((w * n[k] for k, w in WEIGHTS.items()), F.lit(0.0)) + sum((w * F.sqrt(n[a] * n[b]) for w, a, b in INTERACTIONS), F.lit(0.0))
    hard = sum(((n[k] >= HARD_AT).cast("int") for k in HARD), F.lit(0))
    raw = raw + F.when(hard >= 3, 0.08).when(hard >= 2, 0.05).otherwise(0.0) + F.when((n["question_tokens"] >= LONG_AT) & (n["answer_tokens"] >= LONG_AT), 0.02).otherwise(0.0)
    score = 100 / (1 + F.exp(-SLOPE * (raw - MIDDLE)))
    return both.select(*features.columns, F.greatest(F.lit(1.0), F.least(F.lit(99.0), score)).alias("difficulty"))


def qa_types(annotations: DataFrame) -> DataFrame:
    """query_id, qa_type of annotations (id, QA_type) that have a type; of a repeated id the last by type."""
    return annotations.where("QA_type IS NOT NULL AND QA_type <> ''").groupBy(F.col("id").cast("string").alias("query_id")).agg(F.max("QA_type").alias("qa_type"))


def histogram(values: DataFrame, column: str, width: float = 5, low: float = 0, high: float = 100) -> DataFrame:
    """bin, n: all bins of [low, high], the last with its upper edge."""
    bins = int((high - low) / width)
    found = values.where(F.col(column).between(low, high)).groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary_line(rows: DataFrame, *keys: str) -> DataFrame:
    """n, mean, median, share of 70 and more, by the keys and overall (null keys)."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.avg("difficulty").alias("mean"), F.percentile("difficulty", 0.5).alias("median"), F.avg((F.col("difficulty") >= 70).cast("double")).alias("hard_share"))


def tail_merged(rows: DataFrame, column: str, quantile: float = 0.95) -> DataFrame:
    """bin, n: values up to the ceiling of the quantile as they are, the rest as one bin."""
    cutoff = quantile_columns(rows, column, {"q": quantile}).select(F.ceil("q").alias("cutoff"))
    bin_ = F.when(F.col(column) <= F.col("cutoff"), F.col(column).cast("long").cast("string")).otherwise(F.concat(F.lit(">"), F.col("cutoff").cast("string")))
    return rows.crossJoin(F.broadcast(cutoff)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def fallback_join(results: DataFrame, by_id: DataFrame, by_text: DataFrame) -> DataFrame:
    """results (query_id, question, score) with the difficulty of their id, else of their question; without either they go.

    by_id: query_id, place, difficulty; by_text: question, place, difficulty; of repeated keys the last place holds."""
    last = lambda df, key, name: df.groupBy(key).agg(F.max_by("difficulty", "place").alias(name))
    out = results.join(last(by_id, "query_id", "d1"), "query_id", "left").join(last(by_text, "question", "d2"), "question", "left")
    return out.withColumn("difficulty", F.coalesce("d1", "d2")).where("difficulty IS NOT NULL").drop("d1", "d2")


def binned_mean(rows: DataFrame, width: float = 5) -> DataFrame:
    """center, n, mean of scores in [low, low + width) bins of difficulty."""
    return rows.groupBy((F.floor(F.col("difficulty") / width) * width + width / 2).alias("center")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def sizes(files: DataFrame) -> DataFrame:
    """modality, ext, n, bytes of files (ext, modality, bytes)."""
    return files.where("modality IS NOT NULL").groupBy("modality", "ext").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def months(rows: DataFrame, ts: str) -> DataFrame:
    return rows.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def box_plot(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """q1, median, q3, and whiskers: the extreme values within 1.5 interquartile ranges."""
    q = quantile_columns(rows, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *keys).select(*keys, F.array("q1", "median", "q3").alias("q"))
    span = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = F.col(value).between(F.col("q")[0] - span, F.col("q")[2] + span)
    joined = rows.join(F.broadcast(q), list(keys)) if keys else rows.crossJoin(F.broadcast(q))
    return joined.groupBy(*keys).agg(F.first("q").alias("q"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count("*").alias("n")).select(*keys, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "low", "high", "n")


def impute_dates(files: DataFrame, salt: int = 0) -> DataFrame:
    """files (path, created) with missing dates filled: folders first, then files later than their top folder.

    Dates follow from a hash of the path, so runs agree; hours stay within 8 to 22, years up to 2025."""
    from heliodor.functions.scalars import is_folder, top_folder

    draw = lambda n, k: F.pmod(F.xxhash64("path", F.lit(salt), F.lit(k)), F.lit(n)).cast("int")
    at = lambda days: (F.timestamp_seconds(F.unix_seconds(days) + (8 + draw(14, 2)) * 3600 + draw(3600, 3))).cast("timestamp")
    start, end = F.lit("2015-01-01").cast("timestamp"), F.lit("2025-12-31").cast("timestamp")
    days_after = lambda base, n: F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", base)) + n * 86400)
    folders = files.where(is_folder(F.col("path"))).withColumn("filled", F.coalesce("created", at(days_after(start, draw(3650, 1)))))
    tops = folders.groupBy(top_folder(F.regexp_replace("path", "/$", "")).alias("top")).agg(F.min("filled").alias("top_date"))
    rest = files.where(~is_folder(F.col("path"))).withColumn("top", top_folder(F.col("path"))).join(tops, "top", "left")
    base = F.coalesce("top_date", start)
    later = at(days_after(base, 1 + F.pmod(draw(1 << 30, 1), F.greatest(F.lit(1), F.datediff(end, base) - 1))))
    return folders.select("path", "filled").unionByName(rest.select("path", F.coalesce("created", F.least(later, at(end))).alias("filled")))


def grouped_prf(rows: DataFrame, *keys: str) -> DataFrame:
    """Micro precision, recall and F1 by keys of (hit, n_found, n_truth)."""
    s = rows.groupBy(*keys).agg(F.sum("hit").alias("hit"), F.sum("n_found").alias("n_found"), F.sum("n_truth").alias("n_truth"))
    p, r = ratio(F.col("hit"), F.col("n_found")), ratio(F.col("hit"), F.col("n_truth"))
    return s.select(*keys, p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def latest_by(rows: DataFrame, key: str | Column, order: str) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
