"""Rank algebra over hits (query_id, id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tagged(lists: list[DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.withColumn(name, F.lit(i)) for i, x in enumerate(lists)])


def rrf(lists: list[DataFrame], limit: int, k: int = 60, digits: int = 10) -> DataFrame:
    """query_id, id, score, rank: reciprocal rank fusion. Equal scores go by the first list that has the id, then its rank there."""
    every = _tagged([x.select("query_id", "id", "rank") for x in lists], "list_no")
    fused = every.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), digits).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "first", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("first")


def merge_sources(dense: DataFrame, sparse: DataFrame, threshold: float | None = None) -> DataFrame:
    """query_id, id, score, source: the greater score of each id; `hybrid` where both have it and the sparse one doesn't win."""
    d = dense.select("query_id", "id", F.col("score").alias("d"))
    s = sparse.select("query_id", "id", F.col("score").alias("s"))
    both = d.join(s, ["query_id", "id"], "full")
    source = F.when(F.col("d").isNull(), "sparse").when(F.col("s").isNull(), "dense").when(F.col("s") > F.col("d"), "sparse").otherwise("hybrid")
    out = both.select("query_id", "id", F.greatest("d", "s").alias("score"), source.alias("source"))
    return out if threshold is None else out.where(F.col("score") >= threshold)


def accumulate_unique(steps: DataFrame, cap: int) -> DataFrame:
    """First occurrence of each id over (step, rank), the first `cap` of a query."""
    first = steps.groupBy("query_id", "id").agg(F.min(F.struct("step", "rank", "score")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.step", "f.rank", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap).select("query_id", "id", "f.score", "f.step", "place")


def accumulate_max(steps: DataFrame) -> DataFrame:
    """Best score of each id; of equal ones the earliest step."""
    best = steps.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("step")).alias("late"))).alias("b"))
    return best.select("query_id", "id", "b.score", (-F.col("b.late")).alias("step"))


def append_dedup(lists: list[DataFrame]) -> DataFrame:
    """query_id, id, place: the lists one after the other, repeated ids dropped."""
    every = _tagged([x.select("query_id", "id", "rank") for x in lists], "list_no").groupBy("query_id", "id").agg(F.min(F.struct("list_no", "rank")).alias("f"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("f", "id"))).select("query_id", "id", "place")


def expand_pages(hits: DataFrame, chunks: DataFrame, max_pages: int) -> DataFrame:
    """query_id, file_id, page, score, text, rank: pages of the hits by their best score, each with all its chunks.

    hits: query_id, id, score; chunks: id, file_id, page, chunk_index, text. Hits without a page are dropped."""
    placed = hits.join(chunks.select("id", "file_id", "page"), "id").where("page IS NOT NULL")
    pages = placed.groupBy("query_id", "file_id", "page").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "file_id", "page")
    top = pages.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_pages)
    # A page that several queries hit is put together once.
    wanted = chunks.join(top.select("file_id", "page").distinct(), ["file_id", "page"], "left_semi")
    whole = wanted.groupBy("file_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), "\n").alias("text"))
    return top.join(whole, ["file_id", "page"]).select("query_id", "file_id", "page", "score", "text", "rank")


def grade_from_reply(reply: Column, index: Column, label: str = "Document", low: float = 0.0, default: float = 0.5) -> Column:
    """Score from low to 1 that a reply gives document `index`; the default if it gives none. Evaluations go from -1, and 0 is their default."""
    pieces = F.regexp_extract_all(reply, F.lit(rf"(?i){label}\s+(\d+)\s*:\s*(?:score\s*=\s*)?[-+]?[0-9.]+"), F.lit(1))
    scores = F.regexp_extract_all(reply, F.lit(rf"(?i){label}\s+\d+\s*:\s*(?:score\s*=\s*)?([-+]?[0-9.]+)"), F.lit(1))
    at = F.array_position(pieces, index.cast("string")).cast("int")
    found = F.when(at > 0, F.get(scores, at - 1).try_cast("double"))
    return F.greatest(F.lit(low), F.least(F.lit(1.0), F.coalesce(found, F.lit(default))))


def grade(hits: DataFrame, threshold: float) -> DataFrame:
    """Hits with a grade: is_relevant, ranked again by grade; a null grade (failure) keeps the old score and is relevant."""
    out = hits.withColumn("is_relevant", F.coalesce(F.col("grade") >= threshold, F.lit(True))).withColumn("score", F.coalesce("grade", "score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))


def keep_relevant(graded: DataFrame, fallback: int = 5) -> DataFrame:
    """Relevant hits; the first `fallback` of a query that has none."""
    any_ = F.max(F.col("is_relevant").cast("int")).over(Window.partitionBy("query_id"))
    return graded.withColumn("__any", any_).where(F.col("is_relevant") | ((F.col("__any") == 0) & (F.col("rank") <= fallback))).drop("__any")


def verdict(scores: Column, upper: float, lower: float) -> Column:
    """correct, incorrect or ambiguous, by the scores of a query's hits."""
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, "incorrect").when(F.exists(scores, lambda s: s >= upper), "correct").when(F.forall(scores, lambda s: s < lower), "incorrect").otherwise("ambiguous")


def refine_strips(strips: DataFrame, threshold: float, most: int = 5) -> DataFrame:
    """query_id, text: the first strips (query_id, place, strip, score) that reach the threshold, joined."""
    good = strips.where(F.col("score") >= threshold).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("n") <= most)
    return good.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "strip"))), lambda s: s["strip"]), " ").alias("text"))


def resume(queries: DataFrame, done: DataFrame) -> DataFrame:
    """Queries that have no result yet."""
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def resume_mismatches(queries: DataFrame, done: DataFrame, prefix: int = 150) -> DataFrame:
    """query_id, saved, expected of results (query_id, question) that do not fit the queries (query_id, question): none if they are of one batch.

    The first and the last result are looked at, by number or else by text; one whose query_id is not among the queries has no expected question."""
    number = F.col("query_id").cast("string").try_cast("decimal(38,0)")
    order = F.struct(number.isNotNull().alias("a"), number.alias("b"), F.col("query_id").alias("query_id"), F.col("question").alias("saved"))
    ends = done.agg(F.array(F.min(order), F.max(order)).alias("e")).select(F.explode(F.array_distinct("e")).alias("e")).where("e IS NOT NULL").select("e.query_id", "e.saved")
    met = ends.where("saved IS NOT NULL").join(queries.select("query_id", F.col("question").alias("expected")), "query_id", "left")
    return met.where(~F.coalesce(F.substring("saved", 1, prefix) == F.substring("expected", 1, prefix), F.lit(False)))


def rerank(hits: DataFrame, scored: Column, top_k: int, threshold: float | None = None) -> DataFrame:
    """Hits by a new score; the old one stays as retrieval_score."""
    out = hits.withColumn("retrieval_score", F.col("score")).withColumn("score", scored)
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= top_k)
