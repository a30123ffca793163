"""Operator 7: benchmark decontamination by a distributed positional inverted index.

The index stores, for each term of the benchmark and each training document that
holds it, the positions of the term there (a table in the shared folder, one row
a position). A window (`n` consecutive item words, or all words of a
shorter item) is looked up from its two rarest terms: their position lists,
shifted by their offsets in the window, are intersected, and the surviving
starts are intersected with the lists of all other terms, so that what is left
is an exact phrase match. Two terms within `slop` words of their distance in the
window give proximity matches.

Scale: training text is read once for the index and once for word counts and is
never shuffled; only terms that a benchmark item has are stored. What is made
from the benchmark, and the documents with a surviving start, are broadcast up to
`BROADCAST_ROWS` counted rows and joined by shuffle beyond. Lists are joined on
document and position, so a frequent term spreads over its documents. No list is cut.

Defined cases: null or wordless text has no words, is not hit and lists no item
(items_sha256 is then the digest of the empty string); an item without words has
no window; items with equal text are all listed; null item_id is ignored;
rows that repeat a doc_id, and rows without one, are each judged by their own text. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import ascii_lower, bounded, documents, drop, let, numbered, table

#: Everything but ASCII letters and digits and signs beyond ASCII parts words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
#: Terms of a window whose lists are intersected before the rest.
RAREST = 2


def words(text: Column) -> Column:
    """array<string> of the words of a text; [] for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """window_id, terms, and items (sorted ids that have the window), of distinct windows."""
    split = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(n)))).alias("terms"))
    return each.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.sha2(F.array_join("terms", " "), 256).alias("window_id"), "terms", "items")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, position: the stored postings of the given distinct terms."""
    each = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return table(each.join(bounded(terms), "term", "left_semi"), "postings")


def _rarest(index: DataFrame, wins: DataFrame) -> DataFrame:
    """window_id, length, needed, rank, term, offset: the terms of each window with the shortest lists, if all terms have one."""
    terms = wins.select("window_id", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    often = index.groupBy("term").agg(F.count("*").alias("often"))
    first = terms.groupBy("window_id", "length", "term").agg(F.min("offset").alias("offset")).join(often, "term", "left")
    entry = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "term", "offset")
    rare = first.groupBy("window_id", "length").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, RAREST).alias("rare"))
    rare = rare.where(F.col("rare")[0]["often"] > 0)
    return table(rare.select("window_id", "length", F.size("rare").alias("needed"), F.posexplode("rare").alias("rank", "r")).select("window_id", "length", "needed", "rank", "r.term", "r.offset"), "rarest")


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """window_id, doc_id, start, length: every exact occurrence of a window."""
    lists = index.join(bounded(_rarest(index, wins)), "term")
    starts = lists.select("window_id", "length", "needed", "doc_id", (F.col("position") - F.col("offset")).alias("start"), "rank").where("start >= 0")
    both = starts.groupBy("window_id", "length", "needed", "doc_id", "start").agg(F.count_distinct("rank").alias("found"))
    both = table(both.where(F.col("found") == F.col("needed")).select("window_id", "length", "doc_id", "start"), "starts")
    # The lists of all terms at the surviving starts, from the postings of their documents alone.
    held = index.join(bounded(both.select("doc_id").distinct()), "doc_id", "left_semi")
    terms = wins.select("window_id", F.posexplode("terms").alias("offset", "term"))
    wanted = both.join(bounded(terms), "window_id").withColumn("position", F.col("start") + F.col("offset"))
    met = wanted.join(held, ["doc_id", "position", "term"])
    whole = met.groupBy("window_id", "doc_id", "start", "length").agg(F.count_distinct("offset").alias("n"))
    return whole.where(F.col("n") == F.col("length")).drop("n")


def proximity_matches(index: DataFrame, wins: DataFrame, slop: int = 3) -> DataFrame:
    """window_id, doc_id, start: places where the two rarest terms of a window stand within slop words of their distance."""
    rare = _rarest(index, wins).where("needed = 2")
    lists = index.join(bounded(rare), "term").select("window_id", "doc_id", "rank", (F.col("position") - F.col("offset")).alias("s"))
    at = [lists.where(F.col("rank") == i).select("window_id", "doc_id", F.col("s").alias(f"s{i}")) for i in (0, 1)]
    # Starts are dealt to cells of slop + 1 words; a start within slop is in the same cell or a next one.
    cells = at[1].withColumn("cell", F.explode(F.array(*[F.floor(F.col("s1") / (slop + 1)) + d for d in (-1, 0, 1)])))
    near = at[0].withColumn("cell", F.floor(F.col("s0") / (slop + 1))).join(cells, ["window_id", "doc_id", "cell"])
    return near.where(F.abs(F.col("s0") - F.col("s1")) <= slop).select("window_id", "doc_id", F.least("s0", "s1").alias("start")).distinct()


def contamination(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    rows = numbered(docs.select("doc_id", "text"), "row")
    own = docs.select(F.col("doc_id").alias("own_id"), F.col("doc_id"), "text") if rows is None else rows.select(F.col("doc_id").alias("own_id"), F.col("row").alias("doc_id"), "text")
    wins = table(windows(items, n), "windows")
    index = build_index(own, wins.select(F.explode("terms").alias("term")).distinct())
    found = table(phrase_matches(index, wins), "matches")
    drop(index)
    covered = found.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("position")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    named = found.select("window_id", "doc_id").distinct().join(wins.select("window_id", "items"), "window_id").select("doc_id", F.explode("items").alias("item_id")).distinct()
    listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hits = covered.join(listed, "doc_id")
    counted = own.select("own_id", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = counted.join(hits, "doc_id", "left")
    return out.select(
        F.col("own_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        let(F.coalesce("items", F.array().cast("array<string>")), F.size).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = {
    "op7_decontamination": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), bw AS (
    SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS win
    FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
    SELECT doc_id, i AS start, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), hit AS (SELECT dw.doc_id, dw.start, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)
), cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS p FROM hit) GROUP BY doc_id
), its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
