"""Operator 10: document fingerprints by order MinHash.

A text is cut into tokens (a word, cut after 12 signs, with one white space behind
it); each run of K tokens is a k-mer, numbered by its occurrence in the text. Of
SKETCHES points on the ring of 64-bit hashes, each takes the L occurrence-numbered k-mers
that follow it, puts them in text order and hashes the tuple. Two texts agree
at a point if they share the same minimal k-mers in the same order, which falls
with edit distance, not only with set overlap. Short texts wrap around the ring,
so no point stays empty.

All of it is built-in array expressions of one row: one or two sorts of the
text's k-mers, nothing exploded. The next document comes by two joins on
doc_id; ids are ranged in blocks, so that no window spans the whole table.

Defined cases: null text is empty; an empty text has the one k-mer of no token;
null doc_id comes before all others; rows that share a doc_id have the same next
document, the one with the next greater doc_id (of several its smallest text).
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.llm.common import documents, let, table

TOKEN = r"\S{1,12}\s?|\s"
K, L, SKETCHES = 3, 2, 32
#: Low bits of a packed k-mer that hold its place in the text (higher places wrap; results stay defined).
PLACE = 24
_MASK = (1 << PLACE) - 1


def _first_from(sorted_values: Column, key: Column, n: Column) -> Column:
    """How many of the sorted values are less than key, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in range(PLACE, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(sorted_values, low + step - 1) < key), low + step).otherwise(low))


def kmers(text: Column) -> Column:
    """Sorted array<bigint>: hash of each occurrence-numbered k-mer in the high bits, its place in the low bits."""

    def of_tokens(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
        return F.when(F.size(h) >= K, many).otherwise(F.array(F.xxhash64(h)))

    def numbered(s: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            return (i > 0) & (F.shiftright(F.get(s, i - 1), PLACE) == F.shiftright(x, PLACE))

        def occurrence(x: Column, i: Column) -> Column:
            first = _first_from(s, x.bitwiseAND(F.lit(~_MASK)), F.size(s))
            again = F.xxhash64(F.shiftright(x, PLACE), i - first).bitwiseAND(F.lit(~_MASK)).bitwiseOR(x.bitwiseAND(F.lit(_MASK)))
            return F.when(same(x, i), again).otherwise(x)

        repeated = F.size(F.filter(s, same)) > 0
        return F.when(repeated, F.sort_array(F.transform(s, occurrence))).otherwise(s)

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    packed = let(F.transform(tokens, lambda t: F.xxhash64(t)), of_tokens)
    packed = F.transform(packed, lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_MASK))))
    return let(F.sort_array(packed), numbered)


def fingerprint(text: Column) -> Column:
    """array<int> with SKETCHES values."""

    def sketch(s: Column) -> Column:
        def one(point: Column) -> Column:
            def chosen(at: Column) -> Column:
                picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(L), F.size(s)) - 1), lambda m: F.get(s, (at + m) % F.size(s)))
                by_place = F.sort_array(F.transform(picks, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 64 - PLACE - 1).bitwiseOR(F.shiftrightunsigned(x, PLACE + 1))))
                return F.shiftright(F.xxhash64(F.transform(by_place, lambda y: y.bitwiseAND(F.lit((1 << (63 - PLACE)) - 1)))), 32).cast("int")

            return let(_first_from(s, point, F.size(s)), chosen)

        points = F.array(*[F.lit(-(1 << 63) + i * ((1 << 64) // SKETCHES)).cast("long") for i in range(SKETCHES)])
        return F.transform(points, one)

    return let(kmers(text), sketch)


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketches that agree, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SKETCHES))


def spelled(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def following(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, part of each distinct doc_id: the next in ascending order, after the last the first; a quarter of its (longest) text's length."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.floor(F.length("text") / 4), F.lit(0)).cast("int")).alias("part"))
    # The block that a sampled range put a row in must not change later: it is written.
    ranged = table(ids.repartitionByRange(n, "doc_id").withColumn("block", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("block").orderBy("doc_id"))).withColumn("last", F.row_number().over(Window.partitionBy("block").orderBy(F.col("doc_id").desc())) == 1)
    heads = ranged.groupBy("block").agg(F.min(F.struct("doc_id")).alias("head"))
    whole = Window.orderBy("block")  # as many rows as blocks
    heads = heads.select("block", F.coalesce(F.lead("head").over(whole), F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return inside.join(F.broadcast(heads), "block").select("doc_id", F.when(F.col("last"), F.col("head.doc_id")).otherwise(F.col("next_id")).alias("next_id"), "part")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text of every row; of the next text only as much as replaces a quarter of this one.

    Whole texts are shuffled once, by doc_id: both joins read that exchange, and only the heads move on."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = table(following(docs), "pairs")
    counted = docs.select("doc_id").agg(F.count("*").alias("n"), (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("distinct")).first()
    single = rows if counted["n"] == counted["distinct"] else rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    heads = single.alias("nxt").join(pairs.alias("p"), F.col("nxt.doc_id").eqNullSafe(F.col("p.next_id"))).select(F.col("p.doc_id").alias("own_id"), "p.next_id", F.substring("nxt.text", F.lit(1), F.col("p.part")).alias("next_text"))
    return rows.alias("own").join(heads.alias("h"), F.col("own.doc_id").eqNullSafe(F.col("h.own_id"))).select("own.doc_id", "own.text", "h.next_id", "h.next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every row."""
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    rows = with_next(docs).withColumn("edited", edited).select("doc_id", "next_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp"))
    made = table(rows, "fingerprints")
    # Of several rows with one doc_id, the fingerprint of the text that with_next took cannot be told from here; texts alike have fingerprints alike.
    nxt = made.groupBy("doc_id").agg(F.min("fp").alias("next_fp"))
    return made.join(nxt.select(F.col("doc_id").alias("__next"), "next_fp"), F.col("next_id").eqNullSafe(F.col("__next")), "left").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("fp")).alias("fingerprint"), spelled(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
