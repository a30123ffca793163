"""Operator 12: how filters interact, for every order in which they can be applied.

Documents become one narrow row each: their part and which filters they fail. Rows are
counted by part and flags, and SQL's CUBE over the five flags and the part adds the counts
up for every subset of flags; where the flags of a subset are all false and the rest are
rolled up, the row says how many documents survive that subset. A step of an order is a pair of
subsets, so all 120 orders need one join of steps with pairs of survivors and no further pass over documents.

Identical texts are told by their SHA-256. Their groups are aggregated before the shuffle, and
the first of a group is found by a join on text and doc_id, so a text that a third of all rows hold is no hot key.

Defined cases: a null text is empty, and so equal to an empty one; a null lang is the part of the empty
string; rows without a doc_id fail nothing as duplicates, make no other row fail, and have no
label; rows that repeat a doc_id are counted each, and of equal texts all rows with the smallest doc_id pass;
a doc_id with several labels is good, or toxic, if one of them says so; other columns are ignored,
whatever their names; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import documents, let, table

#: The filters' names, in the order of the flags.
FILTERS = "ABCDE"
#: A's least number of words, B's least per cent of distinct words, C's most per cent of capitals, D's signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"


def text_flags(text: Column) -> Column:
    """A struct of what a text fails by itself: a, b, c and d."""

    def of(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            (n < LEAST_WORDS).alias("a"),
            (100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n).alias("b"),
            (100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > MOST_CAPITALS * F.length(text)).alias("c"),
            text.rlike(SIGNS).alias("d"),
        )

    return let(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""), of)


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a, b, c, d, e, good, toxic and n, the number of rows that are alike in them."""
    text = F.coalesce("text", F.lit(""))
    judged = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_flags(text).alias("f"))
    rows = table(judged.select("doc_id", "part", "same", "f.*"), "filter-flags")
    first = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = ["a", "b", "c", "d"]
    alike = rows.where("doc_id IS NOT NULL").groupBy("doc_id", "same", "part", *flags).agg(F.count("*").alias("n"))
    told = alike.join(first, ["same", "doc_id"], "left").join(known, "doc_id", "left")
    false = F.lit(False)
    told = told.select("part", *flags, F.col("first").isNull().alias("e"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"), "n")
    nameless = rows.where("doc_id IS NULL").select("part", *flags, false.alias("e"), false.alias("good"), false.alias("toxic"), F.lit(1).cast("long").alias("n"))
    return told.unionByName(nameless)


def survivors(counted: DataFrame) -> DataFrame:
    """part, subset (bit k: filter k applies), n, good and toxic documents that pass all filters of the subset; subsets that none passes are left out."""
    alike = counted.groupBy("part", "a", "b", "c", "d", "e").agg(F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0L)")).alias("good"), F.sum(F.expr("if(toxic, n, 0L)")).alias("toxic"))
    spark = counted.sparkSession
    cubed = spark.sql(
        "SELECT part, a, b, c, d, e, grouping_id() AS rolled, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic FROM {alike} GROUP BY CUBE(part, a, b, c, d, e)",
        alike=alike,
    )
    # grouping_id has a bit for each rolled-up column, part's the highest and e's the lowest
    chosen = [F.when(F.col("rolled").bitwiseAND(1 << (4 - k)) == 0, 1 << k).otherwise(0) for k in range(5)]
    passed = cubed.where("rolled < 32 AND NOT (coalesce(a, false) OR coalesce(b, false) OR coalesce(c, false) OR coalesce(d, false) OR coalesce(e, false))")
    return passed.select("part", sum(chosen[1:], chosen[0]).cast("int").alias("subset"), "n", "good", "toxic")


def pairs(survived: DataFrame) -> DataFrame:
    """For each part, filter and subset without it: what the filter removes after the subset, and what it removes over all orders."""
    parts = survived.select("part").distinct()
    grid = parts.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(31)))).join(survived, ["part", "subset"], "left").na.fill(0, ["n", "good", "toxic"])
    after = grid.select("part", F.col("subset").alias("then"), F.col("n").alias("kept"), F.col("good").alias("good_kept"), F.col("toxic").alias("toxic_kept"))
    before = grid.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("(shiftright(subset, filter) & 1) = 0").withColumn("then", F.expr("subset | shiftleft(1, filter)"))
    return before.join(after, ["part", "then"]).select("part", "filter", "subset", "kept", (F.col("n") - F.col("kept")).alias("removed"), (F.col("good") - F.col("good_kept")).alias("good_lost"), (F.col("toxic") - F.col("toxic_kept")).alias("toxic_lost"))


def orders(spark: SparkSession) -> DataFrame:
    """filter_order, step, filter and the subset before it, for each of the 120 orders."""
    return spark.sql(
        """WITH RECURSIVE grown(filter_order, subset, step, filter) AS (
             SELECT '', 0, 0, -1
             UNION ALL
             SELECT concat(filter_order, substring('ABCDE', k + 1, 1)), subset | shiftleft(1, k), step + 1, k
             FROM grown, (SELECT explode(sequence(0, 4)) AS k) WHERE step < 5 AND (shiftright(subset, k) & 1) = 0)
           SELECT whole.filter_order, part.step, part.filter, part.subset & ~shiftleft(1, part.filter) AS subset
           FROM grown AS part JOIN grown AS whole ON whole.step = 5 AND part.step > 0 AND substring(whole.filter_order, 1, part.step) = part.filter_order"""
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    step = pairs(survivors(facts(docs, labels)))
    size = F.bit_count("subset")
    # an order has the subset's filters first, then this one: |S|! (4 - |S|)! orders of 120
    weight = F.factorial(size) * F.factorial(4 - size)
    total = step.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * weight).alias("shapley"),
        F.sum(F.when(size == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(size == 4, F.col("removed"))).alias("unique_fails"),
    )
    by_step = F.broadcast(orders(docs.sparkSession)).join(step, ["filter", "subset"]).join(total, ["part", "filter"])
    return by_step.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (
  SELECT doc_id, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
     coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM words LEFT JOIN labels USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS x FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
fails AS (SELECT part, good, toxic, [x FOR x IN ['A', 'B', 'C', 'D', 'E'] IF f[ascii(x) - 64]] AS failed FROM flags),
judged AS (
  SELECT part, filter_order, step, x, good, toxic, list_contains(failed, x) AS bad, len(failed) AS n_failed,
    coalesce(list_min([instr(filter_order, y) FOR y IN failed]), 6) AS gone
  FROM fails, steps),
counted AS (
  SELECT part, filter_order, step, x, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (bad AND gone < step) AS redundant, count(*) FILTER (bad AND n_failed = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted"""
}
