"""Operator 11: a Merkle manifest of a table: leaves, roots, and each row's proof.

Rows are ranked in their group by ranges: a range partition counts its rows, and the counts
before it are added to a row's place in it, so no task orders a whole group. A level is one
window over group and parent index: the digests of its whole frame, in order, are the
preimage of the parent and hold the siblings of each node. One row for each parent goes to the
next level. Proofs are put together from the top: a node's path is its siblings, then its
parent's path, and each level joins half as many rows as the one below it.

A path is a text: `<left>right` for each level, with the digests left and right of the
node's own; `/` and the subroot stand between the levels of the group and those above.

Defined cases: null values are `-` in a leaf, whatever the column, and null is a group of its own, the first; rows
without a doc_id come first in their group; rows that repeat a doc_id are leaves each, in the
order of their leaves; a lone leaf is its group's subroot and a lone subroot the root; other columns are
ignored, whatever their names; an empty table has no leaf and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.llm.common import documents, drop, table

#: Fixed value: the columns of a leaf, in their order.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
#: Children of a node.
FANOUT = 2


def digest(*parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**instead: Column) -> Column:
    """The leaf of a row; instead: values in place of its columns'."""
    return digest(*(field(instead.get(c, F.col(c))) for c in LEAF))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows, a table, with `place`, from 0 in its group by the order, and `members`, the group's size, as a table. Values of group must not be null.

    Rows that are equal in the order are told apart by a number of their own, so a value that many rows hold is dealt over ranges too."""
    keyed = rows.withColumn("__tie", F.monotonically_increasing_id())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = table(keyed.repartitionByRange(n, *group, *order, "__tie").withColumn("__range", F.spark_partition_id()), "ranges")
    every = Window.partitionBy(*group)
    before = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = ranges.groupBy("__range", *group).agg(F.count("*").alias("__n"))
    counts = counts.select("__range", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(every).alias("members"))
    inside = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order, "__tie"))
    placed = ranges.withColumn("__inside", inside).join(counts, ["__range", *group])
    made = table(placed.withColumn("place", F.col("__inside") - 1 + F.col("__before")).drop("__range", "__tie", "__inside", "__before"), "ranked")
    drop(ranges)
    return made


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels over nodes (group, place, digest, members, and any more), from the lowest, and each group's top: group, top, height.

    A level has its nodes' columns, their siblings as `step`, and `parent_place`. Groups of one node are done."""
    largest = nodes.agg(F.max("members")).first()[0] or 0
    top = lambda nodes, k: nodes.where("members = 1").select("group", F.col("digest").alias("top"), F.lit(k).alias("height"))
    found, tops = [], top(nodes, 0)
    while largest > 1:
        run = Window.partitionBy("group", "parent_place").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nth = (F.col("place") % FANOUT).cast("int")
        joined = lambda begin, n: F.array_join(F.slice("run", begin, n), "")
        level = table(
            nodes.where("members > 1")
            .withColumn("parent_place", F.floor(F.col("place") / FANOUT))
            .withColumn("run", F.collect_list("digest").over(run))
            .withColumn("step", F.concat(F.lit("<"), joined(F.lit(1), nth), F.lit(">"), joined(nth + 2, F.lit(FANOUT))))
            .withColumn("parent", digest(F.array_join("run", "")))
            .drop("run"),
            "level",
        )
        found.append(level)
        nodes = level.where(F.col("place") % FANOUT == 0).select("group", F.col("parent_place").alias("place"), F.col("parent").alias("digest"), F.ceil(F.col("members") / FANOUT).alias("members"))
        tops = tops.unionByName(top(nodes, len(found)))
        largest = -(-largest // FANOUT)
    return found, tops


def with_paths(nodes: DataFrame, found: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """group, place, the columns to carry, and `path` of the nodes: their steps in all levels, then the path that tops (group, height, path) has for the group."""

    def done(k: int) -> DataFrame:
        mine = tops.where(F.col("height") == k)
        if k:
            return mine.select("group", F.lit(0).cast("long").alias("place"), "path")
        return nodes.where("members = 1").select("group", "place", *carry).join(mine.select("group", "path"), "group")

    above = done(len(found))
    for k in range(len(found) - 1, -1, -1):
        parents = above.select("group", F.col("place").alias("parent_place"), F.col("path").alias("rest"))
        own = found[k].join(parents, ["group", "parent_place"]).select("group", "place", *([] if k else carry), F.concat("step", "rest").alias("path"))
        above = own.unionByName(done(k))
    return above


def manifest(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (the path from the leaf to the root) and more, given as expressions over docs, of each row."""
    lang = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    rows = table(docs.select("doc_id", lang.alias("group"), leaf().alias("digest"), *(c.alias(k) for k, c in more.items())), "leaves")
    leaves = ranked(rows, ["group"], ["doc_id", "digest"])
    drop(rows)
    found, tops = tree(leaves)
    tops = table(tops, "subroots")
    subroots = ranked(tops.withColumnRenamed("group", "of"), [], ["of"]).withColumn("group", F.lit("")).withColumn("digest", F.col("top"))
    above, whole = tree(subroots)
    root = whole.first()
    to_root = with_paths(subroots, above, whole.withColumn("path", F.lit("")), ["of", "top", "height"])
    ends = table(to_root.select(F.col("of").alias("group"), "height", F.concat(F.lit("/"), "top", "path").alias("path")), "ends")
    inner, outer = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    made = with_paths(leaves, found, ends, ["doc_id", "digest", *more])
    subroot, rest = F.substring(outer, 1, 64), F.substr(outer, F.lit(65))
    return made.select("doc_id", F.col("digest").alias("leaf"), subroot.alias("subroot"), F.lit(root["top"] if root else None).cast("string").alias("root"), F.concat(inner, rest).alias("steps"), *more)


def fold(start: Column, steps: Column) -> Column:
    """The root that steps lead to from a leaf."""
    each = F.split(F.substr(steps, F.lit(2)), "<")
    return F.when(steps == "", start).otherwise(F.aggregate(each, start, lambda below, step: digest(F.replace(step, F.lit(">"), below))))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = leaf(n_chars=F.try_add("n_chars", F.lit(1).cast("long")))
    made = manifest(documents(spark, sf_dir), tampered=F.when(chosen, tampered))
    made = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    proof = F.sha2(F.translate("steps", "<>", ""), 256)
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels, siblings and folds by recursion; crc32 from its table of 256 remainders.
_NODES = """{name}(g, lvl, place, digest, m) AS (
  SELECT g, 0, place, digest, m FROM {base}
  UNION ALL
  SELECT g, lvl + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (m + 1) // 2 FROM {name} WHERE m > 1 GROUP BY g, lvl, m, place // 2)"""
_WALK = """{name}(k, g, lvl, place, m, sibs, cur) AS (
  SELECT k, g, 0, place, m, sibs, cur FROM {base}
  UNION ALL
  SELECT w.k, w.g, w.lvl + 1, w.place // 2, (w.m + 1) // 2, sibs || coalesce(n.digest, ''),
    sha256(CASE WHEN n.digest IS NULL THEN cur WHEN w.place % 2 = 0 THEN cur || n.digest ELSE n.digest || cur END)
  FROM {name} w LEFT JOIN {nodes} n ON n.g = w.g AND n.lvl = w.lvl AND n.place = xor(w.place, 1) WHERE w.m > 1)"""
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
ORACLE_SQL = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE remainders(b, k, c) AS (
  SELECT b, 0, b::BIGINT FROM range(256) AS t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainders WHERE k < 8),
crc(doc_id, k, c) AS (
  SELECT DISTINCT doc_id, 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, crc.k + 1, xor(r.c, crc.c >> 8) FROM crc JOIN remainders r ON r.k = 8 AND r.b = xor(crc.c & 255, ascii((doc_id::VARCHAR)[crc.k + 1])) WHERE crc.k < length(doc_id::VARCHAR)),
leaves AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS g,
    sha256({" || ".join(_FIELD.format(c) for c in LEAF)}) AS leaf,
    sha256({" || ".join(_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in LEAF)}) AS tampered
  FROM documents),
base AS (
  SELECT l.*, leaf AS digest, row_number() OVER (PARTITION BY g ORDER BY l.doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS m,
    CASE WHEN xor(c.c, 4294967295) % 7 = 0 THEN tampered ELSE leaf END AS cur, '' AS sibs
  FROM leaves l LEFT JOIN crc c ON c.doc_id = l.doc_id AND c.k = length(l.doc_id::VARCHAR)),
{_NODES.format(name="nodes", base="base")},
{_WALK.format(name="walk", base="base", nodes="nodes")},
subroots AS (SELECT '' AS g, n.g AS of, digest, row_number() OVER (ORDER BY n.g) - 1 AS place, count(*) OVER () AS m FROM nodes n WHERE n.m = 1),
{_NODES.format(name="tops", base="subroots")},
climb0 AS (SELECT w.k, '' AS g, s.place, s.m, w.sibs, w.cur FROM walk w JOIN subroots s ON s.of = w.g WHERE w.m = 1),
{_WALK.format(name="climb", base="climb0", nodes="tops")}
SELECT b.doc_id, b.leaf, s.digest AS subroot, t.digest AS root, sha256(c.sibs) AS proof_sha256, c.cur AS folded_root, c.cur = t.digest AS verified
FROM base b JOIN climb c ON c.k = b.k AND c.m = 1 JOIN subroots s ON s.of = b.g, (SELECT digest FROM tops WHERE m = 1) t"""
}
