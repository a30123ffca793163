"""Operator 6: near-duplicates by MinHash with tensored banding, confirmed on full sets.

A document's set is its distinct shingles of `words` words: two in the query, and what
a caller says. A text of fewer words is one shingle. Equal sets are one class, which
its smallest doc_id represents. A representative has two collections of `TUPLES`
keys, each key made of `WIDTH` minhashes; a table is a pair of one key of either
collection, so TUPLES**2 tables of 2 * WIDTH minhashes each cost only
2 * TUPLES * WIDTH minhashes. With a similarity of 0.8 a pair shares no table
with probability 1 - (1 - (1 - 0.8**WIDTH)**TUPLES)**2, 2e-4 here, and in a group of
more it has as many further ways to be found as there are members between.

Tables tie representatives to families (connected by shared tables, not yet
confirmed). In a family full sets are compared, and links with
100 * intersection >= 80 * union give the components. A family is compared in
blocks of at most `BLOCK` members: a task has two blocks, it skips pairs that it
has already connected, and it returns a spanning forest of its links, so neither pairs nor
groups are ever emitted or collected whole, and no link is lost.

Scale: per document two keys arrays and a class move; keys that one
representative alone has are dropped before tables are formed; texts move once, by
doc_id, and only members of families send their sets. A hot class is summed to one row
before it moves.

Defined cases: a text without words, or null, has the empty set, is linked with nothing
and is its own component; rows that repeat a doc_id are
one document, which is linked with what any of its texts is linked with (each has its own n_shingles); a null doc_id has a null component and is not kept.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import PartHashes, documents, drop, mix64, numbered, slices, table, text_buffer, tidy, word_spans

WIDTH, TUPLES = 3, 14
#: Words of a shingle in the query.
WORDS = 2
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members of a family that a task compares with so many others.
BLOCK = 1500
SLICE = 1 << 20
_SEEDS = np.random.default_rng(6).integers(1, 2**63, 2 * TUPLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def _joined(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place."""
    if n == 1:
        return mix64(words[at] ^ np.uint64(0x5851F42D4C957F2D))
    out = words[at + n - 1]
    for k in range(n - 2, -1, -1):
        out = mix64(words[at + k] * np.uint64(0x9E3779B97F4A7C15) + mix64(out))
    return out


class _Sets:
    """Sorted distinct shingles of the texts of a batch: values flat, and where each text's begin."""

    def __init__(self, batch: pa.RecordBatch, n: int):
        raw, off = text_buffer(batch.column("text"))
        raw = _UPPER[raw]
        starts, ends, first = word_spans(raw, off)
        words = PartHashes(raw).of(starts, ends)
        text = np.repeat(np.arange(len(off) - 1), np.diff(first))
        full = np.flatnonzero(text[n - 1 :] == text[: max(len(text) - n + 1, 0)])
        short = [first[:-1][np.diff(first) == k] for k in range(1, n)]
        values = np.concatenate([_joined(words, full, n), *(_joined(words, at, k) for k, at in enumerate(short, 1))])
        text = text[np.concatenate([full, *short])]
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.values, text = values[new], text[new]
        self.first = np.searchsorted(text, np.arange(len(off)))
        self.size = np.diff(self.first)

    def lowest(self) -> np.ndarray:
        """The minhashes of the texts that have a set: one row a hash function."""
        heads = self.first[:-1][self.size > 0]
        return np.stack([np.minimum.reduceat(self.values * s, heads) for s in _SEEDS]) if len(heads) else np.zeros((len(_SEEDS), 0), np.uint64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, c1 and c2 (the class: a 128-bit digest of the set), keys (array<long>: collection A, then B)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                s = _Sets(batch, words)
                has = s.size > 0
                low = s.lowest()
                keys = np.zeros((2 * TUPLES, low.shape[1]), np.uint64)
                for t in range(2 * TUPLES):
                    for w in range(WIDTH):
                        keys[t] = mix64(keys[t] ^ low[t * WIDTH + w])
                    keys[t] = mix64(keys[t] + np.uint64(t))
                heads = s.first[:-1][has]
                digest = [np.zeros(len(has), np.uint64) for _ in range(2)]
                for d, seed in zip(digest, (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)), strict=True):
                    if len(heads):
                        d[has] = mix64(np.add.reduceat(mix64(s.values ^ seed), heads) + s.size[has].astype(np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * 2 * TUPLES)), pa.int32()), pa.array(keys.T.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(s.size, pa.int64()), "c1": pa.array(digest[0].view(np.int64)), "c2": pa.array(digest[1].view(np.int64)), "keys": lists})

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, label: the smallest node that each node of the edges (a, b) is connected with.

    Min-label propagation with pointer jumping; each round is written, so that
    lineage stays short and a lost executor costs a round at most."""
    both = table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), name)
    held = labels
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        after = table(step.join(jump, F.col("next") == F.col("via"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), "old"), name)
        changed = after.where("label <> old").limit(1).count()
        drop(held)
        held, labels = after, after.select("node", "label")
        if not changed:
            drop(both)
            return labels


def families(reps: DataFrame) -> DataFrame:
    """node, label: representatives (rep, keys) connected by shared tables, where more than one is."""
    each = reps.select("rep", F.posexplode("keys").alias("t", "key"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    halves = each.join(shared, "key").groupBy("rep").agg(F.collect_list(F.struct("t", "key")).alias("k"))
    side = lambda low: F.transform(F.filter("k", (lambda x: x["t"] < TUPLES) if low else (lambda x: x["t"] >= TUPLES)), lambda x: x["key"])
    # The tensored tables: a pair of one key of either collection.
    cells = halves.select("rep", side(True).alias("a"), side(False).alias("b")).select("rep", F.explode("a").alias("a"), "b").select("rep", "a", F.explode("b").alias("b")).select("rep", F.xxhash64("a", "b").alias("cell"))
    first = cells.groupBy("cell").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("cell", "pivot")
    # Of the pivots that a representative meets, TUPLES**2 at most, it is tied to the least, and
    # the others are tied to that one: a group that meets under many pivots then has one edge a member.
    met = cells.join(first, "cell").where("rep <> pivot").groupBy("rep").agg(F.collect_set("pivot").alias("pivots"))
    met = table(met.select("rep", F.array_min("pivots").alias("least"), "pivots"), "pivots")
    others = met.select(F.explode("pivots").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    return components(met.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(others), "families")


def compare(ids: np.ndarray, block: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between members, all of which are compared by full sets.

    Members of one block are only compared here if there is one block (or the task is the block's own)."""
    n = len(ids)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    label = np.arange(n)
    mark = np.zeros(int(flat.max()) + 1, bool)
    cross = len(np.unique(block)) > 1
    out = []
    for x in range(n - 1):
        other = np.arange(x + 1, n)
        fit = (label[other] != label[x]) & (size[other] * 100 >= percent * size[x]) & (size[x] * 100 >= percent * size[other])
        if cross:
            fit &= block[other] != block[x]
        other = other[fit]
        if not len(other):
            continue
        own = flat[begin[x] : begin[x] + size[x]]
        mark[own] = True
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            width = size[some]
            head = np.cumsum(width) - width
            index = np.arange(int(width.sum())) - np.repeat(head, width) + np.repeat(begin[some], width)
            met = np.add.reduceat(mark[flat[index]].astype(np.int64), head)
            for y in some[100 * met >= percent * (size[x] + width - met)].tolist():
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    out.append((int(ids[x]), int(ids[y])))
        mark[own] = False
    return out


def links(docs: DataFrame, family: DataFrame, block: int = BLOCK, words: int = WORDS) -> DataFrame:
    """a, b: confirmed links that connect the members of each family."""
    spark = docs.sparkSession
    sizes = family.groupBy("label").agg(F.count("*").alias("size"))
    placed = family.join(sizes, "label").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A member goes to each task (i, j) of its family in which its block is one of the two.
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("i"), F.greatest(i, F.col("block")).alias("j")))
    chosen = docs.select("doc_id", "text").join(placed.withColumnRenamed("node", "doc_id").hint("shuffle_hash"), "doc_id")

    def sets(batches):
        for whole in batches:
            for batch in slices(whole, SLICE):
                s = _Sets(batch, words)
                held = s.values.tobytes()
                first = (s.first * 8).tolist()
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "label", "blocks", "block")} | {"shingles": pa.array([held[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())})

    made = chosen.mapInArrow(tidy(sets), "doc_id long, label long, blocks int, block int, shingles binary")
    dealt = made.select("doc_id", "label", "block", "shingles", F.explode(tasks).alias("task")).select("doc_id", "label", "block", "shingles", "task.i", "task.j")
    dealt = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "doc_id")

    def confirm(batches):
        task, rows = None, []

        def done():
            if len(rows) > 1:
                found = compare(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [np.frombuffer(r[2], np.uint64) for r in rows])
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in ("label", "i", "j")), strict=True))
            for key, doc, blk, s in zip(own, batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if key != task:
                    yield from done()
                    task, rows = key, []
                if not rows or rows[-1][0] != doc:  # rows that repeat a doc_id are one document
                    rows.append((doc, blk, s))
        yield from done()

    return dealt.mapInArrow(tidy(confirm), "a long, b long")


def _grouped(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs, in which a doc_id has one row."""
    signed = table(signatures(docs, words), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = table(filled.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "keys")
    family = families(reps)
    confirmed = table(links(docs, family, words=words), "links")
    label = components(confirmed, "components")
    named = classes.join(label, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("label", "rep").alias("component"))
    out = signed.join(named, ["c1", "c2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def _by_rows(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """What _grouped returns where rows repeat a doc_id: each of `rows` (numbered) is grouped by itself, and the groups of one doc_id are joined."""
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text")
    apart = _grouped(rows.select(F.col("row").alias("doc_id"), "text").unionByName(nameless), words).withColumnRenamed("doc_id", "row")
    found = table(apart.join(rows.select("row", "doc_id"), "row", "left").select("doc_id", "n_shingles", F.col("component_id").alias("part")), "apart")
    filled = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    parts = filled.select("doc_id", "part").distinct()
    ties = parts.join(parts.groupBy("doc_id").agg(F.min("part").alias("a")), "doc_id").where("part <> a").select("a", F.col("part").alias("b"))
    tied = components(ties, "tied").select(F.col("node").alias("part"), "label")
    whole = lambda df: df.join(tied, "part", "left").withColumn("part", F.coalesce("label", "part")).drop("label")
    least = whole(filled).groupBy("part").agg(F.min("doc_id").alias("component_id"))
    out = whole(found).join(least, "part", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs, by shingles of so many words."""
    rows = numbered(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), "row")
    out = _grouped(docs, words) if rows is None else _by_rows(docs, rows, words)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE_SQL = {
    "op6_near_duplicates": r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 1], ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
    SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 80 * (nx.n + ny.n - m)
), edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link
), reach AS (
    SELECT x AS doc_id, y AS other FROM edge
    UNION SELECT r.doc_id, b.y FROM reach r JOIN edge b ON b.x = r.other
), low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id <= coalesce(other, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
}
