"""A stored full-text index: immutable segments of stemmed postings, and a top-k search that skips blocks.

Documents are dealt to stripes: those of about one length together, a few hundred to a stripe. A
block holds the postings of one term in one stripe, with the greatest frequency and the least
length in it, which bound what the term can add to a score there, whatever the statistics
become. Blocks lie in buckets of a hash of the term, sorted by term; a search reads the buckets
of its terms.

A search shuffles the blocks of its terms by stripe, packed as they are stored, so a document's
terms meet in one task whatever their number. A task scores the stripes with the best sums of
bounds first; its k-th score is a floor, and blocks of a stripe whose sum stays below a query's
floor are skipped for that query. Nothing is estimated: what is skipped cannot be in the top k.

Segments are added and merged by commits to a log, so readers see whole segments, and a
document's later version hides its earlier ones at once. Statistics are those of the live documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from heliodor.functions.text import porter, words
from heliodor.operators.search import K1, B, top_ranked
from heliodor.storage import CommitLog, Folder, shared_dir, source_mark

#: Of the files; an index of another is built anew.
FORMAT = 1
#: Documents of a stripe, about; stripes hold documents whose lengths differ by a fifth at most.
STRIPE = 256
#: Terms of queries that one scan carries (some 40 bytes each); they are counted, and more are searched in several scans.
QUERY_TERMS = 200_000
#: Stripes of a batch that are scored for a query before its floor skips others.
FIRST_STRIPES = 4
#: Scores that a task holds at once: queries times documents; and postings, each counted for every query that has its term.
HELD_SCORES, HELD_POSTINGS = 4_000_000, 1_000_000
#: The lengths of a token that is stemmed.
STEMMED = (3, 64)


@F.arrow_udf(ArrayType(StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    coded = tokens.flatten().dictionary_encode()
    stems = [porter(t) if t is not None and STEMMED[0] <= len(t) <= STEMMED[1] else t for t in coded.dictionary.to_pylist()]
    flat = pa.array(stems, pa.string()).take(coded.indices)
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)


ANALYZERS = {"words": words, "stems": lambda text: _stemmed(F.coalesce(words(text), F.array().cast("array<string>")))}


def _of_tokens(batch: pa.RecordBatch):
    """The batch in parts of about HELD_POSTINGS tokens, or of one document with more."""
    if batch.num_rows:
        size = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // HELD_POSTINGS
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), batch.num_rows)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(low, high - low)


def _postings(batches):
    """(id, stripe, tokens) as term, stripe, id, tf, dl: frequencies are counted in the batch, so no word is shuffled."""
    for batch in (part for whole in batches for part in _of_tokens(whole)):
        lists = batch.column("tokens")
        dl = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * max(len(coded.dictionary), 1) + term, return_counts=True)
        row, term = np.divmod(pair, max(len(coded.dictionary), 1))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(term)), batch.column("stripe").take(pa.array(row)), batch.column("id").take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(dl[row].astype(np.int32))],
            ["term", "stripe", "id", "tf", "dl"],
        )


def _blocks(batches):
    """Sorted postings as blocks: one for each term and stripe of a batch, so a frequent term streams through."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        term = batch.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        segment, stripe = batch.column("segment").to_numpy(), batch.column("stripe").to_numpy()
        begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (stripe[1:] != stripe[:-1]) | (segment[1:] != segment[:-1])))
        cuts = pa.array(np.append(begin, n), pa.int32())
        tf, dl = batch.column("tf").to_numpy(), batch.column("dl").to_numpy()
        lists = [pa.ListArray.from_arrays(cuts, batch.column(c)) for c in ("id", "tf", "dl")]
        first = pa.array(begin)
        bounds = [pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(dl, begin))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(first) for c in ("bucket", "segment", "term", "stripe")), pa.array(np.diff(np.append(begin, n)).astype(np.int32)), *bounds, *lists], ["bucket", "segment", "term", "stripe", "n", "max_tf", "min_dl", "ids", "tfs", "dls"])


def _whole_stripes(batches):
    """Tables of whole stripes from rows sorted by segment and stripe."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seg, stripe = batch.column("segment").to_numpy(), batch.column("stripe").to_numpy()
        last = np.flatnonzero((seg != seg[-1]) | (stripe != stripe[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if held and (cut or (held[-1].column("segment")[-1].as_py(), held[-1].column("stripe")[-1].as_py()) != (seg[-1], stripe[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class _Asked:
    """The terms of a block of queries, as arrays by term: which queries have it, and its weight."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        self.queries = np.unique(np.array([r[0] for r in rows], np.int64))
        self.code: dict[str, int] = {}
        for r in rows:
            self.code.setdefault(r[1], len(self.code))
        term = np.array([self.code[r[1]] for r in rows], np.int64)
        self.query = np.searchsorted(self.queries, np.array([r[0] for r in rows], np.int64))
        self.idf = np.array([r[2] for r in rows])
        self.begin = np.searchsorted(term, np.arange(len(self.code) + 1))


def _expanded(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each member is of, and its place, of ranges that begin somewhere and have so many members."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - begin, count)


#: What a term's frequency adds to a score, times the query's weight of the term; none falls as tf grows or rises as dl grows.
MODELS = {
    "bm25": lambda tf, dl, avgdl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)),
    "product": lambda tf, dl, avgdl: tf,
}


def _scorer(held, k: int, digits: int, avgdl: float, model: str, count_only: bool):
    def part(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return MODELS[model](tf, dl, avgdl)

    def run(batches):
        asked: _Asked = held.value
        n_queries = len(asked.queries)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, score
        floor = np.full(n_queries, -np.inf)
        seen = used = 0
        at_once = max(1, HELD_SCORES // (n_queries * 2 * STRIPE))
        for table in _whole_stripes(batches):
            table = table.combine_chunks()
            seg, stripe = table.column("segment").to_numpy(), table.column("stripe").to_numpy()
            new = np.append(True, (seg[1:] != seg[:-1]) | (stripe[1:] != stripe[:-1]))
            place = np.cumsum(new) - 1
            firsts = np.append(np.flatnonzero(new), len(place))
            coded = table.column("term").combine_chunks().dictionary_encode()
            codes = np.array([asked.code[t] for t in coded.dictionary.to_pylist()], np.int64)
            all_terms = codes[coded.indices.to_numpy(zero_copy_only=False)]
            for low in range(0, len(firsts) - 1, at_once):
                high = min(low + at_once, len(firsts) - 1)
                rows = slice(firsts[low], firsts[high])
                own_table = table.slice(rows.start, rows.stop - rows.start)
                ends = np.append(0, np.cumsum(own_table.column("n").to_numpy(), dtype=np.int64))
                flat = {c: own_table.column(f"{c}s").combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("id", "tf", "dl")}
                weight = part(flat["tf"].astype(float), flat["dl"])
                bounds = part(own_table.column("max_tf").to_numpy().astype(float), own_table.column("min_dl").to_numpy())
                term, where = all_terms[rows], place[rows] - low
                block, pair = _expanded(asked.begin[term], np.diff(asked.begin)[term])
                query, own = asked.query[pair], where[block]
                most = np.bincount(query * (high - low) + own, asked.idf[pair] * bounds[block], n_queries * (high - low)).reshape(n_queries, -1)
                ids, doc = np.unique(flat["id"], return_inverse=True)
                n_first = min(FIRST_STRIPES, high - low)
                first = np.zeros(most.shape, bool)
                np.put_along_axis(first, np.argpartition(-most, n_first - 1, axis=1)[:, :n_first], True, axis=1)
                seen += len(block)
                for turn in (first, ~first):
                    # a rounded score may lie above its bound by half a digit, and equal scores go by id
                    some = np.flatnonzero((turn & (most >= floor[:, None] - 10.0**-digits))[query, own])
                    used += len(some)
                    # some queries at a time, whole: a posting is held for each query of its term
                    held_by = np.cumsum(np.bincount(query[some], np.diff(ends)[block[some]], n_queries).astype(np.int64))
                    group = (held_by // HELD_POSTINGS)[query[some]]
                    for one in np.unique(group).tolist():
                        mine = some[group == one]
                        b = block[mine]
                        owner, posting = _expanded(ends[b], ends[b + 1] - ends[b])
                        begin = int(query[mine].min())
                        key = (query[mine] - begin)[owner] * len(ids) + doc[posting]
                        score = np.bincount(key, asked.idf[pair[mine]][owner] * weight[posting])
                        hit = np.flatnonzero(score > 0)
                        q = hit // len(ids) + begin
                        value = np.round(score[hit], digits)
                        good = value >= floor[q]
                        q, hit, value = q[good], hit[good], value[good]
                        q, i, value = (np.concatenate(x) for x in zip(best, (q, ids[hit % len(ids)], value), strict=True))
                        order = np.lexsort((i, -value, q))
                        q, i, value = q[order], i[order], value[order]
                        rank = np.arange(len(q)) - np.searchsorted(q, q)
                        kept = rank < k
                        best = q[kept], i[kept], value[kept]
                        last = rank == k - 1
                        floor[q[last]] = value[last]
        if count_only:
            yield pa.RecordBatch.from_pydict({"blocks": pa.array([seen], pa.int64()), "scored": pa.array([used], pa.int64())})
        else:
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(asked.queries[best[0]], pa.int64()), "id": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})

    return run


def _stripe(n: int) -> Column:
    """The stripe of a document of an index of n: documents of about one length, dealt by a hash of their ids."""
    slots = max(1, n // STRIPE)
    return F.floor(F.log2(F.col("dl").cast("double") + 1) * 4).cast("long") * slots + F.pmod(F.xxhash64("id"), F.lit(slots))


BLOCKS = "bucket int, segment int, term string, stripe long, n int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>"


class TextIndex:
    """The index below a folder. Documents are (id long, tokens or text); more columns of a document are kept for hits."""

    def __init__(self, spark: SparkSession, root: str, analyzer: str = "stems", buckets: int = 64):
        self.spark, self.analyze = spark, ANALYZERS[analyzer]
        self.folder, self.log = Folder(spark, root), CommitLog(spark, root)
        state = self.log.read()
        if state and state["analyzer"] != analyzer:
            raise ValueError(f"the index holds {state['analyzer']}")
        self.analyzer, self.buckets = analyzer, state.get("buckets", buckets)

    @classmethod
    def stored(cls, spark: SparkSession, source: str, docs: Callable[[], DataFrame], analyzer: str = "stems") -> TextIndex:
        """The index of a source's documents, in the shared folder: built if there is none of the source as it is now."""
        made = cls(spark, f"{shared_dir(spark)}/heliodor-text-{FORMAT}-{analyzer}-{source_mark(spark, source)}", analyzer)
        if made.log.version() < 0:
            made.add(docs())
        return made

    # Writing

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write_blocks(self, postings: DataFrame, segment: str) -> None:
        """postings: term, stripe, id, tf, dl. One shuffle by bucket; a frequent term streams through its task."""
        dealt = postings.withColumn("bucket", self._bucket(F.col("term"))).withColumn("segment", F.lit(0)).repartition("bucket").sortWithinPartitions("bucket", "term", "stripe", "id")
        dealt.mapInArrow(_blocks, BLOCKS).drop("segment").write.partitionBy("bucket").parquet(self.folder.at(f"{segment}/blocks"))

    def _write(self, docs: DataFrame) -> str | None:
        """A segment of docs (id, tokens, more), or none if there are no docs."""
        name = uuid.uuid4().hex
        n = docs.count()
        if not n:
            return None
        docs = docs.withColumn("dl", F.size("tokens")).withColumn("stripe", _stripe(n))
        docs.drop("tokens").write.parquet(self.folder.at(f"{name}/docs"))
        self._write_blocks(docs.select("id", "stripe", "tokens").mapInArrow(_postings, "term string, stripe long, id long, tf int, dl int"), name)
        return name

    def _statistics(self, state: dict) -> dict:
        live = self.documents(state)
        row = live.agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("long")).alias("total")).first()
        return state | {"n": row["n"], "total": row["total"] or 0}

    def add(self, docs: DataFrame) -> None:
        """Add documents (id, text or tokens, and more to keep); an id that is there already gets its new version."""
        docs = docs.where("id IS NOT NULL").dropDuplicates(["id"])
        if "tokens" not in docs.columns:
            docs = docs.withColumn("tokens", self.analyze(F.coalesce("text", F.lit(""))))
        name = self._write(docs.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))
        if name is None and self.log.version() >= 0:
            return

        def change(state: dict) -> dict:
            segments = state.get("segments", []) + ([name] if name else [])
            again = False
            if state.get("segments") and name:
                again = bool(self._docs(name).join(self._all_docs(state).select("id"), "id", "left_semi").limit(1).count())
            return self._statistics({"analyzer": self.analyzer, "buckets": self.buckets, "segments": segments, "overlaid": state.get("overlaid", False) or again})

        self.log.update(change)

    def merge(self) -> None:
        """One segment of the live postings in place of all; blocks are cut anew, texts are not read. The old ones stay until vacuum()."""
        state = self.log.read()
        if len(state.get("segments", [])) < 2:
            return
        name = uuid.uuid4().hex
        place = _stripe(state["n"])
        self.documents(state).withColumn("stripe", place).drop("segment").write.parquet(self.folder.at(f"{name}/docs"))
        self._write_blocks(self._live(self._read_blocks(state), state).select("term", "id", "tf", "dl").withColumn("stripe", place), name)
        merged = state["segments"]

        def change(now: dict) -> dict:
            if now["segments"][: len(merged)] != merged:
                raise ValueError("the segments were merged by another writer")
            return now | {"segments": [name, *now["segments"][len(merged) :]], "overlaid": now["overlaid"] and len(now["segments"]) > len(merged)}

        self.log.update(change)

    def vacuum(self) -> None:
        """Delete segments that the last version does not name."""
        for name in set(self.folder.names()) - {"_log", *self.log.read().get("segments", [])}:
            self.folder.delete(name)

    # Reading

    def _docs(self, segment: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.at(f"{segment}/docs"))

    def _all_docs(self, state: dict) -> DataFrame:
        out = None
        for k, name in enumerate(state["segments"]):
            part = self._docs(name).withColumn("segment", F.lit(k))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out if out is not None else self.spark.createDataFrame([], "id long, dl int, stripe long, segment int")

    def documents(self, state: dict | None = None) -> DataFrame:
        """The live documents, without their postings: the last version of each id."""
        state = state or self.log.read()
        found = self._all_docs(state)
        if not state.get("overlaid"):
            return found
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("segment").desc()))
        return found.withColumn("__n", last).where("__n = 1").drop("__n")

    def _read_blocks(self, state: dict, where: Column | None = None) -> DataFrame:
        out = None
        for k, name in enumerate(state["segments"]):
            part = self.spark.read.parquet(self.folder.at(f"{name}/blocks"))
            part = (part.where(where) if where is not None else part).withColumn("segment", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, blocks: DataFrame, state: dict) -> DataFrame:
        """A row for each posting of the blocks that is of a live document."""
        flat = blocks.withColumn("p", F.explode(F.arrays_zip("ids", "tfs", "dls"))).select("bucket", "segment", "term", "stripe", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        if not state.get("overlaid"):
            return flat
        return flat.join(self.documents(state).select("id", "segment"), ["id", "segment"], "left_semi")

    def _blocks_of(self, wanted: DataFrame, within: Column, state: dict, only: DataFrame | None = None) -> DataFrame:
        """The blocks of the wanted terms (bucket, term), without postings of documents that are replaced or not allowed."""
        blocks = self._read_blocks(state, within).join(wanted, ["bucket", "term"], "left_semi")
        if only is None and not state.get("overlaid"):
            return blocks
        flat = self._live(blocks, state)
        flat = flat if only is None else flat.join(only.select("id").distinct(), "id", "left_semi")
        return flat.repartition("segment", "stripe").sortWithinPartitions("segment", "stripe", "term", "id").mapInArrow(_blocks, BLOCKS)

    def search(self, queries: DataFrame, k: int, only: DataFrame | None = None, digits: int = 4, keep: list[str] | None = None, model: str = "bm25") -> DataFrame:
        """query_id, id, score, rank of the k best documents for queries (query_id, tokens or text).

        model: bm25, or product, the inner product of term frequencies. only: the ids that may be found (statistics are of all documents). keep: columns of the documents that hits shall have."""
        found = self._scan(queries, k, only, digits, model, False)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, id long, score double, rank int")
        hits = top_ranked(found, k)
        return hits.join(self.documents().select("id", *keep), "id") if keep else hits

    def skips(self, queries: DataFrame, k: int, model: str = "bm25") -> tuple[int, int]:
        """How many blocks the queries' terms have, over all queries, and how many a search scores."""
        found = self._scan(queries, k, None, 4, model, True)
        return tuple(found.agg(F.sum("blocks"), F.sum("scored")).first()) if found is not None else (0, 0)

    def _scan(self, queries: DataFrame, k: int, only: DataFrame | None, digits: int, model: str, count_only: bool) -> DataFrame | None:
        state = self.log.read()
        if not state.get("n"):
            return None
        if "tokens" not in queries.columns:
            queries = queries.withColumn("tokens", self.analyze(F.coalesce("text", F.lit(""))))
        each = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        terms = each.withColumn("bucket", self._bucket(F.col("term"))).persist()
        scans = -(-terms.count() // QUERY_TERMS)
        found = None
        for scan in range(scans):
            mine = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == scan) if scans > 1 else terms
            wanted = F.broadcast(mine.select("bucket", "term").distinct())  # QUERY_TERMS rows, about
            within = F.col("bucket").isin([r[0] for r in mine.select("bucket").distinct().collect()])  # the index's buckets at most
            if model == "bm25":
                held = self._blocks_of(wanted, within, state) if state.get("overlaid") else self._read_blocks(state, within).select("bucket", "term", "n").join(wanted, ["bucket", "term"], "left_semi")
                df = held.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
                idf = F.ln(1 + (F.lit(float(state["n"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
                rows = mine.join(df, ["bucket", "term"]).select("query_id", "term", idf).collect()
            else:
                rows = mine.select("query_id", "term", F.col("times").cast("double")).collect()
            if not rows:
                continue
            asked = self.spark.sparkContext.broadcast(_Asked([tuple(r) for r in rows]))
            dealt = self._blocks_of(wanted, within, state, only).drop("bucket").repartition("segment", "stripe").sortWithinPartitions("segment", "stripe")
            schema = "blocks long, scored long" if count_only else "query_id long, id long, score double"
            part = dealt.mapInArrow(_scorer(asked, k, digits, state["total"] / state["n"] or 1.0, model, count_only), schema)
            found = part if found is None else found.unionByName(part)
        return found
