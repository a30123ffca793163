"""A stored approximate vector index: inverted lists of product-quantised residuals, rescored exactly.

Coarse centroids and the codebooks of the residuals' parts are trained by Lloyd steps over
a bounded sample: each task assigns its rows and sums them, and only sums by centroid leave it. Every
point is then stored in the list of its nearest centroid, as a code of a byte a part beside
its vector. A search reads the codes of the lists nearest to its queries, keeps the best few
of each query by distances from what the codes stand for, and reads the vectors of those alone for exact scores.

How many lists are probed is measured when the index is trained: the fewest that hold the wanted share
of the exact neighbours of each of some points, not of all together, where a few may find less than half.
Data with clusters need few, data without any need most.

Cosine and dot product become distances: cosine over normalised vectors, dot product by a
further component that gives all points one length.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliodor.operators.search import METRICS, QUERY_BLOCK, dense_topk, top_ranked
from heliodor.storage import CommitLog, Folder, shared_dir, source_mark

#: Of the files; an index of another is built anew.
FORMAT = 2
#: Points that training reads, at most about; queries that the number of probed lists is measured with; lists, at most.
SAMPLE, MEASURED, MOST_LISTS = 65_536, 256, 4096
#: Candidates a query, over all blocks of a search, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Candidates that a task holds beside the best of its queries.
HELD_CANDIDATES = 500_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _normalised(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _placed(v: np.ndarray, metric: str, longest: float, query: bool) -> np.ndarray:
    """Vectors between which least distance is best score."""
    if metric == "cosine":
        return _normalised(v)
    if metric == "dot":
        rest = np.zeros(len(v), np.float32) if query else np.sqrt(np.maximum(longest**2 - (v * v).sum(1), 0))
        return np.hstack((v, rest[:, None])).astype(np.float32)
    return v


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T).argmin(1)


def lloyd(rows: DataFrame, k: int, parts: int = 1, steps: int = 8) -> np.ndarray:
    """Centroids [parts, k, width] of a table of vectors (id, x), for each of so many equal parts of them. Centroids that nothing is near to stay."""
    spark = rows.sparkSession
    first = np.array([r.x for r in rows.orderBy(F.xxhash64("id"), "id").limit(k).collect()], np.float32)
    width = first.shape[1] // parts
    found = np.stack([first[:, m * width : (m + 1) * width] for m in range(parts)])
    for _ in range(steps):
        held = spark.sparkContext.broadcast(found)

        def summed(batches, held=held):
            sums, counts = np.zeros(found.shape, np.float64), np.zeros(found.shape[:2], np.int64)
            for batch in batches:
                x = _matrix(batch.column("x"))
                for m in range(parts):
                    part = x[:, m * width : (m + 1) * width]
                    at = _nearest(part, held.value[m])
                    np.add.at(sums[m], at, part)
                    counts[m] += np.bincount(at, minlength=counts.shape[1])
            m, c = np.nonzero(counts)
            yield pa.RecordBatch.from_pydict({"place": pa.array(m * counts.shape[1] + c), "n": pa.array(counts[m, c]), "total": pa.array(list(sums[m, c]), pa.list_(pa.float64()))})

        def met(batches):
            held_rows = [b for b in batches if b.num_rows]
            if held_rows:
                rows = pa.Table.from_batches(held_rows).combine_chunks()
                place, at = np.unique(rows.column("place").to_numpy(), return_inverse=True)
                total = np.zeros((len(place), width))
                np.add.at(total, at, rows.column("total").combine_chunks().flatten().to_numpy().reshape(-1, width))
                mean = total / np.bincount(at, rows.column("n").to_numpy())[:, None]
                yield pa.RecordBatch.from_pydict({"place": pa.array(place), "mean": pa.array(list(mean), pa.list_(pa.float64()))})

        means = rows.select("x").mapInArrow(summed, "place long, n long, total array<double>").repartition("place").mapInArrow(met, "place long, mean array<double>").collect()
        moved = found.copy()
        for r in means:
            moved[r.place // found.shape[1], r.place % found.shape[1]] = r.mean
        held.unpersist()
        if np.allclose(moved, found, atol=1e-6):
            break
        found = moved
    return found


def _packed(a: np.ndarray) -> dict:
    return {"shape": list(a.shape), "data": base64.b64encode(a.astype("<f4").tobytes()).decode()}


def _unpacked(d: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(d["data"]), "<f4").reshape(d["shape"])


class VectorIndex:
    """The index below a folder. Points are (id long, vector, and more columns to keep); those without a vector are left out."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.log = spark, Folder(spark, root), CommitLog(spark, root)

    @classmethod
    def stored(cls, spark: SparkSession, source: str, points: Callable[[], DataFrame], metric: str = "cosine") -> VectorIndex:
        """The index of a source's points, in the shared folder: built if there is none of the source as it is now."""
        made = cls(spark, f"{shared_dir(spark)}/heliodor-vectors-{FORMAT}-{metric}-{source_mark(spark, source)}")
        if made.log.version() < 0:
            made.train(points(), metric)
            made.add(points())
        return made

    # Writing

    def train(self, points: DataFrame, metric: str = "cosine", recall: float = 0.95, lists: int | None = None, parts: int | None = None) -> None:
        """Centroids, codebooks and the number of lists to probe, from at most about SAMPLE points."""
        if metric not in METRICS:
            raise ValueError(f"no metric {metric}")
        points = points.select("id", "vector").where("vector IS NOT NULL")
        n = points.count()
        if not n:
            raise ValueError("no points to train on")
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        longest = points.agg(F.max(norm)).first()[0] if metric == "dot" else 0.0
        base = self.folder.at(f"train-{uuid.uuid4().hex}")
        picked = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / n)))) if n > SAMPLE else points

        def placed(batches):
            for batch in batches:
                x = _placed(_matrix(batch.column("vector")), metric, longest, False)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float32()))], ["id", "x"])

        picked.mapInArrow(placed, "id long, x array<float>").write.parquet(f"{base}/sample")
        sample = self.spark.read.parquet(f"{base}/sample")
        size = sample.count()
        lists = min(lists or max(1, int(n**0.5)), MOST_LISTS, size)
        centroids = lloyd(sample, lists)[0]
        dims = centroids.shape[1]
        parts = parts or max(1, dims // 2)
        parts = next(p for p in range(min(parts, dims), 0, -1) if dims % p == 0)
        held = self.spark.sparkContext.broadcast(centroids)

        def residuals(batches):
            for batch in batches:
                x = _matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x - held.value[_nearest(x, held.value)]), pa.list_(pa.float32()))], ["id", "x"])

        sample.mapInArrow(residuals, "id long, x array<float>").write.parquet(f"{base}/residuals")
        books = lloyd(self.spark.read.parquet(f"{base}/residuals"), min(256, size), parts)
        probe = self._probes(sample, centroids, recall)
        self.folder.delete(base.rsplit("/", 1)[1])
        self.log.update(lambda _: {"metric": metric, "longest": longest, "lists": lists, "probe": probe, "centroids": _packed(centroids), "books": _packed(books), "segments": []})

    def _probes(self, sample: DataFrame, centroids: np.ndarray, recall: float, k: int = 10) -> int:
        """The fewest lists that hold so much of the k nearest points of the sample, for each of some of its points."""
        asked = sample.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(MEASURED).select(F.col("id").alias("query_id"), F.col("x").alias("vector"))
        near = dense_topk(sample.select("id", F.col("x").alias("vector")), asked, k, "l2").select("query_id", "id")
        met = near.join(sample, "id").select("query_id", "x").join(asked, "query_id").collect()  # MEASURED x k rows at most
        x, q = (np.array([r[c] for r in met], np.float32) for c in ("x", "vector"))
        _, own, count = np.unique([r["query_id"] for r in met], return_inverse=True, return_counts=True)
        order = ((centroids * centroids).sum(1)[None, :] - 2 * q @ centroids.T).argsort(1).argsort(1)
        place = order[np.arange(len(x)), _nearest(x, centroids)]
        place = place[np.lexsort((place, own))]
        wanted = np.maximum(1, np.floor(recall * count)).astype(np.int64)
        return int(place[np.cumsum(count) - count + wanted - 1].max()) + 1

    def add(self, points: DataFrame) -> None:
        """Store points in their lists, as one more segment; ids are taken to be new."""
        state = self.log.read()
        more = [c for c in points.columns if c not in ("id", "vector")]
        held = self.spark.sparkContext.broadcast((_unpacked(state["centroids"]), _unpacked(state["books"])))
        metric, longest = state["metric"], state["longest"]
        width = held.value[1].shape[2]

        def coded(batches):
            centroids, books = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _placed(_matrix(batch.column("vector")), metric, longest, False)
                at = _nearest(x, centroids)
                rest = x - centroids[at]
                codes = np.stack([_nearest(rest[:, m * width : (m + 1) * width], books[m]) for m in range(len(books))], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "list", "code"])

        found = points.select("id", F.col("vector").cast("array<float>").alias("vector"), *more).where("vector IS NOT NULL")
        name = uuid.uuid4().hex
        kept = "".join(f", `{c}` {dict(points.dtypes)[c]}" for c in more)
        found.mapInArrow(coded, f"id long, vector array<float>{kept}, list int, code binary").repartition("list").write.partitionBy("list").parquet(self.folder.at(name))
        self.log.update(lambda now: now | {"segments": [*now["segments"], name]})

    # Reading

    def points(self, state: dict | None = None) -> DataFrame:
        out = None
        for name in (state or self.log.read())["segments"]:
            part = self.spark.read.parquet(self.folder.at(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no points are stored")
        return out

    def candidates(self, queries: DataFrame, n: int, probe: int | None = None) -> DataFrame:
        """query_id, id, list, distance: the n points of each query (query_id, vector) that are nearest by their codes, in the lists that are probed."""
        state = self.log.read()
        metric, probe = state["metric"], min(probe or state["probe"], state["lists"])
        centroids, books = _unpacked(state["centroids"]), _unpacked(state["books"])
        queries = queries.select("query_id", "vector").where("vector IS NOT NULL")
        n_blocks = -(-queries.count() // QUERY_BLOCK) or 1
        found = None
        for block in range(n_blocks):
            mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else queries
            rows = mine.collect()  # a block of queries
            if not rows:
                continue
            q = _placed(np.array([r[1] for r in rows], np.float32), metric, state["longest"], True)
            near = ((centroids * centroids).sum(1)[None, :] - 2 * q @ centroids.T).argsort(1, kind="stable")[:, :probe]
            held = self.spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), q, near, centroids, books))
            wanted = sorted({int(x) for x in near.ravel()})  # the index's lists at most
            # A task has n rows for each query of its block: with more blocks, fewer tasks a block keep all cores busy.
            tasks = max(4, -(-4 * self.spark.sparkContext.defaultParallelism // n_blocks))
            part = self.points(state).where(F.col("list").isin(wanted)).select("id", "list", "code").coalesce(tasks).mapInArrow(_searcher(held, n), "query_id long, id long, list int, distance float")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, id long, list int, distance float")
        w = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")

    def search(self, queries: DataFrame, k: int, rescored: int | None = None, probe: int | None = None, digits: int = 6, keep: list[str] | None = None) -> DataFrame:
        """query_id, id, score, rank of about the k best points, by exact scores of `rescored` candidates (10 k, if not given) a query."""
        state = self.log.read()
        near = self.candidates(queries, rescored or 10 * k, probe).select("query_id", "id", "list").persist()
        small = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        asked = queries.select("query_id", F.col("vector").alias("q"))
        met = self.points(state).select("id", "list", "vector", *(keep or [])).join(F.broadcast(near) if small else near, ["list", "id"]).join(asked, "query_id")
        metric = state["metric"]
        kept = "".join(f", `{c}` {dict(met.dtypes)[c]}" for c in keep or [])

        def exact(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                a, b = (_matrix(batch.column(c)).astype(np.float64) for c in ("q", "vector"))
                score = (a * b).sum(1)
                if metric == "cosine":
                    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
                    score = np.divide(score, norm, out=np.zeros_like(score), where=norm > 0)
                elif metric == "l2":
                    score = 1 / (1 + np.linalg.norm(a - b, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(np.round(score, digits)), *(batch.column(c) for c in keep or [])], ["query_id", "id", "score", *(keep or [])])

        return top_ranked(met.select("query_id", "id", "q", "vector", *(keep or [])).mapInArrow(exact, f"query_id long, id long, score double{kept}"), k)


def _searcher(held, n: int):
    """The n nearest of each query in a task by their codes; a query's n-th distance so far is a floor that holds back all greater ones."""

    def run(batches):
        ids, q, near, centroids, books = held.value
        parts, _, width = books.shape
        floor = np.full(len(q), np.inf, np.float32)
        best = tuple(np.zeros(0, t) for t in (np.int64, np.float32, np.int64, np.int32))  # query, distance, id, list
        waiting: list[tuple] = []

        def met() -> tuple:
            every = tuple(np.concatenate(x) for x in zip(best, *waiting, strict=True))
            order = np.lexsort((every[2], every[1], every[0]))
            sorted_q = every[0][order]
            place = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
            last = order[place == n - 1]
            floor[every[0][last]] = every[1][last]
            waiting.clear()
            return tuple(x[order[place < n]] for x in every)

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, points = batch.column("list").to_numpy(), batch.column("id").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for one in np.unique(lists).tolist():
                asked = np.flatnonzero((near == one).any(1))
                rows = np.flatnonzero(lists == one)
                # What the codes stand for, and its squared length: one product gives the distances, however fine the codes are.
                stood = books[np.arange(parts), codes[rows]].reshape(len(rows), parts * width)
                length = (stood * stood).sum(1)
                for begin in range(0, len(asked), 256):
                    some = asked[begin : begin + 256]
                    rest = q[some] - centroids[one]
                    distance = rest @ stood.T
                    distance *= -2
                    distance += length
                    distance += (rest * rest).sum(1)[:, None]
                    most = floor[some]
                    if len(rows) > n:
                        most = np.minimum(most, np.partition(distance, n - 1, axis=1)[:, n - 1])
                    own, place = np.nonzero(distance <= most[:, None])
                    waiting.append((some[own], distance[own, place], points[rows[place]], np.full(len(own), one, np.int32)))
                    if sum(len(x[0]) for x in waiting) > HELD_CANDIDATES:
                        best = met()
        best = met() if waiting else best
        if len(best[0]):
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[best[0]]), "id": pa.array(best[2].astype(np.int64)), "list": pa.array(best[3], pa.int32()), "distance": pa.array(best[1].astype(np.float32))})

    return run
