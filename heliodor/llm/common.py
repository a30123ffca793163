"""What the training-data operators share: tables, shared storage, word spans."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, or the warehouse.

    Only a session that runs in this process alone, as in tests, gets a temporary folder of this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="heliodor-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_heliodor"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: a cut that keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heliodor-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete what table() wrote, once nothing that is still to be computed reads it."""
    for made in tables:
        delete(made.sparkSession, made.written_to)


#: Narrow rows that are broadcast at most, some 60 bytes each; they are counted first.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, units: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has no more rows than the bound: they are counted, and beyond it a shuffle joins.

    units: what a row counts for, where rows are not alike. df is written first, so counting does not compute it twice."""
    made = table(df, "bounded")
    if units is not None:
        return F.broadcast(made) if (made.agg(F.sum(units)).first()[0] or 0) <= rows else made.hint("shuffle_hash")
    return F.broadcast(made) if made.limit(rows + 1).count() <= rows else made


def numbered(docs: DataFrame, name: str) -> DataFrame | None:
    """docs with a unique long `name` for each row, or None if doc_id is one already.

    Of the rows of a doc_id the one with the smallest text has doc_id; its other rows, and rows
    without one, have numbers above all doc_ids. What is returned is a table."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct"), F.max("doc_id").alias("top")).first()
    if ids["n"] == ids["distinct"]:
        return None
    again = bounded(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    alone = docs.join(again, "doc_id", "left_anti").withColumn("__nth", F.when(F.col("doc_id").isNotNull(), 1).otherwise(2))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = alone.unionByName(docs.join(again, "doc_id", "left_semi").withColumn("__nth", order))
    spare = F.lit(-1 if ids["top"] is None else ids["top"]) + 1 + F.monotonically_increasing_id()
    return table(rows.withColumn(name, F.when(F.col("__nth") == 1, F.col("doc_id")).otherwise(spare)).drop("__nth"), "numbered")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge, zero: Column) -> Column:
    """For each place of a non-empty array what merge makes of the values up to it, itself included.

    Values are merged in blocks of 64 and blocks of 64 blocks, so a place costs some 200 steps however long the array is."""

    def whole(part: Column) -> Column:
        return F.aggregate(part, zero, merge)

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, 6)), lambda k: whole(F.slice(a, k * 64 + 1, F.lit(64))))

    def placed(a: Column, b: Column, c: Column) -> Column:
        def one(_x: Column, i: Column) -> Column:
            j, k = F.shiftright(i, 6), F.shiftright(i, 12)
            return merge(merge(whole(F.slice(c, F.lit(1), k)), whole(F.slice(b, k * 64 + 1, j - k * 64))), whole(F.slice(a, j * 64 + 1, i - j * 64 + 1)))

        return F.transform(a, one)

    return let(values, lambda a: let(blocks(a), lambda b: let(blocks(b), lambda c: placed(a, b, c))))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column in which null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, most: int):
    """Parts of a batch with at most so many bytes of text, one row at least, so that what a worker holds does not follow the batch's size."""
    _, off = text_buffer(batch.column("text"))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(off, off[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def tidy(run):
    """run, a map over Arrow batches, that gives free memory back when a partition ends: Spark uses a worker again and again."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in a buffer, and for each text its first word's number."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begin[edge] |= inside[edge]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edge - 1] |= inside[edge - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longest part, in bytes, whose hash is a polynomial's: modulo 2**64, Thue-Morse words of 1,024 signs and more have the hash of their complements.
POLYNOMIAL_BYTES = 256


class PartHashes:
    """64-bit hashes of any parts of a byte buffer, by prefix sums modulo 2**64 of random byte values times powers of an odd base; long parts by BLAKE2."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, raw: np.ndarray):
        cls = type(self)
        if len(cls._up) <= len(raw):
            n = max(len(raw) + 1, 2 * len(cls._up))
            cls._up, cls._down = powers(n), powers(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        self.raw = raw
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        value = _BYTE[raw]
        value *= cls._up[: len(raw)]
        np.cumsum(value, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends]
        out -= self.sums[starts]
        out *= type(self)._down[starts]
        size = ends - starts
        out += size.astype(np.uint64)
        out = mix64(out)
        for i in np.flatnonzero(size > POLYNOMIAL_BYTES).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out


class Memo:
    """What a worker remembers of the ids of words: a direct-mapped cache of fixed size, so what it forgets changes no result."""

    def __init__(self, bits: int = 20, most_ids: int = 4 << 20):
        self.bits, self.most = bits, most_ids
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.keys[0] = np.uint64((1 << 64) - 1)  # no slot holds at first what belongs in it
        self.begin, self.count = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _append(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate((self.flat[:at], np.zeros(2 * self.used - at, np.int32)))
        self.flat[at : self.used] = ids
        return at

    def ids_of(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has; encode(places) gives both for the words at some places."""
        if self.used > self.most:
            self.forget()
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        begin, count = self.begin[slot], self.count[slot]
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            distinct, where, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            ids, sizes = encode(new[where])
            sizes = sizes.astype(np.int32)
            starts = (self._append(ids) + np.cumsum(sizes) - sizes).astype(np.int32)
            begin[new], count[new] = starts[inverse], sizes[inverse]
            put = slot[new[where]]
            self.keys[put], self.begin[put], self.count[put] = distinct, starts, sizes
        ends = np.cumsum(count, dtype=np.int64)
        index = np.repeat(begin - (ends - count), count)
        index += np.arange(len(index))
        return self.flat[index], count
