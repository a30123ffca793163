"""Operator 4: removal of repeated byte strings by a sparse, distributed suffix array.

Every string of `LENGTH` bytes selects an anchor (the leftmost lowest-hashed gram
of `GRAM` bytes in it), so equal strings meet under equal anchors at equal places and
only anchored suffixes need be sorted. Anchors that occur once in the corpus are
dropped. Of the others, each sends its suffix, with the bytes before it that its
strings reach back to. Splitters sampled from leading grams range-partition the
suffixes into buckets; each bucket sorts them by multikey quicksort (one 8-byte
key at a time, equal parts going on with their next key), and likewise the
reversed left contexts; common prefixes of neighbours in both orders then tell for each
string whether its left and right part occur together anywhere else.

Splitters are whole leading grams, and a gram on a boundary goes to one side, so
suffixes on two sides of a boundary differ within the gram: what is compared
across boundaries is the leading gram alone, by the splitters themselves.

Scale: one row moves for each anchor (an eightieth of the bytes), whole texts
move once, by doc_id, and some 280 bytes for each repeated anchor. Equal suffixes of
a batch are one row, so a passage that is in a third of all documents sends one row
a batch. Only the splitter sample reaches the driver, and its size is bounded.

Defined cases: null text is empty; texts under `LENGTH` bytes keep all; a string that
overlaps its own repeat counts; rows that repeat a doc_id are documents of their own,
each judged and cut by itself (equal rows: all is removed from both, if they have
`LENGTH` bytes); the text of a null doc_id is compared but itself kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import _BYTE, documents, mix64, numbered, slices, text_buffer, tidy
from heliodor.llm.seeds import Spans, combine_shared, shared_keys, window_runs, with_lists

LENGTH, GRAM = 200, 48
#: Anchors that the splitters are drawn from, at most about, and the texts that are read for them.
SAMPLED_ROWS, ANCHORS_A_ROW = 4000, 16
#: Buckets for each shuffle partition.
BUCKETS = 4
#: Bytes of text that are looked at together (a longer text alone).
BLOCK = 1 << 19


class _Bytes:
    """Texts of a batch as bytes, and the anchors of their strings."""

    def __init__(self, batch: pa.RecordBatch, length: int, gram: int):
        self.raw, self.off = text_buffer(batch.column("text"))
        self.spans = Spans(_BYTE[self.raw])
        at = np.arange(max(len(self.raw) - gram + 1, 0))
        self.grams = self.spans.hash(at, at + gram)
        self.low, self.high, self.anchor, self.text = window_runs(self.grams, self.off, length, gram)
        self.ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of the byte strings in the rows of a matrix.

    Multikey quicksort with 8 bytes as one key: all equal parts of a depth are
    partitioned by their key together, and parts of two or more go one key deeper."""
    n, width = rows.shape
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    keys = keys.view(">u8").astype(np.uint64)
    order = np.argsort(keys[:, 0], kind="stable")
    part = np.append(0, np.cumsum(keys[order[1:], 0] != keys[order[:-1], 0]))
    for depth in range(1, keys.shape[1]):
        size = np.bincount(part)
        open_ = np.flatnonzero(size[part] > 1)
        if not len(open_):
            break
        own, key = part[open_], keys[order[open_], depth]
        again = np.lexsort((key, own))
        order[open_] = order[open_][again]
        key = key[again]
        split = np.zeros(n, bool)
        split[1:] = part[1:] != part[:-1]
        split[open_[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        part = np.cumsum(split)
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, in order, with the one before; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    for i in range(1, len(order), 1 << 15):
        a, b = rows[order[i - 1 : min(i + (1 << 15), len(order)) - 1]], rows[order[i : i + (1 << 15)]]
        differs = a != b
        out[i : i + len(b)] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def repeated_strings(left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """For rows of reversed left contexts and suffixes: a matrix of which strings, by how far they reach back, occur twice.

    low, high: the least and greatest reach of the strings of a row."""
    n = len(left)
    out = np.zeros((n, int(high.max()) + 1), bool)
    orders = [multikey_order(right), multikey_order(left)]
    commons = [_common(right, orders[0]), _common(left, orders[1])]
    for reach in range(int(low.min()), int(high.max()) + 1):
        rows = np.flatnonzero((low <= reach) & (high >= reach))
        if len(rows) < 2:
            continue
        classes = []
        for order, common, depth in zip(orders, commons, (length - reach, reach), strict=True):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(common < depth)
            classes.append(c[rows])
        both = classes[0] * (n + 1) + classes[1]
        by = np.argsort(both, kind="stable")
        same = both[by[1:]] == both[by[:-1]]
        again = np.append(False, same) | np.append(same, False)
        out[rows[by[again]], reach] = True
    return out


def _bytes_at(raw: np.ndarray, at: np.ndarray, step: int, size: np.ndarray, width: int) -> np.ndarray:
    """A matrix of the bytes that follow each place (step 1) or go before it (step -1), 0 beyond size."""
    out = np.zeros((len(at), width), np.uint8)
    along = np.arange(width)[None, :]
    for i in range(0, len(at), 4096):
        part = slice(i, i + 4096)
        index = np.clip(at[part, None] + step * along, 0, len(raw) - 1)
        out[part] = np.where(along < size[part, None], raw[index], 0)
    return out


def _splitters(docs: DataFrame, length: int, gram: int, buckets: int) -> list[bytes]:
    """Leading grams that part the anchored suffixes into about equal buckets, from a bounded sample of texts."""
    total = docs.count()
    if not total:
        return []
    sample = docs.select("doc_id", "text").sample(min(1.0, SAMPLED_ROWS / total), seed=7)

    def lead(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                b = _Bytes(batch, length, gram)
                pick = np.sort(np.argsort(mix64(b.anchor.astype(np.uint64)), kind="stable")[: ANCHORS_A_ROW * batch.num_rows])
                held = b.raw.tobytes()
                yield pa.RecordBatch.from_pydict({"lead": pa.array([held[a : a + gram] for a in b.anchor[pick].tolist()], pa.binary())})

    leads = sorted(bytes(r[0]) for r in sample.mapInArrow(tidy(lead), "lead binary").collect())
    cuts = [leads[i * len(leads) // buckets] for i in range(1, buckets)] if leads else []
    return sorted(set(cuts))


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, spans (array<struct<start, stop>>): bytes of each document that lie in repeated strings; spans may overlap.

    Each row needs a doc_id of its own, as remove_repeats() gives it one."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(docs, length, gram, buckets)

    def anchors(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                b = _Bytes(batch, length, gram)
                key, doc = b.grams[b.anchor], b.ids[b.text]
                rows, route, shared = combine_shared(key, doc, True)
                yield pa.RecordBatch.from_pydict({"route": pa.array(route.view(np.int64)), "key": pa.array(key[rows].view(np.int64)), "doc": pa.array(doc[rows], pa.int64()), "shared": pa.array(shared)})

    def send(batches):
        from bisect import bisect_right

        for whole in batches:
            for batch in slices(whole, BLOCK):
                batch = batch.filter(batch.column("keys").is_valid())
                if not batch.num_rows:
                    continue
                b = _Bytes(batch, length, gram)
                keys, sizes = batch.column("keys").flatten().to_numpy(), batch.column("keys").value_lengths().to_numpy()
                salt = mix64(np.arange(batch.num_rows, dtype=np.uint64))
                mine = np.isin(b.grams[b.anchor] ^ salt[b.text], keys.view(np.uint64) ^ np.repeat(salt, sizes))
                low, high, anchor, text = b.low[mine], b.high[mine], b.anchor[mine], b.text[mine]
                if not len(low):
                    continue
                content = b.spans.hash(low, high + length) ^ mix64((anchor - low).astype(np.uint64))
                order = np.lexsort((low, content))
                new = np.append(True, content[order[1:]] != content[order[:-1]])
                count = np.bincount(np.cumsum(new) - 1)
                alone = np.zeros(len(low), bool)
                alone[order] = count[np.cumsum(new) - 1] == 1
                first = np.zeros(len(low), bool)
                first[order] = new
                held = b.raw.tobytes()
                begin = b.off[text]
                payload = [held[s : e + length] if f else None for s, e, f in zip(low.tolist(), high.tolist(), first.tolist(), strict=True)]
                bucket = np.array([bisect_right(splitters, held[a : a + gram]) if f else -1 - (a % 9973) for a, f in zip(anchor.tolist(), first.tolist(), strict=True)], np.int32)
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket, pa.int32()),
                    "doc": pa.array(b.ids[text], pa.int64()),
                    "start": pa.array(low - begin, pa.int64()),
                    "stop": pa.array(high + length - begin, pa.int64()),
                    "reach": pa.array(anchor - low, pa.int32()),
                    "done": pa.array(~alone),
                    "payload": pa.array(payload, pa.binary()),
                })

    def sort(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        done = rows.column("done").to_numpy()
        doc, start, stop = (rows.column(c).to_numpy() for c in ("doc", "start", "stop"))
        yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[done]), "start": pa.array(start[done]), "stop": pa.array(stop[done])})
        sent = np.flatnonzero(rows.column("payload").is_valid().to_numpy())
        bucket = rows.column("bucket").to_numpy()[sent]
        for one in np.unique(bucket).tolist():
            mine = sent[bucket == one]
            raw, off = text_buffer(rows.column("payload").take(pa.array(mine)))
            reach, size = rows.column("reach").to_numpy()[mine].astype(np.int64), np.diff(off)
            at = off[:-1] + reach
            right = _bytes_at(raw, at, 1, size - reach, length)
            left = _bytes_at(raw, at - 1, -1, reach, max(int(reach.max()), 1))
            twice = repeated_strings(left, right, reach - (size - length), reach, length)
            twice[done[mine]] = False
            edge = np.zeros((len(mine), twice.shape[1] + 2), np.int8)
            edge[:, 1:-1] = twice
            change = np.diff(edge, axis=1)
            r, a = np.nonzero(change == 1)
            _, z = np.nonzero(change == -1)
            anchor = start[mine][r] + reach[r]
            yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[mine][r]), "start": pa.array(anchor - (z - 1)), "stop": pa.array(anchor - a + length)})

    found = docs.select("doc_id", "text").mapInArrow(tidy(anchors), "route long, key long, doc long, shared boolean")
    sent = with_lists(docs, shared_keys(found, True)).mapInArrow(tidy(send), "bucket int, doc long, start long, stop long, reach int, done boolean, payload binary")
    spans = sent.repartition(buckets, "bucket").mapInArrow(tidy(sort), "doc long, start long, stop long")
    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with keep_bytes what is left."""

    def strip(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                raw, off = text_buffer(batch.column("text"))
                lists = batch.column("spans")
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                flat = lists.flatten()
                edge = np.zeros(len(raw) + 1, np.int32)
                base = np.repeat(off[:-1], sizes)
                if len(base):
                    np.add.at(edge, flat.field(0).to_numpy() + base, 1)
                    np.subtract.at(edge, flat.field(1).to_numpy() + base, 1)
                gone = np.cumsum(edge[:-1]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                heads = off[:-1][off[:-1] < len(raw)]
                begins[heads] |= gone[heads]
                n, runs = (np.append(0, np.cumsum(x))[off] for x in (gone, begins))
                left = raw[~gone].tobytes()
                at = off - n
                kept = [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(n), pa.int64()), "n_spans": pa.array(np.diff(runs), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
                if keep_bytes:
                    out["kept"] = pa.array(kept, pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    rows = numbered(docs.select("doc_id", "text"), "row")
    texts = docs.select("doc_id", "text") if rows is None else rows.select(F.col("row").alias("doc_id"), "text")
    spans = find_repeats(texts, length, gram)
    if rows is not None:  # a row without a doc_id is compared, but itself kept
        spans = spans.join(rows.where("doc_id IS NOT NULL").select(F.col("row").alias("doc")), "doc", "left_semi")
    made = with_lists(texts, spans).mapInArrow(tidy(strip), schema)
    if rows is None:
        return made
    return made.withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row").select(*made.columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
