"""Operator 9: substring deduplication by seed and extend.

Every window of `WINDOW` words selects a winnowed anchor of `GRAM` words. Documents
are joined on anchors; an anchor in several documents is a seed and is extended both
ways to all windows that it stands in. A window whose word sequence starts
in a document with a smaller doc_id is a repeat; overlapping repeats join to the
maximal repeats, all at least `WINDOW` words long, which are removed.

Scale: anchors (a fifth of the words) and the windows of seeds move by hash;
whole texts move once, by doc_id. Rows of one anchor or window are combined in each
batch before they move, so a passage that is in a third of all documents sends one row a
batch. No group is collected: a partition is handled as arrays, and no pair of
documents is ever made.

Defined cases: null text has no words; a text under `WINDOW` words keeps all; of
equal documents the smallest doc_id keeps its words; rows that repeat a doc_id count as one
document (a match of one applies to all); null doc_id is nobody's source and keeps its
words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import PartHashes, documents, mix64, slices, text_buffer, tidy, word_spans
from heliodor.llm.seeds import Spans, combine_shared, shared_keys, window_runs, with_lists

WINDOW, GRAM = 13, 6
#: Bytes of text that a worker hashes at once; it holds some 60 bytes for each.
BLOCK = 1 << 20


class _Words:
    """Words of the texts of a batch, and the anchors of their windows."""

    def __init__(self, batch: pa.RecordBatch, window: int, gram: int):
        self.raw, off = text_buffer(batch.column("text"))
        self.doc = batch.column("doc_id")
        self.window = window
        self.starts, self.ends, self.first = word_spans(self.raw, off)
        self.spans = Spans(PartHashes(self.raw).of(self.starts, self.ends))
        n = len(self.starts) - gram + 1
        at = np.arange(max(n, 0))
        self.grams = self.spans.hash(at, at + gram)
        self.low, self.high, self.anchor, self.text = window_runs(self.grams, self.first, window, gram)

    def ids(self) -> np.ndarray:
        return self.doc.fill_null(0).to_numpy(zero_copy_only=False)

    def windows(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the runs, and each one's run."""
        n = high - low + 1
        run = np.repeat(np.arange(len(low)), n)
        return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[run], run


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, repeats (array<long>): hashes of the windows of a document that start in one with a smaller doc_id."""

    def seeds(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                w = _Words(batch, window, gram)
                known = w.doc.is_valid().to_numpy(zero_copy_only=False)[w.text]
                key, doc = w.grams[w.anchor][known], w.ids()[w.text][known]
                rows, route, shared = combine_shared(key, doc, False)
                yield pa.RecordBatch.from_pydict({"route": pa.array(route.view(np.int64)), "key": pa.array(key[rows].view(np.int64)), "doc": pa.array(doc[rows], pa.int64()), "shared": pa.array(shared)})

    def extend(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                batch = batch.filter(batch.column("keys").is_valid())
                if not batch.num_rows:
                    continue
                w = _Words(batch, window, gram)
                keys, sizes = batch.column("keys").flatten().to_numpy(), batch.column("keys").value_lengths().to_numpy()
                # An anchor is a seed in its own document: both are told apart by a mix of document and key.
                salt = mix64(np.arange(batch.num_rows, dtype=np.uint64))
                seeded = np.isin(w.grams[w.anchor] ^ salt[w.text], keys.view(np.uint64) ^ np.repeat(salt, sizes))
                at, run = w.windows(w.low[seeded], w.high[seeded])
                if not len(at):
                    continue
                doc = w.ids()[w.text[seeded][run]]
                key = w.spans.hash(at, at + window)
                # Of a window the smallest document here goes by the window; others here are repeats already.
                order = np.lexsort((doc, key))
                k, d = key[order], doc[order]
                new_key = np.append(True, k[1:] != k[:-1])
                new_row = new_key | np.append(True, d[1:] != d[:-1])
                first = np.maximum.accumulate(np.where(new_key, np.arange(len(k)), 0))
                route = np.where(new_key, k, mix64(k ^ mix64(d.astype(np.uint64))))
                repeat = d > d[first]
                yield pa.RecordBatch.from_pydict({"route": pa.array(route[new_row].view(np.int64)), "key": pa.array(k[new_row].view(np.int64)), "doc": pa.array(d[new_row], pa.int64()), "shared": pa.array(repeat[new_row])})

    def settle(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key, doc = rows.column("key").to_numpy(), rows.column("doc").to_numpy()
        repeat = rows.column("shared").to_numpy().copy()
        own = rows.column("route").to_numpy() == key
        _, group = np.unique(key, return_inverse=True)
        low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group[own], doc[own])
        repeat |= own & (doc > low[group])
        yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[repeat]), "repeat": pa.array(key[repeat])})

    schema = "route long, key long, doc long, shared boolean"
    found = docs.select("doc_id", "text").mapInArrow(tidy(seeds), schema)
    extended = with_lists(docs, shared_keys(found, False)).mapInArrow(tidy(extend), schema)
    settled = extended.repartition("route").mapInArrow(tidy(settle), "doc long, repeat long")
    return settled.groupBy("doc").agg(F.collect_list("repeat").alias("repeats"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and with keep_text the kept words."""

    def strip(batches):
        for whole in batches:
            for batch in slices(whole, BLOCK):
                w = _Words(batch, window, gram)
                lists = batch.column("repeats")
                gone = np.zeros(len(w.starts) + 1, np.int32)
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                if sizes.any():
                    salt = mix64(np.arange(batch.num_rows, dtype=np.uint64))
                    mine = sizes[w.text] > 0
                    at, run = w.windows(w.low[mine], w.high[mine])
                    key = w.spans.hash(at, at + window) ^ salt[w.text[mine][run]]
                    at = at[np.isin(key, lists.flatten().to_numpy().view(np.uint64) ^ np.repeat(salt, sizes))]
                    np.add.at(gone, at, 1)
                    np.subtract.at(gone, at + window, 1)
                kept = np.cumsum(gone[:-1]) == 0
                held = w.raw.tobytes()
                first = w.first.tolist()
                texts = []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    here = np.flatnonzero(kept[a:b]) + a
                    texts.append(b" ".join([held[s:e] for s, e in zip(w.starts[here].tolist(), w.ends[here].tolist(), strict=True)]))
                total = np.append(0, np.cumsum(kept))[w.first]
                n = np.diff(w.first)
                out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - np.diff(total), pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts])}
                if keep_text:
                    out["kept"] = pa.array(texts).cast(pa.string())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return with_lists(docs, find_repeats(docs, window, gram)).mapInArrow(tidy(strip), schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


ORACLE_SQL = {
    "op9_substring_dedup": r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
    SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (h) WHERE doc_id > low
), kept AS (
    SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), k AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
}
