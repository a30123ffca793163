"""Anchors for exact substring search: the lowest-hashed gram of every window.

A window of a text selects the leftmost gram with the lowest hash. Equal windows
select the same gram at the same place in them, wherever they are, so two
occurrences of a window meet under one anchor and no other pair need be looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliodor.llm.common import mix64, powers, tidy

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bits of a place in one segment, beside which 40 bits of hash are compared.
_PLACE = 24


class Spans:
    """Hashes of any spans of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        self.back = powers(len(values) + 1, _BACK)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values), _BASE), out=self.sums[1:]) if len(values) else None

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of keys[i:i + width] for each i that has a whole window."""
    n, have = len(keys) - width + 1, 1
    out = keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` grams the place of its leftmost lowest gram."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    step = (1 << _PLACE) - width
    parts = []
    for at in range(0, n, step):
        part = grams[at : min(at + step + width - 1, len(grams))]
        keys = (part & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(part), dtype=np.uint64)
        parts.append((_lowest(keys, width) & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + at)
    return np.concatenate(parts)


def window_runs(grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: first window, last window, anchor, number of the text.

    grams: a hash at each place where a gram of `gram` values starts in the values of
    all texts; first: where each text begins, and the end. Windows stay in their text."""
    width = window - gram + 1
    at = anchors(grams, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    inside = np.arange(len(at)) + window <= first[1:][text] if len(at) else np.zeros(0, bool)
    where = np.flatnonzero(inside)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    a, t = at[where], text[where]
    new = np.ones(len(where), bool)
    new[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1]) | (where[1:] != where[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(where)) - 1
    return where[begin], where[last], a[begin], t[begin]


def combine_shared(key: np.ndarray, doc: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows to send, their route, whether they are known to be shared), of rows (key, doc).

    One row of a key goes by its key, so a key that is everywhere has no more rows
    than there are batches. A key that meets itself here (with same_doc in one
    document too, else in two documents) is known to be shared: its other rows go by a mixed route."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_row = new_key | np.append(True, d[1:] != d[:-1])
    group = np.cumsum(new_key) - 1
    count = np.bincount(group, weights=None if same_doc else new_row)
    shared = count[group] > 1
    keep = new_row
    route = np.where(new_key, k, mix64(k ^ mix64(d.astype(np.uint64))))
    return order[keep], route[keep], shared[keep]


def shared_keys(found: DataFrame, same_doc: bool) -> DataFrame:
    """doc, keys (array<long>): the keys of each document that occur more than once (with same_doc), or in several documents.

    found has route, key, doc, shared, as combine_shared leaves them."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        key = rows.column("key").to_numpy().view(np.uint64)
        doc = rows.column("doc").to_numpy()
        own = rows.column("route").to_numpy().view(np.uint64) == key
        shared = rows.column("shared").to_numpy().copy()
        _, group = np.unique(key, return_inverse=True)
        n = int(group.max()) + 1
        count = np.bincount(group, weights=own & ~shared, minlength=n) + 2 * np.bincount(group, weights=own & shared, minlength=n)
        if not same_doc:  # rows of one document from several batches are no second document
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(low, group[own], doc[own])
            np.maximum.at(high, group[own], doc[own])
            count = np.where(np.bincount(group, weights=own & shared, minlength=n) > 0, 2, (high > low) + 1)
        shared |= own & (count[group] > 1)
        yield pa.RecordBatch.from_pydict({"doc": pa.array(doc[shared]), "key": pa.array(key[shared].view(np.int64))})

    met = found.repartition("route").mapInArrow(tidy(run), "doc long, key long")
    return met.groupBy("doc").agg(F.collect_list("key").alias("keys"))


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, text and the list columns of the rows of docs; documents are shuffled by doc_id, never sorted."""
    return docs.select("doc_id", "text").join(lists.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id", "left")
