"""Operator 5: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All distinct pre-tokens of an Arrow batch form one linked list of token ids in
which no pair crosses a pre-token. One bucket for each merge rank holds
positions; a three-level bitmap over the buckets gives the lowest rank that is
not empty by find-first-set. Popped positions whose pair has changed meanwhile
(stale entries) are skipped. All merges of a rank that are independent of one
another are done together with numpy, so a pre-token of megabytes costs as many
rounds as it has ranks, not as it has merges.

Defined cases: null text encodes as the empty text (no ids); ties between equal
ranks go to the leftmost pair, as in tiktoken; duplicates and extra columns are
left as they are.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from heliodor.llm.common import Memo, PartHashes, documents, slices, text_buffer, tidy

NO_RANK, _FREE = np.int32(2**31 - 1), np.uint64(2**63)
#: Bytes of text that are encoded together (a longer text alone).
BLOCK_BYTES = 1 << 19
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Fixed value: the pre-token pattern of the vocabulary, which split() implements by classes of signs.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankQueue:
    """Buckets of positions by rank, under a three-level bitmap of 64-bit words."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray] | None] = [None] * ranks
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: np.ndarray) -> None:
        held = self.buckets[rank]
        if held is None:
            self.buckets[rank] = [at]
            self.leaf[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            held.append(at)

    def push_all(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begin = 0
        for rank, end in zip(ranks[np.concatenate(([0], cuts))].tolist(), [*cuts.tolist(), len(at)], strict=True):
            self.push(rank, at[begin:end])
            begin = end

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) + (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = (b << 6) + (self.leaf[b] & -self.leaf[b]).bit_length() - 1
        self.leaf[b] &= self.leaf[b] - 1
        if not self.leaf[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        held, self.buckets[rank] = self.buckets[rank], None
        return rank, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


class BytePairEncoder:
    """Encoder and decoder for ranks in tiktoken's file format."""

    def __init__(self, path: str, pattern: str):
        import regex

        if pattern != PATTERN:
            raise ValueError("split() knows one pattern")
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.said = list(map(str, range(max(self.ranks.values()) + 1)))
        self.kinds = np.full(0x110000, OTHER, np.int8)
        for low in range(0, 0x110000, 1 << 14):
            every = "".join(chr(c) for c in range(low, low + (1 << 14)) if not 0xD800 <= c < 0xE000)
            for kind, sign in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
                for run in regex.finditer(sign, every):
                    self.kinds[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
        self.memo = Memo(19, 2 << 20)
        self.n = max(self.ranks.values()) + 1
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = array("q"), array("q"), array("i")
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        left, right, rank = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64), np.frombuffer(rank, np.int32)
        self._hash_pairs(left, right, rank)
        #: Tokens that some token before (behind) them makes one of a lower rank with; no pair of any other is looked up for that.
        self.sinks_back, self.sinks_on = (np.zeros(self.n, bool) for _ in range(2))
        self.sinks_back[right[rank < right.astype(np.int64)].astype(np.int64)] = True
        self.sinks_on[left[rank < left.astype(np.int64)].astype(np.int64)] = True

    def _hash_pairs(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        """Open addressing with linear probing, filled probe by probe."""
        self.bits = max(16, int(np.ceil(np.log2(len(left) * 3 + 1))))
        keys = (left << np.uint64(20)) | right
        self.keys = np.full((1 << self.bits) + 64, np.uint64(2**63), np.uint64)
        self.vals = np.full(len(self.keys), NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**63)
            _, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.vals[slot[put]] = keys[put], rank[put]
            todo = np.setdiff1d(todo, put)
            slot[todo] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        miss = there != keys
        out = self.vals[slot]
        out[miss] = NO_RANK
        miss &= there != _FREE
        todo = np.flatnonzero(miss)
        while len(todo):
            slot[todo] += 1
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**63))]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and how many each piece has."""
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), size
        none = n  # the place before a piece's first and after its last token
        seg = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        tok = np.append(self.byte_id[raw], np.int32((1 << 20) - 1))
        nxt = np.arange(1, n + 2, dtype=np.int32)
        prv = np.arange(-1, n, dtype=np.int32)
        filled = size[size > 0]
        last = np.cumsum(filled) - 1
        nxt[last], prv[last - filled + 1], nxt[n] = none, none, none
        rank = self.pair_rank(tok, tok[nxt])
        queue = RankQueue(self.n)
        at = np.flatnonzero(rank[:n] != NO_RANK).astype(np.int32)
        if len(at):
            queue.push_all(rank[at], at)
        while (popped := queue.pop()) is not None:
            r, at = popped
            at = at[rank[at] == r]
            if not len(at):
                continue
            p, q = at, nxt[at]
            if len(p) > 1 and (chained := q[:-1] == p[1:]).any():
                index = np.arange(len(p))
                index[1:] -= np.maximum.accumulate(np.where(np.append(False, chained), 0, index))[1:]
                p, q = p[(index & 1) == 0], q[(index & 1) == 0]
            before, after = prv[p], nxt[q]
            low, new = np.zeros(len(p), bool), np.full(1, r, np.int32)
            if self.sinks_back[r]:
                left = tok[before]
                if len(p) > 1:
                    left[1:][after[:-1] == p[1:]] = r
                low |= self.pair_rank(left, new) < r
            if self.sinks_on[r]:
                low |= self.pair_rank(new, tok[after]) < r
            if low.any():  # that lower pair comes first in its piece: leave the rest of the piece for later
                pieces_low, first = np.unique(seg[p[low]], return_index=True)
                stop = np.full(len(pieces_low), n, np.int64)
                stop[:] = p[low][first]
                place = np.minimum(np.searchsorted(pieces_low, seg[at]), len(pieces_low) - 1)
                late = (pieces_low[place] == seg[at]) & (at > stop[place])
                if late.any():
                    queue.push(r, at[late])
                    keep = ~np.isin(p, at[late])
                    p, q, after, before = p[keep], q[keep], after[keep], before[keep]
            tok[p] = r
            tok[q] = -1
            rank[q] = NO_RANK
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            changed = np.concatenate((p, before[before != none]))
            fresh = self.pair_rank(tok[changed], tok[nxt[changed]])
            rank[changed] = fresh
            if (some := fresh != NO_RANK).any():
                queue.push_all(fresh[some], changed[some])
        left = tok[:n] >= 0
        return tok[:n][left], np.bincount(seg[left], minlength=len(pieces))

    def split(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of all pre-tokens of texts held one after the other, and the number of the first of each text.

        The pattern's alternatives by runs of one class: a space joins the run of
        letters, digits or other signs behind it, white space before the last
        sign of its run stands alone, and an apostrophe takes its contraction."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self.kinds[self._points(raw, lead)]
        first = np.searchsorted(lead, off)
        new_text = np.zeros(len(lead) + 1, bool)
        new_text[first] = True
        run = new_text[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        run[:1] = True
        begin = run.copy()
        space = kind == SPACE
        ends_run = np.append(run[1:], True)
        ends_text = new_text[1:]
        tail = space & ends_run & ~ends_text  # the last white space before a run of another class
        begin |= tail
        blank = raw[lead] == 32
        begin[1:] &= ~((tail & blank)[:-1] & ~new_text[1:-1])
        mark = np.flatnonzero((raw[lead] == 39) & begin & ends_run & ~ends_text)
        if len(mark):
            at = np.concatenate((lead, [len(raw), len(raw), len(raw)]))
            padded = np.append(raw, np.uint8(0))
            c1, c2 = padded[at[mark + 1]], padded[at[mark + 2]]
            same = ~new_text[np.minimum(mark + 2, len(lead))] & (mark + 2 < len(lead))
            one = np.isin(c1, np.frombuffer(b"stmd", np.uint8))
            two = same & (((c2 == 101) & ((c1 == 114) | (c1 == 118))) | ((c1 == 108) & (c2 == 108)))
            for hit, n in ((one, 1), (two & ~one, 2)):
                m = mark[hit]
                begin[m + 1] = False
                m = m[m + 1 + n < len(lead)] + 1 + n
                begin[m[~space[m]]] = True
        starts = lead[begin]
        return starts, np.searchsorted(starts, off)

    @staticmethod
    def _points(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
        points = raw[lead].astype(np.int32)
        for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
            at = np.flatnonzero((points >= low) & (points < high) & (raw[lead] >= low))
            if len(at):
                value = points[at] & bits
                for k in range(1, more + 1):
                    value = (value << 6) | (raw[lead[at] + k] & 0x3F)
                points[at] = value
        return points

    def _ids_of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens, and how many each has. Each distinct one is encoded once and remembered."""

        def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            held = raw.tobytes()
            pieces = [held[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            whole = [self.ranks.get(p) for p in pieces]
            ids, counts = self.encode_pieces([p if w is None else b"" for p, w in zip(pieces, whole, strict=True)])
            single = np.array([-1 if w is None else w for w in whole], np.int32)
            flat = np.empty(len(ids) + int((single >= 0).sum()), np.int32)
            counts = np.where(single >= 0, 1, counts)
            alone = np.repeat(single >= 0, counts)
            flat[alone], flat[~alone] = single[single >= 0], ids
            return flat, counts

        return self.memo.ids_of(PartHashes(raw).of(starts, ends), fresh)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts raw[off[i]:off[i + 1]] in one array, and where each text's begin."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        starts, first = self.split(raw, off)
        ids, count = self._ids_of(raw, starts, np.append(starts[1:], len(raw)))
        return ids, np.append(0, np.cumsum(count))[first]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(path: str, pattern: str) -> BytePairEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BytePairEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids as array<int>.

    A map over the texts: nothing is shuffled. Other columns of docs are ignored."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches):
        bpe = encoder(path, pattern)
        said = bpe.said
        for batch in (part for whole in batches for part in slices(whole, BLOCK_BYTES)):
            raw, off = text_buffer(batch.column("text"))
            ids, cuts = bpe.encode(raw, off)
            digests, decoded = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # one text at a time is a list of Python numbers
                own = ids[a:b].tolist()
                digests.append(hashlib.sha256(" ".join(map(said.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            out = {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
