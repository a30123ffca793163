"""Operator 13: SentencePiece encoding and decoding by a table of distinct chunks.

The model's pieces hold white-space markers at their front alone, so no merge crosses the
place before a run of markers. A chunk is such a run with the signs behind it, and a text is
the sequence of its chunks. Texts are coded in blocks: a block's documents become numbers
into its own list of distinct chunks, and the lists, not the words, are shuffled, by
buckets of a hash. A bucket's table holds each of its distinct chunks once and segments it
once; its pieces go back to the lists, and a block's documents are put together by position.

Defined cases: a null or empty text has no ids and decodes as the empty text; a literal
marker sign is white space, as in the library; signs without a piece become byte pieces;
equal scores merge from the left; rows that repeat a doc_id or lack it are each encoded as
they are; other columns of docs are ignored, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from heliodor.llm.common import PartHashes, documents, slices, text_buffer, tidy

#: Fixed value: the sign that stands for a space in pieces.
MARKER = "▁"
#: Bytes of text whose chunks are listed together (a longer text alone).
BLOCK_BYTES = 16 << 20
#: Longest chunk, in signs, that merges in lockstep with others of its length.
LOCKSTEP = 64
NO_RANK = 2**31 - 1


class PieceModel:
    """The pieces of a byte-fallback BPE model, and segmentation by them: of all adjacent pairs that form a piece the best score merges first, the leftmost of equals."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = library.get_piece_size()
        every = range(self.n)
        plain = [i for i in every if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        text = {i: library.id_to_piece(i) for i in plain}
        byte = {int(library.id_to_piece(i)[3:5], 16): i for i in every if library.is_byte(i)}
        probe = f" a  b{MARKER}ﬁ "
        if library.normalize(probe) != MARKER + probe.replace(" ", MARKER) or len(byte) < 256 or any(library.is_unused(i) for i in every):
            raise ValueError("a model with dummy prefix, byte fallback, no unused pieces and no other normalization is needed")
        if any(MARKER in piece.lstrip(MARKER) for piece in text.values()):
            raise ValueError("pieces cross white-space markers")
        self.id_of = {piece: i for i, piece in text.items()}
        self.score = {piece: library.get_score(i) for i, piece in text.items()}
        self.byte_id = [byte[b] for b in range(256)]
        self.bytes_of = {i: piece.replace(MARKER, " ").encode() for i, piece in text.items()} | {i: bytes([b]) for b, i in byte.items()}
        # a symbol is a piece's id, or for a sign without a piece n and its code point
        self.symbol = np.arange(self.n, self.n + 0x110000, dtype=np.int64)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            elif not all(sign in self.id_of for sign in piece):
                raise ValueError("a piece has a sign that is no piece")
        self.symbol[32] = self.symbol[ord(MARKER)]
        rank = {score: r for r, score in enumerate(sorted(set(self.score.values()), reverse=True))}
        splits = [(self.id_of[x], self.id_of[y], rank[self.score[p]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if (x := p[:k]) in self.id_of and (y := p[k:]) in self.id_of]
        left, right, order, made = np.array(splits, np.int64).T
        keys = left << 32 | right
        by_key = np.argsort(keys)
        self.keys, self.made, self.order = keys[by_key], np.append(made[by_key], 0), np.append(order[by_key], NO_RANK).astype(np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The places of pairs in the table; its end for those that form no piece."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, at, len(self.keys)).astype(np.int32)

    def segment_all(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk (spaces are markers). Chunks of a length merge in lockstep, one pair of each a round."""
        out: list = [None] * len(chunks)
        signs = [c.decode() for c in chunks]
        size = np.fromiter(map(len, signs), np.int64, len(signs))
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n > LOCKSTEP:
                for r in rows.tolist():
                    out[r] = self.segment(signs[r].replace(" ", MARKER))
                continue
            points = np.frombuffer("".join(map(signs.__getitem__, rows.tolist())).encode("utf-32-le"), np.uint32).reshape(-1, n)
            held = self.symbol[points]
            pair = self._pairs(held[:, :-1], held[:, 1:]) if n > 1 else np.zeros((len(rows), 0), np.int32)
            while len(rows):
                width = held.shape[1]
                best = np.argmin(self.order[pair], axis=1) if width > 1 else np.zeros(len(rows), np.int64)
                each = np.arange(len(rows))
                ready = self.order[pair[each, best]] == NO_RANK if width > 1 else np.ones(len(rows), bool)
                for r, ids in zip(rows[ready].tolist(), held[ready].tolist(), strict=True):
                    out[r] = ids if max(ids) < self.n else self._spelled(ids)
                rows, held, pair, best = rows[~ready], held[~ready], pair[~ready], best[~ready]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                held[each, best] = self.made[pair[each, best]]
                keep = np.ones(held.shape, bool)
                keep[each, best + 1] = False
                held = held[keep].reshape(len(rows), width - 1)
                pair = pair[keep[:, 1:]].reshape(len(rows), width - 2)
                for at in (best - 1, best):  # the pairs that the new piece is the right and the left of
                    some = np.flatnonzero((at >= 0) & (at < width - 2))
                    pair[some, at[some]] = self._pairs(held[some, at[some]], held[some, at[some] + 1])
        return out

    def _spelled(self, symbols: list[int]) -> list[int]:
        return [i for s in symbols for i in ([s] if s < self.n else map(self.byte_id.__getitem__, chr(s - self.n).encode()))]

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk, by a heap of its pairs: for chunks of any length."""
        held: list[str | None] = list(chunk)
        n, score = len(held), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score.get(chunk[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if held[i] is None or (j := after[i]) >= n or len(held[i]) + len(held[j]) != size:
                continue  # one of the two has merged with another meanwhile
            held[i] += held[j]
            held[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(held[i] + held[k])) is not None:
                    heapq.heappush(heap, (-s, i, len(held[i]) + len(held[k])))
            if (h := before[i]) >= 0 and (s := score.get(held[h] + held[i])) is not None:
                heapq.heappush(heap, (-s, h, len(held[h]) + len(held[i])))
        return self._spelled([self.id_of.get(piece, self.n + ord(piece[0])) for piece in held if piece is not None])

    def decode(self, ids: list[int]) -> str:
        """The text of ids that segment() made; the dummy prefix at its front goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All chunks of the texts one after the other, white space as spaces, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, MARKER, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    raw, off = text_buffer(texts)
    space = raw == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[off[:-1][np.diff(off) > 0]] = True  # each text starts with its prefix
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, len(raw)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)])
    return words, np.diff(np.searchsorted(starts, off))


def _packed(values: np.ndarray) -> bytes:
    """Numbers under 2**32 as four planes of bytes, compressed."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(packed, 4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _blocks(batches):
    """For each block of texts: its number, a checksum of it, its batch, what chunks_of() gives and each chunk's place among the distinct ones, and those, the most frequent first."""
    block = (TaskContext.get().partitionId() << 32) - 1
    for batch in (part for whole in batches for part in slices(whole, BLOCK_BYTES)):
        block += 1
        words, sizes = chunks_of(batch.column("text"))
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        by_use = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")
        place = np.empty(len(by_use), np.int64)
        place[by_use] = np.arange(len(by_use))
        distinct = coded.dictionary.take(pa.array(by_use))
        raw, off = text_buffer(distinct)
        yield block, zlib.crc32(raw), batch, sizes, place[index], distinct, PartHashes(raw).of(off[:-1], off[1:])


def _lists(n_buckets: int):
    def run(batches):
        """The chunks of each block by bucket: a row holds those of one bucket."""
        for block, check, _, _, _, distinct, hashes in _blocks(batches):
            bucket = (hashes % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            raw, off = text_buffer(distinct.take(pa.array(order)))
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(order))
            if not len(order):
                continue
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(begins), block)),
                "checked": pa.array(np.full(len(begins), check)),
                "bucket": pa.array(bucket[order][begins]),
                "sizes": pa.array([_packed(np.diff(off[a : b + 1])) for a, b in zip(begins, ends, strict=True)], pa.binary()),
                "n": pa.array((ends - begins).astype(np.int32)),
                "chunks": pa.array([pa.compress(raw[off[a] : off[b]].tobytes(), codec="zstd", asbytes=True) for a, b in zip(begins, ends, strict=True)], pa.binary()),
                "n_bytes": pa.array(off[ends] - off[begins]),
            })

    return run


def _codes(n_buckets: int):
    def run(batches):
        """The documents of each block: their ids, numbers of chunks and the chunks as places in the block's list."""
        for block, check, batch, sizes, codes, _, hashes in _blocks(batches):
            row = {"block": block, "checked": check, "doc_ids": batch.column("doc_id").cast(pa.int64()).to_pylist(), "sizes": sizes.tolist(), "codes": _packed(codes), "n": len(hashes), "buckets": _packed(hashes % np.uint64(n_buckets))}
            yield pa.RecordBatch.from_pylist([row], CODES)

    return run


CODES = pa.schema([("block", pa.int64()), ("checked", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("n", pa.int32()), ("buckets", pa.binary())])


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids as array<int>, of each row of docs.

    docs is read twice and has to give the same rows in the same order each time, as files do; if it does not, a checksum stops the job."""
    texts = docs.select("doc_id", "text")
    n_buckets = 4 * max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def segmented(batches):
        """The table of distinct chunks of this partition's buckets, and each list's ids from it."""
        pieces, known = model(path), {}
        for batch in batches:
            lists = []
            for row in batch.select(["sizes", "n", "chunks", "n_bytes"]).to_pylist():
                off = np.append(0, np.cumsum(_unpacked(row["sizes"], row["n"]))).astype(np.int64)
                held = pa.decompress(row["chunks"], row["n_bytes"], codec="zstd", asbytes=True)
                lists.append(list(map(held.__getitem__, map(slice, off[:-1].tolist(), off[1:].tolist()))))
            new = list({c for chunks in lists for c in chunks} - known.keys())
            for begin in range(0, len(new), 1 << 16):
                part = new[begin : begin + (1 << 16)]
                known.update((c, np.array(ids, "<u4").tobytes()) for c, ids in zip(part, pieces.segment_all(part), strict=True))
            ids, counts = [], []
            for chunks in lists:
                own = list(map(known.__getitem__, chunks))
                counts.append(_packed(np.fromiter(map(len, own), np.int64, len(own)) >> 2))
                ids.append(_packed(np.frombuffer(b"".join(own), "<u4")))
            total = [int(_unpacked(c, n).sum()) for c, n in zip(counts, batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("block", "checked", "bucket", "n")), pa.array(counts, pa.binary()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["of", "checked", "bucket", "n", "counts", "n_ids", "ids"])

    def joined(held: pa.Table, spelled: pa.Table) -> pa.Table:
        pieces = model(path)
        row = held.to_pylist()[0]
        bucket = _unpacked(row["buckets"], row["n"])
        order = np.argsort(bucket, kind="stable")
        ids: list = [None] * row["n"]
        first = np.searchsorted(bucket[order], np.arange(n_buckets))
        for part in spelled.to_pylist():
            begin = int(first[part["bucket"]])
            ends = np.cumsum(_unpacked(part["counts"], part["n"])).tolist()
            flat = _unpacked(part["ids"], part["n_ids"]).tolist()
            if part["checked"] != row["checked"]:
                raise ValueError("docs gave other rows when it was read again")
            for at, a, b in zip(order[begin : begin + part["n"]].tolist(), [0, *ends[:-1]], ends, strict=True):
                ids[at] = flat[a:b]
        said = [",".join(map(str, own)) for own in ids]
        text = [b"".join(map(pieces.bytes_of.__getitem__, own)) for own in ids]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        codes, begin = _unpacked(row["codes"], sum(row["sizes"])), 0
        out = {"doc_id": row["doc_ids"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if keep_ids else {})
        for size in row["sizes"]:
            part = codes[begin : begin + size]
            own, begin = part.tolist(), begin + size
            out["n_tokens"].append(int(count[part].sum()))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(said.__getitem__, own)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join(map(text.__getitem__, own))[1:]).hexdigest())
            if keep_ids:
                out["ids"].append([i for k in own for i in ids[k]])
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        return pa.table({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    lists = texts.mapInArrow(tidy(_lists(n_buckets)), "block long, checked long, bucket int, sizes binary, n int, chunks binary, n_bytes long")
    spelled = lists.repartition("bucket").mapInArrow(tidy(segmented), "of long, checked long, bucket int, n int, counts binary, n_ids long, ids binary")
    codes = texts.mapInArrow(tidy(_codes(n_buckets)), "block long, checked long, doc_ids array<long>, sizes array<int>, codes binary, n int, buckets binary")
    return codes.groupBy("block").cogroup(spelled.groupBy("of")).applyInArrow(joined, schema)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
