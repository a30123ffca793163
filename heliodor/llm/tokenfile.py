"""Operator 1: token ids in a binary format, by an adaptive context-mixing range coder.

Ids are cut into blocks of `BLOCK` ids. A block starts from an empty model, so it is
decoded alone, and carries a checksum of its ids. Four events say what predicts the next id:
order 2 (the id that last followed the two ids before), order 1 (the one that last followed
the id before), order 0 (an id that the block has had, by its frequency so far; the
frequencies are counted anew each time the block has doubled), or none of them (a new
id, by a prior that falls with its high byte). The event's probabilities mix what
this block has seen in the context (how well either order did when it was last here, and
whether they agree) with what it has seen in all contexts. Event and order-0 id
are one symbol of a range coder with a 48-bit window. Arithmetic is on integers, or on
doubles below 2**53 with + - * / and floor alone, so every machine decodes alike.

All blocks of a task are coded in lockstep, one numpy lane a block.

Format. A row of the dataset is a segment: whole documents, about `SEGMENT` ids.
Its bytes are, little-endian:

    "HTOK" version:u32 n_docs:u32 n_blocks:u32 doc_bytes:u32
    doc table (zlib): n_docs doc_ids:i64, n_docs nulls:u8, n_docs n_tokens:u32
    block table: n_blocks times n_ids:u32 n_words:u32 crc32:u32 (of the ids as u32)
    n_words:u16 words of each block

Columns beside it: part and segment (order of the segments), first (ids of the part
before it), n_docs, n_tokens. Files are written by Spark's committer, so a lost task leaves
nothing half-written.

Defined cases: null text is the empty text (its end id alone); rows go by doc_id (null
first), then text; repeated rows are documents of their own; extra columns are ignored.
Ids up to 2**27 - 2 are supported, far beyond any vocabulary; a larger one is an error.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliodor.llm.common import _SPACE, Memo, PartHashes, documents, shared_dir, text_buffer, tidy, word_spans

MAGIC, VERSION = b"HTOK", 2
BLOCK, SEGMENT = 2048, 1 << 20
#: Ids that wait to be coded or decoded in lockstep at most, beside one segment.
LOCKSTEP = 8 << 20
#: Bytes of text that are parted into words together (a longer text alone).
TEXT_BLOCK = 1 << 20
MOST_ID = (1 << 27) - 2
_T = 1 << 16
_BITS1, _BITS2 = 9, 10
#: What each event has at least, of _T.
_LEAST = 24
#: Order-0 counts are taken anew at the first of these places and each time the block has doubled.
_FIRST_COUNT = 64
_ID, _NEW = np.array((1 << 27) - 1, np.int32), np.array(1, np.int32)


def _const(value, kind=np.float64) -> np.ndarray:
    """A number that numpy need not convert at each use."""
    return np.array(value, kind)


_ONE, _WINDOW, _WORD, _MORE = _const(1), _const(1 << 32), _const(1 << 16), _const((1 << 16) - 1)
_A_WORD, _A_WINDOW, _A_NEW, _MORE_OF = _const(1 / (1 << 16)), _const(1 / (1 << 32)), _const(1 / (1 << 24)), _const(((1 << 16) - 1) / (1 << 32))
_UP4, _DOWN2, _DOWN27, _DOWN29 = _const(4, np.int8), _const(2, np.int32), _const(27, np.int32), _const(29, np.int32)
_CONTEXTS = 32
#: How fast an event's shares move to what is seen, in one context and in all.
_RATE, _RATE_ALL = 1 / 24, 1 / 48
#: The share of the context's own estimate in the mixture.
_OWN = 0.75
#: Cumulative shares before events 0 (always 0), 1, 2 and 3, if the event (row) were sure.
_SURE = np.array([[0, 1, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1], [0, 0, 0, 0]], np.float64)


def _fours(rows: np.ndarray) -> np.ndarray:
    """Rows of four float32 as numbers of 16 bytes, which numpy gathers and scatters at once."""
    return np.ascontiguousarray(rows, np.float32).view(np.complex128).reshape(-1)


_STEP, _STEP_ALL = _fours(_SURE * _RATE * _OWN), _fours(_SURE * _RATE_ALL * (1 - _OWN))
_KEEP, _KEEP_ALL = _const(1 - _RATE, np.float32), _const(1 - _RATE_ALL, np.float32)


def _first_shares() -> np.ndarray:
    """Cumulative shares that each context begins with: the surer an order (0 no guess, 1 one, 2 one that held), the more."""
    out = np.zeros((_CONTEXTS, 4))
    for c in range(_CONTEXTS):
        order2, order1 = (c >> 2) & 3, c & 3
        p2 = (0.0, 0.25, 0.625, 0.625)[order2]
        p1 = 0.0 if c & 16 else (1 - p2) * (0.0, 0.125, 0.375, 0.375)[order1]
        out[c] = 0, p2, p2 + p1, p2 + p1 + (1 - p2 - p1) * 0.625
    return out


_FIRST_SHARES = _first_shares()


def _prior() -> np.ndarray:
    """Cumulative prior of the 256 high bytes of ids under 2**16, falling as 1 / (byte + 24), and of all longer ids, of _T."""
    weight = np.cumsum((1 << 24) // (np.arange(256) + 24))
    share = weight * (_T - 257 * 16) // weight[-1] + 16 * np.arange(1, 257)
    return np.concatenate(([0], share, [_T])).astype(np.float64)


_HIGH = _prior()
_EACH = np.diff(_HIGH)  # of each low byte, of 256 * _T
_HIGH_OF = np.repeat(np.arange(257), np.diff(_HIGH).astype(np.int64))
#: How the bits above the lowest byte of a longer id are coded: from which bit, and of how many values.
_FAR = ((16, 1 << 12), (8, 1 << 8))
#: Of the places of ids in the tables of orders 1 and 2: factors (of the id before; of the two before for order 2) and greatest places.
_TIMES1, _TIMES2, _TIMES_BEFORE2 = (np.array(k, np.uint32) for k in (40503, 60493, 52711))
_MOST1, _MOST2 = (np.array((1 << bits) - 1, np.uint32) for bits in (_BITS1, _BITS2))
_KEY, _DOWN4 = np.array(0xFFFF, np.uint32), np.array(4, np.uint32)


def _place(key: np.ndarray, times: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The place of an id's low 16 bits: a product below 2**32, its upper bits. (Cheaper than a look at a table that no core's cache holds.)"""
    at = key * times
    at >>= _DOWN4
    at &= most
    return at


class _Model:
    """The adaptive model of a number of lanes. Tables hold id + 1, and above it how sure it is.

    Shares are sums below an event, four a lane. As 16-bit numbers their differences are the events' shares, the
    last event's too, whose end _T is 0."""

    def __init__(self, lanes: int):
        at = np.arange(lanes)
        self.at, self.at_seen, self.at_shares = np.stack((at, at)), at * _CONTEXTS, at * 4
        self.at *= (1 << _BITS1) + (1 << _BITS2)
        self.at[1] += 1 << _BITS1
        self.guesses = np.zeros(lanes * ((1 << _BITS1) + (1 << _BITS2)), np.int32)
        self.seen = np.tile(_fours(_FIRST_SHARES * _OWN), lanes)
        self.all = np.tile((_FIRST_SHARES[9] * (1 - _OWN)).astype(np.float32), lanes)
        self.shares = np.zeros(4 * lanes + 1, np.uint16)
        self.by_event = self.shares[:-1].reshape(lanes, 4).T
        self.counting(0)

    def counting(self, counted: int) -> None:
        """Order 0 has now counted so many ids, and needs as much of _T."""
        self.free = _const(_T - counted - 4 * _LEAST, np.float32)
        self.least = np.tile(np.array([0, _LEAST, 2 * _LEAST, 3 * _LEAST + counted], np.uint16), len(self.at_seen))

    def look(self, i: np.ndarray) -> np.ndarray:
        """What orders 1 and 2 (rows) guess, plus 1; leaves the cumulative shares of the events in self.shares."""
        n = i.shape[1]
        e = self.guesses.take(i)
        g = e & _ID
        e >>= _DOWN27
        e2 = e[1]
        e2 += e[0] >> _DOWN2
        e2 += (g[0] == g[1]).view(np.int8) << _UP4
        self.c = self.at_seen[:n] + e2
        self.rows = self.seen.take(self.c)
        mix = self.rows.view(np.float32) + self.all[: 4 * n]
        mix *= self.free
        shares = self.shares[: 4 * n]
        np.copyto(shares, mix, casting="unsafe")  # rounds down
        shares += self.least[: 4 * n]
        return g

    def share(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's event begins, and its share."""
        place = self.at_shares[: len(event)] + event
        cum = self.shares.take(place)
        place += 1
        f = self.shares.take(place)
        f -= cum
        return cum.astype(np.float64), f.astype(np.float64)

    def learn(self, event: np.ndarray) -> None:
        rows = self.rows.view(np.float32)
        rows *= _KEEP
        rows += _STEP.take(event).view(np.float32)
        self.seen[self.c] = self.rows
        every = self.all[: len(rows)]
        every *= _KEEP_ALL
        every += _STEP_ALL.take(event).view(np.float32)

    def guess(self, i: np.ndarray, after: np.ndarray, held: np.ndarray) -> None:
        """Set what orders 1 and 2 guess to the ids, plus 1: as guesses that held (2 in the upper bits) where they did, as new ones (1) elsewhere."""
        entry = held.astype(np.int32)
        entry += _NEW
        entry <<= _DOWN29
        entry += after
        self.guesses[i.reshape(-1)] = entry.reshape(-1)


def _counted_until(t: int) -> int:
    """How many ids order 0 has counted when the id at t is coded."""
    return 0 if t < _FIRST_COUNT else 1 << (t.bit_length() - 1)


def _placed(rows: np.ndarray) -> np.ndarray:
    """Each lane's ids (rows), and below each its place."""
    out = rows.astype(np.int32 if not rows.size or int(rows.max()) < 1 << 17 else np.int64)
    out <<= 13
    out += np.arange(rows.shape[1], dtype=out.dtype)
    return out


def _order0(placed: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ids begin to end of each lane (rows of _placed; columns of the result): how many of those before begin are less, and less or equal; 4 where one is equal."""
    n, width = len(placed), end - begin
    both = np.empty((width, n), np.int32)  # less in the upper half, less or equal in the lower
    for at in range(0, n, 64):
        keys = np.sort(placed[at : at + 64, :end], axis=1)
        lanes = len(keys)
        place = keys & 8191
        keys >>= 13
        old = (place < begin).view(np.int8)
        before = np.cumsum(old, axis=1, dtype=np.int16)
        first = before - old
        first[:, 1:] *= keys[:, 1:] != keys[:, :-1]
        np.maximum.accumulate(first, axis=1, out=first)
        packed = first.astype(np.int32)
        packed <<= 16
        packed |= before
        own = np.empty(lanes * end, np.int32)
        own[place + (np.arange(lanes) * end)[:, None]] = packed
        both[:, at : at + 64] = own.reshape(lanes, end)[:, begin:].T
    low, high = (both >> 16).astype(np.int16), (both & 0xFFFF).astype(np.int16)
    return low, high, (high > low).view(np.int8) << 2


def _order0_table(ids: np.ndarray) -> np.ndarray:
    """For each lane (column of ids) its ids in order, packed as id, how many are less, and how many are less or equal."""
    most, n = ids.shape
    out = np.empty((n, most), np.int64)
    place, end = np.arange(1, most, dtype=np.int16), np.int16(most)
    for at in range(0, n, 64):
        part = np.sort(np.ascontiguousarray(ids[:, at : at + 64].T), axis=1)
        new = part[:, 1:] != part[:, :-1]
        first, last = np.zeros(part.shape, np.int16), np.full(part.shape, end)
        np.maximum.accumulate(new * place, axis=1, out=first[:, 1:])
        next_ = new * (place - end)
        next_ += end
        last[:, :-1] = np.minimum.accumulate(next_[:, ::-1], axis=1)[:, ::-1]
        entry = part.astype(np.int64)
        entry <<= 13
        entry |= first
        entry <<= 13
        entry |= last
        out[at : at + 64] = entry
    return out.reshape(-1)


def _lanes(sizes_in: list[int]) -> tuple[list[int], np.ndarray, list[int]]:
    """Order of the blocks, longest first, their sizes in that order, and for each step how many are longer."""
    order = sorted(range(len(sizes_in)), key=lambda i: -sizes_in[i])
    sizes = np.array([sizes_in[i] for i in order], np.int64)
    most = int(sizes[0]) if len(sizes) else 0
    return order, sizes, np.searchsorted(-sizes, -np.arange(most), "left").tolist()


#: Event by whether order 2 (1), order 1 (2) and order 0 (4) know the id.
_EVENT = np.array([3, 0, 1, 0, 2, 0, 1, 0])
#: Steps for which an encoder looks up the places of ids at once.
_AHEAD = 128


class _Writer:
    """The coders of all lanes. Words have room for a carry, which is settled at the end."""

    def __init__(self, lanes: int, most: int):
        self.low, self.width = np.zeros(lanes), np.full(lanes, float(1 << 48))
        self.room = most + 4 * _AHEAD
        self.words, self.at = np.zeros(lanes * self.room, np.uint32), np.arange(lanes) * self.room

    def make_room(self) -> None:
        """Space for four words a lane at each of the next steps."""
        lanes = len(self.at)
        fill = self.at - np.arange(lanes) * self.room
        if int(fill.max()) + 4 * _AHEAD > self.room:
            wider = np.zeros((lanes, 2 * self.room), np.uint32)
            wider[:, : self.room] = self.words.reshape(lanes, self.room)
            self.words, self.room = wider.reshape(-1), 2 * self.room
            self.at = fill + np.arange(lanes) * self.room

    def put(self, lanes, cum, f, total: np.ndarray, words: int = 1) -> None:
        """Code a symbol in each lane, and put out a word, or up to so many, of each whose width falls under 2**32."""
        r = self.width[lanes] * total
        np.floor(r, out=r)
        f = f * r
        r *= cum
        r += self.low[lanes]
        at = self.at[lanes]
        for _ in range(words):
            word = r * _A_WINDOW
            np.floor(word, out=word)
            out = f < _WINDOW
            self.words[at] = word.astype(np.uint32)  # where nothing is put out the next word takes its place
            at = at + out
            # Without a choice for each lane, which a processor cannot foresee: all are multiplied, by 1 where nothing is put out.
            by = out * _WINDOW
            word *= by
            r -= word
            by *= _MORE_OF
            by += _ONE
            r *= by
            f *= by
        self.at[lanes], self.low[lanes], self.width[lanes] = at, r, f

    def close(self) -> list[np.ndarray]:
        for _ in range(3):
            word = np.floor(self.low * _A_WINDOW)
            self.words[self.at] = word
            self.at += 1
            self.low = (self.low - word * _WINDOW) * _WORD
        begin = np.arange(len(self.at)) * self.room
        fill = self.at - begin
        words, every = self.words.reshape(len(fill), self.room)[:, : int(fill.max())], np.arange(len(fill))
        part = words
        while len(rows := np.flatnonzero(part[:, 1:].max(axis=1) >> 16)):  # those that a carry has still to go through
            part = part[rows]
            carry = part[:, 1:] >> 16
            part &= 0xFFFF
            part[:, :-1] += carry
            every = every[rows]
            words[every] = part
        return [words[i, :n].astype("<u2") for i, n in enumerate(fill.tolist())]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded words of each block. Blocks are coded in lockstep, longest first."""
    order, _, lives = _lanes([len(b) for b in blocks])
    n, most = len(blocks), len(lives)
    if not n:
        return []
    rows = np.zeros((n, most), np.int32)
    for lane, i in enumerate(order):
        rows[lane, : len(blocks[i])] = blocks[i]
    ids, placed = np.ascontiguousarray(rows.T), _placed(rows)
    model, writer = _Model(n), _Writer(n, most)
    i = model.at
    counted, begin = 0, 0
    for t, live in enumerate(lives):
        if not t % _AHEAD:
            writer.make_room()
            ahead = ids[t : t + _AHEAD, :live]
            key = ahead.view(np.uint32) & _KEY
            before = np.zeros_like(key)
            before[1:] = key[:-1]
            if t:
                before[0] = ids[t - 1, :live] & 0xFFFF
            at2 = _place(key, _TIMES2, _MOST2)
            at2 ^= _place(before, _TIMES_BEFORE2, _MOST2)
            next_ = np.empty((len(key), 2, live), np.int64)
            np.add(_place(key, _TIMES1, _MOST1), model.at[0, :live], out=next_[:, 0])
            np.add(at2, model.at[1, :live], out=next_[:, 1])
            after = ahead + 1
        if _counted_until(t) != counted:
            counted, begin = _counted_until(t), t
            model.counting(counted)
            low, high, known = _order0(placed[:live], t, min(2 * t, most))
            high -= np.int16(counted)
            inverse, count = _const(1 / counted), _const(counted)
        k = t % _AHEAD
        own = after[k, :live]
        if live < i.shape[1]:
            i = i[:, :live].copy()
        held = model.look(i) == own
        is1, is2 = held.view(np.int8)
        which = is1 + is1
        which += is2
        if counted:
            which += known[t - begin, :live]
        event = _EVENT.take(which)
        cum, f = model.share(event)
        if counted:  # a part of an event 2, the whole of another: exact, since the counted ids are a power of two
            old = (event == 2).view(np.int8)
            f *= inverse
            bottom = f * (low[t - begin, :live] * old)
            np.floor(bottom, out=bottom)
            cum += bottom
            top = (high[t - begin, :live] * old) + count
            f *= top
            np.floor(f, out=f)
            f -= bottom
        writer.put(slice(0, live), cum, f, _A_WORD)
        if len(new := np.flatnonzero(event == 3)):
            x = ids[t][new]
            h = np.minimum(x >> 8, 256)
            each = _EACH[h]
            writer.put(new, _HIGH[h] * 256 + each * (x & 255), each, _A_NEW, 2)
            if len(far := new[h == 256]):  # an id of more than two bytes
                for shift, total in _FAR:
                    writer.put(far, (ids[t][far] >> shift) & (total - 1), _ONE, _const(1 / total))
        model.learn(event)
        model.guess(i, own, held)
        i = next_[k]
    out = [b""] * n
    for i, words in zip(order, writer.close(), strict=True):
        out[i] = words.tobytes()
    return out


class _Reader:
    """The decoders of all lanes."""

    def __init__(self, coded: list[bytes]):
        n, longest = len(coded), max((len(c) for c in coded), default=0) // 2 + 4
        words = np.zeros((n, longest), np.uint16)
        for lane, data in enumerate(coded):
            got = np.frombuffer(data, "<u2")
            words[lane, : len(got)] = got
        first = words[:, :3].astype(np.float64)
        self.value = (first[:, 0] * _WORD + first[:, 1]) * _WORD + first[:, 2]
        self.width = np.full(n, float(1 << 48))
        self.words, self.at = words.reshape(-1), np.arange(n) * longest + 3

    def find(self, lanes, total: int) -> tuple[np.ndarray, np.ndarray]:
        r = self.width[lanes] * _const(1 / total)
        np.floor(r, out=r)
        v = self.value[lanes] / r
        np.floor(v, out=v)
        return r, np.minimum(v, _const(total - 1), out=v)

    def take(self, lanes, r: np.ndarray, cum, f, words: int = 1) -> None:
        wide = r * f
        value = self.value[lanes] - r * cum
        at = self.at[lanes]
        for _ in range(words):
            more = wide < _WINDOW
            next_ = self.words.take(at, mode="clip")
            next_ *= more
            at = at + more
            by = more * _MORE
            by += _ONE
            value *= by
            value += next_
            wide *= by
        self.at[lanes], self.value[lanes], self.width[lanes] = at, value, wide


def decode_blocks(coded: list[bytes], sizes_in: list[int]) -> list[np.ndarray]:
    order, sizes, lives = _lanes(sizes_in)
    n, most = len(coded), len(lives)
    if not n:
        return []
    ids = np.zeros((most, n), np.int32)
    model, reader = _Model(n), _Reader([coded[i] for i in order])
    i, before = model.at, np.zeros(n, np.uint32)
    counted, table, stride, count = 0, None, None, None
    for t, live in enumerate(lives):
        if _counted_until(t) != counted:
            counted = _counted_until(t)
            model.counting(counted)
            table, stride, inverse = _order0_table(ids[:t, :live]), np.arange(n) * counted, _const(1 / counted)
            count, last = _const(counted), _const(counted - 1)
        if live < i.shape[1]:
            i, before = i[:, :live].copy(), before[:live]
        g = model.look(i)
        r, v = reader.find(slice(0, live), _T)
        at = v.astype(np.uint16)
        passed = [(at >= model.by_event[k, :live]).view(np.int8) for k in (1, 2, 3)]
        event = passed[0] + passed[1]
        event += passed[2]
        event = event.astype(np.int64)
        cum, f = model.share(event)
        own = g[0] - g[1]
        own *= passed[0]
        own += g[1]
        own -= _NEW
        if counted and len(old := np.flatnonzero(event == 2)):
            whole, below = f.take(old), cum.take(old)
            # The greatest place u with floor(whole * u / counted) <= v - cum.
            u = v.take(old)
            u -= below
            u += _ONE
            u *= count
            u -= _ONE
            u /= whole
            np.minimum(u, last, out=u)
            entry = table.take(stride.take(old) + u.astype(np.int64))
            whole *= inverse
            bottom = np.floor(whole * ((entry >> 13) & 8191))
            own[old] = entry >> 26
            below += bottom
            cum[old] = below
            f[old] = np.floor(whole * (entry & 8191)) - bottom
        reader.take(slice(0, live), r, cum, f)
        if len(new := np.flatnonzero(passed[2].view(bool))):
            r, v = reader.find(new, _T << 8)
            high = _HIGH_OF[v.astype(np.int64) >> 8]
            each, first = _EACH[high], _HIGH[high] * 256
            low = np.floor((v - first) / each)
            reader.take(new, r, first + each * low, each, 2)
            if len(far := np.flatnonzero(high == 256)):
                high[far] = 0
                for shift, total in _FAR:
                    r, v = reader.find(new[far], total)
                    reader.take(new[far], r, v, _ONE)
                    high[far] += v.astype(np.int64) << (shift - 8)
            own[new] = (high << 8) + low.astype(np.int64)
        ids[t, :live] = own
        model.learn(event)
        after = own + _NEW
        model.guess(i, after, g == after)
        key = own.view(np.uint32) & _KEY
        before ^= _place(key, _TIMES2, _MOST2)
        i = np.empty((2, live), np.int64)
        np.add(_place(key, _TIMES1, _MOST1), model.at[0, :live], out=i[0])
        np.add(before, model.at[1, :live], out=i[1])
        before = _place(key, _TIMES_BEFORE2, _MOST2)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    rows = np.ascontiguousarray(ids.T)
    for lane, i in enumerate(order):
        out[i] = rows[lane, : sizes[lane]]
    return out


def pack_segments(segments: list[tuple[list, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Bytes of each segment (doc_ids, n_tokens, ids); all their blocks are coded in lockstep."""
    cut = [[ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)] for _, _, ids in segments]
    if any(len(ids) and (ids.min() < 0 or ids.max() > MOST_ID) for _, _, ids in segments):
        raise ValueError(f"an id is beyond {MOST_ID}")
    coded = iter(encode_blocks([b for blocks in cut for b in blocks]))
    out = []
    for (doc_ids, sizes, _), blocks in zip(segments, cut, strict=True):
        null = np.array([d is None for d in doc_ids], np.uint8)
        docs = zlib.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.asarray(sizes, "<u4").tobytes(), 6)
        words = [next(coded) for _ in blocks]
        table = b"".join(struct.pack("<III", len(b), len(w) // 2, zlib.crc32(b.astype("<u4").tobytes())) for b, w in zip(blocks, words, strict=True))
        out.append(MAGIC + struct.pack("<IIII", VERSION, len(doc_ids), len(blocks), len(docs)) + docs + table + b"".join(words))
    return out


def unpack_segments(packed: list[bytes]) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, n_tokens and ids of each segment; raises on a wrong checksum."""
    heads, coded, sizes, sums = [], [], [], []
    for data in packed:
        version, n_docs, n_blocks, doc_bytes = struct.unpack_from("<IIII", data, 4)
        if data[:4] != MAGIC or version != VERSION:
            raise ValueError("not a segment of this format")
        docs = zlib.decompress(data[20 : 20 + doc_bytes])
        doc_ids, null, n = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs), np.frombuffer(docs, "<u4", n_docs, 9 * n_docs)
        heads.append(([None if z else d for d, z in zip(doc_ids.tolist(), null.tolist(), strict=True)], n.astype(np.int64), n_blocks))
        at = 20 + doc_bytes
        body = at + 12 * n_blocks
        for i in range(n_blocks):
            ids, words, crc = struct.unpack_from("<III", data, at + 12 * i)
            coded.append(data[body : body + 2 * words])
            sizes.append(ids)
            sums.append(crc)
            body += 2 * words
    blocks = decode_blocks(coded, sizes)
    for b, crc in zip(blocks, sums, strict=True):
        if zlib.crc32(b.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
    out, at = [], 0
    for doc_ids, n, n_blocks in heads:
        out.append((doc_ids, n, np.concatenate([np.zeros(0, np.int32), *blocks[at : at + n_blocks]])))
        at += n_blocks
    return out


_SORT = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 another sign
_SORT[_SPACE], _SORT[48:58], _SORT[65:91], _SORT[97:123], _SORT[128:] = 0, 2, 1, 1, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that only letters from U+00C0 to U+024F and printable ASCII signs but the apostrophe have are plain.
_PLAIN = np.zeros(256, bool)
_PLAIN[_SPACE], _PLAIN[33:127], _PLAIN[0x80:0xC0], _PLAIN[0xC3:0xCA] = True, True, True, True
_PLAIN[39] = False


#: Signs that byte-level tokenizers spell bytes with: printable Latin-1 by itself, all others by the next sign from U+0100.
_SPELLED, _next = {}, 256
for _b in range(256):
    if not (33 <= _b < 127 or 161 <= _b < 173 or 174 <= _b):
        _SPELLED[_b], _next = _next, _next + 1


class WordEncoder:
    """A tokenizer of the tokenizers library that drops white space and parts letters, single digits and other signs, so that each part is encoded once.

    Words are parted at ASCII white space, which no token of such a tokenizer spans. A plain
    word (see _PLAIN; no multiplication or division sign, no dotted capital I, no marker's
    begin) is parted further into runs of letters, digits and runs of other signs, all of them in
    lower case; every other word goes to the library as it is."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # A plain part in lower case, its bytes spelled as signs, is what the normalizer and the
        # pre-tokenizer leave of it: the same model takes it without those two.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo = Memo(21)

    def _parts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with plain words in lower case, starts and ends of all parts, and which of them are whole words that aren't plain."""
        starts, ends, _ = word_spans(raw, off)
        odd = ~_PLAIN[raw]
        for a, b in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (60, 124)):
            odd[:-1] |= (raw[:-1] == a) & (raw[1:] == b)
        words = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
        sort = _SORT[raw]
        inside = sort > 0
        begin = sort == 2
        begin[1:] |= sort[1:] != sort[:-1]
        begin &= inside
        begin[starts] = True
        low = _LOWER[raw]
        if len(words):
            a, n = starts[words], ends[words] - starts[words]
            within = np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)
            begin[within] = False
            begin[a] = True
            low[within] = raw[within]
        stop = inside
        stop[:-1] &= ~inside[1:] | begin[1:]
        stop[ends - 1] = True
        at = np.flatnonzero(begin)
        whole = np.zeros(len(at), bool)
        whole[np.searchsorted(at, starts[words])] = True
        return low, at, np.flatnonzero(stop) + 1, whole

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        low, starts, ends, whole = self._parts(raw, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)

        def fresh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            held = low.tobytes()
            texts = [held[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            odd = whole[at]
            plain = [texts[i] for i in np.flatnonzero(~odd).tolist()]
            spelled = [t if t.isascii() else t.lower().encode().decode("latin-1").translate(_SPELLED) for t in plain]
            joined = [" ".join(spelled[i : i + 500]) for i in range(0, len(spelled), 500)]
            ids = np.array([i for e in self.bare.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], np.int32)
            counts = np.zeros(len(at), np.int64)
            counts[~odd] = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(odd).tolist()], add_special_tokens=False)]
            counts[odd] = [len(x) for x in lists]
            out, alone = np.empty(int(counts.sum()), np.int32), np.repeat(odd, counts)
            out[~alone], out[alone] = ids, [i for x in lists for i in x]
            return out, counts

        ids, count = self.memo.ids_of(PartHashes(low).of(starts, ends), fresh)
        return ids, np.diff(np.append(0, np.cumsum(count))[np.searchsorted(starts, off)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker's encoder, with what it remembers from one task to the next. (A dict that a task's own function named would go with each task, empty.)"""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def lockstep(segments, most: int, size):
    """Lists of segments, in order, to code together: as soon as `most` ids wait, the first ones that have half as many; at the end, all.

    A step costs nearly as much for few lanes as for hundreds, so a task that has just more than `most` ids must not leave few segments to the end."""
    held, ends = [], [0]
    for segment in segments:
        held.append(segment)
        ends.append(ends[-1] + size(segment))
        if ends[-1] >= most:
            k = max(1, int(np.searchsorted(ends, most // 2)))
            yield held[:k]
            held, ends = held[k:], [e - ends[k] for e in ends[k:]]
    if held:
        yield held


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write segments in ascending doc_id order below path."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        words = encoder(tokenizer)
        part, first, segment = TaskContext.get().partitionId(), 0, 0

        def segments():
            open_ids, open_docs, open_sizes, size = [], [], [], 0
            for batch in batches:
                raw, off = text_buffer(batch.column("text"))
                begin = 0
                while begin < batch.num_rows:
                    end = max(begin + 1, int(np.searchsorted(off, off[begin] + TEXT_BLOCK, "right")) - 1)
                    ids, count = words.encode(raw[off[begin] : off[end]], off[begin : end + 1] - off[begin])
                    ends = np.cumsum(count)
                    ids = np.insert(ids, ends, end_id)
                    sizes = count + 1
                    stops = np.cumsum(sizes)
                    names = batch.column("doc_id").slice(begin, end - begin).to_pylist()
                    at = 0
                    while at < len(names):
                        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + SEGMENT - size, "right")))
                        a, b = (stops[at - 1] if at else 0), stops[to - 1]
                        open_ids.append(ids[a:b])
                        open_docs += names[at:to]
                        open_sizes.append(sizes[at:to])
                        size += b - a
                        at = to
                        if size >= SEGMENT or at < len(names):
                            yield open_docs, np.concatenate(open_sizes), np.concatenate(open_ids)
                            open_ids, open_docs, open_sizes, size = [], [], [], 0
                    begin = end
            if open_docs:
                yield open_docs, np.concatenate(open_sizes), np.concatenate(open_ids)

        for held in lockstep(segments(), LOCKSTEP, lambda s: len(s[2])):
            n = [len(ids) for _, _, ids in held]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(n), pa.int32()),
                "segment": pa.array(range(segment, segment + len(n)), pa.int32()),
                "first": pa.array(first + np.cumsum(n) - n, pa.int64()),
                "n_docs": pa.array([len(d) for d, _, _ in held], pa.int32()),
                "n_tokens": pa.array(n, pa.int64()),
                "data": pa.array(pack_segments(held), pa.binary()),
            })
            first, segment = first + sum(n), segment + len(n)

    rows = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(tidy(run), "part int, segment int, first long, n_docs int, n_tokens long, data binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    stored = spark.read.schema("part int, segment int, first long, n_docs int, n_tokens long, data binary").parquet(path)
    # One row a part: as many as the shuffle partitions that wrote them.
    sums = [(r[0], r[1]) for r in stored.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect()]
    starts, total = {}, 0
    for part, n in sums:
        starts[part] = total
        total += n

    def run(batches):
        def rows():
            for batch in batches:
                for p, f, n, data in zip(*(batch.column(c) for c in ("part", "first", "n_tokens", "data")), strict=True):
                    yield starts[p.as_py()] + f.as_py(), n.as_py(), data.as_py()

        for held in lockstep(rows(), LOCKSTEP, lambda r: r[1]):
            for (start, _, _), (doc_ids, n, ids) in zip(held, unpack_segments([data for _, _, data in held]), strict=True):
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return stored.select("part", "first", "n_tokens", "data").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/heliodor-tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read(spark, path)
