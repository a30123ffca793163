"""Streams whose rows depend on those before them in their session: streaks, token windows, paged outputs.

Rows may come in any order within the watermark: a session keeps what has come, and a timer lets it
go on in order of time once the watermark has passed, so the rows that come out are those of the batch
form. A session that is idle for so long that the watermark passes its last row by `idle` is ended by
another timer and leaves no state. State is in RocksDB; a restart from the checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from heliodor.operators.trajectory import TPM_BUDGET, TPM_WAIT, WINDOW_S

#: Idle time, in the streams' own time, after which a session's state goes.
IDLE_MS = 6 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """The session's state store while a stream is started, which needs RocksDB for its state."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _InOrder(StatefulProcessor):
    """Rows of a key in order of (ts, step). A subclass turns rows of one time into output, given and changing `memory`, a tuple or None."""

    def __init__(self, rows: StructType, memory: str, idle_ms: int):
        self.schema, self.memory, self.idle_ms = rows, memory, idle_ms
        self.names = rows.fieldNames()

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.kept = handle.getValueState("memory", self.memory)
        self.last = handle.getValueState("last", "ms long")

    def _ms(self, row) -> int:
        return int(row["ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.names) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[self.names.index("ms")] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self.names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r["ms"] < passed), key=lambda r: (r["ms"], r["step"]))
        rest = [r for r in rows if r["ms"] >= passed]
        memory = tuple(self.kept.get()) if self.kept.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        begin = 0
        while begin < len(ready):
            end = begin + 1
            while end < len(ready) and ready[end]["ms"] == ready[begin]["ms"]:
                end += 1
            if last is not None and ready[begin]["ms"] - last >= self.idle_ms:
                out += self.ended(key, memory)
                memory = None
            last = ready[begin]["ms"]
            found, memory = self.step(key, memory, ready[begin:end])
            out += found
            begin = end
        if ready:
            if rest:
                self.waiting.put([tuple(r[n] for n in self.names) for r in rest])
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(min(r["ms"] for r in rest) + 1)
        if last is not None and not rest and passed > last + self.idle_ms:
            out += self.ended(key, memory)
            memory = last = None
            self.kept.clear()
            self.last.clear()
        elif last is not None:
            self.kept.update(memory) if memory is not None else self.kept.clear()
            self.last.update((last,))
            self.handle.registerTimer(last + self.idle_ms + 1)
        return iter(out)

    def step(self, key, memory, rows: list[dict]) -> tuple[list[Row], tuple | None]:
        raise NotImplementedError

    def ended(self, key, memory) -> list[Row]:
        return []

    def close(self) -> None:
        pass


class _Streaks(_InOrder):
    def __init__(self, schema, idle_ms, notice_at):
        super().__init__(schema, "pattern string, matched boolean, run long", idle_ms)
        self.notice_at = notice_at

    def step(self, key, memory, rows):
        out = []
        for r in rows:
            same = memory is not None and r["pattern"] is not None and memory[0] == r["pattern"] and not memory[1] and not r["matched"]
            run = memory[2] + 1 if same else 1
            memory = (r["pattern"], r["matched"], run)
            streak = 0 if r["matched"] else run
            out.append(Row(session=key[0], step=r["step"], pattern=r["pattern"], matched=r["matched"], streak=streak, notice=streak >= self.notice_at))
        return out, memory


class _Tokens(_InOrder):
    """memory: the times and tokens of the last seconds, and the row that waits for the next one's tokens."""

    def __init__(self, schema, idle_ms, budget, wait_at, seconds):
        super().__init__(schema, "times array<long>, tokens array<long>, step long, at long, own long, used long", idle_ms)
        self.most, self.seconds = min(budget, wait_at), seconds

    def _said(self, key, pending, nxt):
        step, at, own, used = pending
        return Row(session=key[0], step=step, at=at, tokens=own, used=used, wait=nxt is not None and used + nxt > self.most)

    def step(self, key, memory, rows):
        times, tokens, *pending = memory or ([], [], None, None, None, None)
        now = rows[0]["at"]
        held = [(t, n) for t, n in zip(times, tokens, strict=True) if t >= now - self.seconds] + [(now, r["tokens"]) for r in rows]
        used = sum(n for _, n in held)
        out = []
        for r in rows:
            if pending[0] is not None:
                out.append(self._said(key, pending, r["tokens"]))
            pending = [r["step"], now, r["tokens"], used]
        return out, ([t for t, _ in held], [n for _, n in held], *pending)

    def ended(self, key, memory):
        return [self._said(key, memory[2:], None)] if memory and memory[2] is not None else []


class _Pages(_InOrder):
    def __init__(self, schema, idle_ms):
        super().__init__(schema, "turn long, small boolean", idle_ms)

    def step(self, key, memory, rows):
        out = []
        for r in rows:
            turn, small = (0, bool(r["small"])) if r["fresh"] or memory is None else (memory[0] + 1, memory[1])
            memory = (turn, small)
            out.append(Row(session=key[0], command=key[1], step=r["step"], chunk=None if small else turn))
        return out, memory


def _stream(rows: DataFrame, keys: list[str], columns: dict[str, str], processor, out: str, delay: str) -> DataFrame:
    held = rows.withWatermark("ts", delay).select("ts", *keys, F.unix_millis("ts").alias("ms"), *(F.col(c).cast(kind).alias(c) for c, kind in columns.items()))
    schema = StructType([f for f in held.schema if f.name not in ("ts", *keys)])
    return held.groupBy(*keys).transformWithState(processor(schema), out, "append", "EventTime")


def streak_stream(steps: DataFrame, notice_at: int = 4, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """trajectory.streaks() of a stream of steps (session, ts, step, pattern, matched)."""
    columns = {"step": "long", "pattern": "string", "matched": "boolean"}
    return _stream(steps, ["session"], columns, lambda s: _Streaks(s, idle_ms, notice_at), "session long, step long, pattern string, matched boolean, streak long, notice boolean", delay)


def token_stream(steps: DataFrame, budget: int = TPM_BUDGET, wait_at: int = TPM_WAIT, seconds: int = WINDOW_S, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """trajectory.token_windows() of a stream of steps (session, ts, step, at, tokens). A step comes out when the next one is known, or the session has ended."""
    if idle_ms <= seconds * 1000:
        raise ValueError("a session must outlive its window")
    columns = {"step": "long", "at": "long", "tokens": "long"}
    return _stream(steps, ["session"], columns, lambda s: _Tokens(s, idle_ms, budget, wait_at, seconds), "session long, step long, at long, tokens long, used long, wait boolean", delay)


def page_stream(steps: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """session, command, step and the number of the chunk that answers it, of a stream of steps (session, ts, step, command, fresh, small), as in trajectory.page_sessions()."""
    return _stream(steps, ["session", "command"], {"step": "long", "fresh": "boolean", "small": "boolean"}, lambda s: _Pages(s, idle_ms), "session long, command string, step long, chunk long", delay)
