"""Stateful streams give the rows of the batch forms: out of order, late, and over a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from heliodor.operators import trajectory
from heliodor.streaming import stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session long, ts timestamp, step long, pattern string, matched boolean, at long, tokens long, command string, fresh boolean, small boolean"


def steps(seed=1):
    rnd = random.Random(seed)
    rows = []
    for session in range(5):
        at = rnd.randrange(100)
        for step in range(40):
            at += rnd.choice([0, 1, 5, 20, 55])
            fresh = step == 0 or rnd.random() < 0.15
            rows.append((session, START + timedelta(seconds=at), step, rnd.choice(["a", "a", "b", None]), rnd.random() < 0.2, at, rnd.randrange(4000), rnd.choice(["ls", "cat x"]), fresh, fresh and rnd.random() < 0.4))
    return rows


def run(spark, tmp_path, stream, parts):
    """What a stream over files of parts writes; it is stopped and started again after each part."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(source)
        with stateful.state_in_rocksdb(spark):
            started = stream(spark.readStream.schema(SCHEMA).json(source)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
            started.awaitTermination(180)
    return spark.read.parquet(out).where("session >= 0")


@pytest.fixture(scope="module")
def parts():
    """Rows in three parts, each shuffled within less than the delay, then a row that is far too late, and one that moves the watermark on."""
    rows = sorted(steps(), key=lambda r: r[1])
    end = rows[-1][1]
    rnd = random.Random(2)
    thirds = [rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3] for i in range(3)]
    moved = [thirds[0].pop(-1), thirds[1].pop(-1)]  # come a part later, within the delay
    thirds[1].append(moved[0])
    thirds[2].append(moved[1])
    for part in thirds:
        rnd.shuffle(part)
    other = lambda ts: (-1, ts, 0, "x", False, 0, 0, "x", True, False)
    late = (0, START - timedelta(days=3), 999, "late", False, -1, 10**6, "late", True, False)
    return rows, [*thirds, [other(end + timedelta(days=9))], [late, other(end + timedelta(days=20))]]


def said(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_streaks(spark, tmp_path, parts):
    rows, files = parts
    got = run(spark, tmp_path, lambda s: stateful.streak_stream(s, 3), files)
    want = trajectory.streaks(spark.createDataFrame(rows, SCHEMA), 3)
    assert said(got, "session", "step", "streak", "notice") == said(want, "session", "step", "streak", "notice") and want.where("notice").count() > 3


def test_token_windows(spark, tmp_path, parts):
    rows, files = parts
    got = run(spark, tmp_path, stateful.token_stream, files)
    want = trajectory.token_windows(spark.createDataFrame(rows, SCHEMA))
    assert said(got, "session", "step", "used", "wait") == said(want, "session", "step", "used", "wait") and want.where("wait").count() > 3
    with pytest.raises(ValueError, match="outlive"):
        stateful.token_stream(spark.createDataFrame(rows, SCHEMA), idle_ms=1000)


def test_pages(spark, tmp_path, parts):
    rows, files = parts
    got = run(spark, tmp_path, stateful.page_stream, files)
    chunks = spark.createDataFrame([(c, k, f"{c}{k}") for c in ("ls", "cat x") for k in range(3)], "command string, chunk int, content string")
    want = trajectory.page_sessions(spark.createDataFrame(rows, SCHEMA), chunks)
    first = want.groupBy("session", "command").agg(F.min("step").alias("step")).join(spark.createDataFrame(rows, SCHEMA).select("session", "command", "step", "fresh"), ["session", "command", "step"])
    assert said(got, "session", "command", "step", "chunk") == said(want, "session", "command", "step", "chunk") and first.count() == 10
    small = want.join(spark.createDataFrame(rows, SCHEMA).where("small").select("session", "step"), ["session", "step"])
    assert small.count() and not small.where("chunk IS NOT NULL OR complete").count() and want.where("complete").count()


def test_idle_sessions_end(spark, tmp_path):
    """A pause as long as the idle time ends a session: it begins anew, and its state is gone at the end."""
    hour = timedelta(hours=1)
    rows = [(1, START, 1, "a", False, 0, 5, "x", True, False), (1, START + hour, 2, "a", False, 3600, 5, "x", False, False), (1, START + 20 * hour, 3, "a", False, 72000, 5, "x", False, False)]
    far = (-1, START + 900 * hour, 0, "x", False, 0, 0, "x", True, False)
    got = run(spark, tmp_path, lambda s: stateful.streak_stream(s, 2), [rows, [far], [(*far[:1], START + 2000 * hour, *far[2:])]])
    assert said(got, "step", "streak") == [(1, 1), (2, 2), (3, 1)]
