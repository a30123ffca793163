"""Queries through the stored collections and the stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from heliodor.operators.store import PointStore
from heliodor.queries import load, query
from heliodor.storage import shared_dir
from heliodor.streaming import stateful


def _filled(spark, sf_dir) -> PointStore:
    """A store of all documents, then of their labels' newer versions, without the toxic ones."""
    docs, labels = load(spark, sf_dir, "documents", "labels")
    points = PointStore(spark, shared_dir(spark), f"heliodor-store-{uuid.uuid4().hex}", "doc_id")
    points.create("doc_id long, version long, note string, toxic int")
    points.upsert(docs.select("doc_id", F.lit(0).cast("long").alias("version"), F.md5("text").alias("note"), F.lit(0).alias("toxic")), batch=("documents", 0))
    newer = labels.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("doc_id") % 3)).alias("version"), F.col("toxic").cast("int").alias("toxic"))
    for _ in range(2):  # the second is the same batch again
        points.upsert(newer.withColumn("note", F.concat(F.lit("v"), F.col("version").cast("string"))), order="version", batch=("labels", 7))
    points.delete(where=F.col("toxic") == 1)
    return points


_STORED = """d AS (SELECT doc_id, 0 AS version, md5(text) AS note, 0 AS toxic FROM documents), l AS (SELECT doc_id, 1 + doc_id % 3 AS version, 'v' || (1 + doc_id % 3) AS note, CAST(toxic AS INTEGER) AS toxic FROM labels),
s AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT * FROM l WHERE toxic <> 1)"""


@query(f"WITH {_STORED} SELECT doc_id, version, note, toxic FROM s")
def store_upsert_delete(spark, sf_dir):
    return _filled(spark, sf_dir).read()


@query(f"WITH {_STORED} SELECT user_id AS doc_id, user_id IN (SELECT doc_id FROM s) AS stored FROM (SELECT DISTINCT user_id FROM events)")
def store_probe(spark, sf_dir):
    points = _filled(spark, sf_dir)
    points.compact()
    ids = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return points.existing(ids).withColumn("stored", F.lit(True)).unionByName(points.missing(ids).withColumn("stored", F.lit(False)))


_STEPS = "s AS (SELECT user_id AS session, event_id AS step, ts, event_type AS pattern, CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 AS matched FROM events)"


@query(f"""WITH {_STEPS}, g AS (SELECT *, lag(ts) OVER (PARTITION BY session ORDER BY ts, step) AS before FROM s),
w AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch_ms(ts) - epoch_ms(before) >= 3600000 * 240 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, step) AS visit FROM g),
c AS (SELECT *, CASE WHEN lag(pattern) OVER v IS NULL OR lag(pattern) OVER v <> pattern OR lag(matched) OVER v OR matched THEN 1 ELSE 0 END AS new FROM w WINDOW v AS (PARTITION BY session, visit ORDER BY ts, step)),
r AS (SELECT *, sum(new) OVER (PARTITION BY session, visit ORDER BY ts, step) AS run FROM c)
SELECT session, step, pattern, matched, CASE WHEN NOT matched THEN row_number() OVER (PARTITION BY session, visit, run ORDER BY ts, step) ELSE 0 END AS streak,
CASE WHEN NOT matched THEN row_number() OVER (PARTITION BY session, visit, run ORDER BY ts, step) ELSE 0 END >= 3 AS notice FROM r""")
def stream_no_match_streak(spark, sf_dir):
    """The streaks of a stream of all events, in which a pause of ten days ends a session; a last row moves the watermark past them."""
    e = load(spark, sf_dir, "events")
    steps = e.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("step"), F.col("event_type").alias("pattern"), (F.get_json_object("props", "$.k").cast("long") % 7 == 0).alias("matched"))
    base = f"{shared_dir(spark)}/heliodor-stream-{uuid.uuid4().hex}"
    steps.write.parquet(f"{base}/in")
    last = steps.agg(F.max("ts").alias("ts")).select(F.lit(None).cast("long").alias("session"), (F.col("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts"), F.lit(0).cast("long").alias("step"), F.lit("").alias("pattern"), F.lit(True).alias("matched"))
    last.write.mode("append").parquet(f"{base}/in")
    with stateful.state_in_rocksdb(spark):
        stream = stateful.streak_stream(spark.readStream.schema(steps.schema).parquet(f"{base}/in"), 3, idle_ms=240 * 3600 * 1000)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.parquet(f"{base}/out").where("session IS NOT NULL")
