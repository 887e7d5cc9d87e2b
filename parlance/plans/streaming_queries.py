"""Streaming queries over the events table, and the SQL that their whole output equals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.plans.inputs import read
from parlance.plans.more_queries import OVERLAP_ADD
from parlance.session import materialize
from parlance.streaming import live as L
from parlance.streaming.chunks import STATE_SETTINGS, enhanced_chunks


def _events(spark, sf):
    table = read(spark, sf, "events")
    return L.table_stream(table, f"{sf}/events.parquet")


def r01(spark, sf):
    log = L.drain(L.numbered(_events(spark, sf), "user_id", "event_id"))
    return log.select("key", F.col("order").alias("event_id"), "seq")


def r02(spark, sf):
    log = L.drain(L.numbered(_events(spark, sf), "user_id", "event_id"))
    return L.replay(log, 20, 30).select("key", F.col("order").alias("event_id"), "seq")


def r03(spark, sf):
    """The three actions of each kind used last."""
    last = L.drain(_events(spark, sf).groupBy("event_type", "user_id").agg(F.max("event_id").alias("last")), "update")
    last = last.groupBy("event_type", "user_id").agg(F.max_by("last", "batch_id").alias("last"))
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("last")))
    return last.withColumn("k", rank).where("k <= 3").drop("k")


def r04(spark, sf):
    profile = read(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.median("value"), 4).alias("weight"))
    return L.drain(L.enriched(_events(spark, sf).select("event_id", F.col("event_type").alias("stage"), "value"), profile)).withColumn("ratio", F.round(F.col("value") / F.col("weight"), 4)).select("event_id", "stage", "ratio")


def r06(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("order"), F.col("event_type").alias("stage"))
    return L.settled_runs(L.drain(L.live_runs(rows)))


def r05(spark, sf):
    """Each user's values as a live recording in frames of seven, which come in any order; every second chunk twice as loud."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), "value", (F.row_number().over(w) - 1).alias("place"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    frames = e.groupBy("key", F.floor(F.col("place") / 7).alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"), (F.max("place") == F.max("n") - 1).alias("last"))
    came = materialize(frames.repartition(4, F.xxhash64("key", "seq")), "frames")
    stream = spark.readStream.schema(came.schema).option("maxFilesPerTrigger", 2).parquet(came.inputFiles()[0].rsplit("/", 1)[0])
    out = L.drain(enhanced_chunks(stream, 50, 10, lambda x, chunk: x * (1 + chunk % 2)), state=STATE_SETTINGS)
    return out.withColumn("x", F.round("x", 4))


def r07(spark, sf):
    """Sessions by event time, those that are still open too."""
    rows = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), "value")
    out = L.drain(L.live_sessions(rows, "3 hours"), "complete", STATE_SETTINGS)
    return out.select("key", F.unix_seconds("start").alias("start_s"), "n", F.round("total", 2).alias("total"))


def r09(spark, sf):
    """Counts of days, those that are still open too."""
    rows = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value")
    out = L.drain(L.live_windows(rows, "1 day"), "complete", STATE_SETTINGS)
    return out.select("key", F.unix_seconds("start").alias("start_s"), "n", F.round("total", 2).alias("total"))


QUERIES = {"r01_event_log": r01, "r02_replay": r02, "r03_recent_actions": r03, "r04_enriched_progress": r04, "r05_streaming_chunks": r05, "r06_live_runs": r06, "r07_live_sessions": r07, "r09_windows_with_watermark": r09}
ORACLES = {
    "r01_event_log": "SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events",
    "r02_replay": "SELECT key, event_id, seq FROM (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE seq > 20 AND seq > n - 30",
    "r03_recent_actions": "SELECT event_type, user_id, last FROM (SELECT event_type, user_id, max(event_id) AS last, row_number() OVER (PARTITION BY event_type ORDER BY max(event_id) DESC) AS k FROM events GROUP BY event_type, user_id) WHERE k <= 3",
    "r04_enriched_progress": "WITH p AS (SELECT event_type AS stage, round(median(value), 4) AS weight FROM events GROUP BY 1) SELECT event_id, stage, round(value / weight, 4) AS ratio FROM events JOIN p ON event_type = stage",
    "r05_streaming_chunks": OVERLAP_ADD,
    "r06_live_runs": """WITH r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)),
        g AS (SELECT user_id, run, any_value(event_type) AS stage, min(event_id) AS s, count(*) AS n FROM r GROUP BY user_id, run), e AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nx FROM g)
        SELECT user_id AS key, stage, s AS start, nx AS "end", n FROM e""",
    "r07_live_sessions": """WITH r AS (SELECT *, sum(CASE WHEN ts - p <= INTERVAL 3 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
        SELECT user_id AS key, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY user_id, run""",
    "r09_windows_with_watermark": "SELECT event_type AS key, epoch(date_trunc('day', ts))::BIGINT AS start_s, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
