"""Keyed event logs, live runs and sessions as Structured Streaming queries.

Each operator takes a streaming DataFrame and returns one; ``drain`` runs a query over what is there now and returns the
rows that it wrote. Event time is an addition: order within a key is arrival, or the event's own time where it has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.session import new_path

HISTORY = 1000


def table_stream(table: DataFrame, path: str) -> DataFrame:
    """A stream of the files of a Parquet table, a folder or a single file."""
    files = table.inputFiles()
    if len(files) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:
        path = f"{path[:-1]}[{path[-1]}]"
    return table.sparkSession.readStream.schema(table.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, mode: str = "append", state: dict[str, str] | None = None) -> DataFrame:
    """Everything that ``stream`` gives for the input there is, as a table in the shared folder.

    In append mode with a watermark, a last batch without data closes what the watermark has passed by then. In update mode
    a batch replaces nothing: rows carry ``batch_id``, and the last one for a key is its state. In complete mode each batch
    replaces all, with what is open too, and no row is late. ``state`` holds settings of the state store.
    """
    spark = stream.sparkSession
    with settings(spark, state or {}):
        return _drained(stream, mode)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "stream-out"), new_path(spark, "stream-state")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", out)
    else:
        write = "overwrite" if mode == "complete" else "append"
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.withColumn("batch_id", F.lit(k)).write.mode(write).parquet(out))
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema if mode == "append" else None
    return spark.read.schema(schema).parquet(out) if schema else spark.read.parquet(out)


def numbered(events: DataFrame, key: str, order: str) -> DataFrame:
    """Events of each key with ``seq``, one more for each event that arrives; state is one number for each key."""
    rows = events.select(F.col(key).alias("key"), F.col(order).alias("order"))

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seq,) = state.getOption or (0,)
        rows = pd.concat(list(batches)).sort_values("order", kind="stable")
        rows["seq"] = range(seq + 1, seq + 1 + len(rows))
        state.update((seq + len(rows),))
        yield rows[["key", "order", "seq"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy("key").applyInPandasWithState(number, f"key {kinds['key']}, order {kinds['order']}, seq long", "seq long", "append", GroupStateTimeout.NoTimeout)


def replay(log: DataFrame, after: int, history: int = HISTORY) -> DataFrame:
    """Events of each key with ``seq > after`` among its latest ``history``."""
    last = log.groupBy("key").agg(F.max("seq").alias("last"))
    return log.join(last, "key").where((F.col("seq") > after) & (F.col("seq") > F.col("last") - history)).drop("last")


def live_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key by event time, given out once the watermark has passed their end.

    The watermark trails the latest event of earlier batches by ``late``; rows behind it are dropped, and closed sessions
    leave the state.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "key")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")
    )


def live_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key in tumbling windows, given out once the watermark has passed their end, as in ``live_sessions``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("key", F.col("window.start").alias("start"), "n", "total")


def live_runs(events: DataFrame) -> DataFrame:
    """Runs of one stage within a key: events (key, order, stage). A run is given out when the next stage begins, and with a
    null end after each batch that leaves it open; ``settled_runs`` keeps the last word on each.

    What ``session_window`` cannot say: a run breaks where the stage changes. The open run of each key is its state.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, start, n = state.getOption or (None, None, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values("order", kind="stable").itertuples():
            if n and r.stage == stage:
                n += 1
                continue
            if n:
                out.append((key[0], stage, start, int(r.order), n))
            stage, start, n = r.stage, int(r.order), 1
        state.update((stage, start, n))
        found = pd.DataFrame([*out, (key[0], stage, start, None, n)], columns=["key", "stage", "start", "end", "n"])
        yield found.astype({"end": "Int64"})

    return events.groupBy("key").applyInPandasWithState(fold, f"key {dict(events.dtypes)['key']}, stage string, start long, end long, n long", "stage string, start long, n long", "append", GroupStateTimeout.NoTimeout)


def settled_runs(runs: DataFrame) -> DataFrame:
    """The last state of each of ``live_runs``: closed, or open at the end of the stream. A run only grows before it closes."""
    last = F.max_by(F.struct("stage", "end", "n"), F.struct("n", F.col("end").isNotNull()))
    return runs.groupBy("key", "start").agg(last.alias("r")).select("key", "r.stage", "start", "r.end", "r.n")


def enriched(events: DataFrame, profile: DataFrame) -> DataFrame:
    """Progress events joined with the stage profile; the profile is a small static table."""
    return events.join(F.broadcast(profile), "stage", "left")


def overlap_add(chunks: DataFrame, fade: int) -> DataFrame:
    """Samples of overlapping chunks (key, chunk, at, n, pos, x) with linear fades, summed by place."""
    up = F.when((F.col("chunk") > 0) & (F.col("pos") < fade), (F.col("pos") + 0.5) / fade).otherwise(F.lit(1.0))
    down = F.when(~F.col("last") & (F.col("n") - F.col("pos") <= fade), (F.col("n") - F.col("pos") - 0.5) / fade).otherwise(F.lit(1.0))
    return chunks.groupBy("key", (F.col("at") + F.col("pos")).alias("place")).agg(F.sum(F.col("x") * up * down).alias("x"))
