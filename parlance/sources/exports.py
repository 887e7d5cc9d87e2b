"""Transcript sinks: JSON, SRT, VTT, text, Markdown and timelines, as rows to write with ``DataFrame.write``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import clock, escape_markup, hms, timeline_clock
from parlance.operators.intervals import tracks
from parlance.session import materialize


#: Recordings that a task writes: each has a folder, which costs more than its rows.
TASK_FOLDERS = 50
#: Tasks that list such folders; by default Spark starts one for each folder, up to 10,000.
LISTING_TASKS = 100


def _label() -> Column:
    return F.when(F.col("speaker_id").isNull(), F.lit("")).otherwise(F.concat(F.col("speaker_id"), F.lit(": ")))


def _numbered(entries: DataFrame) -> DataFrame:
    return entries.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("idx")))


def srt_cues(entries: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), clock(F.col("start_ms")), F.lit(" --> "), clock(F.col("end_ms")), F.lit("\n"), _label(), text, F.lit("\n"))
    return _numbered(entries).select("rec_id", "n", cue.alias("cue"))


def vtt_cues(entries: DataFrame) -> DataFrame:
    text = F.concat(F.when(F.col("speaker_id").isNull(), "").otherwise(F.concat(F.lit("<v "), escape_markup(F.col("speaker_id")), F.lit(">"))), escape_markup(F.coalesce("text", F.lit(""))))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), clock(F.col("start_ms"), "."), F.lit(" --> "), clock(F.col("end_ms"), "."), F.lit("\n"), text, F.lit("\n"))
    return _numbered(entries).select("rec_id", "n", cue.alias("cue"))


def text_lines(entries: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), hms(F.col("start_ms")), F.lit("] "), F.coalesce("speaker_id", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))
    return entries.select("rec_id", "idx", line.alias("line"))


def markdown_lines(entries: DataFrame) -> DataFrame:
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\`*_{}\[\]<>#|])", r"\\$1")
    return entries.select("rec_id", "idx", F.concat(F.lit("**["), hms(F.col("start_ms")), F.lit("] "), F.coalesce("speaker_id", F.lit("?")), F.lit(":** "), escaped).alias("line"))


def timeline_lines(entries: DataFrame) -> DataFrame:
    """One line for each speaker with the intervals in which they speak."""
    spans = tracks(entries.withColumn("extra_speakers", F.array().cast("array<string>"))) if "extra_speakers" not in entries.columns else tracks(entries)
    said = F.concat(timeline_clock(F.col("start_ms")), F.lit("–"), timeline_clock(F.col("end_ms")))
    grouped = spans.withColumn("said", said).groupBy("rec_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "said"))).alias("s"))
    return grouped.select("rec_id", "speaker", F.concat("speaker", F.lit(": "), F.array_join(F.transform("s", lambda x: x["said"]), ", ")).alias("line"))


def json_documents(entries: DataFrame) -> DataFrame:
    """One nested document for each recording; nulls are left out."""
    entry = F.struct("idx", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", F.col("speaker_id").alias("speaker"))
    grouped = entries.groupBy("rec_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select("rec_id", F.to_json(F.struct("rec_id", "entries")).alias("document"))


def slides_payload(slides: DataFrame) -> DataFrame:
    """rec_id and a document of its slides: ``slides(rec_id, start_ms, end_ms, text, image)`` numbered by start, from 1.

    Times are seconds; a slide without an end stays open (null), blank texts are left out, and so are fields without a value.
    """
    number = F.row_number().over(Window.partitionBy("rec_id").orderBy("start_ms", "image"))
    text = F.nullif(F.trim("text"), F.lit(""))
    slide = F.struct(number.alias("index"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), text.alias("text"), "image")
    rows = slides.select("rec_id", slide.alias("slide")).groupBy("rec_id").agg(F.array_sort(F.collect_list("slide")).alias("slides"))
    return rows.select("rec_id", F.to_json(F.struct(F.size("slides").alias("count"), "slides")).alias("document"))


def _by_recording(rows: DataFrame) -> DataFrame:
    """Rows of a recording in one task, and few recordings in each; the number is given, or small tasks would be put together."""
    n = rows.select("rec_id").distinct().count()
    return rows.repartition(max(1, -(-n // TASK_FOLDERS)), "rec_id")


def slides_sidecar(slides: DataFrame, path: str) -> None:
    """Write the slides of each recording beside it, one folder for each, whole or not at all."""
    payload = materialize(slides_payload(slides), "payload")
    _by_recording(payload).select("rec_id", F.col("document").alias("value")).write.partitionBy("rec_id").text(path)


def read_by_recording(spark: SparkSession, path: str) -> DataFrame:
    """value and rec_id of the lines of all recordings, as ``export`` and ``slides_sidecar`` write them."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTING_TASKS)))
    try:  # folders are listed when the table is made
        return spark.read.text(path)
    finally:
        spark.conf.set(name, before)


#: Rows of each format: (function, column that holds the text).
EXPORTERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "json": (json_documents, "document"), "srt": (srt_cues, "cue"), "vtt": (vtt_cues, "cue"), "txt": (text_lines, "line"), "md": (markdown_lines, "line"), "timeline": (timeline_lines, "line"),
}


def export(entries: DataFrame, path: str, fmt: str) -> None:
    """Write one folder for each recording, in order; Spark's commit protocol makes it whole or absent."""
    rows, column = EXPORTERS[fmt][0](entries), EXPORTERS[fmt][1]
    order = [c for c in ("rec_id", "n", "idx", "speaker") if c in rows.columns]
    _by_recording(rows).sortWithinPartitions(*order).select("rec_id", F.col(column).alias("value")).write.partitionBy("rec_id").text(path)


def upsert_partitions(rows: DataFrame, path: str, key: str = "job_id") -> None:
    """Replace the partitions of the keys in ``rows`` and leave the others."""
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(key).parquet(path)
