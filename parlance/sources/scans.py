"""Readers: each parses lines or documents that Spark has read, with explicit schemas, and keeps going past bad rows.

``*_lines`` functions take a DataFrame with a ``value`` column; ``read_*`` read paths.
"""

from __future__ import annotations

import csv
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ASR_SCHEMA = "transcription array<struct<offsets:struct<`from`:long,`to`:long>,text:string,tokens array<struct<text:string,p:double,offsets:struct<`from`:long,`to`:long>>>>>".replace("tokens array", "tokens:array")
RESULT_SCHEMA = "rec_id string, language string, duration double, speakers array<struct<id:string,name:string>>, entries array<struct<start:double,end:double,text:string,speaker:string,avg_logprob:double,words:array<struct<text:string,start:double,end:double>>>>"
MEDIA = ("mp3", "wav", "m4a", "ogg", "flac", "mp4", "mkv", "webm", "avi", "mov")
#: Header names of glossary columns, in English and Russian. Fixed values.
ALIASES = {"canonical": ("canonical", "term", "термин", "канон"), "variant": ("variant", "wrong", "вариант", "ошибка"), "category": ("category", "категория"), "note": ("note", "comment", "примечание", "комментарий")}


def rttm_lines(lines: DataFrame, recording: str | None = None) -> DataFrame:
    """rec_id, start_ms, end_ms, speaker_id of SPEAKER lines with at least eight fields, a label and a duration."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.select(f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start, length = F.expr("try_cast(f[3] as double)"), F.expr("try_cast(f[4] as double)")
    number = F.regexp_extract(F.col("f")[7], r"^speaker_(\d+)$", 1).try_cast("int")
    label = F.when(number >= 1, F.format_string("SPEAKER_%02d", number - 1)).otherwise(F.col("f")[7])
    rows = rows.select(F.col("f")[1].alias("rec_id"), start.alias("s"), length.alias("d"), label.alias("speaker_id"), F.col("f")[7].alias("raw")).where("d > 0 and s is not null and raw <> '<NA>'")
    rows = rows.where(F.col("rec_id") == recording) if recording else rows
    return rows.select("rec_id", F.round(F.col("s") * 1000).cast("long").alias("start_ms"), F.round((F.col("s") + F.col("d")) * 1000).cast("long").alias("end_ms"), "speaker_id")


def asr_documents(documents: DataFrame) -> DataFrame:
    """doc, idx, start_ms, end_ms, text, avg_logprob of segments with text in token JSON documents (doc, value)."""
    parsed = documents.select("doc", F.from_json("value", ASR_SCHEMA, {"mode": "FAILFAST"}).alias("j")).select("doc", F.posexplode("j.transcription").alias("idx", "s"))
    lexical = F.filter(F.coalesce("s.tokens", F.expr("cast(array() as array<struct<text:string,p:double,offsets:struct<`from`:bigint,`to`:bigint>>>)")), lambda t: (t["p"] > 0) & ~F.trim(t["text"]).rlike(r"^\[_.*\]$"))
    mean = F.aggregate(lexical, F.lit(0.0), lambda a, t: a + F.log(t["p"])) / F.nullif(F.size(lexical), F.lit(0))
    return parsed.where(F.trim("s.text") != "").select("doc", F.col("idx").cast("long").alias("idx"), F.col("s.offsets.from").alias("start_ms"), F.col("s.offsets.to").alias("end_ms"), F.trim("s.text").alias("text"), mean.alias("avg_logprob"))


def glossary_lines(lines: DataFrame) -> DataFrame:
    """canonical and variant of lines ``term`` or ``wrong = canonical``; comments and blank lines are left out."""
    v = F.trim("value")
    parts = F.split(v, "=", 2)
    pair = F.size(parts) == 2
    return lines.where((v != "") & ~v.startswith("#")).select(F.when(pair, F.trim(parts[1])).otherwise(v).alias("canonical"), F.when(pair, F.trim(parts[0])).alias("variant"))


def sniff_delimiter(head: str) -> str:
    """The delimiter of a CSV head among comma, semicolon and tab."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t").delimiter
    except csv.Error:
        return max(",;\t", key=head.count)


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Glossary columns by their aliases; without a known header the first column is the term. Reads a head on the driver."""
    first = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4096]
    sep = sniff_delimiter(first)
    header = [c.strip().strip('"').lower() for c in first.split("\n", 1)[0].split(sep)]
    names = {alias: column for column, aliases in ALIASES.items() for alias in aliases}
    if not any(h in names for h in header):
        df = spark.read.csv(path, sep=sep, escape='"', schema=", ".join(f"c{i} string" for i in range(len(header))))
        return df.select(F.trim("c0").alias("canonical"), F.lit(None).cast("string").alias("variant"))
    df = spark.read.csv(path, sep=sep, escape='"', header=True).toDF(*(names.get(h, f"other{i}") for i, h in enumerate(header)))
    return df.select(*(F.trim(c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ALIASES))


def result_documents(documents: DataFrame) -> DataFrame:
    """rec_id, idx, start_ms, end_ms, text, speaker_id of result documents (value); malformed ones give no rows."""
    parsed = documents.select(F.from_json("value", RESULT_SCHEMA).alias("j")).select("j.rec_id", F.posexplode("j.entries").alias("idx", "e"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return parsed.select("rec_id", F.col("idx").cast("long").alias("idx"), ms("e.start").alias("start_ms"), ms("e.end").alias("end_ms"), F.col("e.text").alias("text"), F.col("e.speaker").alias("speaker_id"))


def unprocessed(files: DataFrame) -> DataFrame:
    """Media files of a listing (path, length) without a ``<file>.processed`` marker beside them, by name."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    media = files.where(kind.isin(*MEDIA))
    markers = files.where(F.col("path").endswith(".processed")).select(F.regexp_replace("path", r"\.processed$", "").alias("path"))
    return media.join(markers, "path", "left_anti").withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1)))


def voice_library(files: DataFrame) -> DataFrame:
    """name and its files in order: ``Name (2).wav`` is the second sample of ``Name``."""
    base = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    index = F.coalesce(F.regexp_extract(base, r" \((\d+)\)$", 1).try_cast("int"), F.lit(1))
    rows = files.dropDuplicates(["path"]).select(F.regexp_replace(base, r" \(\d+\)$", "").alias("name"), F.struct(index.alias("i"), F.lower("path").alias("k"), "path").alias("s"))
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["path"]).alias("paths"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and time of files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def wav_samples(files: DataFrame, rate: int | None = None) -> DataFrame:
    """path, rate, samples (in [-1, 1), mono) of 16-bit or 32-bit PCM files (path, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with wave.open(io.BytesIO(content)) as f:
                    size = f.getsampwidth()
                    if size not in (2, 4) or (rate and f.getframerate() != rate):
                        raise ValueError(f"{path}: not 16-bit or 32-bit PCM at the expected rate")
                    x = np.frombuffer(f.readframes(f.getnframes()), dtype=f"<i{size}").reshape(-1, f.getnchannels()).mean(axis=1) / 2 ** (8 * size - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.getframerate()], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64()))], names=["path", "rate", "samples"])

    return files.select("path", "content").mapInArrow(decode, "path string, rate int, samples array<double>")


def config_lines(lines: DataFrame) -> DataFrame:
    """key and value of KEY=VALUE lines; of a repeated key the last by ``pos`` counts."""
    v = F.trim("value")
    parts = F.split(v, "=", 2)
    rows = lines.where((v != "") & ~v.startswith("#") & (F.size(parts) == 2)).select("pos", F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), "^[\"']|[\"']$", "").alias("value"))
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("pos")))
    return rows.withColumn("_n", last).where("_n = 1").select("key", "value")
