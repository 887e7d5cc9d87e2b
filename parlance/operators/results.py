"""Results as pages ask for them: filters, payloads, and model edits as rows located in entries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_LOGPROB, LOW_SPEAKER = -0.8, 0.5
EDITS = "array<struct<before: string, after: string, reason: string, confidence: string>>"


def matching(**wanted: object) -> Column:
    """The conjunction of equalities with the values that are given; values of None ask for nothing."""
    return reduce(and_, (F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None), F.lit(True))


def edit_rows(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """The other columns with pos, before, after, reason and confidence (0 to 1) of each edit in a model's answer.

    The answer may have text around its JSON array. What does not parse, edits without a ``before`` or without a change give
    no row; a confidence that is no number counts as 0.
    """
    array = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), EDITS)
    rows = responses.select(*(c for c in responses.columns if c != raw), F.posexplode(array).alias("pos", "edit")).select("*", "edit.*").drop("edit")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0))))
    return rows.where("before <> '' and after is not null and before <> after").withColumn("confidence", sure)


def located(edits: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``edits(keys, before)`` with idx and start (from 0) of the first entry of the same keys whose text holds ``before``.

    An edit whose words no entry holds is left out.
    """
    held = edits.join(entries.select(*keys, "idx", F.col("text").alias("_text")), keys).withColumn("start", F.instr("_text", F.col("before")) - 1)
    first = held.where("start >= 0").groupBy(*edits.columns).agg(F.min(F.struct("idx", "start")).alias("at"))
    return first.select(*edits.columns, "at.idx", "at.start")


def payload(entries: DataFrame) -> DataFrame:
    """rec_id and the JSON document of each recording: its entries with flags, and its speakers, those heard only beside others last."""
    flags = {
        "low_confidence": F.coalesce(F.col("avg_logprob") < LOW_LOGPROB, F.lit(False)),
        "low_speaker_confidence": F.coalesce(F.col("speaker_confidence") < LOW_SPEAKER, F.lit(False)),
        "edited": F.col("original_text").isNotNull(),
    }
    entry = F.struct("idx", "start_ms", "end_ms", "speaker_id", "text", *(v.alias(k) for k, v in flags.items()))
    own = entries.groupBy("rec_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    main = entries.where("speaker_id is not null").groupBy("rec_id", "speaker_id").agg(F.struct(F.lit(0).alias("beside"), F.min("idx").alias("at")).alias("rank"))
    beside = entries.select("rec_id", "idx", F.explode("extra_speakers").alias("speaker_id")).where("speaker_id is not null")
    beside = beside.groupBy("rec_id", "speaker_id").agg(F.struct(F.lit(1).alias("beside"), F.min("idx").alias("at")).alias("rank"))
    speakers = main.union(beside).groupBy("rec_id", "speaker_id").agg(F.min("rank").alias("rank"))
    speakers = speakers.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "speaker_id"))), lambda x: x["speaker_id"]).alias("speakers"))
    return own.join(speakers, "rec_id", "left").select("rec_id", F.to_json(F.struct("entries", "speakers")).alias("payload"))
