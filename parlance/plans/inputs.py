"""Inputs of the operators, derived from the driver tables; the same rows as SQL text for the oracles.

Times are integer milliseconds within a recording (a day of events, or a conversation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_ms(spark: bool) -> str:
    return "pmod(unix_micros(cast(ts as timestamp)) div 1000, 86400000)" if spark else "(epoch_us(ts) // 1000) % 86400000"


def _day(spark: bool) -> str:
    return "date_format(cast(ts as timestamp), 'yyyy-MM-dd')" if spark else "strftime(ts, '%Y-%m-%d')"


def _segments(spark: bool) -> str:
    s = _day_ms(spark)
    return f"{_day(spark)} AS rec_id, event_id AS idx, {s} AS start_ms, {s} + CAST(floor(value * 4000) AS BIGINT) AS end_ms, round(-value / 100, 4) AS avg_logprob, event_type AS text"


def _speakers(spark: bool) -> str:
    s = _day_ms(spark)
    return f"{_day(spark)} AS rec_id, event_id AS idx, {s} AS start_ms, {s} + CAST(floor(value * 10000) AS BIGINT) AS end_ms, concat('U', CAST(user_id % 8 AS VARCHAR(9))) AS speaker_id"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised segments: every third event."""
    return read(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr(*_columns(_segments(True)))


def speaker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who spoke when: the other events."""
    return read(spark, sf_dir, "events").where("event_id % 3 <> 0").selectExpr(*_columns(_speakers(True)))


def _columns(text: str) -> list[str]:
    """Split a select list at commas outside parentheses and quotes."""
    out, depth, quoted, held = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


SEG = f"seg AS (SELECT {_segments(False)} FROM events WHERE event_id % 3 = 0)"
SPK = f"spk AS (SELECT {_speakers(False)} FROM events WHERE event_id % 3 <> 0)"

_ENTRY = (
    "conv_id AS rec_id, turn AS idx, "
    "CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id * 7 + turn * 3) % 11 < 6 THEN 'A' ELSE role END AS speaker_id, "
    "text, turn * 9000 + (conv_id * 37 + turn * 113) % 4000 AS start_ms, "
    "turn * 9000 + (conv_id * 37 + turn * 113) % 4000 + {length}(text) * 15 AS end_ms, "
    "-CAST(({length}(text) * 7) % 150 AS DOUBLE) / 100 AS avg_logprob, (conv_id + turn) % 7 = 0 AS overlap"
)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript entries: the turns of conversations, with speakers, some of them unknown."""
    return read(spark, sf_dir, "conversations").where("conv_id is not null").selectExpr(*_columns(_ENTRY.format(length="length")))


ENT = f"ent AS (SELECT {_ENTRY.format(length='length')} FROM conversations WHERE conv_id IS NOT NULL)"

_JOB = (
    "o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, "
    "o_totalprice / 100 AS duration, o_orderdate AS created_at, o_custkey AS owner, o_orderpriority AS priority"
)
_STAGE = (
    "l_orderkey AS job_id, CASE l_linenumber WHEN 1 THEN 'denoise' WHEN 2 THEN 'asr' WHEN 3 THEN 'diarization' WHEN 4 THEN 'merge' "
    "WHEN 5 THEN 'clean' WHEN 6 THEN 'llm' ELSE 'export' END AS stage, l_linenumber AS pos, l_quantity AS seconds, l_discount > 0.07 AS cached, l_suppkey AS worker, l_tax AS fraction"
)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_columns(_JOB))


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_columns(_STAGE))


JOB = f"job AS (SELECT {_JOB} FROM orders)"
STAGE = f"stg AS (SELECT {_STAGE} FROM lineitem)"
