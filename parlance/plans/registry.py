"""Every query of the package by name, with the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.plans import index_queries, interval_queries, more_queries, phrase_queries, result_queries, seam_queries, sequence_queries, similarity_queries, source_queries, stage_queries, store_queries, streaming_queries, text_queries

FLAGSHIP = "j03_j06_speaker_attribution"
FAMILIES = (index_queries, interval_queries, text_queries, sequence_queries, store_queries, similarity_queries, streaming_queries, source_queries, stage_queries, more_queries, phrase_queries, result_queries, seam_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
