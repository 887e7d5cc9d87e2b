"""Pluggable stages: named functions from DataFrame to DataFrame, run in order, with protocols for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import ocr_clean
from parlance.operators import intervals, sequences
from parlance.operators.chunking import text_chunks

Stage = Callable[[DataFrame], DataFrame]


class Recognizer(Protocol):
    """Audio rows (rec_id, content) to segments; models run in tasks."""

    def __call__(self, audio: DataFrame) -> DataFrame: ...


class Diarizer(Protocol):
    """Audio rows to speaker segments."""

    def __call__(self, audio: DataFrame) -> DataFrame: ...


class Chat(Protocol):
    """One prompt to one answer; called once for each row of a batch."""

    def __call__(self, prompt: str) -> str: ...


class Embedder(Protocol):
    """Pieces of sound or text to vectors of one length, a batch at a time."""

    def __call__(self, pieces: list) -> list[list[float]]: ...


class TextReader(Protocol):
    """Images to the text on them, a batch at a time."""

    def __call__(self, images: list[bytes]) -> list[str]: ...


@dataclass
class Plan:
    """Stages by name; a stage may be replaced or left out."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def using(self, **changes: Stage | None) -> Plan:
        return Plan({k: s for k, s in (self.stages | changes).items() if s is not None})

    def run(self, df: DataFrame) -> DataFrame:
        for stage in self.stages.values():
            df = df.transform(stage)
        return df


def transcript_plan(speakers: DataFrame, max_gap_ms: int = 5000) -> Plan:
    """Segments to cleaned, attributed, sessionized entries."""

    def attribute(segments: DataFrame) -> DataFrame:
        return intervals.attributed(segments, speakers).withColumn("overlap", F.lit(False))

    return Plan({"merge": attribute, "clean": sequences.clean_artifacts, "context": sequences.context_fill, "sessions": lambda df: sequences.sessions(df, max_gap_ms)})


def answered(prompts: DataFrame, chat: Chat) -> DataFrame:
    """``prompts`` with an ``answer`` column from an injected model, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=[chat(p) for p in batch["prompt"]])

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes) + ", answer string"
    return prompts.mapInPandas(run, schema)


def embedded(rows: DataFrame, load: Callable[[], Embedder], column: str) -> DataFrame:
    """``rows`` with a ``vector`` for each value of a column; null for null. ``load`` makes the model once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            known = batch[column].notna()
            vectors = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                vectors[known] = pd.Series(model(batch.loc[known, column].tolist()), index=batch.index[known])
            yield batch.assign(vector=vectors)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", vector array<double>"
    return rows.mapInPandas(run, schema)


def read_texts(rows: DataFrame, load: Callable[[], TextReader], column: str) -> DataFrame:
    """``rows`` with the ``text`` on the image of a column, cleaned line by line; null for null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            known = batch[column].notna()
            texts = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if known.any():
                texts[known] = model(batch.loc[known, column].tolist())
            yield batch.assign(text=texts)

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", text string"
    return rows.mapInPandas(run, schema).withColumn("text", ocr_clean(F.col("text")))


def summarized(entries: DataFrame, chat: Chat, most: int) -> DataFrame:
    """Map chunks of a recording to partial answers and those to one; a single chunk needs no second step."""
    chunks = text_chunks(entries, most).join(entries.select("rec_id", "idx", "text"), ["rec_id", "idx"])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n")
    partial = answered(chunks.groupBy("rec_id", "chunk").agg(lines.alias("prompt")), chat)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "answer"))), lambda x: x["answer"]), "\n")
    whole = partial.groupBy("rec_id").agg(joined.alias("prompt"), F.count("*").alias("chunks"))
    reduced = answered(whole, chat)
    return reduced.select("rec_id", "chunks", F.when(F.col("chunks") > 1, F.col("answer")).otherwise(F.col("prompt")).alias("summary"))


def refined(rows: DataFrame, bad: DataFrame, again: Stage) -> DataFrame:
    """``rows`` with those in ``bad`` (rec_id, idx) replaced by what ``again`` makes of them."""
    kept = rows.join(bad, ["rec_id", "idx"], "left_anti")
    return kept.unionByName(again(rows.join(bad, ["rec_id", "idx"], "left_semi")))


def engine(speakers: int | None, most: int = 4) -> str:
    """Which diarization to plan: one pass for few speakers, windows and clustering for more or for an unknown number."""
    return "single" if speakers is not None and speakers <= most else "windowed"
