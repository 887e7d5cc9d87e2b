"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of their input with its own values, whatever their names.

In every stage null and empty texts are documents like others: none is toxic, all are one group of exact copies, none is a
near copy, and they have no tokens to be sampled by, so mixing keeps them only in a cell with other documents. An empty
table gives no rows. Rows that repeat a doc_id, and rows without one, are rows of their own: toxicity judges each by its
text, of equal texts exact dedup keeps one, near-copy removal tells them apart by their texts, mixing keeps or drops the
rows of one doc_id (or of none) together, packing packs each.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import dedup, jaccard, mixing, packing, toxicity
from parlance.llm.queries import ARROW_ROWS
from parlance.session import materialize


def _few_texts_a_batch(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def _decided(docs: DataFrame, names: tuple[str, ...], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``decide(docs)`` with the columns of ``docs``, also those that have one of the ``names`` which it gives its results."""
    aside = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    out = decide(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger trained on the labels does not reject."""
    _few_texts_a_batch(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _decided(docs, ("score", "predicted", "toxic_spans"), lambda d: toxicity.score(d, model).where("predicted = 0"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the one that stays."""
    return _decided(docs, dedup.RESULTS, lambda d: dedup.exact_dedup(spark, dedup.source_path(d)).where("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over five-word shingles connect, the one with the smallest doc_id.

    Where a doc_id repeats or is null, rows are told apart by their texts, and of equal texts one row stays too.
    """
    _few_texts_a_batch(spark)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return _decided(docs, ("_row",), _one_of_each_group)
    found = jaccard.jaccard_components(docs, n=5, percent=80)
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id"), "dropped")
    few = dropped.count() <= jaccard.BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(docs.columns)


def _one_of_each_group(docs: DataFrame) -> DataFrame:
    rows = docs.withColumn("_row", F.xxhash64("text"))
    found = jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), n=5, percent=80)
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    stays = rows.select("doc_id", "_row").join(groups, "_row").groupBy("component_id").agg(first)
    stays = materialize(stays.select(F.col("first.doc_id").alias("id"), F.col("first._row").alias("of")), "stays")
    kept = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_row") == F.col("of")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_row"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights by source, language and topic approach the targets."""
    return _decided(docs, mixing.RESULTS, lambda d: mixing.mix(d).where("kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    _few_texts_a_batch(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot train a tagger or encode tokens; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
