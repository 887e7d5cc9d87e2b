"""The pipeline's stages against plain versions of their decisions."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import DATA
from tests.llm.test_operators import brute_components, docs_of, stored


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = spark.read.parquet(stored(stage(spark, docs, DATA), tmp_path, name))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert after.items() <= before.items()
        if name == "exact_dedup":
            squeezed = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in before.values()}
            assert len(after) == len(squeezed)
        if name == "ngram_jaccard":
            assert set(after) == {c for _, c in brute_components(before.items(), 5, 80).values()}
        before, docs = after, out


def test_empty_documents(spark, tmp_path):
    empty = docs_of(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).collect() == []


def test_clashing_columns_keep_their_values(spark):
    names = ["score", "predicted", "kept", "keep_id", "topic", "n_tokens", "_row", "_tokens", "_digest"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    docs = docs.select("*", *(F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, DATA).collect()
        assert rows and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names), name


def test_near_copies_with_repeated_ids(spark):
    long = " ".join(f"w{k}" for k in range(80))
    texts = [long, "another text of some words here", "another text of some words here", long + " end", "a third one that has no copies at all"]
    docs = docs_of(spark, texts, [5, 5, 5, None, None]).select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.without_near_copies(spark, docs, DATA).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, texts[4]), (5, texts[1]), (5, long)]
