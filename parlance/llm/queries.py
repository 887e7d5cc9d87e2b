"""One query for each operator, over whole tables, and the SQL that it equals where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import token_counts
from parlance.llm.dedup import exact_dedup
from parlance.llm import collocations, fixity, licences, mixing
from parlance.llm.jaccard import jaccard_components, jaccard_links
from parlance.llm.nearest import nearest
from parlance.llm.packing import pack
from parlance.llm.pii import personal_data
from parlance.llm.runs import periodic_runs
from parlance.llm.secrets import secrets
from parlance.llm.toxicity import held_out, score, train

#: Rows in an Arrow batch: whole texts, so few of them.
ARROW_ROWS = "400"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(*fixity.replicas(fixity.warc_records(table(spark, sf_dir, "pages"))))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "toxic_spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), least=12, planted=True)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=100, top=2000)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op3_ngram_jaccard_links": op3_ngram_jaccard_links,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mixing": op6_mixing,
    "op7_licence_scan": op7_licence_scan,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_personal_data": op9_personal_data,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secret_scan": op12_secret_scan,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY n) AS group_size,
               row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) = 1 AS kept,
               sha256(n) AS text_sha256
        FROM d""",
    "op6_mixing": mixing.oracle(),
    "op7_licence_scan": licences.oracle(),
    "op13_collocations": collocations.oracle(),
    "op8_warc_fixity": r"""
        WITH r AS (
            SELECT page_id, page_id // 1000 AS file,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:sha1:'
                   || sha1(concat_ws('|', page_id::VARCHAR, url)) || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                   || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
                   || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
                   || chr(13) || chr(10) || chr(13) || chr(10) AS bytes
            FROM pages)
        SELECT page_id, file,
               coalesce(sum(strlen(bytes)) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
               strlen(bytes) AS length, sha256(bytes) AS sha256,
               CASE WHEN page_id % 211 = 17 THEN 'missing' WHEN page_id % 197 = 5 THEN 'damaged' ELSE 'ok' END AS status
        FROM r""",
}
