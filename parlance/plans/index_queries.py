"""Queries over the kept search index, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import store as S
from parlance.operators.search_index import SearchIndex
from parlance.plans.inputs import read
from parlance.session import new_path

_CHANGED = "id % 3 = 0"


def _documents(spark, sf):
    return read(spark, sf, "documents").where("doc_id is not null").selectExpr("doc_id div 10 as id", "doc_id as entry", "source as speaker", "text")


def _indexed(spark, sf) -> SearchIndex:
    """All documents, ten a job; then every third job has changed, and every seventh has gone."""
    docs = _documents(spark, sf)
    index = SearchIndex.create(spark, new_path(spark, "index"), mtime="int")
    jobs = docs.select(F.col("id").alias("job_id"), F.lit(1).alias("mtime")).distinct()
    index.refresh(jobs, docs.withColumnRenamed("id", "job_id"))
    later = docs.withColumn("text", F.expr(f"case when {_CHANGED} then concat(text, ' erneut tionale 7') else text end")).where("id % 7 <> 0")
    jobs = later.selectExpr("id as job_id", f"case when {_CHANGED} then 2 else 1 end as mtime").distinct()
    index.refresh(jobs, later.withColumnRenamed("id", "job_id"))
    return index


def t01(spark, sf):
    """The same out of an index of all documents."""
    docs = _documents(spark, sf)
    index = SearchIndex.create(spark, new_path(spark, "index"), mtime="int")
    index.refresh(docs.select(F.col("id").alias("job_id"), F.lit(1).alias("mtime")).distinct(), docs.withColumnRenamed("id", "job_id"))
    hits = index.search(["tion", "er"])
    return hits.select(F.col("entry").alias("doc_id"), F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)


def t01_scan(spark, sf):
    """Documents with words that begin with both terms, by score, in one pass over all texts."""
    hits = S.bm25(read(spark, sf, "documents"), ["tion", "er"], ["doc_id"])
    return hits.withColumn("score", F.round("score", 5)).orderBy(F.desc("score"), "doc_id").limit(100)


def t03(spark, sf):
    """Jobs, and what the index holds of them, after the second refresh."""
    return _indexed(spark, sf).jobs()


def t03_search(spark, sf):
    """Hits and scores after the second refresh."""
    hits = _indexed(spark, sf).search(["Tion", "er"])
    return hits.select("job_id", "entry", F.round("score", 5).alias("score"))


_NOW = rf"now AS (SELECT doc_id // 10 AS id, doc_id, regexp_extract_all(lower(CASE WHEN (doc_id // 10) % 3 = 0 THEN text || ' erneut tionale 7' ELSE text END), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents WHERE doc_id IS NOT NULL AND (doc_id // 10) % 7 <> 0)"
_SCORE = "greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))"
_COUNTED = """d AS (SELECT *, len(w) AS l, len(list_filter(w, lambda x: starts_with(x, 'tion'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'er'))) AS b FROM now WHERE len(w) > 0),
    t AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM d)"""
QUERIES = {"t01_bm25_search": t01_scan, "t01_indexed_search": t01, "t03_incremental_index": t03, "t03_search_after_refresh": t03_search}
ORACLES = {
    "t01_bm25_search": rf"""WITH now AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM documents), {_COUNTED}
        SELECT doc_id, round({_SCORE}, 5) AS score FROM d, t WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 100""",
    "t03_incremental_index": f"""WITH {_NOW} SELECT id AS job_id, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS mtime, count(*) FILTER (len(w) > 0) AS n_entries, coalesce(sum(len(w)), 0)::BIGINT AS n_tokens,
        CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS generation FROM now GROUP BY id""",
    "t03_search_after_refresh": f"WITH {_NOW}, {_COUNTED} SELECT id AS job_id, doc_id AS entry, round({_SCORE}, 5) AS score FROM d, t WHERE a > 0 AND b > 0",
}
ORACLES["t01_indexed_search"] = ORACLES["t01_bm25_search"]
