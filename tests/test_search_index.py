"""The kept index: what a refresh writes and reads, removal, filters, compaction, and a refresh that died."""

import glob

import pytest
from pyspark.sql import functions as F

from parlance.operators import store as S
from parlance.operators.search_index import SearchIndex, bucket
from parlance.session import new_path

ENTRIES = "job_id long, entry long, speaker string, text string"
TEXTS = [(1, 0, "A", "Signal and signals"), (1, 1, "B", "no match here"), (2, 0, "A", "a signal of sign language"), (2, 1, None, None), (3, 0, "B", "..."), (3, 1, "B", "Sigma x_1 é")]


def filled(spark, texts=TEXTS):
    index = SearchIndex.create(spark, new_path(spark, "index"), mtime="int")
    index.refresh(jobs_of(spark, {t[0]: 1 for t in texts}), spark.createDataFrame(texts, ENTRIES))
    return index


def jobs_of(spark, times):
    return spark.createDataFrame(list(times.items()), "job_id long, mtime int")


def scores(hits):
    return {(r.job_id, r.entry): round(r.score, 9) for r in hits.collect()}


def plain(spark, texts, terms):
    return scores(S.bm25(spark.createDataFrame(texts, ENTRIES), terms, ["job_id", "entry"]))


@pytest.mark.parametrize("terms", [["sign"], ["s"], ["sig", "a"], ["é"], ["x_1"], ["SIGNAL", "and"], ["zz"]])
def test_scores_equal_a_scan_of_all_texts(spark, terms):
    assert scores(filled(spark).search(terms)) == plain(spark, TEXTS, [t.lower() for t in terms])


def test_a_refresh_reads_and_writes_changed_jobs_only(spark):
    index = filled(spark)
    before = set(glob.glob(f"{index.path}/postings/**/*.parquet", recursive=True))
    texts = [t for t in TEXTS if t[0] != 2] + [(3, 2, "C", "sign again"), (4, 0, "A", "fresh sign")]
    written = index.refresh(jobs_of(spark, {1: 1, 3: 2, 4: 1}), spark.createDataFrame(texts, ENTRIES))
    assert {(r.job_id, r.removed) for r in written.collect()} == {(2, True), (3, False), (4, False)}
    after = set(glob.glob(f"{index.path}/postings/**/*.parquet", recursive=True))
    assert before < after and {r.job_id for r in spark.read.parquet(*(after - before)).select("job_id").distinct().collect()} == {3, 4}
    assert {(r.job_id, r.generation, r.n_entries) for r in index.jobs().collect()} == {(1, 1, 2), (3, 2, 2), (4, 2, 1)}
    for terms in (["sign"], ["s"], ["sig", "again"]):
        assert scores(index.search(terms)) == plain(spark, texts, terms)
    assert index.refresh(jobs_of(spark, {1: 1, 3: 2, 4: 1}), spark.createDataFrame(texts, ENTRIES)).count() == 0
    compact = index.compacted(new_path(spark, "index"))
    assert scores(compact.search(["sign"])) == plain(spark, texts, ["sign"])
    assert {r.generation for r in compact.jobs().collect()} == {1}


def test_a_search_reads_the_bucket_of_its_term(spark):
    index = filled(spark)
    plan = index.postings(["sign"])._jdf.queryExecution().toString()
    own = spark.range(1).select(bucket(F.lit("sign"))).first()[0]
    assert f"= {own})" in plan and "StringStartsWith(token,sign)" in plan


def test_a_refresh_that_died_changes_nothing(spark):
    index = filled(spark)
    lost = index.spark.createDataFrame([("sign", 9, 0, None, 1, 1, 3)], "token string, job_id long, entry long, speaker string, length int, tf int, bucket int")
    lost.write.partitionBy("bucket").parquet(f"{index.path}/postings/generation=2")
    assert scores(index.search(["sign"])) == plain(spark, TEXTS, ["sign"])
    texts = [*TEXTS, (9, 0, "A", "other")]
    index.refresh(jobs_of(spark, {1: 1, 2: 1, 3: 1, 9: 1}), spark.createDataFrame(texts, ENTRIES))
    assert scores(index.search(["sign"])) == plain(spark, texts, ["sign"])


def test_filters_and_empty_indexes(spark):
    index = filled(spark)
    every = scores(index.search(["sig"]))
    assert scores(index.search(["sig"], speaker="A")) == {k: v for k, v in every.items() if k in {(1, 0), (2, 0)}}
    assert scores(index.search(["sig"], jobs=jobs_of(spark, {3: 0}))) == {k: v for k, v in every.items() if k[0] == 3}
    assert index.search([]).collect() == [] == index.search([""]).collect()
    empty = SearchIndex.create(spark, new_path(spark, "index"), mtime="int")
    assert empty.search(["a"]).collect() == []
    empty.refresh(jobs_of(spark, {}), spark.createDataFrame([], ENTRIES))
    assert empty.search(["a"]).collect() == [] and empty.jobs().count() == 0
