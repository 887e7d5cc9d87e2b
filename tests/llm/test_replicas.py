"""The fixity query where page ids repeat with other bodies or are null."""

from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import fixity, queries


def test_repeated_and_null_ids_keep_their_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixity, "RECORDS_PER_FILE", 10)
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 90)) for i in range(30)]
    rows += [(i, f"http://h/{i}", body) for i in (3, 5, 17) for body in ("one", "two, longer", "three")]
    rows += [(None, f"http://n/{k}", "y" * k) for k in range(40)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = queries.op8_warc_fixity(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    assert len({(x.file, x.offset) for x in found}) == len(rows)
    expected = Counter({(5, "damaged"): 4, (17, "missing"): 4})
    assert Counter((x.page_id, x.status) for x in found if x.status != "ok") == expected
    assert len({x.file for x in found if x.page_id == -1}) > 1


def test_any_page_ids(spark):
    """Large, negative and null ids, with faults on both sides that are all found, and only they."""
    ids = [2**62, 2**62 + 1, 2**53 + 1, 2**63 - 1, -(2**63), -5, -1, 0, 999, 1000, None, None]
    pages = spark.createDataFrame([(i, f"u{k}", "z" * k * 20_000) for k, i in enumerate(ids)], "page_id long, url string, html string")
    records = fixity.warc_records(pages)
    files = {r.page_id: r.file for r in records.where("page_id <> -1").collect()}
    assert files == {i: i // 1000 for i in ids if i not in (None, -1)}
    one = fixity.placed(fixity.hashed(records))
    two = one.where("page_id <> -5").withColumn("sha256", F.when(F.col("page_id").isin(2**62, 999), F.lit("0")).otherwise(F.col("sha256")))
    found = lambda a, b: Counter((x.page_id, x.status) for x in fixity.audit(a, b).collect() if x.status != "ok")
    assert found(one, two) == {(-5, "missing"): 1, (2**62, "damaged"): 1, (999, "damaged"): 1}
    assert found(two, one)[-5, "extra"] == 1
    assert fixity.audit(one, one).where("status = 'ok'").count() == len(ids)
    far = one.withColumn("offset", F.col("offset") + (1 << 40))  # a file of more than 2 ** 20 ranges
    assert found(far, far.where("page_id <> 0")) == {(0, "missing"): 1}
