"""Recordings whose samples need more than 16 bits."""

from datetime import datetime

from parlance.plans import registry
from parlance.session import new_path
from tests.compare import rows_of, rows_of_sql


def test_wav_scan_of_large_and_negative_values(spark):
    folder = new_path(spark, "loud")
    at = datetime(2024, 1, 1)
    values = [(0, 655.34), (0, 655.4), (1, 784.29), (1, -3.01), (2, 5000.0), (2, 1e7), (2, -1e7)]
    rows = [(i, at, user, "view", value, "") for i, (user, value) in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    columns, found = rows_of(registry.QUERIES["s03_wav_scan"](spark, folder))
    sql = registry.ORACLES["s03_wav_scan"].replace("FROM events", f"FROM '{folder.removeprefix('file:')}/events.parquet/*.parquet'")
    assert (columns, found) == rows_of_sql(sql)
