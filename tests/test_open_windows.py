"""Sessions and days of all events, closed or not."""

from datetime import datetime, timedelta

import pytest

from parlance.plans import registry
from parlance.session import new_path

START = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.mark.parametrize("name, expected", [("r07_live_sessions", [(1, 0, 2), (1, 86400, 1), (2, 86400, 1)]), ("r09_windows_with_watermark", [("view", 0, 2), ("view", 86400, 2)])])
def test_open_ones_count_and_no_row_is_late(spark, name, expected):
    folder = new_path(spark, "open")
    hours = [(1, 24), (2, 24), (1, 1), (1, 0)]
    for i, (user, hour) in enumerate(hours):
        spark.createDataFrame([(i, START + timedelta(hours=hour), user, "view", 1.0)], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    origin = int((START - datetime(1970, 1, 1)).total_seconds())
    found = registry.QUERIES[name](spark, folder).collect()
    assert sorted((r.key, r.start_s - origin, r.n) for r in found) == expected
