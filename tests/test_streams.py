"""Live chunks under any split into batches, and windows that a watermark closes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.streaming import live as L
from parlance.streaming.chunks import STATE_SETTINGS, enhanced_chunks
from parlance.session import new_path

FRAMES = "key string, seq long, values array<double>, last boolean"


def batch(samples, size, fade, enhance):
    """All chunks laid out, faded and added up."""
    n = len(samples)
    starts = [0]
    while starts[-1] + size < n:
        starts.append(starts[-1] + size - fade)
    out = np.zeros(n)
    for c, s in enumerate(starts):
        own = enhance(samples[s : s + size], c).astype(float)
        if c:
            own[:fade] *= (np.arange(fade) + 0.5) / fade
        if s != starts[-1]:
            own[-fade:] *= 1 - (np.arange(fade) + 0.5) / fade if fade else 1
        out[s : s + size] += own
    return out


def stream_of(spark, frames, n_files):
    """Frames as files, one for each micro-batch."""
    path = new_path(spark, "frames")
    for part in np.array_split(np.arange(len(frames)), n_files):
        spark.createDataFrame([frames[i] for i in part], FRAMES).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("order, n_files", [("sorted", 1), ("sorted", 4), ("mixed", 3)])
def test_stream_equals_batch(spark, order, n_files):
    draw = random.Random(n_files)
    samples = {f"k{n}": np.array([draw.uniform(-1, 1) for _ in range(n)]) for n in (1, 19, 20, 21, 36, 37, 90)}
    frames = []
    for key, values in samples.items():
        cuts = sorted({0, len(values), *(draw.randint(0, len(values)) for _ in range(5))})
        frames += [(key, i, values[a:b].tolist(), b == len(values)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    frames.sort(key=lambda f: (f[1], f[0]))
    if order == "mixed":
        draw.shuffle(frames)
    loud = lambda x, chunk: x * (chunk + 1)
    out = L.drain(enhanced_chunks(stream_of(spark, frames, n_files), 20, 4, loud), state=STATE_SETTINGS).collect()
    for key, values in samples.items():
        got = sorted((r.place, r.x) for r in out if r.key == key)
        assert [p for p, _ in got] == list(range(len(values)))
        assert np.allclose([x for _, x in got], batch(values, 20, 4, loud))


def test_what_is_not_ended_waits_and_repeats_count_once(spark):
    frames = [("a", 0, [1.0] * 30, False), ("a", 0, [9.0] * 30, False), ("b", 1, [1.0], False)]
    out = L.drain(enhanced_chunks(stream_of(spark, frames, 3), 20, 4, lambda x, c: x), state=STATE_SETTINGS).collect()
    assert sorted((r.key, r.place, r.x) for r in out) == [("a", i, 1.0) for i in range(16)]
    with pytest.raises(Exception, match="at most 0"):
        L.drain(enhanced_chunks(stream_of(spark, frames, 1), 20, 4, lambda x, c: x, most_waiting=0), state=STATE_SETTINGS)
    with pytest.raises(ValueError):
        enhanced_chunks(stream_of(spark, frames, 1), 20, 11, lambda x, c: x)


EVENTS = "ts timestamp, key string, value double"


def test_late_rows_are_dropped_and_windows_close_once(spark):
    path = new_path(spark, "events")
    batches = [[("10:05", 1.0), ("10:20", 2.0)], [("11:30", 4.0)], [("11:35", 0.5)], [("10:10", 100.0), ("11:40", 8.0)], [("13:00", 16.0)]]
    for rows in batches:
        df = spark.createDataFrame([(t, "k", v) for t, v in rows], "t string, key string, value double")
        df.select(F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"), "key", "value").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    hour = lambda c: F.date_format(c, "HH:mm").alias(c)
    windows = L.drain(L.live_windows(stream(), "1 hour", "10 minutes")).select(hour("start"), "n", "total").collect()
    assert sorted(map(tuple, windows)) == [("10:00", 2, 3.0), ("11:00", 3, 12.5)]  # the late row is in none, 13:00 stays open
    sessions = L.drain(L.live_sessions(stream(), "20 minutes", "10 minutes")).select(hour("start"), hour("end"), "n", "total").collect()
    assert sorted(map(tuple, sessions)) == [("10:05", "10:40", 2, 3.0), ("11:30", "12:00", 3, 12.5)]
