"""Windows and chunks: what is planned over time or text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def speech_windows(spans: DataFrame, window_ms: int = 1500, tail_ms: int = 500) -> DataFrame:
    """Tumbling windows on each span; a tail shorter than ``tail_ms`` joins the window before it in the span."""
    length = F.col("end_ms") - F.col("start_ms")
    full = F.floor(length / window_ms)
    rest = length - full * window_ms
    n = F.when(full == 0, F.when(length > 0, 1).otherwise(0)).otherwise(full + F.when(rest >= tail_ms, 1).otherwise(0))
    rows = spans.withColumn("_n", n.cast("long")).where("_n > 0").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = F.col("start_ms") + F.col("k") * window_ms
    return rows.select("rec_id", "idx", "k", start.alias("win_start"), F.when(F.col("k") == F.col("_n") - 1, F.col("end_ms")).otherwise(start + window_ms).alias("win_end"))


def overlapping_windows(recordings: DataFrame, window_ms: int, overlap_ms: int) -> DataFrame:
    """Sliding windows over (rec_id, total_ms); each owns the time up to the middle of the overlap with its neighbour."""
    step = window_ms - overlap_ms
    last = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("total_ms") - window_ms) / step))
    rows = recordings.where("total_ms > 0").withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start, end = F.col("k") * step, F.least(F.col("k") * step + window_ms, F.col("total_ms"))
    rows = rows.select("rec_id", "k", "last", "total_ms", start.alias("win_start"), end.alias("win_end"))
    middle = F.floor(F.lit(overlap_ms) / 2)
    own_start = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("win_start") + middle)
    own_end = F.when(F.col("k") == F.col("last"), F.col("total_ms")).otherwise(F.col("win_start") + step + middle)
    return rows.select("rec_id", "k", "win_start", "win_end", own_start.alias("own_start"), own_end.alias("own_end"))


def text_chunks(entries: DataFrame, most: int) -> DataFrame:
    """rec_id, idx, chunk: lines in order, a new chunk where size + line would pass ``most`` (a line end counts too).

    A fold over the ordered lengths of a recording, since each chunk starts where the one before it ended.
    """
    grouped = entries.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("lines"))
    empty = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.expr("cast(array() as array<struct<idx:bigint,chunk:int>>)").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        new = (acc["size"] > 0) & (acc["size"] + line["n"] > most)
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        size = F.when(new, 0).otherwise(acc["size"]) + line["n"] + 1
        return F.struct(chunk.alias("chunk"), size.alias("size"), F.array_append(acc["out"], F.struct(line["idx"].cast("long").alias("idx"), chunk.alias("chunk"))).alias("out"))

    return grouped.select("rec_id", F.explode(F.aggregate("lines", empty, step, lambda a: a["out"])).alias("r")).select("rec_id", "r.*")


def fitting_prefix(terms: DataFrame, most: int, separator: int = 2) -> DataFrame:
    """Terms of each group in order that fit ``most`` characters together; ones that do not fit are passed over."""
    grouped = terms.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    empty = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cost = F.length(x["term"]) + F.when(F.size(acc["out"]) > 0, separator).otherwise(0)
        fits = acc["used"] + cost <= most
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["out"], x["term"])).otherwise(acc["out"]).alias("out"))

    return grouped.select("rec_id", F.aggregate("t", empty, step, lambda a: a["out"]).alias("kept"))


def speech_samples(spans: DataFrame, k: int, window_ms: int) -> DataFrame:
    """``k`` windows of each recording at even offsets of its cumulative speech."""
    order = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "idx")
    length = F.col("end_ms") - F.col("start_ms")
    rows = spans.where("end_ms > start_ms").withColumn("_to", F.sum(length).over(order)).withColumn("_from", F.col("_to") - length)
    total = Window.partitionBy("rec_id")
    rows = rows.withColumn("_all", F.max("_to").over(total)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    target = F.floor(F.col("_all") * (2 * F.col("k") + 1) / (2 * k))
    rows = rows.where((target >= F.col("_from")) & (target < F.col("_to")))
    start = F.col("start_ms") + target - F.col("_from")
    return rows.select("rec_id", "k", start.alias("win_start"), (start + window_ms).alias("win_end"))


def frame_energies(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """key, n (samples), k, energy: the mean square of the samples (key, place, x) from place k * hop on, ``frame`` of them.

    Places count from 0 without gaps. The last frames are those that fit, or one shorter frame if none does.
    """
    size = F.col("n") - frame
    last = F.when(size >= 0, F.floor(size / hop)).otherwise(0)
    totals = samples.groupBy("key").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.floor((F.col("place") - frame + hop) / hop))
    frames = F.sequence(first, F.floor(F.col("place") / hop))
    # a sample counts in every frame that holds it; tasks add up first
    each = samples.select("key", "x", F.explode(frames).alias("k")).groupBy("key", "k").agg((F.sum(F.col("x") * F.col("x")).cast("double") / F.count("*")).alias("energy"))
    return each.join(totals, "key").where(F.col("k") <= last).select("key", "n", "k", "energy")


def quiet_chunks(samples: DataFrame, chunk: int, overlap: int, frame: int, hop: int) -> DataFrame:
    """key, chunk, start, stop of overlapping chunks of ``samples(key, place, x)`` that begin where it is quiet.

    Each chunk begins ``chunk - overlap`` after the one before it, moved to the middle of the frame with the least energy
    within half the overlap (of equals the nearest, then the first); a rest no longer than the overlap joins the chunk before
    it. A start depends on the start before it, so a recording's starts are a fold over its energies, one number for each
    ``hop`` samples; the samples themselves are never gathered. Overlaps count as at most half a chunk.
    """
    lap = max(0, min(overlap, chunk // 2))
    step, radius = max(1, chunk - lap), lap // 2
    rows = frame_energies(samples, frame, hop).groupBy("key").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "energy"))).alias("e"))
    # places of the frames whose middle lies around the target, as numbers from 0
    low = f"greatest(0, cast(ceil((t - {radius} - {frame // 2}) / {hop}) as int))"
    high = f"least(size(e) - 1, cast(floor((t + {radius} - {frame // 2}) / {hop}) as int))"
    near = f"if({low} <= {high}, slice(e, {low} + 1, {high} - {low} + 1), slice(e, 1, 0))"
    best = f"array_min(transform({near}, f -> struct(f.energy as energy, abs(f.k * {hop} + {frame // 2} - t) as off, f.k * {hop} + {frame // 2} as middle))).middle"
    snapped = f"coalesce({best}, t)" if radius else "t"
    starts = F.expr(f"""aggregate(sequence(1, cast(n div {max(1, step - radius)} as int) + 1), array(0L), (s, turn) -> element_at(transform(array(element_at(s, -1) + {step}), t ->
        if(t >= n or n - t <= {lap} or turn > size(s), s, array_append(s, greatest(element_at(s, -1) + 1, least(cast({snapped} as bigint), n - 1))))), 1))""")
    rows = rows.select("key", "n", starts.alias("starts")).select("key", "n", F.size("starts").alias("m"), F.posexplode("starts").alias("chunk", "start"))
    return rows.select("key", "chunk", "start", F.when(F.col("chunk") == F.col("m") - 1, F.col("n")).otherwise(F.least(F.col("start") + chunk, F.col("n"))).alias("stop"))
