"""Running values in two levels against plain windows, and intervals that reach over many bins."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import intervals as I
from parlance.operators import scans as S


def test_scans_equal_windows_over_whole_keys(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([1, None]), t, draw.choice([None, 1, 2, 5, -3])) for t in draw.sample(range(2000), 400)]
    df = spark.createDataFrame(rows, "k string, k2 long, t long, v long")
    v = F.col("v")
    kinds = {"b": S.before(v), "a": S.after(v), "s": S.total(v), "m": S.most_before(v), "l": S.last_known(v), "n": S.next_known(v)}
    w = Window.partitionBy("k", "k2").orderBy("t")
    up_to, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    plain = df.select(
        "*", F.lag("v").over(w).alias("b"), F.lead("v").over(w).alias("a"), F.sum("v").over(up_to).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.last("v", True).over(up_to).alias("l"), F.first("v", True).over(ahead).alias("n"),
    )
    expected = sorted(map(tuple, plain.collect()), key=repr)
    for width in (1, 7, 100, 5000):
        found = S.scanned(df, ["k", "k2"], F.floor(F.col("t") / width), ["t"], **kinds)
        assert found.columns == plain.columns
        assert sorted(map(tuple, found.collect()), key=repr) == expected, width
    assert S.scanned(df.limit(0), ["k"], F.col("t"), ["t"], **kinds).collect() == []


def merged(rows, gap):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_islands_over_bins(spark):
    draw = random.Random(3)
    for gap in (0, 700):
        rows = [(s := draw.randrange(0, 20_000_000), s + draw.choice([0, 500, 40_000, 900_000, 4_000_000])) for _ in range(draw.choice([20, 150]))]
        df = spark.createDataFrame([("r", *x) for x in rows], "rec_id string, start_ms long, end_ms long")
        assert sorted((r.start_ms, r.end_ms) for r in I.islands(df, ["rec_id"], gap).collect()) == merged(rows, gap)


def test_following_and_runs_over_parts(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "b", None]), t, draw.choice([None, 1, 1, 1, 2])) for t in draw.sample(range(900), 300)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    w = Window.partitionBy("k").orderBy("t")
    expected = sorted(map(tuple, df.withColumn("n", F.lead("v").over(w)).withColumn("m", F.lead("t").over(w)).collect()), key=repr)
    runs = []
    for k in ("a", "b", None):
        own, last = sorted((t, v) for key, t, v in rows if key == k), ()
        for t, v in own:
            if last != (v,):
                runs.append([k, v, t, 0])
            runs[-1][3], last = runs[-1][3] + 1, (v,)
    for width in (1, 9, 50, 5000):
        part = F.floor(F.col("t") / width)
        assert sorted(map(tuple, S.following(df, ["k"], part, ["t"], n="v", m="t").collect()), key=repr) == expected
        _, pieces = S.pieces_of_runs(df, ["k"], part, "t", F.col("v"), n=F.count("*"), at=F.min("t"))
        found = pieces.groupBy("k", "_head").agg(F.first("_value.v").alias("v"), F.min("at").alias("at"), F.sum("n").alias("n")).drop("_head")
        assert sorted(map(list, found.collect()), key=repr) == sorted(runs, key=repr), width


def sweep(rows):
    """Regions with two speakers or more, where touching splits."""
    marks = sorted([(s, 1, i, who) for i, who, s, e in rows] + [(e, -1, i, who) for i, who, s, e in rows])
    active, out, since = {}, [], None
    for t, d, _, who in marks:
        before = sum(n > 0 for n in active.values())
        active[who] = active.get(who, 0) + d
        now = sum(n > 0 for n in active.values())
        if before < 2 <= now:
            since = t
        elif now < 2 <= before and t > since:
            out.append((since, t))
    return sorted(out)


def test_sweeps_over_bins(spark):
    draw = random.Random(2)
    step = I.BIN_MS // 4  # so that many ends lie on borders
    for n in (6, 40):
        rows = [(i, draw.choice("ABC"), s := draw.randrange(0, 60) * step, s + draw.choice([1, 1, 2, 5, 30]) * step) for i in range(n)]
        rows = [(i, who, s, e) for i, who, s, e in rows]
        df = spark.createDataFrame([("r", *x) for x in rows], "rec_id string, idx long, speaker_id string, start_ms long, end_ms long")
        assert sorted((r.start_ms, r.end_ms) for r in I.overlap_regions(df).collect()) == sweep(rows)
        holes = df.where("speaker_id = 'B'")
        base = [x for x in rows if x[1] == "A"]
        cover = {t for _, _, s, e in base for t in range(s, e, step)} - {t for _, who, s, e in rows if who == "B" for t in range(s, e, step)}
        found = I.subtract(df.where("speaker_id = 'A'"), holes, ["rec_id"]).collect()
        assert sorted((r.start_ms, r.end_ms) for r in found) == merged([(t, t + step) for t in cover], 0)
        slices = {(r.start_ms, r.end_ms, *r.speakers) for r in I.atomic_simultaneous(df).collect()}
        own = {who: merged([x[2:] for x in rows if x[1] == who], 0) for who in "ABC"}
        ends = sorted({t for spans in own.values() for x in spans for t in x})
        assert slices == {(a, b, *who) for a, b in zip(ends, ends[1:]) if len(who := [k for k in "ABC" if any(s <= a and b <= e for s, e in own[k])]) > 1}
