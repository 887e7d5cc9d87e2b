"""Queries over ordered rows and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions.text import match_key
from parlance.operators import intervals as I
from parlance.operators import sequences as S
from parlance.plans.inputs import ENT, SPK, entries, read, segments, speaker_segments

WORDS = "wd AS (SELECT rec_id, idx, CASE WHEN idx % 7 = 0 THEN NULL ELSE speaker_id END AS speaker_id, start_ms, CASE WHEN idx % 5 = 1 THEN start_ms + 100 ELSE end_ms END AS end_ms FROM spk)"
FRAMES = "fr AS (SELECT strftime(ts, '%Y-%m-%d') AS rec_id, event_id, epoch_us(ts) // 1000 AS ts_ms, event_type = 'signup' AS scene_cut, [(user_id % 4)::DOUBLE / 100, floor(value / 200) / 20] AS features FROM events)"
TOKENS = "tk AS (SELECT conv_id * 10 + turn AS rec_id, i AS idx, CASE WHEN i % 3 = 0 THEN ' ' ELSE '' END || substr(text, i::INT * 3 + 1, 3) AS text, i * 200 AS start_ms, i * 200 + (i * 37) % 250 AS end_ms, (i * 31 % 100) / 100.0::DOUBLE AS p FROM (SELECT *, unnest(range(0, greatest(1, ceil(length(coalesce(text, '')) / 3)::INT))) AS i FROM conversations))"
PROGRESS = "pg AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq, CASE WHEN event_type = 'error' THEN 'done' ELSE event_type END AS stage, value < 5 AS cached FROM events)"


PIECE_BIN_MS = 120_000


def words(spark, sf):
    return speaker_segments(spark, sf).selectExpr("rec_id", "idx", "case when idx % 7 = 0 then null else speaker_id end as speaker_id", "start_ms", "case when idx % 5 = 1 then start_ms + 100 else end_ms end as end_ms")


def tokens(spark, sf):
    c = read(spark, sf, "conversations").selectExpr("conv_id * 10 + turn as rec_id", "text", "explode(sequence(0, greatest(1, cast(ceil(length(coalesce(text, '')) / 3) as int)) - 1)) as i")
    return c.selectExpr("rec_id", "cast(i as bigint) as idx", "concat(case when i % 3 = 0 then ' ' else '' end, substr(text, i * 3 + 1, 3)) as text", "cast(i * 200 as bigint) as start_ms", "cast(i * 200 + (i * 37) % 250 as bigint) as end_ms", "cast(i * 31 % 100 as double) / 100 as p")


def progress(spark, sf):
    return read(spark, sf, "events").selectExpr("user_id as job_id", "unix_micros(cast(ts as timestamp)) div 1000 as ts_ms", "event_id as seq", "case when event_type = 'error' then 'done' else event_type end as stage", "value < 5 as cached")


def w01(spark, sf):
    return S.sessions(entries(spark, sf))


def w02(spark, sf):
    return S.trim_overlaps(entries(spark, sf)).select("rec_id", "idx", "start_ms", "end_ms")


def w03(spark, sf):
    short = entries(spark, sf).withColumn("text", F.when(F.col("idx") % 2 == 0, F.lit("yes ok")).otherwise(F.col("text")))
    return S.context_fill(short).select("rec_id", "idx", "speaker_id")


def _repeating(spark, sf):
    return entries(spark, sf).withColumn("text", F.when(F.col("idx") % 4 < 2, F.concat(F.lit("Same words again "), (F.col("rec_id") % 3).cast("string"))).otherwise(F.col("text")))


def w04_exact(spark, sf):
    return S.collapse_exact(_repeating(spark, sf), match_key(F.col("text")))


def w04_fuzzy(spark, sf):
    return S.collapse_repeats(_repeating(spark, sf)).select("rec_id", "idx", "end_ms")


def w05(spark, sf):
    noisy = entries(spark, sf).withColumn("text", F.expr("case (rec_id * 3 + idx) % 8 when 0 then 'Applause.' when 1 then 'applause applause' when 2 then '[MUSIC]' when 3 then 'Laughter' when 4 then 'Thanks for watching' else text end"))
    return S.clean_artifacts(noisy).select("rec_id", "idx", "text")


def w06_w07(spark, sf):
    return S.speaker_runs(words(spark, sf))


def w08(spark, sf):
    """Segments split into parts of one speaker each, from words that the speakers' join has labelled."""
    # parts are short: in narrow bins they meet fewer speakers
    labelled = I.labelled_parts(segments(spark, sf), speaker_segments(spark, sf), 8, PIECE_BIN_MS)
    runs = S.speaker_runs(labelled, keys=["rec_id", "seg"], short=True)
    return runs.select(F.concat_ws("/", "rec_id", "seg").alias("part_id"), *(c for c in runs.columns if c not in ("rec_id", "seg")))


def w09(spark, sf):
    at = F.col("start_ms") + F.col("rec_id") % 5 * 700 + 350
    return S.split_at(entries(spark, sf).where("text is not null"), at).withColumn("text", F.md5(F.col("text").cast("binary")))


def w10(spark, sf):
    f = read(spark, sf, "events").selectExpr("date_format(cast(ts as timestamp), 'yyyy-MM-dd') as rec_id", "event_id as idx", "unix_micros(cast(ts as timestamp)) div 1000 as ts_ms", "event_type = 'signup' as scene_cut", "array(cast(user_id % 4 as double) / 100, floor(value / 200) / 20) as features")
    return S.stable_runs(f).withColumn("features", F.array_join(F.transform("features", lambda x: F.format_number(x, 2)), "|"))


def w11(spark, sf):
    zero = words(spark, sf).withColumn("start_ms", F.floor(F.col("start_ms") / 900_000) * 900_000).withColumn("end_ms", F.when(F.col("idx") % 2 == 0, F.col("start_ms") + 500).otherwise(F.col("start_ms")))
    return S.repaired_words(zero.withColumn("start_ms", F.col("start_ms").cast("long"))).select("rec_id", "idx", F.col("end_ms").cast("long").alias("end_ms"))


def w12(spark, sf):
    return S.words_of_tokens(tokens(spark, sf)).withColumn("text", F.md5(F.col("text").cast("binary")))


def w13(spark, sf):
    t = tokens(spark, sf).withColumn("continuation", (F.col("idx") % 4 != 0) & (F.col("rec_id") % 2 == 0)).withColumn("text", F.trim("text"))
    return S.stitched(t).withColumn("text", F.md5(F.col("text").cast("binary")))


def w15(spark, sf):
    return S.first_seen(entries(spark, sf))


def a15(spark, sf):
    return S.stage_durations(progress(spark, sf))


def w17(spark, sf):
    """Local speakers of ten-minute windows stitched by cluster, clipped to their window, numbered by first appearance."""
    spk = speaker_segments(spark, sf).withColumns({"win": F.floor(F.col("start_ms") / 600_000), "local": F.substring("speaker_id", 2, 1).cast("int") % 4})
    clip = spk.withColumns({"start_ms": F.greatest("start_ms", F.col("win") * 600_000), "end_ms": F.least("end_ms", (F.col("win") + 1) * 600_000)}).where("end_ms - start_ms > 1")
    named = clip.withColumn("speaker_id", F.concat(F.lit("c"), F.col("local").cast("string"))).select("rec_id", "idx", "start_ms", "end_ms", "speaker_id")
    merged = I.adjacent(named, 20)
    firsts = named.groupBy("rec_id", "speaker_id").agg(F.min(F.struct("start_ms", "idx")).alias("f"))
    label = F.format_string("SPEAKER_%02d", F.row_number().over(Window.partitionBy("rec_id").orderBy("f")) - 1)
    return merged.join(firsts.select("rec_id", "speaker_id", label.alias("label")), ["rec_id", "speaker_id"]).drop("speaker_id")


def a35(spark, sf):
    return S.overloaded(speaker_segments(spark, sf), 3_600_000)


def l06(spark, sf):
    """The last three user and assistant turns with text of each conversation."""
    c = read(spark, sf, "conversations").where("role in ('user', 'assistant') and trim(text) <> ''")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("k", rank).where("k <= 3").select("conv_id", "turn", "role")


def l07(spark, sf):
    return S.budgeted_prefix(entries(spark, sf).where("text is not null"), 1500).select("rec_id", "idx", "used")


def a34(spark, sf):
    """Later speakers of one name point at the first."""
    s = read(spark, sf, "supplier").selectExpr("s_nationkey as rec_id", "s_suppkey as speaker", "concat('name', s_suppkey % 3) as name")
    w = Window.partitionBy("rec_id", "name").orderBy("speaker")
    return s.select("rec_id", F.col("speaker").alias("source"), F.first("speaker").over(w).alias("target")).where("source <> target")


def j22(spark, sf):
    """Speakers remapped in the first place and among the others, each named once."""
    e = entries(spark, sf).withColumn("extra", F.array(F.lit("B"), F.lit("user"), F.col("speaker_id"), F.lit("A")))
    to = lambda c: F.when(c == "user", F.lit("A")).otherwise(c)
    primary = to(F.col("speaker_id"))
    others = F.filter(F.array_distinct(F.transform(F.array_compact("extra"), to)), lambda x: ~x.eqNullSafe(primary))
    return e.select("rec_id", "idx", primary.alias("speaker_id"), F.array_join(others, ",").alias("extras"))


def p01(spark, sf):
    """Entries that a time window overlaps, and whether they lie in it."""
    e = entries(spark, sf).where((F.col("end_ms") > 10_000) & (F.col("start_ms") < 30_000))
    inside = (F.col("start_ms") >= 10_000) & (F.col("end_ms") <= 30_000)
    return e.select("rec_id", "idx", inside.alias("inside"), F.when(inside, "X").otherwise(F.col("speaker_id")).alias("speaker_id"))


def p13(spark, sf):
    """Names with a part of three letters or more among the words, whole or as a prefix with up to three letters more."""
    words = read(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("tok")).distinct()
    parts = read(spark, sf, "benchmark").selectExpr("item_id", "explode(array_distinct(regexp_extract_all(lower(text), '\\\\p{L}+', 0))) as part").where("length(part) >= 3")
    exact = parts.join(words, F.col("tok") == F.col("part"), "left_semi")
    long = parts.where("length(part) >= 4")
    # a prefix of each length that may match makes an equality of it
    prefixes = words.select("tok", F.explode(F.sequence(F.greatest(F.lit(4), F.length("tok") - 3), F.greatest(F.lit(4), F.length("tok")))).alias("n")).where("length(tok) >= n").select(F.expr("substr(tok, 1, n)").alias("pre")).distinct()
    begun = long.join(prefixes, F.col("pre") == F.col("part"), "left_semi")
    return exact.union(begun).distinct()


_SESSION = f"""WITH {ENT}, r AS (SELECT *, sum(CASE WHEN n > 1 AND p IS NOT DISTINCT FROM speaker_id THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY idx) AS run FROM (
    SELECT *, lag(speaker_id) OVER w AS p, row_number() OVER w AS n FROM ent WINDOW w AS (PARTITION BY rec_id ORDER BY idx))),
  g AS (SELECT *, sum(CASE WHEN start_ms - reach <= 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id, run ORDER BY idx) AS part FROM (
    SELECT *, max(end_ms) OVER (PARTITION BY rec_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r))
  SELECT rec_id, min(idx) AS idx, any_value(speaker_id) AS speaker_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
    trim(regexp_replace(string_agg(text, ' ' ORDER BY idx), '\\s+', ' ', 'g')) AS text, min(avg_logprob) AS avg_logprob, bool_or(overlap) AS overlap, count(*) AS n_entries FROM g GROUP BY rec_id, run, part"""
_RUNS = """a AS (SELECT rec_id, idx, start_ms, end_ms, coalesce(last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING),
      first_value(speaker_id IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s FROM {src}),
  b AS (SELECT *, sum(CASE WHEN n > 1 AND p IS NOT DISTINCT FROM s THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY idx) AS run FROM (SELECT *, lag(s) OVER w AS p, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY rec_id ORDER BY idx))),
  c AS (SELECT rec_id, run, any_value(s) AS s, min(idx) AS idx, max(idx) AS last_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM b GROUP BY rec_id, run),
  d AS (SELECT *, end_ms - start_ms >= 400 OR (end_ms - start_ms <= 0 AND n >= 2) AS real FROM c),
  e AS (SELECT *, CASE WHEN NOT bool_or(real) OVER (PARTITION BY rec_id) THEN first_value(s IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      ELSE coalesce(last_value(CASE WHEN real THEN s END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN real THEN s END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS sp FROM d),
  f AS (SELECT *, sum(CASE WHEN m > 1 AND p IS NOT DISTINCT FROM sp THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY idx) AS k FROM (SELECT *, lag(sp) OVER w AS p, row_number() OVER w AS m FROM e WINDOW w AS (PARTITION BY rec_id ORDER BY idx)))
  SELECT rec_id{name}, any_value(sp) AS speaker_id, min(idx) AS idx, max(last_idx) AS last_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, sum(n)::BIGINT AS n_words FROM f GROUP BY rec_id, k"""

QUERIES = {
    "w01_sessionize": w01, "w02_trim_overlaps": w02, "w03_context_fill": w03, "w04_exact_repeats": w04_exact, "w04_fuzzy_repeats": w04_fuzzy, "w05_noise_runs": w05,
    "w06_w07_speaker_runs": w06_w07, "w08_split_at_speaker_change": w08, "w09_split_at_time": w09, "w10_stable_runs": w10, "w11_zero_durations": w11, "w12_tokens_to_words": w12,
    "w13_stitch_words": w13, "w15_first_seen_numbers": w15, "a15_w16_stage_timing": a15, "w17_label_stitching": w17, "a35_overloaded_windows": a35, "l06_history_tail": l06,
    "l07_budgeted_prefix": l07, "a34_same_name_pairs": a34, "j22_speaker_remap": j22, "p01_time_window": p01, "p13_participants": p13,
}
ORACLES = {
    "w01_sessionize": _SESSION,
    "w02_trim_overlaps": f"WITH {ENT} SELECT rec_id, idx, start_ms, CASE WHEN end_ms > n AND n > start_ms AND NOT overlap AND NOT o THEN n ELSE end_ms END AS end_ms FROM (SELECT *, lead(start_ms) OVER w AS n, lead(overlap) OVER w AS o FROM ent WINDOW w AS (PARTITION BY rec_id ORDER BY idx))",
    "w06_w07_speaker_runs": f"WITH {SPK}, {WORDS}, " + _RUNS.format(src="wd", name=""),
    "w10_stable_runs": f"""WITH {FRAMES}, r AS (SELECT *, sum(CASE WHEN scene_cut OR pf IS NULL OR greatest(abs(features[1] - pf[1]), abs(features[2] - pf[2])) > 0.06 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY ts_ms) AS run FROM (SELECT *, lag(features) OVER (PARTITION BY rec_id ORDER BY ts_ms) AS pf FROM fr)),
        g AS (SELECT rec_id, run, min(ts_ms) AS start_ms, max(ts_ms) AS last_ms, arg_max(features, ts_ms) AS features FROM r GROUP BY rec_id, run),
        n AS (SELECT *, lead(start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms) AS end_ms FROM g)
        SELECT rec_id, start_ms, last_ms, printf('%.2f', features[1]) || '|' || printf('%.2f', features[2]) AS features, end_ms FROM n WHERE last_ms - start_ms >= 1500""",
    "w12_tokens_to_words": f"""WITH {TOKENS}, k AS (SELECT * FROM tk WHERE trim(text) <> ''), w AS (SELECT *, sum(CASE WHEN starts_with(text, ' ') OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY idx) AS w FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS n FROM k))
        SELECT rec_id, min(idx) AS idx, md5(string_agg(trim(text, ' '), '' ORDER BY idx)) AS text, arg_min(start_ms, idx) AS start_ms, greatest(max(end_ms), arg_min(start_ms, idx)) AS end_ms, min(CASE WHEN p > 0 AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN p END) AS probability, arg_min(NOT starts_with(text, ' '), idx) AS continuation FROM w GROUP BY rec_id, w""",
    "w13_stitch_words": f"""WITH {TOKENS}, c AS (SELECT *, idx % 4 <> 0 AND rec_id % 2 = 0 AS continuation, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS n FROM tk), w AS (SELECT *, sum(CASE WHEN NOT continuation OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY idx) AS w FROM c)
        SELECT rec_id, min(idx) AS idx, md5(string_agg(trim(text, ' '), '' ORDER BY idx)) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM w GROUP BY rec_id, w""",
    "w15_first_seen_numbers": f"WITH {ENT} SELECT rec_id, speaker_id, min(idx) AS first_idx, row_number() OVER (PARTITION BY rec_id ORDER BY min(idx)) AS number FROM ent WHERE speaker_id IS NOT NULL GROUP BY rec_id, speaker_id",
    "a15_w16_stage_timing": f"""WITH {PROGRESS}, r AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM stage THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS run FROM (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts_ms, seq) AS p FROM pg)),
        g AS (SELECT job_id, run, any_value(stage) AS stage, min(ts_ms) AS start_ms, bool_or(cached) AS cached FROM r GROUP BY job_id, run), d AS (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms, run) - start_ms AS duration_ms FROM g)
        SELECT job_id, stage, start_ms, cached, duration_ms FROM d WHERE stage <> 'done' AND duration_ms IS NOT NULL""",
    "a35_overloaded_windows": f"""WITH {SPK}, c AS (SELECT *, start_ms // 3600000 AS win, CASE WHEN lag(speaker_id) OVER (PARTITION BY rec_id, start_ms // 3600000 ORDER BY start_ms, end_ms, idx) <> speaker_id THEN 1 ELSE 0 END AS ch FROM spk),
        g AS (SELECT rec_id, win, count(DISTINCT speaker_id) AS speakers, count(*) AS n, sum(ch) AS ch FROM c GROUP BY ALL) SELECT rec_id, win, speakers, n, speakers >= 4 AND n >= 10 AND ch / (n - 1) >= 0.7 AS overloaded FROM g""",
    "l06_history_tail": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE k <= 3",
    "l07_budgeted_prefix": f"WITH {ENT} SELECT rec_id, idx, used FROM (SELECT *, sum(length(text) + 1) OVER w AS used, row_number() OVER w AS n FROM ent WHERE text IS NOT NULL WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) WHERE used <= 1500 OR n = 1",
    "a34_same_name_pairs": "SELECT * FROM (SELECT s_nationkey AS rec_id, s_suppkey AS source, first_value(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3 ORDER BY s_suppkey) AS target FROM supplier) WHERE source <> target",
    "j22_speaker_remap": f"WITH {ENT}, m AS (SELECT rec_id, idx, CASE WHEN speaker_id = 'user' THEN 'A' ELSE speaker_id END AS s FROM ent) SELECT rec_id, idx, s AS speaker_id, CASE WHEN s IS NULL THEN 'B,A' WHEN s = 'A' THEN 'B' WHEN s = 'B' THEN 'A' ELSE 'B,A' END AS extras FROM m",
    "p01_time_window": f"WITH {ENT} SELECT rec_id, idx, start_ms >= 10000 AND end_ms <= 30000 AS inside, CASE WHEN start_ms >= 10000 AND end_ms <= 30000 THEN 'X' ELSE speaker_id END AS speaker_id FROM ent WHERE end_ms > 10000 AND start_ms < 30000",
    "p13_participants": r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS tok FROM documents), p AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS part FROM benchmark), d AS (SELECT DISTINCT part FROM p WHERE length(part) >= 3), ok AS (SELECT part FROM d WHERE EXISTS (SELECT 1 FROM w WHERE tok = part OR (length(part) >= 4 AND starts_with(tok, part) AND length(tok) - length(part) <= 3))) SELECT item_id, part FROM p WHERE part IN (SELECT part FROM ok)",
}
