"""Queries over speaker edits, terms, signals and slides, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.functions.text import levenshtein_ratio, splice_terms
from parlance.operators import chunking as C
from parlance.operators import intervals as I
from parlance.operators import sequences as S
from parlance.operators import similarity as M
from parlance.plans.inputs import ENT, SEG, SPK, entries, read, segments, speaker_segments
from parlance.streaming.live import overlap_add

_SELECTED = "(rec_id + idx) % 4 = 0"


def _with_extras(spark, sf):
    return entries(spark, sf).withColumn("extra", F.expr("case when (rec_id + idx) % 3 = 0 then array('B', 'T') else cast(array() as array<string>) end"))


def p16(spark, sf):
    """Chosen entries get speaker T: as their first, and then not among the others."""
    e = _with_extras(spark, sf)
    hit = F.expr(_SELECTED)
    speaker = F.when(hit, F.lit("T")).otherwise(F.col("speaker_id"))
    extra = F.when(hit, F.array_remove("extra", "T")).otherwise(F.col("extra"))
    changed = ~(speaker.eqNullSafe(F.col("speaker_id")) & (extra == F.col("extra")))
    return e.select("rec_id", "idx", speaker.alias("speaker_id"), F.array_join(extra, ",").alias("extras"), changed.alias("changed"))


def p17(spark, sf):
    """Chosen entries get T as a further speaker, others lose B; the overlap flag follows."""
    e = _with_extras(spark, sf)
    hit = F.expr(_SELECTED)
    extra = F.when(hit, F.array_union("extra", F.array(F.lit("T")))).otherwise(F.array_remove("extra", "B"))
    return e.select("rec_id", "idx", F.array_join(extra, ",").alias("extras"), F.when(hit, F.lit(True)).when(F.size(extra) == 0, F.lit(False)).otherwise(F.col("overlap")).alias("overlap"))


def p15(spark, sf):
    """Whether a segment's energy reaches a quarter of its day's median."""
    e = segments(spark, sf).withColumn("energy", F.pow((F.col("end_ms") - F.col("start_ms")) / 1000, F.lit(2.0)))
    m = e.groupBy("rec_id").agg(F.median("energy").alias("m"))
    return e.join(m, "rec_id").select("rec_id", "idx", (F.col("energy") >= F.greatest(F.lit(1e-8), 0.25 * F.col("m"))).alias("speech"))


def a24(spark, sf):
    """Per user, the first window of ten events in a row with the most energy."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf, "events").select("user_id", "event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(w.rowsBetween(0, 9)).alias("sum"), F.row_number().over(w).alias("n"), F.count("*").over(Window.partitionBy("user_id")).alias("all"))
    return e.where(F.col("n") <= F.col("all") - 9).groupBy("user_id").agg(F.max_by("event_id", F.struct("sum", -F.col("event_id"))).alias("event_id"), F.max("sum").cast("double").alias("energy"))


def a25(spark, sf):
    """The run of loud values around each user's loudest one, that two quiet values or more end."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("idx"), "value")
    e = e.withColumn("n", F.row_number().over(S.by_idx())).withColumn("loud", F.col("value") >= 20)
    loud = e.where("loud").withColumn("run", F.sum(F.when(F.col("n") - F.lag("n").over(S.by_idx()) <= 2, 0).otherwise(1)).over(S.up_to()))
    peak = loud.groupBy("rec_id").agg(F.max_by("run", F.struct("value", -F.col("idx"))).alias("run"))
    return loud.join(peak, ["rec_id", "run"]).groupBy("rec_id").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_loud"))


def a37(spark, sf):
    """Level, peak and flags of each user's values as a recording."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("value").alias("peak"), F.avg((F.col("value") > 10).cast("int")).alias("speech"), F.count("*").alias("n"))
    level = 20 * F.log10(F.col("rms") / 500)
    return e.select("user_id", F.round(level, 4).alias("dbfs"), F.round("peak", 2).alias("peak"), (level < -15).alias("too_quiet"), (F.col("peak") >= 450).alias("clipped"), (F.col("speech") < 0.8).alias("sparse"), (F.col("n") < 60).alias("short"))


def f20(spark, sf):
    """Pairs of word and term that differ as spellings do: long, one edit at most, near in length and ratio."""
    p = read(spark, sf, "customer").select("c_custkey", F.lower("c_name").alias("word"), F.lower(F.concat(F.substring("c_name", 1, 12), F.lit("x"), F.substring("c_name", 14, 30))).alias("form"))
    delta = F.abs(F.length("word") - F.length("form"))
    ok = (F.length("word") >= 6) & (F.levenshtein("word", "form") <= 1) & (delta <= F.greatest(F.lit(2), F.floor(F.length("word") / 5))) & (levenshtein_ratio(F.col("word"), F.col("form")) >= 0.93)
    return p.select("c_custkey", ok.alias("spelling"))


_TERMS = {"licensed under": "LICENSED UNDER", "license": "LICENCE", "under the": "UNDER THE", "the": "THE", "of the": "OF THE"}


def f32(spark, sf):
    """Terms replaced from a map in one pass, longest first, whatever their case."""
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(splice_terms(F.col("text"), _TERMS).cast("binary")).alias("spliced"))


def f33(spark, sf):
    """Each user's values as samples, in chunks of fifty that overlap by ten, every second one twice as loud, faded into each other."""
    w = Window.partitionBy("user_id")
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("value"), (F.row_number().over(w.orderBy("event_id")) - 1).alias("place"), F.count("*").over(w).alias("total"))
    e = e.withColumn("most", F.greatest(F.lit(0), F.ceil((F.col("total") - 50) / 40)))
    own = F.floor(F.col("place") / 40)
    s = e.withColumn("chunk", F.explode(F.array(own, own - 1))).withColumn("at", F.col("chunk") * 40).withColumn("pos", F.col("place") - F.col("at"))
    s = s.where("chunk between 0 and most and pos < 50").withColumns({"n": F.least(F.lit(50), F.col("total") - F.col("at")), "last": F.col("chunk") == F.col("most"), "x": F.col("value") * (1 + F.col("chunk") % 2)})
    return overlap_add(s, 10).withColumn("x", F.round("x", 4))


def f34(spark, sf):
    """Events of a day at a tenth of their value where another speaker's interval mutes them."""
    seg = segments(spark, sf).withColumn("at_ms", F.col("start_ms"))
    mute = speaker_segments(spark, sf).where("speaker_id = 'U3'")
    hit = I.containing(seg.select("rec_id", "idx", "at_ms"), mute)
    return seg.select("rec_id", "idx", "end_ms", "start_ms").join(hit, ["rec_id", "idx"]).select("rec_id", "idx", F.round((F.col("end_ms") - F.col("start_ms")) * F.when(F.col("span_idx").isNull(), 1.0).otherwise(0.1), 3).alias("value"))


def f28(spark, sf):
    """Log-band means of the spectrum of each vector, centred and of unit length."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def bands(values: pd.Series) -> pd.Series:
        power = np.abs(np.fft.rfft(np.stack(values).astype(float) * np.hanning(len(values.iloc[0])), axis=1)) ** 2
        edges = np.unique(np.geomspace(1, power.shape[1], 9).astype(int))
        means = np.stack([np.log(power[:, a:b].mean(axis=1) + 1e-9) for a, b in zip(edges, edges[1:])], axis=1)
        means -= means.mean(axis=1, keepdims=True)
        return pd.Series(list(means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)))

    v = read(spark, sf, "embeddings").where("embedding is not null")
    return v.select("vec_id", F.array_join(F.transform(bands("embedding"), lambda x: F.round(x, 4)), " ").alias("fingerprint"))


def l04(spark, sf):
    """The three longest segments of each speaker and day that no longer one of theirs overlaps."""
    s = speaker_segments(spark, sf).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    left = s.select(F.concat_ws("/", "rec_id", "speaker_id").alias("rec_id"), "idx", "start_ms", "end_ms", "ms")
    right = left.select("rec_id", F.col("idx").alias("r_idx"), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.col("ms").alias("r_ms"))
    longer = (F.col("r_ms") > F.col("ms")) | ((F.col("r_ms") == F.col("ms")) & (F.col("r_idx") < F.col("idx")))
    covered = I.overlap_join(left, right, ["rec_id"]).where(longer).select("rec_id", "idx").distinct()
    return M.top_rows(left.join(covered, ["rec_id", "idx"], "left_anti"), ["rec_id"], [F.desc("ms"), F.col("start_ms")], 3).select(F.col("rec_id").alias("track"), "idx", "ms")


def u10(spark, sf):
    """Samples of one voice moved to another with the next free numbers."""
    f = read(spark, sf, "supplier").selectExpr("s_nationkey as name", "s_suppkey as sample").withColumn("number", F.row_number().over(Window.partitionBy("name").orderBy("sample")))
    most = f.where("name <> 3").groupBy("name").agg(F.max("number").alias("most")).where("name = 4").select("most")
    moved = f.where("name = 3").crossJoin(F.broadcast(most)).select(F.lit(4).cast("bigint").alias("name"), "sample", (F.col("number") + F.col("most")).alias("number"))
    return f.where("name <> 3").select(F.col("name").cast("bigint").alias("name"), "sample", F.col("number").cast("bigint").alias("number")).unionByName(moved.withColumn("number", F.col("number").cast("bigint")))


def c06(spark, sf):
    """Names of each size from a rotated start, while they fit."""
    t = read(spark, sf, "part").selectExpr("p_size as rec_id", "pmod(p_partkey - p_size * 7, 2000) as pos", "p_name as term")
    return C.fitting_prefix(t, 80, 1).select("rec_id", F.size("kept").alias("n"))


def x08(spark, sf):
    """First name for each speaker over ordered chunks, every name used once among fifty users."""
    rows = read(spark, sf, "events").selectExpr("user_id div 50 as group", "event_id as chunk", "user_id as speaker", "concat('n', cast(floor(value) as int) % 40) as name")
    return S.first_names(rows)


_WHOLE = r"(?i)\b(?:" + "|".join(sorted(_TERMS, key=len, reverse=True)) + r")\b"
OVERLAP_ADD = """WITH e AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events),
    m AS (SELECT *, greatest(0, ceil((total - 50) / 40))::BIGINT AS most, unnest([place // 40, place // 40 - 1]) AS chunk FROM e), s AS (SELECT *, place - chunk * 40 AS pos, least(50, total - chunk * 40) AS n FROM m)
    SELECT key, place, round(sum(value * (1 + chunk % 2) * CASE WHEN chunk > 0 AND pos < 10 THEN (pos + 0.5) / 10 ELSE 1 END * CASE WHEN chunk < most AND n - pos <= 10 THEN (n - pos - 0.5) / 10 ELSE 1 END), 4) AS x
    FROM s WHERE chunk BETWEEN 0 AND most AND pos < 50 GROUP BY key, place"""

QUERIES = {
    "p15_speech_mask": p15, "p16_speaker_assign": p16, "p17_co_speakers": p17, "a24_best_energy_window": a24, "a25_speech_window": a25, "a37_recording_quality": a37, "f20_spelling_form": f20,
    "f28_fingerprint": f28, "f32_term_splice": f32, "f33_overlap_add": f33, "f34_attenuation": f34, "l04_top_without_overlap": l04, "u10_voice_merge": u10, "c06_rotating_block": c06,
    "x08_first_names": x08,
}
ORACLES = {
    "p15_speech_mask": f"WITH {SEG}, e AS (SELECT *, pow((end_ms - start_ms) / 1000, 2) AS en FROM seg), m AS (SELECT rec_id, median(en) AS m FROM e GROUP BY 1) SELECT rec_id, idx, en >= greatest(1e-8, 0.25 * m) AS speech FROM e JOIN m USING (rec_id)",
    "p16_speaker_assign": f"WITH {ENT}, x AS (SELECT *, (rec_id + idx) % 3 = 0 AS has, {_SELECTED} AS hit FROM ent) SELECT rec_id, idx, CASE WHEN hit THEN 'T' ELSE speaker_id END AS speaker_id, CASE WHEN NOT has THEN '' WHEN hit THEN 'B' ELSE 'B,T' END AS extras, hit AND (speaker_id IS DISTINCT FROM 'T' OR has) AS changed FROM x",
    "p17_co_speakers": f"WITH {ENT}, x AS (SELECT *, (rec_id + idx) % 3 = 0 AS has, {_SELECTED} AS hit FROM ent) SELECT rec_id, idx, CASE WHEN hit AND has THEN 'B,T' WHEN hit THEN 'T' WHEN has THEN 'T' ELSE '' END AS extras, CASE WHEN hit THEN true WHEN NOT has THEN false ELSE overlap END AS overlap FROM x",
    "a24_best_energy_window": "WITH w AS (SELECT user_id, event_id, sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, arg_max(event_id, (s, -event_id)) AS event_id, max(s)::DOUBLE AS energy FROM w WHERE n <= c - 9 GROUP BY 1",
    "a25_speech_window": "WITH e AS (SELECT user_id AS rec_id, event_id AS idx, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), l AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY rec_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS new FROM e WHERE value >= 20), r AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY idx) AS run FROM l), p AS (SELECT rec_id, arg_max(run, (value, -idx)) AS run FROM r GROUP BY 1) SELECT rec_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_loud FROM r JOIN p USING (rec_id, run) GROUP BY 1",
    "a37_recording_quality": "WITH q AS (SELECT user_id, 20 * log10(sqrt(avg(value * value)) / 500) AS l, max(value) AS p, avg(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS s, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(l, 4) AS dbfs, round(p, 2) AS peak, l < -15 AS too_quiet, p >= 450 AS clipped, s < 0.8 AS sparse, n < 60 AS short FROM q",
    "f20_spelling_form": "WITH p AS (SELECT c_custkey, lower(c_name) AS w, lower(substr(c_name, 1, 12) || 'x' || substr(c_name, 14, 30)) AS f FROM customer) SELECT c_custkey, length(w) >= 6 AND levenshtein(w, f) <= 1 AND abs(length(w) - length(f)) <= greatest(2, length(w) // 5) AND 1 - levenshtein(w, f) / greatest(length(w), length(f)) >= 0.93 AS spelling FROM p",
    "f32_term_splice": rf"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_WHOLE}') AS g, regexp_extract_all(text, '{_WHOLE}') AS m FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE lower(m[i]) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _TERMS.items())} END, '')), '')) AS spliced FROM p""",
    "f33_overlap_add": OVERLAP_ADD,
    "f34_attenuation": f"WITH {SEG}, {SPK} SELECT s.rec_id, s.idx, round((s.end_ms - s.start_ms) * CASE WHEN EXISTS (SELECT 1 FROM spk p WHERE p.rec_id = s.rec_id AND p.speaker_id = 'U3' AND s.start_ms BETWEEN p.start_ms AND p.end_ms) THEN 0.1 ELSE 1.0 END, 3)::DOUBLE AS value FROM seg s",
    "l04_top_without_overlap": f"WITH {SPK}, s AS (SELECT rec_id || '/' || speaker_id AS track, idx, start_ms, end_ms, end_ms - start_ms AS ms FROM spk), f AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.track = s.track AND least(o.end_ms, s.end_ms) > greatest(o.start_ms, s.start_ms) AND (o.ms > s.ms OR (o.ms = s.ms AND o.idx < s.idx)))) SELECT track, idx, ms FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ms DESC, start_ms) AS k FROM f) WHERE k <= 3",
    "u10_voice_merge": "WITH f AS (SELECT s_nationkey AS name, s_suppkey AS sample, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS number FROM supplier) SELECT name, sample, number FROM f WHERE name <> 3 UNION ALL SELECT 4, sample, number + (SELECT max(number) FROM f WHERE name = 4) FROM f WHERE name = 3 AND (SELECT max(number) FROM f WHERE name = 4) IS NOT NULL",
}
