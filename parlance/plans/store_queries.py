"""Queries over stores, search and statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parlance.operators import store as S
from parlance.plans.inputs import ENT, JOB, STAGE, entries, jobs, read, stage_times

_RUNNING = "run AS (SELECT id, status, CASE id % 8 WHEN 0 THEN 'denoise' WHEN 1 THEN 'asr' WHEN 2 THEN 'diarization' WHEN 3 THEN 'merge' WHEN 4 THEN 'clean' WHEN 5 THEN 'correction' WHEN 6 THEN 'llm' ELSE 'export' END AS stage, (id % 10)::DOUBLE / 10 AS fraction, duration FROM job)"
_PROFILE = f"""fresh AS (SELECT stage, greatest(median(greatest(seconds, 0) / duration), 1e-6) AS fresh, count(*) AS samples FROM stg JOIN job ON job.id = stg.job_id WHERE NOT cached AND status = 'done' AND duration > 0 AND stage IN {S.STAGES} GROUP BY stage),
  prof AS (SELECT stage, coalesce(fresh, (SELECT median(fresh) FROM fresh)) AS weight, coalesce(samples, 0) AS samples, place FROM (SELECT unnest({list(S.STAGES)}) AS stage, unnest(range(8)) AS place) LEFT JOIN fresh USING (stage))"""


def _running(spark, sf):
    names = " ".join(f"when {i} then '{s}'" for i, s in enumerate(S.STAGES))
    return jobs(spark, sf).selectExpr("id", "status", f"case id % 8 {names} end as stage", "cast(id % 10 as double) / 10 as fraction", "duration")


def a10(spark, sf):
    return S.profile(jobs(spark, sf), stage_times(spark, sf)).withColumn("weight", F.round("weight", 9))


def a11_a12(spark, sf):
    out = S.progress_and_eta(_running(spark, sf), S.profile(jobs(spark, sf), stage_times(spark, sf)))
    return out.withColumn("eta_seconds", F.round("eta_seconds", 4))


def a13(spark, sf):
    return S.estimate(jobs(spark, sf).select("id", "duration"), S.profile(jobs(spark, sf), stage_times(spark, sf)), ["asr", "merge", "correction"]).withColumn("seconds", F.round("seconds", 4))


def a14(spark, sf):
    j = jobs(spark, sf).selectExpr("id", "status", "id % 7 <> 0 as active", "cast(id % 400 as double) as since_update", "cast(id % 300 as double) as elapsed", "case when id % 5 = 0 then null else cast(id % 90 as double) end as expected", "cast(id % 10 as double) / 10 as fraction")
    return S.health(j)


def a36(spark, sf):
    c = read(spark, sf, "orders").selectExpr("o_custkey as cache", "o_orderkey as key", "unix_seconds(cast(o_orderdate as timestamp)) as mtime", "cast(o_totalprice as bigint) as size")
    return S.evict(c, F.lit(915148800), 86400 * 1500, 600_000)


def j01(spark, sf):
    """Enabled terms with their source, or without one, each once by its folded form."""
    s = read(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_acctbal > 0 as enabled")
    p = read(spark, sf, "part").selectExpr("p_partkey as pos", "p_name as canonical", "case when p_partkey % 4 = 0 then null else p_partkey % 100 end as source_id")
    rows = p.join(s, F.col("source_id") == s.id, "left").where("enabled or source_id is null")
    first = F.row_number().over(Window.partitionBy(F.lower("canonical")).orderBy("pos"))
    return rows.withColumn("n", first).where("n = 1").select("pos", "canonical", "source_id")


def j02(spark, sf):
    n, s = read(spark, sf, "nation"), read(spark, sf, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("n_entries"))


def t02(spark, sf):
    return S.contains_all(entries(spark, sf), ["tion", "the"]).select("rec_id", "idx")


def j23(spark, sf):
    """Search hits with the names of their job and archive record."""
    hits = S.contains_all(read(spark, sf, "documents"), ["licensed"]).selectExpr("doc_id", "doc_id % 100 as s", "doc_id % 25 as n")
    sup, nat = read(spark, sf, "supplier"), read(spark, sf, "nation")
    return hits.join(sup, hits.s == sup.s_suppkey, "left").join(nat, hits.n == nat.n_nationkey, "left").select("doc_id", "s_name", "n_name")


def a01(spark, sf):
    return read(spark, sf, "part").agg(F.count("*").alias("entries"), F.count_if(F.col("p_size") > 25).alias("enabled"), F.count_distinct("p_brand").alias("sources"))


def a02(spark, sf):
    return entries(spark, sf).where("speaker_id <> ''").select("speaker_id").distinct().orderBy("speaker_id")


def a16_a18(spark, sf):
    """Exact duplicates by digest, a row for each, with the one to keep: the most common source, then the smallest id.

    Groups are counted before they meet, by digest and source, so a group of any size costs no task its rows.
    """
    d = read(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    by_source = d.groupBy("digest", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    g = by_source.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("minus"), "first")).alias("k")).where("n > 1")
    return d.join(g, "digest").select("doc_id", "digest", "n", F.col("k.first").alias("keep"))


def a33(spark, sf):
    s = read(spark, sf, "supplier").selectExpr("s_nationkey as rec_id", "format_string('SPEAKER_%02d', s_suppkey % 17) as speaker")
    return s.groupBy("rec_id").agg(F.format_string("SPEAKER_%02d", F.max(F.regexp_extract("speaker", r"(\d+)$", 1).cast("int")) + 1).alias("next_id"))


def a38(spark, sf):
    """The first 60 units of each owner's jobs, in time order, the last one cut to fit."""
    t = stage_times(spark, sf).where("seconds >= 0.5")
    w = Window.partitionBy("worker", "stage").orderBy("job_id", "pos", "seconds")
    used = F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return t.withColumn("used", used).where("used < 60").groupBy("worker", "stage").agg(F.sum(F.least("seconds", F.lit(60.0) - F.col("used"))).alias("taken"), F.count("*").alias("n"))


def a39(spark, sf):
    new = read(spark, sf, "part").selectExpr("p_partkey as pos", "case when p_partkey % 50 = 0 then '' else p_name end as canonical", "p_type as variant")
    old = read(spark, sf, "part").where("p_partkey % 10 = 0").selectExpr("upper(p_name) as canonical", "p_type as variant")
    return S.import_report(new, old)


def a41(spark, sf):
    return entries(spark, sf).groupBy("rec_id").agg(F.count("*").alias("n_entries"), F.count_distinct("speaker_id").alias("n_speakers"), F.sum(F.length("text")).alias("n_chars"))


def l01(spark, sf):
    o = read(spark, sf, "orders").withColumn("meeting", F.expr("case when o_orderkey % 6 = 0 then null else date_format(o_orderdate, 'yyyy-MM-dd') end"))
    top = o.orderBy(F.coalesce("meeting", F.lit("")).desc(), F.desc("o_totalprice"), "o_orderkey")
    return top.select("o_orderkey", "meeting")


def l02(spark, sf):
    """The third page of fifty parts, with the total."""
    p = read(spark, sf, "part").where("p_size > 10")
    total = p.agg(F.count("*").alias("total"))
    return p.orderBy("p_name", "p_partkey").offset(100).limit(50).select("p_partkey", "p_name").crossJoin(F.broadcast(total))


def l03(spark, sf):
    """The ten longest segments of half a second or more for each user, longest first, then earliest."""
    e = read(spark, sf, "events").selectExpr("user_id", "event_id", "cast(floor(value * 1000) as bigint) as ms").where("ms >= 500")
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ms"), "event_id"))).where("rank <= 10")


def l09(spark, sf):
    return read(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("created"))


def p09(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.expr("case when o_orderkey % 8 = 0 then 'unknown' else date_format(o_orderdate, 'yyyy-MM-dd') end").alias("said"))
    return o.where(F.expr("try_to_date(said, 'yyyy-MM-dd')").between("1996-01-01", "1996-12-31")).select("o_orderkey")


def p10(spark, sf):
    o = read(spark, sf, "orders").withColumn("deleted_at", F.expr("case when o_orderstatus = 'F' then o_orderdate end"))
    return o.where("deleted_at is null").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey")


def u01(spark, sf):
    """Two lists in order, the first occurrence kept."""
    p = read(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.lit(0).alias("part")).where("pos % 2 = 0")
    q = read(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.lit(1).alias("part"))
    return p.unionByName(q).groupBy("name").agg(F.min(F.struct("part", "pos")).alias("f")).select("name", F.col("f.part").alias("part"), F.col("f.pos").alias("pos"))


def u02(spark, sf):
    """Brands and sizes of all parts less those of every third part, as a multiset."""
    p = read(spark, sf, "part")
    return p.select("p_brand", "p_size").exceptAll(p.where("p_partkey % 3 = 0").select("p_brand", "p_size"))


def u03(spark, sf):
    """Jaccard of the words of neighbouring turns."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    c = entries(spark, sf).where("text is not null").select("rec_id", "idx", words.alias("w"))
    n = c.select("rec_id", (F.col("idx") - 1).alias("idx"), F.col("w").alias("v"))
    j = F.when((F.size("w") == 0) & (F.size("v") == 0), 1.0).otherwise(F.size(F.array_intersect("w", "v")) / F.size(F.array_union("w", "v")))
    return c.join(n, ["rec_id", "idx"]).select("rec_id", "idx", F.round(j, 6).alias("jaccard"))


def u05(spark, sf):
    old = read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = read(spark, sf, "supplier").selectExpr("s_suppkey + 50 as s_suppkey", "case when s_suppkey % 2 = 0 then concat('new ', s_name) end as s_name", "s_acctbal * 2 as s_acctbal")
    return S.upsert(old, new, ["s_suppkey"])


def _cascade(spark, sf, cascade):
    n = read(spark, sf, "nation").selectExpr("n_nationkey as id", "n_name")
    e = read(spark, sf, "supplier").selectExpr("s_suppkey", "s_nationkey as source_id")
    return S.delete_source(n, e, n.where("id % 5 = 0").select("id"), cascade)[1].select("s_suppkey", "source_id")


def u06(spark, sf):
    return _cascade(spark, sf, True)


def u06_null(spark, sf):
    return _cascade(spark, sf, False)


def u07(spark, sf):
    o = read(spark, sf, "orders").selectExpr("o_orderkey", "case when o_orderkey % 4 = 0 then cast(o_orderdate as date) end as deleted_at")
    return o.withColumn("deleted_at", F.when(F.col("o_orderkey") % 3 == 0, F.coalesce("deleted_at", F.lit("2024-01-01").cast("date"))).when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("deleted_at")))


def u08(spark, sf):
    """Insert names that are not there, and the active one, or else the first."""
    old = read(spark, sf, "part").where("p_partkey % 2 = 0").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    seed = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    every = old.unionByName(seed.join(old, "p_name", "left_anti"))
    active = every.where("id > 0").agg(F.min("id").alias("first"))
    return every.crossJoin(F.broadcast(active)).select("p_name", "id", (F.col("id") == F.col("first")).alias("active"))


def u09(spark, sf):
    e = entries(spark, sf).withColumn("original_text", F.when(F.col("idx") % 6 == 0, F.lit("first")))
    edits = e.where("idx % 3 = 0").select("rec_id", "idx", F.concat(F.lit("edited "), F.col("idx").cast("string")).alias("text"))
    return S.overlay(e, edits, e.where("idx % 4 = 0").select("rec_id", "idx"))


def u11(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    c = p.where("p_partkey % 3 = 0").selectExpr("p_partkey", "case when p_partkey % 2 = 0 then ' new ' end as p_name", "case when p_partkey % 5 = 0 then '' end as p_type")
    return S.patch(p, c, "p_partkey", ["p_name", "p_type"])


def j12(spark, sf):
    """Edits carried over by start and end; of repeated keys the last wins."""
    e = entries(spark, sf)
    old = read(spark, sf, "conversations").selectExpr("conv_id as rec_id", "turn as idx").where("idx % 2 = 0")
    old = e.join(old, ["rec_id", "idx"], "left_semi").select("rec_id", "start_ms", "end_ms", "idx", F.concat(F.lit("was "), F.col("idx").cast("string")).alias("old_text"))
    last = old.groupBy("rec_id", "start_ms", "end_ms").agg(F.max_by("old_text", "idx").alias("old_text"))
    return e.join(last, ["rec_id", "start_ms", "end_ms"], "left").select("rec_id", "idx", F.coalesce("old_text", F.lit("")).alias("carried"))


def j19(spark, sf):
    """Aliases replaced word by word from a lookup table."""
    words = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    alias = read(spark, sf, "benchmark").where("text is not null").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("alias")).where("length(alias) >= 6").distinct()
    hit = words.join(alias, F.lower("word") == F.col("alias"), "left")
    return hit.where("alias is not null").groupBy("doc_id").agg(F.count("*").alias("n_replaced"))


def j20(spark, sf):
    """Cited numbers in first-seen order, joined to the entries they name."""
    answers = read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("rec_id"), F.expr("concat('so [', conv_id % 4, ', ', conv_id % 3, '] and [', conv_id % 4, ', 99]')").alias("answer"))
    numbers = F.flatten(F.transform(F.regexp_extract_all("answer", F.lit(r"\[([\d,\s]+)\]"), F.lit(1)), lambda m: F.split(m, r"\s*,\s*")))
    cited = answers.select("rec_id", F.posexplode(numbers).alias("pos", "k")).groupBy("rec_id", F.col("k").cast("long").alias("idx")).agg(F.min("pos").alias("pos"))
    e = entries(spark, sf).select("rec_id", "idx", "speaker_id")
    return cited.join(e, ["rec_id", "idx"])


def k02(spark, sf):
    from parlance.sources.exports import srt_cues

    return srt_cues(entries(spark, sf)).withColumn("cue", F.md5(F.col("cue").cast("binary")))


def k04(spark, sf):
    from parlance.sources.exports import text_lines

    return text_lines(entries(spark, sf)).withColumn("line", F.md5(F.col("line").cast("binary")))


def k01(spark, sf):
    from parlance.sources.exports import json_documents

    doc = json_documents(entries(spark, sf))
    back = F.from_json("document", "rec_id bigint, entries array<struct<start:double,end:double,text:string,speaker:string>>")
    return doc.select("rec_id", back.alias("d")).select("rec_id", F.size("d.entries").alias("n"), F.round(F.aggregate("d.entries", F.lit(0.0), lambda a, x: a + x["end"]), 3).alias("ends"))


def k06(spark, sf):
    from parlance.sources.exports import timeline_lines

    return timeline_lines(entries(spark, sf))


def k11(spark, sf):
    """Suggested terms with counts: known ones stay, new ones are added."""
    words = read(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).where("length(term) >= 10")
    known = words.where("doc_id % 4 = 0").select("term").distinct()
    new = words.join(known, "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))
    return known.select("term", F.lit(0).cast("long").alias("n")).unionByName(new)


_CLOCK = "lpad((({0}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 1000 % 60)::VARCHAR, 2, '0')"
_MS = "lpad((({0}) % 1000)::VARCHAR, 3, '0')"

QUERIES = {
    "a10_stage_profile": a10, "a11_a12_progress_eta": a11_a12, "a13_run_estimate": a13, "a14_health": a14, "a36_cache_eviction": a36, "j01_terms_left_join": j01, "j02_group_count": j02,
    "t02_substring_search": t02, "j23_hit_lookup": j23, "a01_counts": a01, "a02_distinct_speakers": a02, "a16_a18_exact_duplicates": a16_a18,
    "a33_next_speaker": a33, "a38_speech_budget": a38, "a39_import_report": a39, "a41_result_summary": a41, "l01_archive_order": l01, "l02_pagination": l02, "l03_longest_segments": l03, "l09_job_order": l09,
    "p09_date_range": p09, "p10_soft_delete_filter": p10, "u01_ordered_union": u01, "u02_multiset_difference": u02, "u03_jaccard": u03, "u05_upsert": u05, "u06_cascading_delete": u06,
    "u06_delete_to_null": u06_null, "u07_soft_delete": u07, "u08_seed_defaults": u08, "u09_edit_overlay": u09, "u11_partial_update": u11, "j12_edit_carry_over": j12, "j19_alias_lookup": j19,
    "j20_citations": j20, "k01_json_export": k01, "k02_srt_export": k02, "k04_text_export": k04, "k06_timeline_export": k06, "k11_term_suggestions": k11,
}
ORACLES = {
    "a10_stage_profile": f"WITH {JOB}, {STAGE}, {_PROFILE} SELECT stage, round(weight, 9) AS weight, samples FROM prof",
    "a11_a12_progress_eta": f"""WITH {JOB}, {STAGE}, {_PROFILE}, {_RUNNING}, x AS (SELECT r.id, r.status, r.duration, sum(CASE WHEN p.place < c.place THEN p.weight WHEN p.place = c.place THEN p.weight * fraction ELSE 0 END) AS done, sum(p.weight) AS a FROM run r JOIN prof c ON c.stage = r.stage CROSS JOIN prof p GROUP BY ALL)
        SELECT id, CASE WHEN status = 'done' THEN 100.0 ELSE round(greatest(0, least(100, done / a * 100)), 1) END AS percent, CASE WHEN status = 'running' THEN round((a - done) * duration, 4) END AS eta_seconds FROM x""",
    "a13_run_estimate": f"WITH {JOB}, {STAGE}, {_PROFILE} SELECT id, round(duration * (SELECT sum(weight) FROM prof WHERE stage IN ('asr', 'merge', 'correction')), 4) AS seconds FROM job",
    "a14_health": f"""WITH {JOB}, x AS (SELECT id, status, id % 7 <> 0 AS active, (id % 400)::DOUBLE AS su, (id % 300)::DOUBLE AS el, CASE WHEN id % 5 = 0 THEN 0 ELSE (id % 90)::DOUBLE END AS ex, (id % 10)::DOUBLE / 10 AS fr FROM job)
        SELECT id, CASE WHEN status = 'running' AND NOT active THEN 'stalled' WHEN su >= CASE WHEN ex > 0 THEN greatest(60, 3 * ex) ELSE 60 END THEN 'stalled' WHEN ex > 0 AND (el >= greatest(30, 2 * ex) OR (fr * ex > 0 AND el >= greatest(30, 2 * fr * ex))) THEN 'slow' ELSE 'ok' END AS health FROM x""",
    "a36_cache_eviction": """WITH c AS (SELECT o_custkey AS cache, o_orderkey AS key, epoch(o_orderdate)::BIGINT AS mtime, o_totalprice::DECIMAL(18,2) AS price FROM orders), d AS (SELECT cache, key, mtime, floor(price)::BIGINT AS size FROM c),
        r AS (SELECT *, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY cache ORDER BY mtime DESC, key)), o AS (SELECT *, 915148800 - mtime > 86400 * 1500 AND n > 1 AS old FROM r),
        u AS (SELECT *, sum(CASE WHEN old THEN 0 ELSE size END) OVER (PARTITION BY cache ORDER BY n) AS used FROM o) SELECT cache, key FROM u WHERE old OR (used > 600000 AND n > 1)""",
    "j01_terms_left_join": "WITH p AS (SELECT p_partkey AS pos, p_name AS canonical, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 100 END AS source_id FROM part), r AS (SELECT p.*, row_number() OVER (PARTITION BY lower(canonical) ORDER BY pos) AS n FROM p LEFT JOIN supplier ON s_suppkey = source_id WHERE s_acctbal > 0 OR source_id IS NULL) SELECT pos, canonical, source_id FROM r WHERE n = 1",
    "j02_group_count": "SELECT n_nationkey, n_name, count(s_suppkey) AS n_entries FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
    "t02_substring_search": f"WITH {ENT} SELECT rec_id, idx FROM ent WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')",
    "j23_hit_lookup": "SELECT doc_id, s_name, n_name FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % 100 LEFT JOIN nation ON n_nationkey = doc_id % 25 WHERE contains(lower(text), 'licensed')",
    "a01_counts": "SELECT count(*) AS entries, count(*) FILTER (p_size > 25) AS enabled, count(DISTINCT p_brand) AS sources FROM part",
    "a02_distinct_speakers": f"WITH {ENT} SELECT DISTINCT speaker_id FROM ent WHERE speaker_id <> ''",
    "a16_a18_exact_duplicates": "WITH d AS (SELECT *, sha256(coalesce(text, '')) AS digest FROM documents), s AS (SELECT *, count(*) OVER (PARTITION BY digest, source) AS ns, count(*) OVER (PARTITION BY digest) AS n FROM d) SELECT doc_id, digest, n, first_value(doc_id) OVER (PARTITION BY digest ORDER BY ns DESC, doc_id) AS keep FROM s WHERE n > 1",
    "a33_next_speaker": "SELECT s_nationkey AS rec_id, 'SPEAKER_' || lpad((max(s_suppkey % 17) + 1)::VARCHAR, 2, '0') AS next_id FROM supplier GROUP BY 1",
    "a38_speech_budget": f"WITH {STAGE}, u AS (SELECT *, coalesce(sum(seconds) OVER (PARTITION BY worker, stage ORDER BY job_id, pos, seconds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM stg WHERE seconds >= 0.5) SELECT worker, stage, sum(least(seconds, 60 - used)) AS taken, count(*) AS n FROM u WHERE used < 60 GROUP BY ALL",
    "a39_import_report": "WITH n AS (SELECT p_partkey AS pos, lower(trim(CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END)) AS c, lower(trim(p_type)) AS v FROM part), k AS (SELECT DISTINCT lower(trim(p_name)) AS c, lower(trim(p_type)) AS v FROM part WHERE p_partkey % 10 = 0), m AS (SELECT n.*, row_number() OVER (PARTITION BY c, v ORDER BY pos) AS r, (c, v) IN (SELECT (c, v) FROM k) AS known FROM n) SELECT count(*) FILTER (c <> '' AND r = 1 AND NOT known) AS added, count(*) FILTER (NOT (c <> '' AND r = 1 AND NOT known)) AS skipped, count(*) AS total FROM m",
    "a41_result_summary": f"WITH {ENT} SELECT rec_id, count(*) AS n_entries, count(DISTINCT speaker_id) AS n_speakers, sum(length(text))::BIGINT AS n_chars FROM ent GROUP BY 1",
    "l01_archive_order": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS meeting FROM orders ORDER BY coalesce(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END, '') DESC, o_totalprice DESC, o_orderkey",
    "l02_pagination": "SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part WHERE p_size > 10 ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100",
    "l03_longest_segments": "SELECT * FROM (SELECT user_id, event_id, floor(value * 1000)::BIGINT AS ms, row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 1000) DESC, event_id) AS rank FROM events WHERE floor(value * 1000) >= 500) WHERE rank <= 10",
    "l09_job_order": "SELECT o_orderkey, o_orderdate::DATE AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC",
    "p09_date_range": "SELECT o_orderkey FROM orders WHERE o_orderkey % 8 <> 0 AND o_orderdate::DATE BETWEEN '1996-01-01' AND '1996-12-31'",
    "p10_soft_delete_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC",
    "u01_ordered_union": "WITH u AS (SELECT p_name AS name, 0 AS part, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, 1, p_partkey FROM part) SELECT name, arg_min(part, (part, pos)) AS part, arg_min(pos, (part, pos)) AS pos FROM u GROUP BY name",
    "u02_multiset_difference": "SELECT p_brand, p_size FROM part EXCEPT ALL SELECT p_brand, p_size FROM part WHERE p_partkey % 3 = 0",
    "u03_jaccard": f"WITH {ENT}, c AS (SELECT rec_id, idx, list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM ent WHERE text IS NOT NULL) SELECT a.rec_id, a.idx, round(CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM c a JOIN c b ON a.rec_id = b.rec_id AND b.idx = a.idx + 1",
    "u05_upsert": "WITH n AS (SELECT s_suppkey + 50 AS s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name END AS s_name, s_acctbal * 2 AS s_acctbal FROM supplier) SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal FROM supplier o FULL JOIN n ON o.s_suppkey = n.s_suppkey",
    "u06_cascading_delete": "SELECT s_suppkey, s_nationkey AS source_id FROM supplier WHERE s_nationkey % 5 <> 0",
    "u06_delete_to_null": "SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS source_id FROM supplier",
    "u07_soft_delete": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END, '2024-01-01'::DATE) WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END AS deleted_at FROM orders",
    "u08_seed_defaults": "WITH o AS (SELECT p_name, min(p_partkey) AS id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), s AS (SELECT p_name, min(p_partkey) AS id FROM part GROUP BY 1), e AS (SELECT * FROM o UNION ALL SELECT * FROM s WHERE p_name NOT IN (SELECT p_name FROM o)) SELECT p_name, id, id = (SELECT min(id) FROM e WHERE id > 0) AS active FROM e",
    "u09_edit_overlay": f"WITH {ENT}, e AS (SELECT rec_id, idx, text, CASE WHEN idx % 6 = 0 THEN 'first' END AS o FROM ent) SELECT rec_id, idx, CASE WHEN idx % 4 = 0 THEN coalesce(o, text) WHEN idx % 3 = 0 THEN 'edited ' || idx ELSE text END AS text, CASE WHEN idx % 4 = 0 THEN NULL WHEN idx % 3 = 0 THEN coalesce(o, text) ELSE o END AS original_text, CASE WHEN idx % 4 = 0 THEN false ELSE idx % 3 = 0 OR o IS NOT NULL END AS edited FROM e",
    "u11_partial_update": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'new' ELSE p_name END AS p_name, CASE WHEN p_partkey % 15 = 0 THEN NULL ELSE p_type END AS p_type FROM part",
    "j12_edit_carry_over": f"WITH {ENT} SELECT rec_id, idx, CASE WHEN idx % 2 = 0 THEN 'was ' || idx ELSE '' END AS carried FROM ent",
    "j19_alias_lookup": "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), a AS (SELECT DISTINCT * FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS alias FROM benchmark) WHERE length(alias) >= 6) SELECT doc_id, count(*) AS n_replaced FROM w JOIN a ON lower(word) = alias GROUP BY 1",
    "j20_citations": f"WITH {ENT}, c AS (SELECT DISTINCT conv_id AS rec_id FROM conversations WHERE conv_id IS NOT NULL), n AS (SELECT rec_id, unnest([rec_id % 4, rec_id % 3, rec_id % 4, 99]) AS idx, unnest([0, 1, 2, 3]) AS pos FROM c), m AS (SELECT rec_id, idx, min(pos) AS pos FROM n GROUP BY ALL) SELECT m.rec_id, m.idx, m.pos, e.speaker_id FROM m JOIN ent e USING (rec_id, idx)",
    "k01_json_export": f"WITH {ENT} SELECT rec_id, count(*) AS n, round(sum(end_ms / 1000), 3) AS ends FROM ent GROUP BY 1",
    "k02_srt_export": f"WITH {ENT}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS n FROM ent) SELECT rec_id, n, md5(n || chr(10) || {_CLOCK.format('start_ms')} || ',' || {_MS.format('start_ms')} || ' --> ' || {_CLOCK.format('end_ms')} || ',' || {_MS.format('end_ms')} || chr(10) || CASE WHEN speaker_id IS NULL THEN '' ELSE speaker_id || ': ' END || coalesce(text, '') || chr(10)) AS cue FROM n",
    "k04_text_export": f"WITH {ENT} SELECT rec_id, idx, md5('[' || {_CLOCK.format('start_ms')} || '] ' || coalesce(speaker_id, '?') || ': ' || coalesce(text, '')) AS line FROM ent",
    "k11_term_suggestions": r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents), l AS (SELECT * FROM w WHERE length(term) >= 10), k AS (SELECT DISTINCT term FROM l WHERE doc_id % 4 = 0) SELECT term, 0 AS n FROM k UNION ALL SELECT term, count(*) FROM l WHERE term NOT IN (SELECT term FROM k) GROUP BY term",
}
