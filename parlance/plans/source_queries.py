"""Readers over lines and documents that Spark derives from the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.plans.inputs import ENT, SPK, entries, read, speaker_segments
from parlance.session import new_path
from parlance.sources import headers as H
from parlance.sources import scans as S
from parlance.sources.exports import export, json_documents, read_by_recording, slides_sidecar, upsert_partitions, vtt_cues


def s04(spark, sf):
    line = F.format_string("%s %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", F.when(F.col("idx") % 9 == 0, "LEXEME").otherwise("SPEAKER"), F.col("rec_id"), F.col("start_ms") / 1000, (F.col("end_ms") - F.col("start_ms")) / 1000, F.when(F.col("idx") % 7 == 0, F.lit("<NA>")).otherwise(F.concat(F.lit("speaker_"), F.substring("speaker_id", 2, 1))))
    return S.rttm_lines(speaker_segments(spark, sf).select(line.alias("value")))


def s05(spark, sf):
    token = F.struct(F.lit(" a").alias("text"), ((F.col("idx") % 9 + 1) / 10).alias("p"))
    seg = F.struct(F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to")).alias("offsets"), F.when(F.col("idx") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" t"), F.col("idx").cast("string"))).alias("text"), F.array(token, F.struct(F.lit("[_BEG_]").alias("text"), F.lit(0.5).alias("p"))).alias("tokens"))
    docs = entries(spark, sf).groupBy(F.col("rec_id").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", seg.alias("s")))), lambda x: x["s"]).alias("transcription"))
    return S.asr_documents(docs.select("doc", F.to_json(F.struct("transcription")).alias("value"))).withColumn("avg_logprob", F.round("avg_logprob", 6))


def s06(spark, sf):
    p = read(spark, sf, "part").selectExpr("case p_partkey % 4 when 0 then concat('# ', p_name) when 1 then '' when 2 then concat(' ', p_type, ' = ', p_name) else concat(p_name, ' ', p_partkey) end as value")
    return S.glossary_lines(p)


def s08(spark, sf):
    docs = json_documents(entries(spark, sf)).select(F.regexp_replace("document", r'"rec_id":(\d+)', '"rec_id":"$1"').alias("value"))
    return S.result_documents(docs).withColumn("text", F.md5(F.col("text").cast("binary")))


def _files(spark, sf):
    return read(spark, sf, "part").selectExpr("concat('/in/', replace(p_name, ' ', '_'), '_', p_partkey % 300, case when p_partkey % 3 = 0 then '.wav' when p_partkey % 3 = 1 then '.txt' else '.wav.processed' end) as path", "p_size as length").dropDuplicates(["path"])


def s09(spark, sf):
    return S.unprocessed(_files(spark, sf)).select("path", "name")


def s10(spark, sf):
    f = read(spark, sf, "supplier").selectExpr("concat('/lib/Name', s_suppkey % 7, case when s_suppkey < 7 then '' else concat(' (', s_suppkey, ')') end, '.wav') as path")
    return S.voice_library(f).select("name", F.array_join("paths", "|").alias("paths"))


def s13(spark, sf):
    p = read(spark, sf, "part").selectExpr("p_partkey as pos", "case when p_partkey % 6 = 0 then '# no=1' else concat(' KEY_', p_partkey % 40, ' = \"', p_name, '\" ') end as value")
    return S.config_lines(p)


def k03(spark, sf):
    return vtt_cues(entries(spark, sf)).withColumn("cue", F.md5(F.col("cue").cast("binary")))


def _little(value, size: int):
    """Bytes of a number, the lowest first, as hex digits; negative ones as their two's complement."""
    digits = F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def _recordings(spark, sf, size=2):
    """Each user's values as a recording of ``size`` bytes a sample; those of odd users have a comment before the data."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.floor(x["value"] * 50))
    u = read(spark, sf, "events").groupBy("user_id").agg(values.alias("v")).withColumn("rate", 8000 * (1 + F.col("user_id") % 3))
    text = lambda t: F.lit(t.encode().hex())
    note = F.when(F.col("user_id") % 2 == 1, F.concat(text("LIST"), _little(F.lit(5), 4), text("abcde"), text("\0"))).otherwise("")
    form = F.concat(text("WAVEfmt "), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(F.lit(1), 2), _little(F.col("rate"), 4), _little(F.col("rate") * size, 4), _little(F.lit(size), 2), _little(F.lit(8 * size), 2))
    data = F.concat(text("data"), _little(F.size("v") * size, 4), F.array_join(F.transform("v", lambda x: _little(x, size)), ""))
    body = F.concat(form, note, data)
    whole = F.unhex(F.concat(text("RIFF"), _little(F.length(body) / 2, 4), body))
    return u.select(F.format_string("u%s.wav", "user_id").alias("path"), whole.alias("content"))


def s02(spark, sf):
    """Headers of recordings from their first 64 bytes."""
    heads = _recordings(spark, sf).select("path", F.octet_length("content").cast("long").alias("length"), F.substring("content", 1, 64).alias("content"))
    return H.content_headers(heads).select("path", "codec", "rate", "channels", "bits", F.round("seconds", 6).alias("seconds"))


def s03(spark, sf):
    """Samples of recordings, 32 bits each: values of 656 and more do not fit in 16."""
    s = S.wav_samples(_recordings(spark, sf, 4))
    return s.select("path", "rate", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * 2**31).cast("long").alias("total"))


def s07(spark, sf):
    """A glossary as a file of columns with other names and another delimiter."""
    path = new_path(spark, "glossary")
    p = read(spark, sf, "part").selectExpr("concat(' ', p_name, ' ') as `Термин`", "p_brand as other", "case when p_partkey % 3 = 0 then null else concat(p_type, ', \"', p_brand, '\"') end as `Вариант`", "concat('c', p_size) as `Категория`")
    p.write.csv(path, sep=";", header=True, escape='"')
    return S.read_glossary_csv(spark, path).select("canonical", "variant", "category", "note")


def k08(spark, sf):
    """Documents written whole, one folder a recording, and read back."""
    path = new_path(spark, "results")
    export(entries(spark, sf), path, "json")
    back = read_by_recording(spark, path).select(F.regexp_replace("value", r'"rec_id":(\d+)', '"rec_id":"$1"').alias("value"))
    return S.result_documents(back).groupBy("rec_id").agg(F.count("*").alias("n"), F.max("end_ms").alias("last_ms"), F.sum(F.length("text")).alias("n_chars"))


def k09(spark, sf):
    """Entries stored by recording; every third recording is then stored anew, and the others stay."""
    path = new_path(spark, "stored")
    e = entries(spark, sf).select(F.col("rec_id").alias("job_id"), "idx", F.length("text").alias("n"))
    upsert_partitions(e, path)
    upsert_partitions(e.where("job_id % 3 = 0 and idx % 2 = 0").withColumn("n", -F.col("n")), path)
    return spark.read.parquet(path).select(F.col("job_id").cast("long").alias("job_id"), "idx", "n")


def k10(spark, sf):
    """Turns as slides, every fifth one still open, in documents beside each recording."""
    path = new_path(spark, "slides")
    e = entries(spark, sf).selectExpr("rec_id", "start_ms", "case when idx % 5 = 4 then null else end_ms end as end_ms", "case when idx % 2 = 0 then ' ' else concat(' ', speaker_id) end as text", "format_string('slide_%03d.png', idx) as image")
    slides_sidecar(e, path)
    kind = "count int, slides array<struct<index: int, start: double, end: double, text: string, image: string>>"
    back = read_by_recording(spark, path).select(F.col("rec_id").cast("long").alias("rec_id"), F.from_json("value", kind).alias("j"))
    return back.select("rec_id", "j.count", F.explode("j.slides").alias("s")).select("rec_id", "count", "s.*")


_T = "lpad((({0}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((({0}) % 1000)::VARCHAR, 3, '0')"
_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
QUERIES = {"s04_rttm_scan": s04, "s05_asr_json_scan": s05, "s06_glossary_scan": s06, "s08_result_json_scan": s08, "s09_unprocessed_files": s09, "s10_voice_library": s10, "s13_config_scan": s13, "k03_vtt_export": k03,
    "s02_header_probe": s02, "s03_wav_scan": s03, "s07_glossary_csv": s07, "k08_atomic_json": k08, "k09_partition_upsert": k09, "k10_slides_sidecar": k10,
}
ORACLES = {
    "s02_header_probe": "SELECT 'u' || user_id || '.wav' AS path, 'pcm' AS codec, 8000 * (1 + user_id % 3) AS rate, 1 AS channels, 16 AS bits, round(count(*) / (8000 * (1 + user_id % 3)), 6) AS seconds FROM events GROUP BY user_id",
    "s03_wav_scan": "SELECT 'u' || user_id || '.wav' AS path, 8000 * (1 + user_id % 3) AS rate, count(*) AS n, sum(floor(value * 50))::BIGINT AS total FROM events GROUP BY user_id",
    "s07_glossary_csv": """SELECT trim(p_name) AS canonical, CASE WHEN p_partkey % 3 <> 0 THEN p_type || ', "' || p_brand || '"' END AS variant, 'c' || p_size AS category, NULL AS note FROM part""",
    "k08_atomic_json": f"WITH {ENT} SELECT rec_id::VARCHAR AS rec_id, count(*) AS n, max(end_ms) AS last_ms, sum(length(text)) AS n_chars FROM ent GROUP BY 1",
    "k09_partition_upsert": f"WITH {ENT} SELECT rec_id AS job_id, idx, CASE WHEN rec_id % 3 = 0 THEN -length(text) ELSE length(text) END AS n FROM ent WHERE rec_id % 3 <> 0 OR idx % 2 = 0",
    "k10_slides_sidecar": f"""WITH {ENT} SELECT rec_id, count(*) OVER (PARTITION BY rec_id) AS count, row_number() OVER (PARTITION BY rec_id ORDER BY start_ms, idx) AS index, start_ms / 1000 AS start,
        CASE WHEN idx % 5 = 4 THEN NULL ELSE end_ms / 1000 END AS "end", CASE WHEN idx % 2 = 1 THEN speaker_id END AS text, 'slide_' || lpad(idx::VARCHAR, 3, '0') || '.png' AS image FROM ent""",
    "s04_rttm_scan": f"WITH {SPK} SELECT rec_id, start_ms, end_ms, CASE WHEN substr(speaker_id, 2, 1) = '0' THEN 'speaker_0' ELSE 'SPEAKER_' || lpad((substr(speaker_id, 2, 1)::INT - 1)::VARCHAR, 2, '0') END AS speaker_id FROM spk WHERE idx % 9 <> 0 AND idx % 7 <> 0 AND end_ms > start_ms",
    "s05_asr_json_scan": f"WITH {ENT}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS k FROM ent) SELECT rec_id AS doc, k AS idx, start_ms, end_ms, 't' || idx AS text, round(ln((idx % 9 + 1) / 10), 6) AS avg_logprob FROM n WHERE idx % 5 <> 0",
    "s06_glossary_scan": "SELECT CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE p_name || ' ' || p_partkey END AS canonical, CASE WHEN p_partkey % 4 = 2 THEN p_type END AS variant FROM part WHERE p_partkey % 4 > 1",
    "s08_result_json_scan": f"WITH {ENT} SELECT rec_id::VARCHAR AS rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS idx, start_ms, end_ms, md5(text) AS text, speaker_id FROM ent",
    "s09_unprocessed_files": "WITH f AS (SELECT DISTINCT '/in/' || replace(p_name, ' ', '_') || '_' || p_partkey % 300 || CASE p_partkey % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.txt' ELSE '.wav.processed' END AS path FROM part) SELECT path, lower(split_part(path, '/', 3)) AS name FROM f WHERE ends_with(path, '.wav') AND path || '.processed' NOT IN (SELECT path FROM f)",
    "s10_voice_library": "WITH f AS (SELECT 'Name' || s_suppkey % 7 AS name, CASE WHEN s_suppkey < 7 THEN 1 ELSE s_suppkey END AS i, '/lib/Name' || s_suppkey % 7 || CASE WHEN s_suppkey < 7 THEN '' ELSE ' (' || s_suppkey || ')' END || '.wav' AS path FROM supplier) SELECT name, string_agg(path, '|' ORDER BY i, lower(path)) AS paths FROM f GROUP BY 1",
    "s13_config_scan": "SELECT 'KEY_' || p_partkey % 40 AS key, arg_max(p_name, p_partkey) AS value FROM part WHERE p_partkey % 6 <> 0 GROUP BY p_partkey % 40",
    "k03_vtt_export": f"WITH {ENT}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS n FROM ent) SELECT rec_id, n, md5(n || chr(10) || {_T.format('start_ms')} || ' --> ' || {_T.format('end_ms')} || chr(10) || CASE WHEN speaker_id IS NULL THEN '' ELSE '<v ' || {_ESC.format('speaker_id')} || '>' END || {_ESC.format('coalesce(text, chr(32)[2:])')} || chr(10)) AS cue FROM n",
}
