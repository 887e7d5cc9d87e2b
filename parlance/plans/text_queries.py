"""Queries over texts and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.plans.inputs import ENT, entries, read

NOTE = (
    "CASE WHEN doc_id % 11 = 0 THEN concat('[LAUGHTER and music] ', text) WHEN doc_id % 11 = 1 THEN concat(text, ' (pause 5 sec) ok , right ..  yes !!  12 : 30  7 , 5  50 %') "
    "WHEN doc_id % 11 = 5 THEN concat('♪ music ♪ ', text, '....') ELSE text END"
)
# short entries stand beside the whole texts, none in the place of one
SHORT = "CASE doc_id % 11 WHEN 2 THEN 'Thanks for watching!' WHEN 3 THEN 'Applause, laughter' WHEN 4 THEN concat('Translated by ', coalesce(source, 'nobody')) ELSE '  ' END"
NOTES = f"notes AS (SELECT doc_id, {NOTE} AS note, doc_id % 30 * 1000 AS ms FROM documents UNION ALL SELECT doc_id, {SHORT}, doc_id % 30 * 1000 FROM documents WHERE doc_id % 11 IN (2, 3, 4, 6))"


def notes(spark, sf):
    d = read(spark, sf, "documents")
    short = d.where("doc_id % 11 in (2, 3, 4, 6)").selectExpr("doc_id", f"{SHORT} AS note", "doc_id % 30 * 1000 AS ms")
    return d.selectExpr("doc_id", f"{NOTE} AS note", "doc_id % 30 * 1000 AS ms").union(short)


def _sql_steps(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"
    return expr


_REPEATED = [("!!+", "!"), (r"\?\?+", "?"), (";;+", ";"), ("::+", ":"), (",,+", ",")]
SQL_TYPOGRAPHY = _sql_steps(
    "replace(note, chr(160), ' ')",
    [(r"\s+", " "), (r"(\d)\s*([.,])\s*(\d)", r"\1\2\3"), (r"(\d)\s*:\s*(\d)", r"\1:\2"), (r"(\d)\s+%", r"\1%"), (r"(\d)\s*/\s*(\d)", r"\1/\2"), (r"\s+([,!?;:…)\]}».])", r"\1"), (r"([(\[{«])\s+", r"\1"), *_REPEATED, (r"\.{3,}", "\u0001"), (r"\.{2}", "."), ("\u0001", "..."), (r"\s+", " ")],
)
SQL_STRIP = "trim(" + _sql_steps(
    "trim(" + _sql_steps("replace(" + _sql_steps("note", [(T.MARKER, " "), (T.MUSIC, " ")]) + ", chr(160), ' ')", [(r"\s+", " ")]) + ")",
    [(r"\s+([,.;:!?…])", r"\1"), *[s for s in _REPEATED], (r"\.{2,}", "."), (r"^[,.;:!?…\s]+", "")],
) + ")"
SQL_KEY = "trim(" + _sql_steps("lower(note)", [(r"[^\p{L}\p{M}\p{N}_\s]+", " "), (r"\s+", " ")]) + ")"
SQL_WORDS = r"regexp_extract_all(note, '\p{L}+')"


def f01(spark, sf):
    return notes(spark, sf).select("doc_id", T.normalize_typography(F.col("note")).alias("clean"))


def f03(spark, sf):
    return notes(spark, sf).select("doc_id", T.strip_markers(F.col("note")).alias("clean"))


def f05(spark, sf):
    n = F.col("note")
    return notes(spark, sf).select("doc_id", T.is_noise_only(n).alias("noise_only"), F.size(T.noise_stem_words(n)).alias("n_noise"))


def f07(spark, sf):
    return notes(spark, sf).select("doc_id", T.match_key(F.col("note")).alias("key"))


def f08(spark, sf):
    return notes(spark, sf).select("doc_id", T.word_count(F.col("note")).alias("n_words"), F.array_join(F.slice(T.words_of(F.col("note")), 1, 5), "|").alias("first_words"))


def f09(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.substring("p_name", 2, 30), F.lit("x")).alias("other"))
    return p.select("p_partkey", F.levenshtein("p_name", "other").alias("distance"), F.round(T.levenshtein_ratio(F.col("p_name"), F.col("other")), 6).alias("ratio"))


def f11(spark, sf):
    p = read(spark, sf, "part").withColumn("word", F.expr("case p_partkey % 3 when 0 then upper(p_name) when 1 then initcap(p_name) else p_name end"))
    return p.select("p_partkey", T.match_case(F.col("word"), F.col("p_type").substr(1, 4)).alias("cased_upper"), T.match_case(F.col("word"), F.lower("p_type")).alias("cased"))


def f13(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


def f14(spark, sf):
    e = entries(spark, sf)
    return e.select("rec_id", "idx", T.clock(F.col("start_ms")).alias("srt"), T.clock(F.col("end_ms"), ".").alias("vtt"), T.hms(F.col("end_ms")).alias("hms"), T.timeline_clock(F.col("end_ms") * 37).alias("timeline"))


def f15(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5(T.escape_markup(F.col("html")).cast("binary")).alias("escaped_md5"))


def f16(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", T.snippet(F.col("text"), ["ation", "licensed"]).alias("snippet"))


def f22(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit("```json\n answer: "), "props", F.lit("\n``` bye")).alias("raw"))
    return e.select("event_id", F.get_json_object(T.json_object(F.col("raw")), "$.k").try_cast("long").alias("k"))


def f25(spark, sf):
    d = read(spark, sf, "orders").select("o_orderkey", F.expr("case when o_orderkey % 5 = 0 then 'soon' when o_orderkey % 5 = 1 then null else date_format(o_orderdate, 'yyyy-MM-dd') end").alias("said"), F.col("o_orderdate").cast("date").alias("made"))
    return d.select("o_orderkey", F.coalesce(F.expr("try_to_date(said, 'yyyy-MM-dd')"), F.when(F.col("o_orderkey") % 2 == 0, F.col("made"))).alias("clean_date"))


def f27(spark, sf):
    e = entries(spark, sf).groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start_ms"], x["end_ms"])), ",")
    return e.select("rec_id", F.substring(F.sha1(text.cast("binary")), 1, 16).alias("fingerprint"), F.sha2(text, 256).alias("cache_key"))


def f31(spark, sf):
    return read(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.ocr_clean(F.concat(F.lit("  a \n\n\f b\n"), F.col("text"))).cast("binary")).alias("ocr_md5"))


def f35(spark, sf):
    return notes(spark, sf).select("doc_id", T.clean_term(F.col("note")).alias("term"))


def p02(spark, sf):
    e = entries(spark, sf).withColumn("confidence", F.expr("case when idx % 4 = 0 then null else (idx * 13 + rec_id) % 100 / 100.0 end"))
    low, unsure = F.coalesce(F.col("avg_logprob") < -0.8, F.lit(False)), F.coalesce(F.col("confidence") < 0.5, F.lit(False))
    mark = F.concat(F.when(low, " [?]").otherwise(""), F.when(unsure, " [speaker?]").otherwise(""), F.when(F.col("overlap"), " [overlap]").otherwise(""))
    return e.select("rec_id", "idx", low.alias("low"), unsure.alias("unsure"), mark.alias("markers"))


def p05(spark, sf):
    e = entries(spark, sf).withColumn("no_speech", F.expr("(idx * 31 + rec_id) % 100 / 100.0"))
    reasons = F.array_compact(F.array(F.when(F.trim("text") == "", "empty"), F.when(F.col("end_ms") - F.col("start_ms") < 500, "short"), F.when(F.col("avg_logprob") < -1.0, "low_logprob"), F.when(F.col("no_speech") > 0.6, "no_speech")))
    return e.select("rec_id", "idx", F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def p06(spark, sf):
    loose, strict = T.sparse_long(F.col("note"), F.col("ms"))
    return notes(spark, sf).select("doc_id", loose.alias("suspicious"), strict.alias("drop"))


def p07(spark, sf):
    return notes(spark, sf).select("doc_id", T.is_hallucination(F.col("note")).alias("hallucination"))


def p08(spark, sf):
    e = entries(spark, sf)
    hay = F.lower(F.concat_ws("\n", "speaker_id", "text"))
    return e.where(hay.contains("th") & hay.contains("er")).select("rec_id", "idx")


def p12(spark, sf):
    p = read(spark, sf, "part")
    return p.where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).select("p_partkey")


def p14(spark, sf):
    s = read(spark, sf, "supplier").withColumn("shown", F.expr("case s_suppkey % 4 when 0 then concat('Speaker ', s_suppkey) when 1 then concat('SPEAKER_', s_suppkey, ' — ', s_name) when 2 then s_name else null end"))
    return s.select("s_suppkey", T.human_name(F.col("shown")).alias("name"))


def a31(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(T.words_of(F.lower("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term")


def a32(spark, sf):
    """Acronyms and capitalised words that are no known lower-case word."""
    words = read(spark, sf, "documents").select(F.explode(T.words_of(F.col("text"))).alias("term")).distinct()
    known = words.where(F.col("term") == F.lower("term")).select(F.col("term").alias("known"))
    new = words.where((F.length("term") >= 6) & (F.col("term") != F.lower("term")))
    return new.join(known, F.lower("term") == F.col("known"), "left_anti").select(F.lower("term").alias("folded")).distinct()


_LOWER_NOISE = "(?:" + "|".join(T.NOISE_STEMS) + ")"
_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_SPLIT_CLOCK = lambda ms, c: f"lpad((({ms}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({ms}) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({ms}) // 1000 % 60)::VARCHAR, 2, '0') || '{c}' || lpad((({ms}) % 1000)::VARCHAR, 3, '0')"

QUERIES = {
    "f01_normalize_typography": f01, "f02_f03_strip_markers": f03, "f05_noise_classification": f05, "f07_match_key": f07, "f08_word_extraction": f08,
    "f09_levenshtein_ratio": f09, "f11_case_transfer": f11, "f13_safe_filename": f13, "f14_timecodes": f14, "f15_markup_escape": f15, "f16_snippet": f16,
    "f22_json_object": f22, "f25_date_clean": f25, "f27_content_hash": f27, "f31_ocr_cleanup": f31, "f35_term_trim": f35, "p02_p04_confidence_markers": p02,
    "p05_bad_segments": p05, "p06_sparse_long": p06, "p07_hallucination": p07, "p08_all_terms_filter": p08, "p12_haystack_search": p12, "p14_human_name": p14,
    "a31_term_frequency": a31, "a32_new_terms": a32,
}
ORACLES = {
    "f01_normalize_typography": f"WITH {NOTES} SELECT doc_id, CASE WHEN trim(regexp_replace(note, '\\s+', ' ', 'g')) = '' THEN note ELSE trim({SQL_TYPOGRAPHY}) END AS clean FROM notes",
    "f02_f03_strip_markers": f"WITH {NOTES} SELECT doc_id, CASE WHEN regexp_matches(note, '{T.MARKER}') OR regexp_matches(note, '{T.MUSIC}') THEN {SQL_STRIP} ELSE note END AS clean FROM notes",
    "f05_noise_classification": f"WITH {NOTES}, w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM notes) SELECT doc_id, len(ws) > 0 AND len(list_filter(ws, lambda w: NOT regexp_full_match(lower(w), '{T.NOISE_WORD}'))) = 0 AS noise_only, len(list_filter(ws, lambda w: regexp_matches(lower(w), '^{_LOWER_NOISE}'))) AS n_noise FROM w",
    "f07_match_key": f"WITH {NOTES} SELECT doc_id, {SQL_KEY} AS key FROM notes",
    "f08_word_extraction": f"WITH {NOTES} SELECT doc_id, len({SQL_WORDS}) AS n_words, array_to_string({SQL_WORDS}[1:5], '|') AS first_words FROM notes",
    "f09_levenshtein_ratio": "WITH p AS (SELECT p_partkey, p_name, substr(p_name, 2, 30) || 'x' AS other FROM part) SELECT p_partkey, levenshtein(p_name, other) AS distance, round(1 - levenshtein(p_name, other) / greatest(length(p_name), length(other)), 6) AS ratio FROM p",
    "f11_case_transfer": "WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'T' ELSE 'L' END AS k FROM part) SELECT p_partkey, substr(p_type, 1, 4) AS cased_upper, CASE k WHEN 'U' THEN upper(p_type) WHEN 'T' THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) ELSE lower(p_type) END AS cased FROM p",
    "f13_safe_filename": r"SELECT page_id, CASE WHEN f = '' THEN 'file' ELSE f END AS filename FROM (SELECT page_id, trim(regexp_replace(url, '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), ' .') AS f FROM pages)",
    "f14_timecodes": f"WITH {ENT}, r AS (SELECT *, round_even(end_ms * 37 / 1000, 0)::BIGINT AS s FROM ent) SELECT rec_id, idx, {_SPLIT_CLOCK('start_ms', ',')} AS srt, {_SPLIT_CLOCK('end_ms', '.')} AS vtt, substr({_SPLIT_CLOCK('end_ms', '.')}, 1, 8) AS hms, CASE WHEN s >= 3600 THEN (s // 3600)::VARCHAR || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS timeline FROM r",
    "f15_markup_escape": "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages",
    "f16_snippet": """WITH h AS (SELECT doc_id, text, nullif(instr(lower(text), 'ation'), 0) AS a, nullif(instr(lower(text), 'licensed'), 0) AS b FROM documents WHERE text IS NOT NULL),
        f AS (SELECT *, least(a, b) AS p, CASE WHEN a = least(a, b) THEN 5 ELSE 8 END AS n FROM h), c AS (SELECT *, greatest(p - 91, 0) AS s, least(p - 1 + n + 90, length(text)) AS e FROM f)
        SELECT doc_id, CASE WHEN p IS NULL THEN substr(text, 1, 180) ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || trim(substr(text, s + 1, e - s)) || CASE WHEN e < length(text) THEN '…' ELSE '' END END AS snippet FROM c""",
    "f22_json_object": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "f25_date_clean": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 1 THEN o_orderdate::DATE END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END) AS clean_date FROM orders",
    "f27_content_hash": f"WITH {ENT}, t AS (SELECT rec_id, string_agg(start_ms || ':' || end_ms, ',' ORDER BY idx) AS t FROM ent GROUP BY 1) SELECT rec_id, substr(sha1(t), 1, 16) AS fingerprint, sha256(t) AS cache_key FROM t",
    "f31_ocr_cleanup": "WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace('  a ' || chr(10) || chr(10) || chr(12) || ' b' || chr(10) || text, chr(12), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(array_to_string(ls, chr(10))) AS ocr_md5 FROM l",
    "f35_term_trim": f"WITH {NOTES} SELECT doc_id, regexp_replace(regexp_replace(note, '^[\\s.,;:!?\"''«»()\\[\\]{{}}…–—-]+|[\\s.,;:!?\"''«»()\\[\\]{{}}…–—-]+$', '', 'g'), '\\s+', ' ', 'g') AS term FROM notes",
    "p02_p04_confidence_markers": f"WITH {ENT}, c AS (SELECT *, coalesce(avg_logprob < -0.8, false) AS low, coalesce(CASE WHEN idx % 4 = 0 THEN NULL ELSE (idx * 13 + rec_id) % 100 / 100.0 END < 0.5, false) AS unsure FROM ent) SELECT rec_id, idx, low, unsure, CASE WHEN low THEN ' [?]' ELSE '' END || CASE WHEN unsure THEN ' [speaker?]' ELSE '' END || CASE WHEN overlap THEN ' [overlap]' ELSE '' END AS markers FROM c",
    "p05_bad_segments": f"WITH {ENT}, r AS (SELECT rec_id, idx, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN end_ms - start_ms < 500 THEN 'short' END, CASE WHEN avg_logprob < -1.0 THEN 'low_logprob' END, CASE WHEN (idx * 31 + rec_id) % 100 / 100.0 > 0.6 THEN 'no_speech' END) AS reasons FROM ent) SELECT * FROM r WHERE reasons <> ''",
    "p06_sparse_long": f"WITH {NOTES}, w AS (SELECT doc_id, ms > 20000 AS l, len(regexp_extract_all(trim(note), '\\p{{L}}+')) <= 4 AS a, length(trim(note)) <= 14 AS b FROM notes) SELECT doc_id, l AND (a OR b) AS suspicious, l AND a AND b AS drop FROM w",
    "p07_hallucination": f"WITH {NOTES}, k AS (SELECT doc_id, {SQL_KEY} AS key FROM notes) SELECT doc_id, key <> '' AND (key IN ({_LIST(T.HALLUCINATIONS)}) OR (len(regexp_extract_all(key, '\\p{{L}}+')) <= 12 AND ({' OR '.join(f'starts_with(key, {_LIST([c])})' for c in T.CREDITS)}))) AS hallucination FROM k",
    "p08_all_terms_filter": f"WITH {ENT} SELECT rec_id, idx FROM ent WHERE contains(lower(concat_ws(chr(10), speaker_id, text)), 'th') AND contains(lower(concat_ws(chr(10), speaker_id, text)), 'er')",
    "p12_haystack_search": "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')",
    "p14_human_name": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN s_name WHEN 2 THEN s_name END AS name FROM supplier",
    "a31_term_frequency": r"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) GROUP BY term ORDER BY n DESC, term",
    "a32_new_terms": r"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS term FROM documents) SELECT DISTINCT lower(term) AS folded FROM w WHERE length(term) >= 6 AND term <> lower(term) AND lower(term) NOT IN (SELECT term FROM w WHERE term = lower(term))",
}
