"""Queries over vectors, glossaries, chunks and edits, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from parlance.functions import edits as E
from parlance.operators import chunking as C
from parlance.operators import graph
from parlance.operators import intervals as I
from parlance.operators import sequences as S
from parlance.operators import clusters as K
from parlance.operators import similarity as M
from parlance.plans.inputs import ENT, SPK, entries, read, segments, speaker_segments

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_GLOSSARY = "g AS (SELECT DISTINCT lower(p_name) AS term FROM part)"


#: Vectors of one recording: groups that stay as small on larger tables.
VOICES = 100


def vectors(spark, sf):
    return read(spark, sf, "embeddings")


def j14(spark, sf):
    """Vectors and slightly changed copies of every fifth of them: the pairs that nearly agree."""
    v = vectors(spark, sf).select((F.col("vec_id") * 2).alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    moved = v.where("id % 10 = 0").select((F.col("id") + 1).alias("id"), F.transform("vector", lambda x, i: F.when(i == 0, x + 0.01).otherwise(x)).alias("vector"))
    return M.near_pairs(v.unionByName(moved), 0.95).withColumn("score", F.round("score", 5))


def j15(spark, sf):
    refs = M.mean_vectors(vectors(spark, sf).where("vec_id % 2 = 0"), ["label"], "embedding").select(F.col("label").alias("name"), F.col("mean").alias("ref"))
    speakers = vectors(spark, sf).where("vec_id % 2 = 1").select(F.col("vec_id").alias("speaker"), F.col("embedding").alias("vector"))
    return M.similarity_matrix(speakers, refs)


def j15_matrix(spark, sf):
    return j15(spark, sf).withColumn("score", F.round("score", 5))


def j16_shared(spark, sf):
    return M.best_names(j15(spark, sf), 0.3).withColumn("score", F.round("score", 5))


def j16_exclusive(spark, sf):
    scores = j15(spark, sf).withColumn("group", F.floor(F.col("speaker") / VOICES))
    return M.exclusive_names(scores, 0.2).withColumn("score", F.round("score", 5))


def a19(spark, sf):
    m = M.mean_vectors(vectors(spark, sf), ["label"], "embedding")
    return m.select("label", F.round(F.element_at("mean", 1), 6).alias("first"), F.round(F.element_at("mean", 64), 6).alias("last"), F.size("mean").alias("n"))


def a17(spark, sf):
    """Components of documents that share a long rare word."""
    words = read(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{16,}"), F.lit(0)))).alias("w"))
    first = words.groupBy("w").agg(F.min("doc_id").alias("b"))
    return graph.components(words.join(first, "w").select(F.col("doc_id").alias("a"), "b"))


def a20(spark, sf):
    v = vectors(spark, sf).select(F.floor(F.col("vec_id") / VOICES).alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.clustered(v, 0.6)


def a21(spark, sf):
    v = vectors(spark, sf).select(F.floor(F.col("vec_id") / VOICES).alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.clustered(v, 1.3, clusters=3, linkage="ward")


def a21_bounded(spark, sf):
    """Clusters of each group by a threshold, with an exact number, an estimate, a lower or an upper bound in turn, or none."""
    v = vectors(spark, sf).select(F.floor(F.col("vec_id") / VOICES).alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    turn = F.col("group") % 5
    bounds = {"exact": (0, 3), "expected": (1, 1), "least": (2, VOICES // 2), "most": (3, 2)}
    return K.bounded_clusters(v.withColumns({c: F.when(turn == t, k).cast("int") for c, (t, k) in bounds.items()}), 1.2)


def a22(spark, sf):
    v = vectors(spark, sf).select(F.floor(F.col("vec_id") / VOICES).alias("group"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.ensemble_count(v, (0.4, 0.5, 0.6, 0.7, 0.8))


def a30(spark, sf):
    d = read(spark, sf, "documents")
    return M.share_distance(d.where("doc_id % 2 = 0").groupBy("lang").agg(F.count("*").alias("n")), d.where("doc_id % 2 = 1").groupBy("lang").agg(F.count("*").alias("n")), "lang").withColumn("distance", F.round("distance", 6))


def u04(spark, sf):
    s = entries(spark, sf).select("rec_id", "idx", F.when(F.col("idx") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("text"), F.array((F.col("idx") % 4 / 10).cast("double"), F.lit(0.5)).alias("features"))
    return M.slide_groups(s)


def a40(spark, sf):
    """Bounds and richest member of each group of entries; an open end leaves the group open."""
    e = entries(spark, sf).withColumns({"group": F.col("idx") % 2, "end_ms": F.when(F.col("idx") == 3, F.lit(None)).otherwise(F.col("end_ms"))})
    return e.groupBy("rec_id", "group").agg(F.min("start_ms").alias("start_ms"), F.when(F.bool_or(F.col("end_ms").isNull()), F.lit(None)).otherwise(F.max("end_ms")).alias("end_ms"), F.max_by("idx", F.struct(F.length(F.trim(F.coalesce("text", F.lit("")))), -F.col("idx"))).alias("best"))


def j17(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,9}"), F.lit(0)))).alias("word"))
    terms = read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,9}"), F.lit(0))).alias("term")).distinct()
    return M.fuzzy_terms(words, terms)


def j07(spark, sf):
    """Share of the merged words of a segment that its speaker covers."""
    seg, spk = segments(spark, sf), speaker_segments(spark, sf)
    third = F.floor((F.col("end_ms") - F.col("start_ms")) / 3)
    words = seg.select(F.concat_ws("/", "rec_id", "idx").alias("seg"), "rec_id", "idx", F.explode(F.array(F.struct(F.col("start_ms").alias("s"), (F.col("start_ms") + third).alias("e")), F.struct((F.col("start_ms") + F.floor(third / 2)).alias("s"), (F.col("start_ms") + 2 * third).alias("e")))).alias("w"))
    spans = I.islands(words.select("seg", "rec_id", "idx", F.col("w.s").alias("start_ms"), F.col("w.e").alias("end_ms")), ["seg", "rec_id", "idx"])
    total = spans.groupBy("rec_id", "idx").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"))
    covered = I.coverage(spans.select("rec_id", "idx", "start_ms", "end_ms"), spk)
    best = I.best_overlap(seg, spk).select("rec_id", "idx", "speaker_id")
    rows = best.join(total, ["rec_id", "idx"]).join(covered, ["rec_id", "idx", "speaker_id"], "left")
    return rows.select("rec_id", "idx", F.when(F.col("total_ms") > 0, F.round(F.coalesce("covered_ms", F.lit(0)) / F.col("total_ms"), 6)).otherwise(0.0).alias("confidence"))


def f06(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" again again. And so it is, and so it is")).alias("text"))
    return d.select("doc_id", M.mapped(S.collapse_ngrams, F.col("text")).alias("text"))


def f10(spark, sf):
    e = entries(spark, sf).where("text is not null").select("rec_id", "idx", F.col("text").alias("a"))
    n = e.select("rec_id", (F.col("idx") - 1).alias("idx"), F.col("a").alias("b"))
    return e.join(n, ["rec_id", "idx"]).select("rec_id", "idx", F.round(M.similarity_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


def f12(spark, sf):
    @F.pandas_udf("array<int>")
    def sync(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([E.sync_words((a or "").split(), (b or "").split()) for a, b in zip(old, new)])

    e = entries(spark, sf).withColumn("new", F.regexp_replace(F.regexp_replace("text", "^\\S+ ", ""), "[.,]", ""))
    return e.select("rec_id", "idx", F.size(sync(F.col("text"), F.col("new"))).alias("n_synced"))


def f18(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit(" Well  well ,yes !! 5 % - so - "), F.col("text"), F.lit(" ")).alias("text"))
    edits = d.select("doc_id", "text", E.apart(E.hits(F.col("text"))).alias("edits"))
    return edits.select("doc_id", F.size("edits").alias("n_edits"), E.apply(F.col("text"), F.col("edits")).alias("text"))


def f24(spark, sf):
    """Edits of one entry by start, then length, none over the one before it."""
    span = F.expr("struct(cast(floor(value * 10) as int) as start, cast(floor(value * 10) + event_id % 40 as int) as stop, cast(event_id as int) as rule)")
    grouped = read(spark, sf, "events").groupBy(F.col("user_id").alias("rec_id")).agg(F.collect_list(span).alias("x"))
    return grouped.select("rec_id", F.explode(E.apart(F.col("x"))).alias("s")).select("rec_id", "s.start", "s.stop")


def f26(spark, sf):
    """Names with single spaces, each once without regard to case, in order."""
    n = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit(" Name  "), (F.col("s_suppkey") % 4).cast("string"), F.lit(" ")).alias("name")))).alias("l"))
    clean = F.transform("l", lambda x: F.trim(F.regexp_replace(x["name"], r"\s+", " ")))
    empty = F.expr("cast(array() as array<string>)")
    return n.select("s_nationkey", F.array_join(F.aggregate(clean, empty, lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x))), "|").alias("names"))


def f29(spark, sf):
    """Largest difference over cells between a frame and the one before it."""
    f = read(spark, sf, "events").selectExpr("user_id as rec_id", "event_id as idx", "array(value / 500, (event_id % 7) / 7D) as cells")
    before = F.lag("cells").over(S.by_idx())
    return f.select("rec_id", "idx", F.round(F.coalesce(F.array_max(F.zip_with("cells", before, lambda a, b: F.abs(a - b))), F.lit(1.0)), 6).alias("difference"))


def f30(spark, sf):
    e = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.avg(F.when(F.col("l_tax") > 0, F.log("l_tax"))).alias("m"))
    return e.select("l_orderkey", F.round("m", 6).alias("mean_logprob"))


def c01(spark, sf):
    return C.speech_windows(speaker_segments(spark, sf), 60_000, 20_000)


def c02(spark, sf):
    total = speaker_segments(spark, sf).groupBy("rec_id").agg(F.max("end_ms").alias("total_ms"))
    return C.overlapping_windows(total, 5_400_000, 120_000)


def c04(spark, sf):
    return C.text_chunks(entries(spark, sf), 1200)


def c05(spark, sf):
    return C.speech_samples(speaker_segments(spark, sf), 8, 1500)


def l08(spark, sf):
    t = read(spark, sf, "part").selectExpr("p_size as rec_id", "p_partkey as pos", "p_name as term")
    return C.fitting_prefix(t, 60).select("rec_id", F.size("kept").alias("n"), F.array_join("kept", ", ").alias("kept"))


def l05(spark, sf):
    """Each user's longest segment, earliest of equals, cut to eight seconds."""
    e = read(spark, sf, "events").selectExpr("user_id", "event_id", "cast(floor(value * 100) as bigint) as ms")
    best = e.groupBy("user_id").agg(F.max(F.struct("ms", (-F.col("event_id")).alias("minus"))).alias("b"))
    return best.select("user_id", (-F.col("b.minus")).alias("event_id"), F.least("b.ms", F.lit(8000)).alias("ms"))


def a23(spark, sf):
    """Energy of each user's values: mean square, its root, median and the share of loud ones."""
    e = read(spark, sf, "events").select("user_id", (F.col("value") * F.col("value")).alias("q"))
    m = e.groupBy("user_id").agg(F.median("q").alias("median"))
    out = e.join(m, "user_id").groupBy("user_id").agg(F.avg("q").alias("energy"), F.first("median").alias("median"), F.avg((F.col("q") >= 0.25 * F.col("median")).cast("int")).alias("loud"))
    return out.select("user_id", F.round("energy", 4).alias("energy"), F.round(F.sqrt("energy"), 4).alias("rms"), F.round("median", 4).alias("median"), F.round("loud", 6).alias("loud"))


def a26(spark, sf):
    """Root mean square in ten equal bins of each day over the loudest bin."""
    e = segments(spark, sf).select("rec_id", F.floor(F.col("start_ms") / 8_640_000).alias("bin"), ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("x"))
    b = e.groupBy("rec_id", "bin").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    top = b.groupBy("rec_id").agg(F.max("rms").alias("top"))
    return b.join(top, "rec_id").select("rec_id", "bin", F.round(F.when(F.col("top") > 0, F.col("rms") / F.col("top")).otherwise(0.0), 6).alias("level"))


QUERIES = {
    "j07_word_coverage": j07, "j14_cosine_join": j14, "j15_similarity_matrix": j15_matrix, "j16_shared_names": j16_shared, "j16_exclusive_names": j16_exclusive, "j17_fuzzy_terms": j17,
    "a17_connected_components": a17, "a19_mean_vectors": a19, "a20_agglomerative": a20, "a21_fixed_count_ward": a21, "a21_bounded_clusters": a21_bounded, "a22_ensemble_count": a22, "a23_energy": a23, "a26_envelope": a26, "a30_share_distance": a30,
    "a40_slide_aggregate": a40, "u04_slide_groups": u04, "f06_ngram_collapse": f06, "f10_similarity_ratio": f10, "f12_word_sync": f12, "f18_f19_editorial": f18, "f24_edit_overlaps": f24, "f26_participants": f26,
    "f29_frame_difference": f29, "f30_mean_logprob": f30, "c01_speech_windows": c01, "c02_overlapping_windows": c02, "c04_text_chunks": c04, "c05_speech_samples": c05, "l05_longest_clean": l05, "l08_fitting_prefix": l08,
}
ORACLES = {
    "j14_cosine_join": f"WITH v AS (SELECT vec_id * 2 AS id, embedding::DOUBLE[] AS embedding FROM embeddings UNION ALL SELECT vec_id * 2 + 1, list_prepend(embedding[1]::DOUBLE + 0.01, embedding[2:]::DOUBLE[]) FROM embeddings WHERE vec_id % 5 = 0) SELECT a.id, b.id AS other, round({_COS}, 5) AS score FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= 0.95",
    "a19_mean_vectors": "WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT m.label, round(max(CASE WHEN i = 1 THEN x / n END), 6) AS first, round(max(CASE WHEN i = 64 THEN x / n END), 6) AS last, 64 AS n FROM m JOIN n USING (label) GROUP BY m.label",
    "j15_similarity_matrix": "WITH r AS (SELECT label AS name, list(x ORDER BY i) AS ref FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 2 = 0 GROUP BY ALL) GROUP BY 1) SELECT vec_id AS speaker, name, round(list_cosine_similarity(embedding::DOUBLE[], ref), 5) AS score FROM embeddings, r WHERE vec_id % 2 = 1",
    "j16_shared_names": "WITH r AS (SELECT label AS name, list(x ORDER BY i) AS ref FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id % 2 = 0 GROUP BY ALL) GROUP BY 1), s AS (SELECT vec_id AS speaker, name, list_cosine_similarity(embedding::DOUBLE[], ref) AS score FROM embeddings, r WHERE vec_id % 2 = 1), k AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY score DESC, name) AS n FROM s) SELECT speaker, name, round(score, 5) AS score FROM k WHERE n = 1 AND score >= 0.3",
    "a30_share_distance": "WITH p AS (SELECT lang, count(*) / sum(count(*)) OVER () AS p FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), q AS (SELECT lang, count(*) / sum(count(*)) OVER () AS q FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS distance FROM p FULL JOIN q USING (lang)",
    "a40_slide_aggregate": f'WITH {ENT} SELECT rec_id, idx % 2 AS "group", min(start_ms) AS start_ms, CASE WHEN bool_or(idx = 3) THEN NULL ELSE max(end_ms) END AS end_ms, arg_max(idx, (length(trim(coalesce(text, \'\'))), -idx)) AS best FROM ent GROUP BY 1, 2',
    "f26_participants": "WITH n AS (SELECT s_nationkey, s_suppkey % 4 AS k, min(s_suppkey) AS f FROM supplier GROUP BY ALL) SELECT s_nationkey, string_agg('Name ' || k, '|' ORDER BY f) AS names FROM n GROUP BY 1",
    "f29_frame_difference": "SELECT user_id AS rec_id, event_id AS idx, round(coalesce(greatest(abs(value / 500 - lag(value / 500) OVER w), abs((event_id % 7) / 7 - lag((event_id % 7) / 7) OVER w)), 1.0), 6) AS difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "f30_mean_logprob": "SELECT l_orderkey, round(avg(CASE WHEN l_tax > 0 THEN ln(l_tax) END), 6) AS mean_logprob FROM lineitem GROUP BY 1",
    "c01_speech_windows": f"""WITH {SPK}, f AS (SELECT *, end_ms - start_ms AS l, (end_ms - start_ms) // 60000 AS full_n FROM spk), n AS (SELECT *, CASE WHEN full_n = 0 THEN CASE WHEN l > 0 THEN 1 ELSE 0 END ELSE full_n + CASE WHEN l - full_n * 60000 >= 20000 THEN 1 ELSE 0 END END AS n FROM f),
        k AS (SELECT *, unnest(range(0, n)) AS k FROM n) SELECT rec_id, idx, k, start_ms + k * 60000 AS win_start, CASE WHEN k = n - 1 THEN end_ms ELSE start_ms + (k + 1) * 60000 END AS win_end FROM k""",
    "c02_overlapping_windows": f"""WITH {SPK}, t AS (SELECT rec_id, max(end_ms) AS total FROM spk GROUP BY 1), l AS (SELECT *, greatest(0, ceil((total - 5400000) / 5280000))::BIGINT AS last FROM t), k AS (SELECT *, unnest(range(0, last + 1)) AS k FROM l)
        SELECT rec_id, k, k * 5280000 AS win_start, least(k * 5280000 + 5400000, total) AS win_end, CASE WHEN k = 0 THEN 0 ELSE k * 5280000 + 60000 END AS own_start, CASE WHEN k = last THEN total ELSE k * 5280000 + 5280000 + 60000 END AS own_end FROM k""",
    "l05_longest_clean": "SELECT user_id, arg_max(event_id, (floor(value * 100)::BIGINT, -event_id)) AS event_id, least(max(floor(value * 100)::BIGINT), 8000) AS ms FROM events GROUP BY 1",
    "a23_energy": "WITH m AS (SELECT user_id, median(value * value) AS med FROM events GROUP BY 1) SELECT user_id, round(avg(value * value), 4) AS energy, round(sqrt(avg(value * value)), 4) AS rms, round(any_value(med), 4) AS median, round(avg(CASE WHEN value * value >= 0.25 * med THEN 1 ELSE 0 END), 6) AS loud FROM events JOIN m USING (user_id) GROUP BY 1",
    "f24_edit_overlaps": """WITH RECURSIVE e AS (SELECT user_id AS rec_id, floor(value * 10)::INT AS s, (floor(value * 10) + event_id % 40)::INT AS e, event_id FROM events),
        o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s, e DESC, event_id) AS k FROM e),
        w AS (SELECT rec_id, k, s, e, true AS taken, e AS reach FROM o WHERE k = 1
              UNION ALL SELECT o.rec_id, o.k, o.s, o.e, o.s >= w.reach, CASE WHEN o.s >= w.reach THEN o.e ELSE w.reach END FROM w JOIN o ON o.rec_id = w.rec_id AND o.k = w.k + 1)
        SELECT rec_id, s AS start, e AS stop FROM w WHERE taken""",
    "c04_text_chunks": f"""WITH RECURSIVE {ENT}, n AS (SELECT rec_id, idx, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS k FROM ent),
        r AS (SELECT rec_id, idx, k, 0 AS chunk, n + 1 AS size FROM n WHERE k = 1 UNION ALL SELECT n.rec_id, n.idx, n.k, r.chunk + CASE WHEN r.size > 0 AND r.size + n.n > 1200 THEN 1 ELSE 0 END, CASE WHEN r.size > 0 AND r.size + n.n > 1200 THEN 0 ELSE r.size END + n.n + 1 FROM r JOIN n ON n.rec_id = r.rec_id AND n.k = r.k + 1)
        SELECT rec_id, idx, chunk FROM r""",
    "j17_fuzzy_terms": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,9}')) AS term FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,9}')) AS word FROM documents),
        u AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE starts_with(word, term) AND length(word) - length(term) BETWEEN 1 AND 3)),
        p AS (SELECT word, term, levenshtein(word, term) AS d FROM u JOIN t ON abs(length(word) - length(term)) <= 2 AND levenshtein(word, term) <= 2), r AS (SELECT *, 1 - d / greatest(length(word), length(term)) AS r FROM p)
        SELECT word, arg_min(term, (-r, d, term)) AS term, arg_min(d, (-r, d, term)) AS distance FROM r WHERE r >= 0.8 GROUP BY word""",
}
