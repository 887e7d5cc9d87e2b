"""Queries over results and model edits, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import results as R
from parlance.plans.inputs import ENT, entries, read


def _answers(spark, sf):
    """What a model might answer for each chunk of four entries: an edit for the first word of each."""
    e = entries(spark, sf).where("text is not null").withColumns({"chunk": F.floor(F.col("idx") / 4), "word": F.regexp_extract("text", r"[a-zA-Z]+", 0)})
    sure = F.when(F.col("idx") % 5 == 0, F.lit("high")).otherwise(((F.col("idx") * 37 + F.col("rec_id")) % 300 / 100 - 1).cast("string"))
    edit = F.struct(F.col("word").alias("before"), F.upper("word").alias("after"), F.lit("case").alias("reason"), sure.alias("confidence"))
    chunk = e.groupBy("rec_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", edit.alias("edit")))), lambda x: x["edit"]).alias("edits"))
    return chunk.select("rec_id", "chunk", F.concat(F.lit("Here it is:\n```json\n"), F.to_json("edits"), F.lit("\n```")).alias("raw"))


def f23(spark, sf):
    return R.edit_rows(_answers(spark, sf)).select("rec_id", "chunk", "pos", "before", "after", F.round("confidence", 4).alias("confidence"))


def j21(spark, sf):
    edits = R.edit_rows(_answers(spark, sf)).select("rec_id", "chunk", "pos", "before")
    e = entries(spark, sf).withColumn("chunk", F.floor(F.col("idx") / 4))
    return R.located(edits, e, ["rec_id", "chunk"])


def p11(spark, sf):
    """Parts of one brand, and of one brand and size: the size is asked for in every second run of the filter."""
    p = read(spark, sf, "part")
    one = p.where(R.matching(p_brand="Brand#13", p_size=None)).select("p_partkey", F.lit("brand").alias("asked"))
    return one.union(p.where(R.matching(p_brand="Brand#13", p_size=7)).select("p_partkey", F.lit("both").alias("asked"))).union(p.where(R.matching()).select("p_partkey", F.lit("all").alias("asked")))


def k07(spark, sf):
    e = entries(spark, sf).withColumns(
        {
            "speaker_confidence": F.when(F.col("idx") % 4 != 0, (F.col("idx") * 13 + F.col("rec_id")) % 100 / 100),
            "original_text": F.when(F.col("idx") % 6 == 0, F.lit("first")),
            "extra_speakers": F.when(F.col("idx") % 3 == 0, F.array(F.lit("Z"), F.lit("A"))),
        }
    )
    read_back = F.from_json("payload", "entries array<struct<idx: long, low_confidence: boolean, low_speaker_confidence: boolean, edited: boolean>>, speakers array<string>")
    rows = R.payload(e).select("rec_id", read_back.alias("p"))
    many = lambda flag: F.size(F.filter("p.entries", lambda x: x[flag]))
    return rows.select("rec_id", F.size("p.entries").alias("n"), many("low_confidence").alias("low"), many("low_speaker_confidence").alias("unsure"), many("edited").alias("edited"), F.array_join("p.speakers", ",").alias("speakers"))


_WORD = f"""{ENT}, w AS (SELECT rec_id, idx, idx // 4 AS chunk, text, regexp_extract(text, '[a-zA-Z]+') AS word, row_number() OVER (PARTITION BY rec_id, idx // 4 ORDER BY idx, word) - 1 AS pos,
    CASE WHEN idx % 5 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (idx * 37 + rec_id) % 300 / 100 - 1)) END AS sure FROM ent WHERE text IS NOT NULL), d AS (SELECT * FROM w WHERE word <> '' AND word <> upper(word))"""
QUERIES = {"f23_model_edits": f23, "j21_located_edits": j21, "p11_dynamic_filter": p11, "k07_result_payload": k07}
ORACLES = {
    "f23_model_edits": f"WITH {_WORD} SELECT rec_id, chunk, pos, word AS before, upper(word) AS after, round(sure, 4) AS confidence FROM d",
    "j21_located_edits": f"WITH {_WORD}, h AS (SELECT d.rec_id, d.chunk, d.pos, d.word AS before, e.idx, instr(e.text, d.word) - 1 AS start FROM d JOIN ent e ON e.rec_id = d.rec_id AND e.idx // 4 = d.chunk WHERE contains(e.text, d.word)) SELECT rec_id, chunk, pos, before, min(idx) AS idx, arg_min(start, idx) AS start FROM h GROUP BY ALL",
    "p11_dynamic_filter": "SELECT p_partkey, 'brand' AS asked FROM part WHERE p_brand = 'Brand#13' UNION ALL SELECT p_partkey, 'both' FROM part WHERE p_brand = 'Brand#13' AND p_size = 7 UNION ALL SELECT p_partkey, 'all' FROM part",
    "k07_result_payload": f"""WITH {ENT}, m AS (SELECT rec_id, speaker_id, 0 AS beside, min(idx) AS heard FROM ent WHERE speaker_id IS NOT NULL GROUP BY ALL UNION ALL SELECT rec_id, z, 1, min(idx) FROM (SELECT rec_id, idx, unnest(['Z', 'A']) AS z FROM ent WHERE idx % 3 = 0) GROUP BY ALL),
        r AS (SELECT rec_id, speaker_id, min((beside, heard)) AS k FROM m GROUP BY ALL), s AS (SELECT rec_id, string_agg(speaker_id, ',' ORDER BY k, speaker_id) AS speakers FROM r GROUP BY 1)
        SELECT rec_id, count(*) AS n, count(*) FILTER (avg_logprob < -0.8) AS low, count(*) FILTER (idx % 4 <> 0 AND (idx * 13 + rec_id) % 100 / 100 < 0.5) AS unsure, count(*) FILTER (idx % 6 = 0) AS edited, any_value(speakers) AS speakers FROM ent LEFT JOIN s USING (rec_id) GROUP BY rec_id""",
}
