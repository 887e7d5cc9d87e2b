"""Queries through the stage registry, with a deterministic stand-in for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.plans import stages as P
from parlance.plans.inputs import ENT, entries, segments, speaker_segments


def x01(spark, sf):
    plan = P.transcript_plan(speaker_segments(spark, sf), 60_000)
    return plan.using(context=None).run(segments(spark, sf).withColumn("avg_logprob", F.col("avg_logprob").cast("double"))).select("rec_id", "idx", "speaker_id", "start_ms", "end_ms", "n_entries")


def _length(prompt: str) -> str:
    return str(len(prompt))


def x07(spark, sf):
    """The stand-in's answer to the answers for the chunks of each recording; of one chunk its answer."""
    return P.summarized(entries(spark, sf).where("text is not null"), _length, 600)


def x11(spark, sf):
    e = entries(spark, sf).select("rec_id", "idx", "text")
    bad = e.where(F.length("text") < 200).select("rec_id", "idx")
    return P.refined(e, bad, lambda df: df.withColumn("text", F.reverse("text"))).withColumn("text", F.md5(F.col("text").cast("binary")))


def _letter_counts():
    return lambda pieces: [[float(p.lower().count(c)) for c in "aeiou"] for p in pieces]


def x06(spark, sf):
    """A stand-in for an embedder: how often each vowel stands in a text."""
    rows = P.embedded(entries(spark, sf).select("rec_id", "idx", "text"), _letter_counts, "text")
    return rows.select("rec_id", "idx", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), " ").alias("vector"))


QUERIES = {"x06_embedder": x06, "x01_stage_plan": x01, "x07_map_reduce_summary": x07, "x11_refined_segments": x11}
ORACLES = {
    "x06_embedder": f"WITH {ENT} SELECT rec_id, idx, " + " || ' ' || ".join(f"length(regexp_replace(text, '[^{c}{c.upper()}]', '', 'g'))" for c in "aeiou") + " AS vector FROM ent",
    "x07_map_reduce_summary": f"""WITH RECURSIVE {ENT}, n AS (SELECT rec_id, idx, length(text) AS n, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS k FROM ent WHERE text IS NOT NULL),
        r AS (SELECT rec_id, k, n, 0 AS chunk, n + 1 AS size FROM n WHERE k = 1 UNION ALL
              SELECT n.rec_id, n.k, n.n, r.chunk + CASE WHEN r.size > 0 AND r.size + n.n > 600 THEN 1 ELSE 0 END, CASE WHEN r.size > 0 AND r.size + n.n > 600 THEN 0 ELSE r.size END + n.n + 1 FROM r JOIN n ON n.rec_id = r.rec_id AND n.k = r.k + 1),
        p AS (SELECT rec_id, chunk, (sum(n + 1) - 1)::BIGINT::VARCHAR AS answer FROM r GROUP BY rec_id, chunk)
        SELECT rec_id, count(*) AS chunks, CASE WHEN count(*) > 1 THEN (sum(length(answer) + 1) - 1)::BIGINT::VARCHAR ELSE any_value(answer) END AS summary FROM p GROUP BY rec_id""",
    "x11_refined_segments": f"WITH {ENT} SELECT rec_id, idx, md5(CASE WHEN length(text) < 200 THEN reverse(text) ELSE text END) AS text FROM ent",
}
