"""Queries over chunks of recordings: quiet bounds and seams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import chunking as C
from parlance.operators import seams as S
from parlance.plans.inputs import read
from parlance.session import materialize

STEP_MS, CHUNK_MS = 28_000, 30_000


def heard_words(spark, sf) -> DataFrame:
    """The words of conversations, 300 ms each, as chunks of 30 s that overlap by 2 s heard them.

    At its end a chunk hears some words as others, and in every second chunk only half of its last word.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = read(spark, sf, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("rec_id"), "turn", F.posexplode(words).alias("pos", "word"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("rec_id").orderBy("turn", "pos")) - 1)
    rows = rows.withColumn("start_ms", F.col("n") * 300)
    own = F.floor(F.col("start_ms") / STEP_MS)
    rows = rows.withColumn("chunk", F.explode(F.array(own, own - 1))).where(f"chunk >= 0 and start_ms < chunk * {STEP_MS} + {CHUNK_MS}")
    late = F.col("start_ms") >= (F.col("chunk") + 1) * STEP_MS
    last = (F.col("chunk") % 2 == 0) & (F.col("start_ms") + 300 >= F.col("chunk") * STEP_MS + CHUNK_MS)
    heard = F.when(late & ((F.col("n") * 7 + F.col("chunk")) % 9 == 0), "uh").when(last, F.expr("substr(word, 1, length(word) div 2 + 1)")).otherwise(F.col("word"))
    return rows.select("rec_id", "chunk", "turn", "n", heard.alias("word"), "start_ms", (F.col("start_ms") + 250).alias("end_ms"))


def heard_segments(words: DataFrame, part: str) -> DataFrame:
    """The words of each chunk in segments of equal ``part``, as rows with an array of words."""
    rows = words.groupBy("rec_id", "chunk", F.expr(part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "word", "start_ms", "end_ms"))).alias("w"))
    own = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))
    rows = rows.select("rec_id", "chunk", (F.col("chunk") * 1_000_000 + F.col("part")).alias("idx"), own.alias("words"))
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    return rows.select("rec_id", "chunk", "idx", first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"), "words")


def w14(spark, sf):
    """Chunks without the words at their ends that the next chunk says again."""
    segments = heard_segments(heard_words(spark, sf), "turn")
    chunks = segments.select("rec_id", "chunk").distinct().withColumn("at_ms", F.col("chunk") * STEP_MS)
    return S.trim_boundaries(segments, chunks).select("rec_id", "chunk", "idx", "end_ms", "text", F.size("words").alias("n_words"))


def j13(spark, sf):
    """Pieces of three words that neighbouring chunks both heard, once."""
    segments = materialize(heard_segments(heard_words(spark, sf), "n div 3").drop("words"), "segments")  # read more than once
    chunks = segments.select("rec_id", "chunk").distinct().withColumn("middle_ms", F.col("chunk") * STEP_MS + CHUNK_MS // 2)
    return S.without_chunk_duplicates(segments, chunks).select("rec_id", "chunk", "idx", "start_ms", "end_ms", "text")


def c03(spark, sf):
    """Each user's values as samples, in chunks of fifty that overlap by twelve and begin where it is quiet."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    samples = read(spark, sf, "events").select(F.col("user_id").alias("key"), place.cast("long").alias("place"), F.col("value").cast("decimal(12, 2)").alias("x"))
    return C.quiet_chunks(samples, chunk=50, overlap=12, frame=4, hop=2)


QUERIES = {"w14_boundary_trim": w14, "j13_chunk_dedup": j13, "c03_quiet_chunks": c03}
ORACLES = {
    "c03_quiet_chunks": """WITH RECURSIVE e AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, value::DECIMAL(12, 2) AS x FROM events),
        t AS (SELECT key, count(*) AS n FROM e GROUP BY key), k AS (SELECT key, n, unnest(range(0, greatest(1, n - 3), 2)) AS low FROM t),
        f AS (SELECT k.key, low + 2 AS middle, sum(x * x)::DOUBLE / count(*) AS energy FROM k JOIN e ON e.key = k.key AND place >= low AND place < low + 4 GROUP BY k.key, low),
        s AS (SELECT key, n, 0::BIGINT AS chunk, 0::BIGINT AS start FROM t UNION ALL
              SELECT s.key, s.n, s.chunk + 1, greatest(any_value(s.start) + 1, least(coalesce(arg_min(middle, (energy, abs(middle - s.start - 38), middle)), any_value(s.start) + 38), s.n - 1))
              FROM s LEFT JOIN f ON f.key = s.key AND middle BETWEEN s.start + 32 AND s.start + 44 WHERE s.start + 38 < s.n AND s.n - s.start - 38 > 12 GROUP BY s.key, s.n, s.chunk, s.start)
        SELECT key, chunk, start, CASE WHEN chunk = max(chunk) OVER (PARTITION BY key) THEN n ELSE least(start + 50, n) END AS stop FROM s""",
}
