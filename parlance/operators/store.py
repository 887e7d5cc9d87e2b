"""Table operators of the archive, glossary and job stores: search, upserts, deletes, overlays, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import materialize

#: Stages in order, and the seconds that each costs for a second of audio without any history.
STAGES = ("denoise", "asr", "diarization", "merge", "clean", "correction", "llm", "export")
DEFAULT_WEIGHTS = (0.08, 0.30, 0.45, 0.01, 0.01, 0.02, 0.05, 0.01)
LEAST_WEIGHT = 1e-6
K1, B = 1.2, 0.75


def tokens(entries: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The inverted index: a row per key and token with its frequency. Tokens are runs of letters, digits and ``_``, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return entries.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def bm25(entries: DataFrame, terms: list[str], keys: list[str], text: str = "text") -> DataFrame:
    """keys and score of rows in which every term is the beginning of some token; larger is better.

    Document frequencies and lengths are of all rows with tokens. Texts are read once, into a narrow table of lengths and
    frequencies of the terms, which gives the totals and then the scores.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    rows = entries.select(*keys, words.alias("w")).where(F.size("w") > 0)
    counts = [F.size(F.filter("w", _begins(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = materialize(rows.select(*keys, F.size("w").alias("length"), *counts), "frequencies")
    total = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    hits = rows
    for i in range(len(terms)):
        hits = hits.where(F.col(f"tf{i}") > 0)
    hits = hits.crossJoin(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.select(*keys, score.alias("score"))


def _begins(term: str):
    return lambda w: w.startswith(term)


def contains_all(entries: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Rows whose text holds every term anywhere, without case; no score."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    for t in terms:
        entries = entries.where(low.contains(t.lower()))
    return entries


def stale(state: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``current(job_id, mtime)`` that are not indexed as they are."""
    return current.join(state.select("job_id", "mtime"), ["job_id", "mtime"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new``: fields that ``new`` leaves null keep their value, new keys are added."""
    values = [c for c in old.columns if c not in keys]
    both = old.join(new.select(*keys, *(F.col(c).alias(f"_{c}") for c in values)), keys, "full")
    return both.select(*keys, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in values))


def patch(old: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Partial update: a null change leaves a field, an empty one clears it."""
    both = old.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in values)), key, "left")
    set_to = {c: F.when(F.col(f"_{c}").isNotNull(), F.nullif(F.trim(f"_{c}"), F.lit(""))).otherwise(F.col(c)) for c in values}
    return both.withColumns(set_to).drop(*(f"_{c}" for c in values))


def delete_source(sources: DataFrame, entries: DataFrame, gone: DataFrame, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """Without the sources in ``gone(id)``: their entries go too, or lose the reference."""
    kept = sources.join(gone, "id", "left_anti")
    hit = gone.withColumn("_gone", F.lit(True)).withColumnRenamed("id", "source_id")
    if cascade:
        return kept, entries.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    marked = entries.join(hit, "source_id", "left")
    return kept, marked.withColumn("source_id", F.when(F.col("_gone").isNull(), F.col("source_id"))).drop("_gone")


def overlay(entries: DataFrame, edits: DataFrame, resets: DataFrame) -> DataFrame:
    """Edited texts over entries: a reset beats an edit, the first original text stays."""
    e = edits.select("rec_id", "idx", F.col("text").alias("_edit"))
    r = resets.select("rec_id", "idx", F.lit(True).alias("_reset"))
    rows = entries.join(e, ["rec_id", "idx"], "left").join(r, ["rec_id", "idx"], "left")
    first = F.coalesce("original_text", "text")
    return rows.select(
        "rec_id",
        "idx",
        F.when(F.col("_reset"), first).otherwise(F.coalesce("_edit", "text")).alias("text"),
        F.when(F.col("_reset"), F.lit(None)).when(F.col("_edit").isNotNull(), first).otherwise(F.col("original_text")).alias("original_text"),
        F.when(F.col("_reset"), F.lit(False)).otherwise(F.col("_edit").isNotNull() | F.col("original_text").isNotNull()).alias("edited"),
    )


def import_report(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """added, skipped and total of terms to import: empty ones, repetitions and known keys are skipped."""
    key = [F.lower(F.trim("canonical")).alias("_c"), F.lower(F.trim(F.coalesce("variant", F.lit("")))).alias("_v")]
    keyed = rows.select("pos", *key)
    known = existing.select(*key).distinct().withColumn("_known", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("_c", "_v").orderBy("pos"))
    marked = keyed.withColumn("_n", rank).join(known, ["_c", "_v"], "left")
    added = (F.coalesce("_c", F.lit("")) != "") & (F.col("_n") == 1) & F.col("_known").isNull()
    return marked.agg(F.count_if(added).alias("added"), F.count_if(~added).alias("skipped"), F.count("*").alias("total"))


def profile(jobs: DataFrame, timings: DataFrame) -> DataFrame:
    """stage, weight, samples: median seconds for a second of audio over finished jobs, leaving cached stages out.

    A stage without fresh times takes the median of the medians; without any history all weigh 1.
    """
    done = jobs.where("status = 'done' and duration > 0").select(F.col("id").alias("job_id"), "duration")
    cost = timings.where(~F.col("cached")).where(F.col("stage").isin(*STAGES)).join(done, "job_id").select("stage", (F.greatest("seconds", F.lit(0.0)) / F.col("duration")).alias("cost"))
    fresh = cost.groupBy("stage").agg(F.greatest(F.median("cost"), F.lit(LEAST_WEIGHT)).alias("fresh"), F.count("*").alias("samples"))
    middle = fresh.agg(F.median("fresh").alias("middle"))
    every = fresh.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    rows = every.join(F.broadcast(fresh), "stage", "left").crossJoin(F.broadcast(middle))  # eight rows, one row
    weight = F.coalesce("fresh", F.greatest("middle", F.lit(LEAST_WEIGHT)), F.lit(1.0))
    return rows.select("stage", weight.alias("weight"), F.coalesce("samples", F.lit(0)).alias("samples"))


def _stage_table(weights: DataFrame) -> DataFrame:
    order = weights.sparkSession.createDataFrame(list(zip(STAGES, range(len(STAGES)), DEFAULT_WEIGHTS)), "stage string, place int, default_weight double")
    return F.broadcast(order.join(weights.select("stage", "weight"), "stage", "left"))


def progress_and_eta(jobs: DataFrame, weights: DataFrame) -> DataFrame:
    """percent and eta_seconds of jobs (id, status, stage, fraction, duration): stages before the current one are done."""
    table = _stage_table(weights)
    current = table.select(F.col("stage").alias("stage"), F.col("place").alias("at"))
    rows = jobs.join(F.broadcast(current), "stage", "left").crossJoin(table.select("place", "weight"))  # eight rows a job
    done = F.when(F.col("place") < F.col("at"), F.col("weight")).when(F.col("place") == F.col("at"), F.col("weight") * F.col("fraction")).otherwise(F.lit(0.0))
    out = rows.groupBy("id", "status", "duration").agg(F.sum(done).alias("done"), F.sum("weight").alias("all"))
    percent = F.when(F.col("status") == "done", F.lit(100.0)).otherwise(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("done") / F.col("all") * 100)), 1))
    eta = F.when(F.col("status") == "running", (F.col("all") - F.col("done")) * F.col("duration"))
    return out.select("id", percent.alias("percent"), eta.alias("eta_seconds"))


def estimate(durations: DataFrame, weights: DataFrame, chosen: list[str]) -> DataFrame:
    """Expected seconds of the chosen stages before a run: from history, else from the default costs."""
    per_second = _stage_table(weights).where(F.col("stage").isin(*chosen)).agg(F.sum(F.coalesce("weight", "default_weight")).alias("cost"))
    return durations.crossJoin(F.broadcast(per_second)).select("id", (F.col("cost") * F.col("duration")).alias("seconds"))


def health(jobs: DataFrame) -> DataFrame:
    """id and health of jobs (status, active, since_update, elapsed, expected, fraction): ok, slow or stalled."""
    known = F.coalesce(F.col("expected") > 0, F.lit(False))
    stall = F.when(known, F.greatest(F.lit(60.0), 3 * F.col("expected"))).otherwise(F.lit(60.0))
    share = F.col("fraction") * F.col("expected")
    slow = known & ((F.col("elapsed") >= F.greatest(F.lit(30.0), 2 * F.col("expected"))) | ((share > 0) & (F.col("elapsed") >= F.greatest(F.lit(30.0), 2 * share))))
    state = F.when((F.col("status") == "running") & ~F.col("active"), "stalled").when(F.col("since_update") >= stall, "stalled").when(F.coalesce(slow, F.lit(False)), "slow").otherwise("ok")
    return jobs.select("id", state.alias("health"))


def evict(cache: DataFrame, now: Column, ttl_s: int, most: int) -> DataFrame:
    """Cache entries (cache, key, mtime, size) to drop: past their time, then the oldest beyond the size, never the newest."""
    newest = Window.partitionBy("cache").orderBy(F.desc("mtime"), "key")
    rows = cache.withColumn("_rank", F.row_number().over(newest)).withColumn("_old", (now - F.col("mtime") > ttl_s) & (F.col("_rank") > 1))
    used = F.sum(F.when(F.col("_old"), 0).otherwise(F.col("size"))).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_used", used).where(F.col("_old") | ((F.col("_used") > most) & (F.col("_rank") > 1))).select("cache", "key")
