"""A kept inverted index over transcript entries: refreshed for changed jobs only, searched by prefixes with BM25.

Two tables under one path. ``postings`` has a row for each token of an entry, with its frequency and the entry's length, in
folders by generation and by a bucket of the token's first two letters, sorted by token. ``jobs`` has a row each time that a
job is indexed or removed, with the generation that holds its postings; a job's last row counts. A refresh writes the postings of
changed jobs as a new generation, and the rows of those jobs last: a refresh that dies in between changes nothing, and the
next one writes that generation again. A search reads the buckets of its terms, within them the row groups whose tokens can
begin with a term, and drops postings of generations that are no longer those of their job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.store import B, K1, stale
from parlance.session import materialize

#: Folders of a generation.
BUCKETS = 64
TOKEN = r"[\p{L}\p{M}\p{N}_]+"
JOBS = "job_id {job}, mtime {mtime}, n_entries long, n_tokens long, removed boolean, generation int"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(BUCKETS)).cast("int")


class SearchIndex:
    """The index under ``path``. Writers take turns: two refreshes at once are an error of the caller."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, job: str = "long", mtime: str = "timestamp") -> SearchIndex:
        """An empty index; ``job`` and ``mtime`` are the types of job ids and of their times of change."""
        index = cls(spark, path)
        spark.createDataFrame([], JOBS.format(job=job, mtime=mtime)).write.parquet(f"{index.path}/jobs")
        return index

    def jobs(self) -> DataFrame:
        """job_id, mtime, n_entries, n_tokens, generation of every job indexed now."""
        every = self.spark.read.parquet(f"{self.path}/jobs")
        last = every.groupBy("job_id").agg(F.max_by(F.struct("mtime", "n_entries", "n_tokens", "removed", "generation"), "generation").alias("j"))
        return last.select("job_id", "j.*").where("not removed").drop("removed")

    def refresh(self, jobs: DataFrame, entries: DataFrame) -> DataFrame:
        """Index the jobs of ``jobs(job_id, mtime)`` that are new or changed, forget those that are gone; what was written.

        ``entries(job_id, entry, speaker, text)`` is read for changed jobs only. A null text has no tokens, and entries
        without tokens are not counted. Repeated job ids are an error of the caller. Returns the rows added to the job table.
        """
        last = self.spark.read.parquet(f"{self.path}/jobs").agg(F.max("generation")).first()[0] or 0
        state = self.jobs()
        changed = materialize(stale(state, jobs), "changed")
        words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
        rows = entries.join(changed.select("job_id"), "job_id", "left_semi").select("job_id", "entry", "speaker", words.alias("w")).where("size(w) > 0")
        rows = rows.withColumn("length", F.size("w"))
        postings = rows.select("job_id", "entry", "speaker", "length", F.explode("w").alias("token")).groupBy("token", "job_id", "entry", "speaker", "length").agg(F.count("*").cast("int").alias("tf"))
        # ranges by token split frequent tokens over files; a file holds few buckets
        postings = postings.withColumn("bucket", bucket(F.col("token"))).repartitionByRange("bucket", "token", "job_id").sortWithinPartitions("bucket", "token")
        postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={last + 1}")
        sizes = rows.groupBy("job_id").agg(F.count("*").alias("n_entries"), F.sum("length").alias("n_tokens"))
        kept = changed.join(sizes, "job_id", "left").select("job_id", "mtime", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.lit(False).alias("removed"))
        gone = state.join(jobs.select("job_id"), "job_id", "left_anti").select("job_id", "mtime", F.lit(0).alias("n_entries"), F.lit(0).alias("n_tokens"), F.lit(True).alias("removed"))
        written = materialize(kept.unionByName(gone).withColumn("generation", F.lit(last + 1)), "refreshed")
        written.write.mode("append").parquet(f"{self.path}/jobs")
        return written

    def postings(self, terms: list[str]) -> DataFrame:
        """Postings of tokens that begin with one of ``terms``, of the generations that count."""
        read = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings/generation=*")
        begins = F.lit(False)
        for t in terms:
            own = F.col("token").startswith(t)
            if len(t) > 1:  # all tokens that begin so are in one bucket
                first = self.spark.range(1).select(bucket(F.lit(t))).first()[0]
                own = own & (F.col("bucket") == first)
            begins = begins | own
        return read.where(begins).join(self.jobs().select("job_id", "generation"), ["job_id", "generation"], "left_semi")

    def search(self, terms: list[str], jobs: DataFrame | None = None, speaker: str | None = None) -> DataFrame:
        """job_id, entry, score of entries in which every term begins some token; larger scores are better.

        Frequencies and lengths are those of the whole index; ``jobs(job_id)`` and ``speaker`` restrict the hits. Terms are
        taken in lower case; none, or an empty index, give no hits.
        """
        terms = [t.lower() for t in terms if t]
        counts = [F.sum(F.when(F.col("token").startswith(t), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        if not terms or not self.jobs().where("n_entries > 0").take(1):
            empty = self.jobs().withColumn("score", F.lit(0.0)).where("false")
            return empty.select("job_id", F.lit(0).cast("long").alias("entry"), "score")
        found = self.postings(terms).groupBy("job_id", "entry", "speaker", "length").agg(*counts)
        found = materialize(found, "found")
        frequent = found.agg(*(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
        total = self.jobs().agg(F.sum("n_entries").alias("n"), (F.sum("n_tokens") / F.sum("n_entries")).alias("mean"))
        hits = found
        for i in range(len(terms)):
            hits = hits.where(F.col(f"tf{i}") > 0)
        if jobs is not None:
            hits = hits.join(jobs.select("job_id"), "job_id", "left_semi")
        if speaker is not None:
            hits = hits.where(F.col("speaker") == speaker)
        hits = hits.crossJoin(F.broadcast(frequent)).crossJoin(F.broadcast(total))  # one row each
        score = F.lit(0.0)
        for i in range(len(terms)):
            idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
            score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
        return hits.select("job_id", "entry", score.alias("score"))

    def compacted(self, path: str) -> SearchIndex:
        """The same index under another path, with one generation and without postings that no longer count."""
        state = self.jobs()
        other = SearchIndex(self.spark, path)
        read = self.spark.read.option("basePath", f"{self.path}/postings").parquet(f"{self.path}/postings/generation=*")
        live = read.join(state.select("job_id", "generation"), ["job_id", "generation"], "left_semi").drop("generation")
        live = live.repartitionByRange("bucket", "token", "job_id").sortWithinPartitions("bucket", "token")
        live.write.partitionBy("bucket").parquet(f"{other.path}/postings/generation=1")
        state.withColumns({"removed": F.lit(False), "generation": F.lit(1)}).select(*self.spark.read.parquet(f"{self.path}/jobs").columns).write.parquet(f"{other.path}/jobs")
        return other
