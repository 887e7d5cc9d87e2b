"""Exact deduplication as a stateful stream.

Each document is reduced to the digest of its text without white space. A streaming aggregation keyed by digest keeps,
on disk (RocksDB) and without expiry, how many documents have it, the stable identifier of the one that stays and where
its content lies (file and row). Spark aggregates within each task before it shuffles, so a digest that a third of all
rows share reaches its state as one row from each task. Later runs with the same checkpoint go on from that state.
Rows that hit a known digest are then checked: their full normalised bytes against those of the content located.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import materialize, new_path

WHITE = r"[\x20\x09-\x0D]+"
#: Groups of copies up to this number are broadcast (about 60 bytes each); more of them are joined by a shuffle.
BROADCAST_GROUPS = 300_000
#: Members of one group that are compared in one task with a copy of the content that stays.
MEMBERS_PER_SALT = 2000
#: Columns of the result, and those that it needs on the way: input columns of these names give way to them.
RESULTS = ("keep_id", "group_size", "kept", "text_sha256", "_file", "_row", "_digest", "_here", "_n", "_keep", "_keeper", "_bytes", "_n2", "_keep2", "_keeper2")
#: State on disk, and closed when its task has committed it: an idle store holds some MB of disk for each partition.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def _digested(rows: DataFrame, text: str) -> DataFrame:
    """doc_id, digest, length in code points, and file and row of each document, for a stream or a table."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(
        F.col("doc_id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.length(whole).alias("n_chars"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
    )


def run_stream(spark: SparkSession, path: str, checkpoint: str, text: str = "text", bytes_per_trigger: int = 2**40) -> DataFrame:
    """Feed every file under ``path`` that the checkpoint has not seen into the keyed state; the state, a row per digest.

    ``bytes_per_trigger`` bounds a micro-batch. Returns digest, group_size, keep_id and the place of the content kept.
    """
    table = spark.read.parquet(path)
    if len(files := table.inputFiles()) == 1 and files[0].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]:
        path = f"{path[:-1]}[{path[-1]}]"  # a single file: streams take folders or patterns
    stream = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", str(bytes_per_trigger)).parquet(path)
    # most code points first, then the smallest doc_id; a null doc_id comes last
    rank = F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), "place")
    state = _digested(stream, text).groupBy("digest").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
    with settings(spark, STATE_SETTINGS):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return (
        spark.read.format("statestore")
        .load(checkpoint)
        .select(F.col("key.digest").alias("digest"), F.col("value.count").alias("group_size"), F.col("value.max").alias("best"))
        .select("digest", "group_size", (-F.col("best.minus_id")).alias("keep_id"), F.col("best.place").alias("place"))
    )


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def source_path(docs: DataFrame) -> str:
    """The folder or file that ``docs`` reads whole; of any other frame, a copy in the shared folder."""
    files = docs.inputFiles()
    for path in {*({f.rsplit("/", 1)[0] for f in files} if files else ()), *files[:1]}:
        if docs.sparkSession.read.parquet(path).sameSemantics(docs):
            return path
    return materialize(docs, "documents").inputFiles()[0].rsplit("/", 1)[0]


def exact_dedup(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Every row under ``path`` with doc_id, keep_id, group_size, kept, text_sha256 and its other columns.

    Texts are equal when they are once white space (``[\\x20\\x09-\\x0D]``) is deleted; null counts as empty, and all
    empty texts are one group. Of a group, the row with the most code points in its original text, then the smallest
    doc_id, stays (a null doc_id only if there is no other). A repeated row counts in group_size, and one of the
    repetitions is kept. Columns of the table named like a result column give way to it. An empty table gives no rows.
    """
    table = spark.read.parquet(path)
    if not table.take(1):
        groups = None
        copies = spark.createDataFrame([], "digest binary, group_size long, keep_id long, keeper long")
    else:
        groups = run_stream(spark, path, new_path(spark, "dedup-state"), text).where("group_size > 1")
        copies = materialize(groups.select("digest", "group_size", "keep_id", F.xxhash64("place.file", "place.row").alias("keeper")), "copies")
    few = copies.count() <= BROADCAST_GROUPS
    copies = F.broadcast(copies) if few else copies
    rows = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumns({"_digest": F.unhex(F.sha2(normalised(text), 256)), "_here": F.xxhash64("_file", "_row")}).drop("_file", "_row")
    copies = copies.select(F.col("digest").alias("_digest"), F.col("group_size").alias("_n"), F.col("keep_id").alias("_keep"), F.col("keeper").alias("_keeper"))
    rows = rows.join(copies, "_digest", "left").withColumn("_bytes", F.when(F.col("_n").isNotNull(), normalised(text)))
    if groups is not None:
        rows = _resolve(rows, text)
    result = {
        "keep_id": F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")),
        "group_size": F.coalesce("_n", F.lit(1)).cast("long"),
        "kept": F.col("_n").isNull() | (F.col("_here") == F.col("_keeper")),
        "text_sha256": F.lower(F.hex("_digest")),
    }
    return rows.withColumns(result).drop("_digest", "_here", "_n", "_keep", "_keeper", "_bytes")


def _resolve(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` as they are if the bytes of every hit equal those of the content kept; else groups by the bytes themselves."""
    hits = rows.where("_n is not null")
    salts = F.floor(F.col("_n") / MEMBERS_PER_SALT)
    kept = hits.where("_here = _keeper").select("_digest", F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("_salt"), F.col("_bytes").alias("_content"))
    members = hits.where("_here <> _keeper").select("_digest", F.pmod(F.col("_here"), salts + 1).alias("_salt"), "_bytes")
    different = members.join(kept, ["_digest", "_salt"]).where("_bytes <> _content").select("_digest").distinct()
    different = materialize(different, "different")
    if not different.take(1):
        return rows
    # digests that unequal bytes share: none is known for SHA-256, so these groups are few and small
    rank = F.struct(F.length(text), -F.col("doc_id"), "_here", "doc_id")
    split = hits.join(different, "_digest", "left_semi").groupBy("_digest", "_bytes").agg(F.count("*").alias("_n2"), F.max(rank).alias("_best"))
    split = split.select("_digest", "_bytes", "_n2", F.col("_best.doc_id").alias("_keep2"), F.col("_best._here").alias("_keeper2"))
    rows = rows.join(split, ["_digest", "_bytes"], "left")
    found = F.col("_n2").isNotNull()
    return rows.withColumns({c: F.when(found, F.col(f"{c}2")).otherwise(F.col(c)) for c in ("_n", "_keep", "_keeper")}).drop("_n2", "_keep2", "_keeper2")
