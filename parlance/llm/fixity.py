"""Merkle fixity audit of archive replicas.

A replica is a table of records with file number, offset and bytes. Records are hashed once; hashes of the records of one
ordered offset range make a leaf, sixteen neighbouring nodes make a node above. A node is a pair of file and range; from a
level on the numbers of files shrink too, so the trees of all files are branches of one tree. Two replicas are compared from the root: below nodes that
agree nothing is looked at, below nodes that differ the children are, down to ranges, and there to records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import materialize

RANGE_BYTES = 1 << 16
FANOUT_BITS = 4
#: Levels on which ranges of one file alone meet: up to 2 ** 20 ranges of 64 KiB come to one node of their file.
FILE_LEVELS = 5
RECORDS_PER_FILE = 1000


def warc_records(pages: DataFrame) -> DataFrame:
    """page_id, file, offset, length and bytes of a WARC response record for each page.

    Records lie in files of up to ``RECORDS_PER_FILE`` consecutive page ids, which may be any numbers of 64 bits, by id and
    then by the digest of their bytes, so rows that repeat an id follow each other. A null id counts as -1; null url and html are empty. An empty table gives no records.
    Records without an id are dealt by a hash of their bytes over files below zero, about ``RECORDS_PER_FILE`` in each.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:sha1:"),
        F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url")).cast("binary")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col("url"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("page_id"), F.col("page_id").isNull().alias("unnamed"), F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("bytes"))
    files = pages.where("page_id is null").count() // RECORDS_PER_FILE + 1
    dealt = F.when(F.col("unnamed"), -1 - F.pmod(F.xxhash64("bytes"), F.lit(files))).otherwise(F.expr(f"page_id div {RECORDS_PER_FILE} - if(page_id % {RECORDS_PER_FILE} < 0, 1, 0)"))
    return rows.withColumns({"file": dealt.cast("long"), "length": F.octet_length("bytes").cast("long")}).drop("unnamed")


def placed(records: DataFrame) -> DataFrame:
    """``records`` with the offset of each in its file."""
    before = Window.partitionBy("file").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def hashed(records: DataFrame) -> DataFrame:
    """Records with sha256 in place of their bytes: all that the trees need, and all that is shuffled."""
    return records.withColumn("sha256", F.sha2("bytes", 256)).drop("bytes")


NODE = ["node_file", "node_range"]


def _leaf() -> dict[str, Column]:
    """The node of a record's offset range."""
    return {"node_file": F.col("file"), "node_range": F.expr(f"offset div {RANGE_BYTES}")}


def _above(level: int) -> dict[str, Column]:
    """The node over a node of ``level``. Shifts of files are unsigned: files below zero come to the same root as all others."""
    file = F.shiftrightunsigned("node_file", FANOUT_BITS) if level >= FILE_LEVELS else F.col("node_file")
    return {"node_file": file, "node_range": F.shiftright("node_range", FANOUT_BITS)}


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels of (node_file, node_range, hash) over ``records(file, offset, length, sha256)``, from ranges to the root."""
    entry = F.struct("offset", "length", "sha256")
    leaf = records.withColumns(_leaf()).groupBy(*NODE).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["offset"], e["length"], e["sha256"])), ",")
    levels = [materialize(leaf.select(*NODE, F.sha2(text, 256).alias("hash")), "tree")]
    while levels[-1].limit(2).count() > 1:
        own = levels[-1].withColumn("entry", F.struct(*NODE, "hash")).withColumns(_above(len(levels) - 1))
        above = own.groupBy(*NODE).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        text = F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["node_file"], e["node_range"], e["hash"])), ",")
        levels.append(materialize(above.select(*NODE, F.sha2(text, 256).alias("hash")), "tree"))
    return levels


def differing_ranges(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """Ranges (node_file, node_range) whose hashes differ or that one replica lacks, found from the roots down."""
    height = max(len(a), len(b))

    def level(t: list[DataFrame], k: int) -> DataFrame:
        if k < len(t):
            return t[k]
        top = t[-1]
        for low in range(len(t) - 1, k):
            top = top.withColumns(_above(low))
        return top

    differ = None
    for k in reversed(range(height)):
        left, right = level(a, k), level(b, k)
        if differ is not None:
            above = differ.withColumnsRenamed({"node_file": "f", "node_range": "r"})
            up = _above(k)
            left, right = (x.withColumns({"f": up["node_file"], "r": up["node_range"]}).join(above, ["f", "r"], "left_semi").drop("f", "r") for x in (left, right))
        both = left.withColumnRenamed("hash", "ha").join(right.withColumnRenamed("hash", "hb"), NODE, "full")
        differ = materialize(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select(*NODE), "differ")
    return differ


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """page_id, file, offset, length, sha256 and status of every record of either replica.

    Takes records with sha256 and offset. Status is ok, damaged (bytes or length differ), missing (not in ``b``) or
    extra (not in ``a``). A record that repeats at one place counts once. Empty replicas agree and give no rows.
    """
    a, b = (materialize(x.dropDuplicates(["file", "offset"]), "records") for x in (a, b))
    if not a.take(1) or not b.take(1):
        suspects_a, suspects_b, sound = a, b, a.limit(0)
    else:
        ranges = differing_ranges(tree(a), tree(b))
        a = a.withColumns(_leaf())
        suspects_a = a.join(ranges, NODE, "left_semi")
        suspects_b = b.withColumns(_leaf()).join(ranges, NODE, "left_semi")
        sound = a.join(ranges, NODE, "left_anti")
    pair = suspects_a.select("page_id", "file", "offset", "length", "sha256").join(
        suspects_b.select("file", "offset", F.col("page_id").alias("page_b"), F.col("length").alias("length_b"), F.col("sha256").alias("sha_b")), ["file", "offset"], "full"
    )
    status = (
        F.when(F.col("sha256").isNull(), "extra").when(F.col("sha_b").isNull(), "missing").when((F.col("sha256") != F.col("sha_b")) | (F.col("length") != F.col("length_b")), "damaged").otherwise("ok")
    )
    found = pair.select(F.coalesce("page_id", "page_b").alias("page_id"), "file", "offset", F.coalesce("length", "length_b").alias("length"), F.coalesce("sha256", "sha_b").alias("sha256"), status.alias("status"))
    return sound.select("page_id", "file", "offset", "length", "sha256", F.lit("ok").alias("status")).union(found)


def replicas(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed hashes of ``records``, and of a second replica with faults that the page id fixes: changed bytes, and lost records.

    The second is made from the placed records themselves, so each keeps its own place, however often its id repeats.
    """
    changed = F.concat(F.substring("bytes", 1, 40), F.lit("#").cast("binary"), F.expr("substring(bytes, 42, length(bytes) - 41)"))
    both = records.withColumn("spoilt", F.when(F.col("page_id") % 197 == 5, F.sha2(changed, 256)))
    both = materialize(placed(hashed(both)), "replica")
    second = both.where("page_id % 211 <> 17").withColumn("sha256", F.coalesce("spoilt", "sha256"))
    return both.drop("spoilt"), second.drop("spoilt")
