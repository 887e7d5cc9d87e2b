"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles have one global order, rarest first by counts of all shingles in buckets. A prefix of ``size - needed + l``
shingles leaves out ``needed - l``, so two sets that share enough shingles share some of them in their prefixes, and the
more the longer the prefixes are. A document for which the counts foresee many candidates takes a longer prefix (a
greater l), and its candidates must share correspondingly more of it before their whole sets are compared.

Documents with one set of shingles are one class, and only classes are joined. First every prefix shingle's list of
classes is compared with its most typical member, the hub, and linked classes are joined into components. Then only lists
that still hold several components matter, and there only classes in different components. A short list gives its pairs,
and lists of one hub count as one where that has fewer (``_fewest_pairs``), since near copies of a long text meet in hundreds
of them. A long one would give the square of its length, so its members must share more than that one shingle: each is written as
its difference from the hub, in which all that the group has in common is gone, and the differences are joined by
prefixes of their own, as long as the number of shingles allows that two members must share there to link (``_step``).
Both steps lose nothing: every link between different components is found.

These phases find components, not every link. All links lie within components, so ``jaccard_links`` and
``jaccard_counts`` compare the classes of each component with each other, whole sets in salted blocks. That work, like
the number of links, grows with the square of the classes in a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.graph import components
from parlance.llm.words import mix, shingle_sets
from parlance.session import materialize

#: Buckets of the shingle counts that order the prefixes; the counts cover all shingles.
BUCKETS = 1 << 18
#: The longest adaptive prefix asks for this many shared shingles.
MOST_SHARED = 8
#: 64-bit words of the bit map of a prefix, which bounds what two prefixes share.
MAP_WORDS = 16
#: What verifying a candidate costs against reading one entry of a list.
VERIFY_COST = 16.0
#: Class ids up to this number are broadcast to fetch their texts (about 80 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A list up to this length gives its pairs; members of a longer one that are like its hub meet by their differences from
#: it, in so many steps at most, each within the lists that the last one left long.
SHORT_LIST, STEPS = 64, 2
#: Differences from a hub are taken if so much of its list links with it, directly or not.
CENTRAL = 0.2
#: Members that are compared with one hub in a task, about.
HUB_SHARE = 2000
#: Classes of a component that are compared at a time, about; and columns of shingles in one matrix product.
BLOCK, COLUMNS = 64, 4096


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _rarest_first(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.lexsort((shingles, counts[(shingles % np.uint64(BUCKETS)).astype(np.int64)]))


def bucket_counts(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """How many documents' distinct shingles fall in each bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), n):
                np.add.at(total, (s % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def choose_shared(counts: np.ndarray, base: int, needed: int, usual: float) -> int:
    """How many shared shingles to ask for: the l of least estimated cost of lists read and candidates verified."""
    more = np.cumsum(np.maximum(0.0, counts[: base + MOST_SHARED - 1] - usual))
    best, least = 1, None
    for shared in range(1, min(MOST_SHARED, needed) + 1):
        read = more[min(base + shared - 1, len(more)) - 1]
        cost = read * (1.0 + VERIFY_COST / shared)
        if least is None or cost < least:
            best, least = shared, cost
    return best


def summaries(docs: DataFrame, n: int, percent: int, shared_counts: Broadcast, text: str = "text") -> DataFrame:
    """Of each document: size and key of its shingle set, how common its shingles are, its prefix, rarest first."""
    mean = shared_counts.value.sum() / BUCKETS
    usual = float(mean + 3 * np.sqrt(mean) + 1)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = shared_counts.value
        for batch in batches:
            sizes, k1, k2, typical, prefixes, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                size = len(s)
                needed = -(-percent * size // 100)
                base = size - needed + 1
                c = bucket[(s % np.uint64(BUCKETS)).astype(np.int64)]
                order = _rarest_first(s, bucket)
                more = choose_shared(c[order].astype(float), base, needed, usual) if size else 1
                order = order[: base + more - 1]
                sizes.append(size)
                k1.append(int(mix(s).sum(dtype=np.uint64)) if size else 0)
                k2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if size else 0)
                typical.append(float(np.log1p(c).mean()) if size else 0.0)
                prefixes.append(s[order])
                bit = mix(s[order] + np.uint64(2)) % np.uint64(64 * MAP_WORDS)
                own = np.zeros(MAP_WORDS, dtype=np.uint64)
                np.bitwise_or.at(own, (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
                maps.append(own)
            if not sizes:
                continue
            lengths = np.array([len(p) for p in prefixes])
            flat = np.concatenate(prefixes)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), _signed(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), _signed(np.array(k1, dtype=np.uint64)), _signed(np.array(k2, dtype=np.uint64)), pa.array(typical, pa.float64()), lists, *(_signed(m) for m in np.stack(maps, axis=1))],
                names=["doc_id", "n_shingles", "k1", "k2", "typical", "prefix", *(f"m{k}" for k in range(MAP_WORDS))],
            )

    schema = "doc_id long, n_shingles long, k1 long, k2 long, typical double, prefix array<long>" + "".join(f", m{k} long" for k in range(MAP_WORDS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(summarise, schema)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its rows, ``rows`` in number, are few."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def _sets(docs: DataFrame, ids: DataFrame, rows: int, n: int, text: str, counts: Broadcast | None = None) -> DataFrame:
    """id, k1, set of the documents whose id is in ``ids(id)``, of which there are ``rows``; rarest first by ``counts``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), n))
            own = batch.column(0).to_pylist()
            keys = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            fresh = [i for i, key in enumerate(zip(own, keys)) if key not in seen and not seen.add(key)]  # repeated rows
            for at in range(0, len(fresh), 64):
                part = fresh[at : at + 64]
                offsets = pa.array(np.r_[0, np.cumsum([len(sets[i]) for i in part])].astype(np.int32))
                held = [sets[i] if counts is None else sets[i][_rarest_first(sets[i], counts.value)] for i in part]
                lists = pa.ListArray.from_arrays(offsets, _signed(np.concatenate(held)))
                yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in part], pa.int64()), pa.array([keys[i] for i in part], pa.int64()), lists], names=["id", "k1", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).join(_small(ids, rows), "id", "left_semi")
    return texts.mapInArrow(whole, "id long, k1 long, set array<long>")


def _similar(inter: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * inter >= F.lit(percent) * (a + b - inter)


def _compared(pairs: DataFrame, docs: DataFrame, keys: DataFrame, n: int, text: str, counts: Broadcast) -> DataFrame:
    """a, b, sa, sb, n_shared of the pairs (a, b): their whole sets, rarest shingles first, and what these share.

    Sets are made where their texts are read. Those of ``a`` move once, to those of ``b``; the members of a ``b`` with
    many of them are dealt over several tasks. A doc_id that repeats with another text is told apart by its set's key.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    rows = pairs.count()
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
    b = shares.join(keys.select(F.col("id").alias("b"), F.col("k1").alias("kb")), "b")
    b = materialize(b, "hubs")
    a = pairs.join(keys.select(F.col("id").alias("a"), F.col("k1").alias("ka")), "a").join(_small(b.select("b", "shares"), rows), "b")
    a = materialize(a.select("a", "ka", "b", F.expr("cast(pmod(xxhash64(a), shares) as int)").alias("share")), "pairs")
    own = _sets(docs, a.select(F.col("a").alias("id")).distinct(), rows, n, text, counts).select(F.col("id").alias("a"), F.col("k1").alias("ka"), F.col("set").alias("sa"))
    hub = _sets(docs, b.select(F.col("b").alias("id")), rows, n, text, counts).select(F.col("id").alias("b"), F.col("k1").alias("kb"), F.col("set").alias("sb"))
    hub = hub.join(_small(b, rows), ["b", "kb"]).withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
    both = own.join(_small(a, rows), ["a", "ka"]).join(hub, ["b", "share"])
    return both.select("a", "b", "sa", "sb", F.size(F.array_intersect("sa", "sb")).alias("n_shared"))


def _verified(pairs: DataFrame, docs: DataFrame, keys: DataFrame, n: int, percent: int, text: str, counts: Broadcast) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = _compared(pairs, docs, keys, n, text, counts)
    return both.where(_similar(F.col("n_shared"), F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _step(long: DataFrame, docs: DataFrame, keys: DataFrame, n: int, percent: int, text: str, counts: Broadcast) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, and two kinds of lists (hub, token, id, component, typical) in which those of ``long`` meet that may still link.

    ``long`` has the same columns: lists, each with its hub. The first kind are lists of differences, the second what is
    left of the lists as they were.

    Write d(x) for the shingles that only one of x and its hub has. What a and b do not share is what d(a) and d(b) do
    not, so that, with p for ``percent``, t(x) = (100 + p) |d(x)| - (100 - p) |x|, and s for the size of what d(a) and
    d(b) share, a and b link if and only if 2 (100 + p) s >= t(a) + t(b). Thus

    * members link with the hub if t <= (100 - p) |hub|: of two that do, the component is the same;
    * members link with the one of smallest t if both t together are at most 0, whatever they share. Of all pairs with
      such a sum both then lie in that one's component, and other pairs share a shingle of d at least;
    * a pair not both of which link with the hub has a lower bound of t(b): from the sizes, or because |d(b)| can be smaller
      than |d(a)| only by what a and b may differ in. So each a must share some number s of d(a), and does so within the
      first |d(a)| - s + 1 of them in any order that is the same for all members of the hub.

    That order takes shingles which the hub lacks first, rarest first: edits of its own that a member shares with none.

    Members that have little to do with the hub stay in their list, without the others, as another hub would say no more of
    them: |d| of two that link differs by no more than they themselves do, so a member with |d| <= |x| / 2 links with none
    whose |d| is beyond that by as much.
    """
    held = long.where("id <> hub").select("id", "hub", "component", "typical").distinct()
    both = _compared(held.select(F.col("id").alias("a"), F.col("hub").alias("b")), docs, keys, n, text, counts)
    apart = F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))
    both = both.select(F.col("a").alias("id"), F.col("b").alias("hub"), F.size("sa").alias("size"), F.size("sb").alias("hub_size"), apart.alias("apart"))
    t = F.expr(f"{100 + percent}L * size(apart) - {100 - percent}L * size")
    # of a partner with t >= (100 + p) * | |x| - |hub| | - (100 - p) * |x| and a near size, the least t is at the size nearest to the hub's
    nearest = F.expr(f"least(greatest(hub_size, ceil({percent} * size / 100)), floor(100 * size / {percent}))")
    linked = F.col("t") <= F.lit(100 - percent) * F.col("hub_size")
    partner = F.when(linked, F.lit(100 - percent) * F.col("hub_size") + 1).otherwise(F.lit(100 + percent) * F.abs(nearest - F.col("hub_size")) - F.lit(100 - percent) * nearest)
    largest = F.expr(f"floor(100 * size / {percent})")
    most = F.floor(F.lit(100 - percent) * (F.col("size") + largest) / (100 + percent))
    shared = F.greatest(F.lit(1), F.size("apart") - most, F.ceil((F.col("t") + partner) / F.lit(2 * (100 + percent))))
    length = F.greatest(F.lit(0), F.size("apart") - shared + 1).cast("int")
    near = F.size("apart") <= F.col("size") / 2 + F.lit(1.5) * (most + 1)
    prefix = F.when(near, F.slice("apart", F.lit(1), length)).otherwise(F.array().cast("array<bigint>"))
    both = both.withColumn("t", t).select("id", "hub", "hub_size", "t", prefix.alias("prefix"), (F.size("apart") > F.col("size") / 2).alias("far"))
    both = materialize(both.join(held, ["id", "hub"]), "apart")
    least = both.groupBy("hub").agg(F.min(F.struct("t", "id")).alias("least"))
    free = both.join(_small(least, least.count()), "hub").where(F.col("t") + F.col("least.t") <= 0)
    links = both.where(linked).select(F.col("id").alias("a"), F.col("hub").alias("b")).union(free.select(F.col("id").alias("a"), F.col("least.id").alias("b")))
    columns = ["hub", "token", "id", "component", "typical"]
    alike = both.withColumn("token", F.explode("prefix")).select(columns)
    others = long.join(both.where("far").select("id", "hub"), ["id", "hub"]).withColumn("token", F.xxhash64("token")).select(columns)
    return links.where("a <> b"), alike, others


def _near_size(a: str, b: str, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _needed(percent: int) -> Column:
    """How many shingles two sets of the sizes of a and b share if they are similar enough."""
    return F.ceil(F.lit(percent) * (F.col("n_shingles_a") + F.col("n_shingles_b")) / (100 + percent))


def _enough(percent: int) -> Column:
    """Whether the prefixes of a and b share as many shingles as two sets that are similar enough must share there."""
    needed = _needed(percent)
    beyond = F.greatest(F.col("n_shingles_a") - F.size("prefix_a"), F.col("n_shingles_b") - F.size("prefix_b"))
    # a fold of two shingles of one prefix counts once: shingles that the fold may have lost are added back
    lost = F.least(F.size("prefix_a") - F.size(F.array_distinct("prefix_a")), F.size("prefix_b") - F.size(F.array_distinct("prefix_b")))
    return F.size(F.array_intersect("prefix_a", "prefix_b")) + lost >= needed - beyond


def _signed_lists(lists: DataFrame, key: list[str], *more: Column) -> DataFrame:
    """key, length and two hashes of the members of each list, and ``more`` of it."""
    return lists.groupBy(*key).agg(F.count("*").alias("length"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 30)).alias("y"), *more)


def _once(lists: DataFrame, key: list[str]) -> DataFrame:
    """Of the ``_signed_lists`` with equal members (and all but the last column of ``key``) one: they give equal pairs."""
    *group, last = key
    return lists.groupBy(*group, "length", "x", "y").agg(F.min(last).alias(last)).select(*key, "length")


def _mixed(lists: DataFrame, key: list[str]) -> DataFrame:
    """key and length of the ``lists`` whose members lie in several components; of lists with equal members, one."""
    return _once(_signed_lists(lists, key, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi"), key)


def _fewest_pairs(lists: DataFrame) -> DataFrame:
    """The ``lists(kind, hub, token, id)``; those of a kind and hub are one list if that has fewer pairs than all of them.

    Whoever shares a list shares that one too, so no pair is lost. Two near copies of a long text share hundreds of lists, a
    few words longer or shorter each, and most of these have one hub.
    """
    group = ["kind", "hub"]
    pairs = F.expr("count(*) * (count(*) - 1)")
    apart = lists.groupBy(*group, "token").agg(pairs.alias("pairs")).groupBy(*group).agg(F.sum("pairs").alias("apart"))
    members = lists.select(*group, "id").distinct()
    fewer = members.groupBy(*group).agg(pairs.alias("pairs")).join(apart, group).where("pairs < apart").select(group)
    fewer = materialize(fewer, "grouped")
    fewer = _small(fewer, fewer.count())
    one = members.join(fewer, group, "left_semi").select(*group, F.lit(0).cast("long").alias("token"), "id")
    return lists.join(fewer, group, "left_anti").select(*group, "token", "id").union(one)


def _joined(docs: DataFrame, n: int, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Summaries of the documents, and k1, k2, n_shingles, class_id, component of every class."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, n, text))
    all_docs = materialize(summaries(docs, n, percent, counts, text), "summaries")
    own = all_docs.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(own.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id")), "classes")
    keys = classes.select("id", "k1")
    maps = [f"m{k}" for k in range(MAP_WORDS)]
    named = own.select(F.col("doc_id").alias("id"), "k1", "n_shingles", "typical", "prefix", *maps).join(_small(keys, classes.count()), ["id", "k1"], "left_semi")
    # similar sets share a shingle of their shortest prefixes; the rest of the longer ones only counts what is shared
    shortest = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1
    posted = named.select("id", F.explode(F.slice("prefix", 1, shortest.cast("int"))).alias("token"))
    shared = _signed_lists(posted, ["token"], F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    shared = materialize(_once(shared, ["token"]).select("token"), "shared")
    lists = materialize(posted.join(shared, "token", "left_semi"), "postings")
    # folded to 32 bits, shingles in common can only grow in number, which admits a pair too many but loses none
    folded = F.transform("prefix", lambda x: F.hash(x))
    about = named.join(lists.select("id").distinct(), "id", "left_semi").select("id", "n_shingles", "typical", folded.alias("prefix"), *maps)
    about = materialize(about.dropDuplicates(["id"]), "about")  # a doc_id that repeats with an equal set is one class
    lists = materialize(lists.join(about.select("id", "n_shingles", "typical"), "id").select("token", "id", "n_shingles", "typical"), "lists")
    hubs = lists.groupBy("token").agg(F.max(F.struct("typical", (-F.col("id")).alias("id"), "n_shingles")).alias("hub"))
    hubs = hubs.select("token", (-F.col("hub.id")).alias("hub"), F.col("hub.n_shingles").alias("hub_size"))

    star = lists.join(hubs, "token").where("id <> hub").where(_near_size("n_shingles", "hub_size", percent)).groupBy("id", "hub").agg(F.count("*").alias("c"))
    side = about.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "n_shingles", "prefix")))
    star = star.select(F.col("id").alias("id_a"), F.col("hub").alias("id_b")).join(about.select(*(F.col(c).alias(f"{c}_a") for c in ("id", "n_shingles", "prefix"))), "id_a").join(side, "id_b")
    star = star.where(_enough(percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    star = materialize(star, "star")
    links = materialize(_verified(star, docs, keys, n, percent, text, counts), "links")
    found = materialize(components(links), "components")

    about = materialize(about.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "about")
    lists = materialize(lists.select("token", "id").join(about.select("id", "component", "typical"), "id"), "labelled")
    held = materialize(lists.join(_mixed(lists, ["token"]), "token").join(hubs.select("token", "hub"), "token"), "mixed")
    # a hub with which few of its list link tells little of the others
    leading = about.select(F.col("id").alias("hub"), F.col("component").alias("own"))
    central = held.where(F.col("length") > SHORT_LIST).join(leading, "hub").groupBy("token").agg(F.avg((F.col("component") == F.col("own")).cast("int")).alias("share"))
    central = materialize(central.where(F.col("share") >= CENTRAL).select("token"), "central")
    short = [held.join(central, "token", "left_anti").select("hub", "token", "id")]
    long = held.join(central, "token", "left_semi")
    for step in range(STEPS):
        if not long.take(1):
            break
        found, parts, others = _step(long, docs, keys, n, percent, text, counts)
        links = links.union(found)
        short.append(others.join(_mixed(others, ["hub", "token"]), ["hub", "token"]).select("hub", "token", "id"))
        parts = materialize(parts.join(_mixed(parts, ["hub", "token"]), ["hub", "token"]), "parts")
        last = F.lit(step == STEPS - 1)
        short.append(parts.where((F.col("length") <= SHORT_LIST) | last).select("hub", "token", "id"))
        long = parts.where((F.col("length") > SHORT_LIST) & ~last)
        next_hubs = long.groupBy("hub", "token").agg((-F.max(F.struct("typical", (-F.col("id")).alias("id")))["id"]).alias("next"))
        long = materialize(long.join(next_hubs, ["hub", "token"]).select(F.col("next").alias("hub"), F.xxhash64("hub", "token").alias("token"), "id", "component", "typical"), "members")

    key = ["kind", "hub", "token"]
    short = materialize(reduce(DataFrame.union, (x.select(F.lit(k).alias("kind"), "hub", "token", "id") for k, x in enumerate(short))), "short")
    short = materialize(_fewest_pairs(short), "paired")
    carried = ["id", "n_shingles", "component", "size", *maps]
    about = about.withColumn("size", F.size("prefix"))
    a, b = (short.join(about.select(carried), "id").select(*key, *(F.col(c).alias(f"{c}_{x}") for c in carried)) for x in "ab")
    near = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & _near_size("n_shingles_a", "n_shingles_b", percent)
    # every bit in which the maps differ is a shingle that only one prefix has
    differ = sum((F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in maps), F.lit(0))
    could = F.floor((F.col("size_a") + F.col("size_b") - differ) / 2) >= _needed(percent) - F.greatest(F.col("n_shingles_a") - F.col("size_a"), F.col("n_shingles_b") - F.col("size_b"))
    pairs = a.join(b, key).where(near & could).select("id_a", "id_b").distinct()
    sides = [about.select(*(F.col(c).alias(f"{c}_{x}") for c in ("id", "n_shingles", "prefix"))) for x in "ab"]
    pairs = pairs.join(sides[0], "id_a").join(sides[1], "id_b").where(_enough(percent)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs, "candidates").join(tried, ["a", "b"], "left_anti")
    links = links.union(_verified(pairs, docs, keys, n, percent, text, counts))
    found = components(links).withColumnRenamed("node", "id")
    counts.destroy()  # all that needs it is written
    named = classes.select("k1", "k2", "n_shingles", "id").join(found, "id", "left")
    named = named.select("k1", "k2", "n_shingles", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"))
    return all_docs, named


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. Two documents link when 100 * intersection >= percent *
    union of their sets of distinct n-word shingles. ``class_id`` is the smallest doc_id with an equal set,
    ``component_id`` the smallest reachable by links. Documents without words (null, empty, blank) have an empty set, link
    with nothing and are their own class. Rows without a doc_id take no part in linking; repeated rows share a class.
    An empty table gives no rows; other columns are not read.
    """
    return _documents(*_joined(docs, n, percent, text)).drop("k1", "k2")


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """a, b, n_shared, n_union of every two classes that link: a < b are their class_id, the sets share ``n_shared``.

    Every link is there, also within components. Members of one class have equal sets and are no links here. Texts, null
    ids and empty sets count as in ``jaccard_components``.
    """
    _, classes = _joined(docs, n, percent, text)
    found = _all_links(docs, materialize(classes, "classes"), n, percent, text)
    return found.where("a < b").groupBy("a", "b").agg(F.max(F.struct("n_shared", "n_union")).alias("best")).select("a", "b", "best.*")


def jaccard_counts(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``jaccard_components`` with n_links: how many other rows have an equal or a similar enough set."""
    all_docs, classes = _joined(docs, n, percent, text)
    classes = materialize(classes, "classes")
    links = _all_links(docs, classes, n, percent, text)
    key = ["k1", "k2", "n_shingles"]
    rows = all_docs.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.count("*").alias("rows"))
    rows = materialize(classes.join(rows, key).select(*key, "class_id", "rows"), "rows")
    ends = links.select("a", "ka", "b", "kb").union(links.select("b", "kb", "a", "ka")).toDF("class_id", "k1", "other", "ko")
    other = rows.select(F.col("class_id").alias("other"), F.col("k1").alias("ko"), F.col("rows").alias("n"))
    linked = ends.join(other, ["other", "ko"]).groupBy("class_id", "k1").agg(F.sum("n").alias("n"))
    counts = rows.join(linked, ["class_id", "k1"], "left").select(*key, (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = _documents(all_docs, classes).join(counts, key, "left")
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def _all_links(docs: DataFrame, classes: DataFrame, n: int, percent: int, text: str) -> DataFrame:
    """a, ka, b, kb, n_shared, n_union of every two ``classes`` that link, each pair once (by id, then by key).

    Classes of a component are dealt into blocks by a hash, and every two blocks are one group: a set is copied once for
    each block of its component, and no group grows with the component.
    """

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        ids, keys, block = (table.column(c).to_numpy() for c in ("id", "k1", "block"))
        sets = table.column("set").combine_chunks()
        _, first = np.unique(np.stack([ids, keys]), axis=1, return_index=True)  # repeated rows
        rows = first[np.lexsort((keys[first], ids[first]))]
        ids, keys, block = ids[rows], keys[rows], block[rows]
        lists = [sets[int(r)].values.to_numpy() for r in rows]
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        own = np.flatnonzero(times[column] > 1)
        own = own[np.argsort(column[own], kind="stable")]
        _, column = np.unique(column[own], return_inverse=True)
        owner = owner[own]
        shared = np.zeros((len(left), len(right)), dtype=np.int64)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((len(rows), COLUMNS), dtype=np.float32)
            held[owner[lo:hi], column[lo:hi] - at] = 1
            shared += np.rint(held[left] @ held[right].T).astype(np.int64)
        union = sizes[left][:, None] + sizes[right] - shared
        found = (shared > 0) & (100 * shared >= percent * union)
        if i == j:
            found &= left[:, None] < right
        x, y = np.nonzero(found)
        a, b = np.minimum(left[x], right[y]), np.maximum(left[x], right[y])
        columns = [ids[a], keys[a], ids[b], keys[b], shared[x, y], union[x, y]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "ka", "b", "kb", "n_shared", "n_union"])

    groups = classes.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    members = classes.join(groups, "component").select("component", F.col("class_id").alias("id"), "k1", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = materialize(members.withColumn("block", F.expr("pmod(xxhash64(id, k1), blocks)")), "members")
    rows = members.count()
    sets = _sets(docs, members.select("id").distinct(), rows, n, text).join(_small(members, rows), ["id", "k1"])
    sets = sets.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    sets = sets.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "k1", "set")
    return materialize(sets.groupBy("component", "i", "j").applyInArrow(compare, "a long, ka long, b long, kb long, n_shared long, n_union long"), "links")


def _documents(all_docs: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and the keys of every document's set."""
    out = all_docs.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    linked = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", "k1", "k2", F.when(linked, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(linked, F.coalesce("component", "doc_id")).alias("component_id"))
