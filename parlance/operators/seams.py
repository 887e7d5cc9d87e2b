"""Seams of overlapping chunks: words that both sides of a boundary recognised, and segments that two chunks say twice.

Chunks overlap, so the last words of a chunk come again at the beginning of the next one. The tail of the earlier chunk is
aligned with the head of the later one, and a tail that the head repeats is cut; the later chunk heard it whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import match_key
from parlance.operators import intervals as I

#: Words within this time of a boundary, and at most so many on each side, are aligned.
CONTEXT_MS, CONTEXT_WORDS = 2000, 30
#: The most words that a boundary cuts, the least share of them that the alignment covers, and how many words the head may
#: have of its own before the alignment begins.
MOST_CUT, LEAST_COVERED, ANCHOR = 25, 0.6, 3
#: Duplicates of neighbouring chunks: least overlap of the shorter segment, or of both together, and least likeness.
LEAST_TIME, LEAST_UNION, LEAST_RATIO, LEAST_JACCARD = 0.6, 0.5, 0.6, 0.6


def matching_blocks(left: str, right: str, longest: int) -> Column:
    """Blocks (a, b, size) of equal elements of two arrays, named by SQL expressions, each up to ``longest`` elements.

    The longest common stretch comes first, of equals the one that begins first on the left, then on the right; what lies
    before it and behind it is aligned in the same way. The pairs of places that agree, each with how long they go on
    agreeing, are found once; the fold then takes one open pair of stretches after another.
    """
    cells = f"""flatten(transform(sequence(0, {longest - 1}), i -> transform(
        filter(sequence(0, {longest - 1}), j -> i < size({left}) and j < size({right}) and get({left}, i) = get({right}, j)),
        j -> struct(i as a, j as b, aggregate(sequence(0, {longest - 1}), 0,
            (n, k) -> if(n = k and i + k < size({left}) and j + k < size({right}) and get({left}, i + k) = get({right}, j + k), n + 1, n)) as size))))"""
    inside = """filter(transform(s.cells, c -> struct(-least(c.size, r.a1 - c.a, r.b1 - c.b) as minus, c.a as a, c.b as b)),
        c -> c.a >= r.a0 and c.b >= r.b0 and c.minus < 0)"""
    step = f"""if(size(s.open) = 0, s, element_at(transform(slice(s.open, 1, 1), r -> element_at(transform(array(array_min({inside})), m -> if(m is null,
        struct(s.cells as cells, slice(s.open, 2, size(s.open)) as open, s.found as found),
        struct(s.cells as cells,
            concat(slice(s.open, 2, size(s.open)), array(struct(r.a0 as a0, m.a as a1, r.b0 as b0, m.b as b1), struct(m.a - m.minus as a0, r.a1 as a1, m.b - m.minus as b0, r.b1 as b1))) as open,
            array_append(s.found, struct(m.a as a, m.b as b, -m.minus as size)) as found))), 1)), 1))"""
    start = f"""struct({cells} as cells, array(struct(0 as a0, size({left}) as a1, 0 as b0, size({right}) as b1)) as open,
        cast(array() as array<struct<a: int, b: int, size: int>>) as found)"""
    return F.expr(f"aggregate(sequence(1, {2 * longest + 1}), {start}, (s, turn) -> {step}, s -> array_sort(s.found))")


def words_to_cut(tails: DataFrame) -> DataFrame:
    """``tails(head, tail, ...)``, arrays of word keys, with n_cut: how many words of the tail the head repeats.

    A block is anchored if it begins within the first words of the head and has two words or ends the tail. From the first
    anchored block on, the tail is cut if blocks cover enough of it. Otherwise a last word of two letters or more that one of
    the first three words of the head goes on from is cut alone.
    """
    rows = tails.withColumn("blocks", matching_blocks("tail", "head", CONTEXT_WORDS))
    anchored = F.filter("blocks", lambda b: (b["b"] <= ANCHOR) & ((b["size"] >= 2) | (b["a"] + b["size"] == F.size("tail"))))
    rows = rows.withColumn("from", F.array_min(F.transform(anchored, lambda b: b["a"])))
    covered = F.aggregate(F.filter("blocks", lambda b: b["a"] >= F.col("from")), F.lit(0), lambda s, b: s + b["size"])
    rows = rows.withColumns({"length": F.size("tail") - F.col("from"), "covered": covered})
    last = F.element_at("tail", -1)
    split = (F.length(last) >= 2) & F.exists(F.slice("head", 1, 3), lambda w: (F.length(w) > F.length(last)) & w.startswith(last))
    whole = F.col("length").between(1, MOST_CUT) & (F.col("covered") / F.col("length") >= LEAST_COVERED)
    return rows.withColumn("n_cut", F.when(whole, F.col("length")).when(split, 1).otherwise(0)).drop("blocks", "from", "length", "covered")


def trim_boundaries(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """``segments(rec_id, chunk, idx, start_ms, end_ms, text, words)`` without the words that the next chunk repeats.

    ``words`` holds (word, start_ms, end_ms) in order; ``chunks(rec_id, chunk, at_ms)`` says where each chunk begins. A
    segment that loses words ends with its last one left and has them as its text; one that loses all goes. Segments
    without words (null or none), and chunks whose next one is missing, stay. Only words near a boundary are gathered, at
    most ``CONTEXT_WORDS`` are aligned, and a chunk's segments alone share a window.
    """
    said = segments.where("size(words) > 0").select("rec_id", "chunk", "idx", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.posexplode("words").alias("pos", "w"))
    key = match_key(F.col("w.word"))
    place = F.struct("s", "e", "idx", "pos", key.alias("key"))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    # the boundary after a chunk is where the next one begins
    following = chunks.select("rec_id", (F.col("chunk") - 1).alias("chunk"), F.col("at_ms").alias("next_ms"))
    tail = said.join(following, ["rec_id", "chunk"]).where(F.col("w.end_ms") >= F.col("next_ms") - CONTEXT_MS)
    tail = tail.groupBy("rec_id", "chunk").agg(F.array_sort(F.collect_list(place)).alias("x"))
    tail = tail.select("rec_id", "chunk", keys(F.expr(f"slice(x, greatest(size(x) - {CONTEXT_WORDS - 1}, 1), {CONTEXT_WORDS})")).alias("tail"))
    head = said.join(chunks, ["rec_id", "chunk"]).where(F.col("w.start_ms") <= F.col("at_ms") + CONTEXT_MS)
    head = head.groupBy("rec_id", (F.col("chunk") - 1).alias("chunk")).agg(F.array_sort(F.collect_list(place)).alias("x"))
    head = head.select("rec_id", "chunk", keys(F.slice("x", 1, CONTEXT_WORDS)).alias("head"))
    cuts = words_to_cut(tail.join(head, ["rec_id", "chunk"])).where("n_cut > 0").select("rec_id", "chunk", "n_cut")
    rows = segments.join(cuts, ["rec_id", "chunk"], "left")
    later = Window.partitionBy("rec_id", "chunk").orderBy(F.desc("start_ms"), F.desc("end_ms"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.greatest(F.size("words"), F.lit(0))
    taken = F.least(n, F.greatest(F.coalesce("n_cut", F.lit(0)) - F.coalesce(F.sum(n).over(later), F.lit(0)), F.lit(0))).cast("int")
    rows = rows.withColumn("_taken", taken).where((F.col("_taken") == 0) | (F.col("_taken") < n))
    left = F.slice("words", 1, n - F.col("_taken"))
    shorter = F.col("_taken") > 0
    rows = rows.withColumns({
        "words": F.when(shorter, left).otherwise(F.col("words")),
        "end_ms": F.when(shorter, F.element_at(left, -1)["end_ms"]).otherwise(F.col("end_ms")),
        "text": F.when(shorter, F.array_join(F.transform(left, lambda w: w["word"]), " ")).otherwise(F.col("text")),
    })
    return rows.select(*segments.columns)


def matched_characters(left: str, right: str) -> int:
    """Characters of two texts in matching blocks, as ``matching_blocks`` chooses them, in memory in proportion to one text."""
    a, b = (np.array([*map(ord, t)], dtype=np.int64) for t in (left, right))
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a0, a1, b0, b1 = open_parts.pop()
        run, best, at = np.zeros(b1 - b0 + 1, dtype=np.int64), 0, (0, 0)
        for i in range(a0, a1):
            # how long the common stretch is that ends at i and at each place on the right
            run[1:] = np.where(b[b0:b1] == a[i], run[:-1] + 1, 0)
            j = int(run.argmax())
            if run[j] > best:
                best, at = int(run[j]), (i + 1, b0 + j)
        if best:
            total += best
            open_parts += [(a0, at[0] - best, b0, at[1] - best), (at[0], a1, at[1], b1)]
    return total


def likeness(left: str, right: str) -> Column:
    """Twice the characters in matching blocks over all characters of two columns of texts, not both empty."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([2 * matched_characters(x, y) / (len(x) + len(y)) for x, y in zip(a, b)], dtype=float)

    return ratio(left, right)


def duplicate_pairs(segments: DataFrame) -> DataFrame:
    """rec_id, idx, r_idx of segments of different chunks that say the same at the same time; each pair in both directions.

    They overlap by ``LEAST_TIME`` of the shorter one, or ``LEAST_UNION`` of the time of both; without case and punctuation
    one text holds the other, or their words or their characters are alike. The cheapest test that says yes decides, and
    characters are aligned only for pairs that have enough of them in common in any order. Segments meet in time bins as
    wide as they last on average, so they fall in two or three bins each on average, and few share one.
    """
    rows = segments.select("rec_id", "idx", "chunk", "start_ms", "end_ms", match_key("text").alias("key")).where("end_ms > start_ms and key <> ''")
    right = rows.select("rec_id", *(F.col(c).alias(f"r_{c}") for c in ("idx", "chunk", "key")), F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    lasting = rows.agg(F.avg(F.col("end_ms") - F.col("start_ms"))).first()[0]
    shorter = F.least(F.col("end_ms") - F.col("start_ms"), F.col("r_end") - F.col("r_start"))
    union = F.greatest("end_ms", "r_end") - F.least("start_ms", "r_start")
    earlier = F.struct("start_ms", "end_ms", "idx") < F.struct("r_start", "r_end", "r_idx")  # which side is aligned with which counts
    met = I.overlap_join(rows, right, ["rec_id"], bin_ms=int(lasting or 0) + 1).where((F.col("chunk") != F.col("r_chunk")) & earlier)
    met = met.where((I.overlap() >= LEAST_TIME * shorter) | (I.overlap() >= LEAST_UNION * union))
    a, b = F.array_distinct(F.split("key", " ")), F.array_distinct(F.split("r_key", " "))
    alike = F.size(F.array_intersect(a, b)) >= LEAST_JACCARD * F.size(F.array_union(a, b))
    sure = F.contains("r_key", "key") | F.contains("key", "r_key") | alike
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x))
    shared = F.aggregate(F.array_distinct(letters(F.col("key"))), F.lit(0), lambda s, x: s + F.least(count(F.col("key"), x), count(F.col("r_key"), x)))
    met = met.select("rec_id", "idx", "r_idx", "key", "r_key", sure.alias("sure"), (2 * shared / (F.length("key") + F.length("r_key"))).alias("most"))
    plain = met.where("sure").select("rec_id", "idx", "r_idx")
    aligned = met.where(~F.col("sure") & (F.col("most") >= LEAST_RATIO)).where(likeness("key", "r_key") >= LEAST_RATIO).select("rec_id", "idx", "r_idx")
    pairs = plain.unionByName(aligned)
    return pairs.unionByName(pairs.select("rec_id", F.col("r_idx").alias("idx"), F.col("idx").alias("r_idx")))


def without_chunk_duplicates(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """``segments(rec_id, chunk, idx, start_ms, end_ms, text)``, each thing said once; ``chunks(rec_id, chunk, middle_ms)``.

    In order of time, a segment that repeats one already there takes its place if it lies nearer the middle of its chunk, or
    as near with a longer text; else it goes. Only segments with a duplicate take part in that fold, and each stretch of
    them that overlap in time by itself. Segments without time or words stay.
    """
    pairs = duplicate_pairs(segments)
    twins = pairs.groupBy("rec_id", "idx").agg(F.collect_set("r_idx").alias("twins"))
    off = F.abs((F.col("start_ms") + F.col("end_ms")) / 2 - F.col("middle_ms"))
    rows = segments.join(twins, ["rec_id", "idx"]).join(chunks, ["rec_id", "chunk"]).select("rec_id", "idx", "start_ms", "end_ms", "twins", off.alias("off"), F.length("text").alias("size"))
    by_time = Window.partitionBy("rec_id").orderBy("start_ms", "end_ms", "idx")
    new = F.coalesce(F.col("start_ms") >= F.max("end_ms").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("_new", new.cast("int")).withColumn("_stretch", F.sum("_new").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy("rec_id", "_stretch").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "idx", "off", "size", "twins"))).alias("x"))
    # places in the result: the first one that holds a twin is contested
    kept = F.expr("""aggregate(x, slice(x, 1, 0), (s, own) -> element_at(transform(array(array_position(transform(s, o -> array_contains(own.twins, o.idx)), true)),
        p -> if(p = 0, array_append(s, own), transform(s, (o, k) -> if(k + 1 = p and (own.off < o.off or (own.off = o.off and own.size > o.size)), own, o)))), 1))""")
    stays = stretches.select("rec_id", F.explode(F.transform(kept, lambda o: o["idx"])).alias("idx"))
    gone = rows.select("rec_id", "idx").join(stays, ["rec_id", "idx"], "left_anti")
    return segments.join(gone, ["rec_id", "idx"], "left_anti")
