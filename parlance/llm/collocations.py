"""Phrases that occur often, and how strongly their parts attract each other, by Toivonen's sampling with a negative border.

A sample of the documents proposes phrases: those that are frequent in it at a lowered limit. A pass over all documents
counts the proposed phrases and their negative border, the phrases that were not proposed but whose two parts (all but the
last word, all but the first) were; for single words, that is every word. If a phrase of the border turns out frequent, its
extensions may be frequent although nothing counted them. A second pass over all documents counts these, and at once the
extensions of what it counts itself, so that it closes the border however long the chain of failures is: both parts of a
frequent phrase are frequent, hence known from the first pass or counted in the second one, and so is the phrase. What is
frequent is then known without loss, whatever the sample holds.

Tasks know phrases by 64-bit hashes, and which ones are proposed or frequent by bit maps of bounded size. Either may take a
phrase for another; that only lets more phrases be counted, since the second pass counts all of its phrases, those found by
the first one included, by their texts. Everything that grows with the corpus stays in shuffles that combine within tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.words import MULTIPLIER, chunks, mix, words
from parlance.session import materialize

LONGEST = 5
#: Share of the documents in the sample, and of the limit at which a phrase of the sample is proposed.
SAMPLE, SLACK = 0.1, 0.5
#: Bits of a bit map for each phrase, and the most bits of one map (16 MB): above that, maps let more phrases pass.
BITS_EACH, MOST_BITS = 32, 27
#: What a task holds before it hands it over, combined: hashes of phrases, numbers of their words (4 bytes each), and texts.
HELD_HASHES, HELD_NUMBERS, HELD_TEXTS = 2_000_000, 5_000_000, 200_000
#: Buckets of phrases for each shuffle partition, so that partitions come out even.
BUCKETS_EACH = 4
#: Totals of up to this number of languages are broadcast.
MOST_LANGS = 10_000

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
INSIDE = np.ones(256, dtype=bool)
INSIDE[[*b"\x20\x09", *BREAKS]] = False
BREAK = np.zeros(256, dtype=np.int64)
BREAK[list(BREAKS)] = 1
BLANKED = bytes(c if INSIDE[c] else 0x20 for c in range(256))


def shifts(bits: int) -> tuple[int, int, int]:
    return 0, (64 - bits) // 2, 64 - bits


class BitMap:
    """Which hashes may be in a set: three bits for each, from its lowest, middle and highest digits."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits

    @staticmethod
    def of(grams: DataFrame, count: int) -> BitMap:
        """From the column ``gram`` of a frame of ``count`` rows; cells of 64 bits come to the driver, at most 2^(MOST_BITS - 6)."""
        bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(1, count) * BITS_EACH))))
        mask = (1 << bits) - 1
        places = F.explode(F.array(*(F.shiftrightunsigned("gram", s).bitwiseAND(mask) for s in shifts(bits))))
        cells = grams.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("cell"))
        found = cells.agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("value")).toPandas()
        out = np.zeros(1 << (bits - 6), dtype=np.int64)
        out[found["cell"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64)
        return BitMap(out.view(np.uint64), bits)

    def has(self, grams: np.ndarray) -> np.ndarray:
        def bit(place: np.ndarray) -> np.ndarray:
            return (self.cells[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)

        mask = np.uint64((1 << self.bits) - 1)
        low, middle, high = (bit((grams >> np.uint64(s)) & mask) for s in shifts(self.bits))
        return (low & middle & high).astype(bool)


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def phrases_of(raw: list[bytes], keys: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The text of each word, and for lengths 1 to ``longest`` the hash of the phrase that starts at each word and whether
    it lies within one piece.

    ``keys`` holds a number for the language of each text, which is part of the hash.
    """
    hashes, owner, starts, _, buffer = words(raw, INSIDE)
    if not len(hashes):
        return owner, [(hashes, np.zeros(0, dtype=bool))] * longest
    piece = np.cumsum(BREAK[buffer])[starts]  # texts are joined by line feeds, which break
    grams = mix(hashes + keys[owner])
    out = [(grams, np.ones(len(grams), dtype=bool))]
    for k in range(2, longest + 1):
        size = max(0, len(hashes) - k + 1)
        grams = mix(grams[:size] * MULTIPLIER + hashes[k - 1 : k - 1 + size] + np.uint64(k))
        out.append((grams, piece[:size] == piece[k - 1 : k - 1 + size]))
    return owner, out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Runs of texts of bounded size with their languages, from the columns lang and text."""
    langs = batch.column(0).to_pylist()
    for first, raw in chunks(batch.column(1).to_pylist()):
        yield raw, langs[first : first + len(raw)]


#: Given the phrases of a chunk, the lengths to count and, for each, which of its phrases.
Choice = Callable[[list[tuple[np.ndarray, np.ndarray]]], Iterator[tuple[int, np.ndarray]]]


def count_hashes(rows: DataFrame, choose: Choice, longest: int) -> DataFrame:
    """gram, k, n: how often each chosen phrase occurs, by its hash."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(longest + 1)]
        size, keys = 0, {}

        def emit() -> Iterator[pa.RecordBatch]:
            for k, parts in enumerate(held):
                if parts:
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    columns = [pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), k, dtype=np.int8)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["gram", "k", "n"])

        for batch in source:
            for raw, langs in _texts(batch):
                keys |= {lang: lang_key(lang) for lang in set(langs) - keys.keys()}
                _, phrases = phrases_of(raw, np.array([keys[lang] for lang in langs], dtype=np.uint64), longest)
                for k, chosen in choose(phrases):
                    held[k].append(chosen)
                    size += len(chosen)
                if size >= HELD_HASHES:
                    yield from emit()
                    size = 0
        yield from emit()

    counted = rows.mapInArrow(batches, "gram long, k byte, n long")
    return counted.groupBy("gram", "k").agg(F.sum("n").alias("n"))


def everything(longest: int) -> Choice:
    """All words, and all phrases of two words."""

    def choose(phrases: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        for k, (grams, whole) in enumerate(phrases[:longest], 1):
            yield k, grams[whole]

    return choose


def chained(known, shortest: int) -> Choice:
    """Phrases of ``shortest`` words and more, all of whose phrases of one word less than ``shortest`` are known."""

    def choose(phrases: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        known_parts = known.value.has(phrases[shortest - 2][0])
        for k in range(shortest, len(phrases) + 1):
            grams, whole = phrases[k - 1]
            chosen = whole.copy()
            for j in range(k - shortest + 2):
                chosen &= known_parts[j : j + len(grams)]
            yield k, grams[chosen]

    return choose


def both(parts: np.ndarray, size: int) -> np.ndarray:
    """Whether both parts of each phrase are marked, given the marks of phrases of one word less."""
    return parts[:size] & parts[1 : size + 1]


def with_border(proposed) -> Choice:
    """All words, and all phrases both of whose parts are proposed: proposed ones and their negative border."""

    def choose(phrases: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        yield 1, phrases[0][0]
        for k in range(2, len(phrases) + 1):
            grams, whole = phrases[k - 1]
            yield k, grams[whole & both(proposed.value.has(phrases[k - 2][0]), len(grams))]

    return choose


def frequent_or_new(phrases: list[tuple[np.ndarray, np.ndarray]], proposed: BitMap, frequent: BitMap) -> list[np.ndarray]:
    """For each length, which phrases the second pass counts: frequent ones, and extensions that the first pass did not count.

    An extension counts if both of its parts are frequent or counted here, and were not both proposed.
    """
    out = [frequent.has(phrases[0][0]) & phrases[0][1]]
    for k in range(2, len(phrases) + 1):
        (grams, whole), parts = phrases[k - 1], phrases[k - 2][0]
        counted = both(proposed.has(parts), len(grams))
        out.append(whole & np.where(counted, frequent.has(grams), both(out[-1], len(grams))))
    return out


def propose(rows: DataFrame, support: int, share: float, slack: float, longest: int) -> DataFrame:
    """gram, k of the phrases that are frequent in a sample of ``share`` of the rows, at ``slack`` of their share of ``support``."""
    spark, slices = rows.sparkSession, 1 << 20
    sample = rows.where(F.pmod("draw", F.lit(slices)) < round(share * slices)).drop("draw")
    limit = max(2, math.floor(support * share * slack))
    short = materialize(count_hashes(sample, everything(min(2, longest)), min(2, longest)).where(F.col("n") >= limit).select("gram", "k"), "proposed")
    if longest < 3:
        return short
    pairs = short.where("k = 2")
    known = spark.sparkContext.broadcast(BitMap.of(pairs, pairs.count()))
    long = count_hashes(sample, chained(known, 3), longest).where(F.col("n") >= limit).select("gram", "k")
    return short.unionByName(materialize(long, "proposed"))


class Numbers(dict):
    """Numbers of words, from 0 in order of their first lookup."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class TextCounts:
    """Counts of phrases by language and words, a number for each: equal numbers are equal texts, no hash decides."""

    def __init__(self, longest: int):
        self.words, self.langs = Numbers(), Numbers()
        self.places: list[list[np.ndarray]] = [[] for _ in range(longest)]
        self.totals: Counter[str] = Counter()
        self.size = 0

    def add(self, joined: bytes, owner: np.ndarray, langs: list[str], chosen: list[np.ndarray]) -> None:
        """The chosen phrases of texts joined by line feeds; ``owner`` holds the text of each word, ``langs`` their languages."""
        ids = np.fromiter(map(self.words.__getitem__, joined.lower().translate(BLANKED).split()), np.int32, len(owner))
        lang = np.array([self.langs[x] for x in langs], dtype=np.int32)[owner]
        names = list(self.langs)
        self.totals.update({names[i]: n for i, n in enumerate(np.bincount(lang, minlength=len(names)).tolist())})
        for k, marks in enumerate(chosen, 1):
            at = np.flatnonzero(marks)
            self.places[k - 1].append(np.stack([lang[at], *(ids[at + j] for j in range(k))]))
            self.size += len(at) * (k + 1)

    def emit(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """All that is held, which is then forgotten: a row for each bucket of phrases, with arrays of lang, phrase, k and n."""
        names, vocabulary = list(self.langs), list(self.words)
        found = [(lang, "", 0, n) for lang, n in self.totals.items()]
        for k, parts in enumerate(self.places, 1):
            if not parts:
                continue
            rows = np.concatenate(parts, axis=1)
            parts.clear()
            codes = rows[0].astype(np.int64)
            for ids in rows[1:-1]:
                codes = np.unique(codes * len(vocabulary) + ids, return_inverse=True)[1]
            _, first, n = np.unique(codes * len(vocabulary) + rows[-1], return_index=True, return_counts=True)
            rows = rows[:, first]
            texts = (b" ".join([vocabulary[i] for i in own]).decode("utf-8", "replace") for own in rows[1:].T.tolist())
            found += zip([names[i] for i in rows[0].tolist()], texts, [k] * len(first), n.tolist())
        self.__init__(len(self.places))
        number = np.array([crc32(phrase.encode()) % buckets for _, phrase, _, _ in found], dtype=np.int32)
        order = np.argsort(number, kind="stable")
        own, starts = np.unique(number[order], return_index=True)
        offsets = pa.array([*starts.tolist(), len(found)], pa.int32())
        columns = zip(*(found[i] for i in order.tolist())) if found else [()] * 4
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c, kind)) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int8(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(own), *lists], names=["bucket", "lang", "phrase", "k", "n"])


def count_texts(rows: DataFrame, proposed, frequent: BitMap, longest: int) -> DataFrame:
    """lang, phrase, k, n of the phrases that ``frequent_or_new`` chooses, by their texts; k = 0 has the number of words.

    A frequent phrase stands in nearly every task, so tasks hand over what they counted in packed rows, one for each bucket
    of phrases; they are added up bucket by bucket in bounded memory, and the few rows that this leaves by an aggregation.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frequent)
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = TextCounts(longest), {}
        for batch in source:
            for raw, langs in _texts(batch):
                keys |= {lang: lang_key(lang) for lang in set(langs) - keys.keys()}
                owner, phrases = phrases_of(raw, np.array([keys[lang] for lang in langs], dtype=np.uint64), longest)
                held.add(b"\n".join(raw), owner, langs, frequent_or_new(phrases, proposed.value, shared.value))
                if held.size >= HELD_NUMBERS:
                    yield from held.emit(BUCKETS_EACH * partitions)
        yield from held.emit(BUCKETS_EACH * partitions)

    def added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str, int]] = Counter()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*held)) if held else [()] * 3
            kinds = (pa.string(), pa.string(), pa.int8())
            arrays = [*map(pa.array, columns, kinds), pa.array(held.values(), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "k", "n"])

        for batch in source:
            for row in range(batch.num_rows):
                lang, phrase, k, n = (batch.column(c)[row].values.to_pylist() for c in range(1, 5))
                for key, times in zip(zip(lang, phrase, k), n):
                    held[key] += times
                if len(held) >= HELD_TEXTS:
                    yield emit()
        yield emit()

    packed = rows.mapInArrow(counted, "bucket int, lang array<string>, phrase array<string>, k array<byte>, n array<long>")
    merged = packed.repartition(partitions, "bucket").mapInArrow(added, "lang string, phrase string, k byte, n long")
    return merged.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))


def mine(docs: DataFrame, support: int = 100, longest: int = LONGEST, share: float = SAMPLE, slack: float = SLACK, text: str = "text") -> DataFrame:
    """A table of lang, phrase, k (words), n (occurrences) of every phrase of up to ``longest`` words that occurs ``support``
    times or more in its language, and of the number of words of each language (k = 0)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows, spark = docs.select(lang, whole, F.xxhash64("doc_id", text).alias("draw")), docs.sparkSession
    proposals = propose(rows, support, share, slack, longest).where(F.col("k") < longest)
    proposed = spark.sparkContext.broadcast(BitMap.of(proposals, proposals.count()))
    rows = rows.drop("draw")
    frequent = materialize(count_hashes(rows, with_border(proposed), longest).where(F.col("n") >= support), "frequent")
    counted = count_texts(rows, proposed, BitMap.of(frequent, frequent.count()), longest)
    return materialize(counted.where((F.col("k") == 0) | (F.col("n") >= support)), "phrases")


def _exact(*factors: str) -> str:
    """The product of whole numbers, in decimals of 38 digits."""
    return " * ".join(f"cast({f} as decimal(19, 0))" for f in factors)


def collocations(docs: DataFrame, support: int = 100, longest: int = LONGEST, top: int = 2000, share: float = SAMPLE, slack: float = SLACK, text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language whose parts attract each other most.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and those into words ``[^\\x20\\x09]+``. Phrases
    of 2 to ``longest`` words that occur ``support`` times or more within pieces are candidates, with a occurrences. For a cut
    after the first words, l and r count both parts, n the words of the language, and the score is floor(1000 a n / (l r)); the
    cut with the lowest score counts, of equals the first. A candidate within a longer one that occurs as often is dropped.
    Order: score, then a, both descending, then the bytes of the phrase.

    A null language is ``und``, a null text has no words; repeated rows count again, and so do rows that repeat an id or have
    none. Other columns are not read. No documents, or none with frequent phrases, give no rows.
    """
    found = mine(docs, support, longest, share, slack, text)
    totals = found.where("k = 0").select("lang", F.col("n").alias("total"))
    phrases = found.where("k > 0").select("lang", "phrase", F.col("k").cast("int").alias("k"), F.col("n").alias("a"))
    inner = F.expr("""flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))""")
    within = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stays = phrases.where("k > 1").join(within, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cut = stays.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({
        "first": F.expr("array_join(slice(split(phrase, ' '), 1, cut), ' ')"),
        "rest": F.expr("array_join(slice(split(phrase, ' '), cut + 1, k - cut), ' ')"),
    })
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    cut = cut.join(parts.withColumnsRenamed({"part": "first", "times": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "times": "r"}), ["lang", "rest"])
    cut = cut.join(F.broadcast(totals) if totals.count() <= MOST_LANGS else totals, "lang")
    scored = cut.withColumn("score", F.expr(f"({_exact('a', 'total')} * 1000) div ({_exact('l', 'r')})"))
    lowest = scored.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def oracle(support: int = 100, top: int = 2000) -> str:
    """The same phrases by counting all of them."""
    return rf"""
        WITH pieces AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
                  FROM documents)),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
        placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
        every AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM every GROUP BY lang, k, phrase HAVING count(*) >= {support}),
        within AS (
            SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM f, (SELECT unnest([2, 3, 4]) AS m), (SELECT unnest([1, 2, 3, 4]) AS i)
            WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, p.a AS l, q.a AS r, t.n, cut, (1000::HUGEINT * c.a * t.n) // (p.a::HUGEINT * q.a) AS score
            FROM f c LEFT JOIN within v ON v.lang = c.lang AND v.phrase = c.phrase
            CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS cut)
            JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1 : cut], ' ')
            JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[cut + 1 : ], ' ')
            JOIN totals t ON t.lang = c.lang
            WHERE c.k > 1 AND cut < c.k AND (v.longer IS NULL OR v.longer < c.a)),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
