"""Best-two-fit packing of token sequences.

Lengths are integers up to the capacity, so what a packing needs to know of all documents is how many pieces there are
of each length. The plan is made from that histogram, bin by bin: fill greedily with the longest piece that fits, then
replace the bin's smallest piece by two unpacked ones if they fill the expanded gap more tightly. A bin's pattern holds
for as many bins as the histogram has pieces for, so the plan has a bounded number of patterns at any size of input.
Pieces are then placed by their rank among those of their length: no text moves, no group meets in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.bpe import byte_symbols
from parlance.session import materialize

CAPACITY = 1024
#: How byte-level vocabularies split a text before their merges.
#: From so many blanks in a row on the encoder's splitting pattern runs out of stack; the tokenizer library has no such end.
LONG_BLANKS = 100_000
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Ids of a byte-level vocabulary file, as little-endian 32-bit bytes.

    The file's merges, in order, are the ranks of a byte-pair encoder that returns its ids as one buffer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        ranks = {b"".join(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in {t["content"] for t in spec["added_tokens"]}}
        for k, merge in enumerate(model["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"]["".join(pair)] != 256 + k:
                raise ValueError(f"{path}: ids do not follow the order of its merges")
        self.encoder = tiktoken.Encoding(
            path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]}
        )
        self.path, self.library, self.blanks = path, None, re.compile(r"\s+")

    def encode(self, text: str) -> bytes:
        # each run of blanks is met once, so this takes time in proportion to the text
        if len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in self.blanks.finditer(text)):
            self.library = self.library or Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.encoder.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


_tokens: dict[str, ByteTokens] = {}


def byte_tokens(path: str) -> ByteTokens:
    if path not in _tokens:
        _tokens[path] = ByteTokens(path)
    return _tokens[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole capacities, but for the first one."""
    first = total % capacity or capacity
    return [(0, min(first, total)), *((at, capacity) for at in range(first, total, capacity))]


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[list[int]], list[int]]:
    """Patterns (lengths in a bin, in order) and for how many bins each holds. ``counts[n]``: pieces of length n."""
    left = counts.astype(np.int64).copy()
    patterns: list[list[int]] = []
    times: list[int] = []
    sizes = np.arange(capacity + 1)
    while left.any():
        spare = left.copy()
        bin_, gap = [], capacity
        while True:
            fits = np.flatnonzero(spare[: gap + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            take = int(min(gap // n, spare[n]))
            bin_ += [n] * take
            spare[n] -= take
            gap -= n * take
            if not gap:
                break
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            # the largest available length at most x, for every x
            below = np.maximum.accumulate(np.where(spare > 0, sizes, 0))
            one = np.flatnonzero(spare[: room + 1])
            one = one[one > 0]
            two = below[room - one]
            twice = (two == one) & (spare[one] < 2)
            two[twice] = below[one[twice] - 1]
            total = np.where(two > 0, one + two, 0)
            if len(total) and total.max() > smallest:
                k = int(np.argmax(total))
                bin_ = [*bin_[:-1], *sorted((int(one[k]), int(two[k])), reverse=True)]
        used = np.bincount(bin_, minlength=capacity + 1)
        k = int((left[used > 0] // used[used > 0]).min())
        patterns.append(bin_)
        times.append(k)
        left -= used * k
    return patterns, times


def slots(patterns: list[list[int]], times: list[int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: from which rank on a run holds, its bin, its place there, pieces of it in a bin."""
    rows, seen, first_bin = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for bin_, k in zip(patterns, times):
        place = 0
        for n in dict.fromkeys(bin_):
            each = bin_.count(n)
            rows.append((n, seen[n], first_bin, place, each))
            seen[n] += each * k
            place += n * each
        first_bin += k
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "place", "each"), table.T))


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """A row per piece with its checksum, and its rank among the task's pieces of that length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, seen = byte_tokens(vocabulary), np.zeros(capacity + 1, dtype=np.int64).tolist()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(value.as_py() or "") + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the single end id. Documents longer than the capacity are cut; the first piece may be
    shorter. Repeated rows and null doc_ids are packed like any other row. Pieces of one length are interchangeable, so
    ties need no rule. An empty table gives no rows; columns besides doc_id and ``text`` are not read.
    The driver sees the histogram of lengths (``capacity`` numbers) and the plan made from it, nothing else.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, vocabulary, end_id, capacity, text), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(slots(*best_two_fit(counts, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(per_part, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("local")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        width = np.int64(2**40)
        keys = table["length"] * width + table["rank"]
        for batch in batches:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, n * width + rank, side="right") - 1
            bin_, k = np.divmod(rank - table["rank"][at], table["each"][at])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table["bin"][at] + bin_), pa.array(table["place"][at] + k * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
