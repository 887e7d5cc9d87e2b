"""Byte-pair token counts by rank-synchronous merging of ragged arrays.

Every pre-token of a batch is one sequence of symbol ids in a flat array with offsets. In each round the ranks of all
adjacent pairs are looked up at once, every sequence finds its lowest-ranked pair, and all sequences merge the
occurrences of their own pair together. The rounds end when no sequence has a pair with a rank; what is left of each
sequence is its token count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known pre-tokens that a Python worker keeps before it starts afresh: bounds memory, not results.
CACHE_ENTRIES = 400_000
# Capitals of Unicode 16 with their small letters, which this Python's tables may lack.
NEWER_CAPITALS = {0xA7CB: 0x0264, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
NO_RANK = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merges of one vocabulary as sorted pair keys with rank and product."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.size = max(vocab.values()) + 1
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.products = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each non-empty word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        out = np.ones(len(words), dtype=np.int64)
        if not len(words):
            return out
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols):
            inside = owner[:-1] == owner[1:]
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1][inside] = self.ranks_of(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            done = best == NO_RANK
            out[owner[starts[done]]] = sizes[done]
            lowest = np.repeat(best, sizes)
            hit = (rank == lowest) & (lowest != NO_RANK)
            # of overlapping occurrences (a pair of equal symbols in a row), every second one from the left merges
            at = np.flatnonzero(hit)
            fresh = np.r_[True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])] if len(at) else np.zeros(0, bool)
            first = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] if len(at) else at
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.products[rank[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class LowercaseWordCounter:
    """Token counts of a vocabulary with NFC, lower case, letters / single digits / other runs, and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = RankMerger(spec["model"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.newer = regex.compile("[" + "".join(map(chr, NEWER_CAPITALS)) + "]")
        self.known: dict[str, int] = {}

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of ``text`` and the number of special tokens that it spells out."""
        specials = 0
        if "<|" in text:
            specials = len(self.special.findall(text))
            parts = self.special.split(text) if specials else [text]
        else:
            parts = [text]
        found: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                if self.newer.search(part):
                    part = part.translate(NEWER_CAPITALS)
            found += self.words.findall(part.lower())
        return found, specials

    def count_batch(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        split = [self.split(t or "") for t in texts]
        new = list(set().union(*(w for w, _ in split)).difference(self.known))
        self.known.update(zip(new, self.merger.counts([w.encode("utf-8", "surrogatepass") for w in new]).tolist()))
        return [sum(map(self.known.__getitem__, words)) + n for words, n in split]


_counters: dict[str, LowercaseWordCounter] = {}


def counter(path: str) -> LowercaseWordCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _counters:
        _counters[path] = LowercaseWordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_bytes, n_tokens and over_limit of each row, by one pass without a shuffle.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null keys give a row each. Whole texts are
    counted whatever their length; other columns, whatever their names, are not read. An empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = counter(vocabulary)
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keys) + 1)]
            tokens = pa.array(n.count_batch(batch.column(len(keys) + 1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, tokens], names=[*keys, "n_bytes", "n_tokens"])

    whole = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(*keys, F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keys) + 1]) + ", n_tokens long"
    return source.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
