"""Secrets in texts: fixed base rules, and stretches of one character class whose windows have a high Shannon entropy.

A candidate is a longest stretch of the characters of a class. A window of the class's width slides over it; the counts of
its characters, and with them the sum of ``c * log2(c)``, change by the character that enters and the one that leaves. The
sum is kept in whole units of 2^-32 bit, so that no rounding adds up along a stretch. Windows at or above the class's
threshold make up the added spans; an allow-list of harmless forms and of what stands before suppresses them. Base spans
are never suppressed, and what overlaps one is not added again.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Every text that ``ASSIGN`` matches holds one of these in lower case.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

UNIT = 1 << 32


@dataclass(frozen=True)
class CharacterClass:
    """Characters of candidate stretches, width of the window in characters, and the least entropy of a window in bits."""

    kind: str
    characters: str
    width: int
    bits: float


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", 16, 3.0),
    CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_-", 20, 3.7),
)

#: Candidates that one of these matches as a whole are harmless: numbers, words of one case with or without a capital, words
#: and numbers joined by - _ or / as in slugs, names and paths, universally unique identifiers, and placeholders.
ALLOWED = (
    r"[0-9_/+-]+",
    r"[A-Z]?[a-z]+",
    r"[A-Z]+",
    r"[A-Za-z]?[a-z]*([/_+-]+([A-Za-z]?[a-z]*|[A-Z]+|[0-9]+))+",
    r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    r"(?i).*(example|placeholder|changeme|your[_-]?(key|token|secret)|abcdefgh|0123456789|xxxx).*",
)
#: What stands right before a harmless candidate: names of digests, and the start of a link or of inline data.
ALLOWED_BEFORE = r"(?i)(sha(1|224|256|384|512)|md5)[:=\x20-]+$|://[^\s]*$|;base64,$"
#: Characters before a candidate that ``ALLOWED_BEFORE`` looks at.
BEFORE = 200


def stretches(raw: np.ndarray, member: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of every longest stretch of ``least`` bytes or more for which ``member`` is true."""
    edge = np.flatnonzero(np.diff(member[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    long = np.flatnonzero(ends - starts >= least)
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def members(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


def base_spans(raw: bytes, view: np.ndarray, hex_digits: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the base rules in bytes, by start, then kind: of each rule the leftmost matches, none overlapping, without failing ones."""
    found = []
    lowered = raw.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *s) for s in stretches(view, hex_digits, LEAST_HEX)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def weights(width: int) -> list[int]:
    """``c * log2(c)`` for counts up to ``width``, in units."""
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, width + 1))]


def rich_windows(stretch: bytes, width: int, bits: float) -> list[tuple[int, int]]:
    """(start, end) of the unions of overlapping windows of ``width`` whose entropy is at least ``bits``."""
    term = weights(width)
    # entropy = log2(width) - total / width >= bits
    most = round((math.log2(width) - bits) * width * UNIT)
    counts: Counter[int] = Counter()
    total, out = 0, []
    for at, entering in enumerate(stretch):
        c = counts[entering]
        counts[entering] = c + 1
        total += term[c + 1] - term[c] if c < width else 0
        if at >= width:
            leaving = stretch[at - width]
            c = counts[leaving]
            counts[leaving] = c - 1
            total += term[c - 1] - term[c] if c <= width else 0
        if at >= width - 1 and total <= most:
            start, end = at - width + 1, at + 1
            if out and start <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([start, end])
    return [tuple(s) for s in out]


class Scanner:
    """The base rules, the classes and the allow-list, ready for many texts."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_before: str = ALLOWED_BEFORE):
        self.classes = [(c, members(c.characters)) for c in classes]
        self.kinds = {k: n for n, k in enumerate((*BASE, *(c.kind for c in classes)))}
        self.allowed = [re.compile(p.encode()) for p in allowed]
        self.before = re.compile(allowed_before.encode())
        self.hex_digits = members(DIGITS + "abcdef")

    def harmless(self, raw: bytes, start: int, end: int) -> bool:
        stretch = raw[start:end]
        return any(p.fullmatch(stretch) for p in self.allowed) or bool(self.before.search(raw[max(0, start - BEFORE) : start]))

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, those with the added ones, and all spans of high entropy, of a text, in code points."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        view = np.frombuffer(raw, dtype=np.uint8)
        base = base_spans(raw, view, self.hex_digits)
        every, entropy = list(base), []
        for c, member in self.classes:
            own = []
            for start, end in stretches(view, member, c.width):
                rich = rich_windows(raw[start:end], c.width, c.bits)
                if rich and not self.harmless(raw, start, end):
                    own += [(c.kind, start + s, start + e) for s, e in rich]
            entropy += own
            every += _free_of(own, every)  # of two classes the first one keeps a place
        if base or entropy:
            places = np.cumsum((view & 0xC0) != 0x80)  # code points up to and with each byte
            base, every, entropy = ([(k, int(places[s]) - 1, int(places[e - 1])) for k, s, e in found] for found in (base, every, entropy))
        order = lambda s: (s[1], self.kinds[s[0]])
        return base, sorted(every, key=order), sorted(entropy, key=order)


def _free_of(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``spans`` that overlap none of ``others``."""
    edges = sorted((s, e) for _, s, e in others)
    starts = np.array([s for s, _ in edges], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in edges], dtype=np.int64)) if edges else starts
    return [x for x in spans if not (k := int(np.searchsorted(starts, x[2]))) or reach[k - 1] <= x[1]]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and entropy_spans of every document.

    A span is ``kind:start:end`` in code points with the end left out, in order of start, then of kind (assign, access, hex,
    then the classes). base_sha256 is the digest of the base spans; ``spans`` lists them and the added ones; ``entropy_spans`` lists
    all spans of high entropy that the allow-list lets pass, also those where a base span stands already. Null and empty
    texts have no spans: zeros, the digest of the empty string and empty lists. Repeated rows give repeated rows, ids may be null, and
    other columns are not read. Each text is settled in its own task, in time and memory in proportion to its length.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes)
        for batch in source:
            rows = []
            for whole in batch.column(1).to_pylist():
                base, every, entropy = scanner.spans(whole)
                n = Counter(k for k, _, _ in base)
                rows.append((*(n[k] for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(every), written(entropy)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "entropy_spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    rows = docs.select("doc_id", text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, entropy_spans string")
