"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken together up to this many bytes, which bounds the arrays.
CHUNK_BYTES = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


BYTE_VALUES = _byte_values()  # A-Z count as a-z
NON_WHITE = np.ones(256, dtype=bool)
NON_WHITE[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 256), MULTIPLIER | np.uint64(1), dtype=np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of encoded texts of bounded size, each with the index of its first text."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def stems(starts: np.ndarray, ends: np.ndarray, buffer: np.ndarray, size: int) -> np.ndarray:
    """Hash of the first ``size`` bytes of each word that is longer; 0 for other words."""
    out = np.zeros(len(starts), dtype=np.uint64)
    long = np.flatnonzero(ends - starts > size)
    for k in range(size):
        out[long] += BYTE_VALUES[buffer[starts[long] + k]] * powers(size)[k]
    out[long] = mix(out[long] + np.uint64(size << 32))
    return out


def words(raw: list[bytes], member: np.ndarray = NON_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner (index of its text), start and end byte in the joined buffer of every word, and the buffer.

    A word is a longest run of bytes in ``member``; texts are joined by line feeds, which no word holds.
    """
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    inside = member[buffer]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty, buffer
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
    weighted = BYTE_VALUES[buffer[inside]] * powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(weighted, firsts) + lengths.astype(np.uint64))
    limits = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(limits, starts, side="right"), starts, ends, buffer


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; of fewer words, the whole sequence is one."""
    for _, raw in chunks(texts):
        hashes, owner, *_ = words(raw)
        counts = np.bincount(owner, minlength=len(raw))
        stops = np.cumsum(counts)
        rolled = hashes.copy()
        for k in range(1, n):
            rolled = mix(rolled * MULTIPLIER + np.uint64(k))
            rolled[: len(hashes) - k] += hashes[k:]
        rolled = mix(rolled)
        for stop, count in zip(stops, counts):
            if count >= n:
                yield np.unique(rolled[stop - count : stop - n + 1])
            elif count:
                own = np.array([count], dtype=np.uint64)
                for h in hashes[stop - count : stop]:
                    own = mix(own * MULTIPLIER + h)
                yield own
            else:
                yield np.zeros(0, dtype=np.uint64)
