"""Maximal runs of repeated words in every text, by a suffix automaton whose suffix links are accessed as a link-cut tree.

The suffix links of the automaton form a tree in which the path from the state of a prefix to the root holds all suffixes
of that prefix. The tree is cut into paths of one colour, the last place where the words of a state ended. Each word in
turn accesses the state of its prefix: the path to the root becomes one segment of the new colour, and every old segment
that it takes over tells an earlier end ``c`` and the longest common suffix ``L`` of both ends. If the distance
``d = i - c`` is at most ``L``, a square of period ``d`` ends here. The last occurrence of a word sequence that is no power
is exactly its period away, so squares of all smallest periods are met, and of those alone. Squares of one period at
consecutive places are one run: ``L`` of the first tells where it starts, the last one where it ends.

Only words that can lie in a run go that way. A run of at least ``m`` words with period ``q`` has ``length - q >= m / 2``,
and is the union of its words without the last ``q`` and of those without the first ``q``; every sequence of
``k = ceil(m / 2)`` words inside one of the two stands again ``q`` words away in the other. So each word of a run lies in a
sequence of ``k`` words that recurs at a distance of at most half the stretch of such words. Hashes find these stretches;
a collision only adds words. The automaton compares the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STEP = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs string"


def split_words(text: str | None) -> list[bytes]:
    """The longest stretches of ``[^\\x20\\x09-\\x0D]`` in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words`` with a periodic tail where the CRC of the identifier ends in 0: planted repeats, fixed by identifiers."""
    if doc_id is None or not words or (h := crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _stretches(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(covered.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[0::2], edge[1::2]


def candidates(words: list[bytes], least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of ``words`` outside of which no run of ``least`` words or more has a word."""
    n, k = len(words), (least + 1) // 2
    if n < least:
        return []
    rolled = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    grams = rolled[: n - k + 1].copy()
    for j in range(1, k):
        grams ^= grams >> np.uint64(29)
        grams *= STEP
        grams += rolled[j : n - k + 1 + j]
    order = np.argsort(grams, kind="stable")
    sorted_grams = grams[order]
    same = np.flatnonzero(sorted_grams[1:] == sorted_grams[:-1])
    if not len(same):
        return []
    # distance of each sequence to the nearest equal one
    near = np.full(len(grams), n, dtype=np.int64)
    apart = order[same + 1] - order[same]
    near[order[same]] = apart
    near[order[same + 1]] = np.minimum(near[order[same + 1]], apart)
    at = np.flatnonzero(near <= n // 2)
    while len(at):
        covered = np.zeros(n + 1, dtype=np.int64)
        covered[at] += 1
        covered[at + k] -= 1
        starts, ends = _stretches(np.cumsum(covered[:n]) > 0)
        sizes = ends - starts
        own = sizes[np.searchsorted(starts, at, side="right") - 1]
        stays = (near[at] * 2 <= own) & (own >= least)
        if stays.all():
            return list(zip(starts.tolist(), ends.tolist()))
        at = at[stays]
    return []


def suffix_links(words: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of every state of the automaton of ``words``, and the state of each prefix."""
    moves: list[dict[bytes, int]] = [{}]
    link, length, prefix = [-1], [0], []
    last = 0
    for word in words:
        new = len(length)
        length.append(length[last] + 1)
        moves.append({})
        link.append(0)
        prefix.append(new)
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q also holds longer words that do not end here: split it
                twin = len(length)
                length.append(length[p] + 1)
                moves.append(moves[q].copy())
                link.append(link[q])
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return link, length, prefix


def find_runs(words: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and two periods, by start and period."""
    link, length, prefix = suffix_links(words)
    size = len(link)
    # splay trees, one for each path of one colour, ordered by depth; the root's colour counts. -1 is no node, and so is
    # the empty word, whose length takes no part: its children are tops of trees.
    up = [-1 if x == 0 else x for x in link]
    left, right, colour = [-1] * size, [-1] * size, [0] * size
    open_runs: dict[int, list[int]] = {}
    found: list[list[int]] = []
    for i, node in enumerate(prefix, 1):
        below = -1
        while node >= 0:
            # bring node to the root of its tree
            p = up[node]
            while p >= 0 and (left[p] == node or right[p] == node):
                g = up[p]
                inner = g >= 0 and (left[g] == p or right[g] == p)
                if inner and (left[g] == p) == (left[p] == node):  # first p over g
                    colour[p] = colour[g]
                    top = up[g]
                    if left[g] == p:
                        moved = left[g] = right[p]
                        right[p] = g
                    else:
                        moved = right[g] = left[p]
                        left[p] = g
                    if moved >= 0:
                        up[moved] = g
                    up[g], up[p] = p, top
                    if top >= 0:
                        if left[top] == g:
                            left[top] = p
                        elif right[top] == g:
                            right[top] = p
                colour[node] = colour[p]
                top = up[p]
                if left[p] == node:
                    moved = left[p] = right[node]
                    right[node] = p
                else:
                    moved = right[p] = left[node]
                    left[node] = p
                if moved >= 0:
                    up[moved] = p
                up[p], up[node] = node, top
                if top >= 0:
                    if left[top] == p:
                        left[top] = node
                    elif right[top] == p:
                        right[top] = node
                p = top
            c = colour[node]
            if c:
                d, common = i - c, length[node]
                if d <= common:
                    run = open_runs.get(d)
                    if run is not None and run[1] == i - 1:
                        run[1] = i
                    else:
                        open_runs[d] = run = [i - d - common, i, d]
                        found.append(run)
                deeper = right[node]
                if deeper >= 0:
                    colour[deeper] = c
            right[node] = below
            below, node = node, up[node]
        colour[below] = i
    return sorted((start, end - start, d) for start, end, d in found if end - start >= least)


def text_runs(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """All runs of a text, by start and period; see ``find_runs``."""
    out = []
    for start, end in candidates(words, least):
        out += [(start + s, size, d) for s, size, d in find_runs(words[start:end], least)]
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    dropped = bytearray(len(words))
    for start, size, period in runs:
        dropped[start + period : start + size] = b"\1" * (size - period)
    return [w for w, gone in zip(words, dropped) if not gone]


def periodic_runs(docs: DataFrame, least: int = 12, planted: bool = False, text: str = "text") -> DataFrame:
    """One row for each document with its runs of repeated words, and digests of them and of the text without repeats.

    A run is a stretch of at least ``least`` words and of at least two periods, with its smallest period, that cannot be
    made longer. ``runs`` lists ``start,length,period`` in lines by start, then period, and runs_sha256 is its digest;
    start, length, period and exponent_milli (1000 * length / period, rounded down) are those of the longest run, of equals
    the first, then that of the smallest period. collapsed_sha256 is the digest of the words that no run holds after its
    first period, joined by spaces. ``planted`` repeats the tails of a tenth of the texts, see ``repeated_tail``.

    Null and empty texts have no words and no run: n_runs 0, four nulls, digests of the empty string. A null doc_id stays
    null and plants nothing. Repeated rows give repeated rows; other columns are not read. Work is spread by rows: each
    text is settled in its own task, in memory in proportion to its longest stretch of recurring words.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, rows = batch.column(0), []
            for doc_id, whole in zip(ids.to_pylist(), batch.column(1).to_pylist()):
                words = split_words(whole)
                if planted:
                    words = repeated_tail(doc_id, words)
                runs = text_runs(words, least)
                lines = "".join(f"{s},{size},{d}\n" for s, size, d in runs)
                kept = b" ".join(without_repeats(words, runs))
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                start, size, period = best or (None, None, None)
                rows.append((len(runs), start, size, period, best and 1000 * size // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), lines))
            columns = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.string()) for c in columns[5:]]
            names = ["doc_id", *(f.split()[0] for f in RESULT.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([ids, *arrays], names=names)

    rows = docs.select("doc_id", text)
    return rows.mapInArrow(batches, RESULT.format(id=rows.schema["doc_id"].dataType.simpleString()))
