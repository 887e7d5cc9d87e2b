"""Boundaries of chunks: cases of repeated tails, and random words against another alignment; duplicates; quiet bounds."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import chunking as C
from parlance.operators import seams as S

SEGMENTS = "rec_id string, chunk long, idx long, start_ms long, end_ms long, text string, words array<struct<word: string, start_ms: long, end_ms: long>>"


def said(words, start, step=100):
    return [(w, start + i * step, start + i * step + 50) for i, w in enumerate(words)]


def segment(rec, chunk, idx, words, start):
    return (rec, chunk, idx, start, start + 100 * len(words), " ".join(words), said(words, start))


def trimmed(spark, segments, starts):
    chunks = spark.createDataFrame(starts, "rec_id string, chunk long, at_ms long")
    rows = S.trim_boundaries(spark.createDataFrame(segments, SEGMENTS), chunks).collect()
    return {(r.rec_id, r.chunk, r.idx): (r.text, r.end_ms, [w.word for w in r.words or []]) for r in rows}


CASES = [
    ("все прекрасно у меня просто вопрос у нас в", "все прекрасно у меня просто вопрос у нас будет ли", 9),
    ("совершенно другая фраза тут", "абсолютно иной текст дальше", 0),
    ("мы убедимся данн", "данный момент идти", 1),
    ("Да коллеги это все прекрасно У меня вопрос", "все прекрасно у меня вопрос у нас будет", 5),
    ("one two", "Two! three", 1),
    ("d", "done", 0),
]


@pytest.mark.parametrize("tail, head, n", CASES)
def test_words_to_cut(spark, tail, head, n):
    keys = lambda t: [w.lower().strip("!") for w in t.split()]
    rows = spark.createDataFrame([(keys(tail), keys(head))], "tail array<string>, head array<string>")
    assert S.words_to_cut(rows).first().n_cut == n


def test_a_repeated_tail_goes_from_segments(spark):
    first = "Да коллеги это все прекрасно У меня вопрос".split()
    following = "все прекрасно у меня вопрос у нас будет".split()
    out = trimmed(spark, [segment("a", 0, 1, first, 8000), segment("a", 1, 2, following, 10000)], [("a", 0, 0), ("a", 1, 10000)])
    assert out["a", 0, 1] == ("Да коллеги это", 8250, ["Да", "коллеги", "это"])
    assert out["a", 1, 2][0] == " ".join(following)


def test_cuts_reach_over_segments_and_leave_others_alone(spark):
    rows = [
        segment("a", 0, 1, "one two three".split(), 9000), segment("a", 0, 2, ["four"], 9400), segment("a", 1, 3, "two three four five".split(), 9500),
        segment("b", 0, 1, "one two three".split(), 9000), segment("b", 2, 2, "one two three".split(), 9000),
        ("c", 0, 1, 9000, 9900, "no words", None), ("c", 0, 2, 9000, 9900, "none", []), segment("c", 1, 3, ["words"], 9000),
        segment("d", 0, 1, "alpha beta".split(), 1000), segment("d", 1, 2, "alpha beta".split(), 10000),
    ]
    out = trimmed(spark, rows, [(r, c, 9500 * c) for r in "abcd" for c in range(3)])
    assert out["a", 0, 1] == ("one", 9050, ["one"]) and ("a", 0, 2) not in out
    assert len(out) == 9 and out["b", 0, 1][0] == "one two three" and out["d", 0, 1][0] == "alpha beta"  # the latter is too long before
    assert out["c", 0, 1] == ("no words", 9900, []) and out["c", 0, 2] == ("none", 9900, [])
    empty = spark.createDataFrame([], SEGMENTS)
    assert S.trim_boundaries(empty, spark.createDataFrame([], "rec_id string, chunk long, at_ms long")).collect() == []


def test_blocks_equal_another_alignment(spark):
    draw = random.Random(2)
    pairs = [([draw.choice("abcd") for _ in range(draw.randint(0, 12))], [draw.choice("abcd") for _ in range(draw.randint(0, 12))]) for _ in range(150)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a array<string>, b array<string>")
    for r in rows.select("id", S.matching_blocks("a", "b", 12).alias("blocks")).collect():
        a, b = pairs[r.id]
        expected = [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        assert [(x.a, x.b, x.size) for x in r.blocks] == expected
        assert S.matched_characters("".join(a), "".join(b)) == sum(m[2] for m in expected)


def duplicates(a, b):
    """Two (chunk, start, end, key, idx) of different chunks, compared test by test."""
    overlap = min(a[2], b[2]) - max(a[1], b[1])
    if a[0] == b[0] or overlap <= 0 or not a[3] or not b[3]:
        return False
    if overlap < 0.6 * min(a[2] - a[1], b[2] - b[1]) and overlap < 0.5 * (max(a[2], b[2]) - min(a[1], b[1])):
        return False
    if a[3] in b[3] or b[3] in a[3]:
        return True
    x, y = set(a[3].split()), set(b[3].split())
    first, second = sorted((a, b), key=lambda x: (x[1], x[2], x[4]))
    return len(x & y) >= 0.6 * len(x | y) or difflib.SequenceMatcher(None, first[3], second[3], autojunk=False).ratio() >= 0.6


def test_duplicates_of_chunks(spark):
    draw = random.Random(6)
    vocabulary = "so this is what we were told about it yes no".split()
    rows = []
    for i in range(120):
        start = draw.randrange(0, 20_000)
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 6)))
        rows.append(("r", i % 3, i, start, start + draw.choice([0, 400, 900, 1500]), draw.choice([text, text.upper() + "!"])))
    segments = spark.createDataFrame(rows, "rec_id string, chunk long, idx long, start_ms long, end_ms long, text string")
    middles = {0: 3000, 1: 9000, 2: 16_000}
    chunks = spark.createDataFrame([("r", c, m) for c, m in middles.items()], "rec_id string, chunk long, middle_ms long")
    key = lambda r: (r[1], r[3], r[4], r[5].lower().replace("!", "").strip(), r[2])
    pairs = {(r.idx, r.r_idx) for r in S.duplicate_pairs(segments).collect()}
    assert pairs == {(a[2], b[2]) for a in rows for b in rows if a[2] != b[2] and duplicates(key(a), key(b))} and pairs
    kept = []
    off = lambda r: abs((r[3] + r[4]) / 2 - middles[r[1]])
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[2])):
        at = next((k for k, o in enumerate(kept) if duplicates(key(o), key(r))), None)
        if at is None:
            kept.append(r)
        elif (off(r), -len(r[5])) < (off(kept[at]), -len(kept[at][5])):
            kept[at] = r
    assert sorted(r.idx for r in S.without_chunk_duplicates(segments, chunks).collect()) == sorted(r[2] for r in kept)


def bounds(spark, values, **sizes):
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "key string, place long, x double")
    return [(r.start, r.stop) for r in C.quiet_chunks(rows, **sizes).orderBy("chunk").collect()]


def bounds_by_hand(values, chunk, overlap, frame, hop):
    lap = min(overlap, chunk // 2)
    step, radius, n = max(1, chunk - lap), lap // 2, len(values)
    starts = list(range(0, max(1, n - frame + 1), hop))
    energy = [np.mean(np.square(values[s : s + frame])) for s in starts]
    out = [0]
    while out[-1] + step < n and n - out[-1] - step > lap:
        target = out[-1] + step
        near = [(e, abs(s + frame // 2 - target), s + frame // 2) for s, e in zip(starts, energy) if abs(s + frame // 2 - target) <= radius]
        best = min(near)[2] if near and radius else target
        out.append(max(out[-1] + 1, min(best, n - 1)))
    return [(a, n if a == out[-1] else min(a + chunk, n)) for a in out]


def test_bounds_move_to_the_quiet_place(spark):
    loud = np.full(400, 0.5)
    loud[270:290] = 0
    assert bounds(spark, loud, chunk=300, overlap=20, frame=10, hop=5)[1][0] in range(270, 291)
    draw = np.random.default_rng(1)
    for n, chunk, overlap, frame, hop in [(500, 60, 20, 7, 3), (90, 60, 20, 5, 5), (130, 40, 60, 4, 2), (200, 50, 0, 5, 5), (61, 60, 10, 5, 2), (3, 60, 10, 5, 2), (300, 50, 4, 9, 20)]:
        values = draw.integers(-3, 4, n).astype(float)
        assert bounds(spark, values, chunk=chunk, overlap=overlap, frame=frame, hop=hop) == bounds_by_hand(values, chunk, overlap, frame, hop), (n, chunk, overlap, frame, hop)
    assert C.quiet_chunks(spark.createDataFrame([], "key string, place long, x double"), 10, 2, 3, 1).collect() == []


def test_queries_cut_something(spark):
    from parlance.plans import seam_queries as Q
    from tests.compare import DATA

    before = Q.heard_segments(Q.heard_words(spark, DATA), "turn").agg(F.sum(F.size("words"))).first()[0]
    after = Q.w14(spark, DATA).agg(F.sum("n_words")).first()[0]
    assert 0 < before - after < before / 2
    pieces = Q.heard_segments(Q.heard_words(spark, DATA), "n div 3").count()
    assert Q.j13(spark, DATA).count() < pieces


def test_segments_meet_in_bins_as_wide_as_they_last(spark, monkeypatch):
    widths, plain = [], S.I.overlap_join

    def join(left, right, keys, bin_ms=S.I.BIN_MS, **more):
        widths.append(bin_ms)
        return plain(left, right, keys, bin_ms, **more)

    monkeypatch.setattr(S.I, "overlap_join", join)
    rows = [("r", i % 2, i, 300 * i, 300 * i + 900, f"word{i // 2} said") for i in range(400)]
    rows += [("r", 5, 400, 0, 90_000, "all of this"), ("r", 6, 401, 3_000, 80_000, "this, all of this"), ("r", 7, 402, 100, 100, "all of this"), ("s", 5, 403, 0, 90_000, "all of this")]
    segments = spark.createDataFrame(rows, "rec_id string, chunk long, idx long, start_ms long, end_ms long, text string")
    pairs = {(r.idx, r.r_idx) for r in S.duplicate_pairs(segments).collect()}
    key = lambda r: (r[1], r[3], r[4], r[5].lower().replace(",", ""), r[2])
    expected = {(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and duplicates(key(a), key(b))}
    assert pairs == expected and {(400, 401), (0, 1)} <= pairs
    # one bin of ten minutes would hold all
    assert widths and max(widths) <= 2 * sum(r[4] - r[3] for r in rows) / len(rows)
    assert S.duplicate_pairs(segments.limit(0)).collect() == []
