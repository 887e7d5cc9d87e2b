"""Runs of repeated words against a search of all periods."""

import hashlib
import random
from zlib import crc32

from hypothesis import given
from hypothesis import strategies as st

from parlance.llm.runs import candidates, find_runs, periodic_runs, text_runs, without_repeats

PLACES = st.lists(st.integers(0, 2), max_size=40).map(lambda xs: [b"%d" % x for x in xs])


def plain_runs(words, least):
    """Longest stretches equal to themselves ``q`` words on, for each q, where no smaller period holds."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            own = words[start : start + size]
            if size >= max(least, 2 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((start, size, q))
            i += i == start
    return sorted(out)


@given(PLACES, st.sampled_from([2, 3, 5, 12]))
def test_runs_equal_a_search_of_all_periods(words, least):
    assert find_runs(words, least) == plain_runs(words, least) == text_runs(words, least)


def test_planted_repeats_and_fibonacci_words():
    draw = random.Random(3)
    for _ in range(300):
        words = [b"%d" % draw.randrange(draw.choice([2, 4, 30])) for _ in range(draw.randrange(1, 90))]
        a, p = draw.randrange(len(words)), draw.randrange(1, 15)
        words = words[:a] + (words[a : a + p] * 90)[: len(words) - a]
        assert text_runs(words) == plain_runs(words, 12)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert text_runs(b) == plain_runs(b, 12)


def test_texts_without_recurring_words_need_no_automaton():
    assert candidates([b"%d" % i for i in range(500)] + [b"x"] * 5, 12) == []
    assert candidates([b"x"] * 12, 12) == [(0, 12)]
    assert candidates([b"x"] * 11, 12) == []


def test_a_very_long_run_is_linear():
    assert text_runs([b"x"] * 200_000) == [(0, 200_000, 1)]
    words = [b"%d" % (i % 40_000) for i in range(120_000)]
    assert text_runs(words) == [(0, 120_000, 40_000)]


def test_words_after_the_first_period_go():
    words = b"a b c a b c a b c d".split()
    assert without_repeats(words, [(0, 9, 3)]) == b"a b c d".split()
    assert without_repeats(words, []) == words


def by_hand(doc_id, text, planted):
    words = [w for w in (text or "").encode().split() if w]
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, best[0] is not None and best[1] * 1000 // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_rows_nulls_repeats_and_other_columns(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["été", "b", "c\x0b", "D\t"]) for _ in range(draw.randrange(60))) for _ in range(120)]
    texts += [None, "", " \n", "a " * 12, "a " * 11, "A a " * 20]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, "x y " * 9, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    for planted in (False, True):
        found = periodic_runs(docs, planted=planted).drop("runs").collect()
        assert sorted(map(tuple, found), key=repr) == sorted((by_hand(i, t, planted) for i, t, _ in rows), key=repr)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query_on_a_table(spark):
    from parlance.llm import queries
    from tests.compare import DATA

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r.text or "") < 6000}
    found = {r[0]: tuple(r)[:8] for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert len(docs) > 100 and any(found[i][1] for i in docs)
    assert all(found[i] == by_hand(i, t, True) for i, t in docs.items())
