"""Phrases against plain counting, with samples that propose too little."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from parlance.llm import collocations as c


def plain(rows, support, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            f.update((lang or "und", tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    f = {p: n for p, n in f.items() if n >= support}
    covered = {(lang, w[i : i + m]) for (lang, w), n in f.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if f[lang, w[i : i + m]] <= n}
    out = []
    for lang in total:
        ranked = []
        for (own, w), a in f.items():
            if own == lang and len(w) > 1 and (lang, w) not in covered:
                n = total[lang]
                cuts = [(1000 * a * n // (f[lang, w[:i]] * f[lang, w[i:]]), i, f[lang, w[:i]], f[lang, w[i:]]) for i in range(1, len(w))]
                score, _, l, r = min(cuts)
                ranked.append((-score, -a, " ".join(w).encode(), l, r, n))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r, n) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def texts(seed, n):
    draw = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é", "x", "y", "z", "w1", "w2", "İ", "k\x1cv"]
    stock = ["a b c d e f", "the end of the road", "one, two; three", "of of of of of of"]
    for _ in range(n):
        words = [draw.choice(vocabulary) if draw.random() < 0.8 else draw.choice(stock) for _ in range(draw.randrange(30))]
        yield draw.choice(["en", "de", None]), "".join(w + draw.choice([" ", "  ", "\t", ", ", ".", "\n"]) for w in words)


@pytest.mark.parametrize("share, slack", [(0.1, 0.5), (0.0, 1.0), (1.0, 1.0), (0.5, 2.0)])
def test_equals_plain_counting_whatever_the_sample(spark, share, slack):
    rows = [*texts(1, 150), ("en", None), ("en", ""), (None, "a b c d e f " * 10)]
    docs = spark.createDataFrame([(i, lang, t, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    found = c.collocations(docs, support=8, top=25, share=share, slack=slack)
    assert sorted(map(tuple, found.collect())) == plain(rows, 8, 25)


def test_border_failures_are_closed_in_one_more_pass(spark):
    """With nothing proposed the first pass counts words alone; the second one all their extensions, step by step."""
    docs = spark.createDataFrame([(i, "en", "p q r s t u") for i in range(20)], "doc_id long, lang string, text string")
    for share in (1.0, 0.0):
        found = c.mine(docs, support=10, share=share)
        assert found.where("k > 0").count() == 6 + 5 + 4 + 3 + 2
    grams = c.phrases_of([b"p q r"], np.zeros(1, dtype=np.uint64), 3)[1]
    none = c.BitMap(np.zeros(1 << 10, dtype=np.uint64), 16)
    every = c.BitMap(np.full(1 << 10, 2**64 - 1, dtype=np.uint64), 16)
    marks = lambda proposed, frequent: [x.tolist() for x in c.frequent_or_new(grams, proposed, frequent)]
    assert marks(none, every) == marks(every, every) == [[True] * 3, [True] * 2, [True]]
    assert marks(every, none) == marks(none, none) == [[False] * 3, [False] * 2, [False]]
    words = c.BitMap(np.zeros(1 << 10, dtype=np.uint64), 16)
    for g in grams[0][0]:
        for place in (int(g) & 0xFFFF, int(g) >> 24 & 0xFFFF, int(g) >> 48):
            words.cells[place >> 6] |= np.uint64(1 << (place & 63))
    assert marks(none, words)[2] == [True]  # an extension of extensions
    assert marks(words, words)[1:] == [[False] * 2, [False]]  # counted before, and not frequent


def test_hashes_that_meet_do_not_mix_counts(spark, monkeypatch):
    """With bit maps that let everything pass, the counts are still those of the texts."""
    rows = [*texts(2, 60)]
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    full = c.BitMap(np.full(1 << 10, 2**64 - 1, dtype=np.uint64), 16)
    monkeypatch.setattr(c.BitMap, "of", staticmethod(lambda *_: full))
    found = c.collocations(docs, support=3, top=10)
    assert sorted(map(tuple, found.collect())) == plain(rows, 3, 10)


def test_repeated_rows_empty_tables_and_wide_products(spark):
    docs = spark.createDataFrame([(None, None, "A b")] * 12, "doc_id long, lang string, text string")
    assert [tuple(r) for r in c.collocations(docs, support=12).collect()] == [("und", 1, "a b", 12, 12, 12, 24, 2000)]
    assert c.collocations(docs.limit(0)).collect() == [] == c.collocations(docs, support=13).collect()
    wide = spark.sql(f"SELECT ({c._exact('3000000000001L', '9000000000000007L')} * 1000) div ({c._exact('7000000003L', '8000000009L')}) AS score").first()
    assert wide.score == 1000 * 3000000000001 * 9000000000000007 // (7000000003 * 8000000009)
