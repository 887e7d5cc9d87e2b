"""Every link of the n-gram Jaccard join, against brute force."""

import random
import re
from collections import defaultdict

import pytest

from parlance.llm import jaccard
from tests.llm.test_operators import ODD, brute_components, docs_of


def brute_links(texts, n, percent):
    """Links of classes with shared and united shingles, and for each text the number of others that are as similar."""
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    links, counts = set(), defaultdict(int)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                counts[i] += 1
                counts[j] += 1
                if a != b:
                    links.add((*sorted((first[a], first[b])), len(a & b), len(a | b)))
    return links, [counts[i] for i in range(len(texts))]


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = [*ODD]
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.randrange(120, 200))]
        for _ in range(14):  # copies of copies: many links that are not to one centre
            base[r.randrange(len(base))] = r.choice(words)
            texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("n, percent, block", [(3, 90, 64), (5, 80, 3), (2, 50, 4)])
def test_every_link_is_found(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_copies(n)
    links, counts = brute_links(texts, n, percent)
    assert len(links) > len(texts)
    rows = jaccard.jaccard_links(docs_of(spark, texts), n, percent).collect()
    assert len(rows) == len(links)
    assert {tuple(x) for x in rows} == links
    if block == 3:
        found = {x.doc_id: x for x in jaccard.jaccard_counts(docs_of(spark, texts), n, percent).collect()}
        assert [found[i].n_links for i in range(len(texts))] == counts
        assert {i: (x.n_shingles, x.component_id) for i, x in found.items()} == brute_components(list(enumerate(texts)), n, percent)


def test_links_of_none_and_of_repeats(spark):
    assert jaccard.jaccard_links(docs_of(spark, [])).collect() == []
    docs = docs_of(spark, ["a b c", "a b c", "a b c", None, "a b c d e"], [5, 5, None, 7, 8])
    assert [tuple(x) for x in jaccard.jaccard_links(docs, 2, 50).collect()] == [(5, 8, 2, 4)]
    found = sorted((x.doc_id or 0, x.n_links) for x in jaccard.jaccard_counts(docs, 2, 50).collect())
    assert found == [(0, 0), (5, 2), (5, 2), (7, 0), (8, 2)]


def test_lists_of_one_hub_give_their_pairs_once(spark, monkeypatch):
    """Copies of a long text that do not link meet in many lists; what these lose by being one is no pair."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base, texts = [r.choice(words) for _ in range(400)], [*ODD]
    for _ in range(16):
        own = list(base)
        for k in r.sample(range(400), 10):
            own[k] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [texts[-1] + " end", texts[-2] + " end"]
    kept, write = {}, jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: kept.setdefault(name, write(df, name)) if name in ("short", "paired") else write(df, name))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert found == brute_components(list(enumerate(texts)), 5, 80)
    pairs = {}
    for name, table in kept.items():
        lists = defaultdict(list)
        for x in table.collect():
            lists[x.kind, x.hub, x.token].append(x.id)
        pairs[name] = [(a, b) for ids in lists.values() for a in ids for b in ids if a < b]
    assert set(pairs["short"]) <= set(pairs["paired"])
    assert len(pairs["short"]) > 2 * len(pairs["paired"]) > 0
