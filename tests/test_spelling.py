"""Corrections from a dictionary against a search through all forms with one beginning."""

import difflib
import random

from parlance.operators import spelling as S


def forms_of(spark, words, dictionary, **limits):
    w = spark.createDataFrame([(x,) for x in words], "word string")
    d = spark.createDataFrame([(x,) for x in dictionary], "form string")
    return S.known_forms(w, d, **limits)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def by_hand(word, dictionary, least_length, most_edits, least_ratio, most_candidates):
    forms = sorted(set(dictionary), key=lambda f: f.encode())
    if word in forms or len(word) < least_length:
        return None
    for n in range(min(8, len(word) - 1), 3, -1):
        best = None
        for form in [f for f in forms if f[:n] == word[:n] and len(f) >= least_length][:most_candidates]:
            ratio = difflib.SequenceMatcher(None, word, form, autojunk=False).ratio()
            if distance(word, form) <= most_edits and ratio >= least_ratio and (best is None or ratio > best[1]):
                best = (form, ratio, n)
        if best:
            return best
    return None


def test_back_off_ties_and_bounds(spark):
    draw = random.Random(8)
    dictionary = ["".join(draw.choice("аб") for _ in range(draw.randint(5, 12))) for _ in range(250)]
    words = ["".join(draw.choice("абв") for _ in range(draw.randint(4, 12))) for _ in range(60)]
    words += [w[: k % len(w)] + "в" + w[k % len(w) + k % 2 :] for k, w in enumerate(dictionary[:80])]
    for limits in ({"least_length": 6, "most_edits": 1, "least_ratio": 0.8, "most_candidates": 8000}, {"least_length": 4, "most_edits": 2, "least_ratio": 0.7, "most_candidates": 3}):
        found = {r.word: (r.form, r.ratio, r.prefix) for r in forms_of(spark, words, dictionary, **limits).collect()}
        expected = {w: by_hand(w, dictionary, **limits) for w in set(words)}
        assert found == {w: b for w, b in expected.items() if b} and len(found) > 20


def test_texts_keep_case_and_foreign_words_stay(spark):
    dictionary = ["безопасность", "информационная"]
    texts = ["Безопастность и БЕЗОПАСНОТЬ, информационная login безопасностьx", None, ""]
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = ["безопастность", "Безопасноть", "login", "безопасностьx", "и", "информационная"]
    forms = forms_of(spark, words, dictionary, least_ratio=0.9)
    assert {r.word for r in forms.collect()} == {"безопастность", "безопасноть"}
    out = {r.id: (r.text, r.n_edits) for r in S.spelled_texts(t, forms).collect()}
    assert out == {0: ("Безопасность и БЕЗОПАСНОСТЬ, информационная login безопасностьx", 2), 1: (None, 0), 2: ("", 0)}
    assert forms_of(spark, [], dictionary).collect() == [] == forms_of(spark, words, []).collect()


def test_a_crowded_beginning_hides_no_form(spark):
    dictionary = [f"prefixab{a}{b}{c}{d}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij" for d in "abcdefghi"]
    found = forms_of(spark, ["prefixabjjjiz"], [*dictionary, "prefixabjjji"], least_ratio=0.9, foreign="[0-9]").collect()
    assert [(r.word, r.form, r.prefix) for r in found] == [("prefixabjjjiz", "prefixabjjji", 8)]


def test_f21_query_has_no_bound(spark, tmp_path):
    from parlance.plans import phrase_queries as Q

    names = [f"prefixab{a}{b}{c}cdef" for a in "abcd" for b in "abcd" for c in "abcd"] + ["prefixabzzzcdef"]
    rows = [(i, " ".join(names), "en") for i in range(3)] + [(3, "prefixabzzzcdeg", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r.word, r.form) for r in Q.f21(spark, str(tmp_path)).collect()]
    assert found == [("prefixabzzzcdeg", "prefixabzzzcdef")]
