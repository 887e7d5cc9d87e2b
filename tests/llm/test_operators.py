"""The ten operators on edge cases, and against brute force where SQL cannot say what they do."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import bpe, dedup, fixity, jaccard, licences, mixing, nearest, packing, pii, queries, toxicity
from tests.compare import DATA, rows_of, rows_of_sql

DOC = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, n_tokens string"


def docs_of(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None if k % 3 else "en", f"s{k % 2}", 0, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts))], DOC)


def stored(df, tmp_path, name="docs"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return path


ODD = [None, "", "   ", "a", "A  b", "a b", " ab\n", "x" * 5000, "word " * 3000, "Ünï ß é", "a <|endoftext|> b", "a <|endoftext|> b"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = rows_of(queries.QUERIES[name](spark, DATA))
    expected_columns, expected = rows_of_sql(queries.ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


# 1 exact dedup


def test_dedup_edge_cases(spark, tmp_path):
    ids = [*range(len(ODD)), 3, None]
    path = stored(docs_of(spark, [*ODD, "a", "a b"], ids), tmp_path)
    rows = dedup.exact_dedup(spark, path).collect()
    assert len(rows) == len(ODD) + 2
    groups = defaultdict(list)
    for i, t in zip(ids, [*ODD, "a", "a b"]):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in rows:
        group = by_hash[r.text_sha256]
        best = min(group, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(group))
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_dedup_goes_on_from_its_state(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    docs_of(spark, ["one", "two"]).write.parquet(folder)
    assert {r.group_size for r in dedup.run_stream(spark, folder, state).collect()} == {1}
    docs_of(spark, ["t wo", "three"], [10, 11]).write.mode("append").parquet(folder)
    found = {r.keep_id: r.group_size for r in dedup.run_stream(spark, folder, state).collect()}
    assert found == {0: 1, 10: 2, 11: 1}


def test_dedup_of_an_empty_table(spark, tmp_path):
    assert dedup.exact_dedup(spark, stored(docs_of(spark, []), tmp_path)).collect() == []


def test_dedup_separates_unequal_bytes(spark):
    rows = spark.createDataFrame([(1, b"d", 10, 1, 3, 10, bytearray(b"x"), "x"), (2, b"d", 11, 1, 3, 10, bytearray(b"x"), "x "), (3, b"d", 12, 1, 3, 10, bytearray(b"y"), "y")], "doc_id long, _digest binary, _here long, _keep long, _n long, _keeper long, _bytes binary, text string")
    found = {r.doc_id: (r._n, r._keep) for r in dedup._resolve(rows, "text").collect()}
    assert found == {1: (2, 2), 2: (2, 2), 3: (1, 3)}


# 2 token counts


def test_token_counts_equal_the_library(spark):
    r = random.Random(3)
    letters = "abcdeABC'.,!  \n\t0123456789éßΣ’😀中文ё"
    texts = [*ODD, *("".join(r.choice(letters) for _ in range(r.randrange(1, 120))) for _ in range(400)), "aaaa" * 50, "don't I'LL we've"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    out = bpe.token_counts(docs_of(spark, texts), public_tokenizers.path("word_bpe_49k.json"), limit=30).collect()
    assert [x.n_tokens for x in sorted(out, key=lambda x: x.doc_id)] == expected
    assert all(x.n_bytes == len((texts[x.doc_id] or "").encode()) and x.over_limit == (x.n_tokens > 30) for x in out)
    assert bpe.token_counts(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_token_counts_of_all_letters():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b" for c in points[k : k + 16]) for k in range(0, len(points), 16)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    found = bpe.counter(public_tokenizers.path("word_bpe_49k.json")).count_batch(texts)
    wrong = [hex(16 * k) for k, (a, b) in enumerate(zip(expected, found)) if a != b]
    assert not wrong


# 3 n-gram Jaccard join


def brute_components(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n, percent, short", [(3, 90, 16), (5, 80, 2), (2, 50, 2)])
def test_jaccard_components(spark, monkeypatch, n, percent, short):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    r = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    texts = [*ODD]
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.randrange(5, 60))]
        for _ in range(14):  # chains of copies of copies, so that links are not all to one centre
            base = [r.choice(words) if r.random() < 0.02 else w for w in base]
            texts.append(" ".join(base))
    base = [r.choice(words) for _ in range(80)]
    for k in range(40):  # one family around a centre, some members of which are just too far from it
        own = [f"v{k} {w}" if r.random() < 0.004 * (k % 9) else w for w in base]
        texts.append(" ".join(own if k % 4 else own[: 80 - k % 7]))
    docs = list(enumerate(texts))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs_of(spark, texts), n, percent).collect()}
    assert found == brute_components(docs, n, percent)


def test_jaccard_nulls_and_repeats(spark):
    found = jaccard.jaccard_components(docs_of(spark, ["a b c", "a b c", "a b c", None], [5, 5, None, 7]), 2, 80).collect()
    assert Counter((x.doc_id, x.component_id) for x in found) == {(5, 5): 2, (None, None): 1, (7, 7): 1}
    assert jaccard.jaccard_components(docs_of(spark, [])).collect() == []


# 4 nearest neighbours


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    vectors = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 32))
    vectors[100:140] = vectors[100]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0, None] * 16), (2004, [1.0]), (None, vectors[0].tolist()), (7, vectors[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(table, table.where("vec_id % 50 = 0")).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    by = defaultdict(dict)
    for x in found:
        by[x.query_id][x.rank] = x.vec_id
    assert set(by) == set(range(0, 1500, 50))
    hits = 0
    for q, ranks in by.items():
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        best = np.lexsort((np.arange(1500), -score))[:5]
        hits += len(set(best) & set(ranks.values()))
        assert sorted(ranks) == [1, 2, 3, 4, 5]
    assert hits / (5 * len(by)) >= 0.9
    assert [by[100][k] for k in range(1, 6)] == [101, 102, 103, 104, 105]


def test_nearest_of_extreme_and_repeated_vectors(spark):
    rows = [(0, [1e300, 0.0]), (1, [1e300, 1e299]), (2, [1e-320, 0.0]), (3, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(table, table.where("vec_id = 0")).collect()
    assert [(x.rank, x.vec_id) for x in sorted(found, key=lambda x: x.rank)] == [(1, 2), (2, 1), (3, 4), (4, 3)]
    assert [round(x.score, 9) for x in sorted(found, key=lambda x: x.rank)] == [1.0, round(1 / 1.01**0.5, 9), round(0.5**0.5, 9), -1.0]


def test_nearest_of_few(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(x.query_id, x.rank, x.vec_id) for x in nearest.nearest(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    assert nearest.nearest(table.limit(0), table.limit(0)).collect() == []


# 5 packing


def test_packing_round_trip(spark):
    texts = [*ODD, *(f"some text {k} " * (k % 97 + 1) for k in range(150))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    rows = packing.pack(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, own in enumerate(ids):
        at = 0
        for k, x in enumerate(sorted(by_doc[i], key=lambda x: x.piece)):
            assert (x.piece, x.start) == (k, at) and (x.length == 1024 or k == 0)
            assert x.ids_crc32 == zlib.crc32(np.array(own[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(own)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.02 * sum(map(len, ids)) / 1024 + 1
    assert packing.pack(docs_of(spark, []), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_two_fit_beats_greedy():
    counts = np.zeros(11, dtype=np.int64)
    for n in (6, 3, 2, 2, 5, 5):
        counts[n] += 1
    patterns, times = packing.best_two_fit(counts, 10)
    assert all(sum(p) <= 10 for p in patterns)
    assert Counter(n for p, k in zip(patterns, times) for n in p * k) == {6: 1, 3: 1, 2: 2, 5: 2}
    assert [6, 2, 2] in patterns


def test_packing_of_very_long_blanks(spark):
    texts = ["a" + " " * 1_000_000 + "b", "\n" * 300_000, "word " * 60_000]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pieces_of(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.json")).collect()
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        own = sorted((x.start, x.length, x.ids_crc32) for x in rows if x.doc_id == i)
        assert own == [(a, n, zlib.crc32(np.array(ids[a : a + n], dtype="<u4").tobytes())) for a, n in packing.cut(len(ids), 1024)]


# 6 mixing


def test_mixing_meets_its_targets(spark):
    docs = docs_of(spark, ["a b c d"] * 50 + ["one", "two words", "x!! y", None, ""], None)
    cells = mixing.features(docs).groupBy(*(f"_{m}" for m in mixing.MARGINS)).sum("_tokens").toDF(*mixing.MARGINS, "tokens")
    raked = mixing.rake(cells).toPandas()
    for m in mixing.MARGINS:
        share = raked.groupby(m)["raked"].sum()
        assert np.allclose(share, raked.groupby(m)[f"goal_{m}"].first(), atol=1e-9)
    out = mixing.mix(docs).collect()
    assert len(out) == 55 and all(0 <= x.probability <= 1 for x in out)
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_mixing_keeps_by_id_alone(spark):
    docs = docs_of(spark, [f"text number {k}" for k in range(200)])
    one = {x.doc_id: x.kept for x in mixing.mix(docs).collect()}
    assert one == {x.doc_id: x.kept for x in mixing.mix(docs.repartition(7)).collect()}
    assert 100 < sum(one.values()) < 200


# 7 licences


def test_licence_scan(spark):
    mit = licences.TEMPLATES["MIT-permission"]
    gone = mit.split()
    gone[9] = "changed"
    texts = [None, "", "license", f"x y z {mit.upper()} and more", " ".join(gone), "Licensed under the Apache License, Version 2.0.", "licensed under\nCC-BY NC 4.0!", "a permission of a person to copy", "filler " * 500 + mit]
    found = {(x.doc_id, x.licence) for x in licences.licence_scan(docs_of(spark, texts)).collect()}
    assert found == {(3, "MIT-permission"), (5, "Apache-2.0"), (6, "CC-BY-NC-4.0"), (8, "MIT-permission")}
    assert licences.licence_scan(docs_of(spark, [])).collect() == []


def test_without_anchors_no_template_is_held():
    own = {n: licences.template_words(t) for n, t in licences.TEMPLATES.items()}
    found = set(licences.anchors(own))
    for words in own.values():
        shingles = {tuple(words[i : i + licences.SHINGLE]) for i in range(max(1, len(words) - licences.SHINGLE + 1))}
        assert sum(not found & set(s) for s in shingles) < licences.CONTAINMENT * len(shingles)


# 8 fixity


def test_audit_finds_every_fault(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(3000)] + [(None, None, None), (5, "http://h/5", None)], "page_id long, url string, html string")
    records = fixity.warc_records(pages)
    one = fixity.placed(fixity.hashed(records)).cache()
    two = one.where("page_id <> 17").withColumn("sha256", __import__("pyspark").sql.functions.expr("case when page_id = 2500 then 'bad' else sha256 end"))
    status = Counter((x.page_id, x.status) for x in fixity.audit(one, two).where("status <> 'ok'").collect())
    assert status == {(17, "missing"): 1, (2500, "damaged"): 1}
    assert fixity.audit(one, two).count() == 3002
    assert fixity.audit(two, one).where("status = 'extra'").count() == 1
    assert fixity.audit(one.limit(0), one.limit(0)).collect() == []


# 9 personal data


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_equal_the_rules(spark):
    r = random.Random(9)
    parts = ["a@b.c", "@", ".", "-", "1", "255", "300", "1.2.3.4", "+4", " ", "é", "😀", "4111111111111111", "4111 1111-1111 1112", "(0)", "x", "_", "%"]
    texts = [*ODD, "9" * 20_000, "1 " * 9000 + "4111111111111111", "a@b.c@d.e.f_x@y.z", *("".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(300))]
    rows = {x.doc_id: x for x in pii.personal_data(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(k, m.start(), m.end()) for k in BASE for m in re.finditer(BASE[k], t or "") if counts(k, m[0])]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), t
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(rows[i].spans.split(","))
    assert pii.personal_data(docs_of(spark, [])).collect() == []


def test_added_spans(spark):
    texts = [f'key{k} text token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end' for k in range(40)] + ["plain words that are long: donaudampfschifffahrtsgesellschaft"]
    rows = pii.personal_data(docs_of(spark, texts)).collect()
    assert sum("secret:" in x.spans for x in rows) == 40 and all(x.n_added <= 1 for x in rows)
    assert [x.spans for x in rows if x.doc_id == 40] == [""]


# 10 toxicity


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    score, move = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    log_z, marginal, pair = toxicity.forward_backward(score, np.ones((1, 5), dtype=bool), move)
    weights = {}
    for bits in range(32):
        y = [(bits >> k) & 1 for k in range(5)]
        weights[tuple(y)] = np.exp(sum(score[0, k] * y[k] for k in range(5)) + sum(move[y[k], y[k + 1]] for k in range(4)))
    z = sum(weights.values())
    assert np.isclose(log_z[0], np.log(z))
    assert np.allclose(marginal[0], [sum(w for y, w in weights.items() if y[k]) / z for k in range(5)])
    assert np.allclose(pair[0, 1, 0], sum(w * sum(y[k] == 1 and y[k + 1] == 0 for k in range(4)) for y, w in weights.items()) / z)


def test_toxicity_learns_words_and_spans(spark):
    r = random.Random(4)
    words = ["".join(r.choice("bcdfgmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    texts, labels = [], []
    for i in range(600):
        t = [r.choice(words) for _ in range(40)]
        if i % 4 == 0:
            t[r.randrange(40)] = r.choice(["vile", "Nasty"])
        texts.append(" ".join(t) + ".")
        labels.append((i, 1 if i % 4 == 0 else 0))
    docs = docs_of(spark, [*texts, None, "", "é vile!"])
    table = spark.createDataFrame([(i, 1, t) for i, t in labels] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in toxicity.score(docs, toxicity.train(docs, table)).withColumn("held_out", toxicity.held_out()).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in held) for i, _ in labels)
    assert np.mean([out[i].predicted == labels[i][1] for i in held]) >= 0.97
    assert out[602].toxic_spans == "2:6" and out[600].toxic_spans == "" and out[600].predicted == 0 == out[601].predicted
    assert out[602].keep_id == "x"


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [x.predicted for x in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_of_held_out_rows(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out())
    found = Counter((x.toxic, x.predicted) for x in out.collect())
    assert found[1, 1] >= 0.6 * (found[1, 1] + found[1, 0])
    assert found[0, 1] <= 0.03 * (found[0, 0] + found[0, 1])
