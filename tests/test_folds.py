"""Operators that SQL cannot say, against independent plain versions on small seeded input."""

import random
import re
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import edits
from parlance.functions.text import splice_terms, trim_noise_edges
from parlance.operators import graph, intervals, sequences, similarity
from parlance.sources import exports, scans


def naive_best(seg, spk):
    out = {}
    for i, s, e in seg:
        best = max(((min(e, b) - max(s, a), -k, name) for k, a, b, name in spk), default=(0, 0, None))
        out[i] = best[2] if best[0] > 0 else None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_join_equals_a_loop(spark, seed):
    r = random.Random(seed)
    seg = [(i, s := r.randrange(0, 4_000_000), s + r.choice([0, 1, 500, 60_000, 900_000, -50])) for i in range(150)]
    spk = [(i, s := r.randrange(0, 4_000_000), s + r.choice([0, 1, 700, 50_000, 1_300_000, -10]), f"S{r.randrange(5)}") for i in range(150)]
    a = spark.createDataFrame([("r", *x) for x in seg], "rec_id string, idx long, start_ms long, end_ms long")
    b = spark.createDataFrame([("r", *x) for x in spk], "rec_id string, idx long, start_ms long, end_ms long, speaker_id string")
    found = {x.idx: x.speaker_id for x in intervals.best_overlap(a, b).collect()}
    assert found == naive_best(seg, spk)


def test_touching_intervals(spark):
    rows = spark.createDataFrame([("r", 0, 0, 10, "A"), ("r", 1, 10, 20, "A"), ("r", 2, 15, 15, "B"), ("r", 3, 12, 18, "B")], "rec_id string, idx long, start_ms long, end_ms long, speaker_id string")
    merged = {tuple(x) for x in intervals.islands(rows, ["rec_id", "speaker_id"]).select("speaker_id", "start_ms", "end_ms").collect()}
    assert merged == {("A", 0, 20), ("B", 12, 18)}
    assert [(x.start_ms, x.end_ms) for x in intervals.overlap_regions(rows).collect()] == [(12, 18)]


def test_no_speakers_means_no_confidence(spark):
    seg = spark.createDataFrame([("r", 0, 0, 10)], "rec_id string, idx long, start_ms long, end_ms long")
    spk = spark.createDataFrame([], "rec_id string, idx long, start_ms long, end_ms long, speaker_id string")
    row = intervals.attributed(seg, spk).first()
    assert row.speaker_id is None and row.confidence is None


ENTRY = "rec_id long, idx long, speaker_id string, text string, start_ms long, end_ms long, avg_logprob double, overlap boolean"


def entry(idx, speaker, text, start, end):
    return (1, idx, speaker, text, start, end, -0.5, False)


def test_context_fill_feeds_on_itself(spark):
    rows = [entry(0, "A", "one", 0, 1000), entry(1, None, "ok", 2000, 3000), entry(2, None, "yes", 4000, 5000), entry(3, "B", "two", 90_000, 91_000), entry(4, None, "a b c d e", 92_000, 93_000)]
    found = {r.idx: r.speaker_id for r in sequences.context_fill(spark.createDataFrame(rows, ENTRY)).collect()}
    assert found == {0: "A", 1: "A", 2: "A", 3: "B", 4: None}


def test_sessions_break_on_speaker_and_gap(spark):
    rows = [entry(0, None, "a", 0, 100), entry(1, None, " b ", 200, 9000), entry(2, None, "c", 14_000, 14_100), entry(3, None, "d", 19_101, 19_200), entry(4, "A", "e", 19_300, 19_400)]
    found = [(r.idx, r.text) for r in sequences.sessions(spark.createDataFrame(rows, ENTRY)).orderBy("idx").collect()]
    assert found == [(0, "a b c"), (3, "d"), (4, "e")]


def test_repeats_compare_with_the_kept_row(spark):
    rows = [entry(0, "A", "Thank you so much", 0, 10), entry(1, "A", "thank you, so much!", 10, 30), entry(2, "A", "yes", 30, 40), entry(3, "A", "yes", 40, 50)]
    found = [(r.idx, r.end_ms) for r in sequences.collapse_repeats(spark.createDataFrame(rows, ENTRY)).orderBy("idx").collect()]
    assert found == [(0, 30), (2, 40), (3, 50)]


@pytest.mark.parametrize(
    "text, expected",
    [("go go now", "go now"), ("да да", "да да"), ("9 9 9", "9 9 9"), ("all hosts are up – All hosts are up.", "all hosts are up –"), ("a b a b a b c", "a b c"), ("", "")],
)
def test_ngram_collapse(text, expected):
    assert sequences.collapse_ngrams(text) == expected


def collapsed_by_hand(words, least):
    """Words without the second of two equal sequences, the longest at the leftmost place first, each time from the start."""
    words = list(words)
    at = True
    while at:
        squares = ((i, -n) for i in range(len(words)) for n in range(1, len(words)) if i + 2 * n <= len(words) and words[i : i + n] == words[i + n : i + 2 * n])
        at = min((s for s in squares if -s[1] >= least or (s[1] == -1 and words[s[0]] not in ("да", "9"))), default=None)
        if at:
            del words[at[0] - at[1] : at[0] - 2 * at[1]]
    return words


def test_ngram_collapse_equals_a_search_from_the_start():
    draw = random.Random(9)
    for _ in range(1500):
        words = [draw.choice(draw.choice((["a", "b"], ["a", "b", "c", "да", "9"]))) for _ in range(draw.randint(0, 18))]
        words += words[draw.randint(0, len(words)) :]
        assert sequences.collapse_ngrams(" ".join(words)).split() == collapsed_by_hand(words, 2), words


def test_ngram_collapse_of_many_repeats_takes_one_scan():
    began = time.process_time()
    text = " ".join(f"w{i} x{i} w{i} x{i}" for i in range(5000))
    assert len(sequences.collapse_ngrams(text).split()) == 10_000
    assert time.process_time() - began < 8  # one scan for each repeat took minutes


def test_noise_series(spark):
    texts = ["Applause", "applause", "word here", "Silence", "[MUSIC]", "Thanks for watching!", "[laughter] so it is"]
    rows = [entry(i, "A", t, i * 10, i * 10 + 5) for i, t in enumerate(texts)]
    found = [(r.idx, r.text) for r in sequences.clean_artifacts(spark.createDataFrame(rows, ENTRY)).orderBy("idx").collect()]
    assert found == [(2, "word here"), (3, "Silence"), (6, "so it is")]


@pytest.mark.parametrize(
    "text, expected",
    [("Text. Laughter laughter", "Text."), ("Noise. So it is", "So it is"), ("Check the signal", "Check the signal"), ("music music", "music music"), ("music noise we go", "we go"), ("", "")],
)
def test_noise_edges(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(trim_noise_edges(F.col("t"))).first()[0] == expected


def test_noise_edges_of_many_texts(spark):
    """Edges found by counting words from both ends."""
    r = random.Random(5)
    words = ["Music", "laughter", "noise", "and", "we", "go", "so", "Шум", "да", "signals"]
    texts = ["".join(r.choice(words) + r.choice([" ", ". ", ", ", "… ", " - "]) for _ in range(r.randrange(7))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    found = {x.i: x.out for x in rows.select("i", trim_noise_edges(F.col("t")).alias("out")).collect()}
    quiet = {"music", "laughter", "noise", "and", "шум", "signals"}
    for i, t in enumerate(texts):
        own = list(re.finditer(r"[^\W\d_]+", t))
        kept = [m for m in own if m[0].lower() not in quiet]
        begin, end = 0, len(t)
        if len(own) > 1 and kept:
            before, behind = t[: kept[0].start()], t[kept[-1].end() :]
            n, m = (len(re.findall(r"[^\W\d_]+", x)) for x in (before, behind))
            if n > 1 or (n and re.search("[.!?…][^\\w]*$", before)):
                begin = kept[0].start()
            if m > 1 or (m and re.match("[^\\w]*[.!?…]", behind)):
                end = kept[-1].end() + re.search(r"[^\W\d_]", behind).start()
        assert found[i] == (t if (begin, end) == (0, len(t)) else t[begin:end].strip()), t


def plain_edits(text):
    found = [(m.start(), -m.end(), k, m.expand(to)) for k, (_, p, to) in enumerate(edits.RULES) for m in re.finditer(p, text) if m.expand(to) != m[0]]
    out, at = "", 0
    for start, minus, _, after in sorted(found):
        if start >= at:
            out, at = out + text[at:start] + after, -minus
    return out + text[at:]


def test_edits(spark):
    r = random.Random(8)
    texts = [" Well  well ,yes !! ( so ) 5 % a - b.Да.Нет  — x ", "", None, "plain", *("".join(r.choice("aБб5 \t,,.;:!?%()—-») ") for _ in range(60)) for _ in range(200))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = rows.select("i", "t", edits.apart(edits.hits(F.col("t"))).alias("edits"))
    found = {x.i: x.out for x in rows.select("i", edits.apply(F.col("t"), F.col("edits")).alias("out")).collect()}
    assert found == {i: None if t is None else plain_edits(t) for i, t in enumerate(texts)}
    assert found[0] == "Well well, yes!! (so) 5% a — b.Да. Нет — x"  # of marks and the blank before them the first match counts


def test_first_names_of_chunks(spark):
    r = random.Random(4)
    rows = [(r.randrange(3), k, r.randrange(6), f"n{r.randrange(5)}" if r.random() < 0.9 else None) for k in range(200)]
    expected = set()
    for g in range(3):
        named = {}
        for _, _, speaker, name in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            if name is not None and speaker not in named and name not in named.values():
                named[speaker] = name
        expected |= {(g, *x) for x in named.items()}
    df = spark.createDataFrame(rows, "group long, chunk long, speaker long, name string")
    assert {tuple(x) for x in sequences.first_names(df).collect()} == expected
    assert sequences.first_names(df.limit(0)).collect() == []


def test_spliced_terms(spark):
    out = lambda text, terms: spark.createDataFrame([(text,)], "t string").select(splice_terms(F.col("t"), terms)).first()[0]
    terms = {"machine learning": "ML", "Machine": "engine", "c++": "C plus plus", "aib": "OIB"}
    assert out("Machine Learning on a machine, machines and AIB (aib)", terms) == "ML on a engine, machines and OIB (OIB)"
    assert out(None, terms) is None and out("", terms) == "" and out("abc", {}) == "abc"


def test_words_keep_their_places():
    assert edits.sync_words(["a", "b"], ["a", "c"]) == []
    assert edits.sync_words(["Hi,", "[x]", "you"], ["hi", "you!"]) == [0, 2]
    assert edits.sync_words([], ["a"]) == []


def test_clustering_by_threshold_and_count():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99], [-1, 0]], dtype=float)
    for linkage in ("complete", "average", "single"):
        assert similarity.agglomerate(v, 0.3, linkage=linkage).tolist() == [0, 0, 1, 1, 2]
    assert len(set(similarity.agglomerate(v, 0, clusters=2, linkage="ward").tolist())) == 2
    assert similarity.agglomerate(v[:1], 0.3).tolist() == [0]


def test_exclusive_matching(spark):
    rows = [(0, 1, "x", 0.9), (0, 2, "x", 0.8), (0, 2, "y", 0.7), (0, 3, "y", 0.65), (0, 3, "z", 0.5)]
    found = similarity.exclusive_names(spark.createDataFrame(rows, "group long, speaker long, name string, score double")).collect()
    assert {(r.speaker, r.name) for r in found} == {(1, "x"), (2, "y")}


def test_components_equal_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    expected = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    found = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == expected


def test_readers(spark, tmp_path):
    lines = spark.createDataFrame([("SPEAKER rec 1 0.5 1.25 <NA> <NA> speaker_2 <NA> <NA>",), ("SPEAKER rec 1 x 1 <NA> <NA> a",), ("LEXEME rec",)], "value string")
    assert [tuple(r) for r in scans.rttm_lines(lines).collect()] == [("rec", 500, 1750, "SPEAKER_01")]
    assert scans.sniff_delimiter("a;b;c\n1;2;3\n") == ";"
    (tmp_path / "g.csv").write_text("Термин;ошибка\nSpark;спарк\n", encoding="utf-8")
    assert [(r.canonical, r.variant) for r in scans.read_glossary_csv(spark, str(tmp_path / "g.csv")).collect()] == [("Spark", "спарк")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(16000)
        f.writeframes(np.array([0, 16384, -32768], dtype="<i2").tobytes())
    row = scans.wav_samples(spark.read.format("binaryFile").load(str(tmp_path / "a.wav"))).first()
    assert row.rate == 16000 and list(row.samples) == [0.0, 0.5, -1.0]


def test_export_and_partition_upsert(spark, tmp_path):
    rows = spark.createDataFrame([entry(0, "A", "hi <b>", 0, 1500), entry(1, None, "there", 1500, 2500)], ENTRY)
    for fmt in exports.EXPORTERS:
        exports.export(rows, str(tmp_path / fmt), fmt)
    text = [r.value for r in spark.read.text(str(tmp_path / "vtt")).collect()]
    assert "<v A>hi &lt;b&gt;" in text and "00:00:00.000 --> 00:00:01.500" in text
    path = str(tmp_path / "index")
    exports.upsert_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, t string"), path)
    exports.upsert_partitions(spark.createDataFrame([(2, "c")], "job_id long, t string"), path)
    assert {(r.job_id, r.t) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_stages_can_be_replaced(spark):
    from parlance.plans import stages

    seg = spark.createDataFrame([("r", 0, 0, 1000, "hello there", -0.2)], "rec_id string, idx long, start_ms long, end_ms long, text string, avg_logprob double")
    spk = spark.createDataFrame([("r", 0, 0, 600, "A")], "rec_id string, idx long, start_ms long, end_ms long, speaker_id string")
    plan = stages.transcript_plan(spk)
    assert plan.run(seg).first().speaker_id == "A"
    assert plan.using(merge=lambda df: df.selectExpr("*", "'Z' as speaker_id", "false as overlap")).run(seg).first().speaker_id == "Z"
    assert stages.engine(3) == "single" and stages.engine(None) == "windowed"


def test_folders_of_recordings_are_dealt_over_tasks(spark, tmp_path):
    path = str(tmp_path / "slides")
    rows = [(i, 100 * k, None, f"t{k}", f"{k}.png") for i in range(400) for k in range(2)]
    exports.slides_sidecar(spark.createDataFrame(rows, "rec_id long, start_ms long, end_ms long, text string, image string"), path)
    files = list((tmp_path / "slides").glob("rec_id=*/part-*"))
    assert len(files) == 400 and len({f.name.split("-")[1] for f in files}) >= 4
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    back = exports.read_by_recording(spark, path)
    assert {(r.rec_id, r.value.count('"image"')) for r in back.collect()} == {(i, 2) for i in range(400)}
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
