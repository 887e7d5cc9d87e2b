"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not, so tokens of the training documents are labelled first: a token of a toxic
document is toxic if its word is far more frequent, over distinct contexts in documents that are no copies of each
other, in toxic documents than in clean ones, or if it begins with letters that only toxic documents have (so that inflected forms
are found that training never showed). Tokens of clean documents are clean, the same words too. Those tokens train a chain
of two states over sentences (L2-regularised likelihood, forward-backward gradients), whose features are a token's word
or beginning and those of its neighbours. Scoring runs forward-backward over every sentence of every document; the
marginals give the offending offsets, and their maximum and sum, calibrated on the training documents, the score.

The fit uses at most ``TRAIN_TOXIC`` and ``TRAIN_CLEAN`` labelled documents, taken by a hash of their ids, with all their
sentences and every word that passes the thresholds; scoring covers everything.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.words import LETTERS, MULTIPLIER, chunks, mix, stems, words
from parlance.session import materialize

TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
#: A chain is a sentence, or this many of its tokens where a sentence goes on for longer.
CHAIN = 64
#: Chains of about one length that the fit works on at a time: bounds its memory.
FIT_BLOCK = 8192
#: A word is a feature, or labels tokens as toxic, from these log odds on; both need contexts in this many toxic documents or more.
FEATURE_ODDS, TOXIC_ODDS, SUPPORT = 1.5, 2.5, 6
#: A toxic document missed costs as much as so many clean ones rejected.
MISS_COST = 2.0
#: Lengths in bytes of the beginnings of words that are features too, the more specific first.
STEMS = (5, 4)
SENTENCE_ENDS = np.zeros(256, dtype=bool)
SENTENCE_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    """Sorted hashes of the feature words, and weights: of each word (0: any other) at a token, before and after it, of
    transitions, of the calibration."""

    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    emit: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    def features(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, buffer: np.ndarray) -> np.ndarray:
        """1 + place in the lexicon of each word, or else of its beginning; 0 for other words."""
        out = np.zeros(len(hashes), dtype=np.int64)
        if len(self.lexicon):
            for keys in (hashes, *(stems(starts, ends, buffer, n) for n in STEMS)):
                at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
                out = np.where((out == 0) & (self.lexicon[at] == keys), at + 1, out)
        return out


def chains(owner: np.ndarray, starts: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of each chain."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    sentence = np.cumsum(SENTENCE_ENDS[buffer])[starts]
    new = np.r_[True, (sentence[1:] != sentence[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))
    first = np.flatnonzero(place % CHAIN == 0)
    return first, np.diff(np.r_[first, len(starts)])


def padded(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chains as rows of a matrix, and which of its cells are tokens."""
    cells = np.arange(sizes.max())
    real = cells < sizes[:, None]
    return ids[np.where(real, first[:, None] + cells, first[:, None])], real


def forward_backward(score: np.ndarray, real: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, P(state 1) of each cell and P(states i, j) summed over each chain's steps.

    ``score``: of state 1 against state 0 in each cell. ``real``: cells that exist, at the left of each row.
    """
    rows, width = score.shape
    weight = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=2)
    step = np.exp(move)
    ahead, scale = np.zeros((rows, width, 2)), np.ones((rows, width))
    ahead[:, 0] = weight[:, 0]
    for t in range(width):
        if t:
            ahead[:, t] = np.where(real[:, t, None], (ahead[:, t - 1] @ step) * weight[:, t], ahead[:, t - 1])
        scale[:, t] = ahead[:, t].sum(axis=1)
        ahead[:, t] /= scale[:, t, None]
    back = np.ones((rows, width, 2))
    pair = np.zeros((rows, 2, 2))
    for t in range(width - 2, -1, -1):
        follow = back[:, t + 1] * weight[:, t + 1]
        joint = ahead[:, t, :, None] * step * follow[:, None, :]
        pair += np.where(real[:, t + 1, None, None], joint / joint.sum(axis=(1, 2), keepdims=True), 0.0)
        now = follow @ step.T
        back[:, t] = np.where(real[:, t + 1, None], now / now.sum(axis=1, keepdims=True), back[:, t + 1])
    marginal = ahead * back
    marginal = marginal[:, :, 1] / marginal.sum(axis=2)
    return np.log(scale).sum(axis=1), np.where(real, marginal, 0.0), pair


def neighbours(ids: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The features of each cell: its word, the one before it and the one after it; 0 beyond the chain."""
    own = np.where(real, ids, 0)
    edge = np.zeros((len(ids), 1), dtype=ids.dtype)
    return np.stack([own, np.c_[edge, own[:, :-1]], np.c_[own[:, 1:], edge]])


def cell_scores(emit: np.ndarray, features: np.ndarray) -> np.ndarray:
    return emit[0][features[0]] + emit[1][features[1]] + emit[2][features[2]]


def fit_chain(sequences: list[np.ndarray], labels: list[np.ndarray], times: np.ndarray, size: int, rounds: int = 120, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``size`` words in their three places, and of transitions; each sequence, with its labels, counts ``times``."""
    order = np.argsort([len(x) for x in sequences], kind="stable")
    blocks, total = [], float(times.sum())
    told, move = np.zeros((2, 2)), np.zeros((2, 2))
    counted, emit = np.zeros((3, size)), np.zeros((3, size))
    for at in range(0, len(order), FIT_BLOCK):
        own = order[at : at + FIT_BLOCK]
        lengths = np.array([len(sequences[i]) for i in own])
        first = np.cumsum(lengths) - lengths
        ids, real = padded(np.concatenate([sequences[i] for i in own]), first, lengths)
        truth = padded(np.concatenate([labels[i] for i in own]), first, lengths)[0].astype(bool) & real
        weight, features = times[own].astype(float), neighbours(ids, real)
        told += [[(weight[:, None] * (real[:, 1:] & (truth[:, :-1] == i) & (truth[:, 1:] == j))).sum() for j in (0, 1)] for i in (0, 1)]
        for k in range(3):
            counted[k] += np.bincount(features[k].ravel(), weights=(weight[:, None] * truth).ravel(), minlength=size)
        blocks.append((features, real, weight))
    slow = [np.zeros_like(emit), np.zeros_like(move)]
    fast = [np.zeros_like(emit), np.zeros_like(move)]
    for step in range(1, rounds + 1):
        expected, pairs = np.zeros_like(emit), np.zeros_like(move)
        for features, real, weight in blocks:
            _, marginal, pair = forward_backward(cell_scores(emit, features), real, move)
            pairs += (weight[:, None, None] * pair).sum(axis=0)
            for k in range(3):
                expected[k] += np.bincount(features[k].ravel(), weights=(weight[:, None] * marginal).ravel(), minlength=size)
        gradient = [(counted - expected) / total - l2 * emit / size, (told - pairs) / total - l2 * move]
        for value, g, s, f in zip((emit, move), gradient, slow, fast):  # Adam
            s += 0.1 * (g - s)
            f += 0.001 * (g * g - f)
            value += 0.25 * (s / (1 - 0.9**step)) / (np.sqrt(f / (1 - 0.999**step)) + 1e-8)
        move[0, 0] = 0.0
        emit[1:, 0] = 0.0  # neighbours that are no features say nothing
    return emit, move


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, cost: float = 1.0) -> np.ndarray:
    """Newton steps for P(y) = 1 / (1 + exp(-(b + w x))); bias first. Rows with y = 1 count ``cost`` times."""
    weight = np.where(y > 0, cost, 1.0)
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(hessian, x.T @ (weight * (y - p)) - l2 * w), -3, 3)
    return w


class Scorer:
    """Marginals of whole texts; chains without feature words are worked out once for each length."""

    def __init__(self, model: Model):
        self.model = model
        sizes = np.arange(1, CHAIN + 1)
        ids, real = padded(np.zeros(1, dtype=np.int64), np.zeros(CHAIN, dtype=np.int64), np.ones(CHAIN, dtype=np.int64))
        real = np.arange(CHAIN) < sizes[:, None]
        _, marginal, _ = forward_backward(np.full(real.shape, model.emit[0, 0]), real, model.move)
        self.plain_sum, self.plain_max = marginal.sum(axis=1), marginal.max(axis=1)

    def texts(self, texts: list[str | None]) -> Iterator[tuple[float, float, list[tuple[int, int, float]]]]:
        """Largest marginal, sum of marginals, and (start, end, marginal) in code points of tokens tagged toxic."""
        for _, raw in chunks(texts):
            hashes, owner, starts, ends, buffer = words(raw, LETTERS)
            top, total = np.zeros(len(raw)), np.zeros(len(raw))
            tagged: list[list[tuple[int, int, float]]] = [[] for _ in raw]
            if len(hashes):
                ids = self.model.features(hashes, starts, ends, buffer)
                first, sizes = chains(owner, starts, buffer)
                loaded = np.add.reduceat(ids, first) > 0
                plain = ~loaded
                np.add.at(total, owner[first[plain]], self.plain_sum[sizes[plain] - 1])
                np.maximum.at(top, owner[first[plain]], self.plain_max[sizes[plain] - 1])
                if loaded.any():
                    first, sizes = first[loaded], sizes[loaded]
                    cells, real = padded(ids, first, sizes)
                    _, marginal, _ = forward_backward(cell_scores(self.model.emit, neighbours(cells, real)), real, self.model.move)
                    np.add.at(total, owner[first], marginal.sum(axis=1))
                    np.maximum.at(top, owner[first], marginal.max(axis=1))
                    points = np.cumsum((buffer & 0xC0) != 0x80)
                    limits = np.cumsum([0, *(len(r) + 1 for r in raw)])
                    for row, at in zip(*np.nonzero(marginal >= 0.5)):
                        token = first[row] + at
                        text = owner[token]
                        zero = points[limits[text] - 1] if text else 0
                        tagged[text].append((int(points[starts[token]] - 1 - zero), int(points[ends[token] - 1] - zero), float(marginal[row, at])))
            yield from zip(top.tolist(), total.tolist(), tagged)

    def document(self, top: float, total: float) -> float:
        b, w1, w2 = self.model.calibration
        return float(1 / (1 + np.exp(-np.clip(b + w1 * document_features(top, total)[0] + w2 * document_features(top, total)[1], -30, 30))))


def document_features(top: float, total: float) -> tuple[float, float]:
    top = min(max(top, 1e-6), 1 - 1e-6)
    return float(np.log(top / (1 - top))), float(np.log(total + 1e-3))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; a row without an id has no label and is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """A model from the labels of rows that are not held out. Without toxic or clean labels every score is low."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    chosen = usable.where("toxic = 1").orderBy(*by_hash).limit(TRAIN_TOXIC).union(usable.where("toxic = 0").orderBy(*by_hash).limit(TRAIN_CLEAN))
    chosen = materialize(chosen, "train-ids")
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most TRAIN_TOXIC + TRAIN_CLEAN rows

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=np.int64)
            for at, raw in chunks(texts):
                hashes, owner, starts, ends, buffer = words(raw, LETTERS)
                if not len(hashes):
                    continue
                left, right = np.r_[np.uint64(0), hashes[:-1]], np.r_[hashes[1:], np.uint64(0)]
                around = mix(left * MULTIPLIER + right)
                shingle = mix(mix(left + hashes * MULTIPLIER) + right * MULTIPLIER)
                bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sketch = np.repeat(np.minimum.reduceat(shingle, bounds), np.diff(np.r_[bounds, len(owner)]))
                for n in (0, *STEMS):
                    keys = stems(starts, ends, buffer, n) if n else hashes
                    own = np.flatnonzero(keys)
                    columns = [pa.array(c[own].view(np.int64)) for c in (sketch, keys, around)]
                    yield pa.RecordBatch.from_arrays([pa.array(toxic[at + owner[own]]), *columns, pa.array(np.full(len(own), n), pa.int32())], names=["toxic", "sketch", "word", "around", "stem"])

    seen = sample.select("doc_id", "text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(contexts, "toxic long, sketch long, word long, around long, stem int")
    # a context counts once in all documents, and once in documents that are copies of each other
    seen = seen.groupBy("toxic", "word", "stem", "around").agg(F.min("sketch").alias("sketch")).groupBy("toxic", "word", "stem").agg(
        F.count("*").alias("contexts"), F.approx_count_distinct("sketch").alias("documents")
    )
    seen = materialize(seen, "contexts")
    totals = {r["toxic"]: float(r["n"]) for r in seen.where("stem = 0").groupBy("toxic").agg(F.sum("contexts").alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    # so many documents that chance alone would hardly put any word into toxic ones only
    chance = totals[1] / (totals[0] + totals[1])
    support = max(SUPPORT, int(np.ceil(np.log(0.02 / seen.count()) / np.log(chance))))
    odds = F.log((F.coalesce("t", F.lit(0)) + 0.5) / totals[1]) - F.log((F.coalesce("c", F.lit(0)) + 0.5) / totals[0])
    pair = seen.where("toxic = 1").select("word", "stem", F.least("contexts", "documents").alias("t")).join(seen.where("toxic = 0").select("word", F.col("contexts").alias("c")), "word", "left")
    pair = pair.where(F.col("t") >= support).where("stem = 0 or c is null").select("word", odds.alias("odds")).where(F.col("odds") >= FEATURE_ODDS)
    found = pair.collect()  # words of a bounded sample, each in ``support`` documents or more
    if not found:
        return Model()
    table = sorted((int(r["word"]) % 2**64, r["odds"]) for r in found)
    model = Model(lexicon=np.array([h for h, _ in table], dtype=np.uint64))
    toxic = np.array([False, *(o >= TOXIC_ODDS for _, o in table)])

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, plain = [], Counter()
            marks = batch.column(2).to_numpy()
            for at, raw in chunks(batch.column(1).to_pylist()):
                hashes, owner, starts, ends, buffer = words(raw, LETTERS)
                ids = model.features(hashes, starts, ends, buffer)
                truth = (toxic[ids] & (marks[at + owner] == 1)).astype(np.int64)
                for first, n in zip(*chains(owner, starts, buffer)):
                    part = ids[first : first + n]
                    if part.any():
                        rows.append((part.tolist(), truth[first : first + n].tolist(), 1))
                    else:
                        plain[int(n)] += 1
            rows += [([0] * n, [0] * n, k) for n, k in plain.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))], names=["ids", "truth", "n"])

    labelled = sample.select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"))
    marked = labelled.mapInArrow(sentences, "ids array<long>, truth array<long>, n long").groupBy("ids", "truth").agg(F.sum("n").alias("n"))
    picked = marked.toPandas().sort_values(["n", "ids"], key=lambda c: c.map(tuple) if c.name == "ids" else c, ignore_index=True)
    model.emit, model.move = fit_chain(picked["ids"].tolist(), picked["truth"].tolist(), picked["n"].to_numpy(), len(toxic))

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [document_features(top, total) for top, total, _ in scorer.texts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(c, pa.float64()) for c in zip(*x))], names=["toxic", "x1", "x2"])

    known = labelled.mapInArrow(measures, "toxic long, x1 double, x2 double").toPandas()
    model.calibration = fit_logistic(known[["x1", "x2"]].to_numpy(), known["toxic"].to_numpy(dtype=float), cost=MISS_COST)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with score, predicted and toxic_spans (start:end of tagged tokens in code points).

    Null, empty and wordless texts get the score of a text without toxic tokens. Whole texts are scored. Repeated rows
    get equal scores; an empty table gives no rows. Only ``text`` is an input of the score, all columns pass through, and
    ones named like a result column give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = ["score", "predicted", "toxic_spans"]
    source = docs.drop(*results)
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores, spans = [], []
            for top, total, tagged in scorer.texts(batch.column(at).to_pylist()):
                scores.append(scorer.document(top, total))
                spans.append(",".join(f"{a}:{b}" for a, b, _ in sorted(tagged)))
            found = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *results])

    kinds = (T.DoubleType(), T.IntegerType(), T.StringType())
    schema = T.StructType([*source.schema.fields, *map(T.StructField, results, kinds)])
    return source.mapInArrow(run, schema)
