"""Approximate nearest neighbours by cosine: inverted lists with adaptive dimension scans.

A random rotation spreads a vector's energy evenly over its dimensions, so the distance over the first columns, scaled
up, estimates the whole distance. Lists hold rotated unit vectors in column blocks. For each query the scan of a list
adds one block of columns at a time and, by a hypothesis test on the partial distance, abandons candidates that are not
likely to be among the nearest. Survivors are scored exactly, in double precision, on the original vectors.

Rotation and list centres are fitted on at most ``FIT_ROWS`` vectors taken by a hash of their ids. Every vector is in the
index. Long lists are cut into blocks by a hash, so a list that a third of all vectors fall in is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import materialize

FIT_ROWS, LISTS_MOST, COLUMNS = 20_000, 1024, 16
#: Vectors and queries of one list that meet in one task at most, about.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Width of the test: larger abandons later and errs less.
WIDTH = 2.1


def fit(vectors: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and the unit centres of the lists (spherical k-means), from a sample of vectors."""
    rng = np.random.default_rng(seed)
    dim = vectors.shape[1] if len(vectors) else 1
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    rotation = q * np.sign(np.diag(r))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors.reshape(0, 1)
    unit = unit @ rotation
    k = int(min(LISTS_MOST, max(1, round(len(unit) ** 0.5 / 2))))
    centres = unit[rng.permutation(len(unit))[:k]].copy() if len(unit) else np.ones((1, dim))
    for _ in range(12):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return rotation, centres


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal vectors give equal values wherever they lie."""
    dot = np.multiply(a, b).sum(axis=1)
    return dot / (np.sqrt(np.multiply(a, a).sum(axis=1)) * np.sqrt(np.multiply(b, b).sum(axis=1)))


def scan(query: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of likely nearest rows to a rotated unit query, by squared distance over column blocks with early exits."""
    n, dim = rows.shape
    alive = np.arange(n)
    partial = np.zeros(n)
    first = min(n, max(4 * k, 64))
    # the whole distance of the likeliest rows by their first columns gives the bound to test against
    for at in range(0, dim, COLUMNS):
        block = rows[alive, at : at + COLUMNS] - query[at : at + COLUMNS]
        partial = partial + np.einsum("ij,ij->i", block, block)
        seen = min(at + COLUMNS, dim)
        if at == 0:
            best = np.argpartition(partial, first - 1)[:first] if n > first else np.arange(n)
            whole = ((rows[best] - query) ** 2).sum(axis=1)
            bound = np.partition(whole, min(k, len(whole)) - 1)[min(k, len(whole)) - 1] + 1e-9
        if seen < dim:
            keep = partial * (dim / seen) <= bound * (1 + WIDTH / np.sqrt(seen)) ** 2
        else:
            keep = partial <= bound
        alive, partial = alive[keep], partial[keep]
    return alive


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: float = 0.75, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest by cosine among all other vectors.

    ``queries`` holds rows of the same columns. A query's own id is never a candidate. Ties go to the smaller id. Vectors
    that are null, empty, zero, of another dimension than most of the fitted ones, or hold nulls or values that are not
    finite take no part, as queries or as candidates; nor do rows without an id. Repeated rows count once, and of rows of
    one id with several vectors the one with the least vector, component by component. Fewer
    candidates than k give fewer rows; an empty table gives none. ``probes``: share of the lists that a query visits.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        rows = rows.where(F.coalesce(finite, F.lit(False)))
        # squares of very large or small components leave the range of doubles: a power of two in each brings them back, and
        # leaves the cosine as it is
        most = F.array_max(F.transform("v", F.abs))
        half = F.pow(F.lit(2.0), -F.floor(F.log2(most) / 2))
        return rows.withColumn("v", F.when(most.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x * half * half)))

    rows = usable(vectors)
    # a bounded sample: the smallest hashes of ids
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample["v"].map(len).mode()[0])
    rotation, centres = fit(np.stack(sample.loc[sample["v"].map(len) == dim, "v"]))
    model = spark.sparkContext.broadcast((rotation, centres))
    visited = int(min(len(centres), max(8, np.ceil(probes * len(centres)))))

    def assign(many: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rotation, centres = model.value
            for batch in batches:
                v = np.asarray(batch.column(1).flatten()).reshape(-1, dim)
                unit = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ rotation
                near = unit @ centres.T
                lists = np.argpartition(-near, visited - 1, axis=1)[:, :visited] if many and visited < len(centres) else np.tile(np.arange(len(centres)), (len(v), 1)) if many else near.argmax(axis=1)[:, None]
                each = lists.shape[1]
                at = pa.array(np.repeat(np.arange(len(v)), each))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lists.ravel().astype(np.int32))], names=["id", "v", "list"])

        return run

    same = rows.where(F.size("v") == dim)
    index = materialize(same.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(assign(False), "id long, v array<double>, list int"), "lists")
    asked = materialize(usable(queries).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(assign(True), "id long, v array<double>, list int"), "probes")
    sizes = index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    wanted = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("shares"))
    grid = F.broadcast(sizes.join(wanted, "list"))  # at most LISTS_MOST rows
    both = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = index.join(grid, "list").select("list", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), both("shares").alias("share"), "id", "v")
    asks = asked.join(grid, "list").select("list", both("blocks").alias("block"), F.pmod(F.xxhash64("id"), "shares").cast("int").alias("share"), "id", "v")

    def search(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cell) and len(queries):
            rotation, _ = model.value
            cell = cell.sort_values("id", ignore_index=True)
            raw, ids = np.stack(cell["v"]), cell["id"].to_numpy()
            rotated = np.asfortranarray((raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))) @ rotation)
            asked = np.stack(queries["v"])
            turned = (asked / np.sqrt((asked * asked).sum(axis=1, keepdims=True))) @ rotation
            for q, own, near in zip(queries["id"].to_numpy(), asked, turned):
                at = scan(near, rotated, k + 1)
                at = at[ids[at] != q]
                score = exact_cosine(np.broadcast_to(own, raw[at].shape), raw[at])
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ("list", "block", "share")
    hits = cells.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    # a task has given its k best for each query, so a query has at most k rows for each list block it visits
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
