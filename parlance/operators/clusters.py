"""Clusters of the vectors of a recording from one dendrogram, with bounds on their number.

The dendrogram is built by nearest-neighbour chains: from any cluster, go on to its nearest one until two are each other's
nearest, and join them. For the linkages here such pairs never come closer by other joins, so the order of joins does not
matter, and sorted by distance they are those that always joining the nearest pair would make. Any threshold and any number
of clusters is then a cut through the same joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parlance.operators.similarity import MOST_IN_GROUP

#: How many more clusters than estimated a threshold may leave.
HEADROOM = 4


def distances(vectors: np.ndarray, linkage: str) -> np.ndarray:
    """1 - cosine of all pairs; for ward the squared Euclidean distance of unit vectors. Zero vectors are far from all."""
    unit = vectors / np.clip(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12, None)
    d = np.clip(1 - unit @ unit.T, 0, 2)
    d = 2 * d if linkage == "ward" else d
    np.fill_diagonal(d, np.inf)
    return d


def dendrogram(vectors: np.ndarray, linkage: str = "ward") -> list[tuple[float, int, int]]:
    """(distance, a, b) of the n - 1 joins in order of distance, where a and b are any members of the two clusters."""
    n = len(vectors)
    d, size, alive = distances(vectors, linkage), np.ones(n), np.ones(n, dtype=bool)
    joins, chain = [], []
    while len(joins) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:  # of equals the one before, so that the chain ends
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        joins.append((float(np.sqrt(d[a, b]) if linkage == "ward" else d[a, b]), a, b))
        if linkage == "complete":
            new = np.maximum(d[a], d[b])
        elif linkage == "single":
            new = np.minimum(d[a], d[b])
        elif linkage == "average":
            new = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        elif linkage == "ward":
            with np.errstate(invalid="ignore"):
                new = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / (size[a] + size[b] + size)
        else:
            raise ValueError(f"unknown linkage {linkage}")
        new[~alive] = np.inf
        d[a], d[:, a] = new, new
        d[a, a] = d[b] = d[:, b] = np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(joins, key=lambda j: j[0])


def cut(joins: list[tuple[float, int, int]], count: int) -> np.ndarray:
    """Labels after the first n - ``count`` joins, numbered by first members."""
    n = len(joins) + 1
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, a, b in joins[: n - count]:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    numbers: dict[int, int] = {}
    return np.array([numbers.setdefault(top(i), len(numbers)) for i in range(n)], dtype=int)


@dataclass(frozen=True)
class Bounds:
    """What is known of the number of clusters: exactly, estimated, at least, at most."""

    exact: int | None = None
    expected: int | None = None
    least: int | None = None
    most: int | None = None


def bounded(vectors: np.ndarray, threshold: float, bounds: Bounds = Bounds(), linkage: str = "ward") -> np.ndarray:
    """Labels of clusters: exactly as many as known, or those that the threshold leaves, brought within the bounds.

    A number given for sure decides. Otherwise joins nearer than the threshold are made; if more clusters than ``most``
    remain, or fewer than ``least``, that many are cut; an estimate only keeps them from passing it by more than
    ``HEADROOM``. Cuts by number are always through the ward dendrogram.
    """
    n = len(vectors)
    if n <= 1:
        return np.zeros(n, dtype=int)
    within = lambda k: max(1, min(int(k), n))
    if bounds.exact is not None:
        return cut(dendrogram(vectors, "ward"), within(bounds.exact))
    joins = dendrogram(vectors, linkage)
    left = n - sum(distance < threshold for distance, _, _ in joins)
    target = left
    if bounds.most is not None and left > bounds.most:
        target = within(bounds.most)
    elif bounds.least is not None and left < bounds.least:
        target = within(bounds.least)
    elif bounds.expected is not None:
        target = min(left, within(bounds.expected + HEADROOM))
    if target != left and linkage != "ward":
        joins = dendrogram(vectors, "ward")
    return cut(joins, target)


def bounded_clusters(vectors: DataFrame, threshold: float, linkage: str = "ward") -> DataFrame:
    """group, id, cluster of ``vectors(group, id, vector, exact, expected, least, most)``; the last four are one per group or null.

    Each group is clustered in its own task by a full matrix, so groups beyond ``MOST_IN_GROUP`` vectors are refused. Null
    vectors take no part. Clusters are numbered by their first ids.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MOST_IN_GROUP:
            raise ValueError(f"{len(rows)} vectors in one group; at most {MOST_IN_GROUP}")
        rows = rows.sort_values("id", ignore_index=True)
        known = (rows[c].iloc[0] for c in ("exact", "expected", "least", "most"))
        bounds = Bounds(*(None if pd.isna(x) else int(x) for x in known))
        return rows[["group", "id"]].assign(cluster=bounded(np.stack(rows["vector"]).astype(float), threshold, bounds, linkage))

    kinds = dict(vectors.dtypes)
    return vectors.where("vector is not null").groupBy("group").applyInPandas(fold, f"group {kinds['group']}, id {kinds['id']}, cluster int")
