"""Bounded clusters: a dendrogram against joins of the nearest pair, and every kind of bound."""

import numpy as np
import pytest

from parlance.operators.clusters import Bounds, bounded, bounded_clusters, cut, dendrogram
from parlance.operators.similarity import agglomerate


@pytest.mark.parametrize("linkage", ["ward", "complete", "average", "single"])
def test_cuts_equal_joining_the_nearest_pair(linkage):
    draw = np.random.default_rng(5)
    for n in (2, 3, 9, 40):
        vectors = draw.normal(size=(n, 6))
        joins = dendrogram(vectors, linkage)
        assert [d for d, _, _ in joins] == sorted(d for d, _, _ in joins) and len(joins) == n - 1
        for k in {1, 2, n // 2 + 1, n}:
            assert cut(joins, k).tolist() == agglomerate(vectors, 0, clusters=k, linkage=linkage).tolist()
        for threshold in (0.2, 0.6, 1.0, 1.4):
            assert bounded(vectors, threshold, linkage=linkage).tolist() == agglomerate(vectors, threshold, linkage=linkage).tolist()


def count(labels):
    return len(set(labels.tolist()))


def test_bounds():
    apart = np.eye(10)
    assert count(bounded(apart, 1.3)) == 10
    assert count(bounded(apart, 1.3, Bounds(exact=1))) == 1 and count(bounded(apart, 1.3, Bounds(exact=99))) == 10 and count(bounded(apart, 1.3, Bounds(exact=0))) == 1
    assert count(bounded(apart[:2], 1.3, Bounds(expected=1))) == 2  # an estimate does not force
    assert count(bounded(apart, 1.3, Bounds(expected=1))) == 5 and count(bounded(apart, 1.3, Bounds(expected=7))) == 10
    assert count(bounded(apart, 1.3, Bounds(most=3))) == 3 and count(bounded(apart, 1.3, Bounds(most=3, expected=1))) == 3
    near = np.eye(4)[[0, 0, 1, 1, 2, 3]] + np.arange(24).reshape(6, 4) * 1e-3
    assert count(bounded(near, 1.3)) == 4
    assert count(bounded(near, 1.3, Bounds(least=5))) == 5 and count(bounded(near, 1.3, Bounds(least=99))) == 6 and count(bounded(near, 1.3, Bounds(least=2))) == 4
    assert count(bounded(near, 0.5, Bounds(most=2), linkage="complete")) == 2
    # by number, ward decides whatever the linkage of the threshold
    draw = np.random.default_rng(2).normal(size=(30, 4))
    assert bounded(draw, 0.1, Bounds(most=4), linkage="single").tolist() == agglomerate(draw, 0, clusters=4, linkage="ward").tolist()
    assert bounded(apart[:1], 1.3, Bounds(exact=5)).tolist() == [0]
    assert bounded(np.zeros((3, 4)), 1.3).tolist() == bounded(np.zeros((3, 4)), 1.3).tolist()
    with pytest.raises(ValueError):
        dendrogram(apart, "other")


def test_groups_with_their_own_bounds(spark):
    rows = [(g, i, [float(x) for x in np.eye(8)[i]], *b) for g, b in enumerate([(3, None, None, None), (None, 2, None, None), (None, None, None, 1), (None, None, None, None)]) for i in range(8)]
    rows.append((9, 1, None, None, None, None, None))
    v = spark.createDataFrame(rows, "group int, id int, vector array<double>, exact int, expected int, least int, most int")
    found = {r["group"]: r.n for r in bounded_clusters(v, 1.3).groupBy("group").agg({"cluster": "max"}).withColumnRenamed("max(cluster)", "n").collect()}
    assert found == {0: 2, 1: 5, 2: 0, 3: 7}
    assert bounded_clusters(v.limit(0), 1.3).collect() == []
