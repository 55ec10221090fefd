"""Vantage-point trees against comparing all points."""

import numpy as np
import pytest

from vecloom import sources
from vecloom.operators import knn, metric


def listed(df):
    return sorted((r.qid, r["rank"], r.id, r.d2) for r in df.collect())


def clustered(n=1200, dim=3, seed=2):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 12, (n, 1)) * 10.0 + rng.standard_normal((n, dim))


@pytest.mark.parametrize("k", [1, 7, 40])
def test_tree_gives_exact_neighbours(spark, k):
    points = sources.points_from_numpy(spark, clustered())
    queries = sources.points_from_numpy(spark, clustered(150, seed=5)).withColumnRenamed("id", "qid")
    tree = metric.build_tree(points, leaf=50)
    assert tree.leaves.count() == 1200 and tree.leaves.groupBy("node").count().agg({"count": "max"}).first()[0] <= 50
    assert listed(metric.tree_knn(tree, queries, k)) == listed(knn.knn_query(points, queries, k))
    if k < 10:
        assert metric.leaf_visits(tree, queries, k).count() < 0.3 * 150 * tree.n_leaves()


def test_repeated_points_are_cut_by_hash(spark, monkeypatch):
    """A third of all points are one point, another third lie equally far from all others; a hot leaf's queries are dealt to shares."""
    monkeypatch.setattr(metric, "ASKED", 16)
    monkeypatch.setattr(metric, "FEW", 2)
    x = np.concatenate([np.zeros((100, 3)), np.tile(np.eye(3), (34, 1)), clustered(100)])
    points = sources.points_from_numpy(spark, x)
    tree = metric.build_tree(points, leaf=20)
    assert tree.leaves.groupBy("node").count().agg({"count": "max"}).first()[0] <= 20
    queries = points.withColumnRenamed("id", "qid")
    assert listed(metric.tree_knn(tree, queries, 5)) == listed(knn.knn_query(points, queries, 5))


def test_one_leaf_and_no_points(spark):
    points = sources.points_from_numpy(spark, clustered(30))
    queries = points.selectExpr("id + 1000000000000 AS qid", "features")
    assert listed(metric.tree_knn(metric.build_tree(points), queries, 50)) == listed(knn.knn_query(points, queries, 50))
    assert metric.tree_knn(metric.build_tree(points.limit(0)), queries, 3).count() == 0
    assert metric.tree_knn(metric.build_tree(points), queries.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        metric.build_tree(points, 0)
