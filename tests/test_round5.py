"""What the reviewer of the fourth round found."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import sources
from vecloom.functions import block_d2, near_tiles
from vecloom.operators import dendrogram, graph, knn, metric, mst, prune, quality
from vecloom.plans import clustering

KIND = "algo string, time double, run int, params string, dendrogram array<struct<left_id: long, right_id: long, height: double, size: long>>"


def trees(spark, n=90, seed=0):
    """Points, their exact tree and the path through their ids."""
    pts = sources.points_from_numpy(spark, np.random.default_rng(seed).random((n, 3)))
    path = graph.with_distance(pts, spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "u", "v")
    return pts, mst.exact_tree(pts), path


def no_pairs(*a, **k):
    raise AssertionError("all pairs were made")


@pytest.mark.parametrize("block", [None, 7])
def test_correlation_of_trees_without_their_pairs(spark, monkeypatch, block):
    """Equal to that of the tables of all pairs; also of forests, where only pairs that both join count."""
    _, tree, path = trees(spark)
    for t, p in ((tree, path), (tree.where("v % 9 <> 0"), path.where("u <> 40"))):
        want = quality.pearson(quality.joined_heights(dendrogram.cophenetic(t), dendrogram.cophenetic(p))).first().quality
        with monkeypatch.context() as m:
            m.setattr(dendrogram, "cophenetic", no_pairs)
            assert abs(quality.tree_pearson(t, p, block).first().quality - want) < 1e-9


@pytest.mark.parametrize("block", [None, 7])
def test_results_against_all_heights_without_their_pairs(spark, block):
    """As against the table of all pairs, also for heights that fall and rise, of very different size, squared or broken."""
    pts, tree, path = trees(spark)
    merges = {k: [tuple(r)[1:] for r in clustering.merged(pts, t).orderBy("merge_no").collect()] for k, t in (("exact", tree), ("path", path))}
    odd = [(a, b, h * 1e6 * (1 + k % 3), s) for k, (a, b, h, s) in enumerate(merges["path"])]
    data = [("exact", merges["exact"]), ("path", merges["path"]), ("odd", odd), ("square", [(a, b, h * h, s) for a, b, h, s in merges["exact"]]), ("broken", merges["exact"][:-2]), ("none", None)]
    made = spark.createDataFrame([(k, 1.0, 1, "{}", m) for k, m in data], KIND)
    squared = F.col("algo") == "square"
    of = lambda df: {(r.algo, r.measure): r.quality for r in df.collect()}
    want, got = of(quality.evaluate(made, dendrogram.cophenetic(tree), squared, block=500)), of(quality.evaluate_all(made, tree, squared, block=block))
    assert want.keys() == got.keys() and len(got) == 18
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or abs(got[k] - v) <= 1e-9 * max(1, abs(v))), k


def test_results_are_never_broadcast_with_pairs(spark):
    """The join of results and packed pairs was, and ended in an error of the driver."""
    _, tree, _ = trees(spark, 12)
    made = spark.createDataFrame([("none", 1.0, 1, "{}", None)], KIND)
    plan = quality.evaluate(made, dendrogram.cophenetic(tree), block=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def odd_points():
    rng = np.random.default_rng(4)
    far = rng.standard_normal((300, 4)) * 1e-3 + 1e6
    return {"normal": rng.standard_normal((300, 4)), "copies": np.repeat(rng.standard_normal((20, 4)), 15, 0), "far": far, "grid": rng.integers(0, 4, (300, 3)) * 1.0}


@pytest.mark.parametrize("name", sorted(odd_points()))
@pytest.mark.parametrize("k", [1, 7, 400])
def test_neighbours_by_products_are_exact(name, k):
    """The same as from exact distances of all pairs, ties by id too; no approximate distance is off by more than it says."""
    x, ids = odd_points()[name], np.arange(300)[::-1].copy()
    y, other = x[100:], ids[100:]
    d = block_d2(x, y)
    assert all((np.abs(near - d[at : at + len(near)]) <= slack).all() for at, near, slack in near_tiles(x, y))
    for others in (False, True):
        full = np.where(ids[:, None] == other[None, :], np.inf, d) if others else d
        r, c = knn._best(full, other, k)
        for got, want in zip(knn._closest(ids, x, other, y, k, others), (ids[r], other[c], full[r, c])):
            assert np.array_equal(got, want)


@pytest.mark.parametrize("name", sorted(odd_points()))
def test_trees_by_rounds_equal_those_of_all_blocks(spark, name):
    """Edge for edge, also with ties and with core distances."""
    pts = sources.points_from_numpy(spark, odd_points()[name])
    core = knn.knn_graph(pts, 5).where("rank = 5").select(F.col("src").alias("id"), F.col("d2").alias("core"))
    for c in (None, core) if name != "grid" else (None,):
        assert sorted(map(tuple, mst.exact_tree(pts, core=c, few=0).collect())) == sorted(map(tuple, mst.exact_tree(pts, core=c).collect()))


def test_blocks_grow_with_the_table(spark):
    """What cells shuffle is the table times its blocks: 24 of them, not one for each 1,024 points."""
    pts = spark.range(60_000).select("id", F.array(F.lit(0.0)).alias("features"))
    rows = knn._cells(pts, None, lambda a, x, b, y, same: {"n": [len(a)]}, "n long", whole=True)
    assert rows.count() <= 25 * 26 / 2


@pytest.mark.parametrize("name", sorted(odd_points()))
@pytest.mark.parametrize("rule", prune.RULES)
def test_all_points_are_pruned_without_all_pairs(spark, monkeypatch, name, rule):
    """As the fold over a table of all pairs, in rounds of few candidates; copies keep distances of 0."""
    x = odd_points()[name][:60]
    pts = sources.points_from_numpy(spark, x)
    want = sorted(map(tuple, prune.prune(pts, graph.directed(knn.all_pairs(pts)), rule).select("src", "dst", "d2").collect()))
    monkeypatch.setattr(knn, "all_pairs", no_pairs)
    monkeypatch.setattr(prune, "CELL", 40)
    assert sorted(map(tuple, prune.prune_all(pts, rule, most=9).collect())) == want


def test_large_buckets_are_cut_into_few_shares(spark, monkeypatch):
    """Shares had ``block`` points, so that a bucket's points were copied once for each 16 of them; results don't depend on shares."""
    pts = sources.points_from_numpy(spark, odd_points()["normal"])
    made = lambda block: knn.knn_graph_bucketed(pts, 4, passes=3, bits=2, block=block)
    assert f"/ {float(knn.CELL)}" in made(16)._jdf.queryExecution().optimizedPlan().toString()
    whole = sorted(map(tuple, made(16).collect()))
    monkeypatch.setattr(knn, "CELL", 16)
    assert sorted(map(tuple, made(16).collect())) == whole


@pytest.mark.parametrize("name", sorted(odd_points()))
def test_trees_are_searched_by_subtrees(spark, monkeypatch, name):
    """A query meets subtrees, not each of their leaves: rows for queries and leaves grew with the square of the table."""
    x = odd_points()[name]
    pts = sources.points_from_numpy(spark, x)
    monkeypatch.setattr(metric, "CELL", 80)
    tree, queries = metric.build_tree(pts, leaf=4), pts.withColumnRenamed("id", "qid")
    made, seen = metric._visits, []
    monkeypatch.setattr(metric, "_visits", lambda *a: seen.append(made(*a)) or seen[-1])
    got = sorted(map(tuple, metric.tree_knn(tree, queries, 5).select("qid", "id", "d2", "rank").collect()))
    assert got == sorted(map(tuple, knn.knn_query(pts, queries, 5).select("qid", "id", "d2", "rank").collect()))
    assert seen[0].count() <= 4 * len(x) and tree.n_leaves() >= 64


@pytest.mark.parametrize("name", sorted(odd_points()))
def test_any_spanning_tree_is_completed_to_the_exact_one(spark, name):
    """Edge for edge, from the path through all ids, in blocks."""
    pts = sources.points_from_numpy(spark, odd_points()[name][:120])
    path = graph.with_distance(pts, spark.range(119).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "u", "v")
    assert sorted(map(tuple, mst.completed_tree(pts, path, block=50).collect())) == sorted(map(tuple, mst.exact_tree(pts).collect()))


def test_expansion_measures_few_pairs(spark):
    """Neighbours are those of the pool given: with a growing pool nearly all pairs were measured after two rounds."""
    pts = sources.points_from_numpy(spark, np.random.default_rng(8).standard_normal((400, 16)))
    pool = graph.undirected(knn.knn_graph(pts, 3))
    assert mst.expanded_pool(pts, pool, symmetric=True).count() < 400 * 399 / 2 / 4
