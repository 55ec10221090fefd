"""The clustering engine on small fixtures with known results."""

import struct

import numpy as np
import pytest

from vecloom import sources
from vecloom.functions import block_d2
from vecloom.operators import dendrogram, descent, graph, knn, mst, quality, relational
from vecloom.operators.prune import prune
from vecloom.plans import clustering, index
from vecloom.streaming import StreamingTree


def line(spark, *xs):
    return spark.createDataFrame([(k, [float(x)]) for k, x in enumerate(xs)], "id long, features array<double>")


def rows(df):
    return [tuple(r) for r in df.orderBy(df.columns[0]).collect()]


def test_chain(spark):
    assert rows(clustering.exact_dendrogram(line(spark, 0, 1, 3, 7))) == [(0, 0, 1, 1.0, 2), (1, 2, 4, 2.0, 3), (2, 3, 5, 4.0, 4)]


def test_ties_and_duplicates(spark):
    assert [r[3] for r in rows(clustering.exact_dendrogram(line(spark, 0, 1, 10, 11)))] == [1, 1, 9]
    assert [r[3] for r in rows(clustering.exact_dendrogram(line(spark, 2, 2, 2, 7)))] == [0, 0, 5]


def test_no_and_one_point(spark):
    assert rows(clustering.exact_dendrogram(line(spark))) == []
    assert rows(clustering.exact_dendrogram(line(spark, 1))) == []


def test_core_distances_and_mutual_reachability(spark):
    pool = knn.all_pairs(line(spark, 0, 1, 3, 7))
    assert [r[1] ** 0.5 for r in rows(mst.core_distances(pool, 2))] == [3, 2, 3, 6]
    tree = mst.forest(mst.mutual_reachability(pool, 2))
    assert [r[3] for r in rows(dendrogram.from_tree(tree, 4))] == [3, 3, 6]
    with pytest.raises(ValueError):
        mst.core_distances(pool, 0)


def test_disconnected_and_bridged(spark):
    pts = line(spark, 0, 1, 2, 20, 21, 22)
    pool = graph.undirected(knn.knn_graph(pts, 2))
    assert mst.forest(pool).count() == 4
    assert not graph.is_connected(pts, pool)
    assert mst.bridged_forest(pts, pool).count() == 5


def test_beyond_one_task(spark):
    """The rounds that take over where one task's limit ends give the same results."""
    rng = np.random.default_rng(0)
    pts = sources.points_from_numpy(spark, rng.random((60, 3)))
    pool = graph.undirected(knn.knn_graph(pts, 4))
    assert sorted(map(tuple, mst.forest(pool, limit=0).collect())) == sorted(map(tuple, mst.forest(pool).collect()))
    few = graph.undirected(knn.knn_graph(pts, 1))
    assert rows(graph.components(pts, few, limit=0)) == rows(graph.components(pts, few))
    tree = mst.forest(graph.undirected(knn.knn_graph(line(spark, 0, 1, 3, 7, 8), 2)))
    assert sorted(map(tuple, dendrogram.cophenetic(tree, block=2).collect())) == sorted(map(tuple, dendrogram.cophenetic(tree).collect()))


def test_blocks_agree(spark):
    pts = sources.points_from_numpy(spark, np.random.default_rng(1).random((50, 4)))
    assert sorted(map(tuple, knn.knn_graph(pts, 3, block=7).collect())) == sorted(map(tuple, knn.knn_graph(pts, 3).collect()))
    assert sorted(map(tuple, mst.exact_tree(pts, block=9).collect())) == sorted(map(tuple, mst.exact_tree(pts).collect()))


def test_flat_cut(spark):
    d = clustering.exact_dendrogram(line(spark, 0, 1, 2, 50, 51, 52, 200))
    assert [r[1] for r in rows(dendrogram.flat_cut(d, 7, 2, 2))] == [0, 0, 0, 1, 1, 1, -1]
    assert {r[1] for r in rows(dendrogram.flat_cut(d, 7, 3, 10))} == {-1}


def test_round_up_and_sort(spark):
    d = spark.createDataFrame([(0, 0, 1, 2.0, 2), (1, 2, 3, 1.0, 2), (2, 4, 5, 1.5, 4)], dendrogram.SCHEMA)
    assert [r[3] for r in rows(dendrogram.round_up(d, 4))] == [2.0, 1.0, 2.0]
    assert rows(dendrogram.sort_by_height(d, 4)) == [(0, 2, 3, 1.0, 2), (1, 0, 1, 2.0, 2), (2, 4, 5, 2.0, 4)]


def test_prune_rules_and_caps(spark):
    pts = line(spark, 0, 1, 2, 4)
    edges = knn.knn_graph(pts, 3)
    kept = {(r.src, r.dst) for r in prune(pts, edges, "occlusion").collect()}
    assert (0, 1) in kept and (0, 3) not in kept
    full = prune(pts, edges, "occlusion", most=2, refill=True)
    assert full.groupBy("src").count().agg({"count": "max"}).first()[0] == 2
    with pytest.raises(ValueError):
        prune(pts, edges, "none")


def test_index_invariants_and_recall(spark):
    pts = sources.points_from_numpy(spark, np.random.default_rng(2).random((150, 5)))
    made = index.build_layered(pts, index.LayeredParams(higher_max_degree=6, lowest_max_degree=12, max_build_heap_size=15))
    e = made.edges.toPandas()
    assert (e.src != e.dst).all() and not e.duplicated(["layer", "src", "dst"]).any() and e.dst.between(0, 149).all()
    assert made.edges.where("layer = 0").groupBy("src").count().agg({"count": "max"}).first()[0] <= 12
    q = pts.where("id < 30").withColumnRenamed("id", "qid")
    truth, found = knn.knn_query(pts, q, 5), made.knn_query(q, 5, heap=40)
    assert knn.recall(found, truth, ("qid", "id")).first().recall > 0.9
    assert knn.recall(made.knn_query(q, 5, heap=150), truth, ("qid", "id")).first().recall == 1.0
    made.set_max_frontier_size(3)
    assert knn.recall(made.knn_query(q, 5, heap=40), truth, ("qid", "id")).first().recall > 0.8


def test_small_random_graph_has_no_loops(spark):
    pts = line(spark, *range(5))
    e = descent.random_graph(pts, 100).toPandas()
    assert (e.src != e.dst).all()


def test_flat_index_file(spark, tmp_path):
    n, dim, bottom, degree = 3, 2, 4, 2
    size = 8 + 4 * bottom + 4 + 4 * dim
    head = bytearray(96)
    for at, x in ((16, n), (24, size), (56, degree), (64, bottom)):
        struct.pack_into("<Q", head, at, x)
    body = b""
    for k in range(n):
        other = [x for x in range(n) if x != k]
        body += struct.pack("<HH", 2, 0) + struct.pack("<4I", *other, 0, 0) + struct.pack("<2f", k, 0) + struct.pack("<Q", k)
    upper = [struct.pack("<I", 4 * degree + 4) + struct.pack("<HH2I", 1, 0, 1, 0), struct.pack("<I", 4 * degree + 4) + struct.pack("<HH2I", 1, 0, 0, 0), struct.pack("<I", 0)]
    (tmp_path / "x.bin").write_bytes(bytes(head) + body + b"".join(upper))
    pts, levels, edges = sources.read_flat_index(spark, str(tmp_path / "x.bin"))
    assert rows(pts) == [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])]
    assert rows(levels) == [(0, 1), (1, 1), (2, 0)]
    assert edges.count() == 8 and edges.where("layer = 1").count() == 2
    made = index.Index.from_flat_file(spark, str(tmp_path / "x.bin"))
    q = spark.createDataFrame([(7, [1.9, 0.0])], "qid long, features array<double>")
    assert [r.id for r in made.knn_query(q, 3, heap=5).orderBy("rank").collect()] == [2, 1, 0] and made.n_layers == 2


def test_scores(spark):
    a = spark.createDataFrame([(k, k // 3) for k in range(9)], "id long, cluster int")
    assert quality.adjusted_rand(a, a).first().ari == 1.0
    assert abs(quality.mutual_information(a, a).first().nmi - 1) < 1e-12
    truth = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 2, 0.0)], "u long, v long, height double")
    pairs = quality.joined_heights(truth, truth, drop_zeros=True)
    assert pairs.count() == 2 and quality.mean_ratio(pairs).first()[0] == 1.0


def test_heaps_sets_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 4), (2, 9)], "k int, v int")
    assert sorted(r.v for r in relational.top_k(df, ["k"], ["v"], 2).collect()) == [3, 4, 9]
    assert [r.v for r in relational.top_k(df, ["k"], ["v"], 2, rest=True).collect()] == [5]
    sources.write_csv(df, str(tmp_path / "c"))
    assert sources.read_csv(spark, str(tmp_path / "c")).count() == 4
    assert sources.count_files(spark, str(tmp_path / "c"), "*.csv") >= 1
    assert [r["rank"] for r in relational.ranked(df, ["v"]).orderBy("v").collect()] == [0, 1, 2, 3]


def test_streaming_tree(spark):
    pts = sources.points_from_numpy(spark, np.random.default_rng(3).random((40, 3)))
    tree = StreamingTree()
    for k in range(3):
        tree.update(pts.where(f"id % 3 = {k}"), k)
    tree.update(pts.where("id % 3 = 0"), 3)  # given again
    assert sorted(map(tuple, tree.tree.collect())) == sorted(map(tuple, mst.exact_tree(pts).collect()))


def test_kernel_bits(spark):
    pts = sources.points_from_numpy(spark, np.random.default_rng(4).random((6, 33)))
    p = pts.toPandas()
    x = np.array(p.features.tolist())
    want = {(r.u, r.v): r.d2 for r in graph.with_distance(pts, knn.all_pairs(pts).select("u", "v"), "u", "v").collect()}
    d = block_d2(x, x)
    assert all(d[u, v] == w for (u, v), w in want.items())


def test_raster():
    assert dendrogram.draw_line(np.zeros((9, 9)), 0, 4, 8, 4)[4].min() > 0.9


def test_bucketed_neighbours_of_a_hot_group(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal(16) + 0.1 * rng.standard_normal((4000, 16))
    pts = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, features array<double>")
    d = block_d2(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(k, int(j)) for k in range(4000) for j in np.argsort(d[k])[:5]}
    got = {(r.src, r.dst) for r in knn.knn_graph_bucketed(pts, 5, block=256).select("src", "dst").collect()}
    assert len(got & want) >= 0.9 * len(want), len(got & want) / len(want)


def heights(df):
    return [r.height for r in df.orderBy("merge_no").collect()]


@pytest.mark.parametrize("expand", [False, True])
def test_min_pts_with_and_without_expansion(spark, expand):
    pts = line(spark, 0, 1, 3, 7)
    assert heights(clustering.from_pool(pts, knn.all_pairs(pts).select("u", "v", "d2"), min_pts=2, expand=expand)) == [3, 3, 6]
    if expand:  # two edges a point at first
        pool = graph.undirected(knn.knn_graph(pts, 2))
        assert heights(clustering.from_pool(pts, pool, min_pts=2, expand=True, symmetric=True)) == [3, 3, 6]


def test_index_dendrogram_uses_min_pts(spark):
    pts = line(spark, 0, 1, 3, 7)
    made, core, _ = clustering.index_dendrogram(pts, min_pts=2)
    assert heights(made) == [3, 3, 6] and [r.core for r in core.orderBy("id").collect()] == [3, 2, 3, 6]
    assert heights(clustering.index_dendrogram(pts)[0]) == [1, 2, 4]


def test_bridges_are_raised_to_core_distances(spark):
    pts = line(spark, 0, 1, 2, 10, 14, 18)
    pool = graph.undirected(knn.knn_graph(pts, 2))
    # cores at 2: 2, 1, 2, 8, 4, 8; the gap of 8 between 2 and 10 is below none, that of 0..2 is
    assert heights(clustering.from_pool(pts, pool, min_pts=2)) == [2, 2, 8, 8, 8]
    far = line(spark, 0, 5, 6, 11)
    apart = spark.createDataFrame([(0, 1, 25.0), (2, 3, 25.0)], "u long, v long, d2 double")
    assert heights(clustering.from_pool(far, apart, min_pts=1)) == [1, 5, 5]
    assert heights(clustering.from_pool(far, apart.unionByName(spark.createDataFrame([(0, 1, 25.0)], "u long, v long, d2 double")), min_pts=1)) == [1, 5, 5]
    core = spark.createDataFrame([(k, 9.0) for k in range(4)], "id long, core double")
    tree = mst.bridged_forest(far, apart, core)
    assert sorted(r.d2 for r in tree.collect()) == [9, 25, 25]


@pytest.mark.parametrize("near", [1, 3, 30])
def test_bridges_from_lists_of_any_length(spark, near):
    pts = sources.points_from_numpy(spark, np.random.default_rng(8).random((70, 2)))
    pool = graph.undirected(knn.knn_graph(pts, 1))
    assert sorted(map(tuple, mst.bridged_forest(pts, pool, near=near).collect())) == sorted(map(tuple, mst.exact_tree(pts).collect()))


def test_large_ids_of_components(spark):
    base = 1 << 60
    pts = spark.createDataFrame([(base + k, [float(x)]) for k, x in enumerate((0, 1, 5, 6))], "id long, features array<double>")
    pool = spark.createDataFrame([(base, base + 1, 1.0), (base + 2, base + 3, 1.0)], "u long, v long, d2 double")
    assert sorted((r.u - base, r.v - base) for r in mst.bridged_forest(pts, pool).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_cut_of_one_point_and_of_forests(spark):
    assert rows(dendrogram.flat_cut(clustering.exact_dendrogram(line(spark, 1)), 1, 2, 1)) == [(0, -1)]
    assert rows(dendrogram.flat_cut(clustering.exact_dendrogram(line(spark)), 0, 2, 1)) == []
    two = dendrogram.from_tree(mst.forest(graph.undirected(knn.knn_graph(line(spark, 0, 1, 2, 20, 21, 22), 2))), 6)
    assert [r[1] for r in rows(dendrogram.flat_cut(two, 6, 1, 2))] == [r[1] for r in rows(dendrogram.flat_cut(two, 6, 2, 2))]
    assert len({r[1] for r in rows(dendrogram.flat_cut(two, 6, 2, 2))}) == 2


def test_components_by_rounds_and_sizes(spark):
    pool = spark.createDataFrame([(k, k + 1, 1.0) for k in range(40) if k % 7], "u long, v long, d2 double")
    nodes = spark.range(41)
    label = graph.components(nodes, pool, limit=0)
    assert rows(label) == rows(graph.components(nodes, pool))
    assert {r.id: r.size for r in graph.with_size(label).collect()}[1] == 7
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "u long, v long")
    assert [r.connected for r in graph.are_connected(pairs, label).orderBy("v").collect()] == [True, False]


def test_random_edges_are_as_many_as_asked(spark):
    e = graph.random_edges(spark.range(50), 12).toPandas()
    assert (e.groupby("src").dst.nunique() == 12).all() and (e.src != e.dst).all() and e.dst.between(0, 49).all()
    assert graph.random_edges(spark.range(3), 12).count() == 6 and graph.random_edges(spark.range(1), 3).count() == 0


def test_batch_edges_and_flags(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 2, 4.0)], "src long, dst long, d2 double")
    new = spark.createDataFrame([(0, 1, 1.0), (2, 0, 4.0), (2, 0, 4.0)], "src long, dst long, d2 double")
    assert sorted((r.src, r.dst, r.is_new) for r in graph.add_edges(e, new).collect()) == [(0, 1, False), (0, 2, False), (2, 0, True)]
    assert graph.remove_edges(e, new).count() == 1 and graph.set_flags(e, True).where("is_new").count() == 2


def plain_fold(x, cands, rule, max_cos=0.5, verify=False):
    """kept and moved edges of node 0 among candidates, pair by pair."""
    d = lambda a, b: float(((x[a] - x[b]) ** 2).sum())
    cos = lambda uv, uw, vw: (uv + uw - vw) / (2 * np.sqrt(uv) * np.sqrt(uw)) if uv > 0 and uw > 0 else -1.0
    kept, moved = [], []
    for v in sorted(cands, key=lambda c: (d(0, c), c)):
        keep, done = True, False
        for w in kept:
            if d(v, w) <= d(0, v) if rule == "occlusion" else cos(d(0, v), d(0, w), d(v, w)) >= max_cos:
                keep = False
                if not done and (not verify or d(v, w) < d(0, w) or cos(d(0, w), d(v, w), d(0, v)) < max_cos):
                    moved.append((w, v))
                    done = True
        if keep:
            kept.append(v)
    return kept, moved


@pytest.mark.parametrize("rule,verify", [("occlusion", False), ("angle", False), ("angle", True)])
def test_folds_pair_by_pair(spark, rule, verify):
    x = np.random.default_rng(6).integers(0, 6, (40, 3)).astype(float)
    pts = sources.points_from_numpy(spark, x)
    edges = graph.with_distance(pts, spark.createDataFrame([(0, k) for k in range(1, 40)], "src long, dst long"))
    kept, moved = plain_fold(x, range(1, 40), rule, verify=verify)
    from vecloom.operators.prune import moved_edges

    got = moved_edges(pts, edges, 0.5 if rule == "angle" else None, verify).collect()
    assert sorted(r.dst for r in got if r.kept) == sorted(kept)
    assert sorted((r.src, r.dst) for r in got if not r.kept) == sorted(moved)
    assert sorted(r.dst for r in prune(pts, edges, rule, 0.5).collect()) == sorted(kept)


@pytest.mark.parametrize("params,least", [
    (index.DescentParams(30, 30, 3, 6), 0.8), (index.DescentParams(30, 30, 2, 4, max_cos=0.5, verify_sen_edges=True, prune_non_sen_edges=False), 0.6),
    (index.DescentParams(10, 30, 2, ego_radius=2), 0.9), (index.DescentParams(20, 30, 3, max_cos=0.5, ego_radius=2), 0.7),
])
def test_descents_reach_neighbours(spark, params, least):
    pts = sources.points_from_numpy(spark, np.random.default_rng(9).random((100, 3)))
    made = index.build_descent(pts, params)
    assert knn.recall(graph.add_reverse(made.layer()), knn.knn_graph(pts, 1)).first().recall >= least


@pytest.mark.parametrize("params", [dict(flooding=True), dict(max_cos=0.5, finetune_sen=True), dict(post_prune_heuristic=True, n_rounds=2)])
def test_layered_variants_are_searched(spark, params):
    pts = sources.points_from_numpy(spark, np.random.default_rng(9).random((150, 3)))
    made = index.build_layered(pts, index.LayeredParams(max_build_heap_size=20, lowest_max_degree=20, higher_max_degree=10, **params))
    assert made.knn_query(pts.where("id < 20").withColumnRenamed("id", "qid"), 1, heap=20).where("qid = id").count() >= 18


def test_levels_by_another_norm(spark):
    pts = line(spark, *range(300))
    few, many = (graph.layers(pts, 8, 10, norm=n).where("level > 0").count() for n in (0.2, 2.0))
    assert few < many


def test_bucketed_recall_of_20000_points(spark):
    rng = np.random.default_rng(1)
    x = rng.random((20_000, 12))
    pts = sources.points_from_numpy(spark, x)
    q = rng.choice(20_000, 200, replace=False)
    d = ((x[q][:, None] - x[None]) ** 2).sum(2)
    d[np.arange(200), q] = np.inf
    want = {(int(a), int(b)) for a, row in zip(q, d) for b in np.argsort(row)[:10]}
    found = knn.knn_graph_bucketed(pts, 10).select("src", "dst", "d2", "rank")
    some = found.where(found.src.isin([int(a) for a in q])).collect()
    assert len({(r.src, r.dst) for r in some} & want) >= 0.9 * len(want)
    assert all(abs(r.d2 - ((x[r.src] - x[r.dst]) ** 2).sum()) < 1e-12 for r in some)


def test_searchers_advance_by_distance(spark):
    pts = line(spark, *range(30))
    e = graph.add_reverse(knn.knn_graph(pts, 2))
    from vecloom.operators.search import searchers

    got = searchers(pts, e, 4).where("id = 10").orderBy("rank").collect()
    assert [r.cand for r in got] == [9, 11, 8, 12] and [r.d2 for r in got] == [1, 1, 4, 4]


@pytest.mark.parametrize("ef", [1, 5])
def test_searcher_dendrogram(spark, ef):
    x = np.random.default_rng(5).standard_normal((120, 3))
    x[::2] += 40
    pts = sources.points_from_numpy(spark, x)
    made, told = clustering.searcher_dendrogram(pts, index.LayeredParams(max_build_heap_size=8, lowest_max_degree=12), ef=ef)
    assert np.allclose(heights(made), heights(clustering.exact_dendrogram(pts))) if ef == 5 else made.count() == 119
    assert told[-1][0] == 1.0 and [s for s, _ in told] == sorted(s for s, _ in told)


def test_agreement_of_dendrograms(spark):
    pts = line(spark, *range(12), *range(100, 112))
    one = clustering.exact_dendrogram(pts)
    assert clustering.agreement(one, one, 24, 2).first().ari == 1.0


def test_results_with_squared_heights_and_broken_ones(spark):
    truth = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (1, 2, 3.0)], "u long, v long, height double")
    kind = "algo string, time double, run int, params string, dendrogram array<struct<left_id: long, right_id: long, height: double, size: long>>"
    data = [("plain", 1.0, 1, "{}", [(0, 1, 1.0, 2), (2, 3, 3.0, 3)]), ("square", 1.0, 1, "{}", [(0, 1, 1.0, 2), (2, 3, 9.0, 3)]), ("twice", 1.0, 1, "{}", [(0, 1, 1.0, 2), (1, 3, 3.0, 3)]), ("none", 1.0, 1, "{}", None), ("small", 1.0, 1, "{}", [(0, 1, 1.0, 2)])]
    from pyspark.sql import functions as F

    got = quality.evaluate(spark.createDataFrame(data, kind), truth, F.col("algo") == "square", block=2).collect()
    of = {(r.algo, r.measure): r.quality for r in got}
    assert len(got) == 15 and all(abs(of[a, m] - 1) < 1e-9 for a in ("plain", "square") for m in quality.MEASURES)
    assert all(of[a, m] is None for a in ("twice", "none", "small") for m in quality.MEASURES)


def test_merge_heights_by_brute_force():
    rng = np.random.default_rng(3)
    n = 40
    alive, left, right = list(range(n)), [], []
    for k in range(n - 1):
        a, b = rng.choice(len(alive), 2, replace=False)
        left.append(alive[a])
        right.append(alive[b])
        alive = [x for j, x in enumerate(alive) if j not in (a, b)] + [n + k]
    height = rng.random(n - 1)
    below = {k: {k} for k in range(n)}
    want = np.zeros((n, n))
    for k in range(n - 1):
        p, q = below[left[k]], below[right[k]]
        for u in p:
            for v in q:
                want[u, v] = want[v, u] = height[k]
        below[n + k] = p | q
    u, v = np.divmod(np.arange(n * n), n)
    left, right = np.array(left), np.array(right)
    assert quality.whole_dendrogram(left, right) and np.array_equal(quality.merge_heights(left, right, height, u, v), want.ravel())


def test_generators_and_results(spark, tmp_path):
    assert sources.normal_points(spark, 30, 4).count() == 30 and sources.uniform_points(spark, 30, 4).where("size(features) = 4").count() == 30
    two = np.array([r.features for r in sources.two_gaussians(spark, 200).orderBy("id").collect()])
    assert two[::2].mean() < 1 and two[1::2].mean() > 4
    spark.createDataFrame([("a", 1), ("b", 2)], "algo string, run int").write.parquet(str(tmp_path / "r"))
    assert [r.run for r in sources.read_results(spark, str(tmp_path / "r"), algo="b").collect()] == [2]
    sources.show_dendrogram(dendrogram.layout(clustering.exact_dendrogram(line(spark, 0, 1, 3)), 3), str(tmp_path / "d.png")) if has("matplotlib") else None


def has(name):
    import importlib.util

    return importlib.util.find_spec(name) is not None


def test_bucketed_index_recall(spark):
    """1,500 points are more than a bucket: candidates come from hyperplanes and one round of neighbours' neighbours."""
    x = np.random.default_rng(12).standard_normal((1500, 12))
    pts = sources.points_from_numpy(spark, x)
    made = index.build_layered(pts, index.LayeredParams(max_build_heap_size=20, lowest_max_degree=24, higher_max_degree=10))
    queries = pts.where("id % 25 = 0").selectExpr("id AS qid", "features")
    truth = knn.knn_query(pts, queries, 10)
    assert knn.recall(made.knn_query(queries, 10, 60), truth, ("qid", "id")).first().recall >= 0.9
    near = knn.knn_graph_bucketed(pts, 10).cache()
    exact = knn.knn_graph(pts, 10)
    assert knn.recall(near, exact).first().recall < 1.0  # buckets did decide
    assert knn.recall(knn.knn_local_join(pts, near, 10), exact).first().recall >= 0.9
