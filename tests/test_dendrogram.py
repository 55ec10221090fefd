"""Dendrogram operators against sequential second implementations, in blocks of a few edges and merges."""

import numpy as np
import pytest

from vecloom.operators import dendrogram

LIMIT = 13


def merges(tree, n):
    root, node, size, out = list(range(n)), list(range(n)), [1] * n, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (w, u, v) in enumerate(sorted((w, u, v) for u, v, w in tree)):
        a, b = find(u), find(v)
        out.append((k, min(node[a], node[b]), max(node[a], node[b]), float(np.sqrt(w)), size[a] + size[b]))
        root[b], node[a], size[a] = a, n + k, size[a] + size[b]
    return out


def leaves_of(d, n):
    held = {k: [k] for k in range(n)}
    for k, a, b, _, _ in d:
        held[n + k] = held[a] + held[b]
    return held


def raised(d, n):
    top, out = {}, []
    for k, a, b, h, s in d:
        top[n + k] = max(h, top.get(a, 0.0), top.get(b, 0.0))
        out.append((k, a, b, top[n + k], s))
    return out


def some_tree(kind, n, seed):
    """Forest edges (u, v, w): random, a chain that grows from one end, a star, or several trees, with ties."""
    rng = np.random.default_rng(seed)
    name = rng.permutation(n).tolist()
    out = []
    for k in range(1, n):
        to = {"random": int(rng.integers(0, k)), "chain": k - 1, "star": 0, "trees": int(rng.integers(max(0, k - 4), k))}[kind]
        if kind == "trees" and k % 9 == 0:
            continue
        w = float(k if kind == "chain" else rng.integers(0, n))
        a, b = name[k], name[to]
        out.append((min(a, b), max(a, b), w))
    return out


def test_from_tree_in_blocks(spark):
    for kind in ("chain", "star", "random"):
        tree = some_tree(kind, 50, 5)
        got = dendrogram.from_tree(spark.createDataFrame(tree, "u long, v long, d2 double"), 50, limit=11)
        assert rows(got) == merges(tree, 50)
        assert "Coalesce" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", params=["chain", "trees"])
def made(spark, request):
    n = 60
    tree = some_tree(request.param, n, 3)
    want = merges(tree, n)
    df = spark.createDataFrame(tree, "u long, v long, d2 double").repartition(3)
    d = dendrogram.from_tree(df, n, limit=LIMIT).cache()
    return n, tree, df, want, d


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_from_tree_in_one_block(made):
    n, _, df, want, d = made
    assert rows(d) == want and rows(dendrogram.from_tree(df, n)) == want


def test_intervals_and_row(made):
    n, _, _, want, d = made
    spans, held = dendrogram.intervals(d, n, limit=LIMIT).collect(), leaves_of(want, n)
    row = {r.pos: (r.id, r.gap) for r in dendrogram.leaf_row(dendrogram.intervals(d, n, limit=LIMIT), n).collect()}
    assert sorted(row) == list(range(len(row)))
    for r in spans:
        assert sorted(row[p][0] for p in range(r.lo, r.hi)) == sorted(held[n + r.merge_no])
        assert sorted(row[p][0] for p in range(r.lo, r.mid)) == sorted(held[r.left_id]) and row[r.mid][1] == r.height


def test_round_up_and_sort(spark, made):
    n, _, _, want, _ = made
    rng = np.random.default_rng(1)
    odd = [(k, a, b, float(h), s) for (k, a, b, _, s), h in zip(want, rng.integers(0, 40, len(want)).tolist())]
    df = spark.createDataFrame(odd, dendrogram.SCHEMA)
    up = raised(odd, n)
    assert rows(dendrogram.round_up(df, n, LIMIT)) == up
    order = sorted(range(len(up)), key=lambda k: (up[k][3], k))
    new = {n + k: n + at for at, k in enumerate(order)}
    sorted_ = [(at, *sorted((new.get(up[k][1], up[k][1]), new.get(up[k][2], up[k][2]))), *up[k][3:]) for at, k in enumerate(order)]
    assert rows(dendrogram.sort_by_height(df, n, LIMIT)) == sorted_


@pytest.mark.parametrize("keep", [1, 25])
def test_first_points(made, keep):
    n, _, _, want, d = made
    to, out = {k: (k, 1) if k < keep else None for k in range(n)}, []
    for k, a, b, h, _ in want:
        a, b = to[a], to[b]
        to[n + k] = a or b
        if a and b:
            to[n + k] = (keep + len(out), a[1] + b[1])
            out.append((len(out), min(a[0], b[0]), max(a[0], b[0]), h, a[1] + b[1]))
    assert rows(dendrogram.first_points(d, n, keep, LIMIT)) == out


@pytest.mark.parametrize("k,least", [(3, 2), (4, 30)])
def test_flat_cut(made, k, least):
    n, _, _, want, d = made
    below = {c for r in want for c in r[1:3]}
    clusters = {r[0] for r in want if n + r[0] not in below}
    while clusters and len(clusters) < k:
        top = max(clusters, key=lambda c: (want[c][3], c))
        clusters.remove(top)
        clusters |= {c - n for c in want[top][1:3] if c >= n and want[c - n][4] >= least}
    held, label = leaves_of(want, n), [-1] * n
    for number, c in enumerate(sorted(clusters)):
        for x in held[n + c]:
            label[x] = number
    assert rows(dendrogram.flat_cut(d, n, k, least, LIMIT)) == list(enumerate(label))


def test_largest_gap(made):
    _, _, _, want, d = made
    h = sorted(r[3] for r in want)
    gaps = [b - a for a, b in zip(h, h[1:])]
    at = gaps.index(max(gaps))
    assert rows(dendrogram.largest_gap_cut(d)) == [(len(h) - at, gaps[at])]
    assert rows(dendrogram.largest_gap_cut(d.where("merge_no < 1"))) == [(1, 0.0)] and rows(dendrogram.largest_gap_cut(d.where("merge_no < 0"))) == [(0, 0.0)]


@pytest.mark.parametrize("least,larger", [(3, True)])
def test_layout(made, least, larger):
    n, _, _, want, d = made
    size = lambda c: 1 if c < n else want[c - n][4]
    out, todo = [], [(n + len(want) - 1, 0)]
    while todo:
        c, x = todo.pop()
        if c < n or size(c) < least:
            continue
        _, p, q, h, _ = want[c - n]
        if larger and size(p) < size(q):
            p, q = q, p
        y = [want[m - n][3] if m >= n and size(m) >= least else 0.0 for m in (p, q)]
        out.append((c - n, x + size(p) / 2, x + size(p) + size(q) / 2, *y, h))
        todo += [(p, x), (q, x + size(p))]
    assert rows(dendrogram.layout(d, n, least, larger, LIMIT)) == sorted(out)


def paths(tree, n):
    """Heights of all pairs that a forest joins, by walking it."""
    near, out = {k: [] for k in range(n)}, {}
    for u, v, w in tree:
        near[u].append((v, w))
        near[v].append((u, w))
    for a in range(n):
        todo = [(a, -1, 0.0)]
        while todo:
            x, before, h = todo.pop()
            out[a, x] = float(np.sqrt(h))
            todo += [(y, x, max(h, w)) for y, w in near[x] if y != before]
    return out


def test_pair_heights_and_cophenetic(spark, made):
    n, tree, df, _, _ = made
    want = paths(tree, n)
    wide = df.selectExpr("u * 10 + 3000000000 AS u", "v * 10 + 3000000000 AS v", "d2")
    pairs = [(a, b, a % 5) for a in range(0, n, 2) for b in range(0, n, 3)]
    asked = spark.createDataFrame([(a * 10 + 3 * 10**9, b * 10 + 3 * 10**9, x) for a, b, x in pairs], "u long, v long, x int")
    got = dendrogram.pair_heights(wide, asked, limit=LIMIT).collect()
    back = lambda i: (i - 3 * 10**9) // 10
    assert sorted((back(r.u), back(r.v), r.x, r.height) for r in got if r.height is not None) == sorted((a, b, x, want[a, b]) for a, b, x in pairs if (a, b) in want)
    assert len(got) == len(pairs)
    coph = dendrogram.cophenetic(df, block=8, limit=LIMIT).collect()
    assert {(r.u, r.v): r.height for r in coph} == {(a, b): h for (a, b), h in want.items() if a < b}


def test_range_max(spark):
    rng = np.random.default_rng(4)
    gap = rng.integers(0, 1000, 300).astype(float)
    row = spark.createDataFrame([(k, float(g)) for k, g in enumerate(gap)], "pos long, gap double")
    asked = [(int(a), int(b), k) for k, (a, b) in enumerate(np.sort(rng.integers(0, 300, (400, 2)), axis=1))]
    got = dendrogram.range_max(row, spark.createDataFrame(asked, "a long, b long, q int"), block=4, per_task=20).collect()
    assert {r.q: r.top for r in got} == {q: gap[a : b + 1].max() for a, b, q in asked} and len(got) == 400


def test_ids_must_be_dense(spark):
    tree = spark.createDataFrame([(0, 10, 1.0), (10, 20, 4.0)], "u long, v long, d2 double")
    with pytest.raises(ValueError, match="dense_ids"):
        dendrogram.from_tree(tree, 3)


def test_drawn_pairs(spark):
    from vecloom.operators import relational

    for ids in ([k for k in range(30)], [k * 10 + 2**33 for k in range(30)]):
        points = spark.createDataFrame([(i,) for i in ids], "id long")
        every = rows(relational.drawn_pairs(points, 435))
        assert every == sorted((a, b) for a in ids for b in ids if a < b)
        some = rows(relational.drawn_pairs(points, 50))
        assert len(set(some)) == 50 and set(some) <= set(every)
    with pytest.raises(ValueError, match="fewer"):
        relational.drawn_pairs(points, 436)


def test_ids_need_not_be_dense(spark):
    from vecloom import sources
    from vecloom.operators import graph
    from vecloom.plans import clustering

    x = np.random.default_rng(2).standard_normal((24, 3))
    points = sources.points_from_numpy(spark, x)
    wide = points.selectExpr("id * 10 + 3000000000 AS id", "features")
    assert rows(clustering.exact_dendrogram(wide)) == rows(clustering.exact_dendrogram(points))
    up = lambda e: sorted((a * 10 + 3 * 10**9, b * 10 + 3 * 10**9, w) for a, b, w in map(tuple, e.collect()))
    none = spark.createDataFrame([], "src long, dst long, d2 double")
    assert rows(graph.fill_random_edges(wide, none, 5).groupBy("src").count()) == [(k * 10 + 3 * 10**9, 5) for k in range(24)]
    assert sorted((r.src, r.dst) for r in graph.random_edges(wide, 4).collect()) == sorted((r.src * 10 + 3 * 10**9, r.dst * 10 + 3 * 10**9) for r in graph.random_edges(points, 4).collect())
    assert up(graph.extend_random_edges(points, none, 3)) == rows(graph.extend_random_edges(wide, none, 3))
    assert {c for r in graph.random_pairs(wide, 99).collect() for c in r} <= {k * 10 + 3 * 10**9 for k in range(24)}
