"""Minimum spanning forests, core distances, bridges and expansion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_d2, near_tiles, pairs_d2, squared_l2
from ..session import release, save
from .dendrogram import block_pairs, tree_row
from .graph import components, expand_pairs, unseen_pairs, with_distance
from .kernels import forest_of, local_forest
from .knn import BLOCK, CELL, CELLS, _cells, knn_graph

ALL_TREES = 16_384  # points up to which trees of all blocks' pairs make the exact tree
ONE_TASK = 2_000_000  # edges that one task may finish; beyond it Boruvka's rounds do


def forest(pool: DataFrame, weight: str = "d2", limit: int = ONE_TASK) -> DataFrame:
    """(u, v, weight): the minimum spanning forest of pool(u, v, weight) in the total order (weight, u, v).

    Every partition drops the edges that its own forest doesn't need, since the
    forest of a union lies in the union of forests. If at most ``limit`` edges are
    left, one task finishes; else Boruvka rounds do, each a few joins and
    aggregations over the edges between components.
    """
    schema = "u long, v long, w double"
    edges = pool.select("u", "v", F.col(weight).alias("w")).where("u <> v")
    left = save(edges.mapInPandas(local_forest, schema), "forest")
    if left.count() <= limit:
        return left.coalesce(1).mapInPandas(local_forest, schema).withColumnRenamed("w", weight)
    return boruvka(left).withColumnRenamed("w", weight)


def boruvka(edges: DataFrame) -> DataFrame:
    """The forest of (u, v, w) by rounds: each component takes its lightest edge to another."""
    live = save(edges.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "live")
    chosen: DataFrame | None = None
    while live.head(1):
        ends = live.select("cu", "cv", "u", "v", "w").unionByName(live.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "u", "v", "w"))
        best = ends.groupBy("cu").agg(F.min(F.struct("w", "u", "v", "cv")).alias("e")).select("cu", "e.*")
        best = save(best, "best")
        new = save(best.select("u", "v", "w").distinct(), "chosen")
        chosen = new if chosen is None else chosen.unionByName(new)
        nodes = best.select(F.col("cu").alias("id")).unionByName(best.select(F.col("cv").alias("id"))).distinct()
        label = components(nodes, best.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")))
        to = lambda c: label.select(F.col("id").alias(c), F.col("component").alias("_" + c))
        left = save(live.join(to("cu"), "cu").join(to("cv"), "cv").select("u", "v", "w", F.col("_cu").alias("cu"), F.col("_cv").alias("cv")).where("cu <> cv"), "live")
        release(live, best)
        live = left
    return edges.limit(0) if chosen is None else chosen


def _prim(ids: np.ndarray, x: np.ndarray, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tree of a block's points by Prim's algorithm, in the total order (d2, u, v); d2 raised to both ends' core where given."""
    d = block_d2(x, x)
    if core is not None:
        d = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    n = len(ids)
    best, par = d[0].copy(), np.zeros(n, dtype=np.int64)
    free = np.ones(n, dtype=bool)
    free[0] = False
    out = []
    key = lambda k: (np.minimum(ids[k], ids[par[k]]), np.maximum(ids[k], ids[par[k]]))
    for _ in range(n - 1):
        able = np.flatnonzero(free)
        low = able[best[able] == best[able].min()]
        if len(low) > 1:
            u, v = key(low)
            low = low[np.lexsort((v, u))]
        k = int(low[0])
        free[k] = False
        out.append((k, int(par[k]), best[k]))
        closer = d[k] < best
        tie = np.flatnonzero((d[k] == best) & free)
        for t in tie:  # of equal lengths the edge first in the total order
            if (min(ids[t], ids[k]), max(ids[t], ids[k])) < (min(ids[t], ids[par[t]]), max(ids[t], ids[par[t]])):
                closer[t] = True
        par[closer & free] = k
        best = np.where(closer & free, d[k], best)
    a = np.array([o[0] for o in out], dtype=np.int64)
    b = np.array([o[1] for o in out], dtype=np.int64)
    return ids[a], ids[b], np.array([o[2] for o in out])


def exact_tree(points: DataFrame, block: int = BLOCK // 2, core: DataFrame | None = None, few: int = ALL_TREES) -> DataFrame:
    """(u, v, d2): the minimum spanning tree of the complete graph on points(id, features), with d2 raised to ``core`` (id, core) where given.

    Up to ``few`` points each pair of blocks contributes the tree of its own points, at most two blocks'
    worth of edges instead of all their pairs; the forest of these is the tree. Of more points each component, at first a point, takes
    its closest partner round by round, which measures few pairs in exact sums (bridged_forest).
    """
    if points.count() > few:
        return bridged_forest(points, None, core)
    raised = core is not None

    def fn(a, x, b, y, same):
        if not len(a):
            return {"u": a, "v": b, "d2": np.zeros(0)}
        ids, feats = (a, x) if same else (np.concatenate((a, b)), np.concatenate((x, y)))
        u, v, w = _prim(ids, feats[:, 1:], feats[:, 0]) if raised else _prim(ids, feats)
        return {"u": np.minimum(u, v), "v": np.maximum(u, v), "d2": w}

    if raised:
        known = points.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
        points = known.select("id", F.concat(F.array("core"), F.col("features").cast("array<double>")).alias("features"))
    return forest(_cells(points, None, fn, "u long, v long, d2 double", block, whole=True).distinct())


def core_distances(pool: DataFrame, min_pts: int, nodes: DataFrame | None = None) -> DataFrame:
    """(id, core): weight of each node's min_pts-th lightest incident edge, itself not counted; null if it has fewer."""
    if min_pts < 1:
        raise ValueError("min_pts is at least 1")
    ends = pool.select(F.col("u").alias("id"), "d2").unionByName(pool.select(F.col("v").alias("id"), "d2"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2"))
    core = ends.withColumn("r", rank).where(F.col("r") == min_pts).select("id", F.col("d2").alias("core"))
    return core if nodes is None else nodes.select("id").join(core, "id", "left")


def mutual_reachability(pool: DataFrame, min_pts: int) -> DataFrame:
    """The pool with d2 raised to both ends' core distances; edges of nodes that are never core are left out."""
    core = core_distances(pool, min_pts)
    a, b = core.select(F.col("id").alias("u"), F.col("core").alias("cu")), core.select(F.col("id").alias("v"), F.col("core").alias("cv"))
    return pool.join(a, "u").join(b, "v").select("u", "v", F.greatest("d2", "cu", "cv").alias("d2"))


def _raised(pairs: DataFrame, core: DataFrame | None) -> DataFrame:
    """Pairs (u, v, d2, ...) with d2 raised to the core distances that their ends have."""
    if core is None:
        return pairs
    a, b = core.select(F.col("id").alias("u"), F.col("core").alias("_cu")), core.select(F.col("id").alias("v"), F.col("core").alias("_cv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").withColumn("d2", F.greatest("d2", "_cu", "_cv")).drop("_cu", "_cv")


def closest_bridges(points: DataFrame, labels: DataFrame, core: DataFrame | None = None, asking: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(c, u, v, d2): for each component c its closest pair to any other, exactly; d2 raised to ``core`` (id, core) where given.

    With ``asking`` (id) only these points look for a partner, among all points.
    """
    rows = points.join(labels, "id").select("id", "component", "features")
    rows = rows.withColumn("core", F.lit(0.0)) if core is None else rows.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(0.0)))
    # component ids are kept beside the vectors as two exact halves, since a vector holds doubles
    half = F.lit(1 << 31)
    wide = F.concat(F.array(F.floor(F.col("component") / half).cast("double"), F.pmod("component", half).cast("double"), "core"), F.col("features"))
    rows = rows.select("id", wide.alias("features"))
    one_sided, raised = asking is not None, core is not None

    def label(x: np.ndarray) -> np.ndarray:
        return x[:, 0].astype(np.int64) * (1 << 31) + x[:, 1].astype(np.int64)

    def fn(a, x, b, y, same):
        parts = [found(a, x, b, y)]
        if not same and not one_sided:
            parts.append(found(b, y, a, x))
        return pd.concat(parts).sort_values(["c", "d2", "u", "v"]).drop_duplicates("c")

    def found(a, x, b, y):
        parts = [pd.DataFrame({"c": a[:0], "d2": np.zeros(0), "u": a[:0], "v": b[:0]})]
        cx, cy, hx, hy, x, y = label(x), label(y), x[:, 2], y[:, 2], x[:, 3:], y[:, 3:]
        for at, d, slack in near_tiles(x, y):
            c = cx[at : at + len(d)]
            d[(c[:, None] == cy[None, :]) | np.isnan(d)] = np.inf
            if raised:
                d = np.maximum(np.maximum(d, hx[at : at + len(d), None]), hy[None, :])
            low = d.min(axis=1)
            i, j = np.divmod(np.flatnonzero((d <= low[:, None] + 2 * slack) & np.isfinite(d)), len(b))
            exact = np.maximum(np.maximum(pairs_d2(x, y, i + at, j), hx[at + i]), hy[j])
            rows = pd.DataFrame({"c": c[i], "d2": exact, "u": np.minimum(a[at + i], b[j]), "v": np.maximum(a[at + i], b[j])})
            parts.append(rows.sort_values(["c", "d2", "u", "v"]).drop_duplicates("c"))
        return pd.concat(parts)

    left = rows if asking is None else rows.join(asking, "id", "left_semi")
    closest = _cells(left, None if asking is None else rows, fn, "c long, d2 double, u long, v long", block, whole=True)
    return closest.groupBy("c").agg(F.min(F.struct("d2", "u", "v")).alias("e")).select("c", "e.u", "e.v", "e.d2")


def bridged_forest(points: DataFrame, pool: DataFrame | None, core: DataFrame | None = None, near: int = 16) -> DataFrame:
    """The forest of the pool, joined to one tree by closest cross pairs, round by round.

    With ``core`` (id, core) the pool's d2 are raised to core distances already, and so are those of
    cross pairs. Each component takes its closest partner: from lists of ``near`` neighbours
    a point, made once, where they prove it the closest. Points that could have a closer one
    beyond their list are compared with all others. Without a pool it begins with points alone, so that the forest is the exact tree.
    """
    points = save(points.select("id", "features"), "points") if pool is None else points
    tree = save(points.sparkSession.createDataFrame([], "u long, v long, d2 double") if pool is None else forest(pool), "tree")
    lists: DataFrame | None = None
    n = points.count()
    while tree.count() < n - 1:
        label = save(components(points, tree), "labels")
        if lists is None:
            found = knn_graph(points, near).select(F.col("src").alias("u"), F.col("dst").alias("v"), "d2", F.col("d2").alias("raw"))
            lists = save(_raised(found, core), "lists")
        to = lambda c: label.select(F.col("id").alias(c), F.col("component").alias("c" + c))
        foreign = F.when(F.col("cu") != F.col("cv"), F.struct("d2", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
        seen = lists.join(to("u"), "u").join(to("v"), "v").groupBy("u").agg(F.min(foreign).alias("best"), F.max("raw").alias("radius"), F.first("cu").alias("c"))
        seen = save(label.select(F.col("id").alias("u"), F.col("component").alias("c")).join(seen.drop("c"), "u", "left"), "seen")
        best = seen.groupBy("c").agg(F.min("best").alias("best"))
        # a point's unlisted neighbours are at least as far as its list reaches
        doubt = seen.select("u", "c", "radius").join(best, "c").where("radius IS NULL OR best IS NULL OR radius <= best.d2").select(F.col("u").alias("id"))
        doubt = save(doubt, "doubt")
        both = best.where("best IS NOT NULL").select(F.col("best.a").alias("u"), F.col("best.b").alias("v"), "best.d2", "c")
        if doubt.head(1):
            both = both.unionByName(closest_bridges(points, label, core, doubt).select("u", "v", "d2", "c"))
        new = both.groupBy("c").agg(F.min(F.struct("d2", "u", "v")).alias("e")).select("e.u", "e.v", "e.d2").distinct()
        larger = save(forest(tree.select("u", "v", "d2").unionByName(new)), "tree")
        same = larger.count() == tree.count()  # points without finite distances stay alone
        release(tree, label, seen, doubt)
        tree = larger
        if same:
            break
    return tree


def expanded_pool(points: DataFrame, pool: DataFrame, symmetric: bool = False, min_pts: int = 1) -> DataFrame:
    """The pool after expansion: the pool's neighbours of its tree's ends join it, again until the tree's edges stay.

    The tree is that of mutual reachability for ``min_pts`` above 1. Neighbours are those of the pool as it was given, so an edge of
    the tree is expanded once and what joins the pool grows with the points, not with the square of a growing pool's degrees.
    """
    tree_of = lambda p: save(forest(mutual_reachability(p, min_pts) if min_pts > 1 else p), "tree")
    graph = pool = save(pool.select("u", "v", "d2"), "pool")
    tree = tree_of(pool)
    fresh, done = tree, None
    while True:
        pairs = unseen_pairs(expand_pairs(graph, fresh.select("u", "v"), symmetric), pool)
        new = save(with_distance(points, pairs, "u", "v").select("u", "v", "d2"), "expansion")
        done = fresh.select("u", "v") if done is None else done.unionByName(fresh.select("u", "v"))
        if not new.head(1):
            return pool
        pool = pool.unionByName(new)
        tree = tree_of(pool)
        fresh = save(tree.select("u", "v").join(done, ["u", "v"], "left_anti"), "fresh")
        if not fresh.head(1):
            return pool


def completed_tree(points: DataFrame, tree: DataFrame, block: int | None = None) -> DataFrame:
    """(u, v, d2): the exact tree of the points, from any of their spanning trees (u, v, d2): the better that is, the less is left to do.

    A pair can only be an edge if it is no longer than the longest edge on its path in the tree given, which is the largest gap between both
    in the row of its dendrogram. Blocks of the row are paired; matrix products rule out nearly all pairs, the others are measured exactly.
    """
    row = save(tree_row(tree), "row")
    own, between = block_pairs(row, block or min(CELL, max(BLOCK, -(-row.count() // CELLS))))
    both = F.when(F.col("b") == F.col("c"), F.array("b")).otherwise(F.array("b", "c"))
    met = between.select(F.col("b").alias("i"), F.col("c").alias("j"), "mid", F.explode(both).alias("b"))
    met = met.join(own.join(points.select("id", "features"), "id"), "b").select("i", "j", "mid", (F.col("b") == F.col("i")).alias("first"), "pos", "id", "gap", "features")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, ids, gap = pdf["first"].to_numpy(), pdf["id"].to_numpy(), pdf["gap"].to_numpy()
        x, same, mid = np.array(pdf["features"].tolist(), dtype=np.float64), pdf["i"].iat[0] == pdf["j"].iat[0], pdf["mid"].iat[0]
        other = first if same else ~first
        a, b, y = ids[first], ids[other], x[other]
        after = np.append(np.maximum.accumulate(gap[first][::-1])[::-1][1:], -np.inf)
        head = np.maximum(np.maximum.accumulate(gap[other]), -np.inf if pd.isna(mid) else mid)
        held = pd.DataFrame({"u": a[:0], "v": b[:0], "w": np.zeros(0)})
        for at, d, slack in near_tiles(x[first], y):
            if same:  # running maxima of the gaps after each leaf
                later = np.arange(len(b)) > np.arange(at, at + len(d))[:, None]
                top = np.maximum.accumulate(np.where(later, gap, -np.inf), axis=1)
                able = later & (d <= top * top * (1 + 1e-9) + 2 * slack)
            else:
                top = np.maximum(after[at : at + len(d), None], head[None, :])
                able = d <= top * top * (1 + 1e-9) + 2 * slack
            i, j = np.divmod(np.flatnonzero(able), len(b))
            p, q = a[at + i], b[j]
            held = forest_of(pd.concat([held, pd.DataFrame({"u": np.minimum(p, q), "v": np.maximum(p, q), "w": pairs_d2(x[first], y, at + i, j)})]))
        return held.rename(columns={"w": "d2"})

    found = met.groupBy("i", "j").applyInPandas(run, "u long, v long, d2 double")
    return forest(found.unionByName(tree.select("u", "v", "d2")))


def expanded_forest(points: DataFrame, pool: DataFrame, symmetric: bool = False) -> DataFrame:
    """The forest of the expanded pool."""
    return forest(expanded_pool(points, pool, symmetric))


def nearest_foreign_rounds(points: DataFrame, pool: DataFrame) -> DataFrame:
    """The batch form of priority searchers: each round every component takes its nearest foreign neighbour; gaps are bridged."""
    tree = boruvka(pool.select("u", "v", F.col("d2").alias("w"))).withColumnRenamed("w", "d2")
    return bridged_forest(points, tree)


__all__ = ["boruvka", "bridged_forest", "closest_bridges", "core_distances", "exact_tree", "expanded_forest", "forest", "mutual_reachability", "nearest_foreign_rounds", "squared_l2"]
