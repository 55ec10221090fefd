"""Occlusion pruning: greedy folds over each node's candidates, nearest first, many nodes at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import Near, pairs_d2
from ..session import release, save
from .knn import CELL, _top, knn_graph

RULES = ("search", "occlusion", "angle")
ROUND = 128  # candidates of a node that a round of prune_all() folds
_CELLS = 1 << 22  # numbers of a block of nodes' candidates that are folded at once


class _Block:
    """Nodes side by side: column j of each array is the j-th nearest candidate of every node."""

    def __init__(self, groups: list[dict[str, np.ndarray]]) -> None:
        self.size = np.array([len(g["dst"]) for g in groups])
        width, dim = int(self.size.max()), groups[0]["x"].shape[1]
        self.own = np.full((len(groups), width), np.inf)
        self.new = np.ones((len(groups), width), dtype=bool)
        self.x = np.zeros((dim, len(groups), width))
        for k, g in enumerate(groups):
            n = len(g["dst"])
            self.own[k, :n], self.new[k, :n], self.x[:, k, :n] = g["d2"], g["new"], g["x"].T
        self.kept = np.zeros((len(groups), width), dtype=bool)
        self.by = np.full((len(groups), width), -1)  # the kept candidate whose edge replaces this one
        self.between = np.zeros((len(groups), width))  # and the length of that edge

    def fold(self, drops: Callable, moves: Callable | None = None) -> None:
        """drops(own of kept, own of j, distances kept to j) says which kept candidates rule j out; moves which of those take it over."""
        n, width = self.own.shape
        rows, room = np.arange(n), 8
        count = np.zeros(n, dtype=np.int64)
        near, at, fresh = np.full((n, room), np.inf), np.zeros((n, room), dtype=np.int64), np.zeros((n, room), dtype=bool)
        kx = np.zeros((len(self.x), n, room))
        for j in range(width):
            if count.max(initial=0) == room:
                near, at, fresh = (np.pad(a, ((0, 0), (0, room)), constant_values=v) for a, v in ((near, np.inf), (at, 0), (fresh, False)))
                kx, room = np.pad(kx, ((0, 0), (0, 0), (0, room))), 2 * room
            used = int(count.max(initial=0))
            d = np.zeros((n, used))
            for k in range(len(self.x)):  # added in the order of squared_l2, so with equal bits
                diff = kx[k, :, :used] - self.x[k, :, j, None]
                d += diff * diff
            there = np.arange(used) < count[:, None]
            out = there & drops(near[:, :used], self.own[:, j, None], d)
            if moves is not None:
                out &= fresh[:, :used] | self.new[:, j, None]
                able = out & moves(near[:, :used], self.own[:, j, None], d)
                hit = able.any(axis=1)
                if hit.any():
                    first = able.argmax(axis=1)
                    self.by[hit, j], self.between[hit, j] = at[rows[hit], first[hit]], d[rows[hit], first[hit]]
            keep = (j < self.size) & ~out.any(axis=1)
            self.kept[:, j] = keep
            near[rows[keep], count[keep]], at[rows[keep], count[keep]], fresh[rows[keep], count[keep]] = self.own[keep, j], j, self.new[keep, j]
            kx[:, rows[keep], count[keep]] = self.x[:, keep, j]
            count[keep] += 1


def cosine(uv: np.ndarray, uw: np.ndarray, vw: np.ndarray) -> np.ndarray:
    """Cosine of the angle at u from squared lengths; -1 where a side at u has no length."""
    den = 2 * np.sqrt(uv) * np.sqrt(uw)
    return np.divide(uv + uw - vw, den, out=np.full(np.broadcast(uv, uw, vw).shape, -1.0), where=den > 0)


def _rule(rule: str, max_cos: float) -> Callable:
    if rule == "search":  # every kept one must be nearer to the node than to j
        return lambda near, own, d: ~(near < d)
    if rule == "occlusion":  # j must be nearer to the node than to any kept one
        return lambda near, own, d: ~(d > own)
    with np.errstate(invalid="ignore"):  # the angle at the node to any kept one must be wide enough
        return lambda near, own, d: ~(cosine(np.where(np.isfinite(near), near, 0.0), np.where(np.isfinite(own), own, 0.0), d) < max_cos)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, np.ndarray]]]:
    """Whole groups of rows (src, d2, dst, new, features) that lie next to each other, so many that a block stays bounded."""
    held: list[dict[str, np.ndarray]] = []
    open_: list[dict[str, np.ndarray]] = []
    width = 0

    def close() -> None:
        nonlocal width
        if open_:
            held.append({k: np.concatenate([g[k] for g in open_]) for k in open_[0]})
            width = max(width, len(held[-1]["dst"]))
            open_.clear()

    for batch in batches:
        src, d2, dst, new = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(src):
            continue
        x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(src), -1)
        cuts = [0, *(np.flatnonzero(np.diff(src)) + 1).tolist(), len(src)]
        for a, b in zip(cuts, cuts[1:]):
            if open_ and open_[-1]["src"][0] != src[a]:
                close()
                if width * len(held) * x.shape[1] >= _CELLS:
                    yield held
                    held, width = [], 0
            open_.append({"src": src[a:b], "d2": d2[a:b], "dst": dst[a:b], "new": new[a:b], "x": x[a:b]})
    close()
    if held:
        yield held


def _folded(points: DataFrame, edges: DataFrame, fn: Callable[[list[dict[str, np.ndarray]]], pd.DataFrame], schema: str) -> DataFrame:
    flag = F.col("is_new") if "is_new" in edges.columns else F.lit(True)
    rows = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.max(flag).alias("new"))
    rows = rows.join(points.select(F.col("id").alias("dst"), "features"), "dst").select("src", "d2", "dst", "new", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _blocks(batches):
            yield pa.RecordBatch.from_pandas(fn(groups), preserve_index=False)

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "src").sortWithinPartitions("src", "d2", "dst").mapInArrow(run, schema)


def prune(points: DataFrame, edges: DataFrame, rule: str = "occlusion", max_cos: float = 0.5, most: int | None = None, refill: bool = False) -> DataFrame:
    """(src, dst, d2, kept): the candidates that the rule keeps, at most ``most`` a node.

    With refill, rejected candidates fill up to ``most`` (kept is false for them). A
    node's candidates meet in one task with their vectors; each is compared with those kept
    before it, so the work grows with candidates times kept ones.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    drops = _rule(rule, max_cos)

    def fn(groups: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        block = _Block(groups)
        block.fold(drops)
        sizes = block.size
        out = pd.DataFrame({k: np.concatenate([g[k] for g in groups]) for k in ("src", "dst", "d2")})
        out["kept"] = np.concatenate([block.kept[k, :n] for k, n in enumerate(sizes)])
        if not refill:
            out = out[out["kept"]]
        if most:
            rank = out.assign(last=~out["kept"]).sort_values(["src", "last", "d2", "dst"], kind="stable")
            out = rank[rank.groupby("src").cumcount() < most].drop(columns="last")
        return out

    return _folded(points, edges, fn, "src long, dst long, d2 double, kept boolean")


def _certain(rule: str, max_cos: float) -> Callable:
    """As _rule(), for distances that may be off by ``slack``: true only where a kept candidate rules j out for certain."""
    if rule == "search":
        return lambda near, own, d, slack: near >= d + 2 * slack
    if rule == "occlusion":
        return lambda near, own, d, slack: d + 3 * slack <= own
    return lambda near, own, d, slack: near + own - d - max_cos * 2 * np.sqrt(near) * np.sqrt(np.maximum(own, 0)) >= 6 * slack


def _left_over(points: DataFrame, kept: DataFrame, asking: DataFrame, rule: str, max_cos: float, most: int) -> DataFrame:
    """(src, dst, d2): for each of ``asking`` (src, reach) the ``most`` nearest points beyond its reach (d2, dst) that what it has kept may not rule out."""
    vectors = kept.join(asking.select("src"), "src", "left_semi").join(points.select(F.col("id").alias("dst"), "features"), "dst")
    held = vectors.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("d2", "dst", "features"))).alias("k"))
    held = held.select("src", F.col("k.d2").alias("near"), F.flatten("k.features").alias("judges"))
    nodes = points.withColumnRenamed("id", "src").join(asking, "src").join(held, "src")
    n, m = points.count(), asking.count()
    nl, nr = max(min(24, -(-m // 128)), -(-m // 2048)), -(-n // CELL)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    share = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    own = nodes.select(share("src", nl).alias("i"), every(nr).alias("j"), "src", F.col("features").alias("x"), F.col("reach.d2").alias("r"), F.col("reach.dst").alias("last"), "near", "judges")
    all_ = points.select(every(nl).alias("i"), share("id", nr).alias("j"), "id", "features")
    out = _certain(rule, max_cos)

    def run(nodes: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(nodes) and len(points):
            ids, y = points["id"].to_numpy(), np.array(points["features"].tolist(), dtype=np.float64)
            others = Near(y)
        for u, x, r, last, near, judges in zip(*(nodes[c] for c in ("src", "x", "r", "last", "near", "judges"))) if len(points) else ():
            x, w, near = np.asarray(x, dtype=np.float64)[None, :], np.asarray(judges, dtype=np.float64).reshape(len(near), -1), np.asarray(near)
            d, slack = others.to(x)
            alive = np.flatnonzero(~(d[0] < r - 2 * slack))
            alive, at, few, there = alive[ids[alive] != u], 0, 4, others
            while at < len(w) and len(alive):
                e, more = there.to(w[at : at + few])
                e = e[:, alive] if there is others else e
                ruled = out(near[at : at + few, None], d[0][alive], e, max(slack, more)).any(axis=0)
                at, few, alive = at + few, 16, alive[~ruled]
                there = Near(y[alive]) if at < len(w) and len(alive) else there
            exact = pairs_d2(x, y, np.zeros(len(alive), dtype=np.int64), alive)
            beyond = np.isfinite(exact) & ((exact > r) | ((exact == r) & (ids[alive] > last)))
            alive, exact = ids[alive[beyond]], exact[beyond]
            first = np.lexsort((alive, exact))[:most]
            parts.append((np.full(len(first), u), alive[first], exact[first]))
        return pd.DataFrame(dict(zip(("src", "dst", "d2"), (np.concatenate(c) for c in zip(*parts)))))

    found = own.groupBy("i", "j").cogroup(all_.groupBy("i", "j")).applyInPandas(run, "src long, dst long, d2 double")
    return _top(found, "src", most, "dst").drop("rank")


def prune_all(points: DataFrame, rule: str = "occlusion", max_cos: float = 0.5, most: int = ROUND) -> DataFrame:
    """(src, dst, d2): what prune() keeps of all other points of each, without a table of all pairs.

    The fold takes each node's ``most`` nearest others first; what these keep rules out nearly all of the rest, in pairs of blocks by
    matrix products. Of what is left over the nearest are folded next, in as many rounds as it takes, in exact sums.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    points = save(points.select("id", F.col("features").cast("array<double>").alias("features")), "points")
    near, kept = save(knn_graph(points, most).select("src", "dst", "d2"), "near"), None
    while True:
        both = near if kept is None else near.unionByName(kept.join(near.select("src"), "src", "left_semi"))
        now = prune(points, both, rule, max_cos).select("src", "dst", "d2")
        now = save(now if kept is None else now.unionByName(kept.join(near.select("src"), "src", "left_anti")), "kept")
        asking = near.groupBy("src").agg(F.count("*").alias("n"), F.max(F.struct("d2", "dst")).alias("reach"))
        asking = save(asking.where(F.col("n") >= most).select("src", "reach"), "asking")
        release(kept, near)
        kept = now
        if not asking.head(1):
            return kept
        near = save(_left_over(points, kept, asking, rule, max_cos, most), "near")


def moved_edges(points: DataFrame, edges: DataFrame, max_cos: float | None = None, verify: bool = False) -> DataFrame:
    """(src, dst, d2, kept): kept edges u-v, and edges w-v that stand for the others.

    w is the first kept neighbour with d(v, w) <= d(u, v); with ``max_cos`` the first whose
    angle to v at u is too narrow, and with ``verify`` only one to which w-v isn't itself ruled out by u: it is
    shorter than u-w, or the angle to u at w is wide enough. Pairs whose flags are both
    old are passed over, where edges has is_new.
    """
    if max_cos is None:
        drops = lambda near, own, d: d <= own
    else:
        drops = _rule("angle", max_cos)
    finite = lambda a: np.where(np.isfinite(a), a, 0.0)
    if max_cos is None or not verify:
        moves = lambda near, own, d: np.ones(d.shape, dtype=bool)
    else:
        moves = lambda near, own, d: (d < near) | (cosine(finite(near), d, finite(own)) < max_cos)

    def fn(groups: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        block = _Block(groups)
        block.fold(drops, moves)
        parts = []
        for k, g in enumerate(groups):
            n = len(g["dst"])
            kept, by = block.kept[k, :n], block.by[k, :n]
            moved = ~kept & (by >= 0)
            parts.append((g["src"][kept], g["dst"][kept], g["d2"][kept], np.ones(kept.sum(), dtype=bool)))
            parts.append((g["dst"][by[moved]], g["dst"][moved], block.between[k, :n][moved], np.zeros(moved.sum(), dtype=bool)))
        return pd.DataFrame(dict(zip(("src", "dst", "d2", "kept"), (np.concatenate(c) for c in zip(*parts)))))

    return _folded(points, edges, fn, "src long, dst long, d2 double, kept boolean")
