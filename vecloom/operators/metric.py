"""Vantage-point trees over points(id, features) and exact neighbours by the triangle inequality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform, l2
from ..session import release, save
from .knn import BLOCK, CELL, CELLS, _closest, _top

LEAF = 512  # points of a leaf
ASKED = CELL  # queries that one task compares with a leaf or a subtree, at most
FEW = 1024  # nodes of a level up to which their table is broadcast
_SLACK = 1e-9  # of the distances compared: sums of squares are rounded


@dataclass
class MetricTree:
    """leaves(id, features, node), vantages(node, vantage) and spans(node, low, high).

    The children of node k are 2k and 2k + 1; the root is 1. A span has the least and largest distance of a node's points
    from its parent's vantage point. Node numbers without vantage point are leaves.
    """

    leaves: DataFrame
    vantages: DataFrame
    spans: DataFrame
    depth: int

    def n_leaves(self) -> int:
        return self.leaves.select("node").distinct().count()


def _small(df: DataFrame) -> DataFrame:
    """A table of a row a node, to be broadcast where it is proven small: then nodes hold many rows and shouldn't gather by key."""
    return F.broadcast(df) if df.count() <= FEW else df


def build_tree(points: DataFrame, leaf: int = LEAF) -> MetricTree:
    """A vantage-point tree, built level by level, with at most ``leaf`` points a leaf.

    Every node with more points takes the one of the smallest hash as its vantage point and cuts the others at their
    median distance from it. Where no cut by distance is left (points that lie equally far, repeated ones above all) a hash of
    ids cuts, so that no leaf outgrows its bound. A level is one pass over the points still in nodes to be cut: ones in
    leaves aren't read again. Ids must be unique; points of an empty table make a tree without leaves.
    """
    if leaf < 1:
        raise ValueError("a leaf has at least one point")
    rows = save(points.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"), F.lit(1).cast("long").alias("node")), "tree")
    leaves, vantages, spans, level = [], [], [], 0
    while True:
        order = F.struct(hash_uniform("id", 29 + level), F.col("id"))
        chosen = save(rows.groupBy("node").agg(F.count("*").alias("n"), F.min_by("features", order).alias("vantage")).where(F.col("n") > leaf).select("node", "vantage"), "vantages")
        if not chosen.head(1):
            leaves.append(rows)
            break
        measured = save(rows.join(_small(chosen), "node", "left").select("id", "features", "node", l2("features", "vantage").alias("d")), "measured")
        cut = save(measured.where("d IS NOT NULL").groupBy("node").agg(F.percentile_approx("d", 0.5).alias("cut"), F.max("d").alias("top")), "cuts")
        side = F.when(F.col("cut") < F.col("top"), F.col("d") > F.col("cut")).otherwise(hash_uniform("id", 31 + level) > 0.5)
        parted = measured.where("d IS NOT NULL").join(_small(cut), "node").select("id", "features", (2 * F.col("node") + side.cast("long")).alias("node"), "d")
        leaves.append(measured.where("d IS NULL").select("id", "features", "node"))
        vantages.append(chosen)
        release(rows)
        below = save(parted, "tree")
        spans.append(save(below.groupBy("node").agg(F.min("d").alias("low"), F.max("d").alias("high")), "spans"))
        rows, level = below.drop("d"), level + 1
    spark = points.sparkSession
    empty = (spark.createDataFrame([], "node long, vantage array<double>"), spark.createDataFrame([], "node long, low double, high double"))
    return MetricTree(save(_union(leaves), "leaves"), save(_union(vantages or [empty[0]]), "vantages"), save(_union(spans or [empty[1]]), "spans"), level)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _at_level(df: DataFrame, level: int) -> DataFrame:
    return df.where(F.col("node").between(1 << level, (2 << level) - 1))


def _children(tree: MetricTree, asked: DataFrame, at: DataFrame, level: int) -> DataFrame:
    """(qid, node, d, low, high): for each pair (qid, node) of a node of the level with vantage point its children, with the query's distance from that point."""
    far = at.join(asked.select("qid", "features"), "qid").join(_small(_at_level(tree.vantages, level)), "node").select("qid", "node", l2("features", "vantage").alias("d"))
    both = far.select("qid", "d", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
    return both.join(_small(_at_level(tree.spans, level + 1)), "node").select("qid", "node", "d", "low", "high")


def _outside(d: Column, low: Column, high: Column) -> Column:
    """How far a query at distance d from a vantage point lies from all points at distances low to high, at least."""
    return F.greatest(low - d, d - high, F.lit(0.0))


def _own_leaves(tree: MetricTree, asked: DataFrame) -> DataFrame:
    """(qid, node): the leaf each query comes to when it takes the nearer child everywhere."""
    at, ended = asked.select("qid", F.lit(1).cast("long").alias("node")), []
    first = Window.partitionBy("qid").orderBy(_outside(F.col("d"), F.col("low"), F.col("high")), "node")
    for level in range(tree.depth):
        ended.append(at.join(tree.vantages.select("node"), "node", "left_anti").select("qid", "node"))
        at = save(_children(tree, asked, at, level).withColumn("r", F.row_number().over(first)).where("r = 1").select("qid", "node"), "own")
    return _union([*ended, at])


def _compared(tree: MetricTree, asked: DataFrame, visits: DataFrame, k: int, level: int | None = None) -> DataFrame:
    """(qid, id, d2): of each visit (qid, node) the k nearest points below the node, a leaf or a node of ``level``.

    A node's queries are dealt to shares as large as a block of cells, each with all the node's points.
    """
    size = min(ASKED, max(BLOCK, -(-asked.count() // CELLS)))
    shares = visits.groupBy("node").agg(F.ceil(F.count("*") / size).cast("int").alias("shares"))
    shares = save(shares, "shares")
    wanted = visits.join(_small(shares), "node").join(asked.select("qid", "features"), "qid").select("node", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int").alias("share"), "qid", "features")
    leaves = tree.leaves
    if level is not None:
        below = F.length(F.bin("node")) - 1 - level  # levels
        leaves = leaves.withColumn("_b", below).withColumn("node", F.expr("IF(_b > 0, shiftright(node, _b), node)")).drop("_b")
    held = leaves.join(_small(shares), "node").select("node", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "id", "features")

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"qid": [], "id": [], "d2": []}).astype({"qid": "int64", "id": "int64"})
        x, y = (np.array(pdf["features"].tolist(), dtype=np.float64) for pdf in (queries, points))
        return pd.DataFrame(dict(zip(("qid", "id", "d2"), _closest(queries["qid"].to_numpy(), x, points["id"].to_numpy(), y, k))))

    return wanted.groupBy("node", "share").cogroup(held.groupBy("node", "share")).applyInPandas(run, "qid long, id long, d2 double")


def _asked(queries: DataFrame) -> DataFrame:
    return save(queries.select(F.col("qid").cast("long").alias("qid"), F.col("features").cast("array<double>").alias("features")), "asked")


def leaf_visits(tree: MetricTree, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, node): the leaves that may hold one of a query's k nearest points; all others are ruled out by the triangle inequality.

    A query's bound is the distance of the k-th nearest point of its own leaf; a leaf with fewer points bounds nothing. From
    the root down a child is entered unless its span lies farther from the query than the bound.
    """
    return _visits(tree, _asked(queries), k, tree.depth)


def _visits(tree: MetricTree, asked: DataFrame, k: int, depth: int) -> DataFrame:
    """(qid, node): what leaf_visits() enters down to level ``depth``: nodes of that level, and leaves above it."""
    near = _compared(tree, asked, _own_leaves(tree, asked), k)
    bound = save(near.groupBy("qid").agg(F.when(F.count("*") >= k, F.sqrt(F.max("d2"))).alias("bound")), "bounds")
    at, ended = asked.select("qid", F.lit(1).cast("long").alias("node")), []
    for level in range(depth):
        ended.append(at.join(tree.vantages.select("node"), "node", "left_anti").select("qid", "node"))
        slack = F.lit(_SLACK) * (F.col("d") + F.col("high") + F.col("bound"))
        entered = F.col("bound").isNull() | (_outside(F.col("d"), F.col("low"), F.col("high")) <= F.col("bound") + slack)
        at = save(_children(tree, asked, at, level).join(bound, "qid").where(entered).select("qid", "node"), "visits")
    return _union([*ended, at])


def tree_knn(tree: MetricTree, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, d2, rank): the k nearest points of each query (qid, features) with a unique qid, ties by id: exact.

    Subtrees of about as many points as a block of cells aren't descended any further: a query that enters one is compared with all its
    points by matrix products. In many dimensions, where nearly all leaves would be visited, a row for each query and leaf
    would cost more.
    """
    asked, n = _asked(queries), tree.leaves.count()
    size = min(CELL, max(BLOCK, -(-n // CELLS)))
    level = min(tree.depth, max(0, (-(-n // size) - 1).bit_length()))
    return _top(_compared(tree, asked, save(_visits(tree, asked, k, level), "visits"), k, level), "qid", k, "id")
