"""All pairs, nearest neighbours and queries over points(id, features)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_d2, near_tiles, np_uniform, pairs_d2, row_d2
from ..session import save

BLOCK = 1024  # points of a tile: functions of pairs see two
CELL = 16_384  # points of a block at most; a task holds two
CELLS = 24  # blocks that a table is cut into, unless they would outgrow CELL or be smaller than BLOCK
BUCKET, PASSES = 512, 12  # points of a bucket, and passes


def _cells(left: DataFrame, right: DataFrame | None, fn: Callable, schema: str, block: int | None = None, whole: bool = False) -> DataFrame:
    """Applies fn(ids, x, ids, y, same) to each pair of blocks; with right=None to pairs of blocks of left.

    Blocks are equal shares by hash, so tasks are alike whatever the data. Every
    point goes to one cell per block of the other side: the work of comparing all
    pairs is quadratic, but no task grows with the input. What is shuffled is the table times the number of blocks, so
    these are large; within a cell fn gets pairs of tiles of BLOCK points, one after the other, or with ``whole`` all of it.
    """
    def blocks(df: DataFrame) -> int:  # a few at least, so that small tables are work for several tasks
        n = df.count()
        size = block or min(CELL, max(BLOCK, math.ceil(n / CELLS)))
        return max(1, math.ceil(n / size), min(8, math.ceil(n / 128)))

    nl = blocks(left)
    nr = nl if right is None else blocks(right)
    if right is None:
        own = F.pmod(F.xxhash64("id"), F.lit(nl)).cast("int")
        both = left.withColumn("own", own).withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(nl - 1)), lambda k: F.struct(F.least(F.col("own"), k).alias("i"), F.greatest(F.col("own"), k).alias("j")))))
        rows = both.select("cell.i", "cell.j", (F.col("own") == F.col("cell.i")).alias("first"), "id", "features")
    else:
        a = left.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(nl)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nr - 1)))).withColumn("first", F.lit(True))
        b = right.withColumn("j", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).withColumn("first", F.lit(False))
        cols = ["i", "j", "first", "id", "features"]
        rows = a.select(*cols).unionByName(b.select(*cols))
    inner = right is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        first, ids, at = (np.concatenate([pdf[c].to_numpy() for pdf in held]) for c in ("first", "id", "i"))
        same = inner and at[0] == held[0]["j"].iat[0]
        x = np.concatenate([np.array(pdf["features"].tolist(), dtype=np.float64).reshape(len(pdf), -1) for pdf in held])
        held.clear()
        order = np.argsort(ids, kind="stable")
        first, ids, x = first[order], ids[order], x[order]
        other = first if same else ~first
        if not first.any() or not other.any():
            yield pd.DataFrame(fn(ids[:0], x[:0], ids[:0], x[:0], same))
            return
        a, x, b, y = ids[first], x[first], ids[other], x[other]
        step = max(len(a), len(b)) if whole else BLOCK
        for p in range(0, len(a), step):
            for q in range(p if same else 0, len(b), step):
                yield pd.DataFrame(fn(a[p : p + step], x[p : p + step], b[q : q + step], y[q : q + step], same and p == q))

    return rows.groupBy("i", "j").applyInPandas(run, schema)


def all_pairs(points: DataFrame, block: int | None = None) -> DataFrame:
    """(u, v, d2) for every u < v: the theta self-join, by blocks."""

    def fn(a, x, b, y, same):
        d = block_d2(x, y) if len(a) else np.zeros((0, 0))
        i, j = np.nonzero(a[:, None] < b[None, :] if same else a[:, None] != b[None, :]) if len(a) else (np.zeros(0, int),) * 2
        return {"u": np.minimum(a[i], b[j]), "v": np.maximum(a[i], b[j]), "d2": d[i, j]}

    return _cells(points, None, fn, "u long, v long, d2 double", block)


def sampled_pairs(points: DataFrame, one_in: int, seed: int = 1, block: int | None = None) -> DataFrame:
    """(u, v, d2) for those u < v that a hash of both ids picks, about one in ``one_in``: only their distances are measured."""

    def fn(a, x, b, y, same):
        if not len(a):
            return {"u": a, "v": b, "d2": np.zeros(0)}
        u, v = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
        i, j = np.nonzero((np_uniform((u & (1 << 31) - 1) * 31 + v, seed) * one_in < 1) & (a[:, None] < b[None, :] if same else a[:, None] != b[None, :]))
        return {"u": u[i, j], "v": v[i, j], "d2": row_d2(x[i], y[j])}

    return _cells(points, None, fn, "u long, v long, d2 double", block)


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the k columns of smallest (d, id) that are finite: (row, column)."""
    if not d.size:
        return (np.zeros(0, dtype=np.int64),) * 2
    last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
    rows, cols = np.nonzero((d <= last[:, None]) & np.isfinite(d))
    order = np.lexsort((ids[cols], d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


def _closest(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, k: int, others: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of a, of b, d2): for each row of x the k rows of y of smallest (d2, id), with finite d2; with ``others`` not of its own id.

    A matrix product leaves those that can be among them, which are measured exactly.
    """
    out = [(a[:0], b[:0], np.zeros(0))]
    some = max(BLOCK, 8 * k)
    for at, d, slack in near_tiles(x, y):
        if others:
            d[a[at : at + len(d), None] == b[None, :]] = np.inf
        few = min(k, len(b), some) - 1
        last = np.partition(d[:, :some], few, axis=1)[:, few]
        last = np.where(np.isnan(last), np.inf, last)[:, None] + 2 * slack
        i, j = np.divmod(np.flatnonzero((d <= last) & (d < np.inf) if np.isinf(last).any() else d <= last), len(b))
        exact = pairs_d2(x, y, i + at, j)
        ok = np.isfinite(exact)
        i, j, exact = i[ok], j[ok], exact[ok]
        order = np.lexsort((b[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((a[at + i[keep]], b[j[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _top(df: DataFrame, by: str, k: int, other: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy("d2", other))
    return df.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def knn_graph(points: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(src, dst, d2, rank) of each point's k nearest others, ties by id: exact.

    Each pair of blocks keeps k candidates a point, so what is shuffled grows with
    points times blocks, not with pairs.
    """

    def fn(a, x, b, y, same):
        out = [_closest(a, x, b, y, k, same)]
        if not same:
            out.append(_closest(b, y, a, x, k))
        return {n: np.concatenate([o[m] for o in out]) for m, n in enumerate(("src", "dst", "d2"))}

    return _top(_cells(points, None, fn, "src long, dst long, d2 double", block, whole=True), "src", k, "dst")


def knn_query(points: DataFrame, queries: DataFrame, k: int = 10, block: int | None = None) -> DataFrame:
    """(qid, id, d2, rank): the k nearest points of each query (qid, features), exact."""

    def fn(a, x, b, y, same):
        return dict(zip(("qid", "id", "d2"), _closest(a, x, b, y, k)))

    return _top(_cells(queries.withColumnRenamed("qid", "id"), points, fn, "qid long, id long, d2 double", block, whole=True), "qid", k, "id")


def knn_graph_bucketed(points: DataFrame, k: int = 10, passes: int = PASSES, bits: int | None = None, seed: int = 3, block: int = BUCKET) -> DataFrame:
    """(src, dst, d2, rank) from random hyperplane buckets, exactly ranked: approximate, near-linear work.

    Hyperplanes go through the points' mean. Their number ``bits`` grows with the table
    so that a bucket of evenly spread points holds about ``block`` of them. Without hyperplanes, of up to ``block`` points, there is
    one bucket of all and the result is exact. Buckets above CELL points are cut by hash into shares that are
    compared pair by pair, so that no task gets a bucket of unbounded size and no pair of a bucket is
    left out; however small ``block`` is, points are copied once for each CELL of their bucket only. Each bucket keeps k candidates a point.
    """
    n = points.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / block))) if bits is None else bits
    if bits == 0:
        return knn_graph(points, k)
    dim = len(points.select("features").head(1)[0][0])
    mean = np.array(points.select([F.avg(F.col("features")[i]).alias(f"m{i}") for i in range(dim)]).first(), dtype=np.float64)
    planes = np.random.default_rng(seed).standard_normal((passes * max(bits, 1), dim))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - mean
            sides = (x @ planes.T >= 0).reshape(len(x), passes, -1)[:, :, :bits]
            codes = (sides * powers).sum(axis=2) + (np.arange(passes, dtype=np.int64) << 40)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(codes), pa.list_(pa.int64()))], names=["id", "features", "codes"])

    table = save(points.select("id", "features").mapInArrow(coded, "id long, features array<double>, codes array<long>"), "codes")
    rows = table.select("id", "features", F.explode("codes").alias("code"))
    sizes = rows.groupBy("code").agg(F.ceil(F.count("*") / CELL).cast("int").alias("shares"))
    rows = rows.join(sizes, "code").withColumn("own", F.pmod(F.xxhash64("id", "code"), F.col("shares")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("shares") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    rows = rows.withColumn("cell", F.explode(cells)).select("code", "cell.i", "cell.j", "own", "id", "features")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x, own = pdf["id"].to_numpy(), np.array(pdf["features"].tolist(), dtype=np.float64), pdf["own"].to_numpy() == pdf["i"].iat[0]
        if pdf["i"].iat[0] == pdf["j"].iat[0]:
            out = [_closest(ids, x, ids, x, k, True)]
        else:  # pairs within a share are another cell's
            out = [_closest(ids[own], x[own], ids[~own], x[~own], k), _closest(ids[~own], x[~own], ids[own], x[own], k)]
        return pd.DataFrame(dict(zip(("src", "dst", "d2"), (np.concatenate(c) for c in zip(*out)))))

    found = rows.groupBy("code", "i", "j").applyInPandas(run, "src long, dst long, d2 double").where("src <> dst")
    return _top(found.groupBy("src", "dst").agg(F.min("d2").alias("d2")), "src", k, "dst")


def knn_local_join(points: DataFrame, edges: DataFrame, k: int = 10, most: int | None = None) -> DataFrame:
    """(src, dst, d2, rank): each point's neighbours among its neighbours and theirs, ranked anew.

    A point is joined with the ``most`` (2k) nearest of those it points to or that point to
    it, so that a hub costs no more than others; with those it meets what any of them
    points to itself, of which there are k.
    """
    from .graph import cap_degree, with_distance

    e = edges.select("src", "dst", "d2")
    both = cap_degree(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")).distinct(), most or 2 * k).select("src", "dst")
    near = cap_degree(e.distinct(), most or 2 * k).select("src", "dst")
    hop = both.alias("a").join(near.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _top(with_distance(points, near.unionByName(back).unionByName(hop).where("src <> dst").distinct()), "src", k, "dst")


def recall(found: DataFrame, truth: DataFrame, keys: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """One row (hits, wanted, recall): share of true neighbours that were found."""
    hits = truth.select(*keys).join(found.select(*keys).distinct(), list(keys), "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(truth.agg(F.count("*").alias("wanted"))).withColumn("recall", F.col("hits") / F.col("wanted"))
