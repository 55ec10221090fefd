"""Embedding near-dedup by sorted projection passes.

Each pass gives a vector a key: the symbols of several random hashes one after
another, each the index and sign of the largest of a few random projections.
Sorted lexicographically by key, vectors of small angle come close, and every
vector is compared with a bounded window of neighbours. Vectors that share a
key's leading symbols are compared without bound: runs up to the window's length
lie in one window, longer ones are dealt to cells of two blocks. How many symbols
lead grows with the table, so that runs of unlike vectors stay short, and so does the
number of passes. Verified pairs of all passes are united: windows and cells return
counts of links and spanning forests, so a group costs rows and not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ranked
from .common import cells, components, materialize, shuffle_partitions

_BITS = 5  # of a symbol: 16 projections and a sign
_SYMBOLS = 12  # of a key, packed into one long
BLOCK = 1024  # successive rows that one window task walks through, with the window before them


def _projections(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((passes * _SYMBOLS, 1 << (_BITS - 1), dim))


def sort_keys(x: np.ndarray, passes: int, seed: int = 7) -> np.ndarray:
    """One 60-bit key for each row of ``x`` and pass."""
    out = np.zeros((len(x), passes), dtype=np.int64)
    rotations = _projections(x.shape[1], passes, seed)
    for k in range(passes * _SYMBOLS):
        y = x @ rotations[k].T
        best = np.abs(y).argmax(axis=1)
        symbol = 2 * best + (y[np.arange(len(x)), best] > 0)
        out[:, k // _SYMBOLS] = (out[:, k // _SYMBOLS] << _BITS) | symbol
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vector(column: str):
    """True for arrays of finite, non-null numbers that aren't all zero."""
    finite = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda v: v != 0), F.lit(False))


def plan_passes(n: int, window: int = 64) -> tuple[int, int]:
    """(leading symbols, passes) for a table of ``n`` vectors.

    A run of unlike vectors has about n / 32 ** leading rows; leading is the least that
    keeps it below a quarter of the window, 3 at least. Vectors at cosine 0.95 share a symbol
    with probability 0.66 (measured), so that passes many enough leave out 1 in 130.
    """
    leading = 3
    while n > window / 4 * 32**leading and leading < _SYMBOLS:
        leading += 1
    return leading, math.ceil(math.log(0.0077) / math.log(1 - 0.664**leading))


class _Links:
    """Links among rows as counts and a forest: (id, root, n) rows, n links of weight, root the smallest id joined to it."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}
        self.count: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> None:
        ids, inv = np.unique(np.concatenate((a, b)), return_inverse=True)
        sums = np.bincount(inv, weights=np.concatenate((wb, wa)), minlength=len(ids)).astype(np.int64)
        for i, s in zip(ids.tolist(), sums.tolist()):
            self.count[i] = self.count.get(i, 0) + s
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def rows(self) -> tuple[list, list, list]:
        ids = list(self.count)
        return ids, [self.find(i) for i in ids], [self.count[i] for i in ids]


def near_links(reps: DataFrame, threshold: float = 0.95, passes: int | None = None, window: int = 64, leading: int | None = None, block: int = 256) -> DataFrame:
    """(id, other, n): links of rows (id, vec array<double>, n) with cosine >= threshold, as sums.

    ``n`` of a row of the result is the weight (column n of ``reps``) of rows that id links
    with, to be summed by id; id and other are in one component. Each linked pair counts
    once: pairs that share leading symbols in some pass are left to the first such
    pass, where they meet for certain; others may meet in several windows and come as pairs
    that are made distinct. Ids must be unique, vectors valid and distinct. Only vectors of
    equal length are compared. No pair below the threshold counts; the share of pairs above it
    that is found grows with ``passes`` (plan_passes() sets them by the table's size). Windows
    run over the whole sorted table: its blocks begin with the last rows of the block before, so
    the pairs found are the same for any number of partitions. ``window`` is at most BLOCK.
    """
    if window > BLOCK:
        raise ValueError(f"a window has at most {BLOCK} rows, not {window}")
    spark = reps.sparkSession
    parts = shuffle_partitions(spark)
    rule = plan_passes(reps.count(), window)
    leading, passes = leading or rule[0], passes or rule[1]
    mask = _BITS * (_SYMBOLS - leading)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            keys: list = [None] * len(vecs)
            for dim in {len(v) for v in vecs}:
                at = [k for k, v in enumerate(vecs) if len(v) == dim]
                for k, row in zip(at, sort_keys(_unit([vecs[k] for k in at]), passes).tolist()):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=["id", "vec", "n", "keys"])

    table = materialize(reps.select("id", "vec", "n").mapInArrow(keyed, "id long, vec array<double>, n long, keys array<long>"), "keys")
    group = ["dim", "pass", "prefix"]
    slim = table.select(F.size("vec").alias("dim"), "id", F.posexplode("keys").alias("pass", "key")).withColumn("prefix", F.shiftright("key", mask))
    long_runs = materialize(slim.groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > window).drop("rows"), "runs")
    rows = slim.join(long_runs.withColumn("long", F.lit(True)), group, "left")

    def linked(x: np.ndarray, keys: np.ndarray, ids: np.ndarray, y: np.ndarray, ykeys: np.ndarray, yids: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified pairs (rows of x, rows of y) that this pass owns, and whether they share leading symbols in it."""
        i, j = np.nonzero(x @ y.T >= threshold - 1e-12)
        dots = np.einsum("ij,ij->i", x[i], y[j])  # one order of summation wherever a pair is met
        hit = (dots >= threshold) & (ids[i] != yids[j])
        i, j = i[hit], j[hit]
        if not len(i):
            return i, j, np.zeros(0, dtype=bool)
        same = (keys[i] >> mask) == (ykeys[j] >> mask)
        first = np.where(same.any(axis=1), same.argmax(axis=1), passes)
        own = (first == number) | (first == passes)
        return i[own], j[own], first[own] == number

    def result(links: _Links, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, roots, sums = links.rows()
        for a, b in pairs:
            ids, roots, sums = ids + np.minimum(a, b).tolist(), roots + np.maximum(a, b).tolist(), sums + [-1] * len(a)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, roots, sums)], names=["id", "other", "n"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares each row with the ``window`` rows before it, over blocks of successive rows; a block's first rows may be the last of the one before."""
        tail: tuple | None = None
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("part", "id", "dim", "pass", "halo", "vec", "keys", "n")}
            ids, part, halo = col["id"].to_numpy(), col["part"].to_numpy(), col["halo"].to_numpy(zero_copy_only=False)
            place = list(zip(part.tolist(), col["dim"].to_pylist(), col["pass"].to_pylist()))
            vecs, keys, weight = col["vec"].to_pylist(), np.array(col["keys"].to_pylist(), dtype=np.int64).reshape(len(ids), passes), col["n"].to_numpy()
            links, pairs = _Links(), []
            begins = [r for r in range(len(place)) if r == 0 or place[r] != place[r - 1]]
            for start, end in zip(begins, [*begins[1:], len(place)]):
                g, at = place[start], slice(start, end)
                x, k, i, w, h = _unit(vecs[at]), keys[at], ids[at], weight[at], halo[at]
                new = 0
                if tail is not None and tail[0] == g:
                    new = len(tail[3])
                    x, k, i, w, h = (np.concatenate(c) for c in zip(tail[1:], (x, k, i, w, h)))
                for s in range(new, len(i), window):
                    low = max(0, s - window)
                    p, q, sure = linked(x[s : s + window], k[s : s + window], i[s : s + window], x[low : s + window], k[low : s + window], i[low : s + window], g[2])
                    p, q = s + p, low + q
                    near = (p - q <= window) & (q < p) & ~h[p]
                    one = near & sure
                    links.add(i[p[one]], i[q[one]], w[p[one]], w[q[one]])
                    pairs.append((i[p[near & ~sure]], i[q[near & ~sure]]))
                tail = (g, x[-window:], k[-window:], i[-window:], w[-window:], h[-window:])
            yield result(links, pairs)

    # ranks of keys alone; equal keys follow a hash of the vector, so that windows don't depend on how Spark deals rows
    short = ranked(rows.where("long IS NULL").select(*group[:2], "key", "id").join(table.select("id", F.xxhash64("vec").alias("tie")), "id"), ["dim", "pass", "key", "tie", "id"], "rank")
    part = F.floor(F.col("rank") / BLOCK)
    here = F.struct(part.alias("part"), F.lit(False).alias("halo"))
    to = F.when(F.col("rank") % BLOCK < BLOCK - window, F.array(here)).otherwise(F.array(here, F.struct((part + 1).alias("part"), F.lit(True).alias("halo"))))
    dealt = short.select("dim", "pass", "id", "rank", F.explode(to).alias("to")).select("to.part", "to.halo", "dim", "pass", "id", "rank").join(table, "id")
    ordered = dealt.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", "rank")
    found = ordered.select("part", "id", "dim", "pass", "halo", "vec", "keys", "n").mapInArrow(windows, "id long, other long, n long")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """All pairs between two blocks (or within one) of one run."""
        number, low, high = int(pdf["pass"].iat[0]), pdf["i"].iat[0], pdf["j"].iat[0]
        x, keys, ids, w = _unit(pdf["vec"].tolist()), np.array(pdf["keys"].tolist(), dtype=np.int64), pdf["id"].to_numpy(), pdf["n"].to_numpy()
        one = (pdf["own"] == low).to_numpy()
        two = one if low == high else ~one
        p, q, sure = linked(x[one], keys[one], ids[one], x[two], keys[two], ids[two], number)
        once = sure & (ids[one][p] < ids[two][q]) if low == high else sure
        links = _Links()
        links.add(ids[one][p[once]], ids[two][q[once]], w[one][p[once]], w[two][q[once]])
        return pd.DataFrame(dict(zip(("id", "other", "n"), links.rows()))).astype("int64")

    dealt = cells(rows.where("long").drop("long", "key"), group, block).join(table, "id")
    found_in_runs = dealt.groupBy(*group, "i", "j").applyInPandas(compare, "id long, other long, n long")
    both = materialize(found.unionByName(found_in_runs), "links")
    apart = both.where("n < 0").select("id", "other").distinct()
    weight = table.select("id", F.col("n"))
    weighed = apart.join(weight.withColumnRenamed("n", "na"), "id").join(weight.select(F.col("id").alias("other"), F.col("n").alias("nb")), "other")
    ends = F.array(F.struct(F.col("id"), F.col("other"), F.col("nb").alias("n")), F.struct(F.col("other").alias("id"), F.col("id").alias("other"), F.col("na").alias("n")))
    return both.where("n >= 0").unionByName(weighed.select(F.explode(ends).alias("e")).select("e.*"))


def near_dedup(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, **options) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: links of cosine >= threshold in double precision.

    Rows whose vector is null, empty, zero, or holds null or non-finite components
    link with nothing. Equal vectors link with each other and are compared as one;
    they count with their number of rows. Rows that repeat an id are vectors of
    their own. component_id is the smallest id reachable over links; a row without
    id has its component's smallest id too (null if there is none) and isn't kept.
    Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    vec = F.transform(F.col(vec_col), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).withColumn("ok", valid_vector("vec"))
    good, bad = rows.where("ok").drop("ok"), rows.where("NOT ok").select("id")
    reps = good.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    reps = materialize(reps, "vectors")
    links = materialize(near_links(reps.select("id", "vec", "n"), threshold, **options), "sums")
    degrees = links.groupBy("id").agg(F.sum("n").alias("others"))
    linked = components(links.select("id", "other").where("id <> other"))
    known = reps.join(linked, F.col("id") == F.col("node"), "left").select("id", "vec", "n", "least", F.coalesce("component", "id").alias("group"))
    known = known.join(degrees, "id", "left").select("vec", "least", "group", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    smallest = known.groupBy("group").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "group").select("vec", "n_links", "component_id")
    out = good.join(known, "vec").select("id", "n_links", "component_id")
    out = out.unionByName(bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
