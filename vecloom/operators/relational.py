"""Sets, duplicates, ranks and bounded heaps as windows and joins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first in order: sort and dedup by key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that first_by_key() removes."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r > 1").drop("_r")


def top_k(df: DataFrame, by: list[str], order: list, k: int, rest: bool = False) -> DataFrame:
    """The k first rows of each group, as a bounded heap holds them; with rest those that it pushes out."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") > k if rest else F.col("_r") <= k).drop("_r")


def _ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows dealt by ranges of the order, in order within each, with the range's number _p."""
    from ..session import save

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    return save(ranged, "ranges")


def _bases(ranged: DataFrame, total: Column) -> DataFrame:
    """(_p, _b): the sum of ``total`` over the ranges before each one; a row a range."""
    sums = ranged.groupBy("_p").agg(total.alias("_t"), F.min("_i").alias("_lo"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_p", F.coalesce(before, F.lit(0)).alias("_b"), "_lo"))


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """0-based ranks over a whole table, in ranges: no task sorts more than its range.

    Rows are dealt by ranges of the order, ranked within, and ranges' sizes summed
    up, which is a row a range.
    """
    ranged = _ranges(df, order)
    return ranged.join(_bases(ranged, F.count("*")), "_p").withColumn(name, F.col("_i") - F.col("_lo") + F.col("_b")).drop("_p", "_i", "_b", "_lo")


def running_sum(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """The sum of ``value`` over all rows up to each one in ``order``, in ranges as by ranked()."""
    ranged = _ranges(df, order)
    within = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn("_s", within).join(_bases(ranged, F.sum(value)), "_p")
    return summed.withColumn(name, F.col("_s") + F.col("_b")).drop("_p", "_i", "_s", "_b", "_lo")


def max_before(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """The largest ``value`` of the rows before each one in ``order`` within its group ``by``, null for the first.

    Rows are dealt by ranges of group and order, so that a group of any size is spread: a range looks back within itself and
    at the maxima of its group's earlier ranges, one row each.
    """
    from ..session import save

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy(*by, "_p").agg(F.max(value).alias("_t"))
    earlier = tops.withColumn("_e", F.max("_t").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    within = F.max(value).over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    held = ranged.withColumn("_w", within)
    same = [held[c].eqNullSafe(earlier[c]) for c in [*by, "_p"]]
    return held.join(earlier, same).select(*[held[c] for c in df.columns], F.greatest("_w", "_e").alias(name))


def permuted(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """Rows with their 0-based places in a seeded permutation of the table."""
    return ranked(df.withColumn("_h", hash_uniform(key, seed)), ["_h", key], name).drop("_h")


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of parameter values."""
    return spark.createDataFrame([dict(zip(values, x)) for x in product(*values.values())])


def in_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows whose parameters are a combination of the grid."""
    return df.join(F.broadcast(grid), grid.columns, "left_semi")


def flatten_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text's fields (a DDL schema, nested ones as structs) as columns next to the others."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_j.*")


def drawn_pairs(points: DataFrame, n_pairs: int, seed: int = 1) -> DataFrame:
    """(u, v): ``n_pairs`` different pairs u < v of the points' ids, drawn by their numbers among all n(n-1)/2 in order.

    One number is drawn from each of ``n_pairs`` equal shares of all numbers and turned into a pair, so that no other pair is
    ever made. Ids are numbered by rank unless they are 0..n-1. More pairs than there are raise a ValueError.
    """
    n, low, high = points.agg(F.count("*"), F.min("id"), F.max("id")).first()
    total = n * (n - 1) // 2
    if n_pairs > total:
        raise ValueError(f"{n} points have {total} pairs, fewer than {n_pairs}")
    wide = total // max(n_pairs, 1)
    number = F.col("id") * F.lit(wide) + F.floor(hash_uniform("id", seed) * wide)
    rows = points.sparkSession.range(n_pairs).select(number.cast("long").alias("c"))
    before = lambda i: i * F.lit(2 * n - 1) - i * i  # noqa: E731 - twice the pairs of smaller first ids
    guess = F.floor((F.lit(2.0 * n - 1) - F.sqrt(F.greatest(F.lit(float(2 * n - 1) ** 2) - 8.0 * F.col("c"), F.lit(0.0)))) / 2).cast("long")
    rows = rows.withColumn("u", F.greatest(guess, F.lit(0)))
    # roots of doubles may be one off
    u = F.col("u") - (before(F.col("u")) > 2 * F.col("c")).cast("long") + (before(F.col("u") + 1) <= 2 * F.col("c")).cast("long")
    rows = rows.withColumn("u", u).select("u", (F.col("c") - F.shiftright(before(F.col("u")), 1) + F.col("u") + 1).alias("v"))
    if n and (low, high) != (0, n - 1):
        ids = ranked(points.select("id"), ["id"], "place")
        to = lambda c: ids.select(F.col("place").alias(c), F.col("id").alias("_" + c))
        rows = rows.join(to("u"), "u").join(to("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    return rows


def sample_pairs(pairs: DataFrame, one_in: int, seed: int = 1) -> DataFrame:
    """All pairs for one_in = 1, else those that a hash of both ids picks: about one in ``one_in``."""
    return pairs if one_in <= 1 else pairs.where(hash_uniform(F.pmod("u", F.lit(1 << 31)) * 31 + F.col("v"), seed) * one_in < 1)
