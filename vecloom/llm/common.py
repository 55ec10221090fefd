"""Helpers shared by the corpus operators: shared scratch tables, ranges, cells of blocks, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, release, save, scratch_path, shared_dir

materialize = save

__all__ = ["cells", "components", "delete_path", "materialize", "range_starts", "release", "scratch_path", "shared_dir", "shuffle_partitions"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list by alternating star contractions.

    ``edges`` has two columns of one comparable type. Returns (node, component)
    for every node that has an edge to another node; component is the smallest
    node reachable. Self loops are ignored, repeated edges count once. Every
    round is a fixed number of equi-joins and aggregations whose joined sides AQE
    may split, so that a node with very many edges doesn't gather in one task; the
    edge list is rewritten each round to the shared folder and never exceeds the
    number of edges plus nodes. Rounds grow with the logarithm of the longest path;
    they go on until the edge list stays, which is when every tree is a star.
    """
    a, b = edges.columns
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur, old, seen = materialize(cur, "edges"), None, None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        old, cur = cur, materialize(small, "edges")
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(old)
        if state == seen:
            break
        seen = state
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def range_starts(df: DataFrame, key: Column) -> list:
    """Ascending keys that cut a table into ranges of like size: the smallest key of each.

    Spark deals the keys alone to ranges; one key a range reaches the driver. Null
    keys aren't looked at. The starts decide only where ranges begin, never which rows are used.
    """
    keys = df.select(key.alias("k")).where("k IS NOT NULL").repartitionByRange(shuffle_partitions(df.sparkSession), "k")
    return sorted({r.low for r in keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low")).collect()})


def cells(rows: DataFrame, keys: list[str], block: int, id_col: str = "id", least: int = 2) -> DataFrame:
    """Rows of groups of ``least`` or more, dealt to pairs of blocks: columns i, j and own are added.

    A group's rows are cut by a hash of ``id_col`` into blocks of about ``block``; cell
    (i, j), i <= j, gets the rows with own = i or own = j. Each pair of a group's
    rows meets in exactly one cell, and no cell grows with its group.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    sizes = sizes.select(*keys, F.ceil(F.col("_n") / block).cast("int").alias("_shares"))
    dealt = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64(id_col, F.lit(17)), F.col("_shares")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("_shares") - 1), lambda x: F.struct(F.least(F.col("own"), x).alias("i"), F.greatest(F.col("own"), x).alias("j")))
    return dealt.withColumn("_cell", F.explode(both)).select(*rows.columns, "_cell.i", "_cell.j", "own")
