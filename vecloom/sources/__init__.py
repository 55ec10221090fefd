"""Readers and writers: points, results, CSV, flat index files, generators."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def points(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """points(id, features) with doubles, from any table with an id and an array of numbers."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("features"))


def points_from_numpy(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """points of a matrix's rows, ids by position."""
    rows = list(enumerate(np.asarray(matrix, dtype=np.float64).tolist()))
    return spark.createDataFrame(rows, "id long, features array<double>")


def read_points(spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    return points(spark.read.parquet(path), id_col, vec_col)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; name a schema where the file is large, since inferring one reads it twice."""
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_results(spark: SparkSession, path: str, **attributes) -> DataFrame:
    """results(algo, time, run, params, dendrogram) with the given attribute values."""
    out = spark.read.parquet(path)
    for name, value in attributes.items():
        out = out.where(F.col(name) == value)
    return out


def count_files(spark: SparkSession, path: str, pattern: str = "*") -> int:
    """Files below a folder that match; their contents aren't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(path).select("path").count()


def normal_points(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.randn(seed + k) for k in range(dim)]).alias("features"))


def uniform_points(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.rand(seed + k) for k in range(dim)]).alias("features"))


def two_gaussians(spark: SparkSession, n: int, dim: int = 3, gap: float = 5.0, seed: int = 1) -> DataFrame:
    """Even ids around 0, odd ones around ``gap`` in every dimension."""
    shift = F.pmod("id", F.lit(2)) * F.lit(gap)
    return spark.range(n).select("id", F.array(*[F.randn(seed + k) + shift for k in range(dim)]).alias("features"))


def read_flat_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points(id, features), levels(id, level), edges(layer, src, dst, d2)) of flat binary index files.

    The format: a header with little-endian numbers at fixed places (count at 16,
    bytes of an element at 24, degree at 56, bottom degree at 64), from 96 on one
    element per point (bottom links, vector of floats, label), then each point's
    upper links. A file is one task's: the format has no places to split it at.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "id long, features array<double>, level int, links array<struct<layer:int,dst:long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(_elements(raw), columns=["id", "features", "level", "links"])

    from ..operators.graph import with_distance
    from ..session import save

    rows = save(files.mapInPandas(run, schema), "flat")
    pts = rows.select("id", "features")
    links = rows.select(F.col("id").alias("src"), F.explode("links").alias("e")).select("e.layer", "src", "e.dst")
    return pts, rows.select("id", "level"), with_distance(pts, links).select("layer", "src", "dst", "d2")


def _elements(raw: bytes) -> list[tuple]:
    n, size = (struct.unpack_from("<Q", raw, at)[0] for at in (16, 24))
    degree, bottom = (struct.unpack_from("<Q", raw, at)[0] for at in (56, 64))
    base, dim = 96, (size - 8 - (4 * bottom + 4)) // 4
    out = []
    for k in range(n):
        at = base + k * size
        count = struct.unpack_from("<H", raw, at)[0]
        links = [{"layer": 0, "dst": int(x)} for x in np.frombuffer(raw, "<u4", count, at + 4)]
        out.append([k, np.frombuffer(raw, "<f4", dim, at + 4 + 4 * bottom).astype(float).tolist(), 0, links])
    at, step = base + n * size, 4 * degree + 4
    for k in range(n):
        length = struct.unpack_from("<I", raw, at)[0]
        at += 4
        for layer in range(1, length // step + 1):
            count = struct.unpack_from("<H", raw, at)[0]
            out[k][3] += [{"layer": layer, "dst": int(x)} for x in np.frombuffer(raw, "<u4", count, at + 4)]
            at += step
        out[k][2] = length // step
    return [tuple(x) for x in out]


def show_dendrogram(layout: DataFrame, path: str) -> None:
    """Draws a dendrogram's layout to an image file; needs matplotlib."""
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("drawing needs matplotlib") from e
    fig, ax = plt.subplots()
    for r in layout.toPandas().itertuples():
        ax.plot([r.x_left, r.x_left, r.x_right, r.x_right], [r.y_left, r.height, r.height, r.y_right], color="black", linewidth=0.5)
    fig.savefig(path)
    plt.close(fig)
