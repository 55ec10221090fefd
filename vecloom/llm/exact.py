"""Exact duplicates by two passes of a Bloom filter.

Texts are equal if they are the same once ASCII white space is deleted. The first pass
counts, for each bit of a Bloom filter, whether two rows or more set it: tasks send
the bits that their own rows set, and a segment of the filter is merged by one task.
The second pass tests each row: one of whose bits some is set by that row alone has a
text of its own and passes straight through; only rows that may be repeated are
shuffled, and are then compared by SHA-256.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import materialize

WHITE = "\t\n\x0b\x0c\r "
SEGMENT = 20  # a segment of the filter has 2**SEGMENT bits
_TESTS = 4  # bits a row sets
_BLOCK = 1 << 18  # rows whose bits a task sends at a time

SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
g AS (SELECT doc_id, bare, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(raw) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM g"""


def normalised(text: Column) -> Column:
    """The text without ASCII white space, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _places(h: np.ndarray, segments: int) -> np.ndarray:
    """Bits of the filter for each hash: _TESTS different ones within one segment."""
    x = hashing.mix(h.view(np.uint64), 13)
    low = np.uint64((1 << SEGMENT) - 1)
    first, step = x & low, (x >> np.uint64(SEGMENT)) & low | np.uint64(1)
    at = (first[:, None] + step[:, None] * np.arange(_TESTS, dtype=np.uint64)) & low
    return ((x >> np.uint64(2 * SEGMENT)) % np.uint64(segments) << np.uint64(SEGMENT))[:, None] | at


def repeated_bits(hashes: DataFrame, segments: int) -> np.ndarray:
    """The filter's bits that two rows or more of ``hashes`` (h long) set, packed: 2**SEGMENT / 8 bytes a segment.

    A task sends a row for each segment and block of rows; the task that merges a segment
    holds 2**SEGMENT counters. Copies of one text within a block send their bits once, however many there are.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            bits, counts = np.unique(_places(np.concatenate(held), segments).ravel(), return_counts=True)
            seg = (bits >> np.uint64(SEGMENT)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            low = (bits & np.uint64((1 << SEGMENT) - 1)).astype("<u4")
            cuts = [*starts.tolist(), len(bits)]
            spans = list(zip(cuts, cuts[1:]))
            once = [low[a:b].tobytes() for a, b in spans]
            more = [low[a:b][counts[a:b] > 1].tobytes() for a, b in spans]
            return pa.RecordBatch.from_arrays([pa.array(seg[starts]), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["seg", "once", "more"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False))
                n += batch.num_rows
            if n >= _BLOCK:
                yield sent()
                held, n = [], 0
        if held:
            yield sent()

    def merge(table: pa.Table) -> pa.Table:
        seen = np.zeros(1 << SEGMENT, dtype=np.uint8)
        for once, more in zip(table.column("once"), table.column("more")):
            at = np.frombuffer(once.as_py(), dtype="<u4")
            seen[at] = np.minimum(seen[at] + 1, 2)
            seen[np.frombuffer(more.as_py(), dtype="<u4")] = 2
        return pa.table({"seg": table.column("seg")[:1].cast(pa.int64()), "bits": pa.array([np.packbits(seen == 2).tobytes()], pa.binary())})

    merged = hashes.select("h").mapInArrow(send, "seg long, once binary, more binary").groupBy("seg").applyInArrow(merge, "seg long, bits binary")
    out = np.zeros((segments, (1 << SEGMENT) // 8), dtype=np.uint8)
    for seg, bits in merged.toLocalIterator():
        out[seg] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def _tester(held: Broadcast, segments: int) -> Callable[[str], Column]:
    def test(h: pd.Series) -> pd.Series:
        at = _places(h.to_numpy(dtype=np.int64), segments)
        bits = held.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return pd.Series(bits.all(axis=1))

    return F.pandas_udf(test, "boolean")


def flagged(rows: DataFrame, bits_per_row: int = 16, most_bits: int = 1 << 29) -> DataFrame:
    """``rows``, which have a column h (long), with a boolean ``maybe``: false if no other row has the same h.

    True for every row whose h is repeated, and for about one in 400 of the others. The
    filter has 16 bits a row. What tasks get of it is at most ``most_bits`` (64 MB): larger
    tables are taken in sweeps, each with the rows of a share of the hashes and a filter of its own, at the cost
    of reading ``rows`` once a sweep. Without rows nothing is flagged.
    """
    spark = rows.sparkSession
    n = rows.count()
    sweeps = max(1, math.ceil(n * bits_per_row / most_bits))
    segments = max(1, math.ceil(n * bits_per_row / sweeps / (1 << SEGMENT)))
    out = None
    for s in range(sweeps):
        part = rows if sweeps == 1 else rows.where(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(sweeps)) == s)
        held = spark.sparkContext.broadcast(repeated_bits(part, segments))

        tested = part.withColumn("maybe", _tester(held, segments)("h"))
        out = tested if out is None else out.unionByName(tested)
    return out


def _order(n_chars: str, id_: str) -> list[Column]:
    """The row that stays is least in this: most code points, then smallest id, null last."""
    return [(-F.col(n_chars)).alias("less"), F.col(id_).isNull().alias("no_id"), F.col(id_).alias("id")]


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_args: int) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of ``df``.

    Texts are equal if they are the same without ASCII white space; null is empty, and texts of
    white space only are equal to it. Of equal texts the one with the most code points stays, then that with the
    smallest id (null after all others); of rows that repeat an id and a text one stays.
    keep_id is null where the row that stays has no id. Groups are first aggregated in every task; rows of a
    repeated text join their group's row in a join whose large partitions Spark splits. Other columns aren't read, whatever
    their names. Texts of any length take a digest each. An empty table gives no rows.
    """
    bare = F.sha2(normalised(F.col(text_col)), 256)
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.unhex(bare).alias("digest"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "digests")
    tested = materialize(flagged(slim.withColumn("h", F.xxhash64("digest")), **filter_args).drop("h"), "tested")
    suspects = tested.where("maybe").drop("maybe")
    rank = F.struct(*_order("n_chars", "id"), "row")
    groups = suspects.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(rank).alias("first")).where("group_size > 1")
    groups = materialize(groups.select("digest", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    met = suspects.join(groups, "digest", "left")
    same = met.select("id", F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"), "digest")
    alone = tested.where("NOT maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    both = alone.unionByName(same)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **filter_args: int) -> DataFrame:
    """Rows of ``df`` less exact duplicates; see report() for which row of a group stays.

    Rows whose text is their own keep their place in their partition; of the others each task
    keeps the best of a text before they are shuffled. Columns stay as they are, whatever their names.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    tested = flagged(rows.withColumn("h", F.xxhash64("digest")), **filter_args)
    best = tested.where("maybe").groupBy("digest").agg(F.min_by("row", F.struct(*_order("n_chars", "id"))).alias("row")).select("row")
    return tested.where("NOT maybe").select("row").unionByName(best).select("row.*")
