"""Document fingerprints: weighted SimHash and its permuted block tables.

Term hashes vote, with their weights, on the signed bits of a 128-bit
fingerprint. To find all fingerprints within a Hamming radius r, the bits are cut
into r + k blocks; for each choice of k blocks a table is sorted by those blocks
first (a permutation of the bits), and since at most r blocks can differ, some
table has both fingerprints under the same leading blocks. The rows under equal
leading blocks are dealt to cells of two blocks of rows, so none grows with its group.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cells, materialize, range_starts

WORDS = 2  # 64-bit words of a fingerprint
_SHINGLE = 2


def fingerprint(data: bytes) -> tuple[int, ...]:
    """128 bits: each distinct word pair of the lower-cased (A-Z) text votes with weight 1 + ln(count)."""
    terms, counts = np.unique(hashing.shingle_hashes(hashing.word_hashes(data.lower()), _SHINGLE), return_counts=True)
    return tuple(hashing.vote([terms], WORDS, 1 + np.log(counts)))


def hex_of(fp: tuple[int, ...]) -> str:
    return "".join(f"{x:016x}" for x in fp)


def likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Estimated cosine of two texts' weighted terms, 0 for an angle of 90 degrees or more, 1 for equal fingerprints."""
    apart = sum((x ^ y).bit_count() for x, y in zip(a, b))
    return max(0.0, float(np.cos(np.pi * apart / (64 * WORDS))))


def _tables(distinct: DataFrame, radius: int, leading: int) -> tuple[DataFrame, list[tuple[int, ...]], np.ndarray]:
    """Rows of every permuted table (choice, key, ...), the choices of leading blocks, and the bits of each block."""
    n = radius + leading
    at = [64 * WORDS * k // n for k in range(n + 1)]
    choices = list(combinations(range(n), leading))
    bits = F.concat(*[F.lpad(F.bin(F.col("fp")[k]), 64, "0") for k in range(WORDS)])
    key = lambda choice: F.xxhash64(*[F.substring("_bits", at[c] + 1, at[c + 1] - at[c]) for c in choice])
    keyed = F.array(*[F.struct(F.lit(k).alias("choice"), key(c).alias("key")) for k, c in enumerate(choices)])
    table = distinct.withColumn("_bits", bits).withColumn("_e", F.explode(keyed)).select(*distinct.columns, "_e.choice", "_e.key")
    # the words' bits of each block, to compare blocks without strings
    masks = np.zeros((n, WORDS), dtype=np.uint64)
    for block in range(n):
        for bit in range(at[block], at[block + 1]):
            masks[block, bit // 64] |= np.uint64(1) << np.uint64(63 - bit % 64)
    return table, choices, masks


def _near(pdf: pd.DataFrame, radius: int, choices: list[tuple[int, ...]], masks: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """A cell's rows and the positions of its pairs within the radius that no earlier table has under equal leading blocks."""
    choice, low, high = int(pdf["choice"].iat[0]), pdf["i"].iat[0], pdf["j"].iat[0]
    pdf = pdf.sort_values("id", kind="stable")
    own, fp = pdf["own"].to_numpy(), np.array(pdf["fp"].tolist(), dtype=np.int64).view(np.uint64)
    apart = sum(np.bitwise_count(fp[:, None, w] ^ fp[None, :, w]).astype(np.int64) for w in range(WORDS))
    allowed = np.triu(np.ones(apart.shape, dtype=bool), 1) & ((own[:, None] != own[None, :]) if low != high else True)
    p, q = np.nonzero(allowed & (apart <= radius))
    diff = fp[p] ^ fp[q]
    equal = ~((diff[:, None, :] & masks[None, :, :]) != 0).any(axis=2)
    earlier = np.zeros(len(p), dtype=bool)
    for c in choices[:choice]:
        earlier |= equal[:, list(c)].all(axis=1)
    mine = equal[:, list(choices[choice])].all(axis=1) & ~earlier
    return pdf, p[mine], q[mine]


def permuted_table_links(fps: DataFrame, radius: int = 3, leading: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of rows of (id, fp) at most ``radius`` bits apart: all of them.

    ``radius + leading`` blocks give C(radius + leading, leading) tables. Equal
    fingerprints are one table row, represented by their smallest id (pairs between
    representatives plus membership by fp stand for all pairs). Rows without id are
    left out.
    """
    distinct = fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"))
    table, choices, masks = _tables(distinct, radius, leading)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, q = _near(pdf, radius, choices, masks)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[p], "b": ids[q]})

    return cells(table, ["choice", "key"], 512).groupBy("choice", "key", "i", "j").applyInPandas(pairs, "a long, b long")


def within_radius(fps: DataFrame, radius: int = 3, leading: int = 1) -> DataFrame:
    """(fp, n_within, first_within) of each distinct fingerprint of rows (id, fp): how many rows lie within the radius, and their smallest id.

    Its own rows count. Rows under equal leading blocks (32 bits and up with one leading
    block of 128 / 4) are compared in cells that return sums, so nothing grows with pairs.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    table, choices, masks = _tables(distinct, radius, leading)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, q = _near(pdf, radius, choices, masks)
        if not len(p):
            return pd.DataFrame({"id": [], "n": [], "first": []}, dtype="int64")
        ids, n, first = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["first"].astype("float64").to_numpy()
        exact = pdf["first"].fillna(0).astype("int64").to_numpy()
        order = np.where(np.isnan(first), np.iinfo(np.int64).max, exact)
        count, least = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), np.iinfo(np.int64).max)
        for x, y in ((p, q), (q, p)):
            np.add.at(count, x, n[y])
            np.minimum.at(least, x, order[y])
        hit = count > 0
        firsts = pd.Series(least[hit], dtype="Int64").mask(least[hit] == np.iinfo(np.int64).max)
        return pd.DataFrame({"id": ids[hit], "n": count[hit], "first": firsts})

    found = cells(table, ["choice", "key"], 512).groupBy("choice", "key", "i", "j").applyInPandas(sums, "id long, n long, first long")
    others = found.groupBy("id").agg(F.sum("n").alias("_n"), F.min("first").alias("_first"))
    joined = distinct.join(others, "id", "left")
    return joined.select("fp", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n_within"), F.least("first", "_first").alias("first_within"))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, id, halo, text, fp): rows dealt to ranges of ascending id, each range with the first row of the next one.

    The ranges' first ids (one number each) pass the driver; a task finds a row's range
    by bisection. Text is shuffled once. A range ends with its halo row, except
    that the last range's halo is the first row of all. Rows without id come first.
    """
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    starts = range_starts(slim, F.col("id"))
    nulls = bool(slim.where("id IS NULL").head(1))
    # ranges 0..k-1 begin at starts; rows without id, if any, stand before range 0's first one
    begins = {s: k for k, s in enumerate(starts)}
    last, first = max(len(starts) - 1, 0), None if nulls or not starts else starts[0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, halo, take, fps = [], [], [], []
            for k, (i, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                at = 0 if i is None else max(bisect.bisect_right(starts, i) - 1, 0)
                to = [(at, False)]
                if i == first:
                    to.append((last, True))  # the first document follows the last
                if i is not None and begins.get(i, 0) > 0:
                    to.append((begins[i] - 1, True))
                fp = [hashing.signed(x) for x in fingerprint(data.as_py())]
                for p, h in to:
                    part.append(p)
                    halo.append(h)
                    take.append(k)
                    fps.append(fp)
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), rows.column(0), pa.array(halo, pa.bool_()), rows.column(1), pa.array(fps, pa.list_(pa.int64()))], names=["part", "id", "halo", "text", "fp"])

    dealt = slim.mapInArrow(deal, "part int, id long, halo boolean, text binary, fp array<long>")
    return dealt.repartitionById(last + 1, "part").sortWithinPartitions("part", "halo", F.col("id").asc_nulls_first(), "text")


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, one row per row.

    The edited text replaces the last floor(n/2) code points by the first as many
    (or all) of the next document's; order is by id (then text, for repeated ids;
    null ids first), and the first document follows the last. A null text is empty;
    other columns aren't read, whatever their names; an empty table gives no rows.
    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and from the permuted block tables n_within and
    first_within: how many rows' fingerprints lie within ``radius`` bits (its own
    included) and the smallest id among them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is awaited
        ended = None  # the range that has had its halo

        def report(row: tuple, nxt: tuple) -> tuple:
            i, text, fp = row
            n = len(text)
            edited = (text[: n - n // 2] + nxt[1][: n // 2]).encode()
            efp = fingerprint(edited)
            return i, n, hashlib.sha256(edited).hexdigest(), hex_of(fp), hex_of(efp), likeness(fp, efp), likeness(fp, nxt[2]), [hashing.signed(x) for x in fp]

        for batch in batches:
            out = []
            for part, i, halo, data, fp in zip(*(batch.column(k) for k in range(5))):
                part, i, halo, data = part.as_py(), i.as_py(), halo.as_py(), data.as_py()
                if halo and ended == part:
                    continue  # a further row with the id that begins the next range
                cur = (i, data.decode(), tuple(x & _MASK for x in fp.as_py()))
                if held is not None:
                    out.append(report(held, cur))
                held, ended = (None, part) if halo else (cur, ended)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], names=_NAMES)

    _MASK = (1 << 64) - 1
    _NAMES = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "fp"]
    _KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fp array<long>"
    report_ = materialize(with_next(df, id_col, text_col).mapInArrow(rows, schema), "report")
    within = within_radius(report_.select(F.col(id_col).alias("id"), "fp"), radius)
    return report_.join(within, "fp").drop("fp")
