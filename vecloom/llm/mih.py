"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments, each with a table from its value to the
fingerprints that have it. Two fingerprints within the radius differ in at most
``radius // segments`` bits of some segment, so looking up a small Hamming ball
around each segment's value meets every such pair; complete distances are then
verified. Of two different values in one ball only the smaller looks up the
larger, which halves the lookups and loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import cells, components, materialize


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of all XXH64 shingle hashes, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space; fewer words
    than ``size`` make one shingle, none (also null text) give fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [hashing.signed(hashing.vote(hashing.xxh64_shingles(t.as_py() or b"", size))[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, fp long").select("id", F.array("fp").alias("fp"))


def set_fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 5, words: int = 4, bands: int = 20, rows: int = 6) -> DataFrame:
    """(id, fp, search) from the set of shingles: its SimHash of 64 * words bits and one more word, and keys of its min-hashes.

    The further word of ``fp`` is a checksum, so that equal fp are equal sets. Each of
    the ``bands`` keys in ``search`` is made of ``rows`` min-hashes, so that sets of
    Jaccard similarity j share a key with probability 1 - (1 - j**rows)**bands.
    """
    odd = np.random.default_rng(5).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    number = np.arange(bands, dtype=np.uint64)

    def one(data: bytes | None) -> tuple[list[int], list[int]]:
        shingles = shingle_set(data, size)
        blocks = [shingles[k : k + (1 << 16)] for k in range(0, len(shingles), 1 << 16)]
        least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
        for k in range(0, len(shingles), 1 << 12):
            least = np.minimum(least, (odd[:, None] * shingles[None, k : k + (1 << 12)]).min(axis=1))
        keys = hashing.mix(number)
        for column in least.reshape(bands, rows).T:
            keys = hashing.mix(keys * np.uint64(3) + column)
        return [hashing.signed(x) for x in (*hashing.vote(blocks, words), checksum(shingles))], keys.view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            both = [one(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], kind), pa.array([y for _, y in both], kind)], names=["id", "fp", "search"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "id long, fp array<long>, search array<long>")


def shingle_set(data: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of the lower-cased (A-Z) text's shingles, sorted."""
    return np.unique(hashing.shingle_hashes(hashing.word_hashes((data or b"").lower()), size))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, check, shingles): shingle_set() of each row, and the checksum that set_fingerprints() gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            checks = pa.array([hashing.signed(checksum(s)) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), checks, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "check", "shingles"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id long, check long, shingles array<long>")


def checksum(shingles: np.ndarray) -> int:
    return int(hashing.mix(shingles, 9).sum(dtype=np.uint64))


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets (id, shingles) have a Jaccard similarity of ``least`` or more, counted exactly."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    percent, na, nb = round(100 * least), F.size("sa"), F.size("sb")
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    return sized.where((100 + percent) * F.size(F.array_intersect("sa", "sb")) >= percent * (na + nb)).select("a", "b").distinct()


def sorted_side(df: DataFrame) -> DataFrame:
    """A table that grows with the corpus, for one side of a join: it is shuffled and sorted, never collected by the driver to be broadcast.

    Fingerprints and ids take far less room in Parquet than as rows, so that Spark takes a table of many rows for a small one.
    """
    return df.hint("merge")


def distance(a: Column, b: Column, words: int) -> Column:
    """Hamming distance of two arrays of ``words`` 64-bit integers."""
    out = F.lit(0)
    for k in range(words):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def cuts(words: int, segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment of a fingerprint; widths differ by one at most."""
    bits = 64 * words
    at = [bits * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def _segment(fp: Column, first: int, width: int) -> Column:
    """Bits first..first+width-1 (from the top bit of the first word) as a non-negative long."""
    word, off = divmod(first, 64)
    take = lambda k, start, n: F.shiftrightunsigned(F.shiftleft(fp[k], start), 64 - n)
    if off + width <= 64:
        return take(word, off, width)
    low = off + width - 64
    return F.shiftleft(take(word, off, width - low), low).bitwiseOR(take(word + 1, 0, low))


def _entries(fps: DataFrame, segments: int, words: int) -> DataFrame:
    """The tables: a row (..., seg, val) for each segment of each fingerprint."""
    entry = F.array(*[F.struct(F.lit(k).cast("byte").alias("seg"), _segment(F.col("fp"), *p).alias("val")) for k, p in enumerate(cuts(words, segments))])
    return fps.withColumn("e", F.explode(entry)).select(*fps.columns, "e.seg", "e.val")


def _lookups(fps: DataFrame, words: int, segments: int, ball: int) -> DataFrame:
    """A row (..., seg, val, same) for each value of a ball that isn't below the own one; same: it is the own one."""
    parts = cuts(words, segments)
    masks = {w: [sum(1 << x for x in c) for n in range(ball + 1) for c in combinations(range(w), n)] for w in {w for _, w in parts}}

    def near(seg: int, part: tuple[int, int]) -> Column:
        val = _segment(F.col("fp"), *part)
        values = F.transform(F.array(*[F.lit(m).cast("long") for m in masks[part[1]]]), lambda m: val.bitwiseXOR(m))
        return F.transform(F.filter(values, lambda x: x >= val), lambda x: F.struct(F.lit(seg).cast("byte").alias("seg"), x.alias("val"), (x == val).alias("same")))

    return fps.withColumn("e", F.explode(F.concat(*[near(k, p) for k, p in enumerate(parts)]))).select(*fps.columns, "e.seg", "e.val", "e.same")


def star_links(fps: DataFrame, words: int, segments: int, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, within the radius, where one end is the first or the last by a hash among those that share a segment's value.

    At most 2 * ``segments`` pairs a row: few of the pairs there are. The hash differs
    by segment, so that a large group gets many centres, and mostly becomes one.
    """
    table = _entries(fps, segments, words)
    rank = F.struct(F.xxhash64("id", "seg").alias("h"), "id", "fp")
    ends = table.groupBy("seg", "val").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi")).where("lo.id <> hi.id")
    met = table.join(sorted_side(ends), ["seg", "val"]).withColumn("c", F.explode(F.array("lo", "hi"))).where(F.col("c.id") != F.col("id"))
    met = met.where(distance(F.col("c.fp"), F.col("fp"), words) <= radius)
    return met.select(F.least("c.id", "id").alias("a"), F.greatest("c.id", "id").alias("b")).distinct()


def hamming_links(fps: DataFrame, words: int, segments: int, radius: int, group: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of rows of (id, fp[, group]) whose fp differ in at most ``radius`` bits: all of them.

    Ids must be unique and not null. With ``group`` pairs of one group are left out, and
    values that only a row's own group has aren't looked up, so that a large group costs
    its rows and not its pairs. Each row makes segments * (half a ball) lookups of a few
    bytes and ``segments`` table entries; distances are verified in the join's own
    condition, so that its output has nothing but pairs.
    """
    table = _entries(fps, segments, words)
    probes = _lookups(fps, words, segments, radius // segments)
    probes = probes.withColumnsRenamed({"id": "pid", "fp": "pfp"} | ({group: "pgroup"} if group else {}))
    on = (F.col("p.seg") == F.col("t.seg")) & (F.col("p.val") == F.col("t.val")) & (~F.col("same") | (F.col("pid") < F.col("id")))
    if group:
        held = table.groupBy("seg", "val").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
        probes = probes.join(sorted_side(held), ["seg", "val"]).where((F.col("lo") != F.col("pgroup")) | (F.col("hi") != F.col("pgroup"))).drop("lo", "hi")
        on = on & (F.col("pgroup") != F.col(group))
    on = on & (distance(F.col("pfp"), F.col("fp"), words) <= radius)
    return probes.alias("p").join(sorted_side(table).alias("t"), on).select(F.least("pid", "id").alias("a"), F.greatest("pid", "id").alias("b")).distinct()


def classes(fps: DataFrame, words: int, segments: int, radius: int) -> DataFrame:
    """Rows of ``fps`` with component_id: the smallest id reachable over links, its own included.

    Equal fingerprints are first collapsed to their smallest id, so copies cost a
    row each and no pairs. Stars around the smallest ids join most of each large group;
    then all links between what is still apart are found. Rows without id get the
    component of their fingerprint (null if all its rows lack ids). Rows that repeat an
    id stand for themselves: their classes don't join through the id. An empty table
    gives an empty result.
    """
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    nodes = distinct.where("rep IS NOT NULL").withColumnRenamed("rep", "id")
    starred = components(star_links(nodes, words, segments, radius))
    grouped = materialize(_grouped(nodes, starred), "stars")
    links = hamming_links(grouped, words, segments, radius, "component")
    final = _merged(grouped, links).select("fp", "component_id")
    known = distinct.select("fp").join(sorted_side(final), "fp", "left")
    return fps.select("id", "fp").join(sorted_side(known), "fp")


def _grouped(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes with the component of table (node, component), else their own id."""
    return nodes.join(sorted_side(known), nodes.id == known.node, "left").drop("node").withColumn("component", F.coalesce("component", "id"))


def _merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of (id, component, ...) with component_id, once links (a, b) join their ends' components."""
    of = grouped.select("id", "component")
    ends = [sorted_side(of.select(F.col("id").alias(x), F.col("component").alias("c" + x))) for x in "ab"]
    joined = links.join(ends[0], "a").join(ends[1], "b")
    merged = components(joined.select("ca", "cb")).withColumnRenamed("component", "merged")
    return grouped.join(sorted_side(merged), F.col("component") == F.col("node"), "left").withColumn("component_id", F.coalesce("merged", "component")).drop("merged", "node")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2, segments: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row: 64-bit SimHash classes within ``radius`` bits.

    fingerprint is 16 lower-case hex digits. See fingerprints() and classes() for
    null, empty and repeated rows.
    """
    fps = materialize(fingerprints(df, id_col, text_col, size), "fps")
    out = classes(fps, 1, segments, radius)
    text = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return out.select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def key_stars(nodes: DataFrame, words: int, radius: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows of (id, fp, search) within the radius, where a key of ``search`` is shared and one end is first by a hash among its rows.

    At most a pair for each key of a row, mostly the same one: a group's first row is that of most of its keys.
    """
    table = nodes.select("id", "fp", F.explode("search").alias("val"))
    first = table.groupBy("val").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = table.join(first, "val").where((F.col("c.id") != F.col("id")) & (distance(F.col("c.fp"), F.col("fp"), words) <= radius))
    return met.select(F.least("c.id", "id").alias("a"), F.greatest("c.id", "id").alias("b")).distinct()


def key_links(grouped: DataFrame, sets: DataFrame, words: int, radius: int, least: float, block: int = 256) -> DataFrame:
    """(a, b): links that join the components of rows of (id, fp, search, component) wherever two rows that share a key are similar.

    Only keys that two components have are looked at. Their rows are dealt with their sets
    (id, shingles) to cells of two blocks, where all pairs of different components meet:
    those within the radius are compared exactly, each pair by the first key that it
    shares. A cell returns a spanning forest of its links, never more rows than it holds.
    """
    percent = round(100 * least)
    rows = grouped.select("id", "component", F.explode("search").alias("val"))
    mixed = rows.groupBy("val").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("val")
    dealt = cells(rows.join(mixed, "val"), ["val"], block)
    dealt = dealt.join(grouped.select("id", "fp", "search"), "id").join(sets, "id")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        val, low, high = pdf["val"].iat[0], pdf["i"].iat[0], pdf["j"].iat[0]
        pdf = pdf.sort_values(["component", "id"], kind="stable")
        ids, comp, own = (pdf[c].to_numpy() for c in ("id", "component", "own"))
        fp, keys = np.array(pdf["fp"].tolist(), dtype=np.int64)[:, :words], np.array(pdf["search"].tolist(), dtype=np.int64)
        held = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in pdf["shingles"]]
        sizes = np.array([len(x) for x in held])
        root = {int(c): int(c) for c in comp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for p in range(1, len(ids)):
            q = np.flatnonzero((comp[:p] != comp[p]) & ((own[:p] != own[p]) if low != high else True))
            q = q[np.bitwise_count((fp[q] ^ fp[p]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= radius]
            q = q[100 * np.minimum(sizes[q], sizes[p]) >= percent * np.maximum(sizes[q], sizes[p])]
            shared = keys[q] == keys[p]
            q = q[keys[p][shared.argmax(axis=1)] == val] if len(q) else q
            here = find(int(comp[p]))
            q = np.array([k for k in q.tolist() if find(int(comp[k])) != here], dtype=np.int64)
            if not len(q):
                continue
            flat, own_set = np.concatenate([held[k] for k in q]), held[p]
            hit = own_set[np.minimum(np.searchsorted(own_set, flat), len(own_set) - 1)] == flat
            common = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[q])[:-1])))
            for k in q[(100 + percent) * common >= percent * (sizes[q] + sizes[p])].tolist():
                one, two = find(int(comp[k])), find(int(comp[p]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    out.append((min(ids[k], ids[p]), max(ids[k], ids[p])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("val", "i", "j").applyInPandas(compare, "a long, b long")


def keep_one(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, radius: int = 64, words: int = 4, segments: int = 3, within: int = 5
) -> DataFrame:
    """Rows of ``df`` less near copies: of each class the row with the smallest id stays.

    Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity
    of ``least`` or more, counted exactly. Candidates come from multi-index hashing of the
    sets' 64-bit SimHash first: all pairs within ``within`` bits, from ``segments`` tables
    with balls of within // segments bits. At 0.8 that many bits are too few (two sets of
    n shingles that share 8/9 n have cosine 8/9, an angle of 27.3 of 180 degrees, so 39 of
    256 bits differ on average, with a standard deviation of 6), and balls that reach so far
    would hold most tables' values. So rows that are still apart are candidates, too, where
    they share one of 20 keys of six min-hashes (0.998 of the pairs at 0.8 do) and lie within
    ``radius`` of 64 * ``words`` bits. Each row is first compared with the first rows of its
    segments' values and of its keys, which joins most copies. Texts without words are equal.
    Rows with null id are all kept; rows that share an id go only if all of their texts are copies. Other columns, whatever their names, stay as they are; an empty table stays empty.
    """
    fps = materialize(set_fingerprints(df, id_col, text_col, size, words), "fps")
    distinct = fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.min("search").alias("search"))
    nodes = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "sets")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, shingles) of those nodes (id)."""
        held = nodes.join(sorted_side(wanted), "id", "left_semi").select("id", "rep", F.col("fp")[words].alias("check"))
        reps = held.select(F.col("rep").alias("_rep")).distinct()
        some = df.select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).alias("_text")).join(reps, "_rep", "left_semi")
        found = shingle_sets(some, "_rep", "_text", size).withColumnRenamed("id", "rep").join(held, ["rep", "check"])
        return materialize(found.groupBy("id").agg(F.first("shingles").alias("shingles")), "shingles")

    def short(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("id", F.slice("fp", 1, 1).alias("fp"), *more)

    keys = nodes.select("id", F.explode("search").alias("val"))
    shared = keys.groupBy("val").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("val")
    stars = materialize(star_links(short(nodes), 1, segments, within), "indexed")
    sets = sets_of(keys.join(sorted_side(shared), "val").select("id").unionByName(_ends(stars)).distinct())
    first = similar(stars.unionByName(key_stars(nodes, words, radius)).distinct(), sets, least)
    grouped = materialize(_grouped(nodes, components(first)), "stars")
    near = materialize(hamming_links(short(grouped, "component"), 1, segments, within, "component"), "indexed")
    unmet = materialize(_ends(near).join(sets.select("id"), "id", "left_anti"), "unmet")
    known = sets.unionByName(sets_of(unmet)) if unmet.head(1) else sets
    merged = _merged(grouped, similar(near, known, least)).drop("component").withColumnRenamed("component_id", "component")
    grouped = materialize(merged, "indexed")
    links = materialize(key_links(grouped, sets, words, radius, least), "links")
    final = _merged(grouped, links)
    kept = final.groupBy("component_id").agg(F.min("rep").alias("kept"))
    final = final.join(sorted_side(kept), "component_id").select("fp", "kept")
    gone = fps.join(sorted_side(final), "fp").groupBy(F.col("id").alias("_gone")).agg(F.min(F.col("id") != F.col("kept")).alias("all_go")).where("all_go").select("_gone")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, F.col("id") == F.col("_gone"), "left_anti").select(*[F.col("row")[c].alias(c) for c in df.columns])


def _ends(pairs: DataFrame) -> DataFrame:
    """(id): the ends of pairs (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
