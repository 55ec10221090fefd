"""Dendrograms dendrogram(merge_no, left_id, right_id, height, size): leaves 0..n-1, merge k is node n + k.

Edges are cut into blocks of successive ranks, each folded in a task of its own. What lies
below a block reaches it as super-nodes: halving the ranks level by level, components of the lighter half
become nodes of the heavier half, for all halves of a level at once. Subtrees are read off
a row of leaves, in which every merge is an interval: links to parents are followed within
blocks, then by pointer jumping between them. No task holds more than a block, and the rounds grow with the
logarithm of the number of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, save
from .graph import components
from .relational import ranked, running_sum

SCHEMA = "merge_no long, left_id long, right_id long, height double, size long"
LIMIT = 200_000  # edges, merges or leaves that one task folds
_WIDTH = 40  # bits of a node in a key of (half, node)


def _ended(edges: DataFrame) -> DataFrame:
    """Rows (block, r, h, u, su, nu, v, sv, nv): both ends' components, their sizes and their nodes of the dendrogram."""
    end = lambda c: [F.col(c), F.lit(1).cast("long").alias("s" + c), F.col(c).alias("n" + c)]
    return edges.select("block", "r", "h", *end("u"), *end("v"))


def _contracted(state: DataFrame, span: int, n: int) -> DataFrame:
    """The state after the heavier half of each run of ``span`` blocks gets the components of the lighter half as nodes."""
    half = F.floor(F.col("block") / span).cast("long")
    light = F.pmod("block", F.lit(span)) < span // 2
    key = lambda c: F.shiftleft(half, _WIDTH) + F.col(c)
    low, high = state.where(light), state.where(~light)
    edges = low.select(key("u").alias("u"), key("v").alias("v"), "r", "su", "sv")
    nodes = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("su").alias("size")), F.struct(F.col("v").alias("id"), F.col("sv").alias("size")))).alias("x")).select("x.*").distinct()
    label = save(components(nodes, edges), "labels")
    size = nodes.join(label, "id").groupBy("component").agg(F.sum("size").alias("size"))
    top = edges.select(F.col("u").alias("id"), "r").join(label, "id").groupBy("component").agg(F.max("r").alias("top"))
    of = save(label.join(size, "component").join(top, "component").select("id", (F.col("component") - F.shiftleft(F.shiftright("component", _WIDTH), _WIDTH)).alias("c"), "size", (F.col("top") + n).alias("node")), "contracted")
    release(label)

    def replaced(df: DataFrame, c: str) -> DataFrame:
        new = of.select(F.col("id").alias("_k"), F.col("c").alias("_c"), F.col("size").alias("_s"), F.col("node").alias("_n"))
        met = df.withColumn("_k", key(c)).join(new, "_k", "left")
        return met.withColumns({c: F.coalesce("_c", c), "s" + c: F.coalesce("_s", "s" + c), "n" + c: F.coalesce("_n", "n" + c)}).drop("_k", "_c", "_s", "_n")

    return low.unionByName(replaced(replaced(high, "u"), "v"))


def _folder(n: int):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["r", "h", "u", "v"], kind="stable")
        # without ranks from a wider order the block is all there is
        ranks = pdf["r"].to_numpy() if pdf["r"].iat[0] >= 0 else np.arange(len(pdf))
        root, node, size, rows = {}, {}, {}, []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, s, d in zip(*(np.concatenate([pdf[c + "u"], pdf[c + "v"]]).tolist() for c in ("", "s", "n"))):
            root[x], size[x], node[x] = x, s, d
        for k, a, b, h in zip(ranks.tolist(), pdf["u"].tolist(), pdf["v"].tolist(), pdf["h"].tolist()):
            a, b = find(a), find(b)
            if size[a] < size[b]:
                a, b = b, a
            rows.append((k, min(node[a], node[b]), max(node[a], node[b]), h, size[a] + size[b]))
            root[b], node[a] = a, n + k
            size[a] += size[b]
        return pd.DataFrame(rows, columns=["merge_no", "left_id", "right_id", "height", "size"])

    return fold


def from_tree(tree: DataFrame, n: int, weight: str = "d2", limit: int = LIMIT) -> DataFrame:
    """The single-linkage dendrogram of forest edges (u, v, weight) over ids 0..n-1; heights are roots of weights.

    Edges merge in the order (height, u, v). A forest of several trees gives fewer than n - 1 merges. Ids
    outside 0..n-1 raise a ValueError, see clustering.dense_ids(). ``limit`` edges are a block.
    """
    edges = save(tree.select("u", "v", F.sqrt(F.greatest(F.col(weight), F.lit(0.0))).alias("h"), F.col(weight).alias("w")), "tree")
    m, low, high = edges.agg(F.count("*"), F.min(F.least("u", "v")), F.max(F.greatest("u", "v"))).first()
    if m and (low < 0 or high >= n):
        raise ValueError(f"ids of a dendrogram's points are 0..{n - 1}, found {low} to {high}; number them first (clustering.dense_ids)")
    if m <= limit:
        one = edges.select(F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("r"), "h", "u", "v")
        return _ended(one).groupBy("block").applyInPandas(_folder(n), SCHEMA)
    order = ranked(edges, ["w", "u", "v"], "r").withColumn("block", F.floor(F.col("r") / limit).cast("long"))
    state = save(_ended(order), "blocks")
    span = 1 << max(-(-m // limit) - 1, 1).bit_length()
    while span > 1:
        old, state = state, save(_contracted(state, span, n), "blocks")
        release(old)
        span //= 2
    return state.groupBy("block").applyInPandas(_folder(n), SCHEMA)


# ---- links to parents


def _parents(dendrogram: DataFrame, n: int, larger_left: bool = False) -> DataFrame:
    """(node, up, off): for each child its merge, and how many leaves of that merge stand before it."""
    sizes = dendrogram.select((F.col("merge_no") + n).alias("left_id"), F.col("size").alias("first"))
    both = dendrogram.join(sizes, "left_id", "left").withColumn("first", F.coalesce("first", F.lit(1)).cast("long"))
    swap = F.lit(larger_left) & (2 * F.col("first") < F.col("size"))
    left = F.struct(F.col("left_id").alias("node"), F.when(swap, F.col("size") - F.col("first")).otherwise(F.lit(0)).alias("off"))
    right = F.struct(F.col("right_id").alias("node"), F.when(swap, F.lit(0)).otherwise(F.col("first")).alias("off"))
    return both.select(F.col("merge_no").alias("up"), F.explode(F.array(left, right)).alias("x")).select("x.node", "up", "x.off")


def climbed(links: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(k, top, off): the end of the chain that links (k, up, off) lead to from each k, and the sum of off on the way.

    ``up`` is null at an end, whose own off doesn't count. Links within a block of ``limit`` numbers are
    followed in a task; what leaves its block then jumps to the jump of where it arrives, until all have ended.
    """
    schema = "k long, top long, off long, up long"

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf["k"].to_numpy()
        sort = np.argsort(k)
        k, out = k[sort], pdf["up"].isna().to_numpy()[sort]
        up = pdf["up"].fillna(-1).to_numpy().astype(np.int64)[sort]
        off = np.where(out, 0, pdf["off"].fillna(0).to_numpy().astype(np.int64)[sort])
        at = np.searchsorted(k, up)
        here = ~out & (at < len(k)) & (k[np.minimum(at, len(k) - 1)] == up)
        # a node that leaves the block, or ends, points at itself and keeps its own step for later
        to = np.where(here, at, np.arange(len(k)))
        total = np.where(here, off, 0)
        while True:
            nxt = to[to]
            if np.array_equal(nxt, to):
                break
            total, to = total + total[to], nxt
        leaves = ~out[to] & ~here[to]
        far = pd.Series(np.where(leaves, up[to], -1)).astype("Int64").mask(~leaves)
        return pd.DataFrame({"k": k, "top": k[to], "off": total + np.where(leaves, off[to], 0), "up": far})

    state = save(links.select("k", F.col("up").cast("long"), F.col("off").cast("long")).groupBy(F.floor(F.col("k") / limit).alias("b")).applyInPandas(inside, schema), "climbed")
    while state.where("up IS NOT NULL").head(1):
        on = state.select(F.col("k").alias("up"), F.col("top").alias("_t"), F.col("off").alias("_o"), F.col("up").alias("_u"))
        step = state.join(on, "up", "left").select("k", F.coalesce("_t", "top").alias("top"), (F.col("off") + F.coalesce("_o", F.lit(0))).alias("off"), F.col("_u").alias("up"))
        old, state = state, save(step, "climbed")
        release(old)
    return state.select("k", "top", "off")


def intervals(dendrogram: DataFrame, n: int, larger_left: bool = False, limit: int = LIMIT) -> DataFrame:
    """The dendrogram with root, lo, mid and hi: in a row of all leaves a merge holds those at lo..hi-1, its first child those before mid.

    The first child is the left one, with ``larger_left`` the larger one. Trees of a forest follow each other by their roots' numbers.
    """
    links = _parents(dendrogram, n, larger_left)
    inner = links.where(F.col("node") >= n).select((F.col("node") - n).alias("merge_no"), "up", "off")
    found = climbed(dendrogram.select("merge_no").join(inner, "merge_no", "left").withColumnRenamed("merge_no", "k"), limit)
    rooted = save(dendrogram.join(found.select(F.col("k").alias("merge_no"), F.col("top").alias("root"), "off"), "merge_no"), "rooted")
    roots = rooted.where("merge_no = root").select("root", "size")
    if len(roots.limit(2).collect()) > 1:
        roots = running_sum(roots, ["root"], "size", "base").select("root", (F.col("base") - F.col("size")).alias("base"))
    else:
        roots = roots.select("root", F.lit(0).cast("long").alias("base"))
    second = links.where("off > 0").select(F.col("up").alias("merge_no"), F.col("off").alias("first"))
    return rooted.join(roots, "root").join(second, "merge_no").select(*dendrogram.columns, "root", (F.col("base") + F.col("off")).alias("lo"), (F.col("base") + F.col("off") + F.col("first")).alias("mid"), (F.col("base") + F.col("off") + F.col("size")).alias("hi"))


def leaf_row(spans: DataFrame, n: int) -> DataFrame:
    """(pos, id, gap) of intervals(): the leaves of merges in their row, each with the height of the merge that joins it to the leaf before, infinite at a tree's first."""
    one = F.struct(F.col("lo").alias("pos"), F.col("left_id").alias("id"))
    two = F.struct(F.col("mid").alias("pos"), F.col("right_id").alias("id"))
    leaves = spans.select(F.explode(F.array(one, two)).alias("x")).select("x.*").where(F.col("id") < n)
    return leaves.join(spans.select(F.col("mid").alias("pos"), F.col("height").alias("gap")), "pos", "left").select("pos", "id", F.coalesce("gap", F.lit(float("inf"))).alias("gap"))


def range_max(row: DataFrame, asked: DataFrame, block: int = 1024, per_task: int = 1_000_000, depth: int = 0) -> DataFrame:
    """``asked`` (a, b, ...) with top: the largest gap of row (pos, gap) at positions a..b; null where there is none.

    Ranges within a block of the row are answered in tasks that hold the block and at most about
    ``per_task`` of them; longer ones take the maxima from a to its block's end and from b's block's start to b, which every
    position carries, and of the blocks between, by the same means on the row of blocks' maxima.
    """
    names = [c for c in asked.columns if c not in ("a", "b")]
    own = row.select("pos", "gap", F.floor(F.col("pos") / block).alias("blk"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        gap = pdf["gap"].to_numpy()
        return pd.DataFrame({"pos": pdf["pos"], "blk": pdf["blk"], "head": np.maximum.accumulate(gap), "tail": np.maximum.accumulate(gap[::-1])[::-1], "top": gap.max()})

    known = save(own.groupBy("blk").applyInPandas(ends, "pos long, blk long, head double, tail double, top double"), "ends")
    asked = save(asked.withColumns({"_x": F.floor(F.col("a") / block), "_y": F.floor(F.col("b") / block)}), "asked")
    salts = max(1, -(-asked.where("_x = _y").count() // per_task))
    near = asked.where("_x = _y").withColumn("s", F.pmod(F.xxhash64("a", "b"), F.lit(salts)).cast("int"))
    held = own.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def within(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return asked.assign(top=np.nan)[[*names, "a", "b", "top"]]
        base, gap = int(held["blk"].iat[0]) * block, np.full(block, -np.inf)
        gap[held["pos"].to_numpy() - base] = held["gap"].to_numpy()
        table, a, b = [gap], asked["a"].to_numpy() - base, asked["b"].to_numpy() - base
        while 2 << len(table) - 1 <= block:
            w, last = 1 << len(table) - 1, table[-1]
            table.append(np.append(np.maximum(last[:-w], last[w:]), last[-w:]))
        level = np.floor(np.log2(np.maximum(b - a + 1, 1))).astype(np.int64)
        table = np.stack(table)
        top = np.where(b >= a, np.maximum(table[level, a], table[level, np.maximum(b - (1 << level) + 1, 0)]), np.nan)
        return asked.assign(top=np.where(np.isneginf(top), np.nan, top))[[*names, "a", "b", "top"]]

    kinds = dict(asked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*names, "a", "b"]) + ", top double"
    short = near.groupBy(F.col("_x").alias("blk"), "s").cogroup(held.groupBy("blk", "s")).applyInPandas(within, schema)
    tail, head = known.select(F.col("pos").alias("a"), F.col("tail").alias("_t")), known.select(F.col("pos").alias("b"), F.col("head").alias("_h"))
    far = asked.where("_x < _y").join(tail, "a", "left").join(head, "b", "left").withColumn("top", F.greatest("_t", "_h")).drop("_t", "_h")
    between = far.where("_y - _x > 1")
    if between.head(1):
        tops = known.select(F.col("blk").alias("pos"), F.col("top").alias("gap")).distinct()
        a, b, top = (f"_{c}{depth}" for c in ("a", "b", "top"))
        wide = between.select(*names, F.col("a").alias(a), F.col("b").alias(b), F.col("top").alias(top), (F.col("_x") + 1).alias("a"), (F.col("_y") - 1).alias("b"))
        through = range_max(tops, wide, block, per_task, depth + 1).select(*names, F.col(a).alias("a"), F.col(b).alias("b"), F.greatest(top, "top").alias("top"))
        short = short.unionByName(through)
    short = short.unionByName(far.where("_y - _x = 1").select(*names, "a", "b", "top"))
    # where top is not a number nothing was found
    return short.withColumn("top", F.when(~F.isnan("top"), F.col("top")))


# ---- whole dendrograms


def _is_sorted(dendrogram: DataFrame, n: int) -> bool:
    """Whether no merge is higher than the merge above it."""
    up = dendrogram.select(F.explode(F.array("left_id", "right_id")).alias("node"), F.col("height").alias("above"))
    below = dendrogram.select((F.col("merge_no") + n).alias("node"), "height")
    return not below.join(up, "node").where("height > above").head(1)


def round_up(dendrogram: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """Heights raised to those of the merges below: the largest gap of a merge's interval in the row of leaves."""
    if _is_sorted(dendrogram, n):
        return dendrogram.select("merge_no", "left_id", "right_id", "height", "size")
    spans = save(intervals(dendrogram, n, limit=limit), "spans")
    gaps = spans.select(F.col("mid").alias("pos"), F.col("height").alias("gap"))
    asked = spans.select("merge_no", (F.col("lo") + 1).alias("a"), (F.col("hi") - 1).alias("b"))
    row = asked.select(F.explode(F.array("a", "b")).alias("pos")).distinct().join(gaps, "pos", "full").select("pos", F.coalesce("gap", F.lit(-float("inf"))).alias("gap"))
    raised = range_max(row, asked).select("merge_no", F.col("top").alias("height"))
    return spans.drop("height").join(raised, "merge_no").select("merge_no", "left_id", "right_id", "height", "size")


def sort_by_height(dendrogram: DataFrame, n: int, limit: int = LIMIT) -> DataFrame:
    """Merges renumbered by (rounded-up height, merge_no), so that heights rise and children come first."""
    order = save(ranked(round_up(dendrogram, n, limit), ["height", "merge_no"], "new"), "sorted")
    to = order.select((F.col("merge_no") + n).alias("node"), (F.col("new") + n).alias("to"))
    for c in ("left_id", "right_id"):
        order = order.join(to.withColumnsRenamed({"node": c, "to": "_" + c}), c, "left").withColumn(c, F.coalesce("_" + c, c)).drop("_" + c)
    return order.select(F.col("new").alias("merge_no"), F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "height", "size")


def first_points(dendrogram: DataFrame, n: int, keep: int, limit: int = LIMIT) -> DataFrame:
    """The dendrogram restricted to points below ``keep``: empty merges go, one-sided ones are spliced out.

    Points of a merge's sides are counted by running sums over the row of leaves.
    """
    spans = save(intervals(dendrogram, n, limit=limit), "spans")
    row = leaf_row(spans, n).withColumn("one", (F.col("id") < keep).cast("long"))
    upto = save(running_sum(row.select("pos", "one"), ["pos"], "one", "upto").select((F.col("pos") + 1).alias("at"), "upto"), "upto")
    held = spans
    for c in ("lo", "mid", "hi"):
        held = held.join(upto.select(F.col("at").alias(c), F.col("upto").alias("_" + c)), c, "left").withColumn("_" + c, F.coalesce("_" + c, F.lit(0)))
    held = save(held.select("merge_no", "left_id", "right_id", "height", (F.col("_mid") - F.col("_lo")).alias("one"), (F.col("_hi") - F.col("_mid")).alias("two")), "held")
    stays = ranked(held.where("one > 0 AND two > 0"), ["merge_no"], "new")
    stays = save(stays, "stays")
    # a merge with points on one side only leads to that side's node
    side = F.when(F.col("one") > 0, F.col("left_id")).otherwise(F.col("right_id"))
    passed = held.where("(one > 0) <> (two > 0)").select((F.col("merge_no") + n).alias("k"), side.alias("up"), F.lit(0).alias("off"))
    ends = passed.select(F.col("up").alias("k")).distinct().join(passed.select("k"), "k", "left_anti").select("k", F.lit(None).cast("long").alias("up"), F.lit(0).alias("off"))
    to = climbed(passed.unionByName(ends), limit).select("k", "top")
    number = stays.select((F.col("merge_no") + n).alias("node"), (F.col("new") + keep).alias("to"))
    out = stays
    for c in ("left_id", "right_id"):
        out = out.join(to.select(F.col("k").alias(c), F.col("top").alias("_t")), c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
        out = out.join(number.withColumnsRenamed({"node": c, "to": "_t"}), c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
    return out.select(F.col("new").alias("merge_no"), F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "height", (F.col("one") + F.col("two")).alias("size"))


def flat_cut(dendrogram: DataFrame, n: int, k: int, min_size: int = 10, limit: int = LIMIT) -> DataFrame:
    """(id, cluster): from the roots the highest cluster is split until there are k or none can be.

    A child stays a cluster if it is a merge of at least ``min_size`` points; others
    become noise, -1. Labels follow ascending merges. Without any cluster all is noise. The
    trees of a forest all start as clusters: of more than k none is split. Heights that
    aren't sorted are raised first, so that clusters are split from the highest down: how many there are
    after each split is a running sum. Points find their cluster by following links up to it.
    """
    spark = dendrogram.sparkSession
    d = round_up(save(dendrogram, "merges"), n, limit)  # read several times
    up = _parents(d, n)
    rows = d.join(up.where(F.col("node") >= n).select((F.col("node") - n).alias("merge_no"), F.col("up")), "merge_no", "left")
    rows = save(rows.withColumn("able", F.col("up").isNull() | (F.col("size") >= min_size)).select("merge_no", "height", "up", "able"), "able")
    begin = rows.where("up IS NULL").count()
    below = rows.where("able AND up IS NOT NULL").groupBy(F.col("up").alias("merge_no")).agg(F.count("*").alias("children"))
    split, label = None, None
    if begin and begin < k:
        change = rows.where("able").join(below, "merge_no", "left").select("merge_no", "height", (F.coalesce("children", F.lit(0)) - 1).alias("change"))
        down = change.select((-F.col("height")).alias("low"), (-F.col("merge_no")).alias("late"), "change")
        after = running_sum(down, ["low", "late"], "change", "n").where((F.col("n") + begin >= k) | (F.col("n") + begin == 0))
        split = after.agg(F.min(F.struct("low", "late")).alias("s")).first().s
    is_split = F.lit(False) if split is None else F.struct((-F.col("height")).alias("low"), (-F.col("merge_no")).alias("late")) <= F.struct(F.lit(split.low).alias("low"), F.lit(split.late).alias("late"))
    told = rows.withColumn("split", F.col("able") & is_split)
    above = told.select(F.col("merge_no").alias("up"), F.col("split").alias("above"))
    told = told.join(above, "up", "left").withColumn("above", F.coalesce("above", F.lit(True)))
    told = save(told.withColumn("cluster", F.col("able") & ~F.col("split") & F.col("above")), "told")
    label = ranked(told.where("cluster").select("merge_no"), ["merge_no"], "cluster").select(F.col("merge_no").alias("top"), F.col("cluster").cast("int"))
    ends = climbed(told.where("NOT split").select(F.col("merge_no").alias("k"), F.when(~F.col("above"), F.col("up")).alias("up"), F.lit(0).alias("off")), limit)
    leaves = up.where(F.col("node") < n).select(F.col("node").alias("id"), F.col("up").alias("k"))
    found = leaves.join(ends, "k").join(label, "top").select("id", "cluster")
    return spark.range(n).join(found, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def largest_gap_cut(dendrogram: DataFrame) -> DataFrame:
    """One row (k, gap): the number of clusters below the largest step between successive heights, the lowest of equal ones."""
    order = ranked(dendrogram.select("height"), ["height"], "r")
    steps = order.join(order.select((F.col("r") - 1).alias("r"), F.col("height").alias("above")), "r", "left")
    found = steps.agg(F.count("*").alias("n"), F.max(F.struct((F.col("above") - F.col("height")).alias("gap"), (-F.col("r")).alias("at"))).alias("e"))
    return found.select((F.col("n") + F.when(F.col("e.gap").isNull(), 0).otherwise(F.col("e.at"))).cast("long").alias("k"), F.coalesce("e.gap", F.lit(0.0)).alias("gap"))


def tree_row(tree: DataFrame, weight: str = "d2", limit: int = LIMIT) -> DataFrame:
    """(pos, id, gap): the points of a forest (u, v, weight), whatever their ids, in the row of its dendrogram."""
    tree = save(tree.select("u", "v", F.col(weight).alias("w")), "tree")
    found = tree.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    n, low, high = found.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n and (low, high) == (0, n - 1):
        return leaf_row(save(intervals(save(from_tree(tree, n, "w", limit), "merges"), n, limit=limit), "spans"), n)
    ids = save(ranked(found, ["id"], "place"), "ids")
    to = lambda c: ids.select(F.col("id").alias(c), F.col("place").alias("_" + c))
    placed = tree.join(to("u"), "u").join(to("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"), "w")
    row = leaf_row(save(intervals(save(from_tree(placed, n, "w", limit), "merges"), n, limit=limit), "spans"), n)
    return row.select("pos", F.col("id").alias("place"), "gap").join(ids, "place").select("pos", "id", "gap")


def pair_heights(tree: DataFrame, pairs: DataFrame, weight: str = "d2", limit: int = LIMIT) -> DataFrame:
    """``pairs`` (u, v, ...) with height: the largest weight's root on their path in the forest; null if it doesn't join them, 0 for equal ends.

    Only the pairs asked for are looked at: heights are range maxima of the row of leaves between their places.
    """
    row = save(tree_row(tree, weight, limit), "row")
    place = lambda c: row.select(F.col("id").alias(c), F.col("pos").alias("_" + c))
    put = pairs.join(place("u"), "u").join(place("v"), "v")
    asked = put.where("u <> v").withColumns({"a": F.least("_u", "_v") + 1, "b": F.greatest("_u", "_v")}).drop("_u", "_v")
    far = range_max(row.select("pos", "gap"), asked).withColumn("height", F.when(F.col("top") < float("inf"), F.col("top"))).drop("a", "b", "top")
    rest = pairs.join(far.select("u", "v").distinct(), ["u", "v"], "left_anti").withColumn("height", F.when(F.col("u") == F.col("v"), F.lit(0.0)))
    return far.select(*pairs.columns, "height").unionByName(rest.select(*pairs.columns, "height"))


def block_pairs(row: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The row (pos, id, gap) with its blocks' numbers b, and (b, c, mid): each block with itself and every later one, and the largest gap of the blocks between."""
    own = row.withColumn("b", F.floor(F.col("pos") / block))
    tops = save(own.groupBy("b").agg(F.max("gap").alias("top")), "tops")
    last = row.agg(F.coalesce(F.floor(F.max("pos") / block), F.lit(-1))).first()[0]
    met = tops.select("b", F.explode(F.sequence(F.col("b"), F.lit(last))).alias("c")).join(tops.withColumnRenamed("b", "c"), "c")
    before = Window.partitionBy("b").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return own, save(met.withColumn("mid", F.max(F.when(F.col("c") > F.col("b"), F.col("top"))).over(before)).select("b", "c", "mid"), "between")


def cophenetic(tree: DataFrame, weight: str = "d2", block: int = 1024, limit: int = LIMIT) -> DataFrame:
    """(u, v, height) for all u < v that the forest joins: the largest weight's root on their path.

    The output has n(n-1)/2 rows. Points stand in the row of the forest's dendrogram: the height of two is the largest gap between them
    in the row. Gaps are a number a point; blocks of the row are paired, each pair of blocks in
    a task with what lies between them as one maximum a block.
    """
    row = save(tree_row(tree, weight, limit), "row")
    own, between = block_pairs(row, block)
    left = between.select("b", "c", "mid", F.col("b").alias("k")).join(own.withColumnRenamed("b", "k"), "k").withColumn("first", F.lit(True))
    right = between.where("b < c").select("b", "c", "mid", F.col("c").alias("k")).join(own.withColumnRenamed("b", "k"), "k").withColumn("first", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, ids, gap = pdf["first"].to_numpy(), pdf["id"].to_numpy(), pdf["gap"].to_numpy()
        if pdf["b"].iat[0] == pdf["c"].iat[0]:
            i, j = np.triu_indices(len(ids), 1)
            # running maxima of the gaps after each leaf
            h = np.array([]) if len(ids) < 2 else np.concatenate([np.maximum.accumulate(gap[k + 1 :]) for k in range(len(ids) - 1)])
            p, q = ids[i], ids[j]
        else:
            one, two = first, ~first
            tail = np.maximum.accumulate(gap[one][::-1])[::-1]  # of leaf k: gaps k.. ; those after it start at k + 1
            after = np.append(tail[1:], -np.inf)
            head = np.maximum.accumulate(gap[two])
            mid = pdf["mid"].iat[0]
            h = np.maximum(np.maximum(after[:, None], head[None, :]), -np.inf if pd.isna(mid) else mid).ravel()
            p, q = np.repeat(ids[one], two.sum()), np.tile(ids[two], one.sum())
        ok = np.isfinite(h)  # an infinite gap parts two trees
        return pd.DataFrame({"u": np.minimum(p, q)[ok], "v": np.maximum(p, q)[ok], "height": h[ok]})

    return left.unionByName(right).groupBy("b", "c").applyInPandas(run, "u long, v long, height double")


def layout(dendrogram: DataFrame, n: int, min_size: int = 1, larger_left: bool = False, limit: int = LIMIT) -> DataFrame:
    """(merge_no, x_left, x_right, y_left, y_right, height): bars for drawing the last merge's tree, x in leaf positions by subtree size.

    Subtrees below ``min_size`` points are drawn as leaves.
    """
    spans = save(intervals(dendrogram, n, larger_left, limit), "spans")
    last = spans.agg(F.max("merge_no")).first()[0]
    drawn = spans.where((F.col("root") == F.lit(last)) & (F.col("size") >= min_size))
    base = drawn.where(F.col("merge_no") == F.lit(last)).select(F.col("lo").alias("base"))
    y = spans.where(F.col("size") >= min_size).select((F.col("merge_no") + n).alias("node"), F.col("height").alias("y"))
    child = spans.select("merge_no", "left_id", "right_id", F.col("size").alias("whole"))
    sizes = spans.select((F.col("merge_no") + n).alias("left_id"), F.col("size").alias("s"))
    swap = F.lit(larger_left) & (2 * F.coalesce("s", F.lit(1)) < F.col("whole"))
    ends = child.join(sizes, "left_id", "left").select("merge_no", F.when(swap, F.col("right_id")).otherwise(F.col("left_id")).alias("p"), F.when(swap, F.col("left_id")).otherwise(F.col("right_id")).alias("q"))
    out = drawn.join(ends, "merge_no").join(F.broadcast(base))
    for c, name in (("p", "y_left"), ("q", "y_right")):
        out = out.join(y.withColumnsRenamed({"node": c, "y": name}), c, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    left, right = F.col("lo") + (F.col("mid") - F.col("lo")) / 2, F.col("mid") + (F.col("hi") - F.col("mid")) / 2
    return out.select("merge_no", (left - F.col("base")).alias("x_left"), (right - F.col("base")).alias("x_right"), "y_left", "y_right", "height")


def draw_line(raster: np.ndarray, x0: float, y0: float, x1: float, y1: float, width: float = 1.0) -> np.ndarray:
    """Adds an anti-aliased line to a grey raster (rows are y): a pixel's ink falls off with its distance from the segment."""
    yy, xx = np.mgrid[0 : raster.shape[0], 0 : raster.shape[1]]
    dx, dy = x1 - x0, y1 - y0
    t = np.clip(((xx - x0) * dx + (yy - y0) * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
    away = np.hypot(xx - x0 - t * dx, yy - y0 - t * dy)
    return np.maximum(raster, np.clip(width / 2 + 0.5 - away, 0, 1))
