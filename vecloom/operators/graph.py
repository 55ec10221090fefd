"""Edge tables: edges(src, dst, d2) directed, pool(u, v, d2) undirected with u < v."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash_uniform, random_level, squared_l2
from ..session import release, save


def with_distance(points: DataFrame, pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Pairs with d2, by two equi-joins with the points."""
    left = points.select(F.col("id").alias(a), F.col("features").alias("_x"))
    right = points.select(F.col("id").alias(b), F.col("features").alias("_y"))
    return pairs.join(left, a).join(right, b).withColumn("d2", squared_l2("_x", "_y")).drop("_x", "_y")


def undirected(edges: DataFrame) -> DataFrame:
    """The pool: each edge once, whichever its direction; no loops."""
    pool = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "d2").where("u <> v")
    return pool.groupBy("u", "v").agg(F.min("d2").alias("d2"))


def directed(pool: DataFrame) -> DataFrame:
    """Both directions of a pool's edges."""
    return pool.select(F.col("u").alias("src"), F.col("v").alias("dst"), "d2").unionByName(pool.select(F.col("v").alias("src"), F.col("u").alias("dst"), "d2"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d2")


def add_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each once."""
    return edges.select("src", "dst", "d2").unionByName(reverse(edges)).distinct()


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too."""
    return edges.select("src", "dst", "d2").join(reverse(edges).select("src", "dst"), ["src", "dst"], "left_semi")


def cap_degree(edges: DataFrame, most: int, first: str | None = None) -> DataFrame:
    """The ``most`` nearest edges of each node, those with ``first`` set before the others."""
    order = ([F.desc(first)] if first else []) + ["d2", "dst"]
    rank = F.row_number().over(Window.partitionBy("src").orderBy(*order))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def evicted(edges: DataFrame, most: int) -> DataFrame:
    """What a bounded heap of ``most`` edges a node would push out."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return edges.withColumn("_rank", rank).where(F.col("_rank") > most).drop("_rank")


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those of ``new`` that aren't there yet, flagged is_new."""
    old = edges.select("src", "dst", "d2").withColumn("is_new", F.lit(False))
    unseen = new.select("src", "dst", "d2").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return old.unionByName(unseen.withColumn("is_new", F.lit(True)))


def set_flags(edges: DataFrame, value: bool) -> DataFrame:
    return edges.withColumn("is_new", F.lit(value))


def unseen_pairs(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs (u, v) that the pool doesn't have."""
    return pairs.join(pool.select("u", "v"), ["u", "v"], "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges and max, min, mean, population deviation of out-degrees, zero degrees included."""
    degree = nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return degree.agg(F.count("*").alias("n_nodes"), F.sum("d").alias("n_edges"), F.max("d").alias("max_degree"), F.min("d").alias("min_degree"), F.avg("d").alias("avg_degree"), F.stddev_pop("d").alias("std_degree"))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("src") == node)


def ego(edges: DataFrame, radius: int) -> DataFrame:
    """(src, dst, hops): nodes within ``radius`` hops of each node."""
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    out = edges.select("src", "dst").distinct().withColumn("hops", F.lit(1))
    reach = out
    for hop in range(2, radius + 1):
        reach = reach.join(step, reach.dst == step.mid).select("src", F.col("to").alias("dst")).distinct().withColumn("hops", F.lit(hop))
        out = out.unionByName(reach)
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min("hops").alias("hops"))


def expand_pairs(pool: DataFrame, tree: DataFrame, symmetric: bool = False) -> DataFrame:
    """(u, v) that the expansion of tree edges proposes and the pool lacks.

    For an edge (i, j): neighbours of i with j and of j with i; symmetric: each of
    i and its neighbours with each of j and its neighbours.
    """
    adj = directed(pool).select(F.col("src").alias("x"), F.col("dst").alias("y"))
    if symmetric:
        own = tree.select(F.col("u").alias("x")).unionByName(tree.select(F.col("v").alias("x"))).distinct()
        adj = adj.unionByName(own.select("x", F.col("x").alias("y")))
        left = tree.join(adj, tree.u == adj.x).select("v", F.col("y").alias("a"))
        pairs = left.join(adj, left.v == adj.x).select("a", F.col("y").alias("b"))
    else:
        at_u = tree.join(adj, tree.u == adj.x).select(F.col("y").alias("a"), F.col("v").alias("b"))
        at_v = tree.join(adj, tree.v == adj.x).select(F.col("u").alias("a"), F.col("y").alias("b"))
        pairs = at_u.unionByName(at_v)
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return unseen_pairs(pairs, pool)


def components(nodes: DataFrame, pool: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """(id, component): component is the smallest id reachable; isolated nodes are their own.

    Every partition first drops edges that its own forest doesn't need. If at most
    ``limit`` edges are left, one task labels their nodes; else labels spread from neighbour to neighbour and jump to their label's label,
    so rounds grow with the logarithm of the longest path; each round's table is
    saved. Edges that have become loops of a component are dropped.
    """
    from .kernels import component_labels, local_forest

    schema = "u long, v long, w double"
    left = save(pool.select("u", "v", F.lit(0.0).alias("w")).where("u <> v").mapInPandas(local_forest, schema), "forest")
    if left.count() <= limit:
        known = left.coalesce(1).mapInPandas(component_labels, "id long, component long")
        return nodes.select("id").join(known, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    label = save(nodes.select("id", F.col("id").alias("component")), "labels")
    edges = left.select("u", "v").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        hook = save(low.where("m < u").select(F.col("u").alias("id"), F.col("m").alias("to")), "hooks")
        if not hook.head(1):
            return label
        while True:  # each hook goes to a smaller root; follow them to the end
            jump = hook.select("id", "to").alias("h").join(hook.select(F.col("id").alias("mid"), F.col("to").alias("far")), F.col("h.to") == F.col("mid"), "left")
            longer = save(jump.select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "jumps")
            moved = longer.where("moved").head(1)
            release(hook)
            hook = longer
            if not moved:
                break
        to = lambda c: hook.select(F.col("id").alias(c), F.col("to").alias("_" + c))
        label = save(label.join(to("component"), "component", "left").select("id", F.coalesce("_component", "component").alias("component")), "labels")
        moved = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
        edges = save(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "left")


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, size) of labels(id, component)."""
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def with_size(labels: DataFrame) -> DataFrame:
    """(id, component, size): labels with the number of nodes that each is connected with, its own included."""
    return labels.join(component_sizes(labels), "component").select("id", "component", "size")


def are_connected(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (u, v) with connected: whether both ends are in one component."""
    a, b = labels.select(F.col("id").alias("u"), F.col("component").alias("_a")), labels.select(F.col("id").alias("v"), F.col("component").alias("_b"))
    return pairs.join(a, "u").join(b, "v").withColumn("connected", F.col("_a") == F.col("_b")).drop("_a", "_b")


def is_connected(nodes: DataFrame, pool: DataFrame) -> bool:
    return components(nodes, pool).select("component").distinct().limit(2).count() <= 1


def layers(points: DataFrame, degree: int = 50, max_layers: int = 10, salt: int = 0, norm: float | None = None) -> DataFrame:
    """(id, level): the layer that each point reaches, from a hash of its id; the smallest id reaches the top.

    ``norm`` takes the place of 1 / ln(degree), by which levels grow.
    """
    level = random_level(hash_uniform("id", salt), degree, max_layers, norm)
    rows = points.select("id", level.alias("level"))
    top = rows.agg(F.max("level").alias("top"), F.min("id").alias("least"))
    return rows.crossJoin(F.broadcast(top)).select("id", F.when(F.col("id") == F.col("least"), F.col("top")).otherwise(F.col("level")).cast("int").alias("level"))


def layer_sizes(levels: DataFrame) -> DataFrame:
    """(layer, n): points of each layer, which holds all that reach it or a higher one."""
    return levels.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


def random_edges(nodes: DataFrame, degree: int, salt: int = 5) -> DataFrame:
    """(src, dst): ``degree`` distinct pseudo-random neighbours of each node (all others if they are fewer), never itself.

    A node's k-th neighbour lies a step away, in the order of ids, that is drawn from the k-th of ``degree`` equal shares of all steps.
    """
    n, low, high = nodes.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if n < 2:
        return nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    degree, ids = min(degree, n - 1), None
    if (low, high) != (0, n - 1):
        from .relational import ranked

        ids = ranked(nodes.select("id"), ["id"], "place").select("id", "place")
    at = nodes.select(F.col("id").alias("place")) if ids is None else ids.select("place")
    draws = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(degree - 1))))
    first, last = F.floor(F.col("k") * F.lit(n - 1) / degree), F.floor((F.col("k") + 1) * F.lit(n - 1) / degree)
    step = first + F.floor(hash_uniform(F.col("place") * degree + F.col("k"), salt) * (last - first))
    drawn = draws.select(F.col("place").alias("src"), F.pmod(F.col("place") + 1 + step, F.lit(n)).cast("long").alias("dst"))
    if ids is None:
        return drawn
    to = lambda c: ids.select(F.col("place").alias(c), F.col("id").alias("_" + c))
    return drawn.join(to("src"), "src").join(to("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def fill_random_edges(points: DataFrame, edges: DataFrame, degree: int, salt: int = 5) -> DataFrame:
    """Edges topped up to ``degree`` a node with random ones."""
    extra = with_distance(points, random_edges(points, 2 * degree, salt)).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    old = edges.select("src", "dst", "d2").withColumn("old", F.lit(1))
    both = old.unionByName(extra.select("src", "dst", "d2").withColumn("old", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("old"), hash_uniform("dst", salt), "dst"))
    return both.withColumn("_r", rank).where((F.col("old") == 1) | (F.col("_r") <= degree)).select("src", "dst", "d2")


def extend_random_edges(points: DataFrame, edges: DataFrame, more: int, salt: int = 5) -> DataFrame:
    """Edges and ``more`` random ones a node."""
    return edges.select("src", "dst", "d2").unionByName(with_distance(points, random_edges(points, more, salt)).select("src", "dst", "d2")).distinct()


def random_pairs(nodes: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(a, b): n pseudo-random pairs of the nodes' ids; loops and repeats may occur. Without nodes there are none."""
    count, low, high = nodes.agg(F.count("*"), F.min("id"), F.max("id")).first()
    draw = lambda s: F.floor(hash_uniform("id", s) * count).cast("long")
    drawn = nodes.sparkSession.range(n if count else 0).select(draw(seed).alias("a"), draw(seed + 1).alias("b"))
    if not count or (low, high) == (0, count - 1):
        return drawn
    from .relational import ranked

    ids = ranked(nodes.select("id"), ["id"], "place")
    to = lambda c: ids.select(F.col("place").alias(c), F.col("id").alias("_" + c))
    return drawn.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def sample_except(nodes: DataFrame, n: int, but: int, salt: int = 1) -> DataFrame:
    """n distinct ids other than ``but``, or all there are, in hash order."""
    return nodes.where(F.col("id") != but).orderBy(hash_uniform("id", salt), "id").limit(n).select("id")


def sample_components(labels: DataFrame, n: int, salt: int = 1) -> DataFrame:
    """Up to n points of each component, by hash."""
    rank = F.row_number().over(Window.partitionBy("component").orderBy(hash_uniform("id", salt), "id"))
    return labels.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
