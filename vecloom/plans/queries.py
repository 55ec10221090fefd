"""The registered queries of the clustering engine and their DuckDB SQL.

SQL computes distances as left folds in doubles, like the engine, so both give the
same bits; sums whose order may differ are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import hash_uniform, random_level, segment_distance, squared_l2, triangle_cosine
from ..operators import dendrogram, descent, graph, knn, metric, mst, quality, relational, search
from ..operators import prune as prune_rules
from ..operators.prune import prune
from ..session import save
from . import clustering, index

_made: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(fn):
        _made[fn.__name__] = (fn, sql)
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _made.items() if sql}


def _points(spark: SparkSession, d: str) -> DataFrame:
    return sources.read_points(spark, f"{d}/embeddings.parquet")


def _n(spark: SparkSession, d: str) -> int:
    return _points(spark, d).count()


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- SQL fragments


def _d(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


DIST = f"dist AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v, {_d('a.embedding', 'b.embedding')} AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


def _near(k: int) -> str:
    return f"near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d2, v) AS rk FROM dist) WHERE rk <= {k})"


POOL = "pool AS MATERIALIZED (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, d2 FROM near)"
BOTH = "both_ AS MATERIALIZED (SELECT u, v, d2 FROM pool UNION ALL SELECT v, u, d2 FROM pool)"


def _prim(source: str) -> str:
    """p and tree(u, v, w): Prim's algorithm over the complete graph source(u, v, d2) with distinct lengths."""
    return f"""p AS (SELECT 0 AS step, v, d2, u AS par FROM {source} WHERE u = 0
  UNION ALL
  SELECT p.step + 1, p.v, least(p.d2, x.d2), CASE WHEN x.d2 < p.d2 THEN x.u ELSE p.par END
  FROM p JOIN (SELECT arg_min(v, (d2, v)) AS pv FROM p) m ON p.v <> m.pv JOIN {source} x ON x.u = m.pv AND x.v = p.v),
tree AS MATERIALIZED (SELECT least(a, b) AS u, greatest(a, b) AS v, w FROM (SELECT arg_min(v, (d2, v)) AS a, arg_min(par, (d2, v)) AS b, min(d2) AS w FROM p GROUP BY step))"""


WALK = """edges AS MATERIALIZED (SELECT u, v, w FROM tree UNION ALL SELECT v, u, w FROM tree),
t AS (SELECT u AS src, v AS cur, u AS prev, w AS h FROM edges
  UNION ALL SELECT t.src, e.v, t.cur, greatest(t.h, e.w) FROM t JOIN edges e ON e.u = t.cur AND e.v <> t.prev),
walk AS MATERIALIZED (SELECT src, cur, h FROM t)"""

def _merges(leaves: str = "(SELECT count(*) FROM embeddings)") -> str:
    """dendro from tree(u, v, w), one row a merge, and walk(src, cur, h) over all pairs."""
    return f"""rk AS MATERIALIZED (SELECT u, v, w, row_number() OVER (ORDER BY w) - 1 AS rk FROM tree),
side AS MATERIALIZED (SELECT m.rk, m.w, m.x, 1 + count(*) FILTER (WHERE walk.h <= m.w) AS size, max(walk.h) FILTER (WHERE walk.h < m.w) AS below
  FROM (SELECT rk, w, u AS x FROM rk UNION ALL SELECT rk, w, v FROM rk) m JOIN walk ON walk.src = m.x GROUP BY m.rk, m.w, m.x),
ids AS MATERIALIZED (SELECT s.rk, s.w, s.size, coalesce({leaves} + b.rk, s.x) AS id FROM side s LEFT JOIN rk b ON b.w = s.below),
dendro AS MATERIALIZED (SELECT rk AS merge_no, min(id) AS left_id, max(id) AS right_id, sqrt(any_value(w)) AS height, any_value(size) AS size FROM ids GROUP BY rk)"""


MERGES = _merges()

TREE_SQL = f"WITH RECURSIVE {DIST}, {_prim('dist')}"


def _flat_sql(k: int, least: int) -> str:
    """Flat cut by thresholds: the first number of lightest edges kept, from all down, that leaves k big components or none."""
    m = max(least, 2)
    return f"""{TREE_SQL}, {WALK}, {MERGES},
big AS MATERIALIZED (SELECT d.merge_no, CASE WHEN d.size >= {m} THEN 1 ELSE 0 END
    - (SELECT count(*) FROM dendro c WHERE c.merge_no + (SELECT count(*) FROM embeddings) IN (d.left_id, d.right_id) AND c.size >= {m}) AS change FROM dendro d),
run AS MATERIALIZED (SELECT merge_no + 1 AS kept, sum(change) OVER (ORDER BY merge_no) AS n FROM big UNION ALL SELECT 0, 0),
cut AS MATERIALIZED (SELECT max(kept) AS kept FROM run WHERE n >= {k} OR n = 0),
lim AS MATERIALIZED (SELECT coalesce((SELECT w FROM rk, cut WHERE rk.rk = cut.kept - 1), -1) AS w),
comp AS MATERIALIZED (SELECT e.vec_id AS id, least(e.vec_id, coalesce(min(cur), e.vec_id)) AS root, 1 + count(cur) AS n, max(h) AS top
  FROM embeddings e LEFT JOIN (SELECT walk.* FROM walk, lim WHERE h <= lim.w) x ON x.src = e.vec_id GROUP BY e.vec_id),
label AS MATERIALIZED (SELECT root, row_number() OVER (ORDER BY top) - 1 AS cluster FROM (SELECT root, max(top) AS top FROM comp WHERE n >= {m} GROUP BY root))
SELECT id, coalesce(cluster, -1)::INTEGER AS cluster FROM comp LEFT JOIN label USING (root)"""


# ---- distances and neighbours


@query(f"WITH {DIST} SELECT u, v, d2 FROM dist WHERE u < v")
def pairwise_d2(spark, d):
    """All pairs by blocks."""
    return knn.all_pairs(_points(spark, d))


@query(f"SELECT a.vec_id AS u, b.vec_id AS v, sqrt({_d('a.embedding', 'b.embedding')}) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2_successive(spark, d):
    """Distances of a given list of pairs: a batch of one-to-many distances."""
    p = _points(spark, d)
    pairs = p.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    return graph.with_distance(p, pairs, "u", "v").select("u", "v", F.sqrt("d2").alias("distance"))


@query(f"""SELECT a.vec_id AS u, CASE WHEN 2 * sqrt(uv) * sqrt(uw) > 0 THEN (uv + uw - vw) / (2 * sqrt(uv) * sqrt(uw)) ELSE -1 END AS cosine
FROM (SELECT a.vec_id, {_d('a.embedding', 'b.embedding')} AS uv, {_d('a.embedding', 'c.embedding')} AS uw, {_d('b.embedding', 'c.embedding')} AS vw
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2) a""")
def triangle_cosines(spark, d):
    p = _points(spark, d)
    a, b, c = (p.select((F.col("id") - k).alias("u"), F.col("features").alias(f"x{k}")) for k in range(3))
    rows = a.join(b, "u").join(c, "u")
    return rows.select("u", triangle_cosine(squared_l2("x0", "x1"), squared_l2("x0", "x2"), squared_l2("x1", "x2")).alias("cosine"))


@query(f"WITH {DIST}, {_near(10)} SELECT u AS src, v AS dst, d2, rk AS rank FROM near")
def knn_graph_k10(spark, d):
    return knn.knn_graph(_points(spark, d), 10)


@query(f"""SELECT qid, id, d2, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_d('a.embedding', 'b.embedding')} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d('a.embedding', 'b.embedding')}, b.vec_id) AS rank
FROM embeddings a CROSS JOIN embeddings b WHERE a.label = 0) WHERE rank <= 5""")
def knn_query_batch(spark, d):
    q = sources.points(_table(spark, d, "embeddings").where("label = 0")).withColumnRenamed("id", "qid")
    return knn.knn_query(_points(spark, d), q, 5)


@query(f"WITH {DIST}, {_near(10)} SELECT a.u AS src, a.v AS dst, a.d2 FROM near a JOIN near b ON a.u = b.v AND a.v = b.u")
def knn_mutual(spark, d):
    return graph.mutual(knn.knn_graph(_points(spark, d), 10))


@query(f"WITH {DIST}, {_near(10)} SELECT u AS src, v AS dst, d2 FROM near UNION SELECT v, u, d2 FROM near")
def knn_reverse_union(spark, d):
    return graph.add_reverse(knn.knn_graph(_points(spark, d), 10))


@query(f"WITH {DIST}, {_near(10)}, {POOL}, {BOTH} SELECT u AS src, v AS dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d2, v) AS r FROM both_) WHERE r <= 12")
def degree_cap(spark, d):
    return graph.cap_degree(graph.add_reverse(knn.knn_graph(_points(spark, d), 10)), 12)


@query(f"WITH {DIST}, {_near(10)}, {POOL}, {BOTH} SELECT u AS src, v AS dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY d2, v) AS r FROM both_) WHERE r > 12")
def heap_overflow(spark, d):
    """What bounded heaps push out."""
    return graph.evicted(graph.add_reverse(knn.knn_graph(_points(spark, d), 10)), 12)


@query(f"WITH {DIST}, {_near(5)}, {POOL}, {BOTH}, g AS (SELECT vec_id, count(v) AS c FROM embeddings LEFT JOIN both_ ON u = vec_id GROUP BY vec_id) SELECT count(*) AS n_nodes, sum(c)::BIGINT AS n_edges, max(c) AS max_degree, min(c) AS min_degree, avg(c) AS avg_degree, round(stddev_pop(c), 9) AS std_degree FROM g")
def graph_stats(spark, d):
    p = _points(spark, d)
    return graph.stats(p, graph.add_reverse(knn.knn_graph(p, 5))).withColumn("std_degree", F.round("std_degree", 9))


@query(f"WITH {DIST}, {_near(1)}, {POOL}, {BOTH}, h AS (SELECT DISTINCT a.u, b.v FROM both_ a JOIN both_ b ON a.v = b.u WHERE a.u <> b.v) SELECT u AS src, v AS dst, min(n)::INTEGER AS hops FROM (SELECT u, v, 1 AS n FROM both_ UNION ALL SELECT u, v, 2 FROM h) GROUP BY u, v")
def ego_radius2(spark, d):
    return graph.ego(graph.add_reverse(knn.knn_graph(_points(spark, d), 1)), 2)


@query(f"""WITH {DIST}, {_near(2)}, {POOL}, {BOTH}, x AS (SELECT a.v AS a, p.v AS b FROM pool p JOIN both_ a ON a.u = p.u UNION ALL SELECT p.u, a.v FROM pool p JOIN both_ a ON a.u = p.v)
SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM x WHERE a <> b AND (least(a, b), greatest(a, b)) NOT IN (SELECT (u, v) FROM pool)""")
def expansion_pairs(spark, d):
    pool = graph.undirected(knn.knn_graph(_points(spark, d), 2))
    return graph.expand_pairs(pool, pool)


@query(f"""WITH {DIST}, {_near(2)}, {POOL}, {BOTH}, o AS (SELECT * FROM both_ UNION SELECT u, u, 0.0 FROM both_), x AS (SELECT a.v AS a, b.v AS b FROM pool p JOIN o a ON a.u = p.u JOIN o b ON b.u = p.v)
SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM x WHERE a <> b AND (least(a, b), greatest(a, b)) NOT IN (SELECT (u, v) FROM pool)""")
def expansion_pairs_symmetric(spark, d):
    pool = graph.undirected(knn.knn_graph(_points(spark, d), 2))
    return graph.expand_pairs(pool, pool, symmetric=True)


@query()
def bucketed_recall(spark, d):
    """Recall of bucketed neighbours, with 8 buckets a pass."""
    p = _points(spark, d)
    truth = knn.knn_graph(p, 5)
    return knn.recall(knn.knn_graph_bucketed(p, 5, bits=3, block=16), truth)


# ---- levels


_LEVEL = "least(floor(-ln((((vec_id + 1) * 2654435761 % 4294967296) + 0.5) / 4294967296.0::DOUBLE) * (1.0 / ln(8)::DOUBLE)), 9)::INTEGER"


@query(f"SELECT vec_id AS id, {_LEVEL} AS level FROM embeddings")
def random_level_hash(spark, d):
    return _points(spark, d).select("id", random_level(hash_uniform("id"), 8, 10).alias("level"))


@query(f"WITH l AS (SELECT vec_id, {_LEVEL} AS level FROM embeddings), m AS (SELECT CASE WHEN vec_id = (SELECT min(vec_id) FROM l) THEN (SELECT max(level) FROM l) ELSE level END AS level FROM l) SELECT k::INTEGER AS layer, count(*) AS n FROM m, LATERAL (SELECT unnest(generate_series(0, level)) AS k) GROUP BY k")
def layer_sizes(spark, d):
    return graph.layer_sizes(graph.layers(_points(spark, d), 8, 10))


# ---- pruning


def _fold_sql(k: int | None, test: str) -> str:
    """g(rk, u, kept, moved): each node's candidates (the k nearest, or all) folded nearest first."""
    return f"""WITH RECURSIVE {DIST}, {_near(k or 1 << 30)},
r AS MATERIALIZED (SELECT n.*, e.embedding AS e FROM near n JOIN embeddings e ON e.vec_id = n.v),
g AS (SELECT 0::BIGINT AS rk, u, []::STRUCT(v BIGINT, d DOUBLE, e FLOAT[])[] AS kept, []::STRUCT(v BIGINT, d DOUBLE, e FLOAT[])[] AS hit, NULL::BIGINT AS v, NULL::FLOAT[] AS ve FROM (SELECT DISTINCT u FROM r)
  UNION ALL
  SELECT rk, u, CASE WHEN len(hit) = 0 THEN list_append(kept, {{'v': v, 'd': d2, 'e': e}}) ELSE kept END, hit, v, e
  FROM (SELECT r.rk, g.u, g.kept, r.v, r.d2, r.e, list_filter(g.kept, lambda k: {test}) AS hit FROM g JOIN r ON r.u = g.u AND r.rk = g.rk + 1))"""


def _prune_sql(k: int | None, test: str) -> str:
    return f"""{_fold_sql(k, test)}
SELECT u AS src, k.v AS dst, k.d AS d2 FROM (SELECT u, unnest(kept) AS k FROM g WHERE rk = (SELECT max(rk) FROM r))"""


def _moved_sql(k: int, test: str) -> str:
    """Kept edges, and for each other candidate the edge from the first kept one that rules it out."""
    return f"""{_fold_sql(k, test)}
SELECT u AS src, k.v AS dst, k.d AS d2 FROM (SELECT u, unnest(kept) AS k FROM g WHERE rk = (SELECT max(rk) FROM r))
UNION SELECT hit[1].v, v, {_d('hit[1].e', 've')} FROM g WHERE len(hit) > 0"""


def _pruned(spark, d, rule, **options):
    p = _points(spark, d)
    return prune(p, knn.knn_graph(p, 20), rule, **options).select("src", "dst", "d2")


@query(_prune_sql(20, f"{_d('k.e', 'r.e')} <= r.d2"))
def rng_edges(spark, d):
    return _pruned(spark, d, "occlusion")


@query(_prune_sql(20, f"k.d >= {_d('k.e', 'r.e')}"))
def hnsw_prune(spark, d):
    return _pruned(spark, d, "search")


@query(_prune_sql(20, f"(k.d + r.d2 - {_d('k.e', 'r.e')}) / (2 * sqrt(k.d) * sqrt(r.d2)) >= 0.5"))
def sen_edges(spark, d):
    return _pruned(spark, d, "angle", max_cos=0.5)


@query(_prune_sql(None, f"{_d('k.e', 'r.e')} <= r.d2"))
def rng_edges_all_points(spark, d):
    """The rule over all other points of each."""
    return prune_rules.prune_all(_points(spark, d), "occlusion")


@query(_prune_sql(None, f"(k.d + r.d2 - {_d('k.e', 'r.e')}) / (2 * sqrt(k.d) * sqrt(r.d2)) >= 0.5"))
def sen_edges_all_points(spark, d):
    return prune_rules.prune_all(_points(spark, d), "angle", max_cos=0.5)


@query(_moved_sql(20, f"{_d('k.e', 'r.e')} <= r.d2"))
def moved_edges_step(spark, d):
    """A descent's step: occluded edges u-v go over to w-v."""
    p = _points(spark, d)
    return prune_rules.moved_edges(p, knn.knn_graph(p, 20)).select("src", "dst", "d2").distinct()


@query(_moved_sql(20, f"(k.d + r.d2 - {_d('k.e', 'r.e')}) / (2 * sqrt(k.d) * sqrt(r.d2)) >= 0.5"))
def moved_edges_by_angle(spark, d):
    p = _points(spark, d)
    return prune_rules.moved_edges(p, knn.knn_graph(p, 20), max_cos=0.5).select("src", "dst", "d2").distinct()


# ---- trees and components


@query(f"WITH RECURSIVE {DIST}, {_near(1)}, {POOL}, {BOTH}, r AS (SELECT u AS id, u AS reach FROM both_ UNION SELECT r.id, e.v FROM r JOIN both_ e ON e.u = r.reach) SELECT id, min(reach) AS component FROM r GROUP BY id")
def connected_components_k1(spark, d):
    p = _points(spark, d)
    return graph.components(p, graph.undirected(knn.knn_graph(p, 1)))


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def mst_exact(spark, d):
    return mst.exact_tree(_points(spark, d))


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def mst_knn_kruskal(spark, d):
    """The 10-neighbour graph's forest; on these points it is the exact tree."""
    return mst.forest(graph.undirected(knn.knn_graph(_points(spark, d), 10)))


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def mst_boruvka(spark, d):
    pool = graph.undirected(knn.knn_graph(_points(spark, d), 10))
    return mst.boruvka(pool.select("u", "v", F.col("d2").alias("w"))).withColumnRenamed("w", "d2")


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def bridged_msf_k1(spark, d):
    """Nearest-neighbour edges bridged by exact closest pairs make the exact tree."""
    p = _points(spark, d)
    return mst.bridged_forest(p, graph.undirected(knn.knn_graph(p, 1)))


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def searcher_rounds(spark, d):
    p = _points(spark, d)
    return mst.nearest_foreign_rounds(p, graph.undirected(knn.knn_graph(p, 1)))


@query(f"{TREE_SQL} SELECT u, v, w AS d2 FROM tree")
def expansion_fixpoint(spark, d):
    """Three neighbours a point, expanded until the forest stays, bridged and completed: the exact tree."""
    p = _points(spark, d)
    return mst.completed_tree(p, mst.bridged_forest(p, mst.expanded_forest(p, graph.undirected(knn.knn_graph(p, 3)), symmetric=True)))


@query(f"WITH {DIST}, {_near(10)}, {POOL}, {BOTH} SELECT u AS id, d2 AS core FROM (SELECT u, d2, row_number() OVER (PARTITION BY u ORDER BY d2) AS r FROM both_) WHERE r = 5")
def core_distance(spark, d):
    return mst.core_distances(graph.undirected(knn.knn_graph(_points(spark, d), 10)), 5)


@query(f"WITH {DIST}, c AS (SELECT u, d2 FROM (SELECT u, d2, row_number() OVER (PARTITION BY u ORDER BY d2) AS r FROM dist) WHERE r = 5) SELECT round(avg(d2), 9) AS mean_core, round(var_pop(d2), 9) AS var_core FROM c")
def core_distance_summary(spark, d):
    core = knn.knn_graph(_points(spark, d), 5).where("rank = 5").select(F.col("src").alias("id"), F.col("d2").alias("core"))
    return quality.core_summary(core).select(F.round("mean_core", 9).alias("mean_core"), F.round("var_core", 9).alias("var_core"))


@query(f"""WITH RECURSIVE {DIST}, c AS MATERIALIZED (SELECT u, d2 FROM (SELECT u, d2, row_number() OVER (PARTITION BY u ORDER BY d2) AS r FROM dist) WHERE r = 5),
reach AS MATERIALIZED (SELECT d.u, d.v, greatest(d.d2, a.d2, b.d2) AS d2 FROM dist d JOIN c a ON a.u = d.u JOIN c b ON b.u = d.v), {_prim('reach')}
SELECT row_number() OVER (ORDER BY w) - 1 AS merge_no, sqrt(w) AS height FROM tree""")
def mutual_reachability_heights(spark, d):
    """Heights only: equal weights leave a choice of edges."""
    p = _points(spark, d)
    core = save(knn.knn_graph(p, 5).where("rank = 5").select(F.col("src").alias("id"), F.col("d2").alias("core")), "core")
    return clustering.merged(p, mst.exact_tree(p, core=core)).select("merge_no", "height")


# ---- dendrograms


@query(f"{TREE_SQL}, {WALK}, {MERGES} SELECT * FROM dendro")
def dendrogram_single_linkage(spark, d):
    return clustering.exact_dendrogram(_points(spark, d))


_UNSORTED = "(1 + (merge_no * 7 % 11) / 10.0::DOUBLE)"


@query(f"""{TREE_SQL}, {WALK}, {MERGES}, odd AS MATERIALIZED (SELECT *, height * {_UNSORTED} AS h FROM dendro), c AS MATERIALIZED (SELECT count(*) AS n FROM embeddings),
below AS (SELECT merge_no AS top, merge_no FROM odd UNION ALL SELECT below.top, unnest([o.left_id, o.right_id]) - c.n FROM below JOIN odd o ON o.merge_no = below.merge_no, c),
up AS MATERIALIZED (SELECT top AS merge_no, max(odd.h) AS height FROM below JOIN odd ON odd.merge_no = below.merge_no GROUP BY top),
rank AS MATERIALIZED (SELECT merge_no, height, row_number() OVER (ORDER BY height, merge_no) - 1 AS r FROM up),
ends AS MATERIALIZED (SELECT odd.merge_no, coalesce(c.n + k.r, x) AS id FROM odd, c, LATERAL (SELECT unnest([left_id, right_id]) AS x) LEFT JOIN rank k ON k.merge_no = x - c.n)
SELECT r AS merge_no, min(id) AS left_id, max(id) AS right_id, any_value(rank.height) AS height, any_value(odd.size) AS size FROM rank JOIN odd USING (merge_no) JOIN ends USING (merge_no) GROUP BY r""")
def dendrogram_sorted(spark, d):
    """A dendrogram whose heights fall and rise, rounded up and sorted."""
    made = clustering.exact_dendrogram(_points(spark, d))
    odd = made.withColumn("height", F.col("height") * (1 + F.pmod(F.col("merge_no") * 7, F.lit(11)) / F.lit(10.0)))
    return dendrogram.sort_by_height(odd, _n(spark, d))


@query(f"""WITH RECURSIVE {DIST}, core AS MATERIALIZED (SELECT u, d2 FROM (SELECT u, d2, row_number() OVER (PARTITION BY u ORDER BY d2) AS r FROM dist) WHERE r = 5),
reach AS MATERIALIZED (SELECT d.u, d.v, greatest(d.d2, a.d2, b.d2) AS d2 FROM dist d JOIN core a ON a.u = d.u JOIN core b ON b.u = d.v), {_prim('reach')}
SELECT row_number() OVER (ORDER BY w) - 1 AS merge_no, sqrt(w) AS height FROM tree""")
def index_dendrogram_minpts5(spark, d):
    """Mutual reachability over an expanded index pool: heights as over all pairs (equal weights leave a choice of edges)."""
    p = _points(spark, d)
    return clustering.index_dendrogram(p, min_pts=5, params=index.LayeredParams(exact=True, max_build_heap_size=30, lowest_max_degree=60, higher_max_degree=10))[0].select("merge_no", "height")


@query(f"{TREE_SQL}, {WALK}, {MERGES} SELECT * FROM dendro")
def index_dendrogram(spark, d):
    """Layered index, edge pool, expansion, forest: on these points the exact dendrogram."""
    return clustering.index_dendrogram(_points(spark, d), params=index.LayeredParams(exact=True, max_build_heap_size=20, lowest_max_degree=20, higher_max_degree=10))[0]


@query(f"{TREE_SQL}, {WALK}, {MERGES} SELECT * FROM dendro")
def self_joined_dendrogram(spark, d):
    return clustering.self_joined_dendrogram(_points(spark, d), 10)[0]


@query(f"{TREE_SQL}, {WALK}, {MERGES} SELECT * FROM dendro")
def searcher_dendrogram(spark, d):
    return clustering.searcher_dendrogram(_points(spark, d), index.LayeredParams(exact=True, max_build_heap_size=10, lowest_max_degree=20), ef=10)[0]


@query()
def searcher_merges(spark, d):
    """What resumable searchers with one candidate merge before any gap is bridged, over ten neighbours a point."""
    p = _points(spark, d)
    return search.searcher_merges(p, knn.knn_graph(p, 10), 1)


@query(f"{TREE_SQL}, {WALK} SELECT src AS u, cur AS v, sqrt(h) AS height FROM walk WHERE src < cur")
def cophenetic_distances(spark, d):
    return dendrogram.cophenetic(mst.exact_tree(_points(spark, d)))


@query(f"""{TREE_SQL}, {WALK}, few_walk AS MATERIALIZED (SELECT * FROM walk WHERE src < 100 AND cur < 100), few_tree AS MATERIALIZED (SELECT min(src) AS u, arg_min(cur, src) AS v, h AS w FROM few_walk GROUP BY h),
{_merges('100').replace('FROM tree', 'FROM few_tree').replace('JOIN walk ON walk.', 'JOIN few_walk ON few_walk.').replace('(walk.h', '(few_walk.h').replace('WHERE walk.h', 'WHERE few_walk.h')} SELECT * FROM dendro""")
def dendrogram_first_points(spark, d):
    return dendrogram.first_points(clustering.exact_dendrogram(_points(spark, d)), _n(spark, d), 100)


@query(_flat_sql(5, 10))
def flat_cut_k5_min10(spark, d):
    return dendrogram.flat_cut(clustering.exact_dendrogram(_points(spark, d)), _n(spark, d), 5, 10)


@query(_flat_sql(5, 3))
def flat_cut_k5_min3(spark, d):
    return dendrogram.flat_cut(clustering.exact_dendrogram(_points(spark, d)), _n(spark, d), 5, 3)


@query(f"{TREE_SQL}, h AS (SELECT sqrt(w) AS h, row_number() OVER (ORDER BY w) AS r, count(*) OVER () AS n FROM tree), g AS (SELECT n - r + 1 AS k, lead(h) OVER (ORDER BY r) - h AS gap FROM h) SELECT arg_max(k, (gap, k)) AS k, max(gap) AS gap FROM g WHERE gap IS NOT NULL")
def largest_gap_cut(spark, d):
    return dendrogram.largest_gap_cut(clustering.exact_dendrogram(_points(spark, d)))


@query(f"""{TREE_SQL}, {WALK}, {MERGES}, c AS MATERIALIZED (SELECT count(*) AS n FROM embeddings), nodes AS MATERIALIZED (SELECT vec_id AS id, 1::BIGINT AS size, 0.0::DOUBLE AS height FROM embeddings UNION ALL SELECT n + merge_no, size, height FROM dendro, c),
place AS (SELECT max(merge_no) AS k, 0.0::DOUBLE AS x FROM dendro UNION ALL
  SELECT unnest([o.left_id, o.right_id]) - c.n, unnest([place.x, place.x + l.size]) FROM place JOIN dendro o ON o.merge_no = place.k JOIN nodes l ON l.id = o.left_id, c)
SELECT o.merge_no, x + l.size / 2.0::DOUBLE AS x_left, x + l.size + r.size / 2.0::DOUBLE AS x_right, l.height AS y_left, r.height AS y_right, o.height FROM place JOIN dendro o ON o.merge_no = place.k JOIN nodes l ON l.id = o.left_id JOIN nodes r ON r.id = o.right_id""")
def dendrogram_layout(spark, d):
    return dendrogram.layout(clustering.exact_dendrogram(_points(spark, d)), _n(spark, d))


# ---- evaluation


_PAIRS = f"{DIST}, pairs AS MATERIALIZED (SELECT sqrt(a.d2) AS x, abs(a.u - a.v)::DOUBLE AS y FROM dist a WHERE u < v)"


def _pairs(spark, d):
    return knn.all_pairs(_points(spark, d)).select(F.sqrt("d2").alias("x"), (F.col("v") - F.col("u")).cast("double").alias("y"))


@query(f"WITH {_PAIRS} SELECT round(corr(x, y), 6) AS quality FROM pairs")
def quality_pearson(spark, d):
    return quality.pearson(_pairs(spark, d)).select(F.round("quality", 6).alias("quality"))


@query(f"WITH {_PAIRS} SELECT round(1 - sqrt(sum((x - y) * (x - y))) / (sqrt(count(*)) * (max(x) - min(x))), 6) AS quality FROM pairs")
def quality_norm(spark, d):
    return quality.norm_quality(_pairs(spark, d)).select(F.round("quality", 6).alias("quality"))


@query(f"WITH {_PAIRS} SELECT round(exp(avg(abs(ln(y / x)))), 6) AS quality FROM pairs WHERE x <> 0 AND y <> 0")
def quality_mean_ratio(spark, d):
    return quality.mean_ratio(_pairs(spark, d)).select(F.round("quality", 6).alias("quality"))


@query(f"""{TREE_SQL}, {WALK}, e AS MATERIALIZED (SELECT u, d2 FROM dist WHERE v = u + 1), pairs AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v, sqrt(max(e.d2)) AS y FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id JOIN e ON e.u >= a.vec_id AND e.u < b.vec_id GROUP BY 1, 2)
SELECT round(corr(sqrt(h), y), 6) AS quality FROM walk JOIN pairs ON src = u AND cur = v""")
def cophenetic_quality(spark, d):
    """Heights of the path through all ids against those of the exact tree."""
    p = _points(spark, d)
    path = graph.with_distance(p, p.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")), "u", "v")
    return quality.tree_pearson(mst.exact_tree(p), path).select(F.round("quality", 6).alias("quality"))


_RESULTS = """r AS MATERIALIZED (SELECT 'exact' AS algo, 22 AS ef, 71 AS max_build_heap_size, sqrt(h) AS x, sqrt(h) AS y FROM walk WHERE src < cur
  UNION ALL SELECT 'chain', 5, 25, sqrt(h), cur::DOUBLE FROM walk WHERE src < cur),
q AS MATERIALIZED (SELECT algo, ef, max_build_heap_size, [corr(x, y), 1 - sqrt(sum((x - y) * (x - y))) / (sqrt(count(*)) * (max(x) - min(x))), exp(avg(abs(ln(y / x))))] AS all_ FROM r GROUP BY ALL)"""


@query(f"{TREE_SQL}, {WALK}, {_RESULTS} SELECT algo, ef, max_build_heap_size, unnest(['pearson', 'norm', 'mean_ratio']) AS measure, round(unnest(all_), 6) AS quality FROM q")
def compute_quality(spark, d):
    """Two results with parameters in JSON, each measured against the exact heights: the exact dendrogram, and a chain of ids."""
    p, n = _points(spark, d), _n(spark, d)
    whole = clustering.exact_dendrogram(p)
    k = F.col("id")
    chain = spark.range(n - 1).select(k.alias("merge_no"), F.when(k == 0, F.lit(0)).otherwise(k + 1).cast("long").alias("left_id"), F.when(k == 0, F.lit(1)).otherwise(n + k - 1).cast("long").alias("right_id"), (k + 1).cast("double").alias("height"), (k + 2).alias("size"))
    rows = []
    for name, made, params in (("exact", whole, '{"ef": 22, "params": {"max_build_heap_size": 71}}'), ("chain", chain, '{"ef": 5, "params": {"max_build_heap_size": 25}}')):
        packed = F.transform(F.array_sort(F.collect_list(F.struct("merge_no", "left_id", "right_id", "height", "size"))), lambda m: F.struct(m.left_id.alias("left_id"), m.right_id.alias("right_id"), m.height.alias("height"), m.size.alias("size")))
        rows.append(made.agg(packed.alias("dendrogram")).select(F.lit(name).alias("algo"), F.lit(1.0).alias("time"), F.lit(1).alias("run"), F.lit(params).alias("params"), "dendrogram"))
    found = quality.evaluate_all(rows[0].unionByName(rows[1]), mst.exact_tree(p))
    flat = relational.flatten_json(found, "params", "ef int, params struct<max_build_heap_size: int>")
    return flat.select("algo", "ef", F.col("params.max_build_heap_size").alias("max_build_heap_size"), "measure", F.round("quality", 6).alias("quality"))


def _score_sql(body: str) -> str:
    return f"""WITH l AS (SELECT vec_id, label AS a, (vec_id % 7)::INTEGER AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY a, b),
ra AS (SELECT sum(n) AS n FROM c GROUP BY a), rb AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n)::DOUBLE AS t FROM c) {body}"""


@query(_score_sql("""SELECT round((s - e) / ((x + y) / 2 - e), 9) AS ari FROM (SELECT s, x, y, x * y / (t * (t - 1) / 2) AS e FROM (SELECT sum(n * (n - 1) / 2) AS s FROM c), (SELECT sum(n * (n - 1) / 2) AS x FROM ra), (SELECT sum(n * (n - 1) / 2) AS y FROM rb), t)"""))
def ari_vs_label(spark, d):
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return quality.adjusted_rand(rows, rows.select("id", F.pmod("id", F.lit(7)).cast("int").alias("cluster"))).select(F.round("ari", 9).alias("ari"))


@query(_score_sql("""SELECT round((x + y - s) / ((x + y) / 2), 9) AS nmi FROM (SELECT -sum(n / t * ln(n / t)) AS s FROM c, t), (SELECT -sum(n / t * ln(n / t)) AS x FROM ra, t), (SELECT -sum(n / t * ln(n / t)) AS y FROM rb, t)"""))
def nmi_vs_label(spark, d):
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return quality.mutual_information(rows, rows.select("id", F.pmod("id", F.lit(7)).cast("int").alias("cluster"))).select(F.round("nmi", 9).alias("nmi"))


@query("SELECT p_partkey, p_brand, p_retailprice, p_size FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM part) WHERE p_size > greatest(coalesce(m, 0), 0)")
def pareto_frontier(spark, d):
    return quality.pareto_frontier(_table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size"), "p_retailprice", "p_size", "p_brand", "p_partkey")


@query("WITH g AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderkey, o_orderpriority, o_totalprice FROM g WHERE o_orderdate = (SELECT min(o_orderdate) FROM g x WHERE x.o_orderpriority = g.o_orderpriority)")
def best_time_over_threshold(spark, d):
    return quality.fastest_above(_table(spark, d, "orders"), "o_totalprice", "o_orderdate", 100000.0, ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT user_id, a.v AS click, b.v AS view FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)")
def grouped_max_inner(spark, d):
    e = _table(spark, d, "events")
    return quality.grouped_max({k: e.where(F.col("event_type") == k) for k in ("click", "view")}, "user_id", "value")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def param_json_flatten(spark, d):
    return relational.flatten_json(_table(spark, d, "events").select("event_id", "props"), "props", "k bigint")


@query("SELECT p_partkey FROM part WHERE (p_size, p_brand) IN (SELECT (s, b) FROM (SELECT unnest([1, 5, 10]) AS s), (SELECT unnest(['Brand#11', 'Brand#12', 'Brand#1', 'Brand#2']) AS b))")
def parameter_grid_filter(spark, d):
    grid = relational.parameter_grid(spark, p_size=[1, 5, 10], p_brand=["Brand#11", "Brand#12", "Brand#1", "Brand#2"]).withColumn("p_size", F.col("p_size").cast("int"))
    return relational.in_grid(_table(spark, d, "part"), grid).select("p_partkey")


@query("SELECT count(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS errors, count(*) AS total FROM orders")
def error_counts(spark, d):
    return quality.error_count(_table(spark, d, "orders"), F.col("o_totalprice") > 1000)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r > 1")
def removed_duplicates(spark, d):
    return relational.duplicates(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank FROM customer")
def global_rank(spark, d):
    return relational.ranked(_table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"]).select("c_custkey", "rank")


@query("SELECT c_custkey AS key FROM customer UNION SELECT s_suppkey FROM supplier")
def duplicate_free_union(spark, d):
    c = _table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return relational.set_union(c, _table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query(f"WITH {DIST}, {_near(5)}, f AS (SELECT u, v FROM dist WHERE v = (u + 1) % (SELECT count(*) FROM embeddings)) SELECT (SELECT count(*) FROM f SEMI JOIN near ON f.u = near.u AND f.v = near.v) AS hits, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM near) AS truth, (SELECT count(*) FROM f SEMI JOIN near ON f.u = near.u AND f.v = near.v) / (SELECT count(*) FROM f) AS precision, (SELECT count(*) FROM f SEMI JOIN near ON f.u = near.u AND f.v = near.v) / (SELECT count(*) FROM near) AS recall")
def edge_precision(spark, d):
    p = _points(spark, d)
    ring = p.select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(p.count())).alias("dst"))
    return quality.edge_precision(ring, knn.knn_graph(p, 5))


# ---- sets, samples and permutations


_H = "(((({0}) + {1} + 1) * 2654435761 % 4294967296) + 0.5) / 4294967296.0::DOUBLE"


@query(f"WITH RECURSIVE {DIST}, {_near(1)}, {POOL}, {BOTH}, r AS (SELECT u AS id, u AS reach FROM both_ UNION SELECT r.id, e.v FROM r JOIN both_ e ON e.u = r.reach), l AS (SELECT id, min(reach) AS component FROM r GROUP BY id) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM l")
def component_sizes(spark, d):
    """Each point's set and how many it holds."""
    p = _points(spark, d)
    return graph.with_size(graph.components(p, graph.undirected(knn.knn_graph(p, 1))))


@query(f"WITH RECURSIVE {DIST}, {_near(1)}, {POOL}, {BOTH}, r AS (SELECT u AS id, u AS reach FROM both_ UNION SELECT r.id, e.v FROM r JOIN both_ e ON e.u = r.reach), l AS (SELECT id, min(reach) AS component FROM r GROUP BY id) SELECT id, component FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {_H.format('id', 1)}, id) AS k FROM l) WHERE k <= 3")
def component_sample(spark, d):
    p = _points(spark, d)
    return graph.sample_components(graph.components(p, graph.undirected(knn.knn_graph(p, 1))), 3)


@query(f"SELECT vec_id AS id FROM embeddings WHERE vec_id <> 7 ORDER BY {_H.format('vec_id', 1)}, vec_id LIMIT 50")
def distinct_sample_except(spark, d):
    return graph.sample_except(_points(spark, d), 50, 7)


@query(f"SELECT floor({_H.format('i', 1)} * (SELECT count(*) FROM embeddings))::BIGINT AS a, floor({_H.format('i', 2)} * (SELECT count(*) FROM embeddings))::BIGINT AS b FROM (SELECT unnest(generate_series(0, 999)) AS i)")
def random_pairs(spark, d):
    return graph.random_pairs(_points(spark, d), 1000)


@query(f"WITH {DIST} SELECT u, v, d2 FROM dist WHERE u < v AND {_H.format('u * 31 + v', 1)} * 10 < 1")
def pair_sample(spark, d):
    return knn.sampled_pairs(_points(spark, d), 10)


@query(f"""{TREE_SQL}, {WALK}, num AS MATERIALIZED (SELECT u, v, row_number() OVER (ORDER BY u, v) - 1 AS c FROM dist WHERE u < v),
drawn AS (SELECT i * w + floor({_H.format('i', 1)} * w)::BIGINT AS c FROM (SELECT unnest(generate_series(0, 1999)) AS i, (SELECT count(*) FROM num) // 2000 AS w))
SELECT num.u, num.v, sqrt(walk.h) AS height FROM drawn JOIN num USING (c) JOIN walk ON walk.src = num.u AND walk.cur = num.v""")
def sampled_cophenetic(spark, d):
    """Cophenetic heights of 2,000 pairs drawn by number: no other pair is made."""
    p = _points(spark, d)
    return dendrogram.pair_heights(mst.exact_tree(p), relational.drawn_pairs(p, 2000))


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_H.format('c_custkey', 9)}, c_custkey) - 1 AS position FROM customer")
def random_permutation(spark, d):
    return relational.permuted(_table(spark, d, "customer").select("c_custkey"), "c_custkey", 9)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_by_key(spark, d):
    return relational.first_by_key(_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("""SELECT o_orderkey, sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS distance FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t
FROM (SELECT o_orderkey, (o_orderkey % 13)::DOUBLE AS px, (o_custkey % 7)::DOUBLE AS py, 1.0::DOUBLE + o_orderkey % 5 AS dx, 2.0::DOUBLE + o_custkey % 3 AS dy FROM orders))""")
def segment_distances(spark, d):
    """Distances of points from segments that begin at 0."""
    o = _table(spark, d, "orders")
    num = lambda c, m, base=0.0: F.pmod(c, F.lit(m)).cast("double") + base
    zero = F.lit(0.0)
    return o.select("o_orderkey", segment_distance(num("o_orderkey", 13), num("o_custkey", 7), zero, zero, num("o_orderkey", 5, 1.0), num("o_custkey", 3, 2.0)).alias("distance"))


_FILL = f"""x AS MATERIALIZED (SELECT src, (src + 1 + lo + floor({_H.format('src * 12 + k', 5)} * (hi - lo))::BIGINT) % n AS dst FROM (SELECT vec_id AS src, k, n, floor(k * (n - 1) / 12.0)::BIGINT AS lo, floor((k + 1) * (n - 1) / 12.0)::BIGINT AS hi
  FROM embeddings, (SELECT count(*) AS n FROM embeddings), (SELECT unnest(generate_series(0, 11)) AS k)))"""


@query(f"""WITH {DIST}, {_near(3)}, {_FILL}, a AS (SELECT u AS src, v AS dst, d2, 1 AS old FROM near UNION ALL SELECT x.src, x.dst, dist.d2, 0 FROM x JOIN dist ON dist.u = x.src AND dist.v = x.dst WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.u = x.src AND near.v = x.dst))
SELECT src, dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY old DESC, {_H.format('dst', 5)}, dst) AS r FROM a) WHERE old = 1 OR r <= 6""")
def random_fill(spark, d):
    p = _points(spark, d)
    return graph.fill_random_edges(p, knn.knn_graph(p, 3), 6)


# ---- indexes and descents


_SEARCH, _OCCLUSION, _ANGLE = (f"k.d >= {_d('k.e', 'r.e')}", f"{_d('k.e', 'r.e')} <= r.d2", f"(k.d + r.d2 - {_d('k.e', 'r.e')}) / (2 * sqrt(k.d) * sqrt(r.d2)) >= 0.5")
_CANDIDATE = "STRUCT(v BIGINT, d DOUBLE, e FLOAT[], n BOOLEAN)[]"


def _folded(name: str, source: str, test: str) -> str:
    """name(layer, u, v, d2, e, kept, over): each (layer, u)'s candidates in source(layer, u, v, d2, n), folded nearest first; over is the first kept one that rules v out, of pairs that aren't both old."""
    return f"""{name}_r AS MATERIALIZED (SELECT s.*, e.embedding AS e, row_number() OVER (PARTITION BY layer, u ORDER BY d2, v) AS rk FROM {source} s JOIN embeddings e ON e.vec_id = s.v),
{name}_g AS (SELECT 0::BIGINT AS rk, layer, u, []::{_CANDIDATE} AS kept, []::{_CANDIDATE} AS hit, NULL::BIGINT AS v, NULL::DOUBLE AS d2, NULL::FLOAT[] AS e FROM (SELECT DISTINCT layer, u FROM {name}_r)
  UNION ALL
  SELECT rk, layer, u, CASE WHEN len(hit) = 0 THEN list_append(kept, {{'v': v, 'd': d2, 'e': e, 'n': n}}) ELSE kept END, hit, v, d2, e
  FROM (SELECT r.rk, g.layer, g.u, g.kept, r.v, r.d2, r.e, r.n, list_filter(g.kept, lambda k: (k.n OR r.n) AND {test}) AS hit FROM {name}_g g JOIN {name}_r r ON r.layer = g.layer AND r.u = g.u AND r.rk = g.rk + 1)),
{name} AS MATERIALIZED (SELECT layer, u, v, d2, e, len(hit) = 0 AS kept, hit[1] AS over_ FROM {name}_g WHERE rk > 0)"""


def _nearest(name: str, source: str, most: str, order: str = "d2, v") -> str:
    return f"{name} AS MATERIALIZED (SELECT layer, u, v, d2, true AS n FROM (SELECT *, row_number() OVER (PARTITION BY layer, u ORDER BY {order}) AS r FROM {source}) WHERE r <= {most})"


def _both(name: str, source: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT layer, u, v, d2, true AS n FROM {source} UNION SELECT layer, v, u, d2, true FROM {source})"


def _layers_sql(name: str, heap: int, low: int, high: int, angle: bool = False, least: int = 10) -> str:
    """name(layer, u, v, d2) from lay(id, layer): candidates, prune and refill, reverse edges, cap; by the angle rule reverse edges that it lets in, and once more the rule."""
    most = f"CASE layer WHEN 0 THEN {low} ELSE {high} END"
    near = f"{name}_d AS (SELECT a.layer, dist.* FROM dist JOIN lay a ON a.id = u JOIN lay b ON b.id = v AND b.layer = a.layer), {_nearest(f'{name}_n', f'{name}_d', str(heap))}, {_folded(f'{name}_f', f'{name}_n', _ANGLE if angle else _SEARCH)}"
    if not angle:
        return f"{near}, {_nearest(f'{name}_o', f'{name}_f', most, 'kept DESC, d2, v')}, {_both(f'{name}_b', f'{name}_o')}, {_nearest(name, f'{name}_b', most)}"
    own = f"{_nearest(f'{name}_o', f'(SELECT * FROM {name}_f WHERE kept)', most)}, {_both(f'{name}_b', f'{name}_o')}, {_folded(f'{name}_w', f'{name}_b', _ANGLE)}, {_nearest(f'{name}_l', f'{name}_b', str(least))}"
    every = f"{name}_e AS (SELECT layer, u, v, d2 FROM {name}_o UNION SELECT layer, u, v, d2 FROM {name}_w WHERE kept UNION SELECT layer, u, v, d2 FROM {name}_l)"
    return f"{near}, {own}, {every}, {_nearest(f'{name}_c', f'{name}_e', most)}, {_folded(f'{name}_z', f'{name}_c', _ANGLE)}, {name} AS (SELECT * FROM {name}_z WHERE kept)"


def _index_sql(heap: int, low: int, high: int, angle: bool = False) -> str:
    """All edges of a layered index with levels from hashes of ids."""
    return f"""WITH RECURSIVE {DIST}, top AS (SELECT least(floor(ln(count(*)) / ln({high}::DOUBLE))::INTEGER, 9) AS most FROM embeddings),
lev AS MATERIALIZED (SELECT vec_id AS id, least(floor(-ln({_H.format('vec_id', 0)}) * (1.0 / ln({high}::DOUBLE)))::INTEGER, most) AS level FROM embeddings, top),
lay AS MATERIALIZED (SELECT id, unnest(generate_series(0, CASE WHEN id = (SELECT min(id) FROM lev) THEN (SELECT max(level) FROM lev) ELSE level END))::INTEGER AS layer FROM lev),
{_layers_sql('g', heap, low, high, angle)} SELECT layer, u AS src, v AS dst, d2 FROM g"""


def _flooding_sql(heap: int, low: int, high: int, layers: int = 5) -> str:
    """Layers of sets without edges between their points, chosen by (hash, id), as long as a layer has ``high`` points."""
    parts, made = ["alive0 AS MATERIALIZED (SELECT vec_id AS id FROM embeddings)"], []
    for k in range(layers):
        parts.append(_layers_sql(f"g{k}", heap, low if k == 0 else high, high).replace("JOIN lay a", f"JOIN (SELECT id, {k} AS layer FROM alive{k}) a").replace("JOIN lay b", f"JOIN (SELECT id, {k} AS layer FROM alive{k}) b"))
        made.append(f"SELECT layer::INTEGER AS layer, u AS src, v AS dst, d2 FROM g{k}")
        parts.append(f"""o{k} AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY {_H.format('id', 23)}, id) AS r FROM alive{k} WHERE (SELECT count(*) FROM alive{k}) >= {high}),
a{k} AS MATERIALIZED (SELECT r, id, coalesce(list(x), []) AS near FROM o{k} LEFT JOIN (SELECT u, v AS x FROM g{k} UNION SELECT v, u FROM g{k}) ON u = id GROUP BY r, id),
c{k} AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS chosen UNION ALL SELECT a{k}.r, CASE WHEN len(list_intersect(near, chosen)) = 0 THEN list_append(chosen, id) ELSE chosen END FROM c{k} JOIN a{k} ON a{k}.r = c{k}.r + 1),
alive{k + 1} AS MATERIALIZED (SELECT unnest(arg_max(chosen, r)) AS id FROM c{k})""")
    return f"WITH RECURSIVE {DIST}, {', '.join(parts)} {' UNION ALL '.join(made)}"


def _random_sql(degree: int) -> str:
    """start(layer, u, v, d2, n): random edges."""
    return f"""start AS MATERIALIZED (SELECT 0 AS layer, x.u, x.v, d2, true AS n FROM (SELECT src AS u, (src + 1 + lo + floor({_H.format(f'src * {degree} + k', 5)} * (hi - lo))::BIGINT) % n AS v FROM (SELECT vec_id AS src, k, n, floor(k * (n - 1) / {degree}.0::DOUBLE)::BIGINT AS lo,
  floor((k + 1) * (n - 1) / {degree}.0::DOUBLE)::BIGINT AS hi FROM embeddings, (SELECT count(*) AS n FROM embeddings), (SELECT unnest(generate_series(0, {degree - 1})) AS k))) x JOIN dist ON dist.u = x.u AND dist.v = x.v)"""


def _descent_sql(initial: int, reduce: int, outer: int, inner: int, test: str) -> str:
    parts, at = [_random_sql(initial)], "start"
    for o in range(outer):
        for i in range(inner):
            s = f"s{o}_{i}"
            parts += [_folded(s, at, test), f"{s}_e AS (SELECT u, v, min(d2) AS d2 FROM (SELECT u, v, d2 FROM {s} WHERE kept UNION ALL SELECT over_.v, v, {_d('over_.e', 'e')} FROM {s} WHERE NOT kept) WHERE u <> v GROUP BY u, v)",
                f"{s}_t AS MATERIALIZED (SELECT 0 AS layer, x.u, x.v, x.d2, o.u IS NULL AS n FROM {s}_e x LEFT JOIN {at} o ON o.u = x.u AND o.v = x.v)"]
            at = f"{s}_t"
        if o + 1 < outer:
            parts += [_both(f"b{o}", at), _nearest(f"c{o}", f"b{o}", str(reduce))]
            at = f"c{o}"
    parts += [f"ends AS (SELECT layer, u, v, d2, true AS n FROM {at})", _folded("last", "ends", test)]
    return f"WITH RECURSIVE {DIST}, {', '.join(parts)} SELECT u AS src, v AS dst, d2 FROM last WHERE kept"


def _ego_sql(initial: int, loops: int, most: int) -> str:
    parts, at = [_random_sql(initial)], "start"
    for k in range(loops):
        if k:
            parts.append(_both(f"b{k}", at))
            at = f"b{k}"
        reach = f"(SELECT u, v FROM {at} UNION SELECT a.u, b.v FROM {at} a JOIN {at} b ON b.u = a.v WHERE a.u <> b.v)"
        parts += [f"r{k} AS MATERIALIZED (SELECT 0 AS layer, dist.*, true AS n FROM dist SEMI JOIN {reach} x ON x.u = dist.u AND x.v = dist.v)", _folded(f"f{k}", f"r{k}", _OCCLUSION), _nearest(f"g{k}", f"(SELECT * FROM f{k} WHERE kept)", str(most))]
        at = f"g{k}"
    return f"WITH RECURSIVE {DIST}, {', '.join(parts)} SELECT u AS src, v AS dst, d2 FROM {at}"


@query(_index_sql(50, 100, 50))
def layered_index(spark, d):
    """All layers' edges of a layered index."""
    return index.build_layered(_points(spark, d)).edges


@query(_index_sql(40, 16, 8))
def layered_index_refilled(spark, d):
    """Degrees below the number of candidates, so that prune and refill decide."""
    return index.build_layered(_points(spark, d), index.LayeredParams(exact=True, max_build_heap_size=40, lowest_max_degree=16, higher_max_degree=8)).edges


@query(_index_sql(50, 100, 50, angle=True))
def layered_index_angle(spark, d):
    return index.build_layered(_points(spark, d), index.LayeredParams(exact=True, max_cos=0.5)).edges


@query(_flooding_sql(20, 20, 50))
def flooding_index(spark, d):
    return index.build_layered(_points(spark, d), index.LayeredParams(exact=True, flooding=True, max_build_heap_size=20, lowest_max_degree=20)).edges


def _nearest_sql(k: int) -> str:
    """The k nearest points of each point, itself included."""
    return f"SELECT qid, id, d2, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_d('a.embedding', 'b.embedding')} AS d2, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_d('a.embedding', 'b.embedding')}, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank <= {k}"


@query(_nearest_sql(5))
def index_queries(spark, d):
    """Greedy searches of the layered index: on few points they meet the exact neighbours."""
    p = _points(spark, d)
    made = index.build_layered(p, index.LayeredParams(exact=True, max_build_heap_size=20, lowest_max_degree=30, higher_max_degree=10))
    return made.knn_query(p.withColumnRenamed("id", "qid"), 5, heap=50)


@query(_nearest_sql(5))
def inserted_index_queries(spark, d):
    """Searches of an index of the even ids into which the odd ones were inserted: on few points they meet the exact neighbours."""
    p = _points(spark, d)
    made = index.build_layered(p.where("id % 2 = 0"), index.LayeredParams(max_build_heap_size=20, lowest_max_degree=30, higher_max_degree=10)).insert(p)
    return made.knn_query(p.withColumnRenamed("id", "qid"), 5, heap=50)


@query(_nearest_sql(10))
def metric_tree_knn(spark, d):
    """Exact neighbours of all points through a vantage-point tree."""
    p = _points(spark, d)
    return metric.tree_knn(metric.build_tree(p, leaf=64), p.withColumnRenamed("id", "qid"), 10)


@query(_descent_sql(20, 20, 2, 3, _OCCLUSION))
def relative_descent(spark, d):
    return descent.relative_descent(_points(spark, d), initial=20, reduce=20, outer=2, inner=3)


@query(_descent_sql(20, 20, 1, 2, _ANGLE))
def angle_descent(spark, d):
    return descent.relative_descent(_points(spark, d), initial=20, reduce=20, outer=1, inner=2, max_cos=0.5)


@query(_ego_sql(10, 2, 50))
def ego_descent(spark, d):
    return descent.ego_descent(_points(spark, d), initial=10, loops=2, radius=2)
