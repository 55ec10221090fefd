"""Points inserted into a built index: recall like that of a build, degrees kept, repeats passed over."""

import numpy as np
import pytest

from vecloom import sources, streaming
from vecloom.operators import knn
from vecloom.plans import index

PARAMS = {"max_build_heap_size": 20, "lowest_max_degree": 20, "higher_max_degree": 8}


def recall_of(spark, made, points, k=5):
    queries = points.where("id % 10 = 0").withColumnRenamed("id", "qid")
    truth = knn.knn_query(points, queries, k)
    return knn.recall(made.knn_query(queries, k, heap=40), truth, ("qid", "id")).first().recall


@pytest.mark.parametrize("params", [{}, {"max_cos": 0.5}])
def test_half_inserted_index_finds_as_much(spark, params):
    points = sources.points_from_numpy(spark, np.random.default_rng(4).standard_normal((800, 8)))
    rule = index.LayeredParams(**PARAMS, **params)
    half = index.build_layered(points.where("id < 400"), rule)
    grown = half.insert(points, batches=2)  # the first half's ids are passed over
    assert grown.points.count() == 800 and grown.levels.count() == 800 and grown.levels.select("id").distinct().count() == 800
    degrees = {(r.layer, r.src): r["count"] for r in grown.edges.groupBy("layer", "src").count().collect()}
    assert all(n <= (20 if layer == 0 else 8) for (layer, _), n in degrees.items()) and {s for layer, s in degrees if layer == 0} == set(range(800))
    assert grown.edges.groupBy("layer", "src", "dst").count().where("count > 1 OR src = dst").count() == 0
    reached = {(r.id, k) for r in grown.levels.collect() for k in range(r.level + 1)}
    assert {(r[i], r.layer) for r in grown.edges.collect() for i in ("src", "dst")} <= reached
    whole = index.build_layered(points, rule)
    assert recall_of(spark, grown, points) >= recall_of(spark, whole, points) - 0.02


def test_stream_of_batches(spark):
    points = sources.points_from_numpy(spark, np.random.default_rng(6).standard_normal((240, 4)))
    kept = streaming.StreamingIndex(index.LayeredParams(**PARAMS))
    kept.update(points.limit(0))
    assert kept.index is None
    for k, low in enumerate((0, 120, 120)):
        kept.update(points.where(f"id >= {low} AND id < {low + 120}"), k)
    assert kept.index.points.count() == 240 and recall_of(spark, kept.index, points) >= 0.95
    same = kept.index
    kept.update(points, 3)
    assert kept.index.edges.count() == same.edges.count()
