"""Trees and layered indexes kept up to date over streams of points: MST(A and B) = MST(MST(A) and the new edges)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import block_d2
from ..operators import mst
from ..operators.kernels import kruskal
from ..operators.knn import _cells
from ..plans.index import Index, LayeredParams, build_layered
from ..session import release, save


class StreamingTree:
    """The minimum spanning tree of all points seen, as batches arrive."""

    def __init__(self) -> None:
        self.points: DataFrame | None = None
        self.tree: DataFrame | None = None
        self.batches = 0

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Adds points(id, features); ids seen before are passed over, so a batch given again changes nothing."""
        new = batch.select("id", "features").dropDuplicates(["id"])
        if self.points is not None:
            new = new.join(self.points.select("id"), "id", "left_anti")
        new = save(new, "batch")
        if not new.head(1):
            return
        edges = mst.exact_tree(new)
        if self.points is not None:

            def fn(a, x, b, y, same):
                if not len(a):
                    return {"u": a, "v": b, "d2": block_d2(x, y)[:0].ravel()}
                d = block_d2(x, y)
                i, j = (d == d).nonzero()
                pairs = {"u": a[i], "v": b[j], "d2": d[i, j]}
                u, v = pairs["u"].copy(), pairs["v"].copy()
                keep = kruskal(u, v, pairs["d2"])
                return {"u": u[keep], "v": v[keep], "d2": pairs["d2"][keep]}

            cross = _cells(new, self.points, fn, "u long, v long, d2 double", 1024)
            cross = cross.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d2")
            edges = mst.forest(edges.unionByName(cross).unionByName(self.tree))
        tree = save(edges, "tree")
        release(self.tree)
        self.tree = tree
        self.batches += 1
        # batches' tables stand side by side; now and then they become one, so that a batch doesn't rewrite all points
        both = new if self.points is None else self.points.unionByName(new)
        self.points = save(both, "points") if self.batches % 32 == 0 else both

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()


class StreamingIndex:
    """A layered index of all points seen, as batches arrive; the first batch is built, later ones are inserted."""

    def __init__(self, params: LayeredParams | None = None, index: Index | None = None) -> None:
        self.params, self.index = params, index

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Adds points(id, features); ids seen before are passed over, so a batch given again changes nothing."""
        if self.index is not None:
            self.index = self.index.insert(batch)
        elif batch.head(1):
            self.index = build_layered(batch.select("id", "features").where("id IS NOT NULL").groupBy("id").agg(F.min("features").alias("features")), self.params)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
