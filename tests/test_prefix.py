"""Running sums and maxima over ordered ranges."""

import numpy as np
from pyspark.sql import functions as F

from vecloom.operators import quality, relational


def test_running_sum_and_max_before(spark):
    rng = np.random.default_rng(3)
    data = [(None if g == 3 else int(g), int(x), k, int(v)) for k, (g, x, v) in enumerate(zip(rng.integers(0, 4, 500), rng.integers(0, 50, 500), rng.integers(-20, 99, 500)))]
    df = spark.createDataFrame(data, "g int, x int, k int, v long")
    total, want = 0, {}
    for g, x, k, v in sorted(data, key=lambda r: (r[1], r[2])):
        total += v
        want[k] = total
    assert {r.k: r.total for r in relational.running_sum(df, ["x", "k"], "v").collect()} == want
    got = {r.k: r.before for r in relational.max_before(df, ["g"], ["x", "k"], "v").collect()}
    assert got == {k: max((b[3] for b in data if b[0] == g and (b[1], b[2]) < (x, k)), default=None) for g, x, k, _ in data}
    assert relational.max_before(df.limit(0), ["g"], ["x", "k"], "v").count() == 0 and relational.running_sum(df.limit(0), ["x"], "v").count() == 0


def test_pareto_of_one_large_group(spark):
    df = spark.range(100_000).select(F.lit("one").alias("g"), "id", F.pmod(F.col("id") * 7919, F.lit(100_003)).alias("x"), F.pmod(F.col("id") * 104_729, F.lit(99_991)).alias("y"))
    ranged = relational.max_before(df, ["g"], ["x", "id"], "y", "m")
    assert ranged.select(F.spark_partition_id().alias("p")).distinct().count() > 1 or int(spark.conf.get("spark.sql.shuffle.partitions")) == 1
    best, want = 0.0, set()
    for r in sorted(df.collect(), key=lambda r: (r.x, r.id)):
        if r.y > best:
            best = r.y
            want.add(r.id)
    assert {r.id for r in quality.pareto_frontier(df, "x", "y", "g", "id").collect()} == want
