"""Mixing sources to target weights by temperature, with DataFrame functions only.

Source shares of tokens are raised to an exponent in [0, 1], found by bisection:
the smallest one at which the mix's entropy is at most the target and no source is
repeated more than the limit. Each source then fills its share of the budget from
seeded block permutations of its documents, one per epoch: documents fall into
4096 blocks by the leading digits of a hash, blocks follow each other, and a
document's place within its block comes from the rest of the hash. So only sums
of blocks are ordered over a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"  # tokens of the mix are words
_LEVELS, _ROUNDS = 4, 8  # bisection steps answered by one job, and jobs


def token_table(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, n_tokens): words of each whole text; null text counts 0, null source is ''."""
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), words.alias("n_tokens"))


def _measures(alpha: float) -> list[Column]:
    z = F.sum(F.exp(F.lit(alpha) * F.col("lnp")))
    s = F.sum(F.exp(F.lit(alpha) * F.col("lnp")) * F.col("lnp"))
    return [z, s]


def exponent(shares: DataFrame, entropy_gap: float, max_repeats: float, cover: bool) -> tuple[float, float]:
    """(alpha, Z): shares has one row per source with lnp, the log of its share; Z is the sum of p ** alpha.

    The target entropy lies ``entropy_gap`` (0 to 1) of the way from the natural one to
    the uniform one. With cover every source appears in full once at least, so the
    budget follows from alpha; else the budget is the number of tokens there are. Each
    job sums a few numbers over all sources; only those reach the driver.
    """
    first = shares.agg(F.count("*").alias("n"), F.max("lnp").alias("hi"), F.min("lnp").alias("lo"), F.sum(F.exp("lnp") * F.col("lnp")).alias("s")).first()
    if not first.n:
        return 1.0, 1.0
    natural = -first.s
    target = natural + entropy_gap * (math.log(first.n) - natural)

    def evaluate(alphas: list[float]) -> list[tuple[float, float]]:
        row = shares.agg(*[m for a in alphas for m in _measures(a)]).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(alphas))]

    def fits(alpha: float, z: float, s: float) -> bool:
        repeats = math.exp((1 - alpha) * (first.hi - first.lo)) if cover else math.exp((alpha - 1) * first.lo) / z
        return math.log(z) - alpha * s / z <= target and repeats <= max_repeats

    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        step = (hi - lo) / (1 << _LEVELS)
        alphas = [lo + k * step for k in range(1, 1 << _LEVELS)]
        known = dict(zip(range(1, 1 << _LEVELS), evaluate(alphas)))
        a, b = 0, 1 << _LEVELS
        while b - a > 1:  # bisection among the midpoints of the next _LEVELS steps
            m = (a + b) // 2
            a, b = (a, m) if fits(lo + m * step, *known[m]) else (m, b)
        lo, hi = lo + a * step, lo + b * step
    return hi, evaluate([hi])[0][0]


def mix(tokens: DataFrame, seed: int = 1, entropy_gap: float = 0.5, max_repeats: float = 4.0, cover: bool = False) -> DataFrame:
    """(id, source, epoch, n_tokens, start) for every chosen copy of a document.

    ``tokens`` has (id, source, n_tokens). start counts the source's tokens before
    the copy; copies with start below the source's budget are chosen, so the last may
    pass it. Without cover the budgets sum to the tokens there are (rounded down by
    source); with cover they grow until every document appears, which includes those
    without tokens. Sources without any token are left out without cover. Rows that
    repeat an id are documents of their own and lie next to each other.
    """
    tokens = materialize(tokens, "tokens")
    totals = tokens.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    grand = totals.agg(F.sum("have")).first()[0] or 0
    totals = materialize(totals.withColumn("lnp", F.when(F.col("have") > 0, F.log(F.col("have") / F.lit(float(max(grand, 1)))))), "sources")
    shares = totals.where("have > 0").select("lnp")
    alpha, z = exponent(shares, entropy_gap, max_repeats, cover)
    if cover:
        top = shares.agg(F.max("lnp")).first()[0] or 0.0
        # tokens such that the source above its weight the most appears once
        want = F.greatest(F.col("have"), F.floor(F.col("have") * F.exp((1 - F.lit(alpha)) * (F.lit(top) - F.col("lnp")))))
    else:
        want = F.floor(F.lit(float(grand)) * F.exp(F.lit(alpha) * F.col("lnp")) / F.lit(z))
    last = F.when(F.col("budget") > 0, F.floor((F.col("budget") - 1) / F.col("have"))).otherwise(0)
    plan = totals.withColumn("budget", F.coalesce(want, F.lit(0)).cast("long")).withColumn("last", last.cast("int"))
    plan = materialize(plan.select("source", "have", "budget", "last"), "budgets")
    copies = tokens.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("last"))))
    code = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    copies = copies.withColumn("code", code).withColumn("block", F.substring("code", 1, 3))
    keys = ["source", "epoch", "block"]
    sums = copies.groupBy(*keys).agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*keys, F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("code", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
    placed = copies.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bases, keys)
    start = F.col("epoch") * F.col("have") + F.col("base") + F.col("inside")
    chosen = placed.withColumn("start", start.cast("long"))
    chosen = chosen.where("start < budget OR epoch = 0" if cover else "start < budget")
    return chosen.select("id", "source", F.col("epoch").cast("long").alias("epoch"), "n_tokens", "start")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df``, each as often as the mix takes it; rows that share an id as often as the one taken most.

    Null sources are a source '', null and empty texts count no tokens and are taken once, null ids are one id.
    Columns stay as they are, whatever their names; an empty table stays empty.
    """
    taken = mix(token_table(df, id_col, source_col, text_col), cover=True, **options)
    times = taken.groupBy("id", "source", "epoch").agg(F.lit(1).alias("one")).groupBy("id").agg(F.max("epoch").alias("more"))
    times = times.select(F.col("id").alias("taken"), (F.col("more") + 1).cast("int").alias("times"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("id"))
    joined = rows.join(times, F.col("id").eqNullSafe(F.col("taken")))
    copies = joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return copies.select(*[F.col("row")[c].alias(c) for c in df.columns])


# The query's SQL: the same bisection over 32 steps.
SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS have, ln(sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM t)::DOUBLE) AS lnp FROM t GROUP BY source HAVING sum(n_tokens) > 0),
g AS MATERIALIZED (SELECT list(lnp) AS l, min(lnp) AS low, count(*) AS n, -sum(exp(lnp) * lnp) AS h, sum(have)::DOUBLE AS total FROM s),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM (SELECT step, lo, hi, m, ln(z) - m * w / z <= h + 0.5 * (ln(n) - h) AND exp((m - 1) * low) / z <= 4 AS ok
    FROM (SELECT b.*, (lo + hi) / 2 AS m, g.h, g.low, g.n,
            list_sum(list_transform(g.l, lambda x: exp((lo + hi) / 2 * x))) AS z,
            list_sum(list_transform(g.l, lambda x: exp((lo + hi) / 2 * x) * x)) AS w FROM b, g WHERE step < 32))),
a AS (SELECT hi AS alpha, list_sum(list_transform(g.l, lambda x: exp(hi * x))) AS z, g.total FROM b, g WHERE step = 32),
p AS (SELECT source, have, floor(a.total * exp(a.alpha * lnp) / a.z)::BIGINT AS budget FROM s, a),
c AS MATERIALIZED (SELECT doc_id AS id, t.source, n_tokens, have, budget, e AS epoch, md5('1:' || e || ':' || doc_id) AS code
  FROM t JOIN p USING (source), LATERAL (SELECT unnest(generate_series(0, CASE WHEN budget > 0 THEN (budget - 1) // have ELSE 0 END)) AS e)),
o AS (SELECT *, epoch * have + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY code, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT id AS doc_id, source, epoch::BIGINT AS epoch, n_tokens, start::BIGINT AS start FROM o WHERE start < budget
"""
