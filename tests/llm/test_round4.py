"""Corpus operators at larger sizes: what the driver holds, and what each step finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecloom.llm import mih, tokens
from vecloom.llm.queries import vocabulary_path

from .test_operators import docs, prose


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_broadcast_no_table_of_the_corpus(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    texts = [prose(k % 20, 40 + k % 3) for k in range(60)]
    found = mih.near_dedup(docs(spark, texts))
    rows = spark.createDataFrame([(k, [k * 7919], k % 5) for k in range(50)], "id long, fp array<long>, component long")
    made = [found, mih.star_links(rows, 1, 2, 2), mih.hamming_links(rows, 1, 2, 2, "component")]
    assert all("SortMergeJoin" in plan_of(x) and "Broadcast" not in plan_of(x) for x in made)
    assert found.count() == 60


def test_keep_one_finds_near_copies_by_its_index(spark, monkeypatch):
    """With no min-hash key shared, all pairs within 5 bits are found, by the tables of segments."""
    made = mih.set_fingerprints
    alone = lambda *a, **b: made(*a, **b).withColumn("search", F.array(F.col("id")))
    monkeypatch.setattr(mih, "set_fingerprints", alone)
    texts = [t for k in range(20) for t in (prose(300 + k, 300), prose(300 + k, 300) + " end")]
    df = docs(spark, texts)
    fp = {r.id: r.fp[0] & (2**64 - 1) for r in made(df, "doc_id", "text").collect()}
    near = [k for k in range(1, 40, 2) if (fp[k] ^ fp[k - 1]).bit_count() <= 5]
    assert len(near) >= 15
    kept = {r.doc_id for r in mih.keep_one(df).collect()}
    assert kept == set(range(40)) - set(near)


def test_bounded_memory_gives_the_same_ids():
    texts = [prose(k, 200) + f" own{k}word Zq{k}x" for k in range(30)]
    small, large = tokens.Counter(vocabulary_path(), 100), tokens.Counter(vocabulary_path())
    assert [small.ids(t) for t in texts] == [large.ids(t) for t in texts]
    assert len(small.known) <= len(small.known.whole) + 1 < len(large.known)
