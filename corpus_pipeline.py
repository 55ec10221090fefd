"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet to the shared folder and rereads it as the next stage's docs. Columns keep their
values, whatever their names; an empty table stays empty; texts are taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import mih, mixing, packing, quality, templates
from vecloom.llm.common import scratch_path
from vecloom.llm.queries import vocabulary_path

REMEMBERED = 100_000  # words that a packing worker remembers: up to four workers that earlier stages left idle share an executor's memory with them


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier keeps.

    Null texts are judged as empty ones; rows that repeat an id are judged each on its own text.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_template_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less lines whose templates recur across documents; n_chars follows the text.

    Null texts stay null; a text that loses all its lines stays as an empty one.
    """
    out = templates.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more): that with the smallest id.

    Texts without words, null ones too, are copies of each other. Rows without id all stay.
    """
    return mih.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources are repeated, one and a half times at most, toward uniform entropy.

    Null sources are one source; texts without words are taken once.
    """
    return mixing.mixed_rows(docs, max_repeats=1.5)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with a checksum of their ids; a text without tokens has its end's token."""
    return packing.digest(packing.pack(docs, vocabulary_path(), remembered=REMEMBERED))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_template_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

# SQL can't express the classifier, the fingerprints and the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
