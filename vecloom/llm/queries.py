"""The registered corpus queries, opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, embeddings, exact, fingerprint, mih, mixing, packing, pages, quality, runs, templates, tokens, warc

VOCABULARY = "word_bpe_49k.json"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine >= 0.95."""
    return embeddings.near_dedup(_table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """128-bit fingerprints of every document and of its edited text, with their likeness."""
    return fingerprint.edit_report(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged WARC files and read back by range."""
    found = warc.round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sources mixed half-way to uniform entropy, at most 4 epochs, by words."""
    table = mixing.token_table(_table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixing.mix(table).withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the lines whose templates recur in three documents or more."""
    return templates.report(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality from its text, its source and its source's language."""
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.digest(packing.pack(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op10_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit SimHash classes of all documents, 3-word shingles, at most 2 bits apart."""
    return mih.near_dedup(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between two tokenizers' tokens in every whole text, scored by the pairs' counts over all."""
    return alignment.align(_table(spark, sf_dir, "documents"), *map(vocabulary_path, ALIGNED))[0]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three periods and 24 words in every whole text, of which a tenth is made periodic."""
    return runs.digest(runs.periodic_runs(runs.made_periodic(_table(spark, sf_dir, "documents"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal without white space, and the row of each that stays."""
    return exact.report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality": op7_quality,
        "op8_html_text": op8_html_text,
        "op9_packing": op9_packing,
        "op10_simhash_mih": op10_simhash_mih,
        "op11_alignment": op11_alignment,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_exact_dedup": op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op4_mixing": mixing.SQL, "op6_line_dedup": templates.SQL, "op13_exact_dedup": exact.SQL}
