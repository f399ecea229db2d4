"""The corpus pipeline: documents pass five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import langid, line_dedup, minhash, packing, quality
from folioscope.session import materialize, ship, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as empty ones; an empty table
    stays empty; columns of any name pass through (as in all stages but the last)."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without a letter go."""
    ship(spark)
    return langid.keep_languages(docs, langid.train(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have; what loses every line with words goes, rows with a
    null doc_id or text stay as they are."""
    ship(spark)
    return line_dedup.remove_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group of near-duplicates. Rows that repeat a doc_id are one document
    and stay or go together; rows with a null doc_id and empty texts stay."""
    ship(spark)
    gone = materialize(minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped").alias("g")
    return docs.alias("d").join(gone, F.col("d.doc_id").cast("long") == F.col("g.doc_id"), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces, in token ids and one end id each, in bins; null texts are an end id alone."""
    import public_tokenizers

    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The stages learn models and align lines, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
