"""Corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

Quality classifier, line dedup, near-dedup, mixing by source, and encoding into pieces. Every stage is a
function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laplens.llm import lines, mixing, neardup, pieces, quality
from laplens.llm.common import table, tokenizer_file
from laplens.session import hold


def with_lengths(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, exactly or within two edits, go; no document does."""
    return with_lengths(lines.dedup_lines(docs, min_chars=None))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return with_lengths(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each text."""
    return pieces.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("quality classifier", drop_poor), ("line dedup", drop_repeated_lines), ("near-dedup", drop_near_copies),
          ("source mix", mix_sources), ("piece encoding", encode)]

#: The classifier's arithmetic and the edit and set similarities are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = hold(stage(spark, docs, sf_dir), "stage")
    return docs
