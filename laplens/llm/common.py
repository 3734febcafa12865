"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and white space as every contract here defines them: ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def uniform(*parts: str | Column) -> Column:
    """A number strictly between 0 and 1 that depends only on ``parts``."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` begins with it: safe for columns beside those of a table."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file, which every worker has."""
    import public_tokenizers

    return public_tokenizers.path(name)
