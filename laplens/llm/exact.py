"""Exact dedup by content-defined chunk recipes.

A text is cut where its content says so: at the first sentence end after ``min_chunk`` characters, or
at ``max_chunk``. Each distinct chunk gets one identifier, which is verified: a 64-bit hash stands for a
chunk only where no other chunk of the corpus has it, else its SHA-256 does. Two texts are equal exactly
when their ordered identifier lists are. The text itself moves once, chunk by chunk, with equal chunks
merged before the shuffle; grouping and joining work on the lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.llm.common import SPACE, text_of
from laplens.session import hold, release


def chunk_pattern(min_chunk: int, max_chunk: int) -> str:
    return rf"(?s).{{{min_chunk},{max_chunk - 1}}}?[.!?\n] |.{{1,{max_chunk}}}"


def _short_id(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chunk: int = 256,
                     max_chunk: int = 2048, id_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id`` (smallest id among equal texts), ``group_size``,
    ``kept`` and ``text_sha256``.

    Texts are compared after each run of white space becomes one space. A null text is empty, and empty texts
    are equal to each other. Nulls among ids come last: a group keeps a null id only if it has no other. Rows
    that repeat an id are counted each and share its verdict. Further columns are not read. An empty table gives
    no rows. ``id_bits`` shortens the chunk hashes, to exercise the way for hashes that collide."""
    chunks = hold(
        docs.select(F.col(id_col).alias("id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("body"))
        .select("id", F.sha2("body", 256).alias("text_sha256"),
                F.regexp_extract_all("body", F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0)).alias("chunks")),
        "chunks", compression="zstd")
    shared = hold(
        chunks.select(F.explode("chunks").alias("chunk"))
        .select(_short_id(F.col("chunk"), id_bits).alias("short"), "chunk").distinct()
        .groupBy("short").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("short"), "shared-ids")
    plain = F.transform("chunks", lambda c: _short_id(c, id_bits).cast("string"))
    if shared.isEmpty():
        recipes = chunks.select("id", "text_sha256", plain.alias("recipe"))
    else:
        keyed = chunks.withColumn("row", F.monotonically_increasing_id())
        touched = (keyed.select("row", F.explode(F.transform("chunks", lambda c: _short_id(c, id_bits))).alias("short"))
                   .join(shared, "short", "left_semi").select("row").distinct().withColumn("hit", F.lit(True)))
        verified = F.transform("chunks", lambda c: F.concat(_short_id(c, id_bits).cast("string"), F.lit(":"), F.sha2(c, 256)))
        recipes = (keyed.join(touched, "row", "left")
                   .select("id", "text_sha256", F.when(F.col("hit"), verified).otherwise(plain).alias("recipe")))
    recipes = hold(recipes, "recipes")
    release(chunks, shared)
    # written first: directly above its own aggregate the join could not be split where one recipe has most of the rows
    groups = hold(recipes.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return (recipes.join(groups, "recipe")
            .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))
