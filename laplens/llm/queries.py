"""One query per operator: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laplens.llm import align, exact, html_text, lexical, lines, mixing, neardup, pieces, quality, secrets, setjoin, tokens, topk
from laplens.llm.common import table, text_of, tokenizer_file
from laplens.llm.sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark, d):
    return quality.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op2_secret_scan(spark, d):
    return secrets.scan_secrets(table(spark, d, "documents"))


@query
def op3_token_counts(spark, d):
    return tokens.count_tokens(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op4_near_dedup(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"))


@query
def op5_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.size(F.split(text_of("text"), "\n")).cast("long").alias("n_lines"))
    rows = lines.numbered(docs, "row")
    gone = lines.removed_lines(rows, "row")
    none = F.expr("CAST(array() AS ARRAY<INT>)")
    return (rows.select("row", "doc_id", "n_lines").join(gone, "row", "left")
            .select("doc_id", "n_lines", F.coalesce("exact", none).alias("exact_lines"), F.coalesce("near", none).alias("near_lines")))


@query
def op6_top_k(spark, d):
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op7_exact_dedup(spark, d):
    return exact.exact_duplicates(table(spark, d, "documents"))


@query
def op8_source_mix(spark, d):
    return mixing.mix(table(spark, d, "documents")).drop("source")


@query
def op9_pieces(spark, d):
    return pieces.encode_texts(table(spark, d, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query
def op10_main_text(spark, d):
    return html_text.extract_text(table(spark, d, "pages"))


@query
def op11_jaccard_join(spark, d):
    return setjoin.jaccard_join(table(spark, d, "documents"))


@query
def op12_lexical_search(spark, d):
    return lexical.lexical_search(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op13_token_alignment(spark, d):
    return align.align_tokens(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
