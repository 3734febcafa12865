"""Problem tags, nested records, capped logs and text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.operators.ordered import first_k, number
from laplens.operators.pace import top_rows


def tag_rows(df: DataFrame, ids: list[str], tags: Column, out: str = "tag") -> DataFrame:
    return df.select(*ids, F.explode(tags).alias(out))


def dictionary_totals(tag_table: DataFrame, tag: str, dictionary: DataFrame) -> DataFrame:
    """Count per dictionary tag, zero where unused; tags outside the dictionary are ignored."""
    counts = tag_table.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    return dictionary.join(counts, tag, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def nest(df: DataFrame, keys: list[str], order: list[Column], cols: list[str], out: str = "items",
         page: int = 10_000) -> DataFrame:
    """Children as arrays of structs in order. An array holds at most ``page`` children; the rest of a
    longer list follows on further pages, so no row grows with its group."""
    placed = number(df, keys, order, "_rn")
    item = F.struct("_rn", *cols)
    grouped = (placed.withColumn("page", F.floor((F.col("_rn") - 1) / page))
               .groupBy(*keys, "page").agg(F.sort_array(F.collect_list(item)).alias("_a")))
    trimmed = F.transform("_a", lambda x: F.struct(*[x[c].alias(c) for c in cols]))
    return grouped.withColumn(out, trimmed).drop("_a")


def unnest(df: DataFrame, items: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def nested_log_rows(df: DataFrame, col: str, outer: str, inner: str, entry: str) -> DataFrame:
    """Map of map of lists to rows with the list position."""
    a = df.select(F.explode(col).alias(outer, "_m"))
    b = a.select(outer, F.explode("_m").alias(inner, "_l"))
    return b.select(outer, inner, F.posexplode("_l").alias("pos", entry))


def capped_log(df: DataFrame, keys: list[str], entry: str, order: Column, keep: int) -> DataFrame:
    """Exact repeats removed (the first stays), then the latest ``keep`` entries per group."""
    first = df.groupBy(*keys, entry).agg(F.min(order).alias("_at"))
    return first_k(first, keys, [F.col("_at").desc()], keep, "recency").drop("_at")


def recall(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Latest ``k`` rows per group."""
    return first_k(df, keys, order, k, "recency")


def distinct_text(df: DataFrame, keys: list[str], col: str, text: str = "members", size: str = "n_members") -> DataFrame:
    """Distinct values of a column with a small domain as sorted text, with their number."""
    names = F.array_sort(F.collect_set(F.col(col).cast("string")))
    return df.groupBy(*keys).agg(F.array_join(names, ", ").alias(text), F.size(names).cast("long").alias(size))


def recall_context(insights: DataFrame, general: DataFrame, summaries: DataFrame, circuit: str = "All", rider: str = "All",
                   order: str = "at", own: int = 5, shared: int = 4, window: int = 6, recent: int = 3) -> DataFrame:
    """What is remembered for a circuit and rider: (part, circuit, rider, recency, entry).

    ``insights`` (circuit, rider, entry, ``order``): the latest ``own`` of each rider asked for, none where the circuit is
    "All". ``general`` (entry): the latest ``shared``. ``summaries`` (circuit, entry): of the latest ``window`` the latest
    ``recent`` that are about this circuit or about all. Equal places go by the entry."""
    latest = [F.col(order).desc(), F.col("entry")]
    about = F.lit(circuit != "All") & (F.col("circuit") == circuit) & (F.lit(rider == "All") | (F.col("rider") == rider))
    mine = first_k(insights.filter(about), ["circuit", "rider"], latest, own, "recency").withColumn("part", F.lit("insights"))
    wide = top_rows(general, latest, shared).withColumnsRenamed({"position": "recency"}).withColumn("part", F.lit("general"))
    fits = F.lit(circuit == "All") | F.col("circuit").isin("All", circuit)
    said = top_rows(top_rows(summaries, latest, window).drop("position").filter(fits), latest, recent).withColumnsRenamed({"position": "recency"})
    missing = F.lit(None).cast("string")
    return (mine.select("part", "circuit", "rider", "recency", "entry")
            .unionByName(wide.select("part", missing.alias("circuit"), missing.alias("rider"), "recency", "entry"))
            .unionByName(said.select(F.lit("summaries").alias("part"), "circuit", missing.alias("rider"), "recency", "entry")))


def text_block(df: DataFrame, order: list[Column], k: int, shown: Column, out: str, sep: str = "\n") -> DataFrame:
    """The first ``k`` rows as one text, a row a line, in order; one row also where there is none."""
    lines = F.sort_array(F.collect_list(F.struct("position", shown.alias("s"))))  # k rows
    return top_rows(df, order, k).agg(F.array_join(F.transform(lines, lambda x: x["s"]), sep).alias(out))
