"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's words are dealt into blocks by a hash. A source's quota is an exact number of drawn blocks
(whole passes over its blocks, then part of one more pass in permuted order, the last block cut at the quota).
A tree over the output shards splits every source's number of drawn blocks: at each node the left half's part
is a hypergeometric draw among the slots of both halves, so a source's parts over the shards follow the
multivariate hypergeometric law and sum up to its quota. Each shard then takes its own range of the source's
permuted blocks; ranges are disjoint. All that travels apart from the documents' sizes is one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.llm.common import WORD, text_of, uniform, unused
from laplens.session import hold

SUPER = 1024


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))


def source_targets(units: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size, target, quota, from rows with a source and a number of ``words``. Sources in order of code points (null last) take ``weights`` in turn
    and share all words; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight until none is above."""
    totals = units.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranged = hold(totals.repartitionByRange(F.col("source").asc_nulls_last())
                  .select("*", F.spark_partition_id().alias("slice")), "sources")
    before = (ranged.groupBy("slice").count()  # one row per partition
              .select("slice", (F.sum("count").over(Window.orderBy("slice")) - F.col("count")).alias("before")))
    place = F.row_number().over(Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = hold(ranged.join(before, "slice").select("source", "source_size", weight.alias("weight")), "weights")
    top, unit = F.col("source_size") * float(cap), -1.0
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    raised = (total or 0) / all_weights if all_weights else 0.0
    while raised > unit:  # each turn caps at least one more source; one row comes back from it
        unit = raised
        capped, free = weighed.agg(F.sum(F.when(top <= F.col("weight") * unit, top)),
                                   F.sum(F.when(top > F.col("weight") * unit, F.col("weight")))).first()
        raised = (total - (capped or 0.0)) / free if free else unit
    target = F.least(top, F.col("weight") * unit)
    return weighed.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("quota"))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` without replacement from ``total`` are among the ``marked``: the value at ``u`` of
    the distribution function. The sum runs over the support within 8 deviations of the mean."""
    mean = draws * marked / total
    dev = F.sqrt(mean * (1 - marked / total) * (total - draws) / F.greatest(total - 1, F.lit(1))) * 8 + 8
    low = F.greatest(F.lit(0), draws - (total - marked), F.floor(mean - dev)).cast("long")
    high = F.least(draws, marked, F.ceil(mean + dev)).cast("long")

    def log_weight(x: Column, last: Column) -> Column:  # from the weight at x - 1
        return F.when(x == low, F.lit(0.0)).otherwise(
            last + F.log(((marked - x + 1) * (draws - x + 1)).cast("double")) - F.log((x * (total - marked - draws + x)).cast("double")))

    def gather(state: Column, x: Column) -> Column:
        w = log_weight(x, state["w"])
        top = F.greatest(state["top"], w)
        return F.struct(w.alias("w"), top.alias("top"), (state["sum"] * F.exp(state["top"] - top) + F.exp(w - top)).alias("sum"))

    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("top"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(F.sequence(low, high), start, gather, lambda s: s["top"] + F.log(s["sum"]))

    def seek(state: Column, x: Column) -> Column:
        w = log_weight(x, state["w"])
        at = state["at"] + F.exp(w - state["whole"])
        return F.struct(w.alias("w"), at.alias("at"), F.when(at < u, x + 1).otherwise(state["found"]).alias("found"), state["whole"].alias("whole"))

    begin = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("at"), low.alias("found"), whole.alias("whole"))
    return F.least(high, F.aggregate(F.sequence(low, high), begin, seek, lambda s: s["found"]))


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, draws) to (source, shard, draws) over 2 ** levels shards. A shard has twice the slots it needs on
    average, so no shard gets more than twice its even part of a source, rounded up."""
    nodes = quotas.select("source", F.lit(0).cast("long").alias("node"), "draws",
                          F.ceil(F.col("draws") * 2 / float(1 << levels)).cast("long").alias("slots"))
    for level in range(levels):
        half = F.col("slots") * (1 << (levels - level - 1))
        nodes = (nodes.withColumn("total", half * 2).withColumn("half", half)
                 .withColumn("u", uniform(F.lit(seed), F.lit(level), F.col("source"), F.col("node")))
                 .withColumn("left", F.when(F.col("draws") == 0, F.lit(0).cast("long"))
                             .otherwise(hypergeometric(F.col("total"), F.col("half"), F.col("draws"), F.col("u"))))
                 .select("source", "slots", F.explode(F.array(
                     F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("draws")),
                     F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("draws") - F.col("left")).alias("draws")))).alias("n"))
                 .select("source", "slots", "n.node", "n.draws"))
    return nodes.select("source", F.col("node").alias("shard"), "draws")


def _running(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running sum before the row, in permuted order, without a window over a whole source: within groups of
    about SUPER blocks, then over the groups."""
    group = Window.partitionBy(*keys, "super").orderBy("perm", "block")
    rows = rows.withColumn("__in", F.sum(value).over(group.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    groups = rows.groupBy(*keys, "super").agg(F.sum(value).alias("__n"))
    order = Window.partitionBy(*keys).orderBy("super").rowsBetween(Window.unboundedPreceding, 0)
    starts = groups.select(*keys, "super", (F.sum("__n").over(order) - F.col("__n")).alias("__before"))
    return rows.join(starts, [*keys, "super"]).withColumn("before_" + value, F.col("__in") + F.col("__before")).drop("__in", "__before")


def draws(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", levels: int = 4,
          block_words: int = 65_536, seed: int = 42, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """What the mix draws from each distinct (id, source, size): ``rows`` (how many rows are alike), ``source_size``, ``target``
    and ``parts``, an array of (shard, words) with the words taken from all of them together, one entry per pass."""
    alike = (sized(docs, id_col, source_col, text_col).groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("words", F.col("size") * F.col("rows")))
    units = hold(alike, "sizes")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    targets = hold(source_targets(units, weights, cap)
                   .withColumn("key", key)
                   .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / float(block_words))).cast("long"))
                   .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
                   .withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_size")), "targets")
    placed = hold(units.withColumn("key", key).join(targets.drop("source"), "key")
                  .withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.col("blocks"))), "placed")

    # blocks of each source in permuted order, and how much each pass draws from them
    blocks = (placed.groupBy("key", "block").agg(F.sum("words").alias("words"), *[F.first(c).alias(c) for c in ("blocks", "passes", "rest")])
              .withColumn("perm", F.xxhash64(F.lit(seed), F.lit("perm"), "key", "block"))
              .withColumn("super", F.pmod("perm", F.ceil(F.col("blocks") / float(SUPER)))))
    blocks = hold(_running(_running(blocks.withColumn("one", F.lit(1).cast("long")), ["key"], "words"), ["key"], "one"), "blocks")
    last = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before_words")))
    rank = F.col("pass") * F.col("blocks") + F.col("before_one")
    drawn = (blocks.withColumn("last", last).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
             .withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("last")))
             .filter("words > 0").select("key", "block", "pass", "words", rank.alias("rank")))
    quotas = drawn.groupBy("key").agg((F.max("rank") + 1).alias("draws")).withColumnRenamed("key", "source")
    ranges = (split_quotas(quotas, levels, seed)
              .withColumn("end", F.sum("draws").over(Window.partitionBy("source").orderBy("shard")))
              .groupBy(F.col("source").alias("key")).agg(F.sort_array(F.collect_list("end")).alias("ends")))  # 2 ** levels numbers
    drawn = (drawn.join(ranges, "key").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
             .groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "words"))).alias("drawn")))  # cap + 1 at most

    inside = Window.partitionBy("key", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("doc"), "id", "size"), "id", "size")
    start = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<pass: BIGINT, shard: INT, words: BIGINT>>)")
    parts = F.transform(F.coalesce("drawn", none), lambda p: F.struct(
        p["shard"].alias("shard"), F.greatest(F.lit(0), F.least(F.col("words"), p["words"] - F.col("start"))).alias("words")))
    return (placed.join(drawn, ["key", "block"], "left").withColumn("start", start)
            .select("id", "source", "size", "rows", "source_size", "target", parts.alias("parts")))


def _own(parts: Column, nth: Column, size: Column) -> Column:
    """The copies that go to the nth of rows that are alike: what is left of each pass after those before it."""
    each = F.transform(parts, lambda p: F.struct(
        p["shard"].alias("shard"), F.greatest(F.lit(0), F.least(size, p["words"] - nth * size)).alias("words")))
    return F.filter(each, lambda p: p["words"] > 0)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: the id, ``source``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words
    the mix takes from the row, repeats counted) and ``draws``, an array of (shard, words), one entry per copy.

    A source's taken words are its target, rounded. At most one document per source is taken in part, its first
    words. A null text or one of white space only has size 0 and nothing is taken from it; a null source is a source.
    Rows that repeat an id are documents of their own. All choices hang on the seed, ids and sizes, so reruns agree.
    Further columns are not read. An empty table gives no rows. Options: see :func:`draws`."""
    out = (draws(docs, id_col, source_col, text_col, **options)
           .withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
           .withColumn("draws", _own(F.col("parts"), F.col("nth"), F.col("size"))))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.alias("taken"), "draws")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 42,
                    shard_col: str | None = None, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, in shuffled order within a partition. ``shard_col`` names
    a column for the shard that the copy went to. All columns pass through and no text is cut: the one document of a source that is
    drawn in part goes in whole where half of its words or more are drawn, else not, so a source misses its target by half a document at most."""
    p = unused(docs, "__mix")
    took = draws(docs, id_col, source_col, text_col, seed=seed, **options).select(
        *[F.col(c).alias(f"{p}_{c}") for c in ("id", "source", "size", "parts")])
    own = docs.withColumn(f"{p}_words", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
    same = (F.col(id_col).eqNullSafe(F.col(f"{p}_id")) & F.col(source_col).eqNullSafe(F.col(f"{p}_source"))
            & (F.col(f"{p}_words") == F.col(f"{p}_size")))
    nth = F.row_number().over(Window.partitionBy(id_col, source_col, f"{p}_words").orderBy(F.lit(1))) - 1
    drawn = (own.join(took, same).withColumn(f"{p}_nth", nth)
             .withColumn(f"{p}_draw", F.explode(_own(F.col(f"{p}_parts"), F.col(f"{p}_nth"), F.col(f"{p}_size")))))
    shard = F.col(f"{p}_draw.shard")
    drawn = (drawn.filter(F.col(f"{p}_draw.words") * 2 >= F.col(f"{p}_size"))
             .sortWithinPartitions(shard, F.xxhash64(F.lit(seed), F.lit("order"), id_col, f"{p}_nth", shard)))
    if shard_col:
        drawn = drawn.withColumn(shard_col, shard)
    return drawn.drop(*[f"{p}_{c}" for c in ("id", "source", "size", "parts", "words", "nth", "draw")])
