"""Fact building: fills, joins, de-duplication and keyed writes on immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.operators.ordered import join_on, keep_one
from laplens.session import hold


# --- joins -------------------------------------------------------------------------------------


def fill_from_first(df: DataFrame, source: DataFrame, keys: list[str], col: str, order: str,
                    default: str = "UNK") -> DataFrame:
    """Missing ``col`` from the first ``source`` row with equal keys (without case), else ``default``."""
    folded = [f"_k{i}" for i in range(len(keys))]
    up = {f: F.upper(F.trim(F.col(k))) for f, k in zip(folded, keys)}
    first = (source.withColumns(up).filter(F.coalesce(F.col(col), F.lit("")) != "")
             .groupBy(*folded).agg(F.min_by(col, order).alias("_fill")))
    out = df.withColumns(up).join(first, folded, "left")
    own = F.when(F.col(col) != "", F.col(col))
    return out.withColumn(col, F.coalesce(own, "_fill", F.lit(default))).drop(*folded, "_fill")


def merge_facts(base: DataFrame, key: str, inserting: list[DataFrame], updating: list[DataFrame]) -> DataFrame:
    """One row per key. ``inserting`` frames may add keys, ``updating`` ones only fill columns; each is
    de-duplicated on ``key`` beforehand and later frames win where they have the key."""
    out = base
    for part, how in [(p, "full") for p in inserting] + [(p, "left") for p in updating]:
        shared = [c for c in part.columns if c in out.columns and c != key]
        renamed = part.select(key, *[F.col(c).alias(f"_n_{c}") if c in shared else F.col(c)
                                     for c in part.columns if c != key], F.lit(True).alias("_hit"))
        out = out.join(renamed, key, how)
        out = out.withColumns({c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in shared})
        out = out.drop("_hit", *[f"_n_{c}" for c in shared])
    return out


def pair_delta(df: DataFrame, key: str, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """``pairs(a, b)``: every field of the two runs side by side, as text. The wide rows are joined, then unpivoted. A run
    that ``df`` does not have leaves its side null; a pair of two such runs gives no rows."""
    def side(s):
        return df.select(F.col(key).alias(s), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(f"_{s}"))

    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("_a is not null or _b is not null")
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a.{f}").alias("value_a"), F.col(f"_b.{f}").alias("value_b"))
                                 for f in fields]))
    return both.select("a", "b", listed.alias("_f")).select("a", "b", "_f.*")


def contained(hay: DataFrame, needles: DataFrame, text: str, needle: str, q: int = 3) -> DataFrame:
    """Pairs where ``needle`` occurs inside ``text``.

    A needle is keyed by the rarest of its substrings of ``q`` characters (shorter ones by themselves), counted over the
    distinct texts. Texts list a hash of themselves under each of their substrings of the lengths in use; the text itself
    joins the few candidates. The containment is then checked in full, so this is an equi-join instead of all pairs.
    What is known of the needles is written first: where they are few, Spark sees it and the lists of substrings, by far
    the most rows here, are not shuffled.
    """
    needles = hold(needles, "needles")
    short = F.length(needle) < q
    sizes = [r[0] for r in needles.filter(F.length(needle) > 0).select(F.least(F.length(needle), F.lit(q))).distinct().collect()]  # at most q values

    def grams(c: str, size: int) -> Column:
        spots = F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1)))
        return F.array_distinct(F.transform(spots, lambda i: F.substring(F.col(c), i, F.lit(size))))

    name = F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
    listed = (hay.select(text).distinct()
              .select(name.alias("_name"), F.explode(F.array_distinct(F.flatten(F.array(*[grams(text, n) for n in sizes])))).alias("_gram")))
    spelled = hold(needles.filter(F.length(needle) > 0).select(needle).distinct()
                   .select(needle, F.explode(F.when(short, F.array(needle)).otherwise(grams(needle, q))).alias("_gram")), "spelled")
    counts = listed.join(spelled.select("_gram"), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keyed = hold(spelled.join(counts, "_gram", "left").groupBy(needle).agg(
        F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")), "keyed")
    candidates = listed.join(keyed, "_gram").select("_name", needle)
    found = hay.withColumn("_name", name).join(candidates, "_name").filter(F.contains(F.col(text), F.col(needle)))
    return found.drop("_name").join(needles, needle)


def impute_dates(df: DataFrame, events: DataFrame, event_key: str, prefix: str, date: str,
                 families: dict[str, list[str]]) -> DataFrame:
    """Missing dates from siblings of the same event: same prefix, else the first present prefix of its
    family (in the listed order), else the event's first known prefix."""
    known = events.filter(F.col(date).isNotNull()).groupBy(event_key, prefix).agg(F.min(date).alias("_d"))
    exact = known.withColumnRenamed("_d", "_exact")
    fam_col, pos = F, F
    for name, members in families.items():
        fam_col = fam_col.when(F.col(prefix).isin(members), F.lit(name))
        for i, m in enumerate(members):
            pos = pos.when(F.col(prefix) == m, F.lit(i))
    ranked = known.withColumns({"_fam": fam_col.otherwise(F.lit(None)), "_pos": pos.otherwise(F.lit(999))})
    by_family = ranked.filter("_fam is not null").groupBy(event_key, "_fam").agg(F.min_by("_d", "_pos").alias("_family"))
    any_date = known.groupBy(event_key).agg(F.min_by("_d", prefix).alias("_any"))
    out = (df.withColumn("_fam", fam_col.otherwise(F.lit(None)))
           .join(exact, [event_key, prefix], "left").join(by_family, [event_key, "_fam"], "left")
           .join(any_date, event_key, "left"))
    return out.withColumn(date, F.coalesce(date, "_exact", "_family", "_any")).drop("_fam", "_exact", "_family", "_any")


def impute_from_equal_date(df: DataFrame, events: DataFrame, date: str, col: str, order: str) -> DataFrame:
    """Missing ``col`` from the first event that has the same date."""
    first = events.filter(F.col(col).isNotNull()).groupBy(date).agg(F.min_by(col, order).alias("_f"))
    return df.join(first, date, "left").withColumn(col, F.coalesce(col, "_f")).drop("_f")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- keyed writes ------------------------------------------------------------------------------


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``source`` (latest per key) replace or extend ``target``. Applying it twice changes nothing."""
    latest = keep_one(source, keys, F.col(order))
    return target.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def insert_new(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``source`` (first per key) whose key ``target`` does not have yet are added."""
    first = keep_one(source, keys, F.col(order), latest=False)
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def patch(target: DataFrame, changes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Columns ``cols`` overwritten, also with null, where ``changes`` has the key."""
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = target.join(new, keys, "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols}) \
              .drop("_hit", *[f"_n_{c}" for c in cols])


def drop_folded_duplicates(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key without regard to case, the largest ``order`` stays."""
    return keep_one(df.withColumn("_fold", F.lower(F.trim(key))), ["_fold"], order).drop("_fold")


def priority_merge(sources: list[DataFrame], key: str, level: str) -> DataFrame:
    """Union of keyed sources; per folded key the highest ``level`` wins, then the earlier source."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("_src", F.lit(-i))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("_fold", F.lower(F.trim(key)))
    return keep_one(out, ["_fold"], F.struct(F.col(level), F.col("_src"))).drop("_fold", "_src")


def review(pending: DataFrame, decisions: DataFrame, key: str, order: str) -> DataFrame:
    """Pending rows with the latest decision as their ``status``; undecided rows keep theirs."""
    last = decisions.groupBy(key).agg(F.max_by("decision", order).alias("_d"))
    return pending.join(last, key, "left").withColumn("status", F.coalesce("_d", "status")).drop("_d")


def difference_report(known: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One row: incoming, distinct, duplicates removed, already known, new."""
    distinct = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    seen = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    joined = join_on(distinct, seen, keys)
    return joined.agg(
        F.sum("_c").alias("incoming"), F.count(F.lit(1)).alias("distinct_keys"),
        (F.sum("_c") - F.count(F.lit(1))).alias("removed"),
        F.count(F.when(F.col("_known"), 1)).alias("skipped"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("new"))


def incremental(stored: DataFrame, incoming: DataFrame, keys: list[str], t: str, order: str) -> DataFrame:
    """Incoming rows with a new key are added; the key includes the time rounded to milliseconds."""
    cut = lambda df: df.withColumn("_t", F.round(F.col(t), 3))
    return insert_new(cut(stored), cut(incoming), [*keys, "_t"], order).drop("_t")


