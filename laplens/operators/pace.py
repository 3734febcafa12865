"""Lap filters, ranks, tiers and paces. Column names are arguments; times are seconds, lower is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.functions.measures import light, tier
from laplens.operators.ordered import before, neighbours, number, with_group_stats


def usable_laps(df: DataFrame, t: str, out_lap: Column, lo: float = 80.0, hi: float = 400.0) -> DataFrame:
    return df.filter(~F.coalesce(out_lap, F.lit(False)) & F.col(t).between(lo, hi))


def flagged_valid(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag text reads as a number other than zero."""
    return df.filter(F.coalesce(flag.cast("string").try_cast("double"), F.lit(0.0)) != 0)


def within_share(df: DataFrame, keys: list[str], t: str, share: float = 1.07) -> DataFrame:
    """Laps no slower than ``share`` times their group's best."""
    return with_group_stats(df, keys, F.min(t).alias("group_best")).filter(F.col(t) <= F.col("group_best") * share)


def latest_rows(df: DataFrame, date: str, cols: list[str]) -> DataFrame:
    """Rows that share ``cols`` with the row of the latest date (ties: largest ``cols``)."""
    top = df.agg(F.max(F.struct(date, *cols)).alias("_t")).select(*[F.col(f"_t.{c}").alias(c) for c in cols])
    return df.join(top, cols, "left_semi")


def gap_to_best(df: DataFrame, keys: list[str], t: str, out: str = "gap", best: str = "group_best") -> DataFrame:
    return with_group_stats(df, keys, F.min(t).alias(best)).withColumn(out, F.col(t) - F.col(best))


def ranked(df: DataFrame, keys: list[str], t: str, tie: list[str], bound: DataFrame | None = None) -> DataFrame:
    """Position, group size, gap to the best and FAST / MED / SLOW tier within the group."""
    out = number(df, keys, [F.col(t), *map(F.col, tie)], "rank", "rank_total", bound=bound, group_best=F.min(t))
    return out.withColumns({"gap_to_best": F.col(t) - F.col("group_best"), "tier": tier(F.col("rank"), F.col("rank_total"))})


def thirds(df: DataFrame, keys: list[str], t: str, tie: list[str]) -> DataFrame:
    """Adds ``is_fast`` / ``is_slow``: the fastest and slowest third, at least one row each."""
    out = number(df, keys, [F.col(t), *map(F.col, tie)], "_rn", "_n")
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    return out.withColumns({"is_fast": F.col("_rn") <= size, "is_slow": F.col("_rn") > F.col("_n") - size}) \
              .drop("_rn", "_n")


def top_third_pace(df: DataFrame, keys: list[str], t: str, tie: list[str]) -> DataFrame:
    """Best, mean of the fastest third, mean and count per group."""
    return (thirds(df, keys, t, tie).groupBy(*keys)
            .agg(F.min(t).alias("best"), F.avg(F.when(F.col("is_fast"), F.col(t))).alias("race_pace"),
                 F.avg(t).alias("mean"), F.count(t).alias("laps")))


def session_metrics(df: DataFrame, session: list[str], rider: list[str], t: str) -> DataFrame:
    """Per session and rider: best, mean, spread, gap to the session's best, mean minus best."""
    base = df.groupBy(*session, *rider).agg(F.min(t).alias("best"), F.avg(t).alias("mean"),
                                           F.stddev_pop(t).alias("sigma"), F.count(t).alias("laps"))
    base = with_group_stats(base, session, F.min("best").alias("p1"))
    return base.withColumns({"p1_gap": F.col("best") - F.col("p1"), "avg_delta": F.col("mean") - F.col("best")}).drop("p1")


def step_changes(df: DataFrame, keys: list[str], order: list[Column], measures: list[str], dead: float = 0.1) -> DataFrame:
    """Change of each measure against the group's previous row, with a traffic light."""
    out = neighbours(df, keys, order, **{f"_p_{m}": before(F.col(m)) for m in measures})
    adds = {}
    for m in measures:
        adds[f"d_{m}"] = F.col(m) - F.col(f"_p_{m}")
        adds[f"{m}_light"] = light(F.col(m) - F.col(f"_p_{m}"), dead)
    return out.withColumns(adds).filter(F.col(f"d_{measures[0]}").isNotNull()).drop(*[f"_p_{m}" for m in measures])


def change_flags(df: DataFrame, keys: list[str], order: list[Column], cols: list[str], out: str = "n_changes") -> DataFrame:
    """``<col>_changed`` against the previous row, compared as text; the first row of a group has none."""
    now = F.struct(*[F.col(c).cast("string").alias(c) for c in cols])
    rows = neighbours(df, keys, order, _prev=before(now))
    flags = {f"{c}_changed": F.col("_prev").isNotNull() & ~F.col(c).cast("string").eqNullSafe(F.col(f"_prev.{c}"))
             for c in cols}
    total = sum((f.cast("int") for f in list(flags.values())[1:]), list(flags.values())[0].cast("int"))
    return rows.withColumns({**flags, out: total}).drop("_prev")


def best_flags(df: DataFrame, keys: list[str], t: str, eps: float = 0.002) -> DataFrame:
    return with_group_stats(df, keys, F.min(t).alias("_best")) \
        .withColumn("is_best", F.abs(F.col(t) - F.col("_best")) < eps).drop("_best")


def tier_means(df: DataFrame, keys: list[str], metrics: list[str], *more: Column, tier_col: str = "tier") -> DataFrame:
    """Mean of each metric over FAST rows, SLOW rows and all, and FAST minus SLOW; ``more`` aggregates ride along."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *more]
    for m in metrics:
        for t in ("FAST", "SLOW"):
            aggs.append(F.avg(F.when(F.col(tier_col) == t, F.col(m))).alias(f"{t.lower()}_{m}"))
        aggs.append(F.avg(m).alias(f"all_{m}"))
    return df.groupBy(*keys).agg(*aggs).withColumns(
        {f"d_{m}": F.col(f"fast_{m}") - F.col(f"slow_{m}") for m in metrics})


def supported(df: DataFrame, keys: list[str], col: str, k: int) -> DataFrame:
    """Groups with at least ``k`` non-null values, all rows kept."""
    ok = df.groupBy(*keys).agg(F.count(col).alias("_n")).filter(F.col("_n") >= k).select(*keys)
    return df.join(ok, keys, "left_semi")


def custom_position(c: Column, order: list[str], unknown: int = 99) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(unknown)).otherwise(at)


def top_rows(df: DataFrame, order: list[Column], k: int, rn: str = "position") -> DataFrame:
    """First ``k`` rows of the whole table with their position. Each task keeps its own ``k`` first."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn(rn, F.row_number().over(Window.orderBy(*order)).cast("long"))  # k rows
