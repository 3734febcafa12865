"""Pivots, unpivots and statistics over long (name, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.operators.ordered import number, with_group_stats


def pivot_counts(df: DataFrame, rows: list[str], col: str, values: list[str]) -> DataFrame:
    out = df.filter(F.col(col).isNotNull()).groupBy(*rows).pivot(col, values).count()
    return out.na.fill(0, values)


def measures_long(df: DataFrame, ids: list[str], measures: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Measures as rows, null values dropped."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(ids, measures, name, value).filter(F.col(value).isNotNull())


def fields_long(df: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """All fields as text rows, nulls kept."""
    return df.select(*ids, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(ids, fields, "field", "value")


def pivot_pair(df: DataFrame, rows: list[str], col: str, pair: tuple, value: str, agg: str = "avg") -> DataFrame:
    """Two members side by side with their difference; rows lacking one are dropped."""
    a, b = pair
    f = getattr(F, agg)
    out = df.filter(F.col(col).isin(list(pair))).groupBy(*rows).agg(
        f(F.when(F.col(col) == a, F.col(value))).alias("value_a"),
        f(F.when(F.col(col) == b, F.col(value))).alias("value_b"))
    return out.filter(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()) \
              .withColumn("gap", F.col("value_a") - F.col("value_b"))


def matrix(df: DataFrame, rows: list[str], col: str, values: list, value: str, order: str, prefix: str = "c") -> DataFrame:
    """One column per listed value, holding the first cell by ``order``."""
    return df.groupBy(*rows).agg(*[F.min_by(F.when(F.col(col) == v, F.col(value)), F.when(F.col(col) == v, F.col(order)))
                                   .alias(f"{prefix}{v}") for v in values])


def correlations(df: DataFrame, params: list[str], target: str, groups: list[str] | None = None, k: int = 3) -> DataFrame:
    """Pearson r of each parameter with ``target`` over pairs that have both, at least ``k`` of them.

    All parameters are aggregated in one pass; only the one-row-per-group result is turned to rows.
    """
    groups = groups or []
    both = {p: F.col(p).isNotNull() & F.col(target).isNotNull() for p in params}
    wide = df.groupBy(*groups).agg(*[F.struct(F.corr(p, target).alias("r"), F.count_if(both[p]).alias("n")).alias(p) for p in params])
    out = wide.unpivot(groups, params, "param", "_s").select(*groups, "param", "_s.r", "_s.n")
    return out.filter(F.col("n") >= k)


def fitted_lines(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group."""
    yy, xx = F.col(y), F.col(x)
    return df.groupBy(*keys).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
                                 F.regr_r2(yy, xx).alias("r2"), F.regr_count(yy, xx).alias("n"))


def sector_ranks(df: DataFrame, keys: list[str], rider: str, sectors: list[str]) -> DataFrame:
    """Best value per sector and rider, gap to the sector's best and rank (equal values share one)."""
    wide = df.groupBy(*keys, rider).agg(*[F.min(c).alias(c) for c in sectors])
    best = measures_long(wide, [*keys, rider], sectors, "sector", "best")
    group = [*keys, "sector"]
    best = with_group_stats(best, group, F.min("best").alias("_top"))
    placed = number(best, group, [F.col("best"), F.col(rider)], "_rn")
    # the rank of a value is the first position it takes
    placed = with_group_stats(placed, [*group, "best"], F.min("_rn").alias("sector_rank"))
    return placed.withColumn("sector_gap", F.col("best") - F.col("_top")).drop("_top", "_rn")
