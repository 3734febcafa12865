"""Detectors and corner phases over wide telemetry tracks.

Every detector takes the column names it reads and its thresholds; the defaults are the values for
kilometres per hour, bar, percent and millimetres. Clocks are microseconds. ``step`` is the sample
period of an evenly sampled track, where n samples last n periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplens.operators.ordered import Track, before, join_on, quantiles, with_group_stats
from laplens.operators.signal import (SECOND, asof, asof_next, derivative, interval_join, islands, label_islands,
                                      long_enough, merge_islands, min_gap, min_gap_keep_larger, smooth_time,
                                      turning_points)
from laplens.session import hold


def all_bands(bands: dict[str, tuple[float, float]]) -> Column:
    """Every column inside its band; null and NaN are outside."""
    cond = F.lit(True)
    for name, (lo, hi) in bands.items():
        cond = cond & F.coalesce(F.col(name).between(lo, hi) & ~F.isnan(name), F.lit(False))
    return cond


def band_areas(t: Track, bands: dict[str, tuple[float, float]], merge_gap: int, min_rows: int,
               means: dict[str, str]) -> DataFrame:
    """Areas where all bands hold, near ones merged first, short ones dropped after, with channel means."""
    sums = [F.sum(c).alias(f"_s_{o}") for o, c in means.items()] + [F.count(c).alias(f"_n_{o}") for o, c in means.items()]
    found = islands(t, all_bands(bands), *sums)
    again = [F.sum(f"_s_{o}").alias(f"_s_{o}") for o in means] + [F.sum(f"_n_{o}").alias(f"_n_{o}") for o in means]
    merged = merge_islands(found, t.keys, merge_gap, F.sum("n").alias("n"), *again, like=t)
    out = long_enough(merged, min_rows=min_rows)
    out = out.withColumn("mid_us", F.floor((F.col("start_us") + F.col("end_us")) / 2))
    return out.withColumns({o: F.col(f"_s_{o}") / F.col(f"_n_{o}") for o in means}) \
              .drop(*[f"_s_{o}" for o in means], *[f"_n_{o}" for o in means])


def limiter_zones(t: Track, speed: str, lo: float = 56.0, hi: float = 64.0, min_span: int = 3 * SECOND,
                  smooth: int = SECOND // 5, means: dict[str, str] | None = None, step: int = 0) -> DataFrame:
    """Stretches whose smoothed speed stays inside [lo, hi] for ``min_span``."""
    t = smooth_time(t, speed, smooth, "_s")
    aggs = [F.avg(c).alias(o) for o, c in (means or {}).items()]
    return long_enough(islands(t, F.col("_s").between(lo, hi), *aggs), min_span=min_span, step=step)


def entry_points(t: Track, speed: str, decel: float = -8.0, min_speed: float = 80.0, min_rows: int = 15,
                 gap: int = 800_000, look_back: int = 80_000, smooth: int = 70_000, to_ms: float = 3.6,
                 values: list[str] | None = None, unit: int = SECOND) -> DataFrame:
    """Starts of strong deceleration, at least ``gap`` apart, with the channel values ``look_back`` earlier."""
    t = smooth_time(t.columns(_v=F.col(speed) / to_ms), "_v", smooth, "_sv")
    t = derivative(t, "_sv", "_a", unit)
    found = islands(t, (F.col("_a") < decel) & (F.col(speed) >= min_speed))
    starts = long_enough(found, min_rows=min_rows).select(*t.keys, "start_us")
    kept = min_gap(starts, t.keys, "start_us", gap, like=t)
    wanted = kept.withColumn(t.ts, F.col("start_us") - look_back)
    return asof(wanted, t.df, t.keys, t.ts, values or [speed], like=t).withColumnRenamed(t.ts, "entry_us")


def peak_areas(t: Track, level: str, speed: str, threshold: float = 1.0, min_speed: float = 80.0,
               ratio: float = 0.85, min_span: int = 50_000, means: dict[str, str] | None = None, step: int = 0) -> DataFrame:
    """Per event above ``threshold``: means over the rows that reach ``ratio`` of the event's peak."""
    rows = label_islands(t, (F.col(level) >= threshold) & (F.col(speed) >= min_speed), "_event")
    rows = with_group_stats(rows, [*t.keys, "_event"], F.max(level).alias("peak"), F.min(t.ts).alias("start_us"),
                            F.max(t.ts).alias("end_us"), F.count(F.lit(1)).alias("n"))
    full = rows.filter((F.col("end_us") - F.col("start_us") + step >= min_span) & (F.col(level) >= F.col("peak") * ratio))
    return (full.groupBy(*t.keys, "start_us", "end_us", "n", "peak")
            .agg(F.count(F.lit(1)).alias("n_full"), *[F.avg(c).alias(o) for o, c in (means or {}).items()]))


def unit_scaled(rows: DataFrame, keys: list[str], value: str, limit_median: float = 10.0, divisor: float = 100.0,
                out: str = "scaled") -> DataFrame:
    """Values of a run divided by ``divisor`` when the median of its positive values says the finer unit."""
    med = quantiles(rows.filter(F.col(value) > 0), keys, value, {"_med": 0.5})
    fine = F.col("_med") > limit_median
    return (rows.join(med, keys, "left")
            .withColumn(out, F.when(fine, F.col(value) / divisor).otherwise(F.col(value))).drop("_med"))


def edge_stats(t: Track, value: str, lo: float, hi: float, share: float = 0.05, min_edge: int = 10,
               min_valid: int = 4) -> DataFrame:
    """Start and end level (medians of the first and last rows), mean and change of a run's valid values."""
    edge = F.greatest(F.lit(min_edge), F.floor(F.col("_n") * share))
    ends = F.array(F.when(F.col("_rn") <= edge, "start"), F.when(F.col("_rn") > F.col("_n") - edge, "end"))
    placed = t.number("_rn", "_n").df.filter((F.col(value) > lo) & (F.col(value) < hi))
    placed = hold(placed.select(*t.keys, value, F.array_compact(ends).alias("_ends")), "placed")  # read for the means and for the medians
    base = placed.groupBy(*t.keys).agg(F.avg(value).alias("avg_val"), F.count(F.lit(1)).alias("n_valid"))
    mid = quantiles(placed.select(*t.keys, value, F.explode("_ends").alias("_end")), [*t.keys, "_end"], value, {"_mid": 0.5})
    mid = mid.groupBy(*t.keys).agg(*[F.max(F.when(F.col("_end") == e, F.col("_mid"))).alias(f"{e}_val") for e in ("start", "end")])
    return (base.filter(F.col("n_valid") >= min_valid).join(mid, t.keys, "left")
            .withColumn("delta_val", F.col("end_val") - F.col("start_val")))


def crossing_after_low(events: DataFrame, rows: DataFrame, keys: list[str], at: str, ts: str, level: str,
                       before_us: int = 300_000, after_us: int = 2 * SECOND, threshold: float = 10.0,
                       width: int | None = None) -> DataFrame:
    """Per event: lowest ``level`` around it, then the first row at or after that low above ``threshold``."""
    spans = events.select(*keys, at, (F.col(at) - before_us).alias("_lo"), (F.col(at) + after_us).alias("_hi"))
    near = interval_join(rows.select(*keys, ts, level), spans, keys, ts, "_lo", "_hi", width or (before_us + after_us))
    lows = near.groupBy(*keys, at).agg(F.min(F.struct(level, ts)).alias("_low"))
    lows = lows.filter(F.col(f"_low.{level}") <= threshold)
    rest = near.join(lows, [*keys, at]).filter((F.col(ts) >= F.col(f"_low.{ts}")) & (F.col(level) > threshold))
    return rest.groupBy(*keys, at).agg(F.min(f"_low.{level}").alias("low_level"), F.min(f"_low.{ts}").alias("low_us"),
                                       F.min(ts).alias("cross_us"))


def brake_corners(t: Track, brake: str, speed: str, threshold: float = 0.5, min_span: int = 100_000,
                  search: int = 4 * SECOND, half: int = 200_000, gap: int = 1_500_000, step: int = 0) -> DataFrame:
    """Corners found from braking: peak of each brake event, then the slowest row within ``search``."""
    peaks = long_enough(islands(t, F.col(brake) > threshold,
                                F.min_by(t.ts, F.struct(-F.col(brake), F.col(t.ts))).alias("peak_us")), min_span=min_span, step=step)
    spans = peaks.select(*t.keys, "peak_us", (F.col("peak_us") + search).alias("_hi"))
    near = interval_join(t.df.select(*t.keys, t.ts, speed), spans, t.keys, t.ts, "peak_us", "_hi", search)
    apex = near.groupBy(*t.keys, "peak_us").agg(F.min(F.struct(speed, t.ts)).getField(t.ts).alias("apex_us"))
    kept = min_gap(apex, t.keys, "apex_us", gap, like=t)
    return kept.withColumns({"start_us": F.col("apex_us") - half, "end_us": F.col("apex_us") + half})


def apex_minima(t: Track, col: str, gap: int, window: int, min_depth: float, **turning) -> DataFrame:
    """Apexes as prominent minima of ``col``, at least ``gap`` after the one accepted before."""
    found = hold(turning_points(t, col, "min", window, min_depth, **turning), "turns")  # read twice, and few next to the rows behind them
    return join_on(found, min_gap(found, t.keys, t.ts, gap, like=t), [*t.keys, t.ts], "inner")


def apex_maxima(t: Track, col: str, gap: int, window: int, min_depth: float, min_signal: float | None = None, **turning) -> DataFrame:
    """Apexes as prominent maxima of the size of ``col``; within ``gap`` the larger one stays. Groups in which the size never
    reaches ``min_signal`` have a channel too weak to judge by, and no apexes."""
    t = t.columns(**{col: F.abs(F.col(col))})
    found = turning_points(t, col, "max", window, min_depth, **turning)
    if min_signal is not None:
        strong = t.df.groupBy(*t.keys).agg(F.max(col).alias("_top")).filter(F.col("_top") >= min_signal).drop("_top")
        found = join_on(found, strong, t.keys, "inner")
    return min_gap_keep_larger(hold(found, "turns"), t.keys, t.ts, "level", gap, like=t)


def apexes(by_load: DataFrame, by_speed: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Apexes by load, or by speed in groups where the load finds fewer than ``share`` of what the speed does."""
    weak = (F.col("n_second") > 0) & (F.col("n_first") < F.col("n_second") * share)
    return choose_detector(by_load, by_speed, keys, weak)


def choose_detector(first: DataFrame, second: DataFrame, keys: list[str], use_second: Column) -> DataFrame:
    """Per group take the events of ``second`` where ``use_second`` (over n_first, n_second) holds."""
    a = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_first"))
    b = second.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_second"))
    counts = a.join(b, keys, "full").na.fill(0, ["n_first", "n_second"]).withColumn("_second", use_second)
    pick = counts.select(*keys, "_second")
    one = first.join(pick.filter(~F.col("_second")), keys, "left_semi").withColumn("detector", F.lit("first"))
    two = second.join(pick.filter("_second"), keys, "left_semi").withColumn("detector", F.lit("second"))
    return one.unionByName(two)


def back_search(segments: DataFrame, t: Track, brake: str, threshold: float = 0.3, look_back: int = 5 * SECOND,
                width: int | None = None, mean: str | None = None) -> DataFrame:
    """Braking phase before each segment start: coasting is skipped, the braking run before it is taken."""
    on = label_islands(t, F.col(brake) > threshold, "_run")
    marked = with_group_stats(on.select(*t.keys, t.ts, "_run"), [*t.keys, "_run"], F.min(t.ts).alias("_run_start"))
    wanted = segments.withColumn(t.ts, F.col("start_us"))
    marked = marked.withColumn("_last_on", F.col(t.ts))
    hit = asof(wanted, marked, t.keys, t.ts, ["_run_start", "_last_on"], strict=True, like=t).drop(t.ts)
    reach = F.col("start_us") - look_back
    start = F.when(F.col("_last_on") >= reach, F.greatest(F.col("_run_start"), reach)).otherwise(F.col("start_us"))
    out = hit.withColumn("brake_start_us", F.coalesce(start, F.col("start_us"))).drop("_run_start", "_last_on")
    spans = out.filter("brake_start_us < start_us").select(*t.keys, "brake_start_us", "start_us")
    cols = [brake] + ([mean] if mean else [])
    near = interval_join(t.df.select(*t.keys, t.ts, *cols), spans, t.keys, t.ts, "brake_start_us", "start_us",
                         width or look_back)
    aggs = [F.max(brake).alias("brake_peak")] + ([F.avg(mean).alias("brake_mean")] if mean else [])
    stats = near.groupBy(*t.keys, "start_us").agg(*aggs)
    return (out.withColumn("brake_us", F.col("start_us") - F.col("brake_start_us"))
            .join(stats, [*t.keys, "start_us"], "left"))


def phase_core(segments: DataFrame, t: Track, speed: str, mean: str, width: int, step: int = 0) -> DataFrame:
    """Duration, lowest speed (not below zero) and a channel mean inside each segment."""
    near = interval_join(t.df.select(*t.keys, t.ts, speed, mean), segments.select(*t.keys, "start_us", "end_us"),
                         t.keys, t.ts, "start_us", "end_us", width, closed=True)
    return (near.groupBy(*t.keys, "start_us", "end_us")
            .agg(F.greatest(F.lit(0.0), F.min(speed)).alias("speed_min"), F.avg(mean).alias("core_mean"))
            .withColumn("core_us", F.col("end_us") - F.col("start_us") + step))


def forward_run(segments: DataFrame, t: Track, level: str, threshold: float = 6.0, run: int = 5,
                cap: int = 4 * SECOND) -> DataFrame:
    """End of the coasting phase: first of ``run`` consecutive rows above ``threshold`` at or after the
    segment end, all within ``cap``; ``cap`` itself where there is none."""
    hot = F.coalesce(F.col(level) > threshold, F.lit(False))
    on = t.columns(_hot=hot)
    if t.fits:  # a run ends where the last ``run`` rows are all above
        w = Window.partitionBy(*t.keys).orderBy(t.ts, *t.tie)
        on = on.columns(_all=F.sum(F.col("_hot").cast("int")).over(w.rowsBetween(1 - run, 0)) == run, _back=F.lag(t.ts, run - 1).over(w))
    else:
        on = on.columns(_all=hot, _back=F.col(t.ts))
        for _ in range(run - 1):
            # one step back along the track: clock and "hot so far" of the row before
            on = on.scan(_pb=before(F.col("_back")), _pa=before(F.col("_all")))
            on = on.columns(_all=F.coalesce(F.col("_hot") & F.col("_pa"), F.lit(False)), _back=F.col("_pb"))
    hits = on.df.filter("_all").select(*t.keys, F.col("_back").alias("_at"), F.col("_back").alias("run_start"),
                                       F.col(t.ts).alias("run_end"))
    wanted = segments.withColumn("_at", F.col("end_us"))
    out = asof_next(wanted, hits, t.keys, "_at", ["run_start", "run_end"], like=t)
    found = F.col("run_end") < F.col("end_us") + cap
    return (out.withColumn("throttle_us", F.when(found, F.col("run_start")).otherwise(F.col("end_us") + cap))
            .withColumn("found", F.coalesce(found, F.lit(False)))
            .withColumn("throttle_us", F.coalesce("throttle_us", F.col("end_us") + cap))
            .withColumn("exit_us", F.col("throttle_us") - F.col("end_us")).drop("_at", "run_start", "run_end"))


def numbered_corners(phases: DataFrame, t: Track, start: str, parts: list[str]) -> DataFrame:
    """Corner number within the lap and total time over the phase columns ``parts``."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    return t.derive(phases, start).number("corner_no").df.withColumn("total_us", total)


def nan_safe(*cols: str, digits: int = 2) -> list[Column]:
    """Mean, minimum and maximum of each column, NaN skipped, null when nothing is left."""
    out = []
    for c in cols:
        v = F.when(~F.isnan(c), F.col(c))
        out += [F.round(F.avg(v), digits).alias(f"{c}_mean"), F.round(F.min(v), digits).alias(f"{c}_min"),
                F.round(F.max(v), digits).alias(f"{c}_max")]
    return out


def with_event_stats(groups: DataFrame, keys: list[str], **events: tuple[DataFrame, list[Column]]) -> DataFrame:
    """Left-join per-group counts (zero where none) and further aggregates of event tables."""
    for name, (ev, aggs) in events.items():
        stats = ev.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_count"), *aggs)
        groups = groups.join(stats, keys, "left").withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    return groups
