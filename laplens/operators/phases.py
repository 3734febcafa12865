"""Corners of a lap in three phases, and suspension figures per lap, over tracks of :func:`laplens.operators.dynamics.lap_track`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.functions.text import lap_text
from laplens.operators.dynamics import LAP, LAP_S, Limits, lap_track
from laplens.operators.events import (apex_maxima, apex_minima, apexes, back_search, band_areas, brake_corners, crossing_after_low, entry_points,
                                      forward_run, peak_areas)
from laplens.operators.ordered import Track, running
from laplens.operators.signal import SECOND, asof, interval_join
from laplens.session import hold

# What holds at an apex, in bar, percent, percent a second and millimetres.
APEX_BANDS = {"brake": (-0.6, 0.3), "gas": (0.0, 6.0), "dtps": (-10.0, 100.0), "sus_f": (20.0, 140.0), "sus_r": (5.0, 50.0)}


@dataclass(frozen=True)
class CornerLimits:
    """Thresholds of the phases; times in microseconds."""

    min_lap_s: float = 60.0
    bands: dict = field(default_factory=lambda: dict(APEX_BANDS))
    merge_gap: int = 200_000
    min_rows: int = 3
    corner_brake: float = 0.5
    corner_span: int = 100_000
    corner_search: int = 4 * SECOND
    corner_half: int = 200_000
    corner_gap: int = 1_500_000
    long_lap_s: float = 80.0
    few: int = 5
    share: float = 0.5
    brake_on: float = 0.3
    look_back: int = 5 * SECOND
    gas_on: float = 6.0
    gas_rows: int = 5
    look_ahead: int = 4 * SECOND
    throttle_low: float = 10.0
    throttle_before: int = 300_000
    throttle_after: int = 2 * SECOND


def span_means(t: Track, spans: DataFrame, start: str, end: str, means: dict[str, str], closed: bool = False) -> DataFrame:
    """Means of ``means`` (output -> column) over the rows of each span [start, end), or up to its end where ``closed``. Spans may overlap.

    The track is scanned once: running sums and counts are read off at both ends of every span, and differences give the means."""
    spans = spans.select(*t.keys, start, end).distinct()
    ends = F.array(F.struct(F.col(start).alias("at"), F.lit(0).alias("side")), F.struct((F.col(end) + int(closed)).alias("at"), F.lit(1).alias("side")))
    marks = spans.select(*t.keys, F.col(start).alias("_start"), F.col(end).alias("_end"), F.explode(ends).alias("_e"))
    marks = marks.select(*t.keys, F.col("_e.at").alias(t.ts), F.lit(0).alias("_row"), "_start", "_end", F.col("_e.side").alias("_side"))
    columns = sorted(set(means.values()))
    rows = t.df.select(*t.keys, t.ts, F.lit(1).alias("_row"), *columns)
    both = t.derive(rows.unionByName(marks, allowMissingColumns=True), t.ts, tie=("_row",))
    sums = {f"_s_{c}": running(F.coalesce(F.col(c), F.lit(0.0))) for c in columns}
    counts = {f"_n_{c}": running(F.when(F.col(c).isNotNull(), 1).otherwise(0).cast("long")) for c in columns}
    seen = both.scan(**sums, **counts).df.filter("_row = 0")
    at = lambda c, side: F.max(F.when(F.col("_side") == side, F.col(c)))
    parts = seen.groupBy(*t.keys, "_start", "_end").agg(*[(at(c, 1) - at(c, 0)).alias(c) for c in (*sums, *counts)])
    out = {o: F.when(F.col(f"_n_{c}") > 0, F.col(f"_s_{c}") / F.col(f"_n_{c}")) for o, c in means.items()}
    return parts.select(*t.keys, F.col("_start").alias(start), F.col("_end").alias(end), *[v.alias(o) for o, v in out.items()])


def corner_segments(t: Track, p: CornerLimits) -> DataFrame:
    """(keys, start_us, end_us, detector) of each lap: areas where all bands hold, or corners found from braking where there are such and the areas are
    none, fewer than ``few`` on a lap of more than ``long_lap_s``, or less than ``share`` of the corners. Both are one tagged table, judged by one row of
    counts per lap."""
    cols = [*t.keys, "start_us", "end_us"]
    areas = band_areas(t, p.bands, p.merge_gap, p.min_rows, {}).select(*cols, F.lit("bands").alias("detector"))
    braked = brake_corners(t.filter(F.col("speed").isNotNull()), "brake", "speed", p.corner_brake, p.corner_span, p.corner_search, p.corner_half, p.corner_gap)
    tagged = hold(areas.unionByName(braked.select(*cols, F.lit("brake").alias("detector"))), "segments")
    length = t.df.groupBy(*t.keys).agg(F.max(LAP_S).alias("lap_s"))
    n = tagged.groupBy(*t.keys).agg(F.count_if(F.col("detector") == "bands").alias("n"), F.count_if(F.col("detector") == "brake").alias("m")).join(length, t.keys)
    rules = (F.col("n") == 0) | ((F.col("lap_s") > p.long_lap_s) & (F.col("n") < p.few)) | (F.col("n") < F.col("m") * p.share)
    chosen = n.select(*t.keys, F.when((F.col("m") > 0) & rules, "brake").otherwise("bands").alias("detector"))
    return tagged.join(chosen, [*t.keys, "detector"])


def corner_phases(samples: DataFrame, roles: DataFrame, laps: DataFrame, p: CornerLimits = CornerLimits()) -> DataFrame:
    """One row per corner: run, lap_no, lap_s, corner_no, detector, and per phase (braking, apex, until throttle) its length in ms and levels.

    Braking is taken from the brake run before the corner, coasting skipped, at most ``look_back`` before; the last phase ends at the first of ``gas_rows``
    rows above ``gas_on``, or ``look_ahead`` after the corner."""
    t = lap_track(samples, roles, laps, "brake", ["speed", "gas", "dtps", "sus_f", "sus_r"], p.min_lap_s)
    t = t.derive(hold(t.df, "laps"), "ts_us", tie=("idx",))
    on = [*t.keys, "start_us", "end_us"]
    segs = hold(corner_segments(t, p), "segments")
    back = back_search(segs.select(on), t, "brake", p.brake_on, p.look_back).select(*on, "brake_start_us", "brake_us", "brake_peak")
    ahead = forward_run(segs.select(on), t, "gas", p.gas_on, p.gas_rows, p.look_ahead).select(*on, "throttle_us")
    whole = hold(back.join(ahead, on), "segments")
    slowest = interval_join(t.df.select(*t.keys, "ts_us", "speed"), segs.select(on), t.keys, "ts_us", "start_us", "end_us", p.look_ahead, closed=True)
    slowest = slowest.groupBy(*on).agg(F.greatest(F.lit(0.0), F.min("speed")).alias("ph3_speed_min"))
    before = span_means(t, whole, "brake_start_us", "start_us", {"ph12_susf_avg": "sus_f"})
    inside = span_means(t, whole, "start_us", "end_us", {"ph3_susf_avg": "sus_f", "ph3_susr_avg": "sus_r"}, closed=True)
    after = span_means(t, whole, "end_us", "throttle_us", {"ph45_gas_avg": "gas", "ph45_susf_avg": "sus_f"})
    out = (whole.join(before, [*t.keys, "brake_start_us", "start_us"], "left").join(inside, on, "left").join(after, [*t.keys, "end_us", "throttle_us"], "left")
           .join(slowest, on, "left").join(segs, on).join(t.df.groupBy(*t.keys).agg(F.max(LAP_S).alias("lap_s")), t.keys))
    ms = lambda c: F.round(c / 1000 + 1e-9, 1)
    lengths = {"ph12_ms": F.col("brake_us"), "ph3_ms": F.col("end_us") - F.col("start_us"), "ph45_ms": F.col("throttle_us") - F.col("end_us")}
    numbered = t.derive(out, "start_us").number("corner_no").df
    r2 = lambda c: F.round(F.col(c) + 1e-9, 2).alias(c)
    sane = lambda c: F.round(F.when(F.col(c).between(0, 200), F.col(c)) + 1e-9, 2).alias(c)
    return numbered.select(
        *t.keys, F.round(F.col("lap_s") + 1e-9, 3).alias("lap_s"), "corner_no", "detector", *[ms(c).alias(n) for n, c in lengths.items()],
        F.col("brake_peak").alias("ph12_brake_peak"), r2("ph12_susf_avg"), "ph3_speed_min", sane("ph3_susf_avg"), sane("ph3_susr_avg"),
        r2("ph45_gas_avg"), r2("ph45_susf_avg"), ms(sum(lengths.values(), F.lit(0))).alias("total_ms"))


def lap_suspension(samples: DataFrame, roles: DataFrame, laps: DataFrame, p: CornerLimits = CornerLimits(), d: Limits = Limits()) -> DataFrame:
    """One row per lap of ``min_lap_s`` or more: apexes (band areas, or the throttle going on after an apex in runs without the ``dtps`` role), brake entries,
    full braking, each with both suspensions, and the lap's own suspension figures, over all samples of the suspension channels."""
    t = lap_track(samples, roles, laps, "speed", ["brake", "gas", "dtps", "acc", "sus_f", "sus_r"], p.min_lap_s)
    t = t.derive(hold(t.df, "laps"), "ts_us", tie=("idx",))
    value = ["speed", "sus_f", "sus_r"]
    with_dtps = roles.filter("role = 'dtps'").select("run").distinct()
    areas = band_areas(t, p.bands, p.merge_gap, p.min_rows, {"sus_f": "sus_f", "sus_r": "sus_r"}).join(with_dtps, "run", "left_semi")
    areas = asof(areas.select(*t.keys, F.col("mid_us").alias("ts_us"), "sus_f", "sus_r"), t.df, t.keys, "ts_us", ["speed"], like=t).select(*t.keys, *value)

    cols = [*t.keys, "ts_us", "idx", "speed"]
    plain = t.derive(t.df.join(with_dtps, "run", "left_anti"), "ts_us", tie=("idx",))
    by_speed = apex_minima(t.derive(plain.df.select(cols), "ts_us", tie=("idx",)), "speed", d.apex_gap, d.apex_window, d.apex_depth, share_of_max=d.apex_share,
                           smooth=d.apex_smooth).select(*t.keys, "ts_us")
    by_load = apex_maxima(t.derive(plain.df.select(*cols, "acc"), "ts_us", tie=("idx",)), "acc", d.load_gap, d.apex_window, -d.load_drop, 1.5 * d.load_min,
                          min_level=d.load_min, smooth=d.load_smooth).select(*t.keys, "ts_us")
    found = apexes(hold(by_load, "apexes"), hold(by_speed, "apexes"), t.keys).select(*t.keys, F.col("ts_us").alias("at_us"))
    throttle = crossing_after_low(found, plain.df, t.keys, "at_us", "ts_us", "gas", p.throttle_before, p.throttle_after, p.throttle_low)
    throttle = asof(throttle.select(*t.keys, F.col("cross_us").alias("ts_us")), plain.df, t.keys, "ts_us", value, like=t).select(*t.keys, *value)

    entry = entry_points(t, "speed", d.entry_decel, d.entry_speed, d.entry_rows, d.entry_gap, d.entry_back, d.entry_smooth, values=value)
    full = peak_areas(t, "brake", "speed", d.brake_min, d.brake_speed, d.brake_ratio, d.brake_span, {"sus_f": "sus_f", "sus_r": "sus_r"}).filter("sus_f IS NOT NULL")
    m2 = lambda c: F.round(F.avg(c) + 1e-9, 2)
    susp = lambda n: [m2("sus_f").alias(f"{n}_susf_avg"), m2("sus_r").alias(f"{n}_susr_avg")]
    speed = lambda n: [m2("speed").alias(f"{n}_speed_avg")]
    out = t.df.groupBy(*t.keys).agg(F.max(LAP_S).alias("_s")).select(
        *t.keys, F.concat("run", F.lit("_L"), F.col(LAP).cast("string")).alias("lap_id"), F.round(F.col("_s") + 1e-9, 3).alias("lap_s"))
    out = out.withColumn("lap_time", lap_text(F.col("lap_s")))
    for name, events, aggs in (("apex", areas.unionByName(throttle), [*speed("apex"), *susp("apex")]), ("brake", entry, [*speed("brake"), *susp("brake")]),
                               ("full_brake", full, susp("full_brake"))):
        out = out.join(events.groupBy(*t.keys).agg(F.count(F.lit(1)).alias(f"{name}_count"), *aggs), t.keys, "left").na.fill(0, [f"{name}_count"])
    r2 = lambda c: F.round(c + 1e-9, 2)
    for role, aggs in (("sus_f", [("lap_susf_mean", F.avg), ("lap_susf_min", F.min), ("lap_susf_max", F.max)]), ("sus_r", [("lap_susr_mean", F.avg)])):
        own = lap_track(samples, roles, laps, role, [], p.min_lap_s).df
        out = out.join(own.groupBy(*t.keys).agg(*[r2(f(role)).alias(n) for n, f in aggs]), t.keys, "left")
    return out
