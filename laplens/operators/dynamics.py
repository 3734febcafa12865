"""Dynamics of a run: every detector over its laps, in one row per run.

The samples of all channels are spread over the clock once, together with the starts of the laps, which travel as channels of their own;
then only the rows of the base channel remain. Masks of several detectors are labelled in one scan and their islands added up in one
aggregation, keyed by detector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.functions.measures import wheel_loads
from laplens.operators.events import apex_maxima, apex_minima, apexes, edge_stats, unit_scaled
from laplens.operators.ordered import Track, last_seen, with_group_stats
from laplens.operators.signal import SECOND, asof, derivative, lap_bounds, min_gap, smooth_time, spread_channels
from laplens.session import hold

LAP, LAP_S = "lap_no", "lap_s"


@dataclass(frozen=True)
class Limits:
    """Thresholds in km/h, m/s², bar and seconds; gaps and windows in microseconds."""

    min_lap_s: float = 60.0
    apex_share: float = 0.92
    apex_depth: float = 15.0
    apex_window: int = 4 * SECOND
    apex_gap: int = 250_000
    apex_smooth: int = 300_000
    load_min: float = 1.5
    load_drop: float = 0.6
    load_gap: int = 400_000
    load_smooth: int = 250_000
    pit_lo: float = 56.0
    pit_hi: float = 64.0
    pit_span: int = 3 * SECOND
    pit_smooth: int = 200_000
    entry_decel: float = -8.0
    entry_speed: float = 80.0
    entry_rows: int = 15
    entry_gap: int = 800_000
    entry_back: int = 80_000
    entry_smooth: int = 70_000
    brake_min: float = 1.0
    brake_speed: float = 80.0
    brake_ratio: float = 0.85
    brake_span: int = 50_000
    tyre_lo: float = 0.8
    tyre_hi: float = 5.0


def recorded_laps(ends: DataFrame, lengths: DataFrame) -> DataFrame:
    """(run, lap_no, start_us, end_us) from cumulative lap ends in ms; a run without ends (``lengths``: run, clock_us) is one lap."""
    timed = lap_bounds(ends.select("run", (F.col("end_ms") * 1000).alias("end_at")), ["run"], "end_at").select("run", "lap_no", "start_us", "end_us")
    whole = lengths.join(ends.select("run").distinct(), "run", "left_anti")
    return timed.unionByName(whole.select("run", F.lit(0).cast("long").alias("lap_no"), F.lit(0).cast("long").alias("start_us"), F.col("clock_us").alias("end_us")))


def lap_track(samples: DataFrame, roles: DataFrame, laps: DataFrame, base: str, others: list[str], min_lap_s: float) -> Track:
    """Rows of the role ``base`` inside laps of at least ``min_lap_s``, as a track per (run, lap), with the latest value of each role.

    ``samples``: run, channel, idx, ts_us, value; ``roles``: run, role, channel. A lap's number and length are written on its start, and the
    end of the last lap ends them."""
    wanted = roles.filter(F.col("role").isin(base, *others))
    order = F.when(F.col("role") == base, len(others))
    for i, role in enumerate(others):
        order = order.when(F.col("role") == role, i)
    rows = samples.join(wanted, ["run", "channel"]).select("run", "role", "idx", "ts_us", "value", order.alias("ord"))
    last = laps.groupBy("run").agg(F.max("end_us").alias("start_us")).select("run", F.lit(-1.0).alias("no"), "start_us", F.lit(0.0).alias("s"))
    marks = laps.select("run", F.col("lap_no").cast("double").alias("no"), "start_us", ((F.col("end_us") - F.col("start_us")) / SECOND).alias("s"))
    marks = marks.unionByName(last).select("run", "start_us", F.explode(F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(c).alias("value"), F.lit(o).alias("ord")) for r, c, o in ((LAP, "no", -2), (LAP_S, "s", -1))])).alias("m"))
    marks = marks.select("run", "m.role", F.lit(-1).cast("long").alias("idx"), F.col("start_us").alias("ts_us"), "m.value", "m.ord")
    t = spread_channels(rows.unionByName(marks), ["run"], "ts_us", "role", "value", {c: c for c in (base, *others, LAP, LAP_S)}, ("ord", "idx"))
    kept = t.df.filter((F.col("role") == base) & (F.col(LAP) >= 0) & (F.col(LAP_S) >= min_lap_s))
    return t.derive(kept.withColumn(LAP, F.col(LAP).cast("long")).drop("role", "value", "ord"), "ts_us", ["run", LAP], ("idx",))


def label_all(t: Track, masks: dict[str, Column]) -> Track:
    """``on_x`` and ``gap_x`` for each mask x, in one scan: rows of one island share the gap, the last false row before them."""
    t = t.columns(**{f"on_{m}": F.coalesce(c, F.lit(False)) for m, c in masks.items()})
    return t.scan(**{f"gap_{m}": last_seen(F.when(~F.col(f"on_{m}"), F.struct(t.ts, *t.tie))) for m in masks})


def all_islands(labelled: Track, masks: list[str], *aggs: Column) -> DataFrame:
    """Islands of all masks of :func:`label_all` with ``detector``, start_us, end_us, n and further aggregates, in one aggregation."""
    marks = F.array(*[F.struct(F.lit(m).alias("detector"), F.col(f"on_{m}").alias("on"), F.col(f"gap_{m}").alias("gap")) for m in masks])
    rows = labelled.df.withColumn("_mark", F.explode(F.filter(marks, lambda m: m["on"])))
    return (rows.groupBy(*labelled.keys, F.col("_mark.detector").alias("detector"), F.col("_mark.gap").alias("_gap"))
            .agg(F.min(labelled.ts).alias("start_us"), F.max(labelled.ts).alias("end_us"), F.count(F.lit(1)).alias("n"), *aggs).drop("_gap"))


def _mean(c: str | Column, digits: int = 1) -> Column:
    """Mean of event values, each rounded as it is shown."""
    return F.round(F.avg(F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)) + 1e-9, 2)


def tyre_levels(samples: DataFrame, roles: DataFrame, tyres: list[str], p: Limits) -> DataFrame:
    """(run, start, end, avg, delta of each role) of the tyres' pressures in bar, all roles in one pass."""
    keys = ["run", "role"]
    rows = samples.join(roles.filter(F.col("role").isin(*tyres)), ["run", "channel"]).select(*keys, "ts_us", "idx", "value")
    level = edge_stats(Track.open(hold(unit_scaled(rows, keys, "value"), "pressures"), keys, "ts_us", ("idx",)), "scaled", p.tyre_lo, p.tyre_hi)
    r1 = lambda role, c: F.max(F.when(F.col("role") == role, F.round(F.col(c + "_val") + 1e-9, 1))).alias(f"{role}_{c}")
    return level.groupBy("run").agg(*[r1(role, c) for role in tyres for c in ("start", "end", "avg", "delta")])


def run_dynamics(samples: DataFrame, roles: DataFrame, laps: DataFrame, runs: DataFrame, p: Limits = Limits()) -> DataFrame:
    """One row per run of ``runs`` (run, mass, wheelbase, cog_h, f_ratio and what describes it): counts and means of apexes with wheel loads and
    acceleration, pit limiter zones, brake entries and full braking, with both suspensions, and both tyres' pressures. Events are looked for in each
    lap of ``min_lap_s`` or more. Counts are 0 and means null where a run has none."""
    t = lap_track(samples, roles, laps, "speed", ["brake", "acc", "sus_f", "sus_r"], p.min_lap_s)
    t = t.columns(v=F.col("speed") / 3.6)
    t = smooth_time(smooth_time(t, "speed", p.pit_smooth, "_pit"), "v", p.entry_smooth, "_sv")
    t = derivative(derivative(t, "_sv", "_a"), "v", "ax")
    t = label_all(t, {"pit": F.col("_pit").between(p.pit_lo, p.pit_hi), "entry": (F.col("_a") < p.entry_decel) & (F.col("speed") >= p.entry_speed),
                      "brake": (F.col("brake") >= p.brake_min) & (F.col("speed") >= p.brake_speed)})
    t = t.derive(hold(t.df.drop("_pit", "_sv", "_a", "v"), "dynamics"), "ts_us", tie=("idx",))
    spans = hold(all_islands(t, ["pit", "entry"], F.avg("speed").alias("speed"), F.avg("sus_f").alias("sus_f"), F.avg("sus_r").alias("sus_r")), "spans")

    pit = spans.filter((F.col("detector") == "pit") & (F.col("end_us") - F.col("start_us") >= p.pit_span))
    starts = spans.filter((F.col("detector") == "entry") & (F.col("n") >= p.entry_rows)).select(*t.keys, "start_us")
    kept = min_gap(starts, t.keys, "start_us", p.entry_gap, like=t)
    entry = asof(kept.withColumn("ts_us", F.col("start_us") - p.entry_back), t.df, t.keys, "ts_us", ["speed", "sus_f", "sus_r"], like=t)

    hard = with_group_stats(t.df.filter("on_brake"), [*t.keys, "gap_brake"], F.max("brake").alias("peak"), F.min("ts_us").alias("from_us"),
                            F.max("ts_us").alias("to_us"))
    hard = hard.filter((F.col("to_us") - F.col("from_us") >= p.brake_span) & (F.col("brake") >= F.col("peak") * p.brake_ratio))
    full = hard.groupBy(*t.keys, "from_us").agg(F.avg("sus_f").alias("sus_f"), F.avg("sus_r").alias("sus_r"))

    cols = ["run", LAP, "ts_us", "speed", "sus_f", "sus_r", "ax"]
    slow = t.derive(t.df.select(*cols, "idx"), "ts_us", tie=("idx",))
    by_speed = hold(apex_minima(slow, "speed", p.apex_gap, p.apex_window, p.apex_depth, share_of_max=p.apex_share, smooth=p.apex_smooth).select(cols), "apexes")
    load = t.derive(t.df.select(*cols, "idx", "acc"), "ts_us", tie=("idx",))
    by_load = hold(apex_maxima(load, "acc", p.load_gap, p.apex_window, -p.load_drop, 1.5 * p.load_min, min_level=p.load_min, smooth=p.load_smooth).select(cols), "apexes")
    apex = apexes(by_load, by_speed, t.keys).filter(F.col("speed") >= 0).join(runs.select("run", "mass", "wheelbase", "cog_h", "f_ratio"), "run")
    apex = apex.withColumns(wheel_loads(*[F.col(c) for c in ("mass", "ax", "wheelbase", "cog_h", "f_ratio")]))

    count = F.count(F.lit(1))
    susp = lambda name: [_mean("sus_f").alias(f"{name}_susf_avg"), _mean("sus_r").alias(f"{name}_susr_avg")]
    out = runs.drop("mass", "wheelbase", "cog_h", "f_ratio")
    for name, events, aggs in (
            ("apex", apex, [_mean("speed").alias("apex_speed_avg"), *susp("apex"), _mean("load_f").alias("apex_load_f_avg"),
                            _mean("load_r").alias("apex_load_r_avg"), _mean("ax", 2).alias("apex_ax_avg")]),
            ("pit", pit, [_mean("speed").alias("pit_speed_avg"), *susp("pit")]),
            ("brake", entry, [_mean("speed").alias("brake_speed_avg"), *susp("brake")]),
            ("full_brake", full, susp("full_brake"))):
        out = out.join(events.groupBy("run").agg(count.alias(f"{name}_count"), *aggs), "run", "left").na.fill(0, [f"{name}_count"])
    return out.join(tyre_levels(samples, roles, ["tyre_f", "tyre_r"], p), "run", "left")
