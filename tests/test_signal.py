"""Detectors on synthetic traces with known answers."""

import math

import numpy as np
from pyspark.sql import functions as F

from laplens.operators import events as ev
from laplens.operators import signal as sig
from laplens.operators.ordered import Track

DT = 10_000  # 100 Hz in microseconds


def track(spark, **cols):
    n = len(next(iter(cols.values())))
    rows = [("r", i * DT, *[None if c[i] is None else float(c[i]) for c in cols.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "run string, ts long, " + ", ".join(f"{c} double" for c in cols))
    return Track.open(df, ["run"], "ts")


def starts(df, col="start_us"):
    return sorted(r[0] // DT for r in df.select(col).collect())


def test_row_smoothing_equals_convolution(spark):
    x = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0, 4.0, 0.0, 6.0, 7.0]
    for w in (3, 4, 5, 7):
        got = [r.s for r in sig.smooth_rows(track(spark, v=x), "v", w, "s").df.orderBy("ts").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(w) / w, mode="same"))


def test_derivative_equals_gradient(spark):
    x = [0.0, 1.0, 4.0, 9.0, 7.0, 7.0]
    got = [r.g for r in sig.derivative(track(spark, v=x), "v", "g").df.orderBy("ts").collect()]
    assert np.allclose(got, np.gradient(x, DT / 1e6))


def test_speed_minima_of_known_depth(spark):
    t = np.arange(3000) / 100.0
    speed = 200 - 60 * np.exp(-((t - 5) ** 2) / 0.5) - 80 * np.exp(-((t - 15) ** 2) / 0.5) - 10 * np.exp(-((t - 25) ** 2) / 0.5)
    found = sig.turning_points(track(spark, v=speed), "v", "min", 4_000_000, 15.0, share_of_max=0.92, smooth=300_000)
    assert [round(s / 100) for s in starts(found, "ts")] == [5, 15]  # the 10 km/h dip is no corner


def test_islands_merge_at_twenty_but_not_at_twenty_one(spark):
    inside = [0.0] * 10 + [9.0] * 19 + [0.0] * 10 + [9.0] * 20 + [0.0] * 10 + [9.0] * 5
    t = track(spark, v=inside)
    found = sig.islands(t, F.col("v") < 1)
    merged = sig.merge_islands(found, ["run"], 20 * DT, F.sum("n").alias("n"))
    assert sorted((r.start_us // DT, r.end_us // DT, r.n) for r in merged.collect()) == [(0, 38, 20), (59, 68, 10)]


def test_limiter_needs_three_seconds(spark):
    speed = [120.0] * 100 + [60.0] * 290 + [120.0] * 100 + [60.0] * 331 + [120.0] * 100
    zones = ev.limiter_zones(track(spark, speed=speed), "speed", smooth=0)
    assert starts(zones) == [490]


def test_brake_entry_and_full_braking(spark):
    speed = [200.0] * 200 + [200 - 1.0 * i for i in range(100)] + [100.0] * 200
    brake = [0.0] * 200 + [10 * math.sin(math.pi * i / 100) for i in range(100)] + [0.0] * 200
    t = track(spark, speed=speed, brake=brake, susp=list(range(500)))
    entry = ev.entry_points(t, "speed", values=["speed"]).collect()
    assert len(entry) == 1 and abs(entry[0].start_us // DT - 200) <= 4
    assert entry[0].entry_us == entry[0].start_us - 80_000 and entry[0].speed == 200.0
    full = ev.peak_areas(t, "brake", "speed", means={"s": "susp"}).collect()
    assert len(full) == 1 and abs(full[0].s - 250) < 1 and full[0].peak == 10.0


def test_phases_around_a_segment(spark):
    #        braking 100..149 | coast 150..169 | segment 170..189 | coast .. throttle: four, then five rows
    brake = [0.0] * 100 + [5.0] * 50 + [0.0] * 150
    gas = [0.0] * 200 + [9.0] * 4 + [0.0] * 6 + [9.0] * 90
    t = track(spark, brake=brake, gas=gas, speed=[100.0 - i / 10 for i in range(300)], susp=[50.0] * 300)
    seg = spark.createDataFrame([("r", 170 * DT, 189 * DT)], "run string, start_us long, end_us long")
    back = ev.back_search(seg, t, "brake", mean="susp").first()
    assert back.brake_start_us == 100 * DT and back.brake_us == 70 * DT and back.brake_peak == 5.0
    fwd = ev.forward_run(seg, t, "gas").first()
    assert fwd.found and fwd.throttle_us == 210 * DT and fwd.exit_us == 21 * DT
    core = ev.phase_core(seg, t, "speed", "susp", 1_000_000).first()
    assert core.core_us == 19 * DT and abs(core.speed_min - (100 - 18.9)) < 1e-9
    short = ev.forward_run(seg, t, "gas", cap=100_000).first()
    assert not short.found and short.throttle_us == 189 * DT + 100_000


def test_edges_and_units(spark):
    bar = [1.5] * 20 + [1.8] * 60 + [2.1] * 20
    kpa = [v * 100 for v in bar]
    rows = [(r, i * DT, v) for r, vs in (("bar", bar), ("kpa", kpa)) for i, v in enumerate(vs)]
    df = ev.unit_scaled(spark.createDataFrame(rows, "run string, ts long, p double"), ["run"], "p")
    out = ev.edge_stats(Track.open(df, ["run"], "ts"), "scaled", 0.8, 5.0).collect()
    for r in out:
        assert abs(r.start_val - 1.5) < 1e-9 and abs(r.end_val - 2.1) < 1e-9 and abs(r.delta_val - 0.6) < 1e-9


def test_corners_from_braking(spark):
    brake = [0.0] * 100 + [3.0] * 30 + [0.0] * 170 + [3.0] * 5 + [0.0] * 195
    speed = [150.0] * 100 + [150 - i for i in range(80)] + [71 + i / 2 for i in range(160)] + [150.0] * 160
    found = ev.brake_corners(track(spark, brake=brake, speed=speed), "brake", "speed", step=DT)
    assert starts(found, "apex_us") == [179]  # the second pulse is under 0.1 s
    brake[400:410] = [3.0] * 10  # ten samples last 0.1 s
    both = ev.brake_corners(track(spark, brake=brake, speed=speed), "brake", "speed", step=DT)
    assert len(starts(both, "apex_us")) == 2


def test_lap_bounds_start_at_zero(spark):
    ends = spark.createDataFrame([("r", 95_000), ("r", 180_000), ("r", 262_000)], "run string, end_ms long")
    laps = sig.lap_bounds(ends, ["run"], "end_ms").orderBy("lap_no").collect()
    assert [(r.lap_no, r.start_us, r.duration_us) for r in laps] == [(0, 0, 95_000), (1, 95_000, 85_000), (2, 180_000, 82_000)]
