"""Corner phases and run dynamics on small tracks."""

import random

import pytest
from pyspark.sql import functions as F

from laplens.operators import dynamics, phases
from laplens.operators.events import forward_run
from laplens.operators.ordered import Track


def track(spark, rows, schema, limit=None):
    return Track.open(spark.createDataFrame(rows, schema), ["run"], "ts_us", (), limit)


@pytest.mark.parametrize("limit", [None, 7])
def test_span_means_of_overlapping_spans(spark, limit):
    rng = random.Random(3)
    rows = [(r, at, rng.choice([None, rng.uniform(-9, 9)]), float(at)) for r in (1, 2) for at in sorted(rng.sample(range(500), 120))]
    spans = [(r, a, a + rng.randrange(0, 90)) for r in (1, 2) for a in rng.sample(range(-20, 520), 40)]
    t = track(spark, rows, "run int, ts_us long, x double, y double", limit)
    for closed in (False, True):
        got = phases.span_means(t, spark.createDataFrame(spans + spans[:3], "run int, a long, b long"), "a", "b", {"mx": "x", "my": "y"}, closed)
        got = {(r.run, r.a, r.b): (r.mx, r.my) for r in got.collect()}
        assert set(got) == set(spans)
        for (run, a, b), (mx, my) in got.items():
            inside = [r for r in rows if r[0] == run and a <= r[1] < b + closed]
            for value, own in ((mx, [r[2] for r in inside if r[2] is not None]), (my, [r[3] for r in inside])):
                assert value == (pytest.approx(sum(own) / len(own)) if own else None)


@pytest.mark.parametrize("limit", [None, 5])
def test_forward_run_needs_consecutive_rows(spark, limit):
    gas = [0, 9, 9, 9, 0, 9, 9, 9, 9, 9, 9, 0, None, 9, 9, 9, 9]
    t = track(spark, [(1, 10 * i, None if g is None else float(g)) for i, g in enumerate(gas)], "run int, ts_us long, gas double", limit)
    segs = spark.createDataFrame([(1, 0, e) for e in (0, 15, 60, 75, 130, 160)], "run int, start_us long, end_us long")
    got = {r.end_us: (r.found, r.throttle_us) for r in forward_run(segs, t, "gas", 6, 4, 65).collect()}
    #         4 rows from 50 on end at 80;  from 60;  70 to 100 begins before 75, 80 has only three;  from 130
    assert got == {0: (False, 65), 15: (False, 80), 60: (True, 60), 75: (False, 140), 130: (True, 130), 160: (False, 225)}


def lap(no, n_areas, n_braked, length_s=90.0):
    """Rows of one lap: areas of three rows, and brake peaks of three rows followed by the slowest row; rows between them are neither."""
    out, at = [], 0
    for _ in range(n_areas):
        out += [(1, no, at + 100_000 * i, i, 100.0, 0.0, 0.0, length_s) for i in range(3)] + [(1, no, at + 400_000, 9, 100.0, 0.4, 0.0, length_s)]
        at += 3_000_000
    for _ in range(n_braked):
        out += [(1, no, at + 100_000 * i, i, 100.0 - 10 * i, 5.0, 50.0, length_s) for i in range(3)] + [(1, no, at + 400_000, 9, 20.0, 0.4, 50.0, length_s)]
        at += 6_000_000
    return out


def test_the_detector_is_chosen_per_lap(spark):
    laps = {0: (6, 0), 1: (0, 3), 2: (4, 6), 3: (6, 12), 4: (6, 13), 5: (4, 6), 6: (4, 0)}
    rows = [r for no, (a, b) in laps.items() for r in lap(no, a, b, 70.0 if no == 5 else 90.0)]
    df = spark.createDataFrame(rows, "run int, lap_no long, ts_us long, idx long, speed double, brake double, gas double, lap_s double")
    p = phases.CornerLimits(bands={"brake": (-0.6, 0.3), "gas": (0.0, 6.0)})
    got = phases.corner_segments(Track.open(df, ["run", "lap_no"], "ts_us", ("idx",)), p)
    counts = {(r.lap_no, r.detector): r["count"] for r in got.groupBy("lap_no", "detector").count().collect()}
    # lap 2: fewer than five on a long lap; lap 5: as many on a shorter one; lap 6: no corner to fall back on
    assert counts == {(0, "bands"): 6, (1, "brake"): 3, (2, "brake"): 6, (3, "bands"): 6, (4, "brake"): 13, (5, "bands"): 4, (6, "bands"): 4}


def test_laps_cut_the_track(spark):
    samples = [(1, c, i, i * step, float(i)) for c, n, step in (("S", 10, 1_000_000), ("B", 20, 500_000)) for i in range(n)]
    samples = spark.createDataFrame(samples, "run int, channel string, idx long, ts_us long, value double")
    roles = spark.createDataFrame([(1, "speed", "S"), (1, "brake", "B"), (1, "gas", "S")], "run int, role string, channel string")
    ends = spark.createDataFrame([(1, 2_000), (1, 5_000), (1, 8_000)], "run int, end_ms long")
    laps = dynamics.recorded_laps(ends, spark.createDataFrame([(1, 9), (2, 70)], "run int, clock_us long"))
    assert sorted(map(tuple, laps.collect())) == [(1, 0, 0, 2_000_000), (1, 1, 2_000_000, 5_000_000), (1, 2, 5_000_000, 8_000_000), (2, 0, 0, 70)]
    t = dynamics.lap_track(samples, roles, laps, "speed", ["brake", "gas"], 3.0)
    got = t.df.select("lap_no", "ts_us", "speed", "brake", "gas", F.col("lap_s")).orderBy("ts_us").collect()
    assert [tuple(r) for r in got] == [(1 + (i >= 5), i * 1_000_000, float(i), 2.0 * i, float(i), 3.0) for i in range(2, 8)]
