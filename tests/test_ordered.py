"""Sliced computation of big groups against the plain way and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from laplens.operators import ordered as o
from laplens.operators import signal as sig


@pytest.fixture(scope="module")
def rows():
    """One key holds more than a third of all rows; clocks are bursty, values tie and miss."""
    rnd = random.Random(7)
    out, i = [], 0
    for key, n in [("hot", 160), ("a", 60), ("b", 50), ("c", 30), (None, 20)]:
        ts = 0
        for _ in range(n):
            ts += rnd.choice([1, 1, 2, 3, 50, 400])
            out.append((key, ts, i, rnd.choice([None, 1.0, 2.0, 2.5, 7.0, 9.0]), rnd.random() < 0.6))
            i += 1
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "key string, ts long, id long, v double, m boolean").repartition(3)


def got(frame, *cols):
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=repr)


LIMITS = [10_000, 12]


def test_limits_take_both_paths(df):
    assert o.Track.open(df, ["key"], "ts", limit=10_000).fits
    assert not o.Track.open(df, ["key"], "ts", limit=12).fits
    assert o.slice_by_range(df, ["key"], [F.col("v")], 10_000) is None
    assert o.slice_by_range(df, ["key"], [F.col("v"), F.col("id")], 12) is not None


def test_every_scan_is_the_same_in_slices(df):
    specs = dict(prev=o.before(F.col("v")), nxt=o.after(F.col("v")), seen=o.last_seen(F.col("v")),
                 earlier=o.last_seen(F.col("v"), inclusive=False), total=o.running(F.col("v")), rn=o.running(F.lit(1)))
    a, b = [got(o.Track.open(df, ["key"], "ts", limit=n).scan(**specs).df, "id", *specs) for n in LIMITS]
    assert a == b


@pytest.mark.parametrize("lo,hi", [(-5, 5), (-100, 0), (1, 60), (-3000, 3000)])
def test_frames_are_the_same_in_slices(df, rows, lo, hi):
    a, b = [got(o.Track.open(df, ["key"], "ts", limit=n).frame(lo, hi, n=F.count("v"), top=F.max("v")).df, "id", "n", "top") for n in LIMITS]
    assert a == b
    brute = []
    for k, ts, i, _, _ in rows:
        near = [v for k2, t2, _, v, _ in rows if k2 == k and ts + lo <= t2 <= ts + hi and v is not None]
        brute.append((i, len(near), max(near) if near else None))
    assert a == sorted(brute, key=repr)


@pytest.mark.parametrize("keys", [["key"], []])
def test_positions_in_any_order(df, keys):
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    a, b = [got(o.number(df, keys, order, "rn", "n", limit=n, best=F.min("v")), "id", "rn", "n", "best") for n in LIMITS]
    assert a == b
    a, b = [got(o.neighbours(df, keys, order, limit=n, p=o.before(F.col("id")), s=o.running(F.col("id"))), "id", "p", "s") for n in LIMITS]
    assert a == b


def test_quantiles_interpolate(df):
    qs = {"q0": 0.0, "q2": 0.02, "q50": 0.5, "q98": 0.98}
    a, b = [got(o.quantiles(df, ["key"], "v", qs, limit=n), "key", *[F.round(q, 9) for q in qs]) for n in LIMITS]
    assert a == b


def test_keep_one_and_first_k(df, rows):
    last = {k: max(r[2] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    assert {r.key: r.id for r in o.keep_one(df, ["key"], F.col("id")).collect()} == last
    top = o.first_k(df, ["key"], [F.col("id").desc()], 3)
    assert top.count() == 15
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def greedy(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] >= gap:
            out.append(t)
    return out


@pytest.mark.parametrize("gap", [1, 2, 4, 30, 500])
def test_minimum_gap_against_brute_force(df, rows, gap):
    want = sorted(((k, t) for k in {r[0] for r in rows if r[0]} for t in greedy([r[1] for r in rows if r[0] == k], gap)), key=repr)
    named = df.filter("key is not null")
    for limit in LIMITS:
        assert got(sig.min_gap(named, ["key"], "ts", gap, limit), "key", "ts") == want


def test_minimum_gap_on_one_long_cluster(spark):
    rnd = random.Random(3)
    times = sorted({rnd.randrange(0, 6000) for _ in range(3000)})
    df = spark.createDataFrame([("x", t) for t in times], "key string, ts long")
    for limit in (10_000, 700):
        assert [t for _, t in got(sig.min_gap(df, ["key"], "ts", 40, limit).orderBy("ts"), "key", "ts")] == sorted(greedy(times, 40), key=lambda t: repr(("x", t)))


def test_islands_partition_the_true_rows(df, rows):
    named = df.filter("key is not null")
    found = []
    for limit in LIMITS:
        t = o.Track.open(named, ["key"], "ts", ("id",), limit)
        found.append(got(sig.islands(t, F.col("m")), "key", "start_us", "end_us", "n"))
    assert found[0] == found[1]
    assert sum(r[3] for r in found[0]) == sum(1 for r in rows if r[0] and r[4])


def test_asof_both_directions(df, rows):
    left = df.filter("m and key is not null").select("key", "ts", "id")
    right = df.filter("not m and key is not null").select("key", "ts", F.col("id").alias("hit"))
    named = [r for r in rows if r[0]]
    for fn, pick in [(sig.asof, lambda k, t: max([(r[1], r[2]) for r in named if r[0] == k and not r[4] and r[1] <= t], default=(0, None))[1]),
                     (sig.asof_next, lambda k, t: min([(r[1], r[2]) for r in named if r[0] == k and not r[4] and r[1] >= t], default=(0, None))[1])]:
        want = sorted(((r[2], pick(r[0], r[1])) for r in named if r[4]), key=repr)
        for limit in LIMITS:
            assert got(fn(left, right, ["key"], "ts", ["hit"], limit=limit), "id", "hit") == want
