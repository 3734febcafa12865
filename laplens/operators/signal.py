"""Time-series operators on (keys, clock, value) rows. No column here is bound to a sensor name.

Clocks are long microseconds; masks are boolean columns, null counts as false.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.operators.ordered import Track, after, before, group_limit, join_on, last_seen, running
from laplens.session import hold, release, ship

SECOND = 1_000_000


def sample_rate(samples: DataFrame, ends: DataFrame, keys: list[str], end_ms: str,
                lo: float = 10.0, hi: float = 500.0, default: float = 100.0) -> DataFrame:
    """Samples per second of each run from its sample count and last lap end, kept inside [lo, hi]."""
    n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    last = ends.groupBy(*keys).agg(F.max(end_ms).alias("last_ms"))
    rate = F.col("n_samples") / (F.col("last_ms") / 1000.0)
    return n.join(last, keys, "left").withColumn(
        "rate_hz", F.when(F.col("last_ms") > 0, F.least(F.greatest(rate, F.lit(lo)), F.lit(hi))).otherwise(F.lit(default)))


def lap_bounds(ends: DataFrame, keys: list[str], end: str, start: str | None = None,
               limit: int | None = None) -> DataFrame:
    """Cumulative lap ends to (lap_no, start, end, duration). Lap 0 begins at ``start`` (default 0)."""
    t = Track.open(ends, keys, end, limit=limit).scan(
        lap_no=running(F.lit(1).cast("long")), _prev=before(F.col(end)))
    origin = F.col(start) if start else F.lit(0).cast("long")
    return (t.df.withColumn("lap_no", F.col("lap_no") - 1).withColumn("start_us", F.coalesce(F.col("_prev"), origin))
            .withColumn("end_us", F.col(end)).drop("_prev")
            .withColumn("duration_us", F.col("end_us") - F.col("start_us")))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], ts: str, start: str, end: str,
                  width: int, closed: bool = False, how: str = "inner") -> DataFrame:
    """Pair points with the spans of the same keys that cover them.

    Both sides meet on (keys, clock bucket): a span is listed once per bucket it touches, so the join
    stays an equi-join that AQE can split when one key is hot.
    """
    p = points.withColumn("_b", F.floor(F.col(ts) / width))
    top = F.col(end) if closed else F.col(end) - 1
    s = (spans.filter(top >= F.col(start))
         .withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(top / width)))))
    for k in [*keys, "_b"]:
        s = s.withColumnRenamed(k, f"_s_{k}")
    cond = F.lit(True)
    for k in [*keys, "_b"]:
        cond = cond & (p[k] == s[f"_s_{k}"])
    hit = (p[ts] >= s[start]) & ((p[ts] <= s[end]) if closed else (p[ts] < s[end]))
    return p.join(s, cond & hit, how).drop("_b", *[f"_s_{k}" for k in [*keys, "_b"]])


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, cols: list[str],
         strict: bool = False, limit: int | None = None, like: Track | None = None) -> DataFrame:
    """Latest ``cols`` of ``right`` at or before (``strict``: before) each row of ``left``. ``like``: the
    track both sides were found in."""
    rest = [c for c in left.columns if c not in (*keys, ts)]
    lrow = left.select(*keys, ts, F.lit(0 if strict else 1).alias("_side"), F.lit(True).alias("_is_left"),
                       F.struct(*(rest or [F.lit(1).alias("_x")])).alias("_l"))
    rrow = right.select(*keys, ts, F.lit(1 if strict else 0).alias("_side"), F.lit(False).alias("_is_left"),
                        F.struct(*cols).alias("_r"))
    both = lrow.unionByName(rrow, allowMissingColumns=True)
    t = like.derive(both, ts, keys, ("_side",)) if like else Track.open(both, keys, ts, ("_side",), limit)
    t = t.scan(_hit=last_seen(F.col("_r")))
    return t.df.filter("_is_left").select(*keys, ts, *[F.col(f"_l.{c}").alias(c) for c in rest],
                                          *[F.col(f"_hit.{c}").alias(c) for c in cols])


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], ts: str, cols: list[str],
              limit: int | None = None, like: Track | None = None) -> DataFrame:
    """Earliest ``cols`` of ``right`` at or after each row of ``left``."""
    flip = lambda df: df.withColumn(ts, -F.col(ts))
    return flip(asof(flip(left), flip(right), keys, ts, cols, limit=limit, like=like))


def spread_channels(samples: DataFrame, keys: list[str], ts: str, channel: str, value: str,
                    names: dict[str, str], tie: tuple = (), limit: int | None = None) -> Track:
    """Every sample row with the latest value of each channel (``names``: output column -> channel)."""
    t = Track.open(samples, keys, ts, tie, limit)
    return t.scan(**{out: last_seen(F.when(F.col(channel) == name, F.col(value))) for out, name in names.items()})


def bucket_align(samples: DataFrame, keys: list[str], ts: str, channel: str, value: str,
                 names: dict[str, str], width: int) -> DataFrame:
    """Mean of each channel per clock bucket: one row per bucket, whatever the channel rates."""
    return (samples.withColumn("bucket", F.floor(F.col(ts) / width))
            .groupBy(*keys, "bucket")
            .agg(*[F.avg(F.when(F.col(channel) == name, F.col(value))).alias(out) for out, name in names.items()]))


def smooth_time(t: Track, col: str, width: int, out: str) -> Track:
    """Centred mean over ``width`` of clock."""
    return t.frame(-(width // 2), width // 2, **{out: F.avg(col)})


def smooth_rows(t: Track, col: str, w: int, out: str) -> Track:
    """Centred mean over ``w`` rows; missing rows at the ends count as zero, an even ``w`` leans back."""
    placed = t.number("_at").df
    half = w // 2
    # positions are dense, so slices of the row limit hold exactly that many rows
    by_row = Track(placed, t.keys, "_at", width=None if t.fits else group_limit(placed))
    by_row = by_row.frame(-half, half if w % 2 else half - 1, _sum=F.sum(col))
    return t._on(by_row.df.withColumn(out, F.col("_sum") / w).drop("_sum", "_at"))


def derivative(t: Track, col: str, out: str, unit: int = SECOND) -> Track:
    """Central difference per ``unit`` of clock, one-sided at the ends."""
    here, clock = F.col(col), F.col(t.ts)
    t = t.scan(_pv=before(here), _pt=before(clock), _nv=after(here), _nt=after(clock))
    rise = F.coalesce(F.col("_nv"), here) - F.coalesce(F.col("_pv"), here)
    span = F.coalesce(F.col("_nt"), clock) - F.coalesce(F.col("_pt"), clock)
    slope = F.when(span > 0, rise / (span / unit)).otherwise(F.lit(0.0))
    return t._on(t.df.withColumn(out, slope).drop("_pv", "_pt", "_nv", "_nt"))


def turning_points(t: Track, col: str, kind: str, window: int, min_depth: float,
                   share_of_max: float | None = None, min_level: float | None = None,
                   smooth: int | None = None, scope: list[str] | None = None) -> DataFrame:
    """Rows where the slope turns: ``kind`` "min" (falling to rising) or "max".

    A minimum must lie below ``share_of_max`` of the group maximum and ``min_depth`` below the highest
    value within ``window`` on either side; a maximum must reach ``min_level`` and may lie at most
    ``-min_depth`` below the highest other value within ``window``.
    """
    if smooth:
        t = smooth_time(t, col, smooth, "_s")
    else:
        t = t.columns(_s=F.col(col))
    t = derivative(t, "_s", "_g")
    t = t.scan(_g_next=after(F.col("_g")))
    if kind == "min":
        turn = (F.col("_g") < 0) & (F.col("_g_next") >= 0)
        t = t.frame(-window, window, _peak=F.max("_s"))
        t = t.columns(level=F.col("_s"), depth=F.col("_peak") - F.col("_s"), _turn=turn)
        df = t.df
        if share_of_max is not None:
            top = df.groupBy(*(scope or t.keys)).agg(F.max("_s").alias("_top"))
            df = df.join(top, scope or t.keys)
            df = df.filter(F.col("_s") < F.col("_top") * share_of_max).drop("_top")
        keep = F.col("_turn") & (F.col("depth") >= min_depth)
    else:
        turn = (F.col("_g") >= 0) & (F.col("_g_next") < 0)
        t = t.frame(-window, -1, _left=F.max("_s")).frame(1, window, _right=F.max("_s"))
        others = F.greatest(F.col("_left"), F.col("_right"))
        t = t.columns(level=F.col("_s"), depth=F.col("_s") - others, _turn=turn)
        df = t.df
        keep = F.col("_turn") & (F.col("depth") >= min_depth)
        if min_level is not None:
            keep = keep & (F.col("_s") >= min_level)
    return df.filter(keep).drop("_s", "_g", "_g_next", "_peak", "_left", "_right", "_turn")


# ---------------------------------------------------------------------------------------------
# islands


def label_islands(t: Track, mask: Column, label: str = "island") -> DataFrame:
    """The true rows, each with a value shared by its island only (and null before the first false row)."""
    t = t.columns(_on=F.coalesce(mask, F.lit(False)))
    t = t.scan(**{label: last_seen(F.when(~F.col("_on"), F.struct(t.ts, *t.tie)))})
    return t.df.filter("_on").drop("_on")


def islands(t: Track, mask: Column, *aggs: Column, start: str = "start_us", end: str = "end_us",
            n: str = "n") -> DataFrame:
    """Runs of consecutive true rows: first and last clock, row count and any further aggregates.

    All true rows after the same false row belong together, so one carried value names the island.
    """
    return (label_islands(t, mask, "_gap").groupBy(*t.keys, "_gap")
            .agg(F.min(t.ts).alias(start), F.max(t.ts).alias(end), F.count(F.lit(1)).alias(n), *aggs)
            .drop("_gap"))


def merge_islands(spans: DataFrame, keys: list[str], max_gap: int, *aggs: Column, start: str = "start_us",
                  end: str = "end_us", limit: int | None = None, like: Track | None = None) -> DataFrame:
    """Join islands whose distance is at most ``max_gap``. ``like``: the track they were found in."""
    t = like.derive(spans, start) if like else Track.open(spans, keys, start, limit=limit)
    t = t.scan(_prev=before(F.col(end)))
    fresh = F.when(F.col("_prev").isNull() | (F.col(start) - F.col("_prev") > max_gap), F.col(start))
    t = t.columns(_fresh=fresh).scan(_first=last_seen(F.col("_fresh")))
    return (t.df.groupBy(*keys, "_first")
            .agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"), *aggs)
            .withColumnRenamed("_lo", start).withColumnRenamed("_hi", end).drop("_first"))


def long_enough(spans: DataFrame, min_rows: int | None = None, min_span: int | None = None, step: int = 0,
                start: str = "start_us", end: str = "end_us", n: str = "n") -> DataFrame:
    """``step``: sample period of an even clock, where n samples last n periods; 0 counts first to last."""
    keep = F.lit(True)
    if min_rows is not None:
        keep = keep & (F.col(n) >= min_rows)
    if min_span is not None:
        keep = keep & (F.col(end) - F.col(start) + step >= min_span)
    return spans.filter(keep)


# ---------------------------------------------------------------------------------------------
# minimum gap


def _fold(arr: Column, gap: int, block: int = 256) -> Column:
    """Accepted clocks of a sorted array: each at least ``gap`` after the one accepted before. Appending copies an
    array, so the list is folded block by block."""
    count = F.floor((F.size(arr) - 1) / block)
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), count),
                         lambda i: F.slice(arr, (i * block + 1).cast("int"), F.lit(block)))

    def take(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x >= acc["last"] + F.lit(gap))
        return F.struct(F.when(ok, x).otherwise(acc["last"]).alias("last"),
                        F.when(ok, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    def whole(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["last"].alias("last"), F.array().cast("array<bigint>").alias("kept")), take)
        return F.struct(inner["last"].alias("last"), F.array_append(acc["kept"], inner["kept"]).alias("kept"))

    zero = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<array<bigint>>").alias("kept"))
    return F.flatten(F.aggregate(blocks, zero, whole)["kept"])


def _last_accepted(gap: int):
    """For one slice: each event with the last one that the chain from it accepts in the slice. One pass from the end."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_ts", ignore_index=True)
        clock = part["_ts"].to_numpy("int64")
        follow = np.searchsorted(clock, clock + gap).tolist()
        last = list(range(len(clock)))
        for i in range(len(clock) - 1, -1, -1):
            if follow[i] < len(last):
                last[i] = last[follow[i]]
        return part.assign(_last=clock[last])
    return run


def _accepted(gap: int):
    """For one slice: the events that the chain from its entry accepts."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_ts", ignore_index=True)
        clock = part["_ts"].to_numpy("int64")
        follow = np.searchsorted(clock, clock + gap)
        i, kept = int(np.searchsorted(clock, part["_entry"].iloc[0])) if len(clock) else 0, []
        while i < len(clock):
            kept.append(i)
            i = int(follow[i])
        return part.iloc[kept].drop(columns="_entry")
    return run


def min_gap(events: DataFrame, keys: list[str], ts: str, gap: int, limit: int | None = None,
            like: Track | None = None) -> DataFrame:
    """(keys, ts) of events accepted when at least ``gap`` after the last accepted one.

    An event ``gap`` or more after its predecessor is accepted whatever happened earlier, so the chain
    falls into independent clusters. A cluster is folded in one piece where groups are small. Otherwise it
    is cut by the clock into slices of bounded size. One pass per slice tells where the chain from each event leaves it;
    the events at which slices are entered are then found by doubling those jumps, and every entered slice is followed
    from its entry. Work grows with the events, and no slice is held as one value. ``like``: the track the events were
    found in.
    """
    times = events.select(*keys, ts).distinct()
    t = like.derive(times, ts, keys) if like else Track.open(times, keys, ts, limit=limit)
    t = t.scan(_prev=before(F.col(ts)))
    fresh = F.when(F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") >= gap), F.col(ts))
    t = t.columns(_fresh=fresh).scan(_cluster=last_seen(F.col("_fresh")))
    rows = t.df.select(*keys, "_cluster", F.col(ts).alias("_ts"))
    group = [*keys, "_cluster"]
    if t.fits:
        arrs = rows.groupBy(*group).agg(F.sort_array(F.collect_list("_ts")).alias("_a"))
        return arrs.select(*keys, F.explode(_fold(F.col("_a"), gap)).alias(ts))

    ship(events.sparkSession)
    rows = hold(rows.withColumn("_slot", F.floor((F.col("_ts") - F.col("_cluster")) / t.width)), "events")
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ends = hold(rows.groupBy(*group, "_slot").applyInPandas(_last_accepted(gap), layout + ", _last long"), "ends")
    leave = ends.select(*group, (F.col("_last") + gap).alias("_ts")).distinct()
    to = asof_next(leave, rows.withColumn("_to", F.col("_ts")), group, "_ts", ["_to"], like=t).filter("_to is not null")
    to = hold(to.withColumn("_last", F.col("_ts") - gap).drop("_ts"), "leaves")
    starts = rows.filter("_ts = _cluster").select(*group, "_ts")
    doors = starts.unionByName(to.select(*group, F.col("_to").alias("_ts"))).distinct()
    jumps = hold(join_on(join_on(doors, ends.select(*group, "_ts", "_last"), [*group, "_ts"], "inner"), to, [*group, "_last"], "inner")
                 .select(*group, "_ts", "_to"), "jumps")
    entered = hold(starts, "entered")
    while not jumps.isEmpty():  # doubles with each turn
        ahead = join_on(entered, jumps, [*group, "_ts"], "inner").select(*group, F.col("_to").alias("_ts"))
        further, done = hold(entered.unionByName(ahead).distinct(), "entered"), entered
        step = jumps.select(*group, F.col("_ts").alias("_from"), F.col("_to").alias("_ts"))
        doubled = hold(join_on(step, jumps, [*group, "_ts"], "inner").select(*group, F.col("_from").alias("_ts"), "_to"), "jumps")
        release(done, jumps)
        entered, jumps = further, doubled
    entry = (entered.withColumn("_slot", F.floor((F.col("_ts") - F.col("_cluster")) / t.width)).withColumnRenamed("_ts", "_entry"))
    followed = join_on(rows, entry, [*group, "_slot"], "inner").select(*rows.columns, "_entry")
    return followed.groupBy(*group, "_slot").applyInPandas(_accepted(gap), layout).select(*keys, F.col("_ts").alias(ts))


def min_gap_keep_larger(events: DataFrame, keys: list[str], ts: str, level: str, gap: int,
                        limit: int | None = None, like: Track | None = None) -> DataFrame:
    """As :func:`min_gap`, but an event inside the gap takes over when its ``level`` is larger; the gap
    keeps counting from the event accepted first."""
    like = like or Track.open(events, keys, ts, limit=limit)
    anchors = min_gap(events, keys, ts, gap, like=like).withColumn("_anchor", F.col(ts))
    tied = asof(events, anchors, keys, ts, ["_anchor"], like=like)
    row = F.struct(*[F.col(c) for c in events.columns])
    return (tied.groupBy(*keys, "_anchor")
            .agg(F.max_by(row, F.struct(F.col(level), -F.col(ts))).alias("_row"))
            .select("_row.*"))

