"""Queries over time-series operators. A user's events play one run; hours stand for seconds."""

from pyspark.sql import functions as F

from laplens.functions.measures import wheel_loads
from laplens.operators import events as ev_ops
from laplens.operators import signal as sig
from laplens.operators.ordered import Track
from laplens.plans.registry import CHANNELS, DAY, EV, HOUR, WIDE, island_cte, query, r6, samples, wide
from laplens.session import hold

ENDS = EV + """, ends AS (SELECT run, ts_us, row_number() OVER (PARTITION BY run ORDER BY ts_us) - 1 AS lap_no,
  coalesce(lag(ts_us) OVER (PARTITION BY run ORDER BY ts_us), 0) AS start_us FROM ev WHERE channel = 'purchase')"""


def lap_spans_from_first(spark, d):
    """Lap spans whose lap 0 starts at the run's first sample instead of 1970, which keeps its bucket list short."""
    first = samples(spark, d).groupBy("run").agg(F.min("ts_us").alias("_t0"))
    return lap_spans(spark, d).join(first, "run").withColumn("start_us", F.greatest("start_us", "_t0")).drop("_t0")


def lap_spans(spark, d):
    ends = samples(spark, d).filter("channel = 'purchase'").select("run", "ts_us")
    return sig.lap_bounds(ends, ["run"], "ts_us").select("run", "lap_no", "start_us", "end_us", "duration_us")


@query(f"""WITH {EV}, e AS (SELECT run, (max(ts_us) FILTER (channel = 'purchase') - min(ts_us)) // 3600000000 AS last_ms FROM ev GROUP BY run),
  n AS (SELECT run, count(*) AS n_samples FROM ev GROUP BY run)
  SELECT run, n_samples, round(CASE WHEN last_ms > 0 THEN least(greatest(n_samples / (last_ms / 1000.0), 10), 500) ELSE 100 END + 1e-9, 6) AS rate_hz
  FROM n LEFT JOIN e USING (run)""")
def sample_rate(spark, d):
    ev = samples(spark, d)
    mark = F.max(F.when(F.col("channel") == "purchase", F.col("ts_us")))
    ends = ev.groupBy("run").agg(F.floor((mark - F.min("ts_us")) / HOUR).alias("end_ms")).filter("end_ms is not null")
    return sig.sample_rate(ev, ends, ["run"], "end_ms").select("run", "n_samples", r6("rate_hz").alias("rate_hz"))


@query(f"WITH {ENDS} SELECT run, lap_no, start_us, ts_us AS end_us, ts_us - start_us AS duration_us FROM ends")
def lap_bounds(spark, d):
    return lap_spans(spark, d)


@query(f"""WITH {ENDS} SELECT ev.run, event_id, lap_no FROM ev JOIN ends ON ev.run = ends.run
  AND ev.ts_us >= start_us AND ev.ts_us < ends.ts_us""")
def samples_in_laps(spark, d):
    return sig.interval_join(samples(spark, d), lap_spans_from_first(spark, d), ["run"], "ts_us", "start_us", "end_us", DAY) \
        .select("run", "event_id", "lap_no")


@query(f"""WITH {EV}, a AS (SELECT * FROM ev WHERE channel = 'click'), b AS (SELECT run, ts_us, value AS speed FROM ev WHERE channel = 'view')
  SELECT a.run, a.event_id, b.speed FROM a ASOF LEFT JOIN b ON a.run = b.run AND a.ts_us >= b.ts_us""")
def asof_channel_value(spark, d):
    ev = samples(spark, d)
    left = ev.filter("channel = 'click'").select("run", "ts_us", "event_id")
    right = ev.filter("channel = 'view'").select("run", "ts_us", F.col("value").alias("speed"))
    return sig.asof(left, right, ["run"], "ts_us", ["speed"]).select("run", "event_id", "speed")


@query(f"""WITH {EV} SELECT run, ts_us // 86400000000 AS bucket, {', '.join(
    f"round(avg(value) FILTER (channel = '{c}') + 1e-9, 6) AS {n}" for n, c in CHANNELS.items())} FROM ev GROUP BY ALL""")
def bucket_align(spark, d):
    out = sig.bucket_align(samples(spark, d), ["run"], "ts_us", "channel", "value", CHANNELS, DAY)
    return out.select("run", "bucket", *[r6(c).alias(c) for c in CHANNELS])


def track(spark, d):
    return Track.open(samples(spark, d), ["run"], "ts_us", ("event_id",))


@query(f"""WITH {EV} SELECT run, event_id, round(avg(value) OVER (PARTITION BY run ORDER BY ts_us
  RANGE BETWEEN {12 * HOUR} PRECEDING AND {12 * HOUR} FOLLOWING) + 1e-9, 6) AS smooth FROM ev""")
def moving_average_time(spark, d):
    return sig.smooth_time(track(spark, d), "value", DAY, "smooth").df.select("run", "event_id", r6("smooth").alias("smooth"))


@query(f"""WITH {EV} SELECT run, event_id, round(sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 + 1e-9, 6) AS odd,
  round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 + 1e-9, 6) AS even FROM ev
  WINDOW w AS (PARTITION BY run ORDER BY ts_us, event_id)""")
def moving_average_rows(spark, d):
    t = sig.smooth_rows(track(spark, d), "value", 7, "odd")
    return sig.smooth_rows(t, "value", 4, "even").df.select("run", "event_id", r6("odd").alias("odd"), r6("even").alias("even"))


def slope_cte(source, col, out="g", unit=HOUR):
    """SQL for the central difference of ``col`` with one-sided ends."""
    w = "(PARTITION BY run ORDER BY ts_us, event_id)"
    nv, pv = f"coalesce(lead({col}) OVER {w}, {col})", f"coalesce(lag({col}) OVER {w}, {col})"
    nt, pt = f"coalesce(lead(ts_us) OVER {w}, ts_us)", f"coalesce(lag(ts_us) OVER {w}, ts_us)"
    return f"(SELECT *, CASE WHEN {nt} > {pt} THEN ({nv} - {pv}) / (({nt} - {pt}) / {unit}.0) ELSE 0 END AS {out} FROM {source})"


@query(f"WITH {EV}, x AS {slope_cte('ev', 'value')} SELECT run, event_id, round(g + 1e-9, 6) AS slope FROM x")
def central_derivative(spark, d):
    return sig.derivative(track(spark, d), "value", "slope", HOUR).df.select("run", "event_id", r6("slope").alias("slope"))


SMOOTH = EV + f""", sm AS (SELECT *, avg(value) OVER (PARTITION BY run ORDER BY ts_us
  RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING) AS s FROM ev), sl AS {slope_cte('sm', 's', unit=1000000)},
  nx AS (SELECT *, lead(g) OVER (PARTITION BY run ORDER BY ts_us, event_id) AS gn,
    max(s) OVER (PARTITION BY run) AS top,
    max(s) OVER (PARTITION BY run ORDER BY ts_us RANGE BETWEEN {48 * HOUR} PRECEDING AND {48 * HOUR} FOLLOWING) AS peak,
    greatest(max(s) OVER (PARTITION BY run ORDER BY ts_us RANGE BETWEEN {48 * HOUR} PRECEDING AND 1 PRECEDING),
             max(s) OVER (PARTITION BY run ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND {48 * HOUR} FOLLOWING)) AS others FROM sl),
  mins AS (SELECT run, event_id, ts_us, s, peak - s AS depth FROM nx WHERE g < 0 AND gn >= 0 AND s < top * 0.92 AND peak - s >= 15),
  maxs AS (SELECT run, event_id, ts_us, s, s - others AS depth FROM nx WHERE g >= 0 AND gn < 0 AND s >= 20 AND s - others >= -0.6)"""


def speed_minima(spark, d):
    return sig.turning_points(track(spark, d), "value", "min", 48 * HOUR, 15.0, share_of_max=0.92, smooth=12 * HOUR)


def load_maxima(spark, d):
    return sig.turning_points(track(spark, d), "value", "max", 48 * HOUR, -0.6, min_level=20.0, smooth=12 * HOUR)


@query(f"WITH {SMOOTH} SELECT run, event_id, round(s + 1e-9, 6) AS level, round(depth + 1e-9, 6) AS depth FROM mins")
def local_minima_prominent(spark, d):
    return speed_minima(spark, d).select("run", "event_id", r6("level").alias("level"), r6("depth").alias("depth"))


@query(f"WITH {SMOOTH} SELECT run, event_id, round(s + 1e-9, 6) AS level, round(depth + 1e-9, 6) AS depth FROM maxs")
def local_maxima_prominent(spark, d):
    return load_maxima(spark, d).select("run", "event_id", r6("level").alias("level"), r6("depth").alias("depth"))


@query(f"""WITH {SMOOTH}, c AS (SELECT coalesce(a.run, b.run) AS run, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM
    (SELECT run, count(*) AS na FROM maxs GROUP BY run) a FULL JOIN (SELECT run, count(*) AS nb FROM mins GROUP BY run) b ON a.run = b.run)
  SELECT m.run, event_id, 'first' AS detector FROM maxs m JOIN c ON m.run = c.run WHERE NOT (nb > 0 AND na < 0.7 * nb)
  UNION ALL SELECT m.run, event_id, 'second' FROM mins m JOIN c ON m.run = c.run WHERE nb > 0 AND na < 0.7 * nb""")
def detector_fallback(spark, d):
    cols = ["run", "event_id"]
    weak = (F.col("n_second") > 0) & (F.col("n_first") < F.col("n_second") * 0.7)
    return ev_ops.choose_detector(load_maxima(spark, d).select(cols).persist(), speed_minima(spark, d).select(cols).persist(), ["run"], weak)


@query(f"""WITH RECURSIVE {EV}, c AS (SELECT run, ts_us FROM ev WHERE value > 60),
  r AS (SELECT run, min(ts_us) AS ts_us FROM c GROUP BY run
    UNION ALL SELECT r.run, (SELECT min(c.ts_us) FROM c WHERE c.run = r.run AND c.ts_us >= r.ts_us + {24 * HOUR}) FROM r WHERE r.ts_us IS NOT NULL)
  SELECT run, ts_us FROM r WHERE ts_us IS NOT NULL""")
def greedy_min_gap(spark, d):
    return sig.min_gap(samples(spark, d).filter("value > 60"), ["run"], "ts_us", 24 * HOUR)


@query(f"""WITH RECURSIVE {EV}, c AS (SELECT run, ts_us, value FROM ev WHERE value > 60),
  r AS (SELECT run, min(ts_us) AS ts_us FROM c GROUP BY run
    UNION ALL SELECT r.run, (SELECT min(c.ts_us) FROM c WHERE c.run = r.run AND c.ts_us >= r.ts_us + {24 * HOUR}) FROM r WHERE r.ts_us IS NOT NULL),
  a AS (SELECT run, ts_us AS anchor FROM r WHERE ts_us IS NOT NULL),
  g AS (SELECT c.run, anchor, ts_us, value FROM c ASOF JOIN a ON c.run = a.run AND c.ts_us >= a.anchor)
  SELECT run, arg_max(ts_us, (value, -ts_us)) AS ts_us, max(value) AS value FROM g GROUP BY run, anchor""")
def greedy_keep_larger(spark, d):
    ev = samples(spark, d).filter("value > 60").select("run", "ts_us", "value")
    return sig.min_gap_keep_larger(ev, ["run"], "ts_us", "value", 24 * HOUR)


# --- apexes per lap -----------------------------------------------------------------------------------

LAPPED = ENDS.replace("FROM ev WHERE", "FROM ev0 WHERE").replace("ev AS", "ev0 AS", 1) + """, first AS (SELECT run, min(ts_us) AS t0 FROM ev0 GROUP BY run),
  ev AS (SELECT ev0.run || '_L' || lap_no AS run, event_id, ev0.ts_us, value FROM ev0 JOIN ends ON ev0.run = ends.run JOIN first ON ev0.run = first.run
    AND ev0.ts_us >= greatest(start_us, t0) AND ev0.ts_us < ends.ts_us)"""


def kept_sql(points, out):
    """SQL for the accepted clocks of ``points`` with a day between them."""
    return f"""{out} AS (SELECT run, min(ts_us) AS ts_us FROM {points} GROUP BY run
    UNION ALL SELECT r.run, (SELECT min(c.ts_us) FROM {points} c WHERE c.run = r.run AND c.ts_us >= r.ts_us + {24 * HOUR}) FROM {out} r WHERE r.ts_us IS NOT NULL)"""


LOW = SMOOTH[len(EV):]
LOAD = LOW.replace("avg(value)", "avg(abs(value - 45))")
for _name in ("sm", "sl", "nx", "mins", "maxs"):
    LOAD = LOAD.replace(f" {_name} AS", f" b_{_name} AS").replace(f"FROM {_name} ", f"FROM b_{_name} ").replace(f"FROM {_name})", f"FROM b_{_name})")
APEX_LOW = f"""{kept_sql("mins", "k1")}, low AS (SELECT mins.* FROM mins JOIN k1 USING (run, ts_us))"""
APEX_LOAD = f"""strong AS (SELECT run FROM ev GROUP BY run HAVING max(abs(value - 45)) >= 40), pts AS (SELECT b_maxs.* FROM b_maxs JOIN strong USING (run)),
  {kept_sql("pts", "k2")}, tied AS (SELECT pts.*, k2.ts_us AS anchor FROM pts ASOF JOIN (SELECT * FROM k2 WHERE ts_us IS NOT NULL) k2 ON pts.run = k2.run AND pts.ts_us >= k2.ts_us),
  top AS (SELECT run, unnest(arg_max({{'event_id': event_id, 'ts_us': ts_us, 's': s, 'depth': depth}}, (s, -ts_us))) FROM tied GROUP BY run, anchor)"""


def lapped(spark, d):
    """Events with run and lap as one key."""
    at = sig.interval_join(samples(spark, d), lap_spans_from_first(spark, d).select("run", "lap_no", "start_us", "end_us"), ["run"],
                           "ts_us", "start_us", "end_us", DAY)
    key = F.concat_ws("_L", F.col("run").cast("string"), F.col("lap_no").cast("string"))
    return Track.open(at.select(key.alias("run"), "event_id", "ts_us", "value"), ["run"], "ts_us", ("event_id",))


def low_apexes(t):
    return ev_ops.apex_minima(t, "value", 24 * HOUR, 48 * HOUR, 15.0, share_of_max=0.92, smooth=12 * HOUR)


def load_apexes(t):
    t = t.columns(load=F.col("value") - 45)
    return ev_ops.apex_maxima(t, "load", 24 * HOUR, 48 * HOUR, -0.6, 40.0, min_level=20.0, smooth=12 * HOUR)


@query(f"WITH RECURSIVE {LAPPED}{LOW}, {APEX_LOW} SELECT run AS lap, event_id, ts_us, round(s + 1e-9, 6) AS level, round(depth + 1e-9, 6) AS depth FROM low")
def apex_speed_minima(spark, d):
    return low_apexes(lapped(spark, d)).select(F.col("run").alias("lap"), "event_id", "ts_us", r6("level").alias("level"), r6("depth").alias("depth"))


@query(f"WITH RECURSIVE {LAPPED}{LOAD}, {APEX_LOAD} SELECT run AS lap, event_id, ts_us, round(s + 1e-9, 6) AS level, round(depth + 1e-9, 6) AS depth FROM top")
def apex_lateral_maxima(spark, d):
    return load_apexes(lapped(spark, d)).select(F.col("run").alias("lap"), "event_id", "ts_us", r6("level").alias("level"), r6("depth").alias("depth"))


@query(f"""WITH RECURSIVE {LAPPED}{LOW}, {APEX_LOW}{LOAD}, {APEX_LOAD},
  c AS (SELECT coalesce(a.run, b.run) AS run, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM
    (SELECT run, count(*) AS na FROM top GROUP BY run) a FULL JOIN (SELECT run, count(*) AS nb FROM low GROUP BY run) b ON a.run = b.run)
  SELECT t.run AS lap, event_id, 'first' AS detector FROM top t JOIN c ON t.run = c.run WHERE NOT (nb > 0 AND na < 0.7 * nb)
  UNION ALL SELECT t.run, event_id, 'second' FROM low t JOIN c ON t.run = c.run WHERE nb > 0 AND na < 0.7 * nb""")
def apex_with_fallback(spark, d):
    t = lapped(spark, d)
    by_load, by_speed = (hold(x.select("run", "event_id"), "apexes") for x in (load_apexes(t), low_apexes(t)))
    return ev_ops.apexes(by_load, by_speed, ["run"]).withColumnRenamed("run", "lap")


BANDS = {"speed": (5.0, 120.0), "brake": (0.0, 80.0), "gas": (0.0, 90.0), "susp": (2.0, 200.0)}
IN_BANDS = " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in BANDS.items())


@query(f"WITH {WIDE} SELECT run, event_id, coalesce({IN_BANDS}, false) AS inside FROM wide")
def band_mask(spark, d):
    return wide(spark, d).df.select("run", "event_id", ev_ops.all_bands(BANDS).alias("inside"))


AREAS_BODY = island_cte("ia", "wide", IN_BANDS) + """,
  isl AS (SELECT run, isl, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, sum(susp) AS ss, count(susp) AS cs FROM ia GROUP BY run, isl)"""
AREAS = WIDE + ", " + AREAS_BODY


@query(f"WITH {AREAS} SELECT run, start_us, end_us, n FROM isl")
def islands(spark, d):
    return sig.islands(wide(spark, d), ev_ops.all_bands(BANDS))


MERGED_BODY = AREAS_BODY + f""", g AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY run ORDER BY start_us) <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM isl),
  h AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY start_us) AS grp FROM g),
  mrg AS (SELECT run, min(start_us) AS start_us, max(end_us) AS end_us, sum(n)::BIGINT AS n, sum(ss) / sum(cs) AS susp FROM h GROUP BY run, grp)"""
MERGED = WIDE + ", " + MERGED_BODY


@query(f"WITH {MERGED} SELECT run, start_us, end_us, n FROM mrg")
def merge_islands(spark, d):
    t = wide(spark, d)
    found = sig.islands(t, ev_ops.all_bands(BANDS))
    return sig.merge_islands(found, ["run"], 12 * HOUR, F.sum("n").alias("n"), like=t)


@query(f"WITH {AREAS} SELECT run, start_us, end_us, n FROM isl WHERE n >= 3 AND end_us - start_us >= {6 * HOUR}")
def long_islands(spark, d):
    return sig.long_enough(sig.islands(wide(spark, d), ev_ops.all_bands(BANDS)), min_rows=3, min_span=6 * HOUR)


def areas(spark, d, t=None):
    return ev_ops.band_areas(t or wide(spark, d), BANDS, 12 * HOUR, 3, {"susp": "susp"})


@query(f"WITH {MERGED} SELECT run, start_us, end_us, n, (start_us + end_us) // 2 AS mid_us, round(susp + 1e-9, 6) AS susp FROM mrg WHERE n >= 3")
def island_stats(spark, d):
    return areas(spark, d).select("run", "start_us", "end_us", "n", "mid_us", r6("susp").alias("susp"))


LIMITER_BODY = f"""sml AS (SELECT *, avg(speed) OVER (PARTITION BY run ORDER BY ts_us
  RANGE BETWEEN {6 * HOUR} PRECEDING AND {6 * HOUR} FOLLOWING) AS s FROM wide), """ + island_cte("il", "sml", "s BETWEEN 20 AND 60") + f""",
  z AS (SELECT run, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, avg(speed) AS speed, avg(susp) AS susp FROM il GROUP BY run, isl
    HAVING max(ts_us) - min(ts_us) >= {12 * HOUR})"""


def zones(spark, d, t=None):
    return ev_ops.limiter_zones(t or wide(spark, d), "speed", 20, 60, 12 * HOUR, 12 * HOUR, {"mean_speed": "speed", "mean_susp": "susp"})


@query(f"WITH {WIDE}, {LIMITER_BODY} SELECT run, start_us, end_us, n, round(speed + 1e-9, 6) AS speed, round(susp + 1e-9, 6) AS susp FROM z")
def limiter_zones(spark, d):
    return zones(spark, d).select("run", "start_us", "end_us", "n", r6("mean_speed").alias("speed"), r6("mean_susp").alias("susp"))


ENTRY_BODY = f"""sm AS (SELECT *, avg(speed / 3.6) OVER (PARTITION BY run ORDER BY ts_us
  RANGE BETWEEN {3 * HOUR} PRECEDING AND {3 * HOUR} FOLLOWING) AS s FROM wide), sl AS {slope_cte('sm', 's')}, """ + \
    island_cte("ie", "sl", "g < -0.1 AND speed >= 10") + """,
  st AS (SELECT run, min(ts_us) AS ts_us FROM ie GROUP BY run, isl HAVING count(*) >= 2)"""
ENTRY = WIDE + ", " + ENTRY_BODY


def entries(spark, d, t=None):
    return ev_ops.entry_points(t or wide(spark, d), "speed", decel=-0.1, min_speed=10, min_rows=2, gap=24 * HOUR, look_back=2 * HOUR,
                               smooth=6 * HOUR, values=["speed", "susp"], unit=HOUR)


KEPT = f"""r AS (SELECT run, min(ts_us) AS ts_us FROM st GROUP BY run UNION ALL
    SELECT r.run, (SELECT min(st.ts_us) FROM st WHERE st.run = r.run AND st.ts_us >= r.ts_us + {24 * HOUR}) FROM r WHERE r.ts_us IS NOT NULL),
  k AS (SELECT run, ts_us AS start_us, ts_us - {2 * HOUR} AS entry_us FROM r WHERE ts_us IS NOT NULL),
  ent AS (SELECT k.run, start_us, entry_us, speed, susp FROM k ASOF LEFT JOIN wide ON k.run = wide.run AND k.entry_us >= wide.ts_us)"""


@query(f"WITH RECURSIVE {ENTRY}, {KEPT} SELECT run, start_us, entry_us, speed, susp FROM ent")
def entry_lookback(spark, d):
    return entries(spark, d).select("run", "start_us", "entry_us", "speed", "susp")


PEAKS_BODY = island_cte("ip", "wide", "brake >= 20 AND speed >= 10") + f""",
  p AS (SELECT *, max(brake) OVER e AS peak, min(ts_us) OVER e AS start_us, max(ts_us) OVER e AS end_us, count(*) OVER e AS n FROM ip
    WINDOW e AS (PARTITION BY run, isl)),
  pk AS (SELECT run, start_us, end_us, n, peak, count(*) AS n_full, avg(susp) AS susp FROM p
    WHERE end_us - start_us >= {1 * HOUR} AND brake >= 0.85 * peak GROUP BY run, isl, start_us, end_us, n, peak)"""
PEAKS = WIDE + ", " + PEAKS_BODY


def full_braking(spark, d, t=None):
    return ev_ops.peak_areas(t or wide(spark, d), "brake", "speed", 20, 10, 0.85, HOUR, {"mean_susp": "susp"})


@query(f"WITH {PEAKS} SELECT run, start_us, end_us, n, peak, n_full, round(susp + 1e-9, 6) AS susp FROM pk")
def peak_fraction_area(spark, d):
    return full_braking(spark, d).select("run", "start_us", "end_us", "n", "peak", "n_full", r6("mean_susp").alias("susp"))


@query(f"""WITH {EV}, x AS (SELECT run, event_id, CASE WHEN run % 2 = 0 THEN 1.4 ELSE 1.35 END AS wb, CASE WHEN run % 2 = 0 THEN 0.65 ELSE 0.6 END AS h,
    CASE WHEN run % 2 = 0 THEN 0.49 ELSE 0.51 END AS fw, 250.0 AS m, (50 - value) / 5 AS ax FROM ev)
  SELECT run, event_id, round(greatest(0, m * 9.81 * fw - m * ax * h / wb) + 1e-9, 6)::DOUBLE AS load_f,
    round(greatest(0, m * 9.81 * (1 - fw) + m * ax * h / wb) + 1e-9, 6)::DOUBLE AS load_r FROM x""")
def load_transfer(spark, d):
    params = spark.createDataFrame([(0, 1.4, 0.65, 0.49), (1, 1.35, 0.6, 0.51)], "kind long, wheelbase double, cog_h double, f_ratio double")
    ev = samples(spark, d).withColumns({"kind": F.col("run") % 2, "mass": F.lit(250.0), "ax": (50 - F.col("value")) / 5})
    loads = wheel_loads(*[F.col(c) for c in ("mass", "ax", "wheelbase", "cog_h", "f_ratio")])
    return ev.join(params, "kind").select("run", "event_id", *[r6(c).alias(n) for n, c in loads.items()])


EDGES = EV + """, p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts_us, event_id) AS rn, count(*) OVER (PARTITION BY run) AS n FROM ev),
  q AS (SELECT *, greatest(10, floor(n * 0.05)) AS edge FROM p WHERE value > 0.8 AND value < 200),
  edge AS (SELECT run, avg(value) AS avg_val, count(*) AS n_valid, median(value) FILTER (rn <= edge) AS start_val,
    median(value) FILTER (rn > n - edge) AS end_val FROM q GROUP BY run HAVING count(*) >= 4)"""


def edge_table(spark, d):
    return ev_ops.edge_stats(track(spark, d), "value", 0.8, 200)


@query(f"""WITH {EDGES} SELECT run, n_valid, round(avg_val + 1e-9, 6) AS avg_val, round(start_val + 1e-9, 6) AS start_val, round(end_val + 1e-9, 6) AS end_val,
  round(end_val - start_val + 1e-9, 6) AS delta_val FROM edge""")
def edge_median_stats(spark, d):
    return edge_table(spark, d).select("run", "n_valid", *[r6(c).alias(c) for c in ("avg_val", "start_val", "end_val", "delta_val")])


@query(f"""WITH {EV}, a AS (SELECT run, ts_us AS at_us FROM ev WHERE channel = 'purchase'), g AS (SELECT run, ts_us, value FROM ev WHERE channel = 'error'),
  n AS (SELECT a.run, at_us, ts_us, value FROM a JOIN g ON a.run = g.run AND ts_us >= at_us - {12 * HOUR} AND ts_us < at_us + {72 * HOUR}),
  l AS (SELECT run, at_us, arg_min(ts_us, (value, ts_us)) AS low_us, min(value) AS low FROM n GROUP BY run, at_us)
  SELECT n.run, n.at_us, low AS low_level, low_us, min(ts_us) AS cross_us FROM n JOIN l ON n.run = l.run AND n.at_us = l.at_us
  WHERE low <= 20 AND ts_us >= low_us AND value > 20 GROUP BY ALL""")
def threshold_crossing(spark, d):
    ev = samples(spark, d)
    apex = ev.filter("channel = 'purchase'").select("run", F.col("ts_us").alias("at_us"))
    gas = ev.filter("channel = 'error'").select("run", "ts_us", "value")
    return ev_ops.crossing_after_low(apex, gas, ["run"], "at_us", "ts_us", "value", 12 * HOUR, 72 * HOUR, 20.0)


CORNERS_BODY = "wides AS (SELECT * FROM wide WHERE speed IS NOT NULL), " + island_cte("ic", "wides", "brake > 30") + f""",
  pkc AS (SELECT run, arg_min(ts_us, (-brake, ts_us)) AS peak_us FROM ic GROUP BY run, isl HAVING max(ts_us) - min(ts_us) >= {3 * HOUR}),
  ap AS (SELECT pkc.run, peak_us, arg_min(ts_us, (speed, ts_us)) AS apex_us FROM pkc JOIN wides ON pkc.run = wides.run AND ts_us >= peak_us
    AND ts_us < peak_us + {48 * HOUR} GROUP BY pkc.run, peak_us),
  rc AS (SELECT run, min(apex_us) AS apex_us FROM ap GROUP BY run UNION ALL
    SELECT rc.run, (SELECT min(ap.apex_us) FROM ap WHERE ap.run = rc.run AND ap.apex_us >= rc.apex_us + {36 * HOUR}) FROM rc WHERE rc.apex_us IS NOT NULL),
  cor AS (SELECT run, apex_us, apex_us - {6 * HOUR} AS start_us, apex_us + {6 * HOUR} AS end_us FROM rc WHERE apex_us IS NOT NULL)"""


def corners(spark, d, t=None):
    t = (t or wide(spark, d)).filter(F.col("speed").isNotNull())
    return ev_ops.brake_corners(t, "brake", "speed", 30, 3 * HOUR, 48 * HOUR, 6 * HOUR, 36 * HOUR)


@query(f"WITH RECURSIVE {WIDE}, {CORNERS_BODY} SELECT run, apex_us, start_us, end_us FROM cor")
def trigger_then_minimum(spark, d):
    return corners(spark, d).select("run", "apex_us", "start_us", "end_us")


SEGS = MERGED + ", segs AS (SELECT run, start_us, end_us FROM mrg WHERE n >= 3)"
BACK_BODY = island_cte("b", "wide", "brake > 15") + f""",
  bon AS (SELECT run, ts_us, min(ts_us) OVER (PARTITION BY run, isl) AS rs FROM b),
  bh AS (SELECT s.*, bon.rs, bon.ts_us AS last_on FROM segs s ASOF LEFT JOIN bon ON s.run = bon.run AND s.start_us > bon.ts_us),
  bs AS (SELECT run, start_us, end_us, CASE WHEN last_on >= start_us - {60 * HOUR} THEN greatest(rs, start_us - {60 * HOUR}) ELSE start_us END AS brake_start_us FROM bh),
  bst AS (SELECT bs.run, bs.start_us, max(brake) AS brake_peak, avg(susp) AS brake_mean FROM bs JOIN wide ON bs.run = wide.run
    AND ts_us >= brake_start_us AND ts_us < start_us GROUP BY ALL),
  back AS (SELECT bs.*, start_us - brake_start_us AS brake_us, brake_peak, brake_mean FROM bs LEFT JOIN bst USING (run, start_us))"""
BACK = SEGS + ", " + BACK_BODY


def segments(spark, d, t=None):
    return areas(spark, d, t).select("run", "start_us", "end_us")


@query(f"WITH {BACK} SELECT run, start_us, brake_start_us, brake_us, brake_peak, round(brake_mean + 1e-9, 6) AS brake_mean FROM back")
def phase_back_search(spark, d):
    t = wide(spark, d)
    out = ev_ops.back_search(segments(spark, d, t), t, "brake", 15, 60 * HOUR, mean="susp")
    return out.select("run", "start_us", "brake_start_us", "brake_us", "brake_peak", r6("brake_mean").alias("brake_mean"))


CORE = """core AS (SELECT s.run, start_us, end_us, greatest(0, min(speed)) AS speed_min, avg(susp) AS core_mean, end_us - start_us AS core_us
  FROM segs s JOIN wide ON s.run = wide.run AND ts_us BETWEEN start_us AND end_us GROUP BY ALL)"""


@query(f"WITH {SEGS}, {CORE} SELECT run, start_us, end_us, speed_min, round(core_mean + 1e-9, 6) AS core_mean, core_us FROM core")
def phase_core(spark, d):
    t = wide(spark, d)
    return ev_ops.phase_core(segments(spark, d, t), t, "speed", "susp", DAY).select(
        "run", "start_us", "end_us", "speed_min", r6("core_mean").alias("core_mean"), "core_us")


FORWARD = f"""fl AS (SELECT run, lag(ts_us, 2) OVER w AS b, ts_us AS e, gas > 25 AND lag(gas, 1) OVER w > 25 AND lag(gas, 2) OVER w > 25 AS ok
    FROM wide WINDOW w AS (PARTITION BY run ORDER BY ts_us, event_id)),
  fh AS (SELECT s.run, s.start_us, s.end_us, f.b, f.e FROM segs s ASOF LEFT JOIN (SELECT * FROM fl WHERE ok) f ON s.run = f.run AND s.end_us <= f.b),
  fwd AS (SELECT run, start_us, end_us, coalesce(e < end_us + {48 * HOUR}, false) AS found,
    CASE WHEN e < end_us + {48 * HOUR} THEN b ELSE end_us + {48 * HOUR} END AS throttle_us FROM fh)"""


@query(f"WITH {SEGS}, {FORWARD} SELECT run, start_us, end_us, found, throttle_us, throttle_us - end_us AS exit_us FROM fwd")
def phase_forward_run(spark, d):
    t = wide(spark, d)
    return ev_ops.forward_run(segments(spark, d, t), t, "gas", 25, 3, 48 * HOUR)


PHASES_BODY = f"""{BACK_BODY}, {CORE}, {FORWARD},
  ph AS (SELECT row_number() OVER (PARTITION BY run ORDER BY start_us) AS corner_no, run, start_us, end_us, brake_us, brake_peak, core_us, speed_min,
    throttle_us - end_us AS exit_us, brake_us + core_us + throttle_us - end_us AS total_us
    FROM back JOIN core USING (run, start_us, end_us) JOIN fwd USING (run, start_us, end_us))"""
PHASES = SEGS + ", " + PHASES_BODY


def phases(t, segs):
    back = ev_ops.back_search(segs, t, "brake", 15, 60 * HOUR).select("run", "start_us", "end_us", "brake_us", "brake_peak")
    core = ev_ops.phase_core(segs, t, "speed", "susp", DAY).select("run", "start_us", "end_us", "core_us", "speed_min")
    fwd = ev_ops.forward_run(segs, t, "gas", 25, 3, 48 * HOUR).select("run", "start_us", "end_us", "exit_us")
    on = ["run", "start_us", "end_us"]
    return ev_ops.numbered_corners(back.join(core, on).join(fwd, on), t, "start_us", ["brake_us", "core_us", "exit_us"])


@query(f"WITH {PHASES} SELECT run, corner_no, brake_us, core_us, exit_us, total_us FROM ph")
def corner_numbering(spark, d):
    t = wide(spark, d).persisted()
    return phases(t, segments(spark, d, t).persist()).select("run", "corner_no", "brake_us", "core_us", "exit_us", "total_us")


@query(f"""WITH {ENDS}, b AS (SELECT run, lap_no, greatest(start_us, 1704067200000000) AS start_us, ts_us AS end_us FROM ends),
  x AS (SELECT b.run, lap_no, count(*) AS n, round(avg(value) + 1e-9, 6) AS v_mean, min(value) AS v_min, max(value) AS v_max,
    count(*) FILTER (channel = 'click' AND value > 30) AS hard_count, round(avg(value) FILTER (channel = 'click' AND value > 30) + 1e-9, 6) AS hard_mean
    FROM b JOIN ev ON b.run = ev.run AND ev.ts_us >= start_us AND ev.ts_us < end_us GROUP BY ALL)
  SELECT * FROM x""")
def lap_event_stats(spark, d):
    spans = lap_spans_from_first(spark, d)
    rows = sig.interval_join(samples(spark, d), spans, ["run"], "ts_us", "start_us", "end_us", DAY)
    base = rows.groupBy("run", "lap_no").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("v_mean"),
                                             F.min("value").alias("v_min"), F.max("value").alias("v_max"))
    hard = rows.filter("channel = 'click' and value > 30")
    return ev_ops.with_event_stats(base, ["run", "lap_no"], hard=(hard, [r6(F.avg("value")).alias("hard_mean")]))


@query(f"""WITH RECURSIVE {ENTRY}, {KEPT}, {PEAKS_BODY},
  a AS (SELECT run, count(*) AS n, round(avg(speed) + 1e-9, 6) AS speed, round(avg(susp) + 1e-9, 6) AS susp FROM wide GROUP BY run),
  e AS (SELECT run, count(*) AS entry_count, round(avg(speed) + 1e-9, 6) AS entry_speed FROM ent GROUP BY run),
  f AS (SELECT run, count(*) AS full_count, round(avg(peak) + 1e-9, 6) AS full_peak FROM pk GROUP BY run)
  SELECT a.*, coalesce(entry_count, 0) AS entry_count, entry_speed, coalesce(full_count, 0) AS full_count, full_peak
  FROM a LEFT JOIN e USING (run) LEFT JOIN f USING (run)""")
def run_event_summary(spark, d):
    t = wide(spark, d)
    base = t.df.groupBy("run").agg(F.count("*").alias("n"), r6(F.avg("speed")).alias("speed"), r6(F.avg("susp")).alias("susp"))
    return ev_ops.with_event_stats(base, ["run"],
                                   entry=(entries(spark, d, t), [r6(F.avg("speed")).alias("entry_speed")]),
                                   full=(full_braking(spark, d, t), [r6(F.avg("peak")).alias("full_peak")]))


@query(f"""WITH {EV}, x AS (SELECT run, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM ev)
  SELECT run, round(avg(v), 2) AS v_mean, round(min(v), 2) AS v_min, round(max(v), 2) AS v_max FROM x GROUP BY run""")
def nan_safe_stats(spark, d):
    ev = samples(spark, d).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return ev.groupBy("run").agg(*ev_ops.nan_safe("v"))

