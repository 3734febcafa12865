"""From logger bundles on disk to dynamics. Events are recorded as bundles, written, and read back through the bundle format.

Ten loggers share the users; each recording holds up to PART samples of an event type, a header, a catalog and, for most, a lap file.
"""

from pyspark.sql import functions as F

from laplens.functions.text import normal_circuit, normal_round, normal_session, parse_date, path_event_key, trailing_number
from laplens.operators import dynamics
from laplens.operators import phases as ph
from laplens.operators.channels import resolve_channels
from laplens.operators.ordered import number
from laplens.plans.files import _bytes
from laplens.plans.registry import island_cte, query, samples
from laplens.plans.telemetry import slope_cte
from laplens.session import fresh_path, hold
from laplens.sources import bundle
from laplens.sources.bundle_format import read_bundles, register_bundles

PART = 1000
#: channel, extension, event type, factor, offset; values are recorded in steps of 1/32, within 16 bits
CHANNELS = [("SPEED_FRONT", "C01", "view", 1.0, 0.0), ("BRAKE_FRONT", "C02", "click", 1.0, 0.0), ("GAS", "C03", "error", 1.0, 0.0),
            ("SUSP_FRONT", "C04", "signup", 1.0, 0.0), ("SUSP_REAR", "C05", "signup", -0.5, 150.0), ("ACC_Y", "C06", "view", 1.0, -45.0),
            ("tyre_press_f", "C07", "purchase", 0.0625, 1.0), ("Tire_Raw_PRESS_REAR", "C08", "purchase", 0.5, 100.0),
            ("dtps_a", "C09", "error", 1.0, -45.0)]
LIMITS = dynamics.Limits(min_lap_s=0.2, pit_lo=20, pit_hi=60, pit_span=100_000, entry_speed=10, entry_rows=2, brake_min=20, brake_speed=10)
RIDER = {"DA77": (1.4115, 0.6511, 0.4871), "JA52": (1.399, 0.6449, 0.4892)}


def recordings(spark, d):
    """One row per sample: run, logger, channel position, idx, raw, and the event's day."""
    ev = samples(spark, d).withColumn("unit", F.col("run") % 10)
    ev = number(ev, ["unit", "channel"], [F.col("ts_us"), F.col("event_id")], "rn")
    run = F.concat(F.lit("P-"), F.col("unit").cast("string"), F.lit("-"), F.floor((F.col("rn") - 1) / PART).cast("string"))
    kinds = F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for _, e, k, a, b in CHANNELS])
    rows = ev.select(run.alias("run"), "unit", ((F.col("rn") - 1) % PART).alias("idx"), "channel", "value", F.to_date(F.timestamp_micros("ts_us")).alias("day"),
                     F.explode(kinds).alias("k")).filter("channel = k.kind AND NOT (k.ext = 'C09' AND unit % 5 = 3)")
    return rows.select("run", "unit", "idx", "k.ext", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round((F.col("value") * F.col("k.a") + F.col("k.b")) * 32 + 1e-6))).cast("long").alias("raw"), "day")


def recorded_files(spark, d):
    """Files of all bundles (path, content); the samples are numbered and packed once, and the other files told from what was packed."""
    rows = recordings(spark, d)
    path = lambda ext: F.concat(F.lit("/R03_SOME_PLACE/"), "run", F.lit(".MES/"), "run", F.lit("."), F.lit(ext) if isinstance(ext, str) else ext)
    word = F.lpad(F.hex(F.col("raw").bitwiseAND(F.lit(0xFFFF))), 4, "0")  # spelt row by row, since an expression over arrays is interpreted
    rows = rows.withColumn("word", F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2)))
    files = rows.groupBy("run", "unit", "ext").agg(  # PART rows at most
        F.sort_array(F.collect_list(F.struct("idx", "word"))).alias("a"), F.count(F.lit(1)).alias("n"), F.min("day").alias("day"))
    files = hold(files.select("run", "unit", "ext", "n", "day", F.unhex(F.array_join(F.col("a.word"), "")).alias("content")), "recordings")
    data = files.select(path(F.col("ext")).alias("path"), "content")
    runs = files.groupBy("run", "unit").agg(F.sum(F.when(F.col("ext") == "C01", F.col("n")).otherwise(0)).alias("n"), F.min("day").alias("day"))
    text = "\r\n".join(f"[{i:04X}]\r\n3=0,0,0,3D000000,0,0,3F800000\r\n4={c},x\r\n6=0,I,0,{e}" for i, (c, e, *_) in enumerate(CHANNELS))
    catalog = runs.select(path("DDD").alias("path"), F.encode(F.lit(text), "ISO-8859-1").alias("content"))
    head = F.concat(F.lit("Rider="), F.when(F.col("unit") % 2 == 0, "DA77").otherwise("JA52"), F.lit("\r\n[MASS]\r\nBike="), (165 + F.col("unit")).cast("string"),
                    F.lit("\r\n[GENERAL]\r\nCircuit=PLACE\r\nSession=fp\r\nDate="), F.date_format("day", "dd/MM/yyyy"))
    header = runs.select(path("HED").alias("path"), F.encode(head, "ISO-8859-1").alias("content"))
    # 20 samples a second, or 1000, which is more than a logger has; every fifth has no lap file
    last = F.when(F.col("unit") % 5 == 1, F.col("n")).otherwise(F.col("n") * 50 + 7)
    ends = F.array(F.lit(3).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.floor(last / 3), F.floor(2 * last / 3), last)
    laps = runs.filter("unit % 5 <> 2 AND n > 2").select(path("LAP").alias("path"), _bytes(ends, 4).alias("content"))
    return data.unionByName(catalog).unionByName(header).unionByName(laps)


def recorded(spark, d):
    """Folder with the written bundles."""
    register_bundles(spark)
    root = fresh_path(spark, "bundles")
    recorded_files(spark, d).write.format("bundle").mode("append").save(root)
    return root


_DEFS = ", ".join(f"('{c}', '{e}', '{k}', {a}, {b})" for c, e, k, a, b in CHANNELS)
RECORDED = f"""defs(channel, ext, kind, a, b) AS (VALUES {_DEFS}),
  src AS (SELECT user_id % 10 AS unit, event_type, value, ts, row_number() OVER (PARTITION BY user_id % 10, event_type ORDER BY epoch_us(ts), event_id) - 1 AS rn FROM events),
  rec AS (SELECT 'P-' || unit || '-' || (rn // {PART}) AS run, unit, channel, ext, rn % {PART} AS idx, greatest(-32768, least(32767, round((value * a + b) * 32 + 1e-6))) / 32 AS value, ts::DATE AS day
    FROM src JOIN defs ON kind = event_type WHERE NOT (ext = 'C09' AND unit % 5 = 3)),
  cnt AS (SELECT run, unit, channel, ext, count(*) AS n FROM rec GROUP BY ALL),
  hd AS (SELECT run, unit, min(day) AS day, count(*) FILTER (channel = 'SPEED_FRONT') AS nb FROM rec GROUP BY ALL),
  ln AS (SELECT *, CASE WHEN unit % 5 = 2 OR nb <= 2 THEN 0 WHEN unit % 5 = 1 THEN nb ELSE nb * 50 + 7 END AS last_ms FROM hd),
  ck AS (SELECT cnt.*, day, last_ms, CASE WHEN last_ms <= 0 THEN coalesce(nullif(nb, 0), n) * 10000 WHEN nb * 1000 < 10 * last_ms THEN nb * 100000
    WHEN nb * 1000 > 500 * last_ms THEN nb * 2000 ELSE last_ms * 1000 END AS len FROM cnt JOIN ln USING (run, unit)),
  smp AS (SELECT rec.run, rec.channel, idx, idx * (len // n) + idx * (len % n) // n AS ts_us, value FROM rec JOIN ck USING (run, channel)),
  en AS (SELECT run, unnest([0, 1, 2]) AS lap_no, unnest([0, last_ms // 3, 2 * last_ms // 3]) AS from_ms, unnest([last_ms // 3, 2 * last_ms // 3, last_ms]) AS end_ms FROM ln WHERE last_ms > 0),
  lp AS (SELECT run, lap_no, from_ms * 1000 AS start_us, end_ms * 1000 AS end_us FROM en
    UNION ALL SELECT run, 0, 0, len FROM ck WHERE last_ms = 0 AND channel = 'SPEED_FRONT')"""


@query(f"WITH {RECORDED} SELECT * FROM smp")
def bundle_source(spark, d):
    """Samples with their clock, decoded where they are read."""
    return read_bundles(spark, recorded(spark, d))


@query(f"WITH {RECORDED} SELECT run, channel, idx, ts_us, value FROM smp WHERE channel IN ('BRAKE_FRONT', 'ACC_Y') AND run <> 'P-1-0' AND value > 3")
def bundle_source_filtered(spark, d):
    """Two channels only; no other channel file is opened."""
    return read_bundles(spark, recorded(spark, d), channels=["BRAKE_FRONT", "ACC_Y"]).filter("run <> 'P-1-0' AND value > 3")


@query(f"""WITH {RECORDED} SELECT run, channel, ext, n AS n_samples, round(n * 1e6 / len + 1e-9, 6) AS rate_hz, len::BIGINT AS clock_us, 'R03_SOME_PLACE' AS folder FROM ck""")
def bundle_channels(spark, d):
    """Channels with their sample counts and rates; only catalogs and lap files are opened."""
    return read_bundles(spark, recorded(spark, d), "channels").withColumn("rate_hz", F.round(F.col("rate_hz") + 1e-9, 6))


@query(f"WITH {RECORDED} SELECT run, lap_no, start_us, end_us FROM lp")
def bundle_laps(spark, d):
    """Laps on the clock of the samples; a recording without a lap file is one lap."""
    root = recorded(spark, d)
    base = read_bundles(spark, root, "channels").filter("channel = 'SPEED_FRONT'")
    return dynamics.recorded_laps(read_bundles(spark, root, "laps"), base.select("run", "clock_us"))


@query(f"""WITH {RECORDED} SELECT DISTINCT run, CASE channel WHEN 'SPEED_FRONT' THEN 'speed' WHEN 'BRAKE_FRONT' THEN 'brake' WHEN 'GAS' THEN 'gas' WHEN 'ACC_Y' THEN 'acc'
    WHEN 'SUSP_FRONT' THEN 'sus_f' WHEN 'SUSP_REAR' THEN 'sus_r' WHEN 'tyre_press_f' THEN 'tyre_f' WHEN 'dtps_a' THEN 'dtps' ELSE 'tyre_r' END AS role, channel FROM cnt""")
def channel_roles(spark, d):
    """Roles by alias, whatever the case, or by the fuzzy rule."""
    return resolve_channels(read_bundles(spark, recorded(spark, d), "channels"), ["run"])


def _decoded(spark, root, table="samples"):
    """A table of the bundles, for several readers: each scan of the format lists the folder anew and opens every file in it."""
    return hold(read_bundles(spark, root, table), table)


def _recorded_tables(spark, root, channels, ends):
    """Samples, roles and laps of the bundles, each found once."""
    laps = dynamics.recorded_laps(ends, channels.filter("channel = 'SPEED_FRONT'").select("run", "clock_us"))
    return _decoded(spark, root), hold(resolve_channels(channels, ["run"]), "roles"), hold(laps, "laps")


def described_runs(spark, header, channels, ends):
    """What headers, folders and catalogs say of each run, with the rider's geometry."""
    keys = {"date": "Date", "circuit": "Circuit", "session_type": "Session", "rider": "Rider", "mass": "MASS.Bike"}
    head = bundle.header_columns(header, keys)
    params = spark.createDataFrame([(r, *v) for r, v in RIDER.items()], "rider string, wheelbase double, cog_h double, f_ratio double")
    base = channels.filter("channel = 'SPEED_FRONT'").select("run", "folder", F.round(F.col("rate_hz") + 1e-9, 1).alias("sample_rate_hz"))
    n = ends.groupBy("run").agg(F.count(F.lit(1)).alias("n_laps"))
    out = base.join(head, "run").join(n, "run", "left").join(params, "rider")
    where = F.concat(F.lit("/"), "folder", F.lit("/x/y"))
    return out.select("run", normal_round(path_event_key(where)).alias("round"), parse_date(F.col("date")).alias("date"), normal_circuit(F.col("circuit")).alias("circuit"),
                      normal_session(F.col("session_type")).alias("session_type"), "rider", trailing_number(F.col("run")).alias("run_no"), "sample_rate_hz",
                      F.coalesce("n_laps", F.lit(1)).alias("n_laps_analyzed"), F.col("mass").cast("double").alias("mass"), "wheelbase", "cog_h", "f_ratio")


def _kept(points, out, gap):
    """SQL for the accepted clocks of ``points``: each at least ``gap`` after the one before."""
    return f"""{out} AS (SELECT run, min(ts_us) AS ts_us FROM {points} GROUP BY run
    UNION ALL SELECT r.run, (SELECT min(c.ts_us) FROM {points} c WHERE c.run = r.run AND c.ts_us >= r.ts_us + {gap}) FROM {out} r WHERE r.ts_us IS NOT NULL)"""


def _around(us):
    return f"(PARTITION BY run ORDER BY ts_us RANGE BETWEEN {us} PRECEDING AND {us} FOLLOWING)"


def _turns(name, value, smooth):  # of the table t
    """SQL for a smoothed value ``s`` of a track with its slopes and the levels around it."""
    return f"""{name}_s AS (SELECT *, avg({value}) OVER {_around(smooth // 2)} AS s FROM t), {name}_g AS {slope_cte(name + '_s', 's', unit=1000000)},
  {name} AS (SELECT *, lead(g) OVER (PARTITION BY run ORDER BY ts_us, event_id) AS gn, max(s) OVER (PARTITION BY run) AS top, max(s) OVER {_around(4000000)} AS peak,
    greatest(max(s) OVER (PARTITION BY run ORDER BY ts_us RANGE BETWEEN 4000000 PRECEDING AND 1 PRECEDING),
      max(s) OVER (PARTITION BY run ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND 4000000 FOLLOWING)) AS others FROM {name}_g)"""


_LAST = ", ".join(f"last_value(CASE WHEN channel = '{c}' THEN value END IGNORE NULLS) OVER w AS {n}" for n, c in (
    ("speed", "SPEED_FRONT"), ("brake", "BRAKE_FRONT"), ("acc", "ACC_Y"), ("sus_f", "SUSP_FRONT"), ("sus_r", "SUSP_REAR"), ("lap_no", "no"), ("lap_s", "s")))
LAP_TRACK = RECORDED + f""", mk AS (SELECT run, 'no' AS channel, -1 AS idx, start_us AS ts_us, lap_no::DOUBLE AS value, -2 AS ord FROM lp
    UNION ALL SELECT run, 's', -1, start_us, (end_us - start_us) / 1e6, -1 FROM lp UNION ALL SELECT run, 'no', -1, max(end_us), -1.0, -2 FROM lp GROUP BY run
    UNION ALL SELECT run, 's', -1, max(end_us), 0.0, -1 FROM lp GROUP BY run),
  al AS (SELECT run, channel, idx, ts_us, value, CASE channel WHEN 'BRAKE_FRONT' THEN 0 WHEN 'ACC_Y' THEN 1 WHEN 'SUSP_FRONT' THEN 2 WHEN 'SUSP_REAR' THEN 3 ELSE 4 END AS ord FROM smp
    WHERE channel IN ('SPEED_FRONT', 'BRAKE_FRONT', 'ACC_Y', 'SUSP_FRONT', 'SUSP_REAR') UNION ALL SELECT run, channel, idx, ts_us, value, ord FROM mk),
  sp AS (SELECT *, {_LAST} FROM al WINDOW w AS (PARTITION BY run ORDER BY ts_us, ord, idx ROWS UNBOUNDED PRECEDING)),
  t0 AS (SELECT run || '_L' || lap_no::BIGINT AS run, run AS run0, idx AS event_id, ts_us, speed, brake, acc, sus_f, sus_r, speed / 3.6 AS v FROM sp
    WHERE channel = 'SPEED_FRONT' AND lap_no >= 0 AND lap_s >= 0.2),
  t AS {slope_cte('t0', 'v', 'ax', 1000000)}"""


def _avg(c, digits=1):
    return f"round(avg(round({c} + 1e-9, {digits})) + 1e-9, 2)"


def _susp(name):
    return f"{_avg('sus_f')} AS {name}_susf_avg, {_avg('sus_r')} AS {name}_susr_avg"


def _tyre(role, channel, scale):
    r1 = lambda c: f"round({c} + 1e-9, 1)"
    return f"""{role}_p AS (SELECT run, idx, ts_us, value, row_number() OVER (PARTITION BY run ORDER BY ts_us, idx) AS rn, count(*) OVER (PARTITION BY run) AS n FROM smp WHERE channel = '{channel}'),
  {role}_m AS (SELECT run, median(value) FILTER (value > 0) AS med FROM {role}_p GROUP BY run),
  {role}_v AS (SELECT run, rn, n, greatest(10, floor(n * 0.05)) AS edge, CASE WHEN med > 10 THEN value / 100 ELSE value END AS x FROM {role}_p JOIN {role}_m USING (run)),
  {role} AS (SELECT run, {r1("median(x) FILTER (rn <= edge)")} AS {role}_start, {r1("median(x) FILTER (rn > n - edge)")} AS {role}_end, {r1("avg(x)")} AS {role}_avg,
    {r1("median(x) FILTER (rn > n - edge) - median(x) FILTER (rn <= edge)")} AS {role}_delta FROM {role}_v WHERE x > 0.8 AND x < 5 GROUP BY run HAVING count(*) >= 4)"""


_GEO = lambda i: "CASE WHEN unit % 2 = 0 THEN " + str(RIDER["DA77"][i]) + " ELSE " + str(RIDER["JA52"][i]) + " END"
DYNAMICS = f"""{LAP_TRACK},
  lim AS (SELECT *, avg(speed) OVER {_around(100000)} AS s FROM t), {island_cte("ip", "lim", "s BETWEEN 20 AND 60")},
  pit AS (SELECT run0, avg(speed) AS speed, avg(sus_f) AS sus_f, avg(sus_r) AS sus_r FROM ip GROUP BY run0, run, isl HAVING max(ts_us) - min(ts_us) >= 100000),
  es AS (SELECT *, avg(v) OVER {_around(35000)} AS s FROM t), eg AS {slope_cte('es', 's', unit=1000000)}, {island_cte("ie", "eg", "g < -8 AND speed >= 10")},
  st AS (SELECT run, min(ts_us) AS ts_us FROM ie GROUP BY run, isl HAVING count(*) >= 2), {_kept("st", "k0", 800000)},
  ke AS (SELECT run, ts_us - 80000 AS at_us FROM k0 WHERE ts_us IS NOT NULL),
  ent AS (SELECT split_part(ke.run, '_L', 1) AS run0, speed, sus_f, sus_r FROM ke ASOF LEFT JOIN t ON ke.run = t.run AND ke.at_us >= t.ts_us),
  {island_cte("ib", "t", "brake >= 20 AND speed >= 10")},
  pb AS (SELECT *, max(brake) OVER e AS peak, min(ts_us) OVER e AS from_us, max(ts_us) OVER e AS to_us FROM ib WINDOW e AS (PARTITION BY run, isl)),
  ful AS (SELECT run0, avg(sus_f) AS sus_f, avg(sus_r) AS sus_r FROM pb WHERE to_us - from_us >= 50000 AND brake >= 0.85 * peak GROUP BY run0, run, isl),
  {_turns("lo", "speed", 300000)}, mins AS (SELECT * FROM lo WHERE g < 0 AND gn >= 0 AND s < top * 0.92 AND peak - s >= 15), {_kept("mins", "k1", 250000)},
  low AS (SELECT mins.* FROM mins JOIN k1 USING (run, ts_us)),
  {_turns("hi", "abs(acc)", 250000)}, strong AS (SELECT run FROM t GROUP BY run HAVING max(abs(acc)) >= 2.25),
  pts AS (SELECT hi.* FROM hi JOIN strong USING (run) WHERE g >= 0 AND gn < 0 AND s >= 1.5 AND s - others >= -0.6), {_kept("pts", "k2", 400000)},
  tied AS (SELECT pts.*, k2.ts_us AS anchor FROM pts ASOF JOIN (SELECT * FROM k2 WHERE ts_us IS NOT NULL) k2 ON pts.run = k2.run AND pts.ts_us >= k2.ts_us),
  best AS (SELECT run, arg_max(ts_us, (s, -ts_us)) AS ts_us FROM tied GROUP BY run, anchor),
  c AS (SELECT coalesce(a.run, b.run) AS run, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT run, count(*) AS na FROM best GROUP BY run) a
    FULL JOIN (SELECT run, count(*) AS nb FROM low GROUP BY run) b ON a.run = b.run),
  pick AS (SELECT run, ts_us FROM best JOIN c USING (run) WHERE NOT (nb > 0 AND na < 0.7 * nb) UNION ALL SELECT run, ts_us FROM low JOIN c USING (run) WHERE nb > 0 AND na < 0.7 * nb),
  apx AS (SELECT t.*, greatest(0, (165 + unit) * 9.81 * {_GEO(2)} - (165 + unit) * ax * {_GEO(1)} / {_GEO(0)}) AS load_f,
    greatest(0, (165 + unit) * 9.81 * (1 - {_GEO(2)}) + (165 + unit) * ax * {_GEO(1)} / {_GEO(0)}) AS load_r
    FROM pick JOIN t USING (run, ts_us) JOIN hd ON hd.run = t.run0 WHERE speed >= 0),
  x1 AS (SELECT run0 AS run, count(*) AS apex_count, {_avg('speed')} AS apex_speed_avg, {_susp('apex')}, {_avg('load_f')} AS apex_load_f_avg, {_avg('load_r')} AS apex_load_r_avg,
    {_avg('ax', 2)} AS apex_ax_avg FROM apx GROUP BY 1),
  x2 AS (SELECT run0 AS run, count(*) AS pit_count, {_avg('speed')} AS pit_speed_avg, {_susp('pit')} FROM pit GROUP BY 1),
  x3 AS (SELECT run0 AS run, count(*) AS brake_count, {_avg('speed')} AS brake_speed_avg, {_susp('brake')} FROM ent GROUP BY 1),
  x4 AS (SELECT run0 AS run, count(*) AS full_brake_count, {_susp('full_brake')} FROM ful GROUP BY 1),
  {_tyre("tyre_f", "tyre_press_f", 1)}, {_tyre("tyre_r", "Tire_Raw_PRESS_REAR", 100)},
  rn AS (SELECT ck.run, 'ROUND3' AS round, strftime(day, '%Y-%m-%d') AS date, 'PLACE' AS circuit, 'FP' AS session_type, CASE WHEN unit % 2 = 0 THEN 'DA77' ELSE 'JA52' END AS rider,
    split_part(run, '-', 3)::BIGINT AS run_no, round(n * 1e6 / len + 1e-9, 1) AS sample_rate_hz, CASE WHEN last_ms > 0 THEN 3 ELSE 1 END AS n_laps_analyzed FROM ck WHERE channel = 'SPEED_FRONT')"""


@query(f"""WITH RECURSIVE {DYNAMICS} SELECT rn.*, coalesce(apex_count, 0) AS apex_count, x1.* EXCLUDE (run, apex_count), coalesce(pit_count, 0) AS pit_count, x2.* EXCLUDE (run, pit_count),
    coalesce(brake_count, 0) AS brake_count, x3.* EXCLUDE (run, brake_count), coalesce(full_brake_count, 0) AS full_brake_count, x4.* EXCLUDE (run, full_brake_count),
    tyre_f.* EXCLUDE (run), tyre_r.* EXCLUDE (run) FROM rn LEFT JOIN x1 USING (run) LEFT JOIN x2 USING (run) LEFT JOIN x3 USING (run) LEFT JOIN x4 USING (run)
    LEFT JOIN tyre_f USING (run) LEFT JOIN tyre_r USING (run)""")
def bundle_dynamics(spark, d):
    """From the files to the 34 columns of a run's dynamics."""
    root = recorded(spark, d)
    channels, ends = _decoded(spark, root, "channels"), _decoded(spark, root, "laps")
    runs = hold(described_runs(spark, read_bundles(spark, root, "header"), channels, ends), "runs")
    return dynamics.run_dynamics(*_recorded_tables(spark, root, channels, ends), runs, LIMITS)


# --- per lap: corners in phases, suspension ---------------------------------------------------------

BANDS = {"brake": (0.0, 40.0), "gas": (0.0, 60.0), "dtps": (-40.0, 30.0), "sus_f": (2.0, 200.0), "sus_r": (50.0, 150.0)}
CORNERS = ph.CornerLimits(min_lap_s=0.2, bands=BANDS, merge_gap=100_000, min_rows=2, corner_brake=60, corner_span=0, corner_search=500_000, corner_half=60_000,
                          corner_gap=400_000, long_lap_s=3.2, few=4, brake_on=15, look_back=600_000, gas_on=25, gas_rows=3, look_ahead=800_000, throttle_low=20)
IN_BANDS = " AND ".join(f"{c} BETWEEN {lo} AND {hi}" for c, (lo, hi) in BANDS.items())
_NAMES = {"speed": "SPEED_FRONT", "brake": "BRAKE_FRONT", "gas": "GAS", "dtps": "dtps_a", "acc": "ACC_Y", "sus_f": "SUSP_FRONT", "sus_r": "SUSP_REAR"}


def _track(name, base, others):
    """SQL for the rows of the role ``base`` in laps, with the latest value of each other role."""
    order = " ".join(f"WHEN '{_NAMES[c]}' THEN {i}" for i, c in enumerate([*others, base]))
    last = ", ".join(f"last_value(CASE WHEN channel = '{c}' THEN value END IGNORE NULLS) OVER w AS {n}" for n, c in
                     [*((r, _NAMES[r]) for r in [base, *others]), ("lap_no", "no"), ("lap_s", "s")])
    names = ", ".join(f"'{_NAMES[c]}'" for c in [base, *others])
    return f"""{name}_a AS (SELECT run, channel, idx, ts_us, value, CASE channel {order} END AS ord FROM smp WHERE channel IN ({names})
    UNION ALL SELECT run, channel, idx, ts_us, value, ord FROM mk),
  {name}_p AS (SELECT *, {last} FROM {name}_a WINDOW w AS (PARTITION BY run ORDER BY ts_us, ord, idx ROWS UNBOUNDED PRECEDING)),
  {name} AS (SELECT run || '_L' || lap_no::BIGINT AS run, run AS run0, lap_no::BIGINT AS lap_no, lap_s, idx AS event_id, ts_us, {', '.join([base, *others])} FROM {name}_p
    WHERE channel = '{_NAMES[base]}' AND lap_no >= 0 AND lap_s >= 0.2)"""


MARKS = LAP_TRACK[:LAP_TRACK.index(",\n  al AS")]


def _areas(source, out):
    return island_cte("ia", source, IN_BANDS) + f""",
  isl AS (SELECT run, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, sum(sus_f) AS sf, count(sus_f) AS nf, sum(sus_r) AS sr, count(sus_r) AS nr FROM ia GROUP BY run, isl),
  ig AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY run ORDER BY start_us) <= 100000 THEN 0 ELSE 1 END AS fresh FROM isl),
  ih AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY start_us) AS grp FROM ig),
  {out} AS (SELECT run, min(start_us) AS start_us, max(end_us) AS end_us, sum(sf) / sum(nf) AS sus_f, sum(sr) / sum(nr) AS sus_r FROM ih GROUP BY run, grp HAVING sum(n) >= 2)"""


PHASES = f"""{MARKS}, {_track("wide", "brake", ["speed", "gas", "dtps", "sus_f", "sus_r"])}, {_areas("wide", "area")},
  wides AS (SELECT * FROM wide WHERE speed IS NOT NULL), {island_cte("ic", "wides", "brake > 60")},
  pkc AS (SELECT run, arg_min(ts_us, (-brake, ts_us)) AS peak_us FROM ic GROUP BY run, isl),
  ap AS (SELECT pkc.run, peak_us, arg_min(ts_us, (speed, ts_us)) AS ts_us FROM pkc JOIN wides ON pkc.run = wides.run AND ts_us >= peak_us AND ts_us < peak_us + 500000 GROUP BY ALL),
  {_kept("ap", "rc", 400000)}, cor AS (SELECT run, ts_us - 60000 AS start_us, ts_us + 60000 AS end_us FROM rc WHERE ts_us IS NOT NULL),
  tag AS (SELECT run, start_us, end_us, 'bands' AS detector FROM area UNION ALL SELECT run, start_us, end_us, 'brake' FROM cor),
  len AS (SELECT run, max(run0) AS run0, max(lap_no) AS lap_no, max(lap_s) AS lap_s FROM wide GROUP BY run),
  num AS (SELECT run, count(*) FILTER (detector = 'bands') AS n, count(*) FILTER (detector = 'brake') AS m FROM tag GROUP BY run),
  rul AS (SELECT run, CASE WHEN m > 0 AND (n = 0 OR lap_s > 3.2 AND n < 4 OR n < m * 0.5) THEN 'brake' ELSE 'bands' END AS detector FROM num JOIN len USING (run)),
  segs AS (SELECT tag.* FROM tag JOIN rul USING (run, detector)), {island_cte("b", "wide", "brake > 15")},
  bon AS (SELECT run, ts_us, min(ts_us) OVER (PARTITION BY run, isl) AS rs FROM b),
  bh AS (SELECT s.*, bon.rs, bon.ts_us AS last_on FROM segs s ASOF LEFT JOIN bon ON s.run = bon.run AND s.start_us > bon.ts_us),
  bs AS (SELECT run, start_us, end_us, detector, CASE WHEN last_on >= start_us - 600000 THEN greatest(rs, start_us - 600000) ELSE start_us END AS from_us FROM bh),
  fl AS (SELECT run, lag(ts_us, 2) OVER w AS b, ts_us AS e, gas > 25 AND lag(gas, 1) OVER w > 25 AND lag(gas, 2) OVER w > 25 AS ok FROM wide WINDOW w AS (PARTITION BY run ORDER BY ts_us, event_id)),
  fw AS (SELECT s.*, CASE WHEN e < end_us + 800000 THEN b ELSE end_us + 800000 END AS to_us FROM bs s ASOF LEFT JOIN (SELECT * FROM fl WHERE ok) f ON s.run = f.run AND s.end_us <= f.b),
  ph AS (SELECT fw.run, start_us, end_us, from_us, to_us, detector, max(brake) FILTER (ts_us >= from_us AND ts_us < start_us) AS peak, avg(sus_f) FILTER (ts_us >= from_us AND ts_us < start_us) AS s1,
    greatest(0, min(speed) FILTER (ts_us BETWEEN start_us AND end_us)) AS v, avg(sus_f) FILTER (ts_us BETWEEN start_us AND end_us) AS s3, avg(sus_r) FILTER (ts_us BETWEEN start_us AND end_us) AS r3,
    avg(gas) FILTER (ts_us >= end_us AND ts_us < to_us) AS g4, avg(sus_f) FILTER (ts_us >= end_us AND ts_us < to_us) AS s4 FROM fw JOIN wide ON fw.run = wide.run GROUP BY ALL)"""


def _ms(c):
    return f"round(({c}) / 1000.0 + 1e-9, 1)::DOUBLE"


@query(f"""WITH RECURSIVE {PHASES} SELECT run0 AS run, lap_no, round(lap_s + 1e-9, 3) AS lap_s, row_number() OVER (PARTITION BY ph.run ORDER BY start_us) AS corner_no, detector,
    {_ms('start_us - from_us')} AS ph12_ms, {_ms('end_us - start_us')} AS ph3_ms, {_ms('to_us - end_us')} AS ph45_ms, peak AS ph12_brake_peak, round(s1 + 1e-9, 2) AS ph12_susf_avg,
    v AS ph3_speed_min, round(CASE WHEN s3 BETWEEN 0 AND 200 THEN s3 END + 1e-9, 2) AS ph3_susf_avg, round(CASE WHEN r3 BETWEEN 0 AND 200 THEN r3 END + 1e-9, 2) AS ph3_susr_avg,
    round(g4 + 1e-9, 2) AS ph45_gas_avg, round(s4 + 1e-9, 2) AS ph45_susf_avg, {_ms('to_us - from_us')} AS total_ms FROM ph JOIN len USING (run)""")
def bundle_corner_phases(spark, d):
    """Corners of each lap in three phases, the detector chosen per lap."""
    root = recorded(spark, d)
    return ph.corner_phases(*_recorded_tables(spark, root, _decoded(spark, root, "channels"), _decoded(spark, root, "laps")), CORNERS)


def _m2(c):
    return f"round(avg({c}) + 1e-9, 2)"


LAP_SUSPENSION = f"""{MARKS}, {_track("t2", "speed", ["brake", "gas", "dtps", "acc", "sus_f", "sus_r"])}, {_areas("t2", "area")},
  has AS (SELECT DISTINCT run AS run0 FROM smp WHERE channel = 'dtps_a'),
  e1 AS (SELECT a.run, t2.speed, a.sus_f, a.sus_r FROM (SELECT *, (start_us + end_us) // 2 AS mid_us FROM area WHERE split_part(run, '_L', 1) IN (SELECT run0 FROM has)) a
    ASOF LEFT JOIN t2 ON a.run = t2.run AND a.mid_us >= t2.ts_us),
  t AS (SELECT * FROM t2 WHERE run0 NOT IN (SELECT run0 FROM has)),
  {_turns("lo", "speed", 300000)}, mins AS (SELECT * FROM lo WHERE g < 0 AND gn >= 0 AND s < top * 0.92 AND peak - s >= 15), {_kept("mins", "k1", 250000)},
  low AS (SELECT mins.run, mins.ts_us FROM mins JOIN k1 USING (run, ts_us)),
  {_turns("hi", "abs(acc)", 250000)}, strong AS (SELECT run FROM t GROUP BY run HAVING max(abs(acc)) >= 2.25),
  pts AS (SELECT hi.* FROM hi JOIN strong USING (run) WHERE g >= 0 AND gn < 0 AND s >= 1.5 AND s - others >= -0.6), {_kept("pts", "k2", 400000)},
  tied AS (SELECT pts.*, k2.ts_us AS anchor FROM pts ASOF JOIN (SELECT * FROM k2 WHERE ts_us IS NOT NULL) k2 ON pts.run = k2.run AND pts.ts_us >= k2.ts_us),
  best AS (SELECT run, arg_max(ts_us, (s, -ts_us)) AS ts_us FROM tied GROUP BY run, anchor),
  c AS (SELECT coalesce(a.run, b.run) AS run, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT run, count(*) AS na FROM best GROUP BY run) a
    FULL JOIN (SELECT run, count(*) AS nb FROM low GROUP BY run) b ON a.run = b.run),
  pick AS (SELECT run, ts_us AS at_us FROM best JOIN c USING (run) WHERE NOT (nb > 0 AND na < 0.7 * nb) UNION ALL SELECT run, ts_us FROM low JOIN c USING (run) WHERE nb > 0 AND na < 0.7 * nb),
  nr AS (SELECT pick.run, at_us, ts_us, gas FROM pick JOIN t ON pick.run = t.run AND ts_us >= at_us - 300000 AND ts_us < at_us + 2000000 WHERE gas IS NOT NULL),
  lw AS (SELECT run, at_us, arg_min(ts_us, (gas, ts_us)) AS low_us, min(gas) AS lowest FROM nr GROUP BY ALL),
  cr AS (SELECT nr.run, nr.at_us, min(ts_us) AS ts_us FROM nr JOIN lw USING (run, at_us) WHERE lowest <= 20 AND ts_us >= low_us AND gas > 20 GROUP BY ALL),
  e2 AS (SELECT t.run, speed, sus_f, sus_r FROM cr JOIN t USING (run, ts_us)),
  es AS (SELECT *, avg(speed / 3.6) OVER {_around(35000)} AS s FROM t2), eg AS {slope_cte('es', 's', unit=1000000)}, {island_cte("ie", "eg", "g < -8 AND speed >= 10")},
  st AS (SELECT run, min(ts_us) AS ts_us FROM ie GROUP BY run, isl HAVING count(*) >= 2), {_kept("st", "k0", 800000)},
  ke AS (SELECT run, ts_us - 80000 AS at_us FROM k0 WHERE ts_us IS NOT NULL),
  ent AS (SELECT ke.run, speed, sus_f, sus_r FROM ke ASOF LEFT JOIN t2 ON ke.run = t2.run AND ke.at_us >= t2.ts_us),
  {island_cte("ib", "t2", "brake >= 20 AND speed >= 10")},
  pb AS (SELECT *, max(brake) OVER e AS peak, min(ts_us) OVER e AS from_us, max(ts_us) OVER e AS to_us FROM ib WINDOW e AS (PARTITION BY run, isl)),
  ful AS (SELECT run, avg(sus_f) AS sus_f, avg(sus_r) AS sus_r FROM pb WHERE to_us - from_us >= 50000 AND brake >= 0.85 * peak GROUP BY run, isl HAVING avg(sus_f) IS NOT NULL),
  {_track("tf", "sus_f", [])}, {_track("tr", "sus_r", [])},
  x1 AS (SELECT run, count(*) AS apex_count, {_m2('speed')} AS apex_speed_avg, {_m2('sus_f')} AS apex_susf_avg, {_m2('sus_r')} AS apex_susr_avg FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY 1),
  x2 AS (SELECT run, count(*) AS brake_count, {_m2('speed')} AS brake_speed_avg, {_m2('sus_f')} AS brake_susf_avg, {_m2('sus_r')} AS brake_susr_avg FROM ent GROUP BY 1),
  x3 AS (SELECT run, count(*) AS full_brake_count, {_m2('sus_f')} AS full_brake_susf_avg, {_m2('sus_r')} AS full_brake_susr_avg FROM ful GROUP BY 1),
  x4 AS (SELECT run, {_m2('sus_f')} AS lap_susf_mean, round(min(sus_f) + 1e-9, 2) AS lap_susf_min, round(max(sus_f) + 1e-9, 2) AS lap_susf_max FROM tf GROUP BY 1),
  x5 AS (SELECT run, {_m2('sus_r')} AS lap_susr_mean FROM tr GROUP BY 1),
  lap AS (SELECT run, max(run0) AS run0, max(lap_no) AS lap_no, round(max(lap_s) + 1e-9, 3) AS lap_s, round(max(lap_s) * 1000 + 1e-6)::BIGINT AS ms FROM t2 GROUP BY run)"""


@query(f"""WITH RECURSIVE {LAP_SUSPENSION} SELECT run0 AS run, lap_no, lap.run AS lap_id, lap_s,
    (ms // 60000) || ':' || lpad(((ms % 60000) // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS lap_time,
    coalesce(apex_count, 0) AS apex_count, apex_speed_avg, apex_susf_avg, apex_susr_avg, coalesce(brake_count, 0) AS brake_count, brake_speed_avg, brake_susf_avg, brake_susr_avg,
    coalesce(full_brake_count, 0) AS full_brake_count, full_brake_susf_avg, full_brake_susr_avg, lap_susf_mean, lap_susf_min, lap_susf_max, lap_susr_mean
    FROM lap LEFT JOIN x1 USING (run) LEFT JOIN x2 USING (run) LEFT JOIN x3 USING (run) LEFT JOIN x4 USING (run) LEFT JOIN x5 USING (run)""")
def bundle_lap_suspension(spark, d):
    """Suspension per lap, from the files: apexes, brake entries, full braking and the whole lap."""
    root = recorded(spark, d)
    return ph.lap_suspension(*_recorded_tables(spark, root, _decoded(spark, root, "channels"), _decoded(spark, root, "laps")), CORNERS, LIMITS)
