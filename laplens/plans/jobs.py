"""Composed jobs: the tables a user asks for, built from the operators."""

from pyspark.sql import functions as F

from laplens.functions.ids import lap_id, run_id
from laplens.functions.measures import direction
from laplens.functions.text import normal_session, parse_date
from laplens.operators import events as ev_ops
from laplens.operators import facts, pace, reshape, tags
from laplens.operators import signal as sig
from laplens.operators.ordered import first_k, number
from laplens.plans.files import LAP_ENDS, lap_files, pasted
from laplens.plans.pace import SM_COLS, lap_runs
from laplens.plans.registry import DAY, LAPS, RUNS, WIDE, laps, query, r6, raw_laps, runs, table, wide
from laplens.plans.telemetry import (CORNERS_BODY, ENDS, ENTRY_BODY, KEPT, LIMITER_BODY, MERGED_BODY, PEAKS_BODY, PHASES_BODY,
                                     areas, corners, entries, full_braking, lap_spans_from_first, phases, zones)
from laplens.session import hold
from laplens.sources import bundle, tables
from laplens.sources.sinks import write_table

# --- telemetry --------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {WIDE}, {LIMITER_BODY}, {ENTRY_BODY}, {KEPT}, {PEAKS_BODY}, {MERGED_BODY},
  a AS (SELECT run, count(*) AS samples, max(speed) AS top_speed FROM wide GROUP BY run),
  b1 AS (SELECT run, count(*) AS apex_count, round(avg(susp) + 1e-9, 6) AS apex_susp FROM mrg WHERE n >= 3 GROUP BY run),
  b2 AS (SELECT run, count(*) AS pit_count, round(avg(speed) + 1e-9, 6) AS pit_speed FROM z GROUP BY run),
  b3 AS (SELECT run, count(*) AS brk_count, round(avg(speed) + 1e-9, 6) AS brk_speed, round(avg(susp) + 1e-9, 6) AS brk_susp FROM ent GROUP BY run),
  b4 AS (SELECT run, count(*) AS full_count, round(avg(susp) + 1e-9, 6) AS full_susp FROM pk GROUP BY run)
  SELECT a.run, samples, top_speed, coalesce(apex_count, 0) AS apex_count, apex_susp, coalesce(pit_count, 0) AS pit_count, pit_speed,
    coalesce(brk_count, 0) AS brk_count, brk_speed, brk_susp, coalesce(full_count, 0) AS full_count, full_susp
  FROM a LEFT JOIN b1 USING (run) LEFT JOIN b2 USING (run) LEFT JOIN b3 USING (run) LEFT JOIN b4 USING (run)""")
def job_run_dynamics(spark, d):
    """Per run: apex areas, limiter zones, brake entries and full braking."""
    t = wide(spark, d).persisted()
    base = t.df.groupBy("run").agg(F.count("*").alias("samples"), F.max("speed").alias("top_speed"))
    return ev_ops.with_event_stats(
        base, ["run"],
        apex=(areas(spark, d, t), [r6(F.avg("susp")).alias("apex_susp")]),
        pit=(zones(spark, d, t), [r6(F.avg("mean_speed")).alias("pit_speed")]),
        brk=(entries(spark, d, t), [r6(F.avg("speed")).alias("brk_speed"), r6(F.avg("susp")).alias("brk_susp")]),
        full=(full_braking(spark, d, t), [r6(F.avg("mean_susp")).alias("full_susp")]))


LAP_SPANS = """lb AS (SELECT run, lap_no, greatest(start_us, t0) AS lap_start, ts_us AS lap_end FROM ends JOIN (SELECT run, min(ts_us) AS t0 FROM wide GROUP BY run) USING (run))"""


def in_laps(spark, d, rows, at):
    """Rows or events with the lap their clock falls into."""
    spans = lap_spans_from_first(spark, d).select("run", "lap_no", F.col("start_us").alias("lap_start"), F.col("end_us").alias("lap_end"))
    return sig.interval_join(rows, spans, ["run"], at, "lap_start", "lap_end", DAY)


@query(f"""WITH RECURSIVE {WIDE}, {ENDS[ENDS.index('ends AS'):]}, {LAP_SPANS}, {MERGED_BODY}, {PEAKS_BODY},
  x AS (SELECT lb.run, lap_no, lap_end - lap_start AS lap_us, round(avg(susp) + 1e-9, 6) AS susp_mean, min(susp) AS susp_min, max(susp) AS susp_max
    FROM lb JOIN wide ON lb.run = wide.run AND ts_us >= lap_start AND ts_us < lap_end GROUP BY ALL),
  a1 AS (SELECT lb.run, lap_no, count(*) AS apex_count, round(avg(susp) + 1e-9, 6) AS apex_susp FROM lb JOIN mrg ON lb.run = mrg.run AND start_us >= lap_start AND start_us < lap_end
    WHERE n >= 3 GROUP BY ALL),
  a2 AS (SELECT lb.run, lap_no, count(*) AS fullbrk_count, round(avg(susp) + 1e-9, 6) AS fullbrk_susp FROM lb JOIN pk ON lb.run = pk.run AND start_us >= lap_start AND start_us < lap_end GROUP BY ALL)
  SELECT run || '_L' || lap_no AS lap_id, run, lap_no, round(lap_us / 1e6 + 1e-9, 6) AS lap_s, susp_mean, susp_min, susp_max, coalesce(apex_count, 0) AS apex_count, apex_susp,
    coalesce(fullbrk_count, 0) AS fullbrk_count, fullbrk_susp FROM x LEFT JOIN a1 USING (run, lap_no) LEFT JOIN a2 USING (run, lap_no)""")
def job_lap_suspension(spark, d):
    """Per lap: whole-lap suspension statistics and event means."""
    t = wide(spark, d).persisted()
    rows = in_laps(spark, d, t.df.select("run", "ts_us", "susp"), "ts_us")
    base = rows.groupBy("run", "lap_no", "lap_start", "lap_end").agg(r6(F.avg("susp")).alias("susp_mean"), F.min("susp").alias("susp_min"),
                                                                    F.max("susp").alias("susp_max"))
    apex = in_laps(spark, d, areas(spark, d, t).select("run", "start_us", "susp"), "start_us")
    full = in_laps(spark, d, full_braking(spark, d, t).select("run", "start_us", "mean_susp"), "start_us")
    out = ev_ops.with_event_stats(base, ["run", "lap_no"], apex=(apex, [r6(F.avg("susp")).alias("apex_susp")]),
                                  fullbrk=(full, [r6(F.avg("mean_susp")).alias("fullbrk_susp")]))
    return out.withColumns({"lap_id": lap_id(F.col("run").cast("string"), F.col("lap_no")),
                            "lap_s": r6((F.col("lap_end") - F.col("lap_start")) / 1e6)}).drop("lap_start", "lap_end")


@query(f"""WITH RECURSIVE {WIDE}, {MERGED_BODY}, {CORNERS_BODY},
  s1 AS (SELECT run, start_us, end_us FROM mrg WHERE n >= 3), s2 AS (SELECT run, start_us, end_us FROM cor),
  c AS (SELECT run, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT run, count(*) AS na FROM s1 GROUP BY run) FULL JOIN (SELECT run, count(*) AS nb FROM s2 GROUP BY run) USING (run)),
  segs AS (SELECT s1.* FROM s1 JOIN c USING (run) WHERE NOT (na = 0 OR na < 0.5 * nb) UNION ALL SELECT s2.* FROM s2 JOIN c USING (run) WHERE na = 0 OR na < 0.5 * nb),
  {PHASES_BODY} SELECT run, corner_no, start_us, end_us, brake_us, brake_peak, core_us, speed_min, exit_us, total_us FROM ph""")
def job_corner_phases(spark, d):
    """Per corner: braking, apex and exit phases; runs with too few apex areas use the braking detector."""
    t = wide(spark, d).persisted()
    cols = ["run", "start_us", "end_us"]
    weak = (F.col("n_first") == 0) | (F.col("n_first") < F.col("n_second") * 0.5)
    # few rows each, read several times below
    by_area, by_brake = areas(spark, d, t).select(cols).persist(), corners(spark, d, t).select(cols).persist()
    segs = ev_ops.choose_detector(by_area, by_brake, ["run"], weak).select(cols).persist()
    return phases(t, segs).select("run", "corner_no", "start_us", "end_us", "brake_us", "brake_peak", "core_us", "speed_min", "exit_us", "total_us")


# --- facts and correlation ----------------------------------------------------------------------------

CORR = f"""{LAPS}, {RUNS},
  lp AS (SELECT run, min(t) AS best_s, avg(t) AS mean_s, count(*) AS n FROM laps WHERE lap_no > 1 AND t BETWEEN 2000 AND 90000 GROUP BY run),
  st AS (SELECT rider, status AS circuit, date, run, best_s, mean_s, n FROM lp JOIN runs USING (run)),
  dy AS (SELECT l_orderkey AS run, avg(l_quantity) AS apex, avg(l_discount * 100) AS brk FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
  dk AS (SELECT rider, status AS circuit, date, run, apex, brk FROM dy JOIN runs USING (run)),
  mt AS (SELECT * FROM st JOIN dk USING (rider, circuit, date, run)),
  rk AS (SELECT *, row_number() OVER (PARTITION BY rider, circuit ORDER BY best_s, run) AS rank, count(*) OVER (PARTITION BY rider, circuit) AS rank_total FROM mt),
  tr AS (SELECT *, CASE WHEN rank_total < 3 THEN CASE WHEN rank = 1 THEN 'FAST' ELSE 'SLOW' END WHEN (rank - 1) / greatest(rank_total - 1, 1) <= 0.33 THEN 'FAST'
    WHEN (rank - 1) / greatest(rank_total - 1, 1) >= 0.67 THEN 'SLOW' ELSE 'MED' END AS tier FROM rk),
  cs AS (SELECT rider, circuit, count(*) AS n_rows, min(best_s) AS best_s, avg(apex) FILTER (tier = 'FAST') - avg(apex) FILTER (tier = 'SLOW') + 1e-9 AS d_apex,
    avg(brk) FILTER (tier = 'FAST') - avg(brk) FILTER (tier = 'SLOW') + 1e-9 AS d_brk FROM tr GROUP BY ALL)"""


def matched_runs(spark, d):
    best = pace.usable_laps(laps(spark, d), "t", F.col("lap_no") == 1, 2_000, 90_000).groupBy("run").agg(
        F.min("t").alias("best_s"), F.avg("t").alias("mean_s"), F.count("*").alias("n"))
    dyn = raw_laps(spark, d).filter("l_linestatus = 'F'").groupBy("run").agg(
        F.avg("l_quantity").alias("apex"), F.avg(F.col("l_discount") * 100).alias("brk"))
    key = runs(spark, d).select("rider", F.col("status").alias("circuit"), "date", "run")
    return best.join(dyn, "run").join(key, "run")  # a run has one rider, circuit and date


def tiered_runs(spark, d):
    bound = runs(spark, d).select("rider", F.col("status").alias("circuit"))  # a run matches at most once
    return pace.ranked(matched_runs(spark, d), ["rider", "circuit"], "best_s", ["run"], bound)


def _d(m):
    return F.col(f"d_{m}") + 1e-9


def _dir(label, c):
    return f"CASE WHEN abs({c}) < 0.3 THEN '{label}:same' WHEN {c} IS NOT NULL THEN '{label}:' || printf('%+.1f', round({c}, 1)) END"


@query(f"""WITH {CORR} SELECT rider, circuit, n_rows, best_s, round(d_apex, 6) AS d_apex, round(d_brk, 6) AS d_brk,
    coalesce(nullif(concat_ws('  |  ', {_dir('Apex', 'd_apex')}, {_dir('Brk', 'd_brk')}), ''), '—') AS direction FROM cs""")
def job_correlation(spark, d):
    """Lap bests joined to dynamics: rank, tier, FAST minus SLOW and direction per rider and circuit."""
    s = pace.tier_means(tiered_runs(spark, d), ["rider", "circuit"], ["apex", "brk"], F.min("best_s").alias("best_s"))
    return s.select("rider", "circuit", "n_rows", "best_s", F.round(_d("apex"), 6).alias("d_apex"), F.round(_d("brk"), 6).alias("d_brk"),
                    direction({"Apex": _d("apex"), "Brk": _d("brk")}).alias("direction"))


@query(f"""WITH {CORR}, u AS (SELECT rider, circuit, 'apex' AS metric, avg(apex) FILTER (tier = 'FAST') AS target, avg(apex) AS mean FROM tr GROUP BY ALL
    UNION ALL SELECT rider, circuit, 'brk', avg(brk) FILTER (tier = 'FAST'), avg(brk) FROM tr GROUP BY ALL)
  SELECT rider, circuit, metric, round(target + 1e-9, 6) AS target, CASE WHEN target - mean > 0.5 THEN 'raise' WHEN target - mean < -0.5 THEN 'lower' ELSE 'keep' END AS advice
  FROM u WHERE target IS NOT NULL""")
def job_setup_target(spark, d):
    """FAST-tier level of each measure as the target, against the overall mean."""
    s = pace.tier_means(tiered_runs(spark, d), ["rider", "circuit"], ["apex", "brk"])
    pairs = s.select("rider", "circuit", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"fast_{m}").alias("target"), F.col(f"all_{m}").alias("mean"))
        for m in ("apex", "brk")])).alias("_p")).select("rider", "circuit", "_p.*")
    gap = F.col("target") - F.col("mean")
    advice = F.when(gap > 0.5, "raise").when(gap < -0.5, "lower").otherwise("keep")
    return pairs.filter("target is not null").select("rider", "circuit", "metric", r6("target").alias("target"), advice.alias("advice"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'D' || strftime(o_orderdate, '%Y') END AS round FROM orders),
  f AS (SELECT o_custkey, o_orderstatus, arg_min(round, o_orderkey) AS fill FROM s WHERE round IS NOT NULL GROUP BY ALL),
  l AS (SELECT l_orderkey, count(*) AS total_laps, min(l_extendedprice) AS best, round(avg(l_extendedprice) + 1e-9, 6) AS avg FROM lineitem GROUP BY 1)
  SELECT coalesce(round, fill, 'UNK') || '_' || o_orderstatus || '_' || regexp_replace(o_orderpriority, '[^A-Z0-9]', '', 'g') || '_' || o_custkey || '_R' || o_orderkey AS run_id,
    coalesce(round, fill, 'UNK') AS round, coalesce(total_laps, 0) AS total_laps, best, avg FROM s LEFT JOIN f USING (o_custkey, o_orderstatus) LEFT JOIN l ON o_orderkey = l_orderkey""")
def job_unified_facts(spark, d):
    """Run fact with filled rounds, generated ids and lap totals."""
    s = table(spark, d, "orders").withColumn(
        "round", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("D"), F.year("o_orderdate").cast("string"))))
    s = s.withColumn("rider", F.col("o_custkey").cast("string"))
    s = facts.fill_from_first(s, s, ["rider", "o_orderstatus"], "round", "o_orderkey")
    lap = raw_laps(spark, d).groupBy(F.col("run").alias("o_orderkey")).agg(
        F.count("*").alias("total_laps"), F.min("t").alias("best"), r6(F.avg("t")).alias("avg"))
    rid = run_id(F.col("round"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("rider"), F.col("o_orderkey"))
    return s.join(lap, "o_orderkey", "left").select(rid.alias("run_id"), "round", F.coalesce("total_laps", F.lit(0)).alias("total_laps"), "best", "avg")


@query(f"""WITH {LAP_ENDS}, x AS (SELECT run, lap_no, end_ms - coalesce(lag(end_ms) OVER (PARTITION BY run ORDER BY lap_no), start_ms) AS ms FROM le),
  b AS (SELECT run, min(ms) FILTER (lap_no > 0) AS best, count(*) FILTER (lap_no > 0) AS n,
    string_agg(lap_no || '=' || ms, ' ' ORDER BY lap_no) AS laps FROM x GROUP BY run)
  SELECT run, round(best / 1000.0, 3)::DOUBLE AS best_s, n AS total_laps, laps FROM b""")
def job_session_import(spark, d):
    """Lap files to sessions with nested laps; importing the same sessions again adds nothing."""
    ends = bundle.read_laps(bundle.with_parts(lap_files(spark, d))).withColumns({"end_us": F.col("end_ms") * 1000, "from_us": F.col("start_ms") * 1000})
    lap = sig.lap_bounds(ends.select("run", "end_us", "from_us"), ["run"], "end_us", "from_us").withColumn("ms", F.floor(F.col("duration_us") / 1000))
    timed = F.when(F.col("lap_no") > 0, F.col("ms"))
    head = lap.groupBy("run").agg(F.round(F.min(timed) / 1000, 3).alias("best_s"), F.count(timed).alias("total_laps"))
    pair = F.concat_ws("=", F.col("lap_no").cast("string"), F.col("ms").cast("string"))
    nested = lap.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("lap_no", pair.alias("shown")))).alias("laps"))  # the laps of one file
    sessions = hold(head.join(nested, "run").withColumn("laps", F.array_join(F.transform("laps", lambda x: x["shown"]), " ")), "sessions")
    stored = hold(sessions.filter(F.crc32("run") % 3 == 0), "stored")  # what an earlier import left
    return facts.incremental(stored, sessions.unionByName(sessions), ["run"], "best_s", "total_laps")


# --- analysis pages -----------------------------------------------------------------------------------


@query(f"""WITH {RUNS}, t AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS tag, l_orderkey AS run FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
  g AS (SELECT tag, count(*) AS total, count(DISTINCT session) AS n_sessions, string_agg(DISTINCT status, ', ' ORDER BY status) AS circuits, min(date) AS first_date, max(date) AS last_date,
    count(DISTINCT (session, status)) AS active FROM t JOIN runs USING (run) GROUP BY tag)
  SELECT *, row_number() OVER (ORDER BY total DESC, tag) AS position FROM g""")
def job_trend(spark, d):
    """Problem tags by total: where they occur, over which dates, in how many active sessions."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tag"))
    t = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("run")).join(p, "l_partkey")
    j = t.join(runs(spark, d), "run")
    g = j.groupBy("tag").agg(F.count("*").alias("total"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    where = tags.distinct_text(j, ["tag"], "status", "circuits").select("tag", "circuits")
    kinds = j.select("tag", "session", "status").distinct().groupBy("tag").agg(
        F.count("*").alias("active"), F.countDistinct("session").alias("n_sessions"))
    return number(g.join(where, "tag").join(kinds, "tag"), [], [F.col("total").desc(), F.col("tag")], "position")


@query(f"""WITH {LAPS}, {RUNS}, top AS (SELECT session, status FROM runs ORDER BY date DESC, session DESC, status DESC LIMIT 1),
  r AS (SELECT runs.* FROM runs JOIN top USING (session, status)), p AS (SELECT *, row_number() OVER (ORDER BY best, run) AS rn, count(*) OVER () AS n FROM r),
  th AS (SELECT run, rn <= greatest(1, n // 3) AS f, rn > n - greatest(1, n // 3) AS s FROM p),
  x AS (SELECT l_linenumber AS corner_no, avg(l_quantity) FILTER (f) AS fast_ms, avg(l_quantity) FILTER (s) AS slow_ms, min(t) AS speed_min, count(*) AS n
    FROM laps JOIN th USING (run) GROUP BY 1)
  SELECT corner_no, n, speed_min, round(slow_ms - fast_ms + 1e-9, 6) AS delta_ms FROM x WHERE fast_ms IS NOT NULL AND slow_ms IS NOT NULL""")
def job_phase_compare(spark, d):
    """Latest event: SLOW minus FAST third per corner."""
    r = pace.latest_rows(runs(spark, d), "date", ["session", "status"]).withColumn("_all", F.lit(1))
    th = pace.thirds(r, ["_all"], "best", ["run"]).select("run", "is_fast", "is_slow")
    j = raw_laps(spark, d).join(th, "run")
    g = j.groupBy(F.col("l_linenumber").alias("corner_no")).agg(
        F.avg(F.when(F.col("is_fast"), F.col("l_quantity"))).alias("f"), F.avg(F.when(F.col("is_slow"), F.col("l_quantity"))).alias("s"),
        F.min("t").alias("speed_min"), F.count("*").alias("n"))
    return g.filter("f is not null and s is not null").select("corner_no", "n", "speed_min", r6(F.col("s") - F.col("f")).alias("delta_ms"))


@query(f"""WITH {RUNS}, t AS (SELECT l_orderkey AS run, l_linestatus AS phase FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT run, count(*) AS tag_count FROM t GROUP BY run),
  s AS (SELECT runs.*, coalesce(tag_count, 0) AS tag_count FROM runs LEFT JOIN n USING (run))
  SELECT session, count(DISTINCT s.run) AS sessions, count(DISTINCT s.run) FILTER (tag_count = 0) AS clean, count(*) FILTER (phase = 'F') AS "F", count(*) FILTER (phase = 'O') AS "O",
    count(phase) AS total FROM s LEFT JOIN t USING (run) GROUP BY session""")
def job_problem_analytics(spark, d):
    """Problem heat map: tags per phase and clean sessions per session type."""
    t = raw_laps(spark, d).filter(~F.col("valid")).select("run", F.col("l_linestatus").alias("phase"))
    n = t.groupBy("run").agg(F.count("*").alias("tag_count"))
    s = runs(spark, d).join(n, "run", "left").na.fill(0, ["tag_count"])
    kpi = s.groupBy("session").agg(F.count("*").alias("sessions"), F.count_if(F.col("tag_count") == 0).alias("clean"))
    heat = reshape.pivot_counts(t.join(runs(spark, d), "run"), ["session"], "phase", ["F", "O"])
    return kpi.join(heat, "session", "left").na.fill(0, ["F", "O"]).withColumn("total", F.col("F") + F.col("O"))


@query(f"""WITH {LAPS}, {RUNS}, sm AS (SELECT session, rider, min(t) AS best, avg(t) AS mean, stddev_pop(t) AS sigma, count(*) AS laps FROM laps JOIN runs USING (run) GROUP BY ALL),
  sg AS (SELECT *, best - min(best) OVER (PARTITION BY session) AS p1_gap, mean - best AS avg_delta, count(*) OVER (PARTITION BY rider) AS ns FROM sm)
  SELECT rider, session, laps, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in SM_COLS)}, p1_gap = 0 AS is_p1 FROM sg WHERE ns >= 2""")
def job_lap_analytics(spark, d):
    """Session metrics of riders seen in at least two session types."""
    m = pace.session_metrics(lap_runs(spark, d), ["session"], ["rider"], "t")
    m = pace.supported(m, ["rider"], "best", 2)
    return m.select("rider", "session", "laps", *[r6(c).alias(c) for c in SM_COLS], (F.col("p1_gap") == 0).alias("is_p1"))


@query(f"""WITH {LAPS}, g AS (SELECT run, lap_no, round(round(t) / 1000, 3) AS lap_time FROM laps WHERE run % 11 <> 0 AND run % 7 <> 0)
  SELECT run, lap_no, lap_time FROM g WHERE run % 3 = 0""")
def job_submission_review(spark, d):
    """Pasted laps: parsed, decided on, and the approved ones added once."""
    good, _ = tables.pasted_laps(pasted(spark, d))
    pending = good.select("run", "lap_no", "lap_time").withColumn("status", F.lit("pending"))
    decisions = runs(spark, d).select("run", "date", F.when(F.col("run") % 3 == 0, "approved").otherwise("rejected").alias("decision"))
    done = facts.review(pending, decisions, "run", "date").filter("status = 'approved'").select("run", "lap_no", "lap_time")
    done = hold(done, "approved")
    stored = done.filter("lap_no % 2 = 0")  # what an earlier review added
    return facts.insert_new(stored, done.unionByName(done), ["run", "lap_no"], "lap_time")


@query(f"""WITH {RUNS} SELECT run, upper(session) AS session, date, row_number() OVER (PARTITION BY rider ORDER BY date DESC, run DESC) AS recency,
  strftime(date::DATE, '%Y-%m-%d') AS day FROM runs QUALIFY recency <= 3""")
def job_latest_sessions(spark, d):
    """Latest three sessions of each rider."""
    top = first_k(runs(spark, d), ["rider"], [F.col("date").desc(), F.col("run").desc()], 3, "recency")
    return top.select("run", normal_session(F.col("session")).alias("session"), "date", "recency", parse_date(F.col("date")).alias("day"))


def refresh(spark, d, out):
    """Run dynamics, correlation and setup targets in order and store them; an error stops the chain."""
    return {job.__name__: write_table(job(spark, d), f"{out}/{job.__name__}")
            for job in (job_run_dynamics, job_correlation, job_setup_target)}

