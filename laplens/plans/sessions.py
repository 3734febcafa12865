"""Sessions imported from logger bundles: orders as recordings with a header, a log and a lap file."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from laplens.operators import facts, sessions
from laplens.plans.files import START_MS, _bytes
from laplens.plans.registry import LAPS, laps, query, runs
from laplens.session import hold
from laplens.sources import bundle

NAMES = ["FP-JA52-", "QP-77-", "X-", "WUP2-DA-"]


def recordings(spark, d):
    """Bundle files of every order: a seventh without a header, a third with a log, and lap files where there are laps."""
    k = F.col("run")
    name = F.concat(F.element_at(F.array(*[F.lit(n) for n in NAMES]), (k % 4 + 1).cast("int")), k.cast("string"))
    folder = F.concat(F.when(k % 5 == 0, "/data/Elsewhere/").otherwise(F.concat(F.lit("/data/R0"), (k % 3 + 1).cast("string"), F.lit("_PLACE.26/"))), name, F.lit(".MES/"))
    o = runs(spark, d).repartition("run").withColumns({"folder": folder, "name": name})
    head = F.concat_ws("\r\n", F.lit("[GENERAL]"), F.concat(F.lit("Date="), F.date_format(F.to_date("date"), "dd/MM/yyyy")), F.concat(F.lit("Circuit="), F.when(k % 2 == 0, F.lit("template ")).otherwise("")),
                       F.lit("Event=gp"), F.concat(F.lit("Session="), "session"), F.concat(F.lit("Rider Number="), F.col("rider").cast("string")), F.lit("Condition=dry"),
                       F.concat(F.lit("Front Tyre=T"), (k % 6).cast("string")), F.lit("Spec=s1"), F.lit("[Laptimes]"), F.lit("Fastest lap=9:59.999"))
    log = F.concat(F.lit("x\r\nPath for measurement: C:\\d\\R03_GRAND_HILL.26\\"), "name", F.lit(".MES\r\n"))
    latin = lambda c: F.encode(c, "ISO-8859-1")
    upto = Window.partitionBy("run").orderBy("lap_no")
    ms = F.floor("t")
    end = F.when(F.count_if(ms.isNull()).over(upto) == 0, START_MS + F.sum(ms).over(upto))
    times = laps(spark, d).select("run", "lap_no", end.alias("end")).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("lap_no", "end"))).alias("a"))
    words = F.concat(F.array(F.size("a").cast("long"), F.lit(0).cast("long"), F.lit(START_MS).cast("long")), F.transform("a", lambda x: x["end"]))
    # All files of an order are made in its row, and orders are dealt out, so every task writes, and later reads, as many headers as the others.
    file = lambda when, path, content: F.when(when, F.struct(path.alias("path"), content.alias("content")))
    made = F.array(file(k % 7 != 0, F.concat("folder", "name", F.lit(".HED")), latin(head)),
                   file(k % 3 == 0, F.concat("folder", F.lit(sessions.LOG_FILE)), latin(log)),
                   file(F.col("a").isNotNull(), F.concat("folder", "name", F.lit(".LAP")), _bytes(words, 4)))
    files = o.join(times, "run", "left").select(F.explode(made).alias("f")).filter("f IS NOT NULL").select("f.*")
    return bundle.with_parts(hold(files, "recordings"))


_NAME = "CASE o_orderkey % 4 WHEN 0 THEN 'FP-JA52-' WHEN 1 THEN 'QP-77-' WHEN 2 THEN 'X-' ELSE 'WUP2-DA-' END || o_orderkey"
SESSIONS = f"""{LAPS}, lm AS (SELECT run, lap_no - 1 AS lap_no, floor(t)::BIGINT AS ms FROM laps),
  lt AS (SELECT run, count(*) FILTER (lap_no > 0) AS n, min(ms) FILTER (lap_no > 0) AS best, avg(ms) FILTER (lap_no > 0) AS mean FROM lm GROUP BY run),
  oh AS (SELECT *, {_NAME} AS name, o_orderkey % 7 <> 0 AS headed, upper(o_orderpriority) AS code FROM orders),
  se AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'ELSEWHERE' ELSE 'ROUND' || (o_orderkey % 3 + 1) END AS round,
    CASE WHEN o_orderkey % 3 = 0 THEN 'GRAND HILL' WHEN NOT headed THEN NULL WHEN o_orderkey % 2 = 0 THEN 'TEMPLATE' ELSE 'GP' END AS circuit,
    CASE WHEN headed THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
    CASE o_orderkey % 4 WHEN 0 THEN 'FP' WHEN 1 THEN 'QP' WHEN 3 THEN 'WUP2' ELSE CASE WHEN NOT headed THEN 'FP' WHEN contains(code, 'L1') THEN 'FP' WHEN contains(code, 'SP') THEN 'SP'
      WHEN contains(code, 'Q') THEN 'QP' WHEN contains(code, 'W') THEN 'WUP1' ELSE 'FP' END END AS session_type,
    CASE WHEN contains(name, '52') OR contains(name, 'JA') THEN 'JA52' WHEN contains(name, '77') OR contains(name, 'DA') THEN 'DA77' WHEN NOT headed THEN 'UNKNOWN'
      WHEN o_custkey = 52 THEN 'JA52' WHEN o_custkey = 77 THEN 'DA77' ELSE '#' || o_custkey END AS rider, o_orderkey AS run_no,
    coalesce(n, 0)::INTEGER AS total_laps, round(best / 1000.0, 3)::DOUBLE AS best_s, round(mean) / 1000 AS avg_s, CASE WHEN headed THEN 'dry' END AS condition,
    CASE WHEN headed THEN 's1' END AS fork_spec, CASE WHEN headed THEN 'T' || (o_orderkey % 6) END AS tyre_f, headed
    FROM oh LEFT JOIN lt ON run = o_orderkey WHERE headed OR o_orderkey % 3 = 0 OR lt.run IS NOT NULL)"""
_TIME = lambda ms: f"({ms} // 60000) || ':' || lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"
_WHO = ", ".join(sessions.WHO)


@query(f"""WITH {SESSIONS} SELECT {_WHO}, total_laps, best_s, avg_s, condition, fork_spec, fork_spec AS shock_spec,
  CASE WHEN best IS NOT NULL THEN {_TIME('best')} WHEN headed THEN '9:59.999' END AS best_lap FROM se LEFT JOIN lt ON run = key""")
def job_header_import(spark, d):
    """Sessions by header, log and name. Importing them again, and what an earlier import left, adds nothing twice."""
    found = hold(sessions.session_table(recordings(spark, d)), "sessions")
    found = found.select("run", "name", *dict.fromkeys([*sessions.WHO, *sessions.SESSION_SHEET]))
    stored = found.filter(F.crc32("name") % 3 == 0)
    every = facts.insert_new(stored, found.unionByName(found), ["run"], "total_laps")
    return sessions.session_sheet(every).select(*sessions.WHO, "total_laps", "best_s", "avg_s", "condition", "fork_spec", "shock_spec", "best_lap")


@query(f"""WITH {SESSIONS} SELECT {_WHO}, lap_no, {_TIME('ms')} AS lap_time, round(ms / 1000.0, 3)::DOUBLE AS lap_s, lap_no = 0 AS is_outlap, condition, NULL::VARCHAR AS air_temp,
  NULL::VARCHAR AS track_temp, tyre_f, NULL::VARCHAR AS tyre_r, lap_no > 0 AND ms - best * 1 < 2 AS is_best FROM se JOIN lm ON run = key LEFT JOIN lt ON lt.run = key""")
def header_lap_sheet(spark, d):
    return sessions.lap_sheet(sessions.session_table(recordings(spark, d)))


@query(f"""WITH {SESSIONS} SELECT {_WHO}, condition, tyre_f, {', '.join(f'NULL::VARCHAR AS {c}' for c in sessions.TYRE_SHEET if c not in ('condition', 'tyre_f'))} FROM se""")
def header_tyre_sheet(spark, d):
    return sessions.tyre_sheet(sessions.session_table(recordings(spark, d)))
