"""Report sheets with damaged ones among them, as tagged results, and their review."""

from pyspark.sql import functions as F

from laplens.functions.text import rider_number, rider_of_number
from laplens.operators import facts, reports
from laplens.plans.files import report_cells
from laplens.plans.registry import LAPS, RUNS, query, runs, table
from laplens.session import fresh_path, hold


def damaged_cells(spark, d):
    """Report sheets of which some lack the rider, the session label or the lap total; those of runs without laps have a setup only."""
    key = F.col("sheet").cast("long")
    at = lambda row, col: (F.col("row") == row) & (F.col("col") == col)
    lost = (at(1, 2) & (key % 13 == 0)) | (at(7, 5) & (key % 17 == 0)) | (at(36, 5) & (key % 19 == 0))
    cells = report_cells(spark, d).filter(~lost)
    more = runs(spark, d).select(F.col("status").alias("file"), F.col("run").cast("string").alias("sheet"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("row"), F.lit(4).alias("col"), v.alias("value")) for r, v in [
            (11, F.lit(" K-1 ")), (17, F.concat((F.col("run") % 30).cast("string"), F.lit(",7"))), (24, F.lit("soft"))]])).alias("c")).select("file", "sheet", "c.*")
    return hold(cells.unionByName(more), "cells")


_SHEET = """CASE WHEN run % 13 = 0 OR n IS NULL THEN 'no rider or circuit' WHEN run % 17 = 0 THEN 'no session column' END"""
RESULTS = f"""{LAPS}, {RUNS}, rs AS (SELECT runs.*, rider::VARCHAR AS rider_id, CASE WHEN contains(rider::VARCHAR, '77') THEN 77 WHEN contains(rider::VARCHAR, '52') THEN 52 ELSE 0 END AS rider_num,
    n, b, {_SHEET} AS why FROM runs LEFT JOIN (SELECT run, count(*) AS n, min(t) AS b FROM laps GROUP BY run) USING (run)),
  lc AS (SELECT laps.run, lap_no, t, rs.* EXCLUDE (run), CASE WHEN lap_no > 42 THEN 'past the last lap row' WHEN laps.run % 4 = 0 THEN 'unreadable time'
    WHEN laps.run % 5 = 0 AND lap_no > 3 THEN 'below an empty cell' END AS bad FROM laps JOIN rs ON rs.run = laps.run WHERE why IS NULL AND laps.run % 19 <> 0 AND NOT (laps.run % 5 = 0 AND lap_no = 3)),
  res AS (SELECT run::VARCHAR AS sheet, status AS file, CASE WHEN why IS NOT NULL THEN 'rejected sheet' WHEN run % 19 = 0 THEN 'rejected session' ELSE 'session' END AS kind,
      coalesce(why, CASE WHEN run % 19 = 0 THEN 'no lap total' END) AS reason, CASE WHEN run % 13 <> 0 AND n > 0 THEN rider_id END AS rider, CASE WHEN run % 13 <> 0 AND n > 0 THEN rider_num ELSE 0 END AS rider_num,
      CASE WHEN why IS NULL THEN 'FP' END AS session_type, (run % 30)::BIGINT AS f_comp, CASE WHEN n > 0 THEN 12.0::DOUBLE END AS f_preload, NULL::DOUBLE AS r_preload, 'K-1' AS fork_type,
      CASE WHEN why IS NULL AND run % 19 <> 0 THEN n END AS total_laps, CASE WHEN why IS NULL THEN round(round(b) / 1000, 3) END AS best_lap_s, NULL::BIGINT AS lap_no, NULL::DOUBLE AS lap_time
    FROM rs UNION ALL
    SELECT run::VARCHAR, status, CASE WHEN bad IS NULL THEN 'lap' ELSE 'rejected cell' END, bad, rider_id, rider_num, 'FP', NULL, NULL, NULL, NULL, NULL, NULL, lap_no,
      CASE WHEN run % 4 <> 0 THEN round(round(t) / 1000, 3) END FROM lc)"""
SHOWN = ["sheet", "file", "kind", "reason", "rider", "rider_num", "session_type", "f_comp", "f_preload", "r_preload", "fork_type", "total_laps", "best_lap_s", "lap_no", "lap_time"]


@query(f"WITH {RESULTS} SELECT * FROM res")
def report_results(spark, d):
    """Every sheet, session and lap cell as one row, whether it could be used or not."""
    return reports.report_results(damaged_cells(spark, d)).select(*SHOWN)


@query(f"WITH {RESULTS} SELECT kind, file, count(*) AS n, count(reason) AS reasons FROM res GROUP BY ALL")
def report_outputs(spark, d):
    """All outputs written in one pass, a folder for each kind, and read back."""
    path = fresh_path(spark, "report-results")
    reports.store_results(reports.report_results(damaged_cells(spark, d)), path)
    back = spark.read.parquet(path)
    return back.groupBy("kind", "file").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("reasons"))


@query(f"WITH {RESULTS} SELECT sheet, session_type, lap_no, lap_time, rider_num FROM res WHERE kind = 'lap' AND sheet::BIGINT % 3 = 0")
def job_report_review(spark, d):
    """Laps of submitted report sheets: pending, decided on per sheet, and the approved ones added to what is stored, once."""
    results = reports.report_results(damaged_cells(spark, d))
    pending = reports.of_kind(results, "lap").select("sheet", "session_type", "lap_no", "lap_time", "rider_num").withColumn("status", F.lit("pending"))
    decisions = runs(spark, d).select(F.col("run").cast("string").alias("sheet"), "date", F.when(F.col("run") % 3 == 0, "approved").otherwise("rejected").alias("decision"))
    approved = hold(facts.review(pending, decisions, "sheet", "date").filter("status = 'approved'").drop("status"), "approved")
    stored = approved.filter("lap_no % 2 = 0")  # what an earlier review added
    return facts.insert_new(stored, approved.unionByName(approved), ["sheet", "session_type", "lap_no"], "lap_time")


@query("""SELECT o_custkey, CASE WHEN contains(o_custkey::VARCHAR, '77') THEN 77 WHEN contains(o_custkey::VARCHAR, '52') THEN 52 ELSE 0 END AS number,
    CASE o_custkey WHEN 77 THEN 'DA77' WHEN 52 THEN 'JA52' ELSE '#' || o_custkey END AS rider FROM (SELECT DISTINCT o_custkey FROM orders)""")
def rider_numbers(spark, d):
    """Numbers read from rider names, and riders from numbers."""
    o = table(spark, d, "orders").select("o_custkey").distinct()
    return o.select("o_custkey", rider_number(F.col("o_custkey").cast("string")).alias("number"), rider_of_number(F.col("o_custkey")).alias("rider"))
