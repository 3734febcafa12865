"""Facts merged from five sources and committed together, and keyed writes."""

from pyspark.sql import functions as F

from laplens.operators import merge
from laplens.plans.registry import LAPS, laps, query, r6, raw_laps, runs, table
from laplens.session import fresh_path, hold, release
from laplens.sources import keyed

FAR = 2_000_000_000


def fact_sources(spark, d):
    """The log creates runs, a report a few more; tyres, dynamics and lap times only add to known ones."""
    log = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderkey").alias("run_no"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("D"), F.year("o_orderdate").cast("string"))).alias("round"),
        F.col("o_orderstatus").alias("circuit"), F.col("o_orderpriority").alias("session"), F.col("o_custkey").cast("string").alias("rider"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("dry")).alias("weather"))
    report = log.filter("run % 5 = 0").select(
        F.when(F.col("run") % 50 == 0, F.col("run") + FAR).otherwise(F.col("run")).alias("run"), "run_no", F.lit("D1999").alias("round"), "circuit", "session", "rider", "date",
        F.lit("wet").alias("weather"), F.concat(F.lit("note "), F.col("run").cast("string")).alias("note"))
    line = table(spark, d, "lineitem")
    tyre = line.select(F.when(F.col("l_orderkey") % 60 == 0, F.col("l_orderkey") + FAR * 2).otherwise(F.col("l_orderkey")).alias("run"),
                       F.when(F.col("l_linenumber") > 1, F.col("l_partkey")).alias("tyre"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("place"))
    dyn = line.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("run")).agg(r6(F.avg("l_quantity")).alias("apex"), F.first(F.lit(1)).alias("place"))
    lap = raw_laps(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("total_laps"), F.min("t").alias("best_s"), r6(F.avg("t")).alias("avg_s"), F.first(F.lit(1)).alias("place"))
    first = lambda df: df.withColumn("place", F.lit(1))
    return [merge.Source(first(log), "place"), merge.Source(first(report), "place"), merge.Source(tyre, "place", False), merge.Source(dyn, "place", False),
            merge.Source(lap, "place", False)]


def committed(spark, d):
    """All four tables, committed together and read again."""
    root = fresh_path(spark, "facts")
    merged = hold(merge.merge_columns(fact_sources(spark, d), ["run"]), "merged")  # named_runs reads it twice
    keyed.commit_tables(spark, root, {"runs": merge.named_runs(merged, "run")})
    release(merged)
    keyed.commit_tables(spark, root, merge.fact_tables(keyed.read_committed(spark, root)["runs"], laps(spark, d).select("run", "lap_no", F.col("t").alias("lap_s"), "l_linenumber"), "run"))
    return keyed.read_committed(spark, root)


_TOK = lambda c: f"coalesce(nullif(regexp_replace(upper(trim({c})), '[^A-Z0-9]', '', 'g'), ''), 'UNK')"
MERGED = f"""lg AS (SELECT o_orderkey AS run, o_orderkey AS run_no, CASE WHEN o_orderkey % 3 <> 0 THEN 'D' || strftime(o_orderdate, '%Y') END AS round, o_orderstatus AS circuit,
    o_orderpriority AS session, o_custkey::VARCHAR AS rider, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 4 = 0 THEN 'dry' END AS weather FROM orders),
  rp AS (SELECT CASE WHEN run % 50 = 0 THEN run + {FAR} ELSE run END AS run, run_no, 'D1999' AS round, circuit, session, rider, date, 'wet' AS weather, 'note ' || run AS note FROM lg WHERE run % 5 = 0),
  bt AS (SELECT coalesce(lg.run, rp.run) AS run, coalesce(lg.run_no, rp.run_no) AS run_no, coalesce(lg.round, rp.round) AS round, coalesce(lg.circuit, rp.circuit) AS circuit,
    coalesce(lg.session, rp.session) AS session, coalesce(lg.rider, rp.rider) AS rider, coalesce(lg.date, rp.date) AS date, coalesce(lg.weather, rp.weather) AS weather, note
    FROM lg FULL JOIN rp ON lg.run = rp.run),
  ty AS (SELECT l_orderkey AS run, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) FILTER (l_linenumber > 1) AS tyre FROM lineitem WHERE l_orderkey % 60 <> 0 GROUP BY 1),
  dy AS (SELECT l_orderkey AS run, round(avg(l_quantity) + 1e-9, 6) AS apex FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
  lt AS (SELECT l_orderkey AS run, count(*) AS total_laps, min(l_extendedprice) AS best_s, round(avg(l_extendedprice) + 1e-9, 6) AS avg_s FROM lineitem GROUP BY 1),
  fl AS (SELECT circuit, session, rider, arg_min(round, run) AS fill FROM bt WHERE round IS NOT NULL GROUP BY ALL),
  mg AS (SELECT run, run_no, coalesce(round, fill, 'UNK') AS round, circuit, session, rider, date, weather, note, tyre, apex, total_laps, best_s, avg_s
    FROM bt LEFT JOIN ty USING (run) LEFT JOIN dy USING (run) LEFT JOIN lt USING (run) LEFT JOIN fl USING (circuit, session, rider)),
  rn AS (SELECT *, {_TOK('round')} || '_' || {_TOK('circuit')} AS event_id, {_TOK('round')} || '_' || {_TOK('circuit')} || '_' || {_TOK('session')} || '_' || {_TOK('rider')} AS session_id FROM mg),
  rs AS (SELECT *, session_id || '_R' || run_no AS run_id FROM rn)"""


@query(f"WITH {MERGED} SELECT * FROM rs")
def merged_runs(spark, d):
    return committed(spark, d)["runs"]


@query(f"""WITH {MERGED} SELECT session_id, event_id, round, circuit, session, rider, count(*) AS n_runs, coalesce(sum(total_laps), 0)::BIGINT AS total_laps, min(best_s) AS best_s,
    round(sum(avg_s * total_laps) / sum(total_laps) FILTER (avg_s IS NOT NULL) + 1e-9, 6) AS avg_s, min(date) AS date FROM rs GROUP BY ALL""")
def merged_sessions(spark, d):
    return committed(spark, d)["sessions"].withColumn("avg_s", r6("avg_s"))


@query(f"""WITH {MERGED} SELECT event_id, round, circuit, min(date) AS first_date, max(date) AS last_date, count(DISTINCT session_id) AS n_sessions, count(DISTINCT rider) AS n_riders
    FROM rs GROUP BY ALL""")
def merged_events(spark, d):
    return committed(spark, d)["events"]


@query(f"WITH {LAPS}, {MERGED} SELECT laps.run, lap_no, t AS lap_s, l_linenumber, run_id, session_id, run_id || '_L' || lap_no AS lap_id FROM laps JOIN rs USING (run)")
def merged_laps(spark, d):
    return committed(spark, d)["laps"]


@query("""WITH b AS (SELECT o_orderkey AS run, o_custkey AS rider, o_totalprice AS best FROM orders WHERE o_orderkey % 10 <> 3),
  n AS (SELECT o_orderkey AS run, o_custkey AS rider, o_totalprice + 1 AS best FROM orders WHERE o_orderkey % 100 IN (3, 4))
  SELECT * FROM n UNION ALL SELECT * FROM b WHERE run NOT IN (SELECT run FROM n)""")
def bucketed_upsert(spark, d):
    """A stored table takes in one row in fifty, twice; only their buckets are read and written."""
    path = fresh_path(spark, "keyed")
    own = runs(spark, d).select("run", "rider", "best").withColumn("at", F.lit(1))
    keyed.upsert_table(own.filter("run % 10 <> 3"), path, ["run"], "at")
    changes = own.filter("run % 100 IN (3, 4)").withColumn("best", F.col("best") + 1)
    for _ in range(2):
        keyed.upsert_table(changes, path, ["run"], "at")
    return keyed.read_keyed(spark, path).drop("at")
