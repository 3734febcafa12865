"""Queries over filters and predicates."""

from pyspark.sql import functions as F

from laplens.functions.measures import in_range
from laplens.operators import pace
from laplens.plans.registry import LAPS, RUNS, EV, laps, query, r6, raw_laps, runs, samples, table


@query(f"WITH {LAPS} SELECT run, lap_no, t FROM laps WHERE lap_no > 1 AND t BETWEEN 10000 AND 60000")
def valid_lap_filter(spark, d):
    return pace.usable_laps(laps(spark, d), "t", F.col("lap_no") == 1, 10_000, 60_000).select("run", "lap_no", "t")


@query("""SELECT l_orderkey AS run, count(*) AS n, round(sum(l_extendedprice) + 1e-9, 6) AS total FROM lineitem GROUP BY l_orderkey
  HAVING count(*) >= 4 AND sum(l_extendedprice) >= 60000""")
def min_duration_filter(spark, d):
    g = raw_laps(spark, d).groupBy("run").agg(F.count("*").alias("n"), r6(F.sum("t")).alias("total"))
    return g.filter((F.col("n") >= 4) & (F.col("total") >= 60_000))


@query("""SELECT l_orderkey AS run, l_linenumber, l_extendedprice AS t FROM lineitem WHERE l_returnflag <> 'R'""")
def valid_flag_filter(spark, d):
    flag = F.when(F.col("valid"), "1").otherwise("0")
    return pace.flagged_valid(raw_laps(spark, d), flag).select("run", "l_linenumber", "t")


@query("""WITH x AS (SELECT l_orderkey AS run, l_linenumber, l_extendedprice AS t, o_custkey AS rider,
    min(l_extendedprice) OVER (PARTITION BY o_custkey) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT rider, run, l_linenumber, t FROM x WHERE t <= 1.07 * m""")
def within_107_percent(spark, d):
    j = raw_laps(spark, d).select("run", "l_linenumber", "t").join(runs(spark, d).select("run", "rider"), "run")
    return pace.within_share(j, ["rider"], "t").select("rider", "run", "l_linenumber", "t")


@query(f"""WITH {RUNS} SELECT * FROM runs WHERE session IN ('1-URGENT', '3-MEDIUM') AND status IN ('F', 'O')""")
def multi_in_filter(spark, d):
    return runs(spark, d).filter(F.col("session").isin("1-URGENT", "3-MEDIUM") & F.col("status").isin("F", "O"))


@query("SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment) = upper('Machinery')")
def case_insensitive_match(spark, d):
    return table(spark, d, "customer").filter(F.upper("c_mktsegment") == F.upper(F.lit("Machinery"))).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def semi_join_filter(spark, d):
    rich = table(spark, d, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
  (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7')""")
def rider_scope_filter(spark, d):
    scope = table(spark, d, "customer").join(
        table(spark, d, "nation").filter("n_name = 'NATION_7'"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(scope.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi") \
        .select("o_orderkey", "o_custkey")


@query(f"""WITH {RUNS}, top AS (SELECT session, status FROM runs ORDER BY date DESC, session DESC, status DESC LIMIT 1)
  SELECT runs.* FROM runs JOIN top USING (session, status)""")
def latest_event_rows(spark, d):
    return pace.latest_rows(runs(spark, d), "date", ["session", "status"])


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 30 THEN p_size END AS size_ok,
  CASE WHEN p_retailprice BETWEEN 950 AND 1100 THEN p_retailprice END AS price_ok FROM part""")
def range_gate(spark, d):
    return table(spark, d, "part").select("p_partkey", in_range(F.col("p_size"), 10, 30).alias("size_ok"),
                                          in_range(F.col("p_retailprice"), 950, 1100).alias("price_ok"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def drop_null_keys(spark, d):
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return c.select("c_custkey", "c_mktsegment").na.drop(subset=["c_mktsegment"]).na.drop("all")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'BOLT') OR starts_with(p_name, 'red')""")
def substring_search(spark, d):
    return table(spark, d, "part").filter(F.contains(F.upper("p_name"), F.lit("BOLT")) | F.col("p_name").startswith("red")) \
        .select("p_partkey", "p_name")


@query("""SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND p_type <> 'PROMO'""")
def required_keys_present(spark, d):
    p = table(spark, d, "part").withColumns({
        "k1": F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_brand")),
        "k2": F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(F.col("p_type"))})
    ok = F.lit(True)
    for k in ("k1", "k2"):
        ok = ok & (F.coalesce(F.trim(k), F.lit("")) != "")
    return p.filter(ok).select("p_partkey")


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS cancelled FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'R') > 0""")
def flagged_rows(spark, d):
    races = runs(spark, d).filter("status = 'F'").select("run")
    g = raw_laps(spark, d).join(races, "run", "left_semi").groupBy(F.col("run").alias("l_orderkey")) \
        .agg(F.count_if(~F.col("valid")).alias("cancelled"))
    return g.filter("cancelled > 0")


@query(f"""WITH {EV} SELECT run, count(*) AS n FROM ev GROUP BY run
  HAVING count(DISTINCT channel) FILTER (channel IN ('view', 'click', 'error')) = 3""")
def complete_channel_runs(spark, d):
    need = ["view", "click", "error"]
    g = samples(spark, d).groupBy("run").agg(F.count("*").alias("n"), *[
        F.max(F.col("channel") == c).alias(c) for c in need])
    return g.filter(F.col("view") & F.col("click") & F.col("error")).select("run", "n")


@query(f"""WITH {EV}, a AS (SELECT DISTINCT run, upper(channel) AS c FROM ev WHERE value > 60),
  p AS (SELECT run, c, CASE c WHEN 'PURCHASE' THEN 0 WHEN 'SIGNUP' THEN 1 ELSE CASE WHEN c LIKE '%E%' THEN 1000 END END AS pos FROM a)
  SELECT run, arg_min(c, (pos, c)) AS resolved FROM p WHERE pos IS NOT NULL GROUP BY run""")
def resolve_channel_alias(spark, d):
    c = F.upper("channel")
    order = F.when(c == "PURCHASE", 0).when(c == "SIGNUP", 1).when(c.contains("E"), 1000)
    ev = samples(spark, d).filter("value > 60").withColumns({"c": c, "pos": order}).filter("pos is not null")
    return ev.groupBy("run").agg(F.min_by("c", F.struct("pos", "c")).alias("resolved"))


@query(f"""WITH {RUNS}, g AS (SELECT rider FROM runs GROUP BY rider HAVING count(*) >= 12)
  SELECT rider, run, best FROM runs WHERE rider IN (SELECT rider FROM g)""")
def minimum_support(spark, d):
    return pace.supported(runs(spark, d).select("rider", "run", "best"), ["rider"], "best", 12)


