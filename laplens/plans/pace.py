"""Queries over aggregates, ranks, sorts and statistics."""

from pyspark.sql import functions as F

from laplens.functions.measures import band
from laplens.functions.text import lap_text
from laplens.operators import pace, reshape
from laplens.operators.ordered import number, quantiles, with_group_stats
from laplens.operators.tags import dictionary_totals, distinct_text
from laplens.plans.registry import LAPS, RUNS, laps, query, r6, raw_laps, runs, table

# laps with the rider, session and status of their run
LR = LAPS + ", " + RUNS + """, lr AS (SELECT laps.*, rider, session, status, date, best FROM laps JOIN runs USING (run))"""


def lap_runs(spark, d, numbered=False):
    base = laps(spark, d) if numbered else raw_laps(spark, d)
    return base.join(runs(spark, d), "run")


@query("SELECT source AS tag, lang, count(*) AS n FROM documents GROUP BY ALL")
def count_by_keys(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("tag"), "lang")
    return docs.filter("tag is not null and lang is not null").groupBy("tag", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {LR} SELECT session, status, min(t) AS best FROM lr WHERE valid GROUP BY ALL")
def best_by_group(spark, d):
    return lap_runs(spark, d).filter("valid").groupBy("session", "status").agg(F.min("t").alias("best"))


@query(f"""WITH {LR} SELECT run, min(t) AS best, round(avg(t) + 1e-9, 6) AS mean, count(*) AS laps,
  array_to_string(list_sort(list_distinct(list(l_linestatus))), ', ') AS sessions FROM lr GROUP BY run""")
def run_lap_stats(spark, d):
    a = raw_laps(spark, d).groupBy("run").agg(F.min("t").alias("best"), r6(F.avg("t")).alias("mean"), F.count("*").alias("laps"),
                                             F.array_join(F.array_sort(F.collect_set("l_linestatus")), ", ").alias("sessions"))
    return a


@query(f"""WITH {LR}, a AS (SELECT session, rider, min(t) AS best, round(avg(t) + 1e-9, 6) AS mean, max(t) AS worst, count(*) AS laps FROM lr GROUP BY ALL)
  SELECT *, round(best - min(best) OVER (PARTITION BY session) + 1e-9, 6) AS gap FROM a""")
def rider_lap_stats(spark, d):
    a = lap_runs(spark, d).groupBy("session", "rider").agg(F.min("t").alias("best"), r6(F.avg("t")).alias("mean"),
                                                          F.max("t").alias("worst"), F.count("*").alias("laps"))
    return with_group_stats(a, ["session"], F.min("best").alias("_b")).withColumn("gap", r6(F.col("best") - F.col("_b"))).drop("_b")


METRICS = f"""{LR}, sm AS (SELECT session, rider, min(t) AS best, avg(t) AS mean, stddev_pop(t) AS sigma, count(*) AS laps FROM lr WHERE valid GROUP BY ALL),
  sg AS (SELECT *, best - min(best) OVER (PARTITION BY session) AS p1_gap, mean - best AS avg_delta FROM sm)"""
SM_COLS = ["best", "mean", "sigma", "p1_gap", "avg_delta"]


def metrics(spark, d):
    return pace.session_metrics(lap_runs(spark, d).filter("valid"), ["session"], ["rider"], "t")


@query(f"WITH {METRICS} SELECT session, rider, laps, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in SM_COLS)} FROM sg")
def session_metrics(spark, d):
    return metrics(spark, d).select("session", "rider", "laps", *[r6(c).alias(c) for c in SM_COLS])


TIE = ["run", "lap_no"]


@query(f"""WITH {LR}, p AS (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY t, run, lap_no) AS rn, count(*) OVER (PARTITION BY rider) AS n FROM lr WHERE valid)
  SELECT rider, min(t) AS best, round(avg(t) FILTER (rn <= greatest(1, n // 3)) + 1e-9, 6) AS race_pace, round(avg(t) + 1e-9, 6) AS mean, count(*) AS laps FROM p GROUP BY rider""")
def race_pace_top_third(spark, d):
    out = pace.top_third_pace(lap_runs(spark, d, True).filter("valid"), ["rider"], "t", TIE)
    return out.select("rider", "best", r6("race_pace").alias("race_pace"), r6("mean").alias("mean"), "laps")


@query(f"WITH {LR} SELECT count(DISTINCT rider) AS riders, count(DISTINCT session) AS sessions, count(DISTINCT run) AS runs FROM lr")
def distinct_counts(spark, d):
    return lap_runs(spark, d).agg(F.countDistinct("rider").alias("riders"), F.countDistinct("session").alias("sessions"),
                                  F.countDistinct("run").alias("runs"))


@query(f"""WITH {LR} SELECT rider, string_agg(DISTINCT session, ', ' ORDER BY session) AS members, count(DISTINCT session) AS n_members FROM lr GROUP BY rider""")
def distinct_set_text(spark, d):
    return distinct_text(lap_runs(spark, d), ["rider"], "session")


@query(f"WITH {LR} SELECT rider, status, round(avg(l_quantity) + 1e-9, 6) AS front, round(avg(l_discount) + 1e-9, 6) AS rear FROM lr GROUP BY ALL")
def mean_two_measures(spark, d):
    return lap_runs(spark, d).groupBy("rider", "status").agg(r6(F.avg("l_quantity")).alias("front"), r6(F.avg("l_discount")).alias("rear"))


TIERS = f"""{RUNS}, rn AS (SELECT *, row_number() OVER g AS rank, count(*) OVER (PARTITION BY rider, status) AS rank_total,
    best - min(best) OVER (PARTITION BY rider, status) AS gap_to_best FROM runs WINDOW g AS (PARTITION BY rider, status ORDER BY best, run)),
  ti AS (SELECT *, CASE WHEN rank_total < 3 THEN CASE WHEN rank = 1 THEN 'FAST' ELSE 'SLOW' END
    WHEN (rank - 1) / greatest(rank_total - 1, 1) <= 0.33 THEN 'FAST' WHEN (rank - 1) / greatest(rank_total - 1, 1) >= 0.67 THEN 'SLOW' ELSE 'MED' END AS tier FROM rn)"""


def tiered(spark, d):
    return pace.ranked(runs(spark, d), ["rider", "status"], "best", ["run"])


@query(f"""WITH {TIERS} SELECT rider, status, run, rank, rank_total, rank || '/' || rank_total AS rank_text, round(gap_to_best, 3) AS gap_to_best FROM ti""")
def rank_and_gap(spark, d):
    return tiered(spark, d).select("rider", "status", "run", "rank", "rank_total",
                                   F.concat_ws("/", F.col("rank").cast("string"), F.col("rank_total").cast("string")).alias("rank_text"),
                                   F.round("gap_to_best", 3).alias("gap_to_best"))


@query(f"WITH {TIERS} SELECT rider, status, run, tier FROM ti")
def tiers(spark, d):
    return tiered(spark, d).select("rider", "status", "run", "tier")


FAST = f"""{TIERS}, m AS (SELECT l_orderkey AS run, avg(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1),
  fs AS (SELECT rider, status, count(*) AS n_rows, avg(qty) FILTER (tier = 'FAST') AS fast_qty, avg(qty) FILTER (tier = 'SLOW') AS slow_qty, avg(qty) AS all_qty,
    avg(disc) FILTER (tier = 'FAST') AS fast_disc, avg(disc) FILTER (tier = 'SLOW') AS slow_disc, avg(disc) AS all_disc FROM ti JOIN m USING (run) GROUP BY ALL),
  fd AS (SELECT *, fast_qty - slow_qty AS d_qty, fast_disc - slow_disc AS d_disc FROM fs)"""
FD_COLS = [f"{k}_{m}" for m in ("qty", "disc") for k in ("fast", "slow", "all", "d")]


def run_means(spark, d):
    return raw_laps(spark, d).groupBy("run").agg(F.avg("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"))


@query(f"WITH {FAST} SELECT rider, status, n_rows, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in FD_COLS)} FROM fd")
def fast_slow_means(spark, d):
    out = pace.tier_means(tiered(spark, d).join(run_means(spark, d), "run"), ["rider", "status"], ["qty", "disc"])
    return out.select("rider", "status", "n_rows", *[r6(c).alias(c) for c in FD_COLS])


@query(f"""WITH {LAPS} SELECT run, count(*) AS corners, round(avg(l_quantity) + 1e-9, 6) AS ph_in, round(avg(l_discount) + 1e-9, 6) AS ph_out, min(t) AS speed_min FROM laps GROUP BY run""")
def per_lap_summary(spark, d):
    return raw_laps(spark, d).groupBy("run").agg(F.count("*").alias("corners"), r6(F.avg("l_quantity")).alias("ph_in"),
                                                r6(F.avg("l_discount")).alias("ph_out"), F.min("t").alias("speed_min"))


@query(f"""WITH {LR}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY best, run) AS rn, count(*) OVER (PARTITION BY session) AS n FROM runs),
  th AS (SELECT run, session, rn <= greatest(1, n // 3) AS fast, rn > n - greatest(1, n // 3) AS slow FROM r),
  x AS (SELECT session, l_linenumber, phase, avg(v) FILTER (fast) AS f, avg(v) FILTER (slow) AS s FROM (
    SELECT th.session, l_linenumber, fast, slow, 'qty' AS phase, l_quantity AS v FROM lineitem JOIN th ON l_orderkey = run
    UNION ALL SELECT th.session, l_linenumber, fast, slow, 'price', l_extendedprice FROM lineitem JOIN th ON l_orderkey = run) GROUP BY ALL)
  SELECT session, l_linenumber, phase, round(s - f + 1e-9, 6) AS delta FROM x WHERE f IS NOT NULL AND s IS NOT NULL""")
def phase_fast_slow_delta(spark, d):
    th = pace.thirds(runs(spark, d), ["session"], "best", ["run"]).select("run", "session", "is_fast", "is_slow")
    j = raw_laps(spark, d).select("run", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("t").alias("price")).join(th, "run")
    aggs = [F.avg(F.when(F.col(f"is_{k}"), F.col(c))).alias(f"{k}_{c}") for c in ("qty", "price") for k in ("fast", "slow")]
    g = j.groupBy("session", "l_linenumber").agg(*aggs)
    gaps = g.select("session", "l_linenumber", *[(F.col(f"slow_{c}") - F.col(f"fast_{c}")).alias(c) for c in ("qty", "price")])
    return reshape.measures_long(gaps, ["session", "l_linenumber"], ["qty", "price"], "phase", "delta").withColumn("delta", r6("delta"))


@query(f"""WITH {LR}, m AS (SELECT session, rider, avg(t) AS mean FROM lr GROUP BY ALL) SELECT session, round(min(mean) + 1e-9, 6) AS best_mean FROM m GROUP BY session""")
def best_rider_mean(spark, d):
    return lap_runs(spark, d).groupBy("session", "rider").agg(F.avg("t").alias("mean")).groupBy("session").agg(r6(F.min("mean")).alias("best_mean"))


QS = {"p02": 0.02, "q1": 0.25, "median": 0.5, "q3": 0.75, "p98": 0.98}


@query(f"WITH {LR} SELECT session, {', '.join(f'round(quantile_cont(t, {q}) + 1e-9, 6) AS {n}' for n, q in QS.items())} FROM lr GROUP BY session")
def quantile_bands(spark, d):
    return quantiles(lap_runs(spark, d).select("session", "t"), ["session"], "t", QS).select("session", *[r6(n).alias(n) for n in QS])


@query(f"""WITH {LR} SELECT run, round(avg(t) FILTER (l_quantity > 25) + 1e-9, 6) AS mean_with, count(*) FILTER (l_quantity > 25) AS laps_with FROM lr GROUP BY run""")
def conditional_means(spark, d):
    hit = F.col("l_quantity") > 25
    return raw_laps(spark, d).groupBy("run").agg(r6(F.avg(F.when(hit, F.col("t")))).alias("mean_with"), F.count_if(hit).alias("laps_with"))


@query(f"""WITH {LR} SELECT rider, count(*) AS laps, round(avg(l_quantity) + 1e-9, 6) AS mean_apex, round(avg(l_discount) + 1e-9, 6) AS mean_brake, round(avg(t) + 1e-9, 6) AS mean_t FROM lr GROUP BY rider""")
def rider_summary(spark, d):
    return lap_runs(spark, d).groupBy("rider").agg(F.count("*").alias("laps"), r6(F.avg("l_quantity")).alias("mean_apex"),
                                                  r6(F.avg("l_discount")).alias("mean_brake"), r6(F.avg("t")).alias("mean_t"))


@query("SELECT strftime(min(o_orderdate), '%b %Y') AS first_month, strftime(max(o_orderdate), '%b %Y') AS last_month FROM orders")
def date_span(spark, d):
    return table(spark, d, "orders").agg(F.date_format(F.min("o_orderdate"), "MMM yyyy").alias("first_month"),
                                         F.date_format(F.max("o_orderdate"), "MMM yyyy").alias("last_month"))


@query("""SELECT count(*) AS sessions, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS urgent_open,
  count(DISTINCT o_custkey) AS riders FROM orders""")
def kpi_row(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").agg(F.count("*").alias("sessions"), F.count_if(s == "F").alias("finished"),
                                         F.count_if((p == "1-URGENT") & (s == "O")).alias("urgent_open"), F.countDistinct("o_custkey").alias("riders"))


@query("""SELECT l_orderkey AS run, arg_min(l_extendedprice, (l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_returnflag = 'R') AS first_t
  FROM lineitem GROUP BY 1""")
def first_non_null(spark, d):
    at = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return raw_laps(spark, d).groupBy("run").agg(F.min_by("t", F.when(~F.col("valid"), at)).alias("first_t"))


@query("""WITH dict AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS tag FROM part UNION SELECT 'unused'),
  t AS (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part JOIN lineitem ON l_partkey = p_partkey)
  SELECT dict.tag, count(t.tag) AS n FROM dict LEFT JOIN t ON dict.tag = t.tag GROUP BY 1""")
def dictionary_tag_totals(spark, d):
    p, li = table(spark, d, "part"), table(spark, d, "lineitem").select("l_partkey")
    words = p.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tag")).distinct()
    dictionary = words.union(spark.createDataFrame([("unused",)], "tag string")).distinct()
    # use counts per part first, so the tags are exploded once per part and not per line
    used = li.groupBy("l_partkey").agg(F.count("*").alias("uses")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    n = used.select(F.explode(F.split("p_name", " ")).alias("tag"), "uses").groupBy("tag").agg(F.sum("uses").alias("n"))
    return dictionary.join(n, "tag", "left").na.fill(0, ["n"])


@query("""WITH dict AS (SELECT DISTINCT 'src' || (o_custkey % 30) AS tag FROM orders), t AS (SELECT source AS tag FROM documents)
  SELECT dict.tag, count(t.tag) AS n FROM dict LEFT JOIN t USING (tag) GROUP BY 1""")
def zero_filled_totals(spark, d):
    dictionary = table(spark, d, "orders").select(F.concat(F.lit("src"), (F.col("o_custkey") % 30).cast("string")).alias("tag")).distinct()
    return dictionary_totals(table(spark, d, "documents").select(F.col("source").alias("tag")), "tag", dictionary)


@query(f"WITH {RUNS} SELECT rider, count(DISTINCT (session, status)) AS active FROM runs WHERE best > 100000 GROUP BY rider")
def active_sessions(spark, d):
    return runs(spark, d).filter("best > 100000").groupBy("rider").agg(F.countDistinct("session", "status").alias("active"))


CHANGES = f"""{RUNS}, pv AS (SELECT *, lag(run) OVER w AS pr, lag(session) OVER w AS ps, lag(status) OVER w AS pst FROM runs
  WINDOW w AS (PARTITION BY rider ORDER BY date, run)),
  cf AS (SELECT rider, run, pr IS NOT NULL AND session IS DISTINCT FROM ps AS session_changed, pr IS NOT NULL AND status IS DISTINCT FROM pst AS status_changed FROM pv)"""


def changes(spark, d):
    return pace.change_flags(runs(spark, d), ["rider"], [F.col("date"), F.col("run")], ["session", "status"])


@query(f"WITH {CHANGES} SELECT rider, sum(session_changed::INT + status_changed::INT)::BIGINT AS n_changes FROM cf GROUP BY rider")
def change_count(spark, d):
    return changes(spark, d).groupBy("rider").agg(F.sum("n_changes").alias("n_changes"))


@query(f"WITH {CHANGES} SELECT * FROM cf")
def change_flags(spark, d):
    return changes(spark, d).select("rider", "run", "session_changed", "status_changed")


@query(f"WITH {LR} SELECT run, lap_no, round(t - min(t) OVER (PARTITION BY session) + 1e-9, 6) AS gap FROM lr")
def gap_to_session_best(spark, d):
    return pace.gap_to_best(lap_runs(spark, d, True), ["session"], "t").select("run", "lap_no", r6("gap").alias("gap"))


@query(f"""WITH {METRICS}, l AS (SELECT *, best - lag(best) OVER w AS d_best, sigma - lag(sigma) OVER w AS d_sigma FROM sg WINDOW w AS (PARTITION BY rider ORDER BY session))
  SELECT rider, session, round(d_best + 1e-9, 6) AS d_best, CASE WHEN d_best < -0.1 THEN 'green' WHEN d_best > 0.1 THEN 'red' ELSE 'yellow' END AS best_light,
    round(d_sigma + 1e-9, 6) AS d_sigma, CASE WHEN d_sigma < -0.1 THEN 'green' WHEN d_sigma > 0.1 THEN 'red' ELSE 'yellow' END AS sigma_light FROM l WHERE d_best IS NOT NULL""")
def session_delta(spark, d):
    out = pace.step_changes(metrics(spark, d), ["rider"], [F.col("session")], ["best", "sigma"])
    return out.select("rider", "session", r6("d_best").alias("d_best"), "best_light", r6("d_sigma").alias("d_sigma"), "sigma_light")


@query(f"""WITH {LR}, p AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t, run, lap_no) AS rn, count(*) OVER (PARTITION BY session) AS n FROM lr)
  SELECT run, lap_no, rn <= greatest(1, n // 3) AS is_fast, rn > n - greatest(1, n // 3) AS is_slow FROM p""")
def thirds(spark, d):
    laps_of = lap_runs(spark, d, True).select("session", "t", *TIE)  # groups too big for a window are written and moved, so with nothing else
    return pace.thirds(laps_of, ["session"], "t", TIE).select("run", "lap_no", "is_fast", "is_slow")


@query(f"WITH {LAPS} SELECT run, lap_no, abs(t - min(t) OVER (PARTITION BY run)) < 0.002 AS is_best FROM laps")
def best_flag(spark, d):
    return pace.best_flags(laps(spark, d), ["run"], "t").select("run", "lap_no", "is_best")


@query(f"""WITH {LAPS} SELECT run, lap_no, row_number() OVER (ORDER BY t, run, lap_no) AS position FROM laps""")
def row_numbers(spark, d):
    return number(laps(spark, d), [], [F.col("t"), F.col("run"), F.col("lap_no")], "position").select("run", "lap_no", "position")


# --- sorts and limits, shown as explicit positions -------------------------------------------------


@query(f"WITH {RUNS} SELECT run, row_number() OVER (ORDER BY coalesce(nullif(status, 'P'), ''), session, rider, run) AS position FROM runs")
def total_order(spark, d):
    keyed = runs(spark, d).withColumn("s", F.coalesce(F.nullif("status", F.lit("P")), F.lit("")))
    return number(keyed, [], [F.col(c) for c in ("s", "session", "rider", "run")], "position").select("run", "position")


@query(f"""WITH {RUNS}, o AS (SELECT *, CASE session WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 3 ELSE 99 END AS ord FROM runs)
  SELECT run, ord, row_number() OVER (PARTITION BY rider ORDER BY ord, run) AS position FROM o""")
def custom_order(spark, d):
    o = runs(spark, d).withColumn("ord", pace.custom_position(F.col("session"), ["3-MEDIUM", "1-URGENT", "5-LOW"]).cast("int"))
    return number(o, ["rider"], [F.col("ord"), F.col("run")], "position").select("run", "ord", "position")


@query(f"WITH {RUNS} SELECT run, best, row_number() OVER (ORDER BY best DESC, run) AS position FROM runs ORDER BY best DESC, run LIMIT 15")
def top_k(spark, d):
    return pace.top_rows(runs(spark, d).select("run", "best"), [F.col("best").desc(), F.col("run")], 15)


@query(f"WITH {RUNS} SELECT run, status = 'F' AS pinned, row_number() OVER (PARTITION BY rider ORDER BY status = 'F' DESC, best, run) AS position FROM runs")
def pinned_first(spark, d):
    p = runs(spark, d).withColumn("pinned", F.col("status") == "F")
    return number(p, ["rider"], [F.col("pinned").desc(), F.col("best"), F.col("run")], "position").select("run", "pinned", "position")


@query(f"""WITH {RUNS}, x AS (SELECT run, rider, CASE WHEN run % 3 <> 0 THEN best END AS b FROM runs)
  SELECT run, row_number() OVER (PARTITION BY rider ORDER BY b ASC NULLS LAST, run) AS up, row_number() OVER (PARTITION BY rider ORDER BY b DESC NULLS LAST, run) AS down FROM x""")
def nulls_last(spark, d):
    x = runs(spark, d).select("run", "rider", F.when(F.col("run") % 3 != 0, F.col("best")).alias("b"))
    x = number(x, ["rider"], [F.asc_nulls_last("b"), F.col("run")], "up")
    return number(x, ["rider"], [F.desc_nulls_last("b"), F.col("run")], "down").select("run", "up", "down")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT *, (sum(n) OVER (PARTITION BY source))::BIGINT AS total FROM c)
  SELECT source, lang, n, total, row_number() OVER (ORDER BY total DESC, source, n DESC, lang) AS position FROM t""")
def order_by_group_total(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    t = with_group_stats(c, ["source"], F.sum("n").alias("total"))
    return number(t, [], [F.col("total").desc(), F.col("source"), F.col("n").desc(), F.col("lang")], "position")


# --- statistics -----------------------------------------------------------------------------------

PART_LINES = """pl AS (SELECT o_custkey AS rider, p_size::DOUBLE AS p_size, CASE WHEN p_size > 5 THEN p_retailprice END AS p_retailprice, l_discount, l_extendedprice AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def part_lines(spark, d):
    li, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("rider"), F.col("p_size").cast("double").alias("p_size"),
                    F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("p_retailprice"), "l_discount", F.col("l_extendedprice").alias("t"))


@query(f"WITH {PART_LINES} " + " UNION ALL ".join(
    f"SELECT '{p}' AS param, round(corr({p}, t) + 1e-9, 6) AS r, count({p}) AS n FROM pl" for p in ("p_size", "p_retailprice", "l_discount")))
def pairwise_corr(spark, d):
    return reshape.correlations(part_lines(spark, d), ["p_size", "p_retailprice", "l_discount"], "t") \
        .select("param", r6("r").alias("r"), "n")


@query(f"WITH {PART_LINES} SELECT rider, round(regr_slope(t, l_discount), 3) AS slope, round(regr_intercept(t, l_discount), 3) AS intercept, "
       "round(regr_r2(t, l_discount) + 1e-9, 6) AS r2, regr_count(t, l_discount)::BIGINT AS n FROM pl GROUP BY rider")
def ols_by_rider(spark, d):
    out = reshape.fitted_lines(part_lines(spark, d), ["rider"], "l_discount", "t")
    return out.select("rider", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), r6("r2").alias("r2"), "n")


@query(f"WITH {LAPS} SELECT run, round(stddev_pop(t) + 1e-9, 6) AS sigma, count(*) AS n FROM laps GROUP BY run")
def population_sigma(spark, d):
    return raw_laps(spark, d).groupBy("run").agg(r6(F.stddev_pop("t")).alias("sigma"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_partkey, min(l_extendedprice) AS best FROM lineitem GROUP BY 1), x AS (SELECT p_partkey, p_brand, p_size, best FROM part JOIN b ON p_partkey = l_partkey),
  g AS (SELECT p_brand FROM x GROUP BY 1 HAVING count(best) >= 2) SELECT x.* FROM x WHERE p_brand IN (SELECT p_brand FROM g)""")
def param_points(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("best"))
    x = table(spark, d, "part").select("p_partkey", "p_brand", "p_size").join(b, "p_partkey")
    return pace.supported(x, ["p_brand"], "best", 2)


@query(f"""WITH {METRICS} SELECT session, rider, CASE WHEN p1_gap <= 0 THEN 'best' WHEN p1_gap < 5000 THEN 'near' ELSE 'far' END AS gap_band,
  CASE WHEN sigma < 15000 THEN 'steady' WHEN sigma < 25000 THEN 'mixed' ELSE 'loose' END AS sigma_band FROM sg""")
def bands(spark, d):
    m = metrics(spark, d)
    return m.select("session", "rider", band(F.col("p1_gap"), [(0, "best"), (5000, "near")], "far", inclusive_first=True).alias("gap_band"),
                    band(F.col("sigma"), [(15000, "steady"), (25000, "mixed")], "loose").alias("sigma_band"))


def flagship(spark, d):
    """Pace table per session and rider: valid laps within 107 %, spread, rank, gap and tier."""
    j = lap_runs(spark, d).filter("valid")
    m = pace.session_metrics(pace.within_share(j, ["session"], "t", 40.0), ["session"], ["rider"], "t")
    out = pace.ranked(m, ["session"], "best", ["rider"])
    return out.select("session", "rider", "laps", "best", lap_text(F.round("best") / 1000).alias("best_text"), r6("mean").alias("mean"),
                      r6("sigma").alias("sigma"), r6("gap_to_best").alias("gap_to_best"), "rank", "rank_total", "tier")


FLAG_SQL = f"""WITH {LR}, k AS (SELECT *, min(t) OVER (PARTITION BY session) AS m FROM lr WHERE valid),
  a AS (SELECT session, rider, count(*) AS laps, min(t) AS best, avg(t) AS mean, stddev_pop(t) AS sigma FROM k WHERE t <= m * 40.0 GROUP BY ALL),
  b AS (SELECT *, best - min(best) OVER (PARTITION BY session) AS gap_to_best, row_number() OVER (PARTITION BY session ORDER BY best, rider) AS rank,
    count(*) OVER (PARTITION BY session) AS rank_total FROM a)
  SELECT session, rider, laps, best, (round(best)::BIGINT // 60000) || ':' || lpad(((round(best)::BIGINT % 60000) // 1000)::VARCHAR, 2, '0') || '.'
    || lpad((round(best)::BIGINT % 1000)::VARCHAR, 3, '0') AS best_text, round(mean + 1e-9, 6) AS mean, round(sigma + 1e-9, 6) AS sigma, round(gap_to_best + 1e-9, 6) AS gap_to_best,
    rank, rank_total, CASE WHEN rank_total < 3 THEN CASE WHEN rank = 1 THEN 'FAST' ELSE 'SLOW' END WHEN (rank - 1) / greatest(rank_total - 1, 1) <= 0.33 THEN 'FAST'
    WHEN (rank - 1) / greatest(rank_total - 1, 1) >= 0.67 THEN 'SLOW' ELSE 'MED' END AS tier FROM b"""


@query(FLAG_SQL)
def pace_table(spark, d):
    return flagship(spark, d)


