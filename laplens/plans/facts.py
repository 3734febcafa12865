"""Queries over joins, fact building, de-duplication and keyed writes."""

from pyspark.sql import functions as F

from laplens.functions.measures import delta_mark, delta_text
from laplens.operators import facts
from laplens.operators.ordered import after, keep_one, neighbours
from laplens.plans.registry import LAPS, RUNS, laps, query, r6, raw_laps, runs, table


@query(f"WITH {LAPS}, {RUNS} SELECT run, rider, session, lap_no, t FROM laps JOIN runs USING (run) WHERE status = 'F' AND lap_no >= 2")
def runs_join_laps(spark, d):
    return runs(spark, d).filter("status = 'F'").join(laps(spark, d).filter("lap_no >= 2"), "run") \
        .select("run", "rider", "session", "lap_no", "t")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'D' || strftime(o_orderdate, '%Y%m') END AS round,
    CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS session FROM orders),
  f AS (SELECT o_custkey, upper(o_orderstatus) AS st, upper(session) AS se, arg_min(round, o_orderkey) AS fill FROM o WHERE round <> '' GROUP BY ALL)
  SELECT o_orderkey, coalesce(nullif(round, ''), fill, 'UNK') AS round FROM o LEFT JOIN f ON o.o_custkey = f.o_custkey
    AND upper(o.o_orderstatus) = st AND upper(o.session) = se""")
def fill_from_first_match(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("D"), F.date_format("o_orderdate", "yyyyMM"))).alias("round"),
        F.when(k % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("session"))
    out = facts.fill_from_first(o, o, ["o_custkey", "o_orderstatus", "session"], "round", "o_orderkey")
    return out.select("o_orderkey", "round")


@query("""WITH log AS (SELECT o_orderkey AS run, o_orderstatus AS status, o_totalprice AS load FROM orders WHERE o_orderkey % 10 < 8),
  dyn AS (SELECT l_orderkey AS run, round(avg(l_extendedprice) + 1e-9, 6) AS dyn_mean, count(*) AS dyn_rows FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
  tyre AS (SELECT l_orderkey AS run, max(l_quantity) AS tyre_max, round(sum(l_discount) + 1e-9, 6) AS load FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
  perf AS (SELECT o_orderkey AS run, o_orderpriority AS perf_tier FROM orders WHERE o_orderkey % 2 = 0)
  SELECT run, status, CASE WHEN tyre.run IS NOT NULL THEN tyre.load ELSE log.load END AS load, dyn_mean, dyn_rows, tyre_max, perf_tier
  FROM log FULL JOIN dyn USING (run) FULL JOIN tyre USING (run) LEFT JOIN perf USING (run)""")
def build_run_fact(spark, d):
    o, li = table(spark, d, "orders"), raw_laps(spark, d)
    log = o.filter("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"),
                                                F.col("o_totalprice").alias("load"))
    dyn = li.filter("l_linestatus = 'F'").groupBy("run").agg(r6(F.avg("t")).alias("dyn_mean"), F.count("*").alias("dyn_rows"))
    tyre = li.filter(~F.col("valid")).groupBy("run").agg(F.max("l_quantity").alias("tyre_max"), r6(F.sum("l_discount")).alias("load"))
    perf = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("perf_tier"))
    return facts.merge_facts(log, "run", [dyn, tyre], [perf])


@query("""WITH s AS (SELECT l_orderkey AS run, min(l_extendedprice) AS best, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
  st AS (SELECT o_custkey AS rider, o_orderstatus AS circuit, o_orderdate AS dt, o_orderkey AS run, best, n FROM s JOIN orders ON run = o_orderkey),
  dy AS (SELECT o_custkey AS rider, o_orderstatus AS circuit, o_orderdate AS dt, o_orderkey AS run, o_totalprice AS load FROM orders WHERE o_orderkey % 2 = 1)
  SELECT rider, circuit, run, best, n, load FROM st JOIN dy USING (rider, circuit, dt, run)""")
def lap_by_dynamics(spark, d):
    s = raw_laps(spark, d).filter("valid").groupBy("run").agg(F.min("t").alias("best"), F.count("*").alias("n"))
    keyed = runs(spark, d).select("rider", F.col("status").alias("circuit"), "date", "run", F.col("best").alias("load"))
    lap_side = s.join(keyed.drop("load"), "run")
    return lap_side.join(keyed.filter("run % 2 = 1"), ["rider", "circuit", "date", "run"]) \
        .select("rider", "circuit", "run", "best", "n", "load")


@query("""SELECT o_custkey AS rider, o_orderkey AS run, o_totalprice AS best, round(avg(CASE WHEN l_quantity > 10 THEN l_quantity END) + 1e-9, 6) AS mean_f,
    round(avg(l_discount) + 1e-9, 6) AS mean_r FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def run_means_by_best(spark, d):
    m = raw_laps(spark, d).groupBy("run").agg(r6(F.avg(F.when(F.col("l_quantity") > 10, F.col("l_quantity")))).alias("mean_f"),
                                             r6(F.avg("l_discount")).alias("mean_r"))
    return runs(spark, d).join(m, "run").select("rider", "run", "best", "mean_f", "mean_r")


@query("SELECT d.doc_id, source AS tag, lang AS phase, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def tags_with_attributes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("tag"), F.col("lang").alias("phase")) \
        .join(table(spark, d, "labels"), "doc_id", "left")


@query("""SELECT o_orderkey AS run, coalesce(n, 0) AS tag_count FROM orders LEFT JOIN
  (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def sessions_with_tag_counts(spark, d):
    n = raw_laps(spark, d).filter(~F.col("valid")).groupBy("run").agg(F.count("*").alias("tag_count"))
    return runs(spark, d).select("run").join(n, "run", "left").na.fill(0, ["tag_count"])


@query("""WITH b AS (SELECT l_partkey, min(l_extendedprice) AS best FROM lineitem GROUP BY 1)
  SELECT p_partkey, p_brand, p_size, best FROM part LEFT JOIN b ON p_partkey = l_partkey""")
def setup_with_best(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_extendedprice").alias("best"))
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size").join(b, "p_partkey", "left")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < '1998-01-01'
  UNION ALL SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderdate >= '1997-01-01'
    AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderkey = o.o_orderkey AND k.o_orderdate < '1998-01-01')""")
def anti_join_new_keys(spark, d):
    o = table(spark, d, "orders")
    known = o.filter("o_orderdate < timestamp_ntz'1998-01-01'").select("o_orderkey", "o_custkey")
    incoming = o.filter("o_orderdate >= timestamp_ntz'1997-01-01'").select("o_orderkey", "o_custkey")
    return known.unionByName(incoming.join(known.select("o_orderkey"), "o_orderkey", "left_anti"))


@query("""SELECT lower(p_name) AS name, max(p_partkey) AS p_partkey FROM part GROUP BY 1""")
def dedup_case_folded(spark, d):
    p = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.initcap("p_name")).alias("name"), "p_partkey")
    return facts.drop_folded_duplicates(p, "name", F.col("p_partkey")).withColumn("name", F.lower("name"))


@query(f"""WITH {RUNS}, p AS (SELECT run AS a, lead(run) OVER (PARTITION BY rider ORDER BY date, run) AS b FROM runs),
  m AS (SELECT run, rider, session, status, best FROM runs),
  x AS (SELECT a, b, f.field, CASE field WHEN 'session' THEN ra.session WHEN 'status' THEN ra.status ELSE ra.best::DECIMAL(14,2)::VARCHAR END AS value_a,
    CASE field WHEN 'session' THEN rb.session WHEN 'status' THEN rb.status ELSE rb.best::DECIMAL(14,2)::VARCHAR END AS value_b, round(rb.best - ra.best, 2) AS dd
    FROM p JOIN m ra ON a = ra.run JOIN m rb ON b = rb.run CROSS JOIN (VALUES ('session'), ('status'), ('best')) f(field))
  SELECT a, b, field, value_a, value_b, value_a IS DISTINCT FROM value_b AS changed,
    CASE WHEN field <> 'best' THEN '' WHEN abs(dd) < 1e-9 THEN '0' ELSE regexp_replace(printf('%+.2f', dd), '\\.?0+$', '') END AS delta,
    CASE WHEN field <> 'best' OR abs(dd) < 1e-9 THEN '' WHEN dd < 0 THEN 'better' ELSE 'worse' END AS mark FROM x""")
def run_pair_delta(spark, d):
    r = runs(spark, d).withColumn("best", F.col("best").cast("decimal(14,2)"))
    pairs = neighbours(r.select("run", "rider", "date"), ["rider"], [F.col("date"), F.col("run")], b=after(F.col("run")))
    pairs = pairs.select(F.col("run").alias("a"), "b").filter("b is not null")
    out = facts.pair_delta(r, "run", pairs, ["session", "status", "best"])
    va, vb = (F.when(F.col("field") == "best", F.col(c).try_cast("double")) for c in ("value_a", "value_b"))
    polarity = F.when(F.col("field") == "best", "lower").otherwise("neutral")
    return out.select("a", "b", "field", "value_a", "value_b", (~F.col("value_a").eqNullSafe(F.col("value_b"))).alias("changed"),
                      delta_text(va, vb).alias("delta"), delta_mark(va, vb, polarity).alias("mark"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS ev, left(o_orderpriority, 1) AS prefix,
    CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dt FROM orders),
  k AS (SELECT ev, prefix, min(dt) AS dt FROM o WHERE dt IS NOT NULL GROUP BY ALL),
  fam AS (SELECT *, CASE WHEN prefix IN ('1', '2') THEN 'fp' WHEN prefix IN ('3', '4') THEN 'race' END AS f,
    CASE prefix WHEN '2' THEN 0 WHEN '1' THEN 1 WHEN '3' THEN 0 WHEN '4' THEN 1 END AS pos FROM k),
  g AS (SELECT ev, f, arg_min(dt, pos) AS dt FROM fam WHERE f IS NOT NULL GROUP BY ALL), a AS (SELECT ev, arg_min(dt, prefix) AS dt FROM k GROUP BY ALL)
  SELECT o_orderkey, coalesce(o.dt, k.dt, g.dt, a.dt) AS date FROM o LEFT JOIN k ON o.ev = k.ev AND o.prefix = k.prefix
    LEFT JOIN g ON o.ev = g.ev AND CASE WHEN o.prefix IN ('1', '2') THEN 'fp' WHEN o.prefix IN ('3', '4') THEN 'race' END = g.f
    LEFT JOIN a ON o.ev = a.ev""")
def impute_from_sibling(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("ev"), F.substring("o_orderpriority", 1, 1).alias("prefix"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"))
    return facts.impute_dates(o, o, "ev", "prefix", "date", {"fp": ["2", "1"], "race": ["3", "4"]}).select("o_orderkey", "date")


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dt, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS circuit FROM orders),
  f AS (SELECT dt, arg_min(circuit, o_orderkey) AS c FROM o WHERE circuit IS NOT NULL GROUP BY dt)
  SELECT o_orderkey, coalesce(circuit, c) AS circuit FROM o LEFT JOIN f USING (dt)""")
def impute_from_equal_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt"),
                                         F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("circuit"))
    return facts.impute_from_equal_date(o, o, "dt", "circuit", "o_orderkey").select("o_orderkey", "circuit")


@query("""SELECT c_custkey, min(n_name) AS note_key FROM (SELECT c_custkey, 'X-' || c_mktsegment || '-' || n2.n_name || '-' || c_custkey AS sid
    FROM customer JOIN nation n2 ON c_nationkey = n2.n_nationkey) s JOIN nation ON contains(sid, n_name) GROUP BY c_custkey""")
def containment_join(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    sid = F.concat_ws("-", F.lit("X"), "c_mktsegment", "n_name", F.col("c_custkey").cast("string"))
    s = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", sid.alias("sid"))
    hits = facts.contained(s, n.select(F.col("n_name").alias("note_key")), "sid", "note_key", q=8)
    return hits.groupBy("c_custkey").agg(F.min("note_key").alias("note_key"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("orders", "lineitem", "customer", "part")))
def table_counts(spark, d):
    return facts.table_counts({t: table(spark, d, t) for t in ("orders", "lineitem", "customer", "part")})


# --- set operations and keyed writes -------------------------------------------------------------

KEYED = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders"""
OCOLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


@query("""SELECT c_custkey AS id, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier""")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s)


LORD = "(l_shipdate, l_partkey, l_suppkey, l_extendedprice)"


def lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, arg_max(l_extendedprice, {LORD}) AS t FROM lineitem GROUP BY ALL")
def keep_last(spark, d):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_one(lines(spark, d), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("t"))


@query(f"SELECT l_orderkey, l_linenumber, arg_min(l_extendedprice, {LORD}) AS t FROM lineitem GROUP BY ALL")
def keep_first(spark, d):
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_one(lines(spark, d), ["l_orderkey", "l_linenumber"], order, latest=False) \
        .select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("t"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def exact_dedup(spark, d):
    return table(spark, d, "events").select("user_id", "event_type", "props").dropDuplicates()


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")) \
        .union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def _split(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderdate < timestamp_ntz'1999-01-01'")
    new = o.filter("o_orderdate >= timestamp_ntz'1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return old.select(OCOLS), new.select(OCOLS)


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= '1998-01-01' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderstatus, o_orderpriority FROM orders""")
def upsert(spark, d):
    old, new = _split(spark, d)
    once = facts.upsert(old, new, ["o_orderkey"], "o_totalprice")
    return facts.upsert(once, new, ["o_orderkey"], "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders""")
def patch_update(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    changes = o.filter((k % 5 == 0) | (k % 2 == 0)).select(
        "o_orderkey", F.when(k % 5 != 0, F.lit("X")).alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return facts.patch(o, changes, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("""SELECT o_orderkey, CASE WHEN o_orderdate < '1999-01-01' THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice FROM orders""")
def insert_if_absent(spark, d):
    old, new = _split(spark, d)
    return facts.insert_new(old, new, ["o_orderkey"], "o_totalprice").select("o_orderkey", "o_totalprice")


DECISIONS = """dec AS (SELECT l_orderkey AS o_orderkey, arg_max(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'approved' END,
  (l_shipdate, l_linenumber, l_partkey, l_extendedprice)) AS decision FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)"""


@query(f"""WITH {DECISIONS} SELECT o_orderkey, coalesce(decision, 'pending') AS status,
  CASE WHEN decision = 'approved' THEN strftime(o_orderdate, '%Y%m%d') || '-' || o_orderstatus || '-' || o_custkey END AS session_id
  FROM orders LEFT JOIN dec USING (o_orderkey)""")
def review_status(spark, d):
    pend = table(spark, d, "orders").withColumn("status", F.lit("pending"))
    dec = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"),
        F.when(F.col("l_returnflag") == "R", "rejected").otherwise("approved").alias("decision"))
    done = facts.review(pend, dec, "o_orderkey", "at")
    sid = F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus", F.col("o_custkey").cast("string"))
    return done.select("o_orderkey", "status", F.when(F.col("status") == "approved", sid).alias("session_id"))


@query("""WITH u AS (SELECT lower(c_mktsegment || c_nationkey) AS k, c_custkey % 7 AS lvl, 0 AS src, c_custkey AS id FROM customer
  UNION ALL SELECT lower('building' || s_nationkey), s_suppkey % 9, -1, s_suppkey + 100000 FROM supplier)
  SELECT k AS name, max(lvl) AS lvl, arg_max(src, (lvl, src)) AS src FROM u GROUP BY k""")
def priority_merge(spark, d):
    c = table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"),
                                           (F.col("c_custkey") % 7).alias("lvl"), F.lit(0).alias("src"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("Building"), F.col("s_nationkey").cast("string")).alias("name"),
                                           (F.col("s_suppkey") % 9).alias("lvl"), F.lit(-1).alias("src"))
    return facts.priority_merge([c, s], "name", "lvl").withColumn("name", F.lower("name"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 3) AS t, (l_shipdate, l_partkey, l_suppkey, l_quantity) AS ord, l_shipdate >= '1998-01-01' AS inc, l_partkey FROM lineitem),
  old AS (SELECT * FROM x WHERE NOT inc), new AS (SELECT l_orderkey, l_linenumber, t, arg_min(l_partkey, ord) AS l_partkey FROM x WHERE inc GROUP BY ALL)
  SELECT l_orderkey, l_linenumber, t, l_partkey FROM old UNION ALL SELECT n.* FROM new n WHERE NOT EXISTS
    (SELECT 1 FROM old o WHERE o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber AND o.t = n.t)""")
def incremental_import(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("t"), "l_partkey",
                                            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("ord"), "l_shipdate")
    cut = F.expr("l_shipdate >= timestamp_ntz'1998-01-01'")
    out = facts.incremental(li.filter(~cut), li.filter(cut), ["l_orderkey", "l_linenumber"], "t", "ord")
    return out.select("l_orderkey", "l_linenumber", "t", "l_partkey")


@query("""WITH inc AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= '1998-01-01'),
  k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < '1998-01-01'),
  g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM inc GROUP BY ALL)
  SELECT sum(c)::BIGINT AS incoming, count(*) AS distinct_keys, (sum(c) - count(*))::BIGINT AS removed, count(k.l_orderkey) AS skipped,
    count(*) - count(k.l_orderkey) AS new FROM g LEFT JOIN k ON g.l_orderkey = k.l_orderkey AND g.l_linenumber = k.l_linenumber""")
def set_difference_report(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    cut = F.expr("l_shipdate >= timestamp_ntz'1998-01-01'")
    return facts.difference_report(li.filter(~cut), li.filter(cut), ["l_orderkey", "l_linenumber"])
