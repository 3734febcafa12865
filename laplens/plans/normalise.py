"""Queries over scalar normalisation."""

from pyspark.sql import functions as F

from laplens.functions import ids, measures, text
from laplens.operators.events import unit_scaled
from laplens.plans.registry import EV, LAPS, laps, query, r6, samples, table

TOK = "regexp_replace(upper(trim({})), '[^A-Z0-9]', '', 'g')"


def tok(c):
    t = TOK.format(c)
    return f"CASE WHEN {t} <> '' THEN {t} ELSE 'UNK' END"


@query(f"""SELECT o_orderkey, {TOK.format('o_orderpriority')} AS session_token,
  concat_ws('_', {tok('o_orderstatus')}, {tok('n_name')}) AS event_id,
  concat_ws('_', {tok('o_orderstatus')}, {tok('n_name')}, {tok('o_orderpriority')}, {tok('c_name')}) AS session_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def id_tokens(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    parts = [F.col(x) for x in ("o_orderstatus", "n_name", "o_orderpriority", "c_name")]
    return j.select("o_orderkey", ids.token(F.col("o_orderpriority")).alias("session_token"),
                    ids.event_id(*parts[:2]).alias("event_id"), ids.session_id(*parts).alias("session_id"))


@query(f"""WITH {LAPS}, x AS (SELECT l.*, o_orderstatus, o_orderpriority, o_custkey FROM laps l JOIN orders ON run = o_orderkey),
  y AS (SELECT *, concat_ws('_', {tok('o_orderstatus')}, {tok("l_linestatus")}, {tok('o_orderpriority')},
    {tok('o_custkey::varchar')}) || '_R' || coalesce(trunc(try_cast(run::varchar AS DOUBLE))::BIGINT, 1) AS run_id FROM x)
  SELECT run, lap_no, run_id, run_id || '_L' || lap_no AS lap_id FROM y""")
def session_and_lap_ids(spark, d):
    o = table(spark, d, "orders")
    j = laps(spark, d).join(o, F.col("run") == o.o_orderkey)
    rid = ids.run_id(F.col("o_orderstatus"), F.col("l_linestatus"), F.col("o_orderpriority"),
                     F.col("o_custkey").cast("string"), F.col("run"))
    return j.select("run", "lap_no", rid.alias("run_id")).withColumn("lap_id", ids.lap_id(F.col("run_id"), F.col("lap_no")))


_SESS = """CASE s WHEN '1' THEN 'FP1' WHEN '2' THEN 'q2' WHEN '3' THEN 'R1' WHEN '4' THEN 'wup2' ELSE '' END"""


@query(f"""WITH a AS (SELECT o_orderkey, left(o_orderpriority, 1) AS s, upper(o_orderpriority) AS raw FROM orders),
  b AS (SELECT *, upper({_SESS}) AS u FROM a)
  SELECT o_orderkey, coalesce(CASE u WHEN 'FP1' THEN 'FP' WHEN 'Q2' THEN 'QP' WHEN 'R1' THEN 'RACE1' WHEN 'WUP2' THEN 'WUP' END,
    raw) AS session_log,
    coalesce(CASE u WHEN 'Q2' THEN 'QP' WHEN 'R1' THEN 'RACE1' WHEN 'WUP2' THEN 'WUP' END, raw) AS session_header
  FROM b""")
def normalize_session_type(spark, d):
    s = F.substring("o_orderpriority", 1, 1)
    spelled = (F.when(s == "1", "FP1").when(s == "2", "q2").when(s == "3", "R1").when(s == "4", "wup2").otherwise(""))
    o = table(spark, d, "orders").withColumn("spelled", spelled)
    raw = F.col("o_orderpriority")
    return o.select("o_orderkey", text.normal_session(F.col("spelled"), raw).alias("session_log"),
                    text.normal_session(F.col("spelled"), raw, profile="header").alias("session_header"))


@query("""WITH a AS (SELECT c_custkey, n_name, n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'phi' WHEN 1 THEN 'Phillip_Island'
    WHEN 2 THEN ' workshop ' ELSE n_name END AS spelled, CASE n_nationkey % 3 WHEN 0 THEN 'R0' || (n_nationkey % 5 + 1) || '_X'
    WHEN 1 THEN 't' || (n_nationkey % 6 + 1) ELSE 'misc' END AS rkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, CASE WHEN n_nationkey % 4 < 3 THEN 'PHILLIP ISLAND' ELSE upper(n_name) END AS circuit_log,
    CASE n_nationkey % 4 WHEN 0 THEN 'PHILLIP ISLAND' WHEN 1 THEN 'PHILLIP_ISLAND' WHEN 2 THEN 'WORKSHOP' ELSE upper(n_name) END AS circuit_header,
    CASE n_nationkey % 3 WHEN 0 THEN 'ROUND' || (n_nationkey % 5 + 1) WHEN 1 THEN 'TEST' || (n_nationkey % 6 + 1) ELSE 'MISC' END AS round
  FROM a""")
def normalize_circuit(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    k = F.col("n_nationkey")
    spelled = (F.when(k % 4 == 0, "phi").when(k % 4 == 1, "Phillip_Island").when(k % 4 == 2, " workshop ").otherwise(F.col("n_name")))
    rkey = (F.when(k % 3 == 0, F.concat(F.lit("R0"), k % 5 + 1, F.lit("_X"))).when(k % 3 == 1, F.concat(F.lit("t"), k % 6 + 1))
            .otherwise("misc"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select("c_custkey", text.normal_circuit(spelled).alias("circuit_log"),
                    text.normal_circuit(spelled, "header").alias("circuit_header"), text.normal_round(rkey).alias("round"))


@query("""WITH a AS (SELECT p_partkey, upper(p_name) AS nm, upper(p_type) AS code FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(nm, '\\bFP\\b|F1\\b|FREE') THEN 'FP' WHEN regexp_matches(nm, '\\bSP\\b|SPRINT') THEN 'SP'
    WHEN regexp_matches(nm, '\\bQP\\b|QUALI') THEN 'QP' WHEN regexp_matches(nm, 'WUP2|WU2\\b') THEN 'WUP2'
    WHEN regexp_matches(nm, 'WUP1?|WU1\\b') THEN 'WUP1' WHEN regexp_matches(nm, '\\bR1\\b|RACE1|RA1') THEN 'RACE1'
    WHEN regexp_matches(nm, '\\bR2\\b|RACE2|RA2') THEN 'RACE2' WHEN regexp_matches(nm, 'RACE|\\bR[D]?\\d') THEN 'RACE1'
    WHEN code LIKE '%L1%' THEN 'FP' WHEN code LIKE '%SP%' THEN 'SP' WHEN code LIKE '%Q%' THEN 'QP' WHEN code LIKE '%W%' THEN 'WUP1'
    WHEN code LIKE '%R1%' THEN 'RACE1' WHEN code LIKE '%R2%' THEN 'RACE2' ELSE 'FP' END AS session_type,
    CASE WHEN nm LIKE '%RED%' OR nm LIKE '%7%' THEN 'RED7' WHEN nm LIKE '%BLUE%' OR nm LIKE '%5%' THEN 'BLUE5'
    ELSE '#' || code END AS rider FROM a""")
def infer_type_regex_cascade(spark, d):
    p = table(spark, d, "part")
    marks = {"RED7": ["RED", "7"], "BLUE5": ["BLUE", "5"]}
    return p.select("p_partkey", text.infer_session_type(F.col("p_name"), F.col("p_type")).alias("session_type"),
                    text.infer_rider(F.col("p_name"), F.col("p_type"), marks).alias("rider"))


@query("""SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '[-#](\\d+)(\\.[A-Za-z]+)?$', 1), '') AS BIGINT), 1) AS run_no
  FROM customer""")
def extract_trailing_number(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.trailing_number(F.col("c_name")).alias("run_no"))


@query("""WITH a AS (SELECT page_id, 'root/' || CASE page_id % 3 WHEN 0 THEN 'R0' || (page_id % 9) || '_' WHEN 1 THEN 'archive/' ELSE 't2/' END
    || split_part(url, '/', 3) || '/x.mes' AS path, split_part(url, '/', 3) AS host FROM pages)
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'R0' || (page_id % 9) WHEN 2 THEN 'T2' END AS event_key,
    'Some Place' AS circuit FROM a""")
def path_event_key(spark, d):
    k = F.col("page_id")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    lead = (F.when(k % 3 == 0, F.concat(F.lit("R0"), k % 9, F.lit("_"))).when(k % 3 == 1, "archive/").otherwise("t2/"))
    path = F.concat(F.lit("root/"), lead, host, F.lit("/x.mes"))
    log = F.concat(F.lit("Start\r\nPath for measurement: D:\\"), host, F.lit("\\R03_SOME_PLACE.26\\X.MES\r\nEnd"))
    return table(spark, d, "pages").select("page_id", text.path_event_key(path).alias("event_key"),
                                           text.log_circuit(log).alias("circuit"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
    CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_strict FROM orders""")
def parse_multi_format_dates(spark, d):
    k, dt = F.col("o_orderkey") % 6, F.col("o_orderdate")
    written = (F.when(k == 0, F.date_format(dt, "dd/MM/yyyy")).when(k == 1, F.date_format(dt, "yyyy-MM-dd"))
               .when(k == 2, F.date_format(dt, "dd.MM.yyyy"))
               .when((k == 3) & (F.year(dt) >= 2000), F.date_format(dt, "yy.MMdd")).when(k == 3, F.date_format(dt, "yyyy-MM-dd"))
               .when((k == 4) & (F.dayofmonth(dt) > 12), F.date_format(dt, "MM/dd/yyyy")).when(k == 4, F.date_format(dt, "dd/MM/yyyy"))
               .otherwise("n/a"))
    return table(spark, d, "orders").select("o_orderkey", text.parse_date(written).alias("date_text"),
                                            text.parse_date(written, strict=True).alias("date_strict"))


@query(f"""WITH {LAPS}, a AS (SELECT run, lap_no, round(t * 10)::BIGINT AS ms FROM laps)
  SELECT run, lap_no, (ms // 60000) || ':' || lpad(((ms % 60000) // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS lap_text,
    round(ms / 1000.0, 3)::DOUBLE AS seconds FROM a""")
def lap_text_round_trip(spark, d):
    ms = F.round(F.col("t") * 10).cast("long")
    out = laps(spark, d).select("run", "lap_no", text.lap_text(ms / 1000).alias("lap_text"))
    return out.withColumn("seconds", text.lap_seconds(F.col("lap_text")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN NULL ELSE o_orderstatus END AS status_clean,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price_clean FROM orders""")
def clean_missing(spark, d):
    k = F.col("o_orderkey")
    dirty = F.when(k % 5 == 0, "").when(k % 5 == 1, "N/A").when(k % 5 == 2, " nan ").otherwise(F.col("o_orderstatus"))
    price = F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", text.blank_to_null(dirty).alias("status_clean"),
                                            text.nan_to_null(price).alias("price_clean"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_totalprice END AS amount,
    CASE WHEN o_orderkey % 4 <> 3 THEN trunc(o_totalprice)::BIGINT END AS amount_whole,
    CASE WHEN o_orderkey % 4 <> 3 THEN o_totalprice END AS amount_comma FROM orders""")
def lenient_numeric(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(14,2)")
    grouped = F.when(k % 4 == 3, "DNF").otherwise(F.format_number(p, 2))
    comma = F.when(k % 4 == 3, "-").otherwise(F.replace(p.cast("string"), F.lit("."), F.lit(",")))
    return table(spark, d, "orders").select("o_orderkey", text.lenient_double(grouped).alias("amount"),
                                            text.lenient_long(grouped).alias("amount_whole"),
                                            text.lenient_double(comma, True).alias("amount_comma"))


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AS flag, o_custkey % 2 = 1 AS odd FROM orders""")
def truthy_flag(spark, d):
    s = F.col("o_orderstatus")
    word = F.when(s == "F", "yes").when(s == "O", " TRUE ").otherwise("no")
    return table(spark, d, "orders").select("o_orderkey", text.truthy(word).alias("flag"),
                                            text.truthy(F.col("o_custkey") % 2).alias("odd"))


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 THEN p_size::DOUBLE ELSE 20.0 END AS mass FROM part""")
def number_before_paren(spark, d):
    note = F.concat(F.col("p_size").cast("string"), F.lit(" ("), F.col("p_type"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.number_before_paren(note, 20.0, 5, 40).alias("mass"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || o_orderstatus || '-' || o_custkey AS report_id,
    strftime(o_orderdate, '%Y-%m-%d') AS report_date, o_orderstatus AS round, o_custkey::VARCHAR AS rider FROM orders""")
def split_composite_key(spark, d):
    key = F.concat_ws("-", F.date_format("o_orderdate", "yyyyMMdd"), "o_orderstatus", F.col("o_custkey").cast("string"))
    out = table(spark, d, "orders").select("o_orderkey", key.alias("report_id"))
    parts = ids.split_report_id(F.col("report_id"))
    parts["report_date"] = F.date_format(parts["report_date"], "yyyy-MM-dd")
    return out.withColumns(parts)


@query("""SELECT o_orderkey, o_orderstatus || '/' || left(o_orderpriority, 1) AS pair,
    'R' || o_orderstatus || ' ' || substr(o_orderpriority, 3) || ' ' || year(o_orderdate) AS label FROM orders""")
def label_concat(spark, d):
    p = F.col("o_orderpriority")
    label = F.concat_ws(" ", F.concat(F.lit("R"), "o_orderstatus"), F.substring(p, 3, 100), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", ids.paired(F.col("o_orderstatus"), F.substring(p, 1, 1)).alias("pair"),
                                            label.alias("label"))


@query("""SELECT p_partkey, concat_ws(' | ', 'brand: ' || p_brand, CASE WHEN p_size > 10 THEN 'size: ' || p_size END, 'type: ' || p_type) AS setup
  FROM part""")
def setup_summary_text(spark, d):
    parts = {"brand": F.col("p_brand"), "size": F.when(F.col("p_size") > 10, F.col("p_size")), "type": F.col("p_type")}
    return table(spark, d, "part").select("p_partkey", ids.labelled(parts).alias("setup"))


@query("""WITH a AS (SELECT p_partkey, p_retailprice, CASE WHEN p_size > 3 THEN p_retailprice END AS v FROM part)
  SELECT p_partkey, coalesce(CASE WHEN (v * 100)::BIGINT % 100 = 0 THEN ((v * 100)::BIGINT // 100)::VARCHAR
     WHEN (v * 100)::BIGINT % 10 = 0 THEN printf('%.1f', v) ELSE printf('%.2f', v) END, '—') AS shown FROM a""")
def trim_zero_text(spark, d):
    v = F.when(F.col("p_size") > 3, F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", text.short_number(v).alias("shown"))


@query(f"""WITH {EV}, a AS (SELECT *, CASE WHEN run % 2 = 0 THEN value * 100 ELSE value / 100 END AS p FROM ev),
  m AS (SELECT run, median(p) FILTER (p > 0) AS med FROM a GROUP BY run)
  SELECT a.run, event_id, round(CASE WHEN med > 10 THEN p / 100 ELSE p END + 1e-9, 6) AS bar, round(value / 3.6 + 1e-9, 6) AS ms FROM a JOIN m ON a.run = m.run""")
def unit_autodetect(spark, d):
    ev = samples(spark, d).withColumn("p", F.when(F.col("run") % 2 == 0, F.col("value") * 100).otherwise(F.col("value") / 100))
    out = unit_scaled(ev, ["run"], "p", out="bar")
    return out.select("run", "event_id", r6("bar").alias("bar"), r6(measures.kmh_to_ms(F.col("value"))).alias("ms"))
