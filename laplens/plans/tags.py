"""Queries over tags, nested records, logs, digests and reshaping."""

from pyspark.sql import functions as F

from laplens.functions.ids import labelled
from laplens.functions.measures import delta_mark, delta_text, direction
from laplens.functions.text import first_of, lap_text
from laplens.functions.text import tags as split_tags
from laplens.operators import pace, reshape, tags
from laplens.operators.ordered import first_k, keep_one
from laplens.plans.pace import FAST, run_means, tiered
from laplens.plans.registry import LAPS, RUNS, query, r6, raw_laps, runs, table


def noisy(spark, d):
    """Part names as free text with mixed separators and case."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return table(spark, d, "part").select("p_partkey", F.concat(F.upper(a), F.lit(" , ;"), b, F.lit("\n"), a).alias("note"))


@query("""SELECT p_partkey, list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)) AS tags FROM part""")
def tag_split(spark, d):
    return noisy(spark, d).select("p_partkey", split_tags(F.col("note")).alias("tags"))


@query("""SELECT p_partkey, unnest(list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), split_part(p_name, ' ', 1))) AS tag FROM part""")
def tag_explode(spark, d):
    return tags.tag_rows(noisy(spark, d), ["p_partkey"], split_tags(F.col("note")))


TURNS = ["turn", "role", "text"]


@query("SELECT conv_id, turn, role, text FROM conversations")
def explode_nested(spark, d):
    nested = tags.nest(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], TURNS)
    return tags.unnest(nested, "items", ["conv_id"])


@query("""SELECT conv_id, (turn_no - 1) // 3 AS page, string_agg(turn || ':' || role || ':' || length(text), '|' ORDER BY turn_no) AS items, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS turn_no FROM conversations) GROUP BY ALL""")
def nest_children(spark, d):
    nested = tags.nest(table(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], TURNS, page=3)
    shown = F.transform("items", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], F.length(x["text"]).cast("string")))
    return nested.select("conv_id", "page", F.array_join(shown, "|").alias("items"), F.size("items").cast("long").alias("n"))


@query("""SELECT event_type AS circuit, 'k' AS rider, generate_series AS pos, (props::JSON ->> 'k')::BIGINT + generate_series AS entry
  FROM events, generate_series(0, 1)""")
def map_explode(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    log = F.to_json(F.create_map("event_type", F.create_map(F.lit("k"), F.array(k, k + 1))))
    parsed = table(spark, d, "events").select(F.from_json(log, "map<string,map<string,array<long>>>").alias("log"))
    return tags.nested_log_rows(parsed, "log", "circuit", "rider", "entry")


def _dir_sql(label, d):
    return (f"CASE WHEN abs({d}) < 0.3 THEN '{label}:same' WHEN {d} IS NOT NULL THEN '{label}:' || printf('%+.1f', round({d}, 1)) END")


@query(f"""WITH {FAST} SELECT rider, status, coalesce(nullif(concat_ws('  |  ', {_dir_sql('qty', '(d_qty + 1e-9)')}, {_dir_sql('disc', '(d_disc + 1e-9)')}), ''), '—') AS direction FROM fd""")
def direction_text(spark, d):
    m = pace.tier_means(tiered(spark, d).join(run_means(spark, d), "run"), ["rider", "status"], ["qty", "disc"])
    return m.select("rider", "status", direction({"qty": F.col("d_qty") + 1e-9, "disc": F.col("d_disc") + 1e-9}).alias("direction"))


@query(f"""WITH {LAPS}, g AS (SELECT run, min(t) AS a, max(t) AS b FROM laps GROUP BY run), h AS (SELECT *, round(b - a, 2) AS dd FROM g)
  SELECT run, CASE WHEN abs(dd) < 1e-9 THEN '0' ELSE regexp_replace(printf('%+.2f', dd), '\\.?0+$', '') END AS delta,
    CASE WHEN abs(dd) < 1e-9 THEN '' WHEN run % 3 = 0 THEN '' WHEN (run % 3 = 1) = (dd < 0) THEN 'better' ELSE 'worse' END AS mark FROM h""")
def delta_marker(spark, d):
    g = raw_laps(spark, d).groupBy("run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    pol = F.when(F.col("run") % 3 == 1, "lower").when(F.col("run") % 3 == 2, "higher").otherwise("neutral")
    return g.select("run", delta_text(F.col("a"), F.col("b")).alias("delta"), delta_mark(F.col("a"), F.col("b"), pol).alias("mark"))


@query(f"""WITH {RUNS}, hit AS (SELECT DISTINCT l_orderkey AS run FROM lineitem JOIN part ON l_partkey = p_partkey WHERE split_part(p_name, ' ', 2) IN ('bolt', 'ring') AND l_returnflag = 'R'),
  tg AS (SELECT l_orderkey AS run, string_agg(DISTINCT split_part(p_name, ' ', 2), ', ' ORDER BY split_part(p_name, ' ', 2)) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1),
  b AS (SELECT l_orderkey AS run, min(l_extendedprice) AS best_lap FROM lineitem GROUP BY 1)
  SELECT run, rider, tags, concat_ws(' | ', 'session: ' || session, CASE WHEN best > 250000 THEN 'load: high' END) AS setup, best_lap,
    CASE WHEN status = 'F' THEN 'done ' || date END AS action, status = 'F' AS has_solution FROM runs JOIN hit USING (run) JOIN tg USING (run) JOIN b USING (run)""")
def problem_solution(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("run"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tag"), "l_returnflag")
    problems = li.filter("l_returnflag = 'R'")
    wanted = problems.filter(F.col("tag").isin("bolt", "ring")).select("run")
    tag_text = tags.distinct_text(problems, ["run"], "tag", "tags").select("run", "tags")
    best = raw_laps(spark, d).groupBy("run").agg(F.min("t").alias("best_lap"))
    out = runs(spark, d).join(wanted, "run", "left_semi").join(tag_text, "run").join(best, "run")
    setup = labelled({"session": F.col("session"), "load": F.when(F.col("best") > 250000, F.lit("high"))})
    done = F.col("status") == "F"
    return out.select("run", "rider", "tags", setup.alias("setup"), "best_lap",
                      F.when(done, F.concat(F.lit("done "), "date")).alias("action"), done.alias("has_solution"))


@query(f"""WITH {RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY date, run) AS rn FROM runs WHERE status = 'P')
  SELECT rider, count(*) AS pending, string_agg(run::VARCHAR, ', ' ORDER BY rn) FILTER (rn <= 5) AS first_five, string_agg(DISTINCT session, ', ' ORDER BY session) AS submitters FROM p GROUP BY rider""")
def digest(spark, d):
    p = runs(spark, d).filter("status = 'P'")
    n = p.groupBy("rider").agg(F.count("*").alias("pending"))
    five = first_k(p, ["rider"], [F.col("date"), F.col("run")], 5)
    head = five.groupBy("rider").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "run"))),
                                                              lambda x: x["run"].cast("string")), ", ").alias("first_five"))
    who = tags.distinct_text(p, ["rider"], "session", "submitters").select("rider", "submitters")
    return n.join(head, "rider").join(who, "rider")


@query(f"""WITH {RUNS}, t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5),
  r AS (SELECT run, date FROM runs ORDER BY date DESC, run DESC LIMIT 3)
  SELECT (SELECT string_agg(source || ' (' || n || ')', ', ' ORDER BY n DESC, source) FROM t) AS top_tags,
    (SELECT string_agg(run || ' ' || date, ', ' ORDER BY date DESC, run DESC) FROM r) AS recent""")
def context_block(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    top = pace.top_rows(counts, [F.col("n").desc(), F.col("source")], 5)
    recent = pace.top_rows(runs(spark, d), [F.col("date").desc(), F.col("run").desc()], 3)

    def block(df, shown, out):
        items = F.sort_array(F.collect_list(F.struct("position", shown.alias("s"))))
        return df.groupBy(F.lit(1).alias("_one")).agg(F.array_join(F.transform(items, lambda x: x["s"]), ", ").alias(out))
    a = block(top, F.concat("source", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "top_tags")
    b = block(recent, F.concat_ws(" ", F.col("run").cast("string"), "date"), "recent")
    return a.join(b, "_one").select("top_tags", "recent")


@query(f"WITH {RUNS} SELECT status, session, rider, arg_min(run, (date, run)) AS run FROM runs GROUP BY ALL")
def first_note(spark, d):
    return keep_one(runs(spark, d), ["status", "session", "rider"], F.struct("date", "run"), latest=False) \
        .select("status", "session", "rider", "run")


@query("""WITH f AS (SELECT role, length(text) % 40 AS entry, min((conv_id, turn)) AS seen FROM conversations GROUP BY ALL)
  SELECT role, entry, row_number() OVER (PARTITION BY role ORDER BY seen DESC) AS recency FROM f QUALIFY recency <= 20""")
def capped_log(spark, d):
    c = table(spark, d, "conversations").withColumn("entry", (F.length("text") % 40).cast("long"))
    return tags.capped_log(c, ["role"], "entry", F.struct("conv_id", "turn"), 20).select("role", "entry", "recency")


@query("""SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC, text) AS recency FROM conversations QUALIFY recency <= 5""")
def recall_last_k(spark, d):
    order = [F.col("conv_id").desc(), F.col("turn").desc(), F.col("text")]
    return tags.recall(table(spark, d, "conversations"), ["role"], order, 5).select("role", "conv_id", "turn", "recency")


_PART = lambda part, circuit, rider, src: f"SELECT '{part}' AS part, {circuit} AS circuit, {rider} AS rider, recency, entry FROM {src}"


@query(f"""WITH c AS (SELECT role AS circuit, (conv_id % 3)::VARCHAR AS rider, conv_id * 1000 + turn AS pl, length(text) || ':' || conv_id || ':' || turn AS entry, conv_id, turn FROM conversations),
  i AS (SELECT *, row_number() OVER (PARTITION BY rider ORDER BY pl DESC, entry) AS recency FROM c WHERE circuit = 'user' QUALIFY recency <= 5),
  g AS (SELECT *, row_number() OVER (ORDER BY pl DESC, entry) AS recency FROM c WHERE turn % 2 = 1 QUALIFY recency <= 4),
  w AS (SELECT CASE WHEN conv_id % 4 = 0 THEN 'All' ELSE circuit END AS circuit, pl, entry FROM c ORDER BY pl DESC, entry LIMIT 6),
  s AS (SELECT *, row_number() OVER (ORDER BY pl DESC, entry) AS recency FROM w WHERE circuit IN ('All', 'user') QUALIFY recency <= 3)
  {_PART('insights', 'circuit', 'rider', 'i')} UNION ALL {_PART('general', 'NULL', 'NULL', 'g')} UNION ALL {_PART('summaries', 'circuit', 'NULL', 's')}""")
def recall_context(spark, d):
    """Insights of one circuit by rider, general ones, and recent summaries that fit."""
    c = table(spark, d, "conversations").select(
        F.col("role").alias("circuit"), (F.col("conv_id") % 3).cast("string").alias("rider"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"),
        F.concat_ws(":", F.length("text").cast("string"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("entry"), "conv_id", "turn")
    summaries = c.withColumn("circuit", F.when(F.col("conv_id") % 4 == 0, "All").otherwise(F.col("circuit")))
    return tags.recall_context(c, c.filter("turn % 2 = 1"), summaries, "user")


@query(f"""WITH {LAPS}, {RUNS}, t AS (SELECT l_linestatus AS phase, split_part(p_name, ' ', 2) AS tag, l_orderkey AS run FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
  n AS (SELECT phase, tag, count(DISTINCT run) AS n FROM t GROUP BY ALL ORDER BY n DESC, phase, tag LIMIT 15),
  r AS (SELECT run, rider, session, date FROM runs ORDER BY date DESC, run DESC LIMIT 3),
  b AS (SELECT status, session, round(min(t))::BIGINT AS ms FROM laps JOIN runs USING (run) WHERE valid GROUP BY ALL ORDER BY status DESC, session DESC LIMIT 10)
  SELECT (SELECT string_agg(phase || ' | ' || tag || ' — ' || n, chr(10) ORDER BY n DESC, phase, tag) FROM n) AS top_tags,
    (SELECT string_agg(concat_ws(' | ', date, rider, session, run), chr(10) ORDER BY date DESC, run DESC) FROM r) AS recent,
    (SELECT string_agg(status || ' ' || session || ': ' || (ms // 60000) || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0'), chr(10)
      ORDER BY status DESC, session DESC) FROM b) AS best_laps""")
def setup_context(spark, d):
    """Text blocks for a setup question: frequent tags, recent sessions, best laps."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tag"))
    t = raw_laps(spark, d).filter(~F.col("valid")).join(part, "l_partkey").select(F.col("l_linestatus").alias("phase"), "tag", "run").distinct()
    n = t.groupBy("phase", "tag").agg(F.count(F.lit(1)).alias("n"))
    r = runs(spark, d)
    best = raw_laps(spark, d).filter("valid").join(r, "run").groupBy("status", "session").agg((F.round(F.min("t")) / 1000).alias("s"))
    text = lambda c: F.col(c).cast("string")
    a = tags.text_block(n, [F.col("n").desc(), F.col("phase"), F.col("tag")], 15, F.concat("phase", F.lit(" | "), "tag", F.lit(" — "), text("n")), "top_tags")
    b = tags.text_block(r, [F.col("date").desc(), F.col("run").desc()], 3, F.concat_ws(" | ", "date", text("rider"), "session", text("run")), "recent")
    c = tags.text_block(best, [F.col("status").desc(), F.col("session").desc()], 10, F.concat("status", F.lit(" "), "session", F.lit(": "), lap_text(F.col("s"))), "best_laps")
    one = F.lit(1).alias("_one")
    return a.select("*", one).join(b.select("*", one), "_one").join(c.select("*", one), "_one").drop("_one")


@query(f"""WITH {RUNS} SELECT run, coalesce(CASE WHEN run % 3 = 0 THEN session END, CASE WHEN run % 2 = 0 THEN status END) AS note, CASE WHEN run % 4 <> 0 THEN 0 ELSE run END AS zero FROM runs""")
def alternative_columns(spark, d):
    """First value among columns that sheets spell differently; zero is a value."""
    r, k = runs(spark, d), F.col("run")
    sheet = r.select("run", F.when(k % 3 == 0, F.col("session")).alias("NOTE PH1"), F.when(k % 2 == 0, F.col("status")).alias("note_ph1"), F.when(k % 4 != 0, F.lit(0)).alias("Laps"), k.alias("LAPS 2"))
    return sheet.select("run", first_of(sheet, ["note ph1", "missing", "NOTE_PH1"]).alias("note"), first_of(sheet, ["laps", "laps 2"]).alias("zero"))


# --- reshaping --------------------------------------------------------------------------------------


@query("SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def pivot_counts(spark, d):
    return reshape.pivot_counts(table(spark, d, "documents"), ["source"], "lang", ["de", "en", "es", "fr"])


@query("""SELECT p_partkey, 'p_size' AS metric, p_size::DOUBLE AS value FROM part UNION ALL
  SELECT p_partkey, 'p_retailprice', p_retailprice FROM part WHERE p_size > 5""")
def unpivot_measures(spark, d):
    p = table(spark, d, "part").withColumn("p_retailprice", F.when(F.col("p_size") > 5, F.col("p_retailprice")))
    return reshape.measures_long(p, ["p_partkey"], ["p_size", "p_retailprice"])


@query(f"""WITH {RUNS}, g AS (SELECT rider, avg(best) FILTER (status = 'F') AS a, avg(best) FILTER (status = 'O') AS b FROM runs GROUP BY rider)
  SELECT rider, round(a + 1e-9, 6) AS value_a, round(b + 1e-9, 6) AS value_b, round(a - b + 1e-9, 6) AS gap FROM g WHERE a IS NOT NULL AND b IS NOT NULL""")
def pivot_pair_gap(spark, d):
    out = reshape.pivot_pair(runs(spark, d), ["rider"], "status", ("F", "O"), "best")
    return out.select("rider", *[r6(c).alias(c) for c in ("value_a", "value_b", "gap")])


MO = "(l_shipdate, l_partkey, l_suppkey, l_extendedprice)"


@query("SELECT l_orderkey AS run, " + ", ".join(f"arg_min(l_extendedprice, {MO}) FILTER (l_linenumber = {i}) AS lap{i}" for i in range(1, 8)) +
       " FROM lineitem GROUP BY 1")
def matrix_pivot(spark, d):
    r = raw_laps(spark, d).withColumn("at", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return reshape.matrix(r, ["run"], "l_linenumber", list(range(1, 8)), "t", "at", "lap")


@query("""SELECT p_partkey, 'p_brand' AS field, p_brand AS value, '' AS unit, 'neutral' AS polarity FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR, 'mm', 'lower' FROM part
  UNION ALL SELECT p_partkey, 'p_type', CASE WHEN p_type <> 'PROMO' THEN p_type END, '', 'neutral' FROM part""")
def field_values(spark, d):
    p = table(spark, d, "part").withColumn("p_type", F.when(F.col("p_type") != "PROMO", F.col("p_type")))
    meta = spark.createDataFrame([("p_brand", "", "neutral"), ("p_size", "mm", "lower"), ("p_type", "", "neutral")],
                                 "field string, unit string, polarity string")
    return reshape.fields_long(p, ["p_partkey"], ["p_brand", "p_size", "p_type"]).join(meta, "field")


@query(f"""WITH {LAPS}, {RUNS}, x AS (SELECT session, rider, unnest(['seg1', 'seg2', 'seg3']) AS sector, unnest([t, l_quantity, l_discount]) AS v FROM laps JOIN runs USING (run)),
  b AS (SELECT session, rider, sector, min(v) AS best FROM x GROUP BY ALL)
  SELECT session, rider, sector, best, round(best - min(best) OVER (PARTITION BY session, sector) + 1e-9, 6) AS sector_gap,
    rank() OVER (PARTITION BY session, sector ORDER BY best) AS sector_rank FROM b""")
def sector_long(spark, d):
    j = raw_laps(spark, d).join(runs(spark, d).select("run", "session", "rider"), "run")
    wide = j.select("session", "rider", F.col("t").alias("seg1"), F.col("l_quantity").alias("seg2"), F.col("l_discount").alias("seg3"))
    out = reshape.sector_ranks(wide, ["session"], "rider", ["seg1", "seg2", "seg3"])
    return out.select("session", "rider", "sector", "best", r6("sector_gap").alias("sector_gap"), "sector_rank")


@query(f"""WITH {RUNS} SELECT rider, run, CASE session WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END AS round_order,
  'R' || left(session, 1) || ' ' || left(date, 4) AS label, best FROM runs WHERE status = 'F'""")
def position_series(spark, d):
    o = pace.custom_position(F.col("session"), ["1-URGENT", "2-HIGH"]).cast("int")
    label = F.concat(F.lit("R"), F.substring("session", 1, 1), F.lit(" "), F.substring("date", 1, 4))
    return runs(spark, d).filter("status = 'F'").select("rider", "run", o.alias("round_order"), label.alias("label"), "best")


@query(f"""WITH {RUNS}, b AS (SELECT session, rider, min(best) AS best FROM runs GROUP BY ALL)
  SELECT session, rider, session || ' / ' || rider AS label, round(best - min(best) OVER (PARTITION BY session) + 1e-9, 6) AS gap FROM b""")
def gap_series(spark, d):
    b = runs(spark, d).groupBy("session", "rider").agg(F.min("best").alias("best"))
    out = pace.gap_to_best(b, ["session"], "best")
    return out.select("session", "rider", F.concat_ws(" / ", "session", F.col("rider").cast("string")).alias("label"), r6("gap").alias("gap"))


