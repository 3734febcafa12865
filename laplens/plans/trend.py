"""The trend job: order lines as a run log with problem tags and comments."""

from pyspark.sql import functions as F

from laplens.operators import trend
from laplens.plans.registry import query, raw_laps, runs, table
from laplens.session import hold

OPEN = "(Not yet recorded)"


def log(spark, d):
    """Problem texts are part names with mixed separators; every third line has none, the first of a run has a comment."""
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    part = table(spark, d, "part").select("p_partkey", F.concat(F.upper(a), F.lit(" , ;"), b, F.lit("\n"), a).alias("problem"))
    rows = raw_laps(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey")).join(runs(spark, d), "run")
    first = F.col("l_linenumber") == 1
    comment = F.when(first & (F.col("run") % 3 == 0), F.concat(F.lit(" note "), F.col("run").cast("string"))).when(first, F.lit(" "))
    named = rows.select(F.concat(F.lit("C"), (F.col("rider") % 7).cast("string"), F.lit("X")).alias("rider"), F.lower(F.split_part("session", F.lit("-"), F.lit(2))).alias("circuit"),
                        F.col("l_linestatus").alias("session"), F.when(F.col("l_quantity") % 3 != 0, F.col("problem")).alias("problem"), comment.alias("comment"), "run", "l_linenumber")
    return trend.log_rows(named, "rider", "circuit", "session", "problem", "comment", F.struct("run", "l_linenumber"))


def dictionary(spark, d):
    """Second words of the part names; the description is their length."""
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    return table(spark, d, "part").select(word.alias("tag")).distinct().select(
        "tag", F.col("tag").alias("place"), F.concat(F.lit("PH"), (F.length("tag") % 4 + 1).cast("string")).alias("phase"), F.length("tag").cast("string").alias("description"))


def stored_notes(spark, d):
    """One note for each run: a third is blank or missing, a third not yet recorded, the rest written."""
    k = F.col("run")
    circuit = F.split_part("session", F.lit("-"), F.lit(2))
    return runs(spark, d).select(
        F.concat_ws("-", "date", circuit, F.concat(F.lit("C"), (F.col("rider") % 9).cast("string"), F.lit("X")), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, F.lit(" "))).when(k % 3 == 1, F.lit(OPEN)).otherwise(F.lit("kept")).alias("note"))


_LOG = """lg AS (SELECT 'C' || (o_custkey % 7) || 'X' AS rider, upper(split_part(o_orderpriority, '-', 2)) AS circuit, l_linestatus AS session, l_orderkey AS run, l_linenumber,
    CASE WHEN l_quantity % 3 <> 0 THEN [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)] ELSE []::VARCHAR[] END AS tags,
    CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN 'note ' || l_orderkey END AS comment
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE split_part(o_orderpriority, '-', 2) <> ''),
  di AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS tag FROM part), tx AS (SELECT rider, circuit, unnest(tags) AS tag FROM lg),
  tt AS (SELECT tag, count(*) AS n FROM tx JOIN di USING (tag) GROUP BY 1), rt AS (SELECT rider, tag, count(DISTINCT circuit) AS n, string_agg(DISTINCT circuit, ', ' ORDER BY circuit) AS detail FROM tx JOIN di USING (tag) GROUP BY ALL),
  ss AS (SELECT rider, circuit, session, count(*) FILTER (len(tags) > 0) AS tr FROM lg WHERE len(tags) > 0 OR comment IS NOT NULL GROUP BY ALL),
  sn AS (SELECT r.rider, count(ss.rider) AS n, coalesce(sum(tr), 0)::BIGINT AS tr FROM (SELECT DISTINCT rider FROM lg) r LEFT JOIN ss ON r.rider = ss.rider GROUP BY 1),
  fc AS (SELECT rider, circuit, arg_min(comment, (run, l_linenumber)) AS comment, min((run, l_linenumber)) AS pl FROM lg WHERE comment IS NOT NULL GROUP BY ALL),
  nt AS (SELECT strftime(o_orderdate, '%Y-%m-%d') || '-' || split_part(o_orderpriority, '-', 2) || '-C' || (o_custkey % 9) || 'X-' || o_orderkey AS id,
    CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN ' ' END WHEN 1 THEN '(Not yet recorded)' ELSE 'kept' END AS note FROM orders),
  nf AS (SELECT id, arg_min(comment, pl) AS c FROM nt JOIN fc ON contains(id, rider) AND contains(upper(id), circuit) GROUP BY 1)"""


@query(f"""WITH {_LOG}
  SELECT 'tags' AS section, NULL AS rider, tag AS name, row_number() OVER (ORDER BY n DESC, tag) AS position, n, 'PH' || (length(tag) % 4 + 1) || ': ' || length(tag) AS detail FROM tt
  UNION ALL SELECT 'riders', rider, tag, row_number() OVER (PARTITION BY rider ORDER BY n DESC, tag), n, detail FROM rt
  UNION ALL SELECT 'sessions', rider, NULL, NULL, n, tr::VARCHAR FROM sn
  UNION ALL SELECT 'notes', NULL, id, NULL, NULL, CASE WHEN note = 'kept' THEN note ELSE coalesce(c, note) END FROM nt LEFT JOIN nf USING (id)""")
def job_trend_report(spark, d):
    """Tag totals, riders' circuits per tag, active sessions and filled notes from one read of the log."""
    return trend.trend_report(hold(log(spark, d), "log"), dictionary(spark, d), stored_notes(spark, d), "id", "note")
