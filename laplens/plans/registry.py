"""Query registry and the roles the test tables play.

Each query is a function (spark, folder) -> DataFrame, registered next to the SQL that must give the
same rows. ``query(sql)`` takes None where plain SQL cannot state the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laplens.functions.measures import micros
from laplens.operators.ordered import number
from laplens.operators.signal import spread_channels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c) -> Column:
    """Six decimals; the small shift settles exact ties the same way in every engine."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# --- samples: events as multi-channel telemetry ------------------------------------------------

CHANNELS = {"speed": "view", "brake": "click", "gas": "error", "susp": "signup"}


def samples(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("channel"),
        micros(F.col("ts")).alias("ts_us"), "value")


EV = """ev AS (SELECT user_id AS run, event_id, event_type AS channel, epoch_us(ts) AS ts_us, value FROM events)"""


def wide(spark, folder):
    """Track of all events with the latest value of each channel."""
    return spread_channels(samples(spark, folder), ["run"], "ts_us", "channel", "value", CHANNELS, ("event_id",))


WIDE = EV + """,
wide AS (SELECT *,
  last_value(CASE WHEN channel = 'view' THEN value END IGNORE NULLS) OVER w AS speed,
  last_value(CASE WHEN channel = 'click' THEN value END IGNORE NULLS) OVER w AS brake,
  last_value(CASE WHEN channel = 'error' THEN value END IGNORE NULLS) OVER w AS gas,
  last_value(CASE WHEN channel = 'signup' THEN value END IGNORE NULLS) OVER w AS susp
  FROM ev WINDOW w AS (PARTITION BY run ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING))"""


def island_cte(name: str, source: str, mask: str) -> str:
    """SQL for the true rows of ``source`` with an island number ``isl`` (difference of positions)."""
    return f"""{name}_f AS (SELECT *, coalesce({mask}, false) AS m FROM {source}),
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts_us, event_id)
    - row_number() OVER (PARTITION BY run, m ORDER BY ts_us, event_id) AS isl FROM {name}_f),
{name} AS (SELECT * FROM {name}_n WHERE m)"""


# --- laps: order lines as laps of a run --------------------------------------------------------

LAP_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def raw_laps(spark, folder) -> DataFrame:
    """Laps without their number: cheap, for everything that needs no order within the run."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run"), *LAP_ORDER, F.col("l_extendedprice").alias("t"), "l_quantity", "l_discount",
        (F.col("l_returnflag") != "R").alias("valid"), "l_returnflag", "l_linestatus")


def laps(spark, folder) -> DataFrame:
    return number(raw_laps(spark, folder), ["run"], [F.col(c) for c in LAP_ORDER], "lap_no")


LAPS = """laps AS (SELECT l_orderkey AS run, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice,
  l_extendedprice AS t, l_quantity, l_discount, l_returnflag <> 'R' AS valid, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS lap_no
  FROM lineitem)"""


def runs(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("rider"), F.col("o_orderpriority").alias("session"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("best"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


RUNS = """runs AS (SELECT o_orderkey AS run, o_custkey AS rider, o_orderpriority AS session, o_orderstatus AS status,
  o_totalprice AS best, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)"""
