"""Facts from several keyed sources: column by column, and what follows from the merged runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laplens.functions.ids import event_id, lap_id, run_id, session_id
from laplens.operators.facts import fill_from_first


@dataclass
class Source:
    """Rows of one source. Earlier rows of a key come first by ``order``, a whole number. Only sources that create may bring new keys."""

    rows: DataFrame
    order: str
    creates: bool = True


def merge_columns(sources: list[Source], keys: list[str]) -> DataFrame:
    """One row per key of a creating source; each column is the first value that is not null, sources in the order given, rows of a source in
    theirs. One tagged union and one aggregation, combined before the shuffle."""
    columns = list(dict.fromkeys(c for s in sources for c in s.rows.columns if c not in (*keys, s.order)))
    out = None
    for i, s in enumerate(sources):
        own = [c for c in columns if c in s.rows.columns]
        part = s.rows.select(*keys, *own, F.struct(F.lit(i).alias("source"), F.col(s.order).cast("long").alias("row")).alias("_at"),
                             F.lit(s.creates).alias("_creates"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    merged = out.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in columns], F.max("_creates").alias("_creates"))
    return merged.filter("_creates").drop("_creates")


def named_runs(runs: DataFrame, order: str) -> DataFrame:
    """Merged runs (round, circuit, session, rider, run_no, ...) with rounds filled from the first run by ``order`` of the same circuit,
    session and rider, and their ids."""
    runs = fill_from_first(runs, runs, ["circuit", "session", "rider"], "round", order).withColumn("round", F.coalesce("round", F.lit("UNK")))
    parts = [F.col(c) for c in ("round", "circuit", "session", "rider")]
    return runs.withColumns({"event_id": event_id(*parts[:2]), "session_id": session_id(*parts), "run_id": run_id(*parts, F.col("run_no"))})


def fact_tables(runs: DataFrame, laps: DataFrame, lap_key: str) -> dict[str, DataFrame]:
    """Runs, events, sessions and laps of :func:`named_runs`; ``laps`` (``lap_key``, lap_no, lap_s and more) belong to the runs with that key."""
    sessions = runs.groupBy("session_id", "event_id", "round", "circuit", "session", "rider").agg(
        F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("total_laps"), F.lit(0)).alias("total_laps"), F.min("best_s").alias("best_s"),
        (F.sum(F.col("avg_s") * F.col("total_laps")) / F.sum(F.when(F.col("avg_s").isNotNull(), F.col("total_laps")))).alias("avg_s"), F.min("date").alias("date"))
    events = runs.groupBy("event_id", "round", "circuit").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                                             F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("rider").alias("n_riders"))
    key = runs.select(lap_key, "run_id", "session_id")
    placed = laps.join(key, lap_key)
    placed = placed.withColumn("lap_id", lap_id(F.col("run_id"), F.col("lap_no")))
    return {"runs": runs, "events": events, "sessions": sessions, "laps": placed}
