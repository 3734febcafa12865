"""Trends of a run log: problem tags against a dictionary, riders compared, and engineer notes filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laplens.functions.text import tags as split_tags
from laplens.operators import tags
from laplens.operators.facts import contained
from laplens.operators.ordered import number

OPEN_NOTE = "(not yet recorded)"  # fixed value: text of a note nobody has written yet


def log_rows(log: DataFrame, rider: str, circuit: str, session: str, problem: str, comment: str, at: Column) -> DataFrame:
    """The log under the names used here: rows without a rider or circuit go, blanks in texts become null, ``tags`` is the
    problem text split. ``at`` orders the rows."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = log.select(filled(rider).alias("rider"), F.upper(filled(circuit)).alias("circuit"), F.coalesce(filled(session), F.lit("")).alias("session"),
                     split_tags(F.coalesce(F.col(problem), F.lit(""))).alias("tags"), filled(comment).alias("comment"), at.alias("at"))
    return out.filter("rider is not null and circuit is not null")


def tag_totals(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary tags (tag, place, ...) in use with their total and position; ties stand in the order of ``place``."""
    found = tags.tag_rows(rows, [], F.col("tags"))
    return number(tags.dictionary_totals(found, "tag", dictionary).filter("n > 0"), [], [F.col("n").desc(), F.col("place")], "position")


def rider_tags(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """For each rider and dictionary tag the circuits where it came up, most first."""
    listed = tags.tag_rows(rows, ["rider", "circuit"], F.array_distinct("tags"))
    known = listed.join(dictionary.select("tag", "place"), "tag")
    out = tags.distinct_text(known, ["rider", "tag", "place"], "circuit", "circuits", "n_circuits")
    return number(out, ["rider"], [F.col("n_circuits").desc(), F.col("place")], "position")


def active_sessions(rows: DataFrame) -> DataFrame:
    """Distinct sessions of each rider with a tag or a comment, and its runs with tags."""
    seen = rows.filter((F.size("tags") > 0) | F.col("comment").isNotNull()).groupBy("rider", "circuit", "session").agg(
        F.count_if(F.size("tags") > 0).alias("tagged_runs"))
    counts = seen.groupBy("rider").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("tagged_runs").alias("tagged_runs"))
    return rows.select("rider").distinct().join(counts, "rider", "left").na.fill(0, ["n_sessions", "tagged_runs"])


def first_comments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First comment of each group, with its place in the log."""
    said = rows.filter("comment is not null").groupBy(*keys)
    return said.agg(F.min_by("comment", "at").alias("comment"), F.min("at").alias("at"))


def fill_notes(notes: DataFrame, rows: DataFrame, key: str, note: str) -> DataFrame:
    """``notes`` with open texts (null, blank or :data:`OPEN_NOTE`) replaced by the first comment of a rider and circuit
    that both occur in ``key``; others stay as they are. Riders and circuits are searched separately and their matches
    joined on the key, so a rider named in most keys meets its circuits only where the key names them too."""
    first = first_comments(rows, ["rider", "circuit"])
    is_open = F.coalesce((F.trim(note) == "") | F.lower(note).contains(OPEN_NOTE), F.lit(True)) & F.col(key).isNotNull()
    wanted = notes.filter(is_open).select(F.col(key).alias("_key"), F.upper(key).alias("_upper")).distinct()
    riders = contained(wanted, first.select("rider").distinct(), "_key", "rider").select("_key", "rider").distinct()
    circuits = contained(wanted, first.select("circuit").distinct(), "_upper", "circuit").select("_key", "circuit").distinct()
    found = (riders.join(circuits, "_key").join(first, ["rider", "circuit"]).groupBy("_key")
             .agg(F.min_by("comment", F.struct("at", "circuit", "rider")).alias("_comment")))
    out = notes.join(found, notes[key] == found["_key"], "left")
    return out.withColumn(note, F.when(is_open, F.coalesce("_comment", note)).otherwise(F.col(note))).drop("_key", "_comment")


def trend_report(rows: DataFrame, dictionary: DataFrame, notes: DataFrame, key: str, note: str) -> DataFrame:
    """All parts as one table: section (``tags``, ``riders``, ``sessions``, ``notes``), rider, name, position, n, detail."""
    text = lambda c: F.col(c).cast("string")
    part = lambda df, section, rider, name, position, n, detail: df.select(
        F.lit(section).alias("section"), rider.alias("rider"), name.alias("name"), position.cast("long").alias("position"), n.cast("long").alias("n"),
        detail.alias("detail"))
    none, no_place = F.lit(None).cast("string"), F.lit(None).cast("long")
    parts = [
        part(tag_totals(rows, dictionary), "tags", none, F.col("tag"), F.col("position"), F.col("n"), F.concat_ws(": ", "phase", "description")),
        part(rider_tags(rows, dictionary), "riders", F.col("rider"), F.col("tag"), F.col("position"), F.col("n_circuits"), F.col("circuits")),
        part(active_sessions(rows), "sessions", F.col("rider"), none, no_place, F.col("n_sessions"), text("tagged_runs")),
        part(fill_notes(notes, rows, key, note), "notes", none, F.col(key), no_place, no_place, F.col(note))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
