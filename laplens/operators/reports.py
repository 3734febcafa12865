"""Report sheets as tagged results: every sheet, session column and lap cell ends up as exactly one row.

``kind`` says what became of it: ``session``, ``lap``, ``rejected sheet``, ``rejected session`` or ``rejected cell``; the
last three carry a ``reason``. A sheet that cannot be read is a row, not a gap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from laplens.functions.text import lap_seconds, lenient_double, lenient_long, parse_date, rider_number
from laplens.session import hold
from laplens.sources.tables import LAP_ROWS, REPORT_HEAD, REPORT_SETUP, SESSION_LABELS, lap_cells

KINDS = ["session", "lap", "rejected sheet", "rejected session", "rejected cell"]
#: rows of a session column: label, temperatures, tyres, lap total, best lap
COLUMN_ROWS = {"label": 7, "temp": 9, "f_tyre": 32, "r_tyre": 34, "total": 36, "best": 37}
WHOLE = ["f_comp", "f_reb", "r_comp", "r_reb", "swing_arm"]
DECIMAL = ["f_preload", "r_preload", "ride_height"]


def _setup_value(name: str) -> Column:
    number = lenient_double(F.col(name), True)
    return number.try_cast("long") if name in WHOLE else number if name in DECIMAL else F.nullif(F.trim(name), F.lit(""))


def sheet_frames(cells: DataFrame, default_bike: str | None = None) -> DataFrame:
    """One row per sheet: head, base setup as numbers where they are numbers, and ``grid``, the filled cells of the session
    rows, as many as the sheet is wide. All cells are grouped, so a sheet without any fixed cell is there too."""
    place = {n: (r, ord(c) - ord("A") + 1) for n, (c, r) in REPORT_HEAD.items()} | {n: (r, 4) for n, r in REPORT_SETUP.items()}
    in_grid = lambda row: row.isin(list(COLUMN_ROWS.values()))
    fixed = reduce(lambda a, b: a | b, [(F.col("row") == r) & (F.col("col") == c) for r, c in place.values()])
    text = F.trim("value")
    # one list of a sheet's filled cells instead of a text aggregate for each place
    kept = F.when((text != "") & (in_grid(F.col("row")) | fixed), F.struct("row", "col", text.alias("value")))
    spot = lambda row, col: F.array_max(F.transform(F.filter("_kept", lambda x: (x["row"] == row) & (x["col"] == col)), lambda x: x["value"]))
    out = cells.groupBy("file", "sheet").agg(F.collect_list(kept).alias("_kept")).select(
        "file", "sheet", *[spot(*at).alias(n) for n, at in place.items()], F.filter("_kept", lambda x: in_grid(x["row"])).alias("grid"))
    return out.withColumns({
        "circuit": F.upper("circuit"), "round_id": F.upper("round_id"), "session_date": parse_date(F.col("session_date")),
        "bike_model": F.coalesce("bike_model", F.lit(default_bike)), "rider_num": rider_number(F.col("rider")),
        **{n: _setup_value(n) for n in REPORT_SETUP}})


def _columns() -> Column:
    """Session columns in ``grid``: label, column and cells. Of columns with the same label the rightmost counts."""
    named = F.filter("grid", lambda x: (x["row"] == COLUMN_ROWS["label"]) & F.upper(x["value"]).isin(SESSION_LABELS))
    labels = F.array_sort(F.array_distinct(F.transform(named, lambda x: F.upper(x["value"]))))
    rightmost = lambda label: F.array_max(F.transform(F.filter(named, lambda x: F.upper(x["value"]) == label), lambda x: x["col"]))
    cell = lambda row, col: F.get(F.filter("grid", lambda x: (x["row"] == row) & (x["col"] == col)), 0)["value"]

    def described(label: Column) -> Column:
        col = rightmost(label)
        return F.struct(label.alias("session_type"), col.alias("col"), cell(COLUMN_ROWS["temp"], col).alias("track_temp"),
                        cell(COLUMN_ROWS["temp"], col + 1).alias("air_temp"), cell(COLUMN_ROWS["f_tyre"], col).alias("f_tyre"),
                        cell(COLUMN_ROWS["r_tyre"], col).alias("r_tyre"), cell(COLUMN_ROWS["total"], col).alias("total"),
                        cell(COLUMN_ROWS["best"], col).alias("best_lap"))

    return F.transform(labels, described)


def report_results(cells: DataFrame, sheets: list[str] | None = None, lap_rows: tuple[int, int] = LAP_ROWS,
                   default_bike: str | None = None) -> DataFrame:
    """Tagged results of ``cells`` (file, sheet, row, col, value). ``sheets`` names the report sheets of a workbook, any
    sheet being one without it. Lap cells count down to the first empty one; empty cells make no row. Cells under no session
    column belong to their sheet's own row. An empty table gives no rows."""
    frames = sheet_frames(cells, default_bike)
    other = F.lit(False) if sheets is None else ~F.upper(F.trim("sheet")).isin([s.upper() for s in sheets])
    reason = (F.when(other, "not a report sheet").when(F.col("rider").isNull() | F.col("circuit").isNull(), "no rider or circuit")
              .when(F.size("_cols") == 0, "no session column"))
    judged = frames.withColumn("_cols", _columns()).withColumn("_why", reason).drop("grid")
    entries = (judged.withColumn("_c", F.explode_outer(F.when(F.col("_why").isNull(), F.col("_cols")))).select("*", "_c.*").drop("_c", "_cols")
               .withColumns({"track_temp": lenient_double(F.col("track_temp"), True), "air_temp": lenient_double(F.col("air_temp"), True),
                             "total_laps": lenient_long(F.col("total")), "best_lap_s": lap_seconds(F.col("best_lap"))}))
    no_laps = F.coalesce(F.col("total_laps"), F.lit(0)) <= 0
    entries = entries.withColumns({
        "kind": F.when(F.col("_why").isNotNull(), "rejected sheet").when(no_laps, "rejected session").otherwise("session"),
        "reason": F.coalesce("_why", F.when(no_laps, "no lap total"))}).drop("_why", "total")
    entries = hold(entries, "report-sessions")  # a few rows a sheet, read by both branches
    sessions = entries.filter("kind = 'session'").select("file", "sheet", "col", "rider", "rider_num", "circuit", "round_id", "session_type")
    under = lap_cells(cells, sessions, lap_rows)
    refused = (F.when(F.col("row") > lap_rows[1], "past the last lap row").when(F.col("lap_time").isNull(), "unreadable time")
               .when(F.col("row") >= F.col("_stop"), "below an empty cell"))
    laps = under.withColumn("reason", refused).withColumn("kind", F.when(F.col("reason").isNull(), "lap").otherwise("rejected cell"))
    return entries.unionByName(laps.drop("_stop", "row"), allowMissingColumns=True)


def store_results(results: DataFrame, path: str) -> dict[str, int]:
    """Write all results in one pass, a folder for each kind, and return how many of each were written."""
    seen = Observation()
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    results.observe(seen, *counts).write.mode("overwrite").partitionBy("kind").parquet(path)
    return dict(seen.get)


def of_kind(results: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind; on stored results only their folder is read."""
    return results.filter(F.col("kind") == kind)
