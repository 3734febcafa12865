"""Report sheets as tagged results, rider numbers, and trends, with damaged, empty and repeated rows."""

from pyspark.sql import functions as F

from laplens.functions.text import rider_number, rider_of_number
from laplens.operators import reports, trend

CELLS = "file string, sheet string, row int, col int, value string"


def sheet(file="f", name="DAY1", drop=(), laps=("1:40.5", "DNF", "1:41.0"), col=5, **more):
    cells = {(1, 2): "DA77", (2, 8): " assen ", (3, 8): "round3", (4, 4): "17/04/2026", (7, col): " fp ", (9, col): "31,5", (9, col + 1): "24",
             (14, 4): "9.5", (15, 4): "12,5", (17, 4): "7.9", (36, col): "3", (37, col): "1:40.5", **more.get("extra", {})}
    cells |= {(38 + i, col): lap for i, lap in enumerate(laps)}
    return [(file, name, r, c, v) for (r, c), v in cells.items() if (r, c) not in drop]


def results(spark, rows, **options):
    return reports.report_results(spark.createDataFrame(rows, CELLS), **options)


def test_every_sheet_session_and_cell_is_one_row(spark):
    rows = (sheet() + sheet(name="DAY2", drop=[(1, 2)]) + sheet(name="REPORT", drop=[(7, 5)]) + sheet(name="NOTES") +
            sheet("g", drop=[(36, 5)]) + [("h", "DAY1", 99, 99, "stray"), ("h", "DAY2", 1, 2, " ")])
    got = results(spark, rows, sheets=["DAY1", "DAY2", "REPORT"])
    kinds = {(r.file, r.sheet, r.kind, r.reason): r.n for r in got.groupBy("file", "sheet", "kind", "reason").agg(F.count("*").alias("n")).collect()}
    assert kinds == {
        ("f", "DAY1", "session", None): 1, ("f", "DAY1", "lap", None): 2, ("f", "DAY1", "rejected cell", "unreadable time"): 1,
        ("f", "DAY2", "rejected sheet", "no rider or circuit"): 1, ("f", "REPORT", "rejected sheet", "no session column"): 1,
        ("f", "NOTES", "rejected sheet", "not a report sheet"): 1, ("g", "DAY1", "rejected session", "no lap total"): 1,
        ("h", "DAY1", "rejected sheet", "no rider or circuit"): 1, ("h", "DAY2", "rejected sheet", "no rider or circuit"): 1}


def test_heads_are_typed(spark):
    row = reports.of_kind(results(spark, sheet(), default_bike="M1"), "session").first()
    assert (row.rider, row.rider_num, row.circuit, row.round_id, row.session_date, row.bike_model) == ("DA77", 77, "ASSEN", "ROUND3", "2026-04-17", "M1")
    assert (row.f_spring, row.f_preload, row.f_comp, row.r_comp, row.track_temp, row.air_temp) == ("9.5", 12.5, 7, None, 31.5, 24.0)
    assert (row.session_type, row.total_laps, row.best_lap, row.best_lap_s) == ("FP", 3, "1:40.5", 100.5)


def test_rightmost_of_equal_labels_and_laps_past_a_gap(spark):
    rows = sheet(extra={(7, 9): "FP", (36, 9): "1", (38, 9): "1:39.0", (41, 9): "1:38.0", (80, 9): "1:37.0"})
    got = results(spark, rows)
    assert [(r.col, r.total_laps) for r in reports.of_kind(got, "session").collect()] == [(9, 1)]
    assert [(r.lap_no, r.lap_time) for r in reports.of_kind(got, "lap").collect()] == [(1, 99.0)]
    assert {(r.lap_no, r.reason) for r in reports.of_kind(got, "rejected cell").collect()} == {(4, "below an empty cell"), (43, "past the last lap row")}


def test_stored_in_one_pass_by_kind(spark, tmp_path):
    path = str(tmp_path / "out")
    counts = reports.store_results(results(spark, sheet() + sheet(name="DAY2", drop=[(1, 2)])), path)
    assert counts == {"session": 1, "lap": 2, "rejected sheet": 1, "rejected session": 0, "rejected cell": 1}
    laps = reports.of_kind(spark.read.parquet(path), "lap")
    assert laps.count() == 2 and "PartitionFilters: [isnotnull(kind" in laps._jdf.queryExecution().executedPlan().toString()


def test_no_cells_no_results(spark):
    assert results(spark, []).count() == 0


def test_rider_numbers_both_ways(spark):
    df = spark.createDataFrame([("DA77",), ("x52",), ("other",), (None,)], "r string")
    assert [r[0] for r in df.select(rider_number(F.col("r"))).collect()] == [77, 52, 0, 0]
    nums = spark.createDataFrame([(77,), (52,), (4,), (None,)], "n int")
    assert [r[0] for r in nums.select(rider_of_number(F.col("n"))).collect()] == ["DA77", "JA52", "#4", None]


LOG = [("A1", "assen", "FP", "x; y,\nX", "", 1), ("A1", "ASSEN ", "QP", None, " first ", 2), ("A1", "assen", "QP", "", "second", 3),
       ("A1", "most", "FP", "y", None, 4), ("B2", "assen", "FP", "zzz", None, 5), ("", "assen", "FP", "x", "lost", 6), ("C3", "most", None, None, None, 7)]


def log(spark, rows=LOG):
    df = spark.createDataFrame(rows, "r string, c string, s string, p string, m string, at int")
    return trend.log_rows(df, "r", "c", "s", "p", "m", F.col("at"))


def tags_known(spark):
    return spark.createDataFrame([("y", 1), ("x", 2), ("unused", 3)], "tag string, place int")


def test_trend_counts(spark):
    rows = log(spark)
    assert [(r.tag, r.n, r.position) for r in trend.tag_totals(rows, tags_known(spark)).orderBy("position").collect()] == [("y", 2, 1), ("x", 2, 2)]
    got = sorted((r.rider, r.position, r.tag, r.n_circuits, r.circuits) for r in trend.rider_tags(rows, tags_known(spark)).collect())
    assert got == [("A1", 1, "y", 2, "ASSEN, MOST"), ("A1", 2, "x", 1, "ASSEN")]
    assert sorted((r.rider, r.n_sessions, r.tagged_runs) for r in trend.active_sessions(rows).collect()) == [("A1", 3, 2), ("B2", 1, 1), ("C3", 0, 0)]


def test_only_open_notes_are_filled(spark):
    notes = [("1-Assen-A1", None), ("2-ASSEN-A1", "(Not Yet recorded)"), ("2-ASSEN-A1", "own"), ("3-MOST-A1", ""), ("4-ASSEN-B2", " "), (None, None)]
    out = trend.fill_notes(spark.createDataFrame(notes, "id string, note string"), log(spark), "id", "note")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        ("1-Assen-A1", "first"), ("2-ASSEN-A1", "first"), ("2-ASSEN-A1", "own"), ("3-MOST-A1", ""), ("4-ASSEN-B2", " "), (None, None)], key=repr)
