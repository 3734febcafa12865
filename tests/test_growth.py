"""Steps whose cost once grew faster than their input."""

import datetime

import pytest
from pyspark.sql import functions as F

from laplens.functions.text import lap_seconds, lap_text, parse_date, settled
from laplens.operators import dynamics, facts, merge, reports
from laplens.plans import bundles, merged, pace
from laplens.sources import bundle_format, tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pasted_laps_parse_a_time_once(spark):
    lines = spark.createDataFrame([("r1,a,fp,7,1,1:37.455",), ("r1,a,fp,7,x,1:37.455",), ("r1,7",), (None,)], "line string")
    good, bad = tables.pasted_laps(lines)
    assert [(r.lap_no, r.lap_time) for r in good.collect()] == [(1, 97.455)]
    assert sorted((r.line or "", r.reason) for r in bad.collect()) == [("", "unreadable number"), ("r1,7", "too few fields"), ("r1,a,fp,7,x,1:37.455", "unreadable number")]
    assert plan(good).count("regexp_replace") == 1
    assert plan(bad).count("regexp_replace") <= 1


def test_lap_cells_parse_a_time_once(spark):
    cells = spark.createDataFrame([("f", "s", 38, 5, "1:01,5"), ("f", "s", 39, 5, "DNF"), ("f", "s", 41, 5, "70")], "file string, sheet string, row int, col int, value string")
    sessions = spark.createDataFrame([("f", "s", 5, "FP")], "file string, sheet string, col int, session_type string")
    rows = tables.lap_cells(cells, sessions, tables.LAP_ROWS)
    assert sorted((r.lap_no, r.lap_time, r._stop) for r in rows.collect()) == [(1, 61.5, 40), (2, None, 40), (4, 70.0, 40)]
    refused = tables.rejected_laps(cells, sessions)
    assert sorted((r.lap_no, r.reason) for r in refused.collect()) == [(2, "unreadable time"), (4, "below an empty cell")]
    assert plan(refused).count("regexp_replace") == 1


@pytest.mark.parametrize(("text", "seconds"), [
    ("1:37.455", 97.455), ("1'38,7", 98.7), ("1:2:3.4", None), (" 1:05.25 ", 65.25), ("1:37.455 pit", 97.455), ("97.1", 97.1), ("1:37", None),
    ("DNF", None), ("", None), ("x:1.5", None), ("1:37.455\n", 97.455), (None, None), ("٣:37.455", None)])
def test_lap_seconds(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "v string").select(lap_seconds(F.col("v"))).first()[0] == seconds


def test_lap_text_computes_its_ticks_once(spark):
    df = spark.createDataFrame([(59.9996,), (None,), (61.5,)], "t double")
    out = df.select(lap_text(F.col("t")).alias("s"))
    assert [r.s for r in out.collect()] == ["1:00.000", "—", "1:01.500"]
    assert plan(out).count("round(") == 1


def test_parse_date_tries_formats_by_their_mark(spark):
    texts = ["03/02/2024", "2024-02-03", "03.02.2024", "24.0203", "12/31/2024", "soon", "", None, "1-2/3"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t"))).collect()]
    assert got == ["2024-02-03", "2024-02-03", "2024-02-03", "2024-02-03", "2024-12-31", "soon", "", None, "1-2/3"]


def test_settled_keeps_filters_above(spark):
    df = settled(spark.range(4), x=F.regexp_replace(F.col("id").cast("string"), "1", "z")).filter("x <> 'z'")
    assert plan(df).count("regexp_replace") == 1 and df.count() == 3 and df.columns == ["id", "x"]


def test_contained_does_not_shuffle_substrings_for_few_needles(spark):
    hay = spark.range(2000).select(F.concat(F.lit("a-C"), (F.col("id") % 9).cast("string"), F.lit("X-"), F.col("id").cast("string")).alias("text"))
    log = spark.range(2000).select(F.concat(F.lit("C"), (F.col("id") % 7).cast("string"), F.lit("X")).alias("needle"), F.repeat(F.lit("pad"), 50).alias("pad"))
    out = facts.contained(hay, log.select("needle").distinct(), "text", "needle")
    assert out.count() == sum(1 for i in range(2000) if i % 9 < 7)
    assert "needle" in out.columns and plan(out).count("Aggregate") <= 2  # distinct texts, none over substrings


def test_sheet_frames_hold_no_text_aggregate_for_each_place(spark):
    cells = spark.createDataFrame([("f", "s", 1, 2, " 77 "), ("f", "s", 1, 2, "12"), ("f", "s", 2, 8, "x"), ("f", "s", 7, 5, "FP"), ("f", "t", 99, 1, "z"), (None, None, 99, 1, None)],
                                  "file string, sheet string, row int, col int, value string")
    frames = reports.sheet_frames(cells)
    rows = {r.sheet: r for r in frames.collect()}
    assert set(rows) == {"s", "t", None} and rows["s"].rider == "77" and rows["s"].circuit == "X" and rows["t"].rider is None
    assert [(g.row, g.col, g.value) for g in rows["s"].grid] == [(7, 5, "FP")] and rows["t"].grid == []
    assert "max(CASE" not in plan(frames)


def test_thirds_move_only_what_they_rank(spark, tmp_path, monkeypatch):
    seen = []
    real = pace.pace.thirds
    monkeypatch.setattr(pace.pace, "thirds", lambda df, *a: (seen.append(df.columns), real(df, *a))[1])
    pace.thirds(spark, "/root/testdata/sf0.001")
    assert sorted(seen[0]) == ["lap_no", "run", "session", "t"]


def test_merged_columns_are_written_before_they_are_read_twice(spark, monkeypatch):
    seen = []
    real = merge.named_runs
    monkeypatch.setattr(merge, "named_runs", lambda df, order: (seen.append(df), real(df, order))[1])
    merged.committed(spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in plan(seen[0])


@pytest.mark.parametrize("name", ["bundle_dynamics", "bundle_lap_suspension", "bundle_corner_phases"])
def test_bundle_files_are_read_once(spark, tmp_path, monkeypatch, name):
    """What goes to the detectors is read from files that are opened once per table, however often it is used."""
    folder = tmp_path / "R03_PLACE" / "P-1-0.MES"
    folder.mkdir(parents=True)
    (folder / "P-1-0.DDD").write_bytes(b"[00A1]\r\n3=0,0,0,3F800000,0,0,3F800000\r\n4=SPEED_FRONT,x\r\n6=0,I,0,C01\r\n")
    (folder / "P-1-0.C01").write_bytes(b"\x01\x00" * 30)
    (folder / "P-1-0.HED").write_bytes(b"Rider=DA77\r\n[MASS]\r\nBike=166\r\n[GENERAL]\r\nCircuit=PLACE\r\nSession=fp\r\nDate=01/02/2024")
    monkeypatch.setattr(bundles, "recorded", lambda spark, d: str(tmp_path))
    for owner, f in ((bundles.dynamics, "run_dynamics"), (bundles.ph, "lap_suspension"), (bundles.ph, "corner_phases")):
        monkeypatch.setattr(owner, f, lambda *given: given)
    given = [x for x in getattr(bundles, name)(spark, "") if hasattr(x, "schema")]
    assert len(given) == (4 if name == "bundle_dynamics" else 3)
    assert [x.count() for x in given] == [30, 1, 1, 1][:len(given)]
    assert not [x for x in given if "RelationV2" in plan(x) or "bundle" in plan(x)]


def test_recordings_are_numbered_once(spark, tmp_path):
    """Channel files, catalogs, headers and lap files come from one pass over the events."""
    kinds = ["view", "click", "error", "signup", "purchase"]
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i % 3, kinds[i // 3 % 5], at + datetime.timedelta(seconds=i), float(i)) for i in range(90)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    files = bundles.recorded_files(spark, str(tmp_path))
    assert "Window" not in plan(files)
    names = sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect())
    assert len(names) == 3 * 9 + 2 * 3 + 2 and names[:3] == ["P-0-0.C01", "P-0-0.C02", "P-0-0.C03"] and "P-2-0.LAP" not in names


def test_tyres_are_levelled_in_one_pass(spark):
    """Both tyres together, a run with one of them, one in kPa, and a run with too few values."""
    levels = {("a", "F"): [1.5] * 10 + [1.8] * 20 + [2.1] * 10, ("a", "R"): [100 * x for x in [1.2] * 10 + [9.0] * 5 + [1.4] * 10], ("b", "F"): [2.0] * 3, ("c", "R"): [0.9] * 4}
    rows = [(run, c, i, i * 10, x) for (run, c), xs in levels.items() for i, x in enumerate(xs)]
    samples = spark.createDataFrame(rows, "run string, channel string, idx long, ts_us long, value double")
    roles = spark.createDataFrame([(run, "tyre_" + c.lower(), c) for run, c in levels], "run string, role string, channel string")
    out = dynamics.tyre_levels(samples, roles, ["tyre_f", "tyre_r"], dynamics.Limits())
    assert out.columns == ["run", *[f"{t}_{c}" for t in ("tyre_f", "tyre_r") for c in ("start", "end", "avg", "delta")]]
    assert sorted(map(tuple, out.collect())) == [("a", 1.5, 2.1, 1.8, 0.6, 1.2, 1.4, 1.3, 0.2), ("c", None, None, None, None, 0.9, 0.9, 0.9, 0.0)]
    assert plan(out).count("row_number") == 0 and plan(out).count("Window") <= 1  # of the medians


def test_small_bundle_files_are_spread_over_tasks(monkeypatch):
    """Opening costs more than reading a small file, so not thousands of them go to one task."""
    found = {f"/x/{i}": (bundle_format.Bundle(str(i), "x", {"DDD": (f"/x/{i}.DDD", 500), "C01": (f"/x/{i}.C01", 2000)}), {}) for i in range(2000)}
    monkeypatch.setattr(bundle_format.Reading, "listing", lambda self: found)
    for table in ("samples", "channels"):
        pieces = bundle_format.Reading({"path": "/x"}, table).pieces(lambda *_: True)
        assert len(pieces) >= 4 and sorted(b.run for p in pieces for b, _ in p.work) == sorted(str(i) for i in range(2000))
