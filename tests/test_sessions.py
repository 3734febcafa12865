"""Sessions from bundles on disk: what the header, the log, the name and the lap file each decide."""

import struct

import pytest
from pyspark.sql import functions as F

from laplens.operators import sessions
from laplens.sources import bundle


def record(root, event, name, head=None, log=None, laps=None):
    folder = root / event / f"{name}.MES"
    folder.mkdir(parents=True)
    if head is not None:
        (folder / f"{name}.HED").write_bytes(head.encode("latin-1"))
    if log is not None:
        (folder / sessions.LOG_FILE).write_bytes(log.encode("latin-1"))
    if laps is not None:
        (folder / f"{name}.LAP").write_bytes(struct.pack(f"<{3 + len(laps)}I", len(laps), 0, 1000, *laps))


@pytest.fixture
def found(spark, tmp_path):
    head = "[GENERAL]\r\nDate=26.0417\r\nCircuit=Template\r\nSession=L1\r\nRider Number=9\r\nFront Tyre=SC1\r\nF Laps=4\r\n[Laptimes]\r\nFastest lap=1:30.000\r\n"
    record(tmp_path, "R03_ASSEN.26", "QP-JA52-04", head, "Path for measurement: C:\\a\\R03_GRAND_HILL.26\\QP-JA52-04.MES", [101_000, 191_500, 282_000])
    record(tmp_path, "R04_MOST.26", "QP-JA52-04", head.replace("Circuit=Template", "Circuit= ").replace("Session", "Event=Most\r\nSession"))
    record(tmp_path, "Tests", "zz", "", "no path here", [5_000])
    return sessions.session_table(bundle.find_bundles(spark, str(tmp_path)))


def test_each_source_in_its_order(found):
    rows = {(r["round"], r["name"]): r for r in found.collect()}
    a, b, c = rows["ROUND3", "QP-JA52-04"], rows["ROUND4", "QP-JA52-04"], rows["TESTS", "zz"]
    assert (a.circuit, a.date, a.session_type, a.rider, a.run_no) == ("GRAND HILL", "2026-04-17", "QP", "JA52", 4)
    assert (a.total_laps, a.best_s, a.avg_s, a.best_lap, a.tyre_f_laps) == (2, 90.5, 90.5, "1:30.500", "4")
    assert (b.circuit, b.total_laps, b.best_s, b.avg_s, b.best_lap, b.laps) == ("MOST", 0, None, None, "1:30.000", None)
    assert (c.circuit, c.date, c.session_type, c.rider, c.run_no, c.total_laps, c.best_lap) == (None, None, "FP", "UNKNOWN", 1, 0, None)


def test_sheets(found):
    laps = sessions.lap_sheet(found).orderBy("circuit", "lap_no").collect()
    assert [(r.circuit, r.lap_no, r.lap_time, r.is_outlap, r.is_best) for r in laps] == [
        (None, 0, "0:04.000", True, False), ("GRAND HILL", 0, "1:40.000", True, False), ("GRAND HILL", 1, "1:30.500", False, True),
        ("GRAND HILL", 2, "1:30.500", False, True)]
    assert sessions.session_sheet(found).columns == sessions.WHO + sessions.SESSION_SHEET
    assert {r.tyre_f for r in sessions.tyre_sheet(found).collect()} == {"SC1", None}


def test_header_picks_equal_header_columns(spark):
    """Odd headers, a key in several sections, keys of a section, and a folder with two headers."""
    texts = ["[GENERAL]\r\nDate = a=b \r\nNote=1\r\n[X]\r\nNote=2\r\nBike=5\r\n[GENERAL]\r\nNote=3\r\n", "Note=first\n [MASS] \nBike=7\nDate=m\n[ MASS]\nBike=8\n=x\nNote\n", "",
             "[X]\nNote=1\n[Y]\nNote=2\n[MASS]\nBike=\nBike= 9\n[not a section] z\nDate=d", "[MASS\nBike=1\r\n\r\n[]\nDate=\u00e9"]
    rows = [(f"/d/{i}.MES/h.HED", t.encode("latin-1")) for i, t in enumerate(texts)]
    rows += [("/d/two.MES/a.HED", b"Date=1\nNote=x"), ("/d/two.MES/b.HED", b"[X]\n\nBike=2")]
    files = bundle.with_parts(spark.createDataFrame(rows, "path string, content binary"))
    keys = {"date": "Date", "note": "Note", "bike": "MASS.Bike", "any_bike": "Bike", "x_note": "X.Note"}
    want = {r.run: r[1:] for r in bundle.header_columns(bundle.read_header(files), keys).collect()}
    picks = bundle.header_picks(files, F.decode("content", "ISO-8859-1"), keys).groupBy("run").agg(*[F.max(c)["value"].alias(c) for c in keys])
    got = {r.run: tuple(r[1:]) for r in picks.collect()}
    assert got == {r: tuple(want.get(r, (None,) * 5)) for r in ("0", "1", "2", "3", "4", "two")} and want["0"][1] == "3"


def test_recorded_files_are_dealt_out(spark, tmp_path):
    """Every task writes files of all kinds, so none has all the headers."""
    from laplens.plans.sessions import recordings

    spark.range(400).selectExpr("id AS o_orderkey", "id % 60 AS o_custkey", "'2-HIGH' AS o_orderpriority", "'O' AS o_orderstatus", "1D AS o_totalprice",
                                "DATE'2020-01-01' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1200).selectExpr("id % 400 AS l_orderkey", "CAST(id div 400 AS INT) AS l_linenumber", "DATE'2020-01-01' AS l_shipdate", "id AS l_partkey", "id AS l_suppkey",
                                 "id + 0.5D AS l_extendedprice", "1D AS l_quantity", "0D AS l_discount", "'N' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    files = recordings(spark, str(tmp_path)).withColumn("part", F.input_file_name())
    kinds = files.groupBy("part").agg(F.countDistinct("ext").alias("n")).collect()
    assert kinds and all(r.n == 3 for r in kinds) and files.count() == 342 + 134 + 400
