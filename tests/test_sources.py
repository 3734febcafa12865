"""Logger files on disk, sheets, sinks and keyed writes."""

import struct

import numpy as np
from pyspark.sql import functions as F

from laplens.operators import facts
from laplens.sources import bundle, sinks, tables


def write_bundle(root, name, laps=(90_000, 180_000), n=50):
    folder = root / "R03_PLACE" / f"{name}.MES"
    folder.mkdir(parents=True)
    (folder / f"{name}.HED").write_bytes("Rider=first\r\n[MASS]\r\nBike=165\r\nDate=old\r\n[GENERAL]\r\nDate=25.1127\r\nNote=\xe9=x\r\n".encode("latin-1"))
    (folder / f"{name}.DDD").write_bytes(b"[00A1]\r\n3=100,0,0,3F000000,0,0,00000000\r\n4=SPEED,km/h\r\n6=0,I,0,S01\r\n"
                                         b"[00A2]\r\n3=0,0,0,3F800000,0,0,3F800000\r\n4=PRESS,bar\r\n6=0,U,0,P01\r\n")
    (folder / f"{name}.S01").write_bytes(np.arange(-10, n - 10, dtype="<i2").tobytes())
    (folder / f"{name}.P01").write_bytes(np.array([0, 65535], dtype="<u2").tobytes() + b"\x01")
    (folder / f"{name}.LAP").write_bytes(struct.pack(f"<{3 + len(laps)}I", len(laps), 0, 0, *laps))
    return folder


def test_bundle_from_disk(spark, tmp_path):
    write_bundle(tmp_path, "D1-X-03")
    folder = write_bundle(tmp_path, "D1-X-04", laps=())
    (folder / "D1-X-04.LAP").write_bytes(b"\x01")
    files = bundle.find_bundles(spark, str(tmp_path)).cache()
    assert {r.parent for r in files.select("parent").collect()} == {"R03_PLACE"}
    catalog = bundle.read_catalog(files)
    speed = catalog.filter("channel = 'SPEED' and run = 'D1-X-03'").first()
    assert (speed.ext, speed.offset, speed.scale, speed.mult, speed.signed) == ("S01", 100, 0.5, 1.0, True)
    samples = bundle.read_samples(files, catalog).filter("run = 'D1-X-03'").orderBy("channel", "idx").collect()
    assert [r.value for r in samples if r.channel == "SPEED"] == [(i - 110) * 0.5 for i in range(50)]
    assert [r.value for r in samples if r.channel == "PRESS"] == [0.0, 65535.0]
    assert [(r.lap_no, r.end_ms) for r in bundle.read_laps(files).orderBy("lap_no").collect()] == [(0, 90_000), (1, 180_000)]
    head = bundle.header_columns(bundle.read_header(files), {"date": "Date", "bike": "MASS.Bike", "mass_date": "MASS.Date", "rider": "Rider", "note": "Note"})
    row = head.filter("run = 'D1-X-03'").first()
    assert (row.date, row.bike, row.mass_date, row.rider, row.note) == ("25.1127", "165", "old", "first", "é=x")
    flat = {r.key: r.value for r in bundle.flat_header(bundle.read_header(files)).filter("run = 'D1-X-03'").collect()}
    assert flat["Date"] == "25.1127" and flat["Bike"] == "165"
    assert [(r.run, r.reason) for r in bundle.damaged(files).collect()] == [("D1-X-04", "lap file too short")]


def test_long_and_cut_off_lap_files(spark, tmp_path):
    write_bundle(tmp_path, "A", laps=[1000 * i for i in range(1, 301)])
    (write_bundle(tmp_path, "B") / "B.LAP").write_bytes(struct.pack("<4I", 5, 0, 70, 1000))
    files = bundle.find_bundles(spark, str(tmp_path), "*.LAP")
    laps = bundle.read_laps(files).collect()
    assert {r.run for r in laps} == {"A"} and max(r.lap_no for r in laps) == 299
    assert [(r.run, r.reason) for r in bundle.damaged(files).collect()] == [("B", "fewer laps than announced")]
    listing = bundle.find_bundles(spark, str(tmp_path), "*.DDD", content=False)
    assert {r.ext for r in listing.collect()} == {"DDD"} and "content" not in listing.columns


def test_sheet_with_title_block(spark, tmp_path):
    (tmp_path / "s.csv").write_text("TITLE,,\nRUN,Name,Name\n1,a,b\n2.0,c,\n,,\nx,d,e\n")
    df = tables.read_sheet(spark, str(tmp_path / "s.csv"), header_row=2)
    assert df.columns == ["RUN", "Name", "Name_2"] and df.count() == 3
    assert [r.RUN for r in tables.run_log(df, "RUN").orderBy("RUN").collect()] == [1, 2]


def test_rows_equal_to_the_title_stay(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(f"RUN,Name\n1,{name}\nRUN,Name\n2,{name}\n")
    rows = sorted(map(tuple, tables.read_sheet(spark, str(tmp_path)).collect()))
    assert rows == sorted([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b"), ("RUN", "Name"), ("RUN", "Name")])


def test_sinks_count_and_dry_run(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    path = str(tmp_path / "t")
    assert sinks.write_table(df, path, valid="id <> 3", dry_run=True) == {"written": 9, "failed": 1}
    assert not (tmp_path / "t").exists()
    for _ in range(2):
        assert sinks.write_table(df, path, partition_by=["p"], rename={"id": "ID"}, valid="id <> 3") == {"written": 9, "failed": 1}
    assert spark.read.parquet(path).count() == 9


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 1)], "k int, v string, o int")
    once = facts.upsert(old, new, ["k"], "o")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "y", 3), (3, "z", 1)]
    assert sorted(map(tuple, facts.upsert(once, new, ["k"], "o").collect())) == sorted(map(tuple, once.collect()))


def test_containment_against_brute_force(spark):
    hay = ["ABCDEF", "XXABX", "", "é-ASSEN-1", "AB"]
    pins = ["AB", "ASSEN", "F", "ZZZ", "ABCDEFG", "é"]
    got = facts.contained(spark.createDataFrame([(h,) for h in hay], "t string"), spark.createDataFrame([(p,) for p in pins], "p string"), "t", "p")
    assert sorted(map(tuple, got.select("t", "p").collect())) == sorted((h, p) for h in hay for p in pins if p in h)
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def test_folded_duplicates_keep_the_larger_id(spark):
    df = spark.createDataFrame([("Ann", 1), ("ANN ", 3), ("bob", 2)], "name string, id int")
    assert sorted(r.id for r in facts.drop_folded_duplicates(df, "name", F.col("id")).collect()) == [2, 3]
