"""The bundle format, its clock, channel roles and recorded laps."""

import os
import struct
import time
from fractions import Fraction

import numpy as np
import pytest

from laplens.operators import dynamics
from laplens.operators.channels import resolve_channels
from laplens.sources import bundle_format as bf

CATALOG = (b"[00A1]\r\n3=100,0,0,3F000000,0,0,00000000\r\n4=SPEED,km/h\r\n6=0,I,0,S01\r\n[00A2]\r\n3=0,0,0,3F800000,0,0,3F800000\r\n4=PRESS,bar\r\n6=0,U,0,P01\r\n"
           b"[00A3]\r\n4=NOWHERE,x\r\n6=0,I,0,X09\r\n[text]\r\n4=IGNORED\r\n")


def write(root, name, speed, press, laps=(), catalog=CATALOG):
    folder = root / "R03_PLACE" / f"{name}.MES"
    folder.mkdir(parents=True, exist_ok=True)
    if catalog:
        (folder / f"{name}.DDD").write_bytes(catalog)
    (folder / f"{name}.S01").write_bytes(np.array(speed, "<i2").tobytes())
    (folder / f"{name}.P01").write_bytes(np.array(press, "<u2").tobytes() + b"\x01")
    if laps:
        (folder / f"{name}.LAP").write_bytes(struct.pack(f"<{3 + len(laps)}I", len(laps), 0, 0, *laps))
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", [2, 14, 1 << 20])
def test_samples_do_not_depend_on_the_cuts(spark, tmp_path, split):
    write(tmp_path, "A-1", range(-20, 30), range(101), (1_000, 2_000))
    write(tmp_path, "B-2", [], [65535])
    want = [("A-1", "SPEED", i, i * 2_000_000 // 50, (i - 120) * 0.5) for i in range(50)]
    want += [("A-1", "PRESS", i, i * 2_000_000 // 101, float(i)) for i in range(101)] + [("B-2", "PRESS", 0, 0, 65535.0)]
    got = bf.read_bundles(spark, str(tmp_path), splitBytes=split)
    assert rows(got) == sorted(want)
    assert rows(bf.read_bundles(spark, f"file:{tmp_path}", runs=["A-1"], channels=["SPEED", "OTHER"], splitBytes=split)) == want[:50]
    assert bf.read_bundles(spark, str(tmp_path), runs=[]).count() == 0


def test_only_wanted_files_are_opened(tmp_path, monkeypatch):
    for name in ("A-1", "B-2"):
        write(tmp_path, name, range(50), range(50), (1_000,))
    own, root = bf.file_system(str(tmp_path))
    opened = []

    class Watched:
        get_file_info = staticmethod(own.get_file_info)

        def open_input_file(self, path):
            opened.append(os.path.basename(path))
            return own.open_input_file(path)

    monkeypatch.setattr(bf, "file_system", lambda _: (Watched(), root))
    reading = bf.Reading({"path": str(tmp_path), "runs": "A-1", "channels": "SPEED"}, "samples")
    assert sum(b.num_rows for p in reading.pieces(lambda *_: True) for b in reading.rows(p)) == 50
    assert sorted(set(opened)) == ["A-1.DDD", "A-1.LAP", "A-1.S01"]
    opened.clear()
    reading = bf.Reading({"path": str(tmp_path)}, "channels")
    assert sum(b.num_rows for p in reading.pieces(lambda *_: True) for b in reading.rows(p)) == 4
    assert {o.rsplit(".", 1)[1] for o in opened} == {"DDD", "LAP"}


def test_the_clock_is_exact():
    for n_base, last_ms, n in ((1_234_567, 9_876_543, 4_938_269), (100, 1_000, 400), (7, 0, 7), (9, 10_000, 9), (10_000, 1_000, 5_000), (0, 60_000, 3)):
        length = bf.clock_length(n_base, last_ms)
        idx = np.unique(np.r_[0, np.linspace(0, n - 1, 999).astype(np.int64), n - 1])
        assert bf.clock_of(idx, length, n).tolist() == [int(Fraction(int(i) * length, n)) for i in idx]
    assert bf.clock_length(100, 2_000) == 2_000_000  # 50 a second, up to the last lap end
    assert bf.clock_length(9, 10_000) == 900_000 and bf.clock_length(10_000, 1_000) == 20_000_000 and bf.clock_length(7, 0) == 70_000


def test_channels_laps_and_header(spark, tmp_path):
    folder = write(tmp_path, "A-1", range(50), range(200), (1_000, 2_000))
    (folder / "A-1.HED").write_bytes("Rider=first\r\n[MASS]\r\nBike=165\r\nNote=\xe9=x\r\n".encode("latin-1"))
    (write(tmp_path, "B-2", range(50), range(10)) / "B-2.LAP").write_bytes(b"\x01")
    channels = bf.read_bundles(spark, str(tmp_path), "channels")
    assert rows(channels.select("run", "channel", "n_samples", "rate_hz", "clock_us", "folder")) == [
        ("A-1", "PRESS", 200, 100.0, 2_000_000, "R03_PLACE"), ("A-1", "SPEED", 50, 25.0, 2_000_000, "R03_PLACE"),
        ("B-2", "PRESS", 10, 20.0, 500_000, "R03_PLACE"), ("B-2", "SPEED", 50, 100.0, 500_000, "R03_PLACE")]
    laps = bf.read_bundles(spark, str(tmp_path), "laps")
    assert rows(laps) == [("A-1", 0, 0, 1_000), ("A-1", 1, 0, 2_000)]
    assert rows(bf.read_bundles(spark, str(tmp_path), "header").drop("pos")) == [
        ("A-1", "GENERAL", "Rider", "first"), ("A-1", "MASS", "Bike", "165"), ("A-1", "MASS", "Note", "é=x")]
    lengths = channels.filter("channel = 'SPEED'").select("run", "clock_us")
    assert rows(dynamics.recorded_laps(laps, lengths)) == [("A-1", 0, 0, 1_000_000), ("A-1", 1, 1_000_000, 2_000_000), ("B-2", 0, 0, 500_000)]


def test_written_bundles_are_read_again(spark, tmp_path):
    bf.register_bundles(spark)
    files = [(f"/x/y/R01_P/R-1.MES/R-1.{e}", bytearray(c)) for e, c in (("DDD", CATALOG), ("S01", b"\x64\x00\x66\x00"))]
    for _ in range(2):  # written twice, there once
        spark.createDataFrame(files, "path string, content binary").write.format("bundle").mode("append").save(str(tmp_path))
    assert rows(bf.read_bundles(spark, str(tmp_path))) == [("R-1", "SPEED", 0, 0, 0.0), ("R-1", "SPEED", 1, 10_000, 1.0)]
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["R-1.DDD", "R-1.S01"]


def test_streams_take_each_file_once(spark, tmp_path):
    bf.register_bundles(spark)
    root, out = tmp_path / "in", tmp_path / "out"

    def turn():
        time.sleep(0.3)
        q = (spark.readStream.format("bundle").option("settleMs", 200).load(str(root)).writeStream.format("parquet").trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "state")).start(str(out)))
        q.awaitTermination()
        return spark.read.schema(bf.SCHEMAS["samples"]).parquet(str(out)).groupBy("run").count().orderBy("run").collect() if out.exists() else []

    write(root, "A-1", range(5), range(6), (1_000,))
    write(root, "C-3", range(3), [], catalog=None)  # its catalog comes later
    assert turn() == [("A-1", 11)]
    assert turn() == [("A-1", 11)]
    write(root, "B-2", range(7), [])
    (root / "R03_PLACE" / "C-3.MES" / "C-3.DDD").write_bytes(CATALOG)
    assert turn() == [("A-1", 11), ("B-2", 7), ("C-3", 3)]


def test_roles(spark):
    names = ["GAS", "tps", "Tyre_R_Press", "TIRE_LEFT_PRESS_FL", "X_TYRE_PRESS_FRONT", "speed_front", "PRESS_REAR_TIRE_RL"]
    channels = spark.createDataFrame([(1, n) for n in names] + [(2, "TPS")], "run long, channel string")
    assert rows(resolve_channels(channels, ["run"])) == [
        (1, "gas", "GAS"), (1, "speed", "speed_front"), (1, "tyre_f", "TIRE_LEFT_PRESS_FL"), (1, "tyre_r", "Tyre_R_Press"), (2, "gas", "TPS")]
    own = resolve_channels(channels, ["run"], {"any": ["tps", "gas"]}, {"rest": [["FRONT", "REAR"]]})
    assert rows(own) == [(1, "any", "tps"), (1, "rest", "PRESS_REAR_TIRE_RL"), (2, "any", "TPS")]
