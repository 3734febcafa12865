"""File streams add new keys once, over several files, restarts and batch sizes."""

import pytest

from laplens.streaming import imports


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_import_over_files_and_restarts(spark, tmp_path, files_per_batch):
    src, target, progress = (str(tmp_path / n) for n in ("src", "target", "progress"))

    def drop(rows):
        spark.createDataFrame(rows, "k long, v string, o long").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = imports.file_stream(spark, src, "k long, v string, o long", files_per_batch=files_per_batch)
        imports.import_new(stream, target, progress, ["k"], "o").awaitTermination()
        return sorted((r.k, r.v) for r in imports.imported(spark, target, ["k"], "o").collect())

    drop([(1, "late", 5), (1, "first", 1), (2, "b", 1)])
    assert run() == [(1, "first"), (2, "b")]
    drop([(2, "earlier", 0), (3, "late", 4)])
    drop([(3, "c", 2), (4, "d", 1)])
    want = [(1, "first"), (2, "earlier"), (3, "c"), (4, "d")]
    assert run() == want and run() == want
    imports.compact(spark, target, ["k"], "o")
    assert run() == want and spark.read.parquet(target).count() == 4
    drop([(1, "after", 0), (5, "e", 1)])
    assert run() == [(1, "after"), *want[1:], (5, "e")]


@pytest.mark.parametrize("files_per_batch", [1, 1000])
@pytest.mark.parametrize("state", [{}, {"event_time": "t", "expiry": "30 days"}])
def test_digests_hold_each_row_once(spark, tmp_path, files_per_batch, state):
    src, target, progress = (str(tmp_path / n) for n in ("src", "target", "progress"))
    told = []

    def drop(rows):
        df = spark.createDataFrame([(*r, "2026-01-05 00:00:00") for r in rows], "id long, who string, by string, t string")
        df.selectExpr("id", "who", "by", "timestamp(t) AS t").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = imports.file_stream(spark, src, "id long, who string, by string, t timestamp", files_per_batch=files_per_batch)
        imports.digest_new(stream, target, progress, ["id"], "who", "by", "id", notify=lambda df, n: told.append([tuple(r) for r in df.collect()]), **state).awaitTermination()
        return sorted(map(tuple, imports.digest_of(spark.read.parquet(target), "who", "by").collect()))

    drop([(1, "A", "x"), (2, "A", "y"), (2, "A", "y"), (3, "B", "x")])
    assert run() == [("A", 2, 2, 1), ("B", 1, 1, 3)]
    assert told == [[("A", 2, 2, 1), ("B", 1, 1, 3)]]
    assert run() == [("A", 2, 2, 1), ("B", 1, 1, 3)] and len(told) == 1
    drop([(3, "B", "x"), (1, "A", "x")])  # known rows only: stored again by nobody, told to nobody
    assert run() == [("A", 2, 2, 1), ("B", 1, 1, 3)] and len(told) == 1
    drop([(5, "B", "x"), (4, "A", "z")])
    drop([(2, "A", "y")])
    assert run() == [("A", 3, 3, 1), ("B", 2, 1, 3)]
    assert told[1:] == [[("A", 1, 1, 4), ("B", 1, 1, 5)]]
