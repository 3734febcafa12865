"""Column-wise merges, tables committed together, bucketed upserts."""

import pytest
from pyspark.sql import functions as F

from laplens.operators.merge import Source, merge_columns
from laplens.sources import keyed


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_come_from_the_first_source_that_has_them(spark):
    a = spark.createDataFrame([(1, 2, None, "x"), (1, 1, None, None), (1, 10, None, "late"), (2, 1, 5, None), (None, 1, 9, "n")], "k int, at int, v int, t string")
    b = spark.createDataFrame([(1, 1, 7, 1.5), (3, 1, 8, None)], "k int, at int, v int, w double")
    c = spark.createDataFrame([(1, 1, 70, "only c"), (4, 1, 0, "no such run")], "k int, at int, v int, u string")
    got = merge_columns([Source(a, "at"), Source(b, "at"), Source(c, "at", creates=False)], ["k"])
    assert got.columns == ["k", "v", "t", "w", "u"]
    assert rows(got) == rows(spark.createDataFrame([(1, 7, "x", 1.5, "only c"), (2, 5, None, None, None), (3, 8, None, None, None), (None, 9, "n", None, None)],
                                                   "k int, v int, t string, w double, u string"))


def test_tables_appear_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.range(3), spark.range(5)
    assert keyed.read_committed(spark, root) == {}
    assert keyed.commit_tables(spark, root, {"a": one, "b": one}) == 1
    broken = two.withColumn("id", F.expr("CAST(raise_error('broken') AS BIGINT)"))
    with pytest.raises(Exception, match="broken"):
        keyed.commit_tables(spark, root, {"a": two, "b": broken})
    assert {n: t.count() for n, t in keyed.read_committed(spark, root).items()} == {"a": 3, "b": 3}
    assert keyed.commit_tables(spark, root, {"a": two}) == 2  # b stays
    assert {n: t.count() for n, t in keyed.read_committed(spark, root).items()} == {"a": 5, "b": 3}
    assert {n: t.count() for n, t in keyed.read_committed(spark, root, 1).items()} == {"a": 3, "b": 3}


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    keyed.commit_tables(spark, root, {"a": spark.range(1)})
    monkeypatch.setattr(keyed, "versions", lambda *_: [])  # what a writer saw that began before
    with pytest.raises(RuntimeError, match="another writer"):
        keyed.commit_tables(spark, root, {"a": spark.range(9)})
    monkeypatch.undo()
    assert keyed.read_committed(spark, root)["a"].count() == 1


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path, where = tmp_path / "t", str(tmp_path / "t")
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at"))
    keyed.upsert_table(base, where, ["k"], "at", 16)
    before = files(path)
    changes = spark.createDataFrame([(5, "a", 1), (5, "b", 2), (2000, "new", 1)], "k long, v string, at int")
    touched = {r[0] for r in changes.select(keyed.bucket_of(["k"], 16)).collect()}
    plan = keyed.touched_rows(spark, where, changes, ["k"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    for _ in range(2):
        keyed.upsert_table(changes, where, ["k"], "at", 16)
        got = {r.k: r.v for r in keyed.read_keyed(spark, where).collect()}
        assert got == {**{k: "old" for k in range(1000)}, 5: "b", 2000: "new"}
    after = files(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {int(f.split("=")[1].split("/")[0]) for f in before.keys() - same} == touched and len(touched) < 16


def test_upsert_of_nothing(spark, tmp_path):
    where = str(tmp_path / "t")
    base = spark.createDataFrame([(1, "x", 1)], "k long, v string, at int")
    keyed.upsert_table(base, where, ["k"], "at", 4)
    keyed.upsert_table(base.limit(0), where, ["k"], "at", 4)
    assert rows(keyed.read_keyed(spark, where)) == [(1, "x", 1)]
