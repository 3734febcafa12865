"""Stored tables with keys: upserts that touch only their buckets, and several tables replaced together."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laplens.operators.facts import upsert
from laplens.session import hold, release

BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def touched_rows(spark: SparkSession, path: str, source: DataFrame, keys: list[str], buckets: int) -> DataFrame | None:
    """Stored rows of the buckets that ``source`` has keys in: a partition filter of at most ``buckets`` values. None before the first write."""
    if not exists(spark, path):
        return None
    wanted = sorted(r[0] for r in source.select(bucket_of(keys, buckets)).distinct().collect())
    return spark.read.parquet(path).filter(F.col(BUCKET).isin(wanted))


def upsert_table(source: DataFrame, path: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """Rows of ``source`` (latest per key) replace or extend the table at ``path``, which is partitioned by the hash of its keys into ``buckets``.
    Only buckets with keys of ``source`` are read and rewritten. Twice the same source changes nothing; a failure before the last step, which
    renames files, leaves the table as it was. One writer at a time, and always the same ``buckets``."""
    spark = source.sparkSession
    stored = touched_rows(spark, path, source, keys, buckets)
    empty = source.limit(0) if stored is None else stored.drop(BUCKET)
    merged = hold(upsert(empty, source, keys, order).withColumn(BUCKET, bucket_of(keys, buckets)), "upsert")
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    release(merged)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


# -- several tables at once ---------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> list[int]:
    where, fs = _path(spark, root + "/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(where) if s.getPath().getName().isdigit()) if fs.exists(where) else []


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Write all ``tables`` under ``root`` and make them visible together, as a new version. What is not in ``tables`` stays as it was. Until the version's
    list is renamed into place readers see the one before; a second writer of the same version fails."""
    before = versions(spark, root)
    listed = dict(_listed(spark, root, before[-1])) if before else {}
    for name, df in tables.items():
        place = f"{name}/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{root}/{place}")
        listed[name] = place
    version = before[-1] + 1 if before else 1
    parked, fs = _path(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(parked, False)
    out.write(bytearray(json.dumps(listed).encode()))
    out.close()
    final, _ = _path(spark, f"{root}/_versions/{version}")
    if fs.exists(final) or not fs.rename(parked, final):
        raise RuntimeError(f"version {version} of {root} was committed by another writer")
    return version


def _listed(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{root}/_versions/{version}", wholetext=True).first()[0])


def read_committed(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the newest unless told."""
    known = versions(spark, root)
    if not known:
        return {}
    return {name: spark.read.parquet(f"{root}/{place}") for name, place in _listed(spark, root, known[-1] if version is None else version).items()}
