"""Session factory, the shared scratch area used to cut lineage, and the package as workers see it."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_SHIPPED: set[str] = set()


def build_session(app: str = "laplens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder, else one in its warehouse."""
    configured = spark.conf.get(CHECKPOINT_CONF, "") or ""
    return configured.rstrip("/") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def hold(df: DataFrame, label: str = "held", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages see one fixed copy,
    also after an executor is lost. ``options`` go to the Parquet writer."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.held_path = path
    return back


def release(*held: DataFrame) -> None:
    """Delete held tables that nothing reads any more."""
    for df in held:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.held_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Give the workers this package, for functions that run in Python there. Once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(sc._temp_dir) / "laplens-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
