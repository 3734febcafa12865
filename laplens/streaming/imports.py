"""Incremental imports: file streams that add only keys not stored before.

Every micro-batch writes the first row of each of its keys to a ``batch=N`` folder of its own, in overwrite mode, so a
batch that is run again after a failure replaces itself. No batch reads what others stored. :func:`imported` merges the
batches by key, so the answer is the same however the files were dealt to batches; :func:`compact` folds them into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from laplens.operators.ordered import keep_one
from laplens.session import hold, release

COMPACTED = -1  # batch number of the folded rows


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream over the files of a table: a folder of part files or one file."""
    path = path.rstrip("/")
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern, because a plain path must be a folder
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(either)


def import_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str,
               every: str | None = None) -> StreamingQuery:
    """Store the first row of each key, by ``order``. ``every`` polls at an interval; without it the files present are
    processed and the query ends."""
    # an empty folder makes the table readable before the first batch
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{target}/batch={COMPACTED}")

    def store(batch: DataFrame, number: int) -> None:
        keep_one(batch, keys, F.col(order), latest=False).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def imported(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """What has been imported: one row per key, the first by ``order`` over all batches."""
    return keep_one(spark.read.parquet(target).drop("batch"), keys, F.col(order), latest=False)


def compact(spark: SparkSession, target: str, keys: list[str], order: str) -> None:
    """Fold all batches into one. To be run between runs of the import. The folded rows are stored before the batches are
    emptied, so a failure on the way leaves repeated rows at worst, which :func:`imported` merges."""
    stored = spark.read.parquet(target)
    batches = [r["batch"] for r in stored.select("batch").distinct().collect() if r["batch"] != COMPACTED]  # one per batch
    folded = hold(imported(spark, target, keys, order), "compacted")
    folded.write.mode("overwrite").parquet(f"{target}/batch={COMPACTED}")
    for number in batches:
        folded.limit(0).write.mode("overwrite").parquet(f"{target}/batch={number}")
    release(folded)


def new_rows(stream: DataFrame, keys: list[str], event_time: str | None = None, expiry: str | None = None) -> DataFrame:
    """Rows of ``stream`` whose key has not come before, by keyed state that survives restarts. Without ``expiry`` a key is
    remembered for good. With one (such as ``"7 days"`` of ``event_time``) the state stays bounded: a key is forgotten after
    it, and rows later than it are dropped, as Spark's watermark says."""
    if expiry is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, expiry).dropDuplicatesWithinWatermark(keys)


def digest_new(stream: DataFrame, target: str, checkpoint: str, keys: list[str], who: str, submitter: str, order: str,
               notify: Callable[[DataFrame, int], None] | None = None, every: str | None = None, **state) -> StreamingQuery:
    """Store a digest of what each batch newly brought, per ``who`` and ``submitter``; no batch reads what others stored.

    A batch that is run again replaces its own digest. ``notify(digest, number)`` is called in arrival order for batches that
    brought something new only, perhaps again after a failure, always with the digest as stored. Nulls among keys are equal to
    each other. ``state`` goes to :func:`new_rows`."""
    spark = stream.sparkSession
    parts = lambda df: df.groupBy(who, submitter).agg(F.count(F.lit(1)).alias("arrived"), F.min(order).alias("first_id"))
    empty = parts(spark.createDataFrame([], stream.schema))
    empty.write.mode("ignore").parquet(f"{target}/batch={COMPACTED}")  # makes the digests readable before the first batch

    def store(batch: DataFrame, number: int) -> None:
        parts(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if notify:
            stored = digest_of(spark.read.schema(empty.schema).parquet(f"{target}/batch={number}"), who, submitter)
            if not stored.isEmpty():
                notify(stored.orderBy("first_id"), number)

    writer = new_rows(stream, keys, **state).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def digest_of(parts: DataFrame, who: str, submitter: str) -> DataFrame:
    """One digest from the stored parts of one or all batches: arrived, submitters and first arrival per ``who``."""
    return parts.groupBy(who).agg(F.sum("arrived").alias("arrived"), F.countDistinct(submitter).alias("submitters"), F.min("first_id").alias("first_id"))


def submission_digest(pending: DataFrame, who: str, submitter: str, order: str) -> DataFrame:
    """Counts of newly arrived submissions per group, with the first arrival."""
    return pending.groupBy(who).agg(F.count(F.lit(1)).alias("arrived"), F.countDistinct(submitter).alias("submitters"),
                                    F.min(order).alias("first_id"))
