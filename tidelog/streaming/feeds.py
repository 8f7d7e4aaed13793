"""Streams over logs: change feeds, rollups behind a watermark, deduplication, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Day 0 of Unix time is day 719162 from 0001-01-01.
_UNIX_DAY = 719_162


def changes(spark: SparkSession, path: str, schema, after: int = 0, files_per_batch: int | None = None) -> DataFrame:
    """The version log as a stream of (key, kind, seq) above an address; the checkpoint of
    the query resumes it.  File listing and reading are Spark's, from any store."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    log = r.parquet(path).where(F.col("seq") > after)
    return log.select("key", F.when(F.col("is_tombstone"), F.lit("delete")).otherwise(F.lit("put")).alias("kind"), "seq")


def window_offset(days: int) -> str:
    """startTime of windows of so many days, so that they are multiples from 0001-01-01."""
    return f"{(-_UNIX_DAY) % days} days"


def rollup(samples: DataFrame, width: str, delay: str, offset: str = "0 seconds") -> DataFrame:
    """(series_id, window and the seven aggregates) of every tumbling window of a stream
    (series_id, ts timestamp, seq, value); first and last go by time, then address, if there is
    one.  Rows later than ``delay`` are dropped by Spark, so split them off first
    (``split_late``) where they must not be."""
    w = F.window("ts", width, width, offset)
    v = F.col("value")
    order = F.struct("ts", "seq") if "seq" in samples.columns else F.col("ts")
    out = samples.withWatermark("ts", delay).groupBy("series_id", w.alias("w")).agg(
        F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v)).alias("min"), F.max(v).alias("max"), F.sum(v).alias("sum"), F.count(F.lit(1)).alias("count"),
        F.avg(v).alias("avg"), F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"),
    )
    return out.select("series_id", F.col("w.start").alias("window"), "min", "max", "sum", "count", "avg", "first", "last")


def deduplicated(messages: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """First of each key within the watermark, which bounds the state."""
    return messages.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def split_late(trimmed: Callable[[SparkSession], DataFrame], accept: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]):
    """A foreachBatch function: rows below their series' boundary go to ``late``, the
    others to ``accept``; both get the batch id, to write each batch once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        marked = batch.join(trimmed(batch.sparkSession), "series_id", "left").withColumn("_late", F.coalesce(F.col("ts") < F.col("trimmed_until"), F.lit(False))).persist()
        accept(marked.where("not _late").drop("_late", "trimmed_until"), batch_id)
        late(marked.where("_late").drop("_late", "trimmed_until"), batch_id)
        marked.unpersist()

    return run


def write_once(path: str):
    """A foreachBatch function that writes each batch to a folder of its own and replaces
    it if the batch runs again, so that every batch counts once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def above_watermark(read: Callable[[], int], write: Callable[[int], None], apply: Callable[[DataFrame], None]):
    """A foreachBatch function for a federated feed (idx, kind, ...): entries up to the
    stored index are skipped, commands are applied, every kind advances the index."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.where(F.col("idx") > read())
        top = fresh.agg(F.max("idx").alias("m")).first()["m"]
        if top is not None:
            apply(fresh.where("kind = 'command'"))
            write(top)

    return run
