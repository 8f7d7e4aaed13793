"""Write-ahead logs and blobs as tables: dense indexes, truncation, snapshots, chunks.

WAL entries: ``idx`` (from 1, dense), ``payload``, ``is_meta``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.log import dense_index
from tidelog.operators.series import fingerprint


def append(wal: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries with contiguous indexes after the log's last, from 1 in an empty log."""
    last = wal.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("_last"))  # one row
    numbered = dense_index(entries, order, 1, "idx").crossJoin(F.broadcast(last))
    return numbered.withColumn("idx", F.col("idx") + F.col("_last")).drop("_last")


def commit(entries: DataFrame, path: str) -> DataFrame:
    """Writes appended entries as one job, which takes effect as a whole, and returns the log."""
    entries.write.mode("append").parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def read_from(wal: DataFrame, start: int, head: int | None = None, limit: int | None = None) -> DataFrame:
    """Entries from an index on, embedded metadata left out; below the head is an error,
    beyond the tail is nothing.  Reading stops before the first invalid entry, if the log
    has a ``valid`` column."""
    if head is not None and start < head:
        raise ValueError(f"index {start} lies before the head {head}")
    out = wal.where(F.col("idx") >= start)
    if "valid" in wal.columns:
        bad = out.where(~F.col("valid")).agg(F.min("idx").alias("bad"))
        out = out.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("idx") < F.col("bad"))).drop("bad")  # one row
    if "is_meta" in wal.columns:
        out = out.where(~F.col("is_meta"))
    out = out.orderBy("idx")
    return out if limit is None else out.limit(limit)


def truncate_suffix(wal: DataFrame, tail: int) -> DataFrame:
    return wal.where(F.col("idx") <= tail)


def truncate_prefix(wal: DataFrame, head: int) -> DataFrame:
    return wal.where(F.col("idx") >= head)


def persisted(wal: DataFrame, index: int) -> DataFrame:
    """One row: whether an index is committed."""
    return wal.agg((F.coalesce(F.max("idx"), F.lit(0)) >= index).alias("persisted"))


def snapshot(wal: DataFrame, upto: int, path: str) -> DataFrame:
    """Writes entries up to an index as a snapshot with a manifest; returns the rest."""
    wal.where(F.col("idx") <= upto).write.mode("overwrite").parquet(f"{path}/entries")
    fingerprint(wal.sparkSession.read.schema(wal.schema).parquet(f"{path}/entries")).withColumn("upto", F.lit(upto)).write.mode("overwrite").parquet(f"{path}/manifest")
    return truncate_prefix(wal, upto + 1)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """A snapshot's entries; an error if they don't fit the manifest."""
    entries = spark.read.schema(schema).parquet(f"{path}/entries")
    if fingerprint(entries).first() != spark.read.parquet(f"{path}/manifest").select("rows", "checksum").first():
        raise ValueError(f"the snapshot at {path} is damaged")
    return entries.orderBy("idx")


def copy_snapshot(spark: SparkSession, source: str, target: str, schema) -> None:
    """Export or import: a verified copy."""
    entries = read_snapshot(spark, source, schema)
    entries.write.mode("overwrite").parquet(f"{target}/entries")
    spark.read.parquet(f"{source}/manifest").write.mode("overwrite").parquet(f"{target}/manifest")
    read_snapshot(spark, target, schema)


def newest_version(meta: DataFrame, name: str = "name") -> DataFrame:
    """Versioned metadata: of each slot the payload of the highest version."""
    return meta.groupBy(name).agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))


# -- blobs: object_id, length, created, state (0 live, 1 tombstone), content


def blob_list(blobs: DataFrame, start: int = 0, end: int = 0, tombstones: bool = False) -> DataFrame:
    """Objects of [start, end) in address order, end = 0 for no bound; content isn't read."""
    out = blobs.where(F.col("object_id") >= start)
    if end:
        out = out.where(F.col("object_id") < end)
    if not tombstones:
        out = out.where("state = 0")
    return out.select("object_id", "length", "created", "state").orderBy("object_id")


def blob_get(blobs: DataFrame, object_id: int) -> DataFrame:
    return blobs.where((F.col("object_id") == object_id) & (F.col("state") == 0)).select("object_id", "content")


def blob_stat(blobs: DataFrame, object_id: int) -> DataFrame:
    return blobs.where(F.col("object_id") == object_id).select("object_id", "length", "created", "state")


def blob_range(blobs: DataFrame, object_id: int, offset: int, n: int) -> DataFrame:
    """Bytes [offset, offset + n) of an object."""
    return blob_get(blobs, object_id).select("object_id", F.substring("content", offset + 1, n).alias("content"))


def blob_stats(blobs: DataFrame) -> DataFrame:
    dead = F.col("state") != 0
    return blobs.agg(
        F.count_if(~dead).alias("active"), F.count_if(dead).alias("tombstones"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("used_bytes"), F.coalesce(F.sum(F.when(dead, F.col("length"))), F.lit(0)).alias("reclaimable_bytes"),
    )


def blob_delete(blobs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("object_id", F.lit(1).cast("tinyint").alias("_dead")).distinct()
    return blobs.join(gone, "object_id", "left").withColumn("state", F.coalesce("_dead", "state")).select(blobs.columns)


def blob_reclaim(blobs: DataFrame) -> DataFrame:
    return blobs.where("state = 0")


def hole_ratio(extents: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """(segment, hole_ratio): 1 - live / total bytes, of segments [begin, end) if given; 0 where a
    segment has no bytes."""
    if begin is not None:
        extents = extents.where(F.col("segment") >= begin)
    if end is not None:
        extents = extents.where(F.col("segment") < end)
    total = F.sum("total_bytes")
    return extents.groupBy("segment").agg(F.when(total > 0, 1 - F.sum("live_bytes") / total).otherwise(F.lit(0.0)).alias("hole_ratio"))


def chunks(blobs: DataFrame, size: int) -> DataFrame:
    """(object_id, chunk, data, crc): contents in frames with checksums.  The frames are cut into an
    array first, so a content isn't copied into each of their rows."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk"), F.substring("content", i * size + 1, F.lit(size)).alias("data")))
    each = blobs.select("object_id", F.explode(cut).alias("c"))
    return each.select("object_id", "c.chunk", "c.data").withColumn("crc", F.crc32("data"))


def put_blob(blobs: DataFrame, contents: DataFrame, now: int) -> DataFrame:
    """blobs with new objects of ``contents`` (name, content), numbered after the last one."""
    last = blobs.agg(F.coalesce(F.max("object_id"), F.lit(0)).alias("_last"))  # one row
    new = dense_index(contents.select("name", "content"), ["name"], 1, "_n").crossJoin(F.broadcast(last))
    rows = {"object_id": F.col("_last") + F.col("_n"), "length": F.octet_length("content").cast("long"), "created": F.lit(now).cast("long"), "state": F.lit(0), "content": F.col("content")}
    kinds = dict(blobs.dtypes)
    return blobs.unionByName(new.select(*(rows[c].cast(kinds[c]).alias(c) for c in blobs.columns)))


def assemble(parts: DataFrame) -> DataFrame:
    """(object_id, content) of verified chunks, joined as bytes; a checksum that differs is an
    error.  An object must fit one row, as any value does."""
    bad = F.raise_error(F.concat(F.lit("checksum differs in object "), F.col("object_id").cast("string"))).cast("binary")
    good = parts.withColumn("data", F.when(F.crc32("data") == F.col("crc"), F.col("data")).otherwise(bad))
    return good.groupBy("object_id").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY chunk)").alias("content"))
