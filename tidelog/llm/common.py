"""Helpers of the subpackage: written tables, folds, fresh names, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import settled as written

__all__ = ["written"]

#: Rows of one Arrow batch that a Python step gets at most; texts may be long.
BATCH_ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(1))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Arrow and Parquet batches of at most BATCH_ROWS rows in this session, which bounds what a
    task holds of long texts: outside the heap, in its Python worker, and in the vectors that
    the Parquet reader fills (a batch of its usual 4,096 texts is one array of tens of MB)."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Gives back what a finished step held on the driver: freed memory of this process, and, by a
    collection in the JVM, the broadcasts and shuffle files of plans that are gone, which Spark
    otherwise keeps until its next collection, half an hour later at most."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a C library of another kind
        ctypes.CDLL(None).malloc_trim(0)
    spark._jvm.System.gc()


def keep_freed() -> None:
    """Lets this process keep up to 64 MB that it frees, for its next arrays, instead of giving
    pages back and having them cleared again for every array of megabytes."""
    with contextlib.suppress(OSError, AttributeError):  # a C library of another kind
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """fn over df's Arrow batches."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()
