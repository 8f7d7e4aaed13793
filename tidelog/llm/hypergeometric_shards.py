"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact sizes.

How many rows of each partition go to each shard is drawn exactly as a uniform random
permutation of all rows would have it: partition after partition takes a multivariate
hypergeometric draw from what the shards still lack.  Each partition then permutes its
rows and deals them out by its line of the matrix; after the exchange every shard
permutes again, in buckets of a random key whose sizes give the slots' offsets, so
neither a shard nor a bucket has to fit one task.

The matrix has a line for each input partition and a column for each shard; the driver
holds nothing that grows with the rows.  A task draws a partition's permutation once and
keeps one or two bytes a row of it; keys come from rows' places, so both take constant
time a row.  The law is ``rows``: shard sizes differ by one
at most.  Defined results: null text has no bytes; null ids and repeated rows are rows as
any other, each with a slot of its own; equal keys go by place; texts are only measured, so
their length costs nothing; an empty table gives no rows; with fewer rows than shards the last shards are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read_table, small_batches, written
from .textvec import mix

SHARDS = 8
#: Rows that one bucket of a shard's second permutation holds, on average.
BUCKET_ROWS = 200_000


def communication_matrix(rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(partition, shard) counts: row sums are ``rows``, column sums differ by one at most."""
    total = int(rows.sum())
    lacking = np.full(shards, total // shards, dtype=np.int64)
    lacking[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for p, n in enumerate(rows):
        n, rest = int(n), int(lacking.sum())
        for s in range(shards - 1):  # one margin after the other
            rest -= int(lacking[s])
            # numpy's hypergeometric takes less than 10**9 of each kind
            k = _hypergeometric(rng, int(lacking[s]), rest, n)
            out[p, s] = k
            n -= k
        out[p, shards - 1] = n
        lacking -= out[p]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good.  The law is exact up to numpy's limit
    of 10**9 of each kind; beyond it, the urn is drawn from in runs of a millionth of it, each
    as with replacement, so a count's variance is right to one part in a million.  Margins,
    and with them all sizes, are exact always."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if n > (good + bad) // 2:  # what is not drawn is a draw, too
        return good - _hypergeometric(rng, good, bad, good + bad - n)
    out = 0
    while n:
        p = good / (good + bad)
        step = min(n, max(1, (good + bad) // 10**6))
        k = int(rng.binomial(step, p)) if step > 1 else int(rng.random() < p)
        k = max(min(k, good), step - bad)
        out, good, bad, n = out + k, good - k, bad - (step - k), n - step
    return out


def keyed(place: np.ndarray, seed: int) -> np.ndarray:
    """A random 62-bit key of each row's place, one to one over the full 64 bits."""
    x = mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return (mix(x) >> np.uint64(2)).astype(np.int64)


def shard(df: DataFrame, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """df with ``shard`` and ``slot`` (from 0 without gaps in each shard); all columns stay."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]  # given anew
    df = df.select(*names)
    kinds = df.schema.fields
    at, key, bucket, low, size = fresh(df, "_at", "_key", "_bucket", "_first", "_size")
    placed = written(df.withColumn(at, F.monotonically_increasing_id()), "dealt")
    part = F.shiftright(at, 33)
    kind = np.uint8 if shards <= 256 else np.uint16 if shards <= 1 << 16 else np.int32
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    rows = np.array([n for _, n in counts], dtype=np.int64)
    sent = df.sparkSession.sparkContext.broadcast(({p: i for i, (p, _) in enumerate(counts)}, communication_matrix(rows, shards, seed)))
    buckets = max(1, int(rows.sum()) // shards // BUCKET_ROWS)


    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, matrix = sent.value
        last, line = None, np.zeros(0, dtype=kind)
        for batch in batches:
            place = batch.column(batch.schema.get_field_index(at)).to_numpy()
            who, pos = place >> 33, place & ((1 << 33) - 1)
            out = np.zeros(len(place), dtype=np.int32)
            for p in np.unique(who).tolist():
                if p != last:  # drawn once a task and partition, a few bytes a row
                    last, line = p, np.random.default_rng((seed, p)).permutation(np.repeat(np.arange(shards, dtype=kind), matrix[where[p]]))
                mine = who == p
                out[mine] = line[pos[mine]]
            yield batch.append_column("shard", pa.array(out)).append_column(key, pa.array(keyed(place, seed)))

    schema = T.StructType([*kinds, T.StructField(at, T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField(key, T.LongType())])
    exchanged = written(placed.mapInArrow(deal, schema).withColumn(bucket, F.pmod(key, F.lit(buckets))), "exchanged")
    sizes = exchanged.groupBy("shard", bucket).agg(F.count("*").alias(size))
    first = F.coalesce(F.sum(size).over(W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", bucket, first.alias(low))
    inside = F.row_number().over(W.partitionBy("shard", bucket).orderBy(key, at)) - 1
    return exchanged.join(offsets, ["shard", bucket]).withColumn("slot", F.col(low) + inside).select(*names, "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    digest = docs.select("doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return shard(digest).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
