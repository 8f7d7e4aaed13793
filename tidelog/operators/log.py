"""The append-only record log: scans, gathers, replay, and the current view derived from it.

A log has key column(s), ``seq`` (the address), ``is_tombstone`` and values.  Everything
else in this package is a derivation that can be rebuilt from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import settled
from tidelog.timebase import expired

FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def scan(log: DataFrame, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Records of [begin, end), tombstones included, for the consumer to apply."""
    out = log
    if begin is not None:
        out = out.where(F.col("seq") >= begin)
    if end is not None:
        out = out.where(F.col("seq") < end)
    return out


def gather(log: DataFrame, addresses: DataFrame, on: str = "seq") -> DataFrame:
    """Records at the listed addresses; the optimiser broadcasts the list if its measured
    size allows, else joins by shuffle."""
    return log.join(addresses.select(on).distinct(), on, "left_semi")


def gather_sorted(log: DataFrame, addresses: DataFrame) -> DataFrame:
    """Records at the listed addresses in address order, the order in which files hold them."""
    return gather(log, addresses).orderBy("seq")


#: An index batch of at most so many rows is sent to the log; a larger one is merged with it.
NESTED_ROWS = 100_000


def gather_by_size(index: DataFrame, log: DataFrame) -> tuple[DataFrame, str]:
    """(records of an index batch, ``nested`` or ``merge``): a counted small batch is broadcast, so
    the log is read where it lies; beyond ``NESTED_ROWS`` both sides are sorted and merged."""
    few = len(index.select("seq").take(NESTED_ROWS + 1)) <= NESTED_ROWS
    side = F.broadcast(index.select("seq").distinct()) if few else index.select("seq").distinct().hint("merge")
    return log.join(side, "seq", "left_semi"), "nested" if few else "merge"


def gather_in_key_order(index: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """An index batch (key, seq) with its records, in key order."""
    return index.select(key, "seq").join(log.drop(key), "seq").orderBy(key, "seq")


def read_at(log: DataFrame, seq: int) -> DataFrame:
    """The record at one address; the filter reaches the scan's row-group statistics."""
    return log.where(F.col("seq") == seq)


def replay(log: DataFrame, start: int, folds: dict[str, Column], checksum: str | None = None) -> DataFrame:
    """Entry count and folds over all records from an address; with ``checksum``, a record
    whose crc32 of ``value`` differs stops the replay with an error."""
    some = scan(log, start)
    if checksum:
        bad = F.crc32("value") != F.col(checksum)
        some = some.where(F.when(bad, F.raise_error(F.concat(F.lit("checksum differs at "), F.col("seq").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    return some.agg(F.count(F.lit(1)).alias("entries"), *(c.alias(n) for n, c in folds.items()))


def newest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The newest record of each key, whatever it is; partial aggregation keeps one
    record a key and task before the shuffle.  Columns of fixed width are aggregated one by
    one, which hashes instead of sorting; addresses are unique, so all come from one record."""
    rest = [c for c in log.columns if c not in keys]
    if all(isinstance(log.schema[c].dataType, FIXED_WIDTH) for c in rest):
        picks = [F.max(order).alias(c) if c == order else F.max_by(c, order).alias(c) for c in rest]
        return log.groupBy(*keys).agg(*picks).select(log.columns)
    row = F.max_by(F.struct(*log.columns), F.col(order))
    return log.groupBy(*keys).agg(row.alias("_r")).select("_r.*")


def current(log: DataFrame, keys: list[str], now: int | None = None) -> DataFrame:
    """The live record of each key: a newest tombstone or expired record hides older ones."""
    out = newest(log, keys)
    if "is_tombstone" in log.columns:
        out = out.where(~F.col("is_tombstone"))
    if now is not None and "expiry" in log.columns:
        out = out.where(~expired(F.col("expiry"), now))
    return out


def as_of(log: DataFrame, keys: list[str], seq: int, now: int | None = None) -> DataFrame:
    """The current view at an earlier address."""
    return current(log.where(F.col("seq") <= seq), keys, now)


def refresh(view: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The newest-record view (tombstones kept) after more of the log: equals a rebuild."""
    return newest(view.unionByName(delta), keys)


def superseded(log: DataFrame, keys: list[str]) -> DataFrame:
    """Records that the current view no longer needs."""
    return log.join(current(log, keys).select("seq"), "seq", "left_anti")


def dead_prefix(log: DataFrame, keys: list[str], now: int | None = None) -> DataFrame:
    """One row (new_begin, reclaimed): the oldest live address, and how many records lie
    below it; without a live record everything is reclaimed."""
    live = current(log, keys, now).agg(F.min("seq").alias("m"))
    last = log.agg((F.max("seq") + 1).alias("tail"))
    begin = live.crossJoin(last).select(F.coalesce("m", "tail").alias("new_begin"))  # one row each
    below = log.select("seq").crossJoin(F.broadcast(begin)).agg(F.count_if(F.col("seq") < F.col("new_begin")).alias("reclaimed"))
    return begin.crossJoin(below)


def compact(log: DataFrame, keys: list[str], path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """The log rewritten without superseded records, or those of [begin, end), as a table of its
    own that readers may switch to; views derived from it are the same.  Tombstones go too if
    the whole log is rewritten; in a range they may still hide what lies outside it."""
    live = newest(log.select(*keys, "seq", "is_tombstone"), keys)
    inside = F.lit(True)
    if begin is None and end is None:
        live = live.where(~F.col("is_tombstone"))
    if begin is not None:
        inside = inside & (F.col("seq") >= begin)
    if end is not None:
        inside = inside & (F.col("seq") < end)
    kept = log.where(inside).join(live.select("seq"), "seq", "left_semi").unionByName(log.where(~inside))
    kept.select(log.columns).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def reclaim(log: DataFrame, path: str, head: int | None = None, tail: int | None = None, hole: tuple[int, int] | None = None) -> DataFrame:
    """The log rewritten without what lies below ``head``, at or above ``tail``, or in the half-open
    range ``hole``."""
    kept = log
    if head is not None:
        kept = kept.where(F.col("seq") >= head)
    if tail is not None:
        kept = kept.where(F.col("seq") < tail)
    if hole is not None:
        kept = kept.where((F.col("seq") < hole[0]) | (F.col("seq") >= hole[1]))
    kept.write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def fold_records(log: DataFrame, start: int, handler, schema) -> DataFrame:
    """A replay handler's rows: ``handler(iterator of record dicts)`` yields rows of ``schema`` for the
    records of one range of addresses, in order; ranges are handled beside each other."""
    import pandas as pd

    ranged = scan(log, start).repartitionByRange("seq").sortWithinPartitions("seq")
    names = ranged.columns

    def run(batches):
        def records():
            for pdf in batches:
                for values in pdf.itertuples(index=False, name=None):
                    yield dict(zip(names, values, strict=True))

        rows: list = []
        for row in handler(records()):
            rows.append(row)
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return ranged.mapInPandas(run, schema)


def dense_index(df: DataFrame, order: list[str], start: int = 1, name: str = "idx") -> DataFrame:
    """Numbers rows from ``start`` without gaps in the given order, in parallel: a range
    exchange orders partitions, and each adds the count of those before it."""
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return ranged.withColumn("_p", part).join(F.broadcast(before), "_p").select(*df.columns, place.alias(name))
