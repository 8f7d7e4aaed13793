"""Time series: ranges, lookups, rollups, statistics and retention.

Columns: ``series_id``, ``ts`` (ticks), ``seq``, ``value``.  Order is (ts, seq): equal times
are all kept, in write order.  Ranges are [from, to).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ordered import fill_forward, has_hot_key
from tidelog.timebase import window_start


def in_range(samples: DataFrame, start: int, end: int, series: int | None = None, trimmed: DataFrame | None = None) -> DataFrame:
    """Samples of [start, end); with ``trimmed`` (series_id, trimmed_until) also only those
    at or after their series' boundary."""
    out = samples.where((F.col("ts") >= start) & (F.col("ts") < end))
    if series is not None:
        out = out.where(F.col("series_id") == series)
    if trimmed is not None:
        out = out.join(trimmed.select("series_id", "trimmed_until"), "series_id", "left").where(F.col("trimmed_until").isNull() | (F.col("ts") >= F.col("trimmed_until"))).drop("trimmed_until")
    return out


def range_ordered(samples: DataFrame, start: int, end: int, series: int, indexed: bool = True) -> DataFrame:
    """One series' samples in time order; in address order if not indexed."""
    return in_range(samples, start, end, series).orderBy(*(["ts", "seq"] if indexed else ["seq"]))


def latest(samples: DataFrame) -> DataFrame:
    """The last sample of each series."""
    return samples.groupBy("series_id").agg(F.max_by(F.struct("ts", "seq", "value"), F.struct("ts", "seq")).alias("r")).select("series_id", "r.*")


def extremes(samples: DataFrame) -> DataFrame:
    """First and last time of each series."""
    return samples.groupBy("series_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def floor(samples: DataFrame, probes: DataFrame, strict: bool = False, spread: bool | None = None) -> DataFrame:
    """For each probe (series_id, t, and any other columns) the last sample at or before t
    (before t, if strict); null if there is none.  A union and one window over (series,
    time), so one shuffle and a sort instead of a range join.  ``spread`` deals series that
    are too large for one task over ranges of time; if it is not given, a count of the series'
    samples decides."""
    others = [c for c in probes.columns if c not in ("series_id", "t")]
    left = samples.select("series_id", F.col("ts").alias("_t"), F.lit(1 if strict else 0).alias("_side"), "seq", F.struct("ts", "seq", "value").alias("_s"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in others))
    right = probes.select("series_id", F.col("t").alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), *others)
    by = W.partitionBy("series_id").orderBy("_t", "_side", "seq").rowsBetween(W.unboundedPreceding, 0)
    both = left.withColumn("_probe", F.lit(False)).unionByName(right.withColumn("_probe", F.lit(True)))
    filled = fill_forward(both, ["series_id"], ["_t", "_side", "seq"], "_s", "_hit") if (has_hot_key(samples, ["series_id"]) if spread is None else spread) else both.withColumn("_hit", F.last("_s", ignorenulls=True).over(by))
    return filled.where("_probe").select("series_id", F.col("_t").alias("t"), *others, F.col("_hit.ts").alias("ts"), F.col("_hit.seq").alias("seq"), F.col("_hit.value").alias("value"))


def _aggregates(value: str) -> dict[str, Column]:
    v, order = F.col(value), F.struct("ts", "seq")
    return {
        # a NaN decides the minimum, as it does the maximum
        "min": F.when(F.max(F.isnan(v)), F.lit(float("nan"))).otherwise(F.min(v)),
        "max": F.max(v),
        "sum": F.sum(v),
        "count": F.count(F.lit(1)).cast("double"),
        "avg": F.avg(v),
        "first": F.min_by(v, order),
        "last": F.max_by(v, order),
    }


AGGREGATES = ("min", "max", "sum", "count", "avg", "first", "last")


def rollup(samples: DataFrame, width: int, start: int | None = None, end: int | None = None, aggregates: tuple[str, ...] = AGGREGATES) -> DataFrame:
    """(series_id, window, one column for each aggregate) of every non-empty window.  The
    scan's filter, a partial aggregation and one shuffle of at most a row a window and task."""
    if width <= 0:
        raise ValueError("the window must be longer than 0")
    if start is not None and end is not None and start >= end:
        samples = samples.limit(0)
    some = samples
    if start is not None:
        some = some.where(F.col("ts") >= start)
    if end is not None:
        some = some.where(F.col("ts") < end)
    known = _aggregates("value")
    return some.groupBy("series_id", window_start("ts", width).alias("window")).agg(*(known[a].alias(a) for a in aggregates))


def as_series(rolled: DataFrame, aggregate: str) -> DataFrame:
    """A rollup as samples again, for the next stage of a cascade; windows are unique, so
    their start also serves as address."""
    return rolled.select("series_id", F.col("window").alias("ts"), F.col("window").alias("seq"), F.col(aggregate).alias("value"))


def write_rollup(rolled: DataFrame, aggregate: str, path: str, mode: str = "append") -> int:
    """Appends (repeats if run again) or replaces the target; returns the windows."""
    seen = Observation()
    rows = as_series(rolled, aggregate).observe(seen, F.count(F.lit(1)).alias("windows"))
    rows.write.mode("overwrite" if mode == "replace" else "append").parquet(path)
    return seen.get["windows"]


def stats(samples: DataFrame, trimmed: DataFrame | None = None) -> DataFrame:
    """first_ts, last_ts, live and boundary by series."""
    out = samples.groupBy("series_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("live"))
    if trimmed is None:
        return out.withColumn("trimmed_until", F.lit(None).cast("long"))
    return out.join(trimmed, "series_id", "full_outer").withColumn("live", F.coalesce("live", F.lit(0)))


def stats_all(samples: DataFrame) -> DataFrame:
    """The whole instance in one row; times are null when it is empty."""
    return samples.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("live"))


def series_ids(samples: DataFrame) -> DataFrame:
    return samples.select("series_id").distinct().orderBy("series_id")


# -- writes and their guards


def admitted(samples: DataFrame, trimmed: DataFrame | None = None, now: int | None = None, max_past: int | None = None, fail: bool = True) -> DataFrame:
    """New samples behind the live guards: a time below its series' boundary, or more than
    ``max_past`` before now, is an error; with fail=False it is marked in ``reject``."""
    out, late = samples, F.lit(None).cast("string")
    if trimmed is not None:
        out = out.join(trimmed.select("series_id", "trimmed_until"), "series_id", "left")
        late = F.when(F.col("ts") < F.col("trimmed_until"), F.lit("trimmed"))
    if now is not None and max_past is not None:
        late = F.coalesce(late, F.when(F.col("ts") < now - max_past, F.lit("too late")))
    out = out.withColumn("reject", late).drop("trimmed_until")
    if not fail:
        return out
    check = F.when(F.col("reject").isNotNull(), F.raise_error(F.concat(F.lit("sample rejected: "), F.col("reject"))).cast("boolean")).otherwise(F.lit(True))
    return out.where(check).drop("reject")


def append(samples: DataFrame, path: str, **guards) -> None:
    """Appends samples that pass the guards; a failing one fails the whole batch."""
    admitted(samples, **guards).write.mode("append").parquet(path)


def import_backup(samples: DataFrame, trimmed: DataFrame, path: str) -> DataFrame:
    """Appends without guards; returns the boundaries pulled back to the imported times."""
    samples.write.mode("append").parquet(path)
    least = samples.groupBy("series_id").agg(F.min("ts").alias("_least"))
    return trimmed.join(least, "series_id", "full_outer").select("series_id", F.least("trimmed_until", "_least").alias("trimmed_until"))


def export(samples: DataFrame, path: str, start: int, end: int, series: list[int] | None = None) -> None:
    """Writes [start, end) by series, in time order inside, with count and checksum."""
    some = in_range(samples, start, end)
    if series is not None:
        some = some.where(F.col("series_id").isin(series))
    some.repartitionByRange("series_id", "ts").sortWithinPartitions("series_id", "ts", "seq").write.mode("overwrite").parquet(f"{path}/samples")
    fingerprint(samples.sparkSession.read.schema(samples.schema).parquet(f"{path}/samples")).write.mode("overwrite").parquet(f"{path}/check")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum), whatever the order and partitions."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def restore(spark, path: str, schema) -> DataFrame:
    """The exported samples; an error if rows or checksum differ."""
    samples = spark.read.schema(schema).parquet(f"{path}/samples")
    if fingerprint(samples).first() != spark.read.parquet(f"{path}/check").select("rows", "checksum").first():
        raise ValueError(f"the export at {path} is damaged")
    return samples


# -- retention


def truncate(samples: DataFrame, before: int, series: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) for a cut of one series, or all, at ``before`` exclusive."""
    cut = F.col("ts") < before
    if series is not None:
        cut = cut & (F.col("series_id") == series)
    return samples.where(~cut), samples.where(cut)


def raise_watermark(trimmed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Boundaries only rise: the greater of the old and the new one of each series."""
    return trimmed.unionByName(cuts).groupBy("series_id").agg(F.max("trimmed_until").alias("trimmed_until"))


def ttl_cutoff(now: int, retention: int) -> int:
    return now - retention


#: Ticks of a day, of a 4096th of it (21 seconds), and of one.
_SCALES = (864_000_000_000, 210_937_500, 1)


def byte_cutoff(sized: DataFrame, budget: int) -> DataFrame:
    """One row (cutoff): the time of the sample that covers the excess over the budget,
    counting from the oldest; no row if there is no excess.  Sizes are summed by day with
    partial sums; of the day that holds the cutoff by 21 seconds; of those by time: each pass
    keeps a few rows a task.  Windows without a partition see a row a day, 4,096 rows, or the
    times of 21 seconds."""
    found = sized.agg((F.sum("bytes") - budget).alias("_excess")).select("_excess", F.lit(0).cast("long").alias("_before"))  # one row
    same = F.lit(True)
    for width in _SCALES:
        start = window_start("ts", width)
        some = sized.join(F.broadcast(found), same)
        sums = some.groupBy(start.alias("_w"), "_excess", "_before").agg(F.sum("bytes").alias("_b"))
        acc = F.sum("_b").over(W.orderBy("_w").rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")
        hit = sums.withColumn("_acc", acc).where((F.col("_excess") > 0) & (F.col("_acc") >= F.col("_excess")))
        found = hit.groupBy("_excess").agg(F.min_by(F.struct("_w", (F.col("_acc") - F.col("_b")).alias("_before")), "_w").alias("_d"))
        found = found.select("_excess", F.col("_d._before").alias("_before"), F.col("_d._w").alias("_at"))
        same = start == F.col("_at")
    return found.select(F.col("_at").alias("cutoff"))


def dense_byte_cutoffs(sized: DataFrame, threshold_seq: int) -> DataFrame:
    """Cutoff of each series whose samples lie below an address: their last time, plus 1."""
    return sized.where(F.col("seq") < threshold_seq).groupBy("series_id").agg((F.max("ts") + 1).alias("cutoff"))


def slow_series_pin(samples: DataFrame, trimmed: DataFrame) -> DataFrame:
    """(series_id, first_live, pin): every series' first surviving address, and the least
    of them, below which space is free."""
    live = in_range(samples, -(1 << 62), 1 << 62, trimmed=trimmed)
    first = live.groupBy("series_id").agg(F.min("seq").alias("first_live"))
    return first.crossJoin(F.broadcast(first.agg(F.min("first_live").alias("pin"))))
