"""Running sums and forward fills in a global order, in parallel however large a group is.

A window puts each group, or without groups the whole table, into one task.  Here rows are
dealt by ranges of (group, order), each range works on its own, and what a range needs from
those before it (a sum, or a last value, for each group that goes on) is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.session import settled

_BEFORE = (W.unboundedPreceding, -1)
#: More rows of one key than this do not go through one task.
HOT_ROWS = 5_000_000


def has_hot_key(df: DataFrame, keys: list[str], most: int | None = None) -> bool:
    """Whether a key has more rows than one task should sort: a count with partial sums, of
    which one row at most reaches the driver."""
    most = HOT_ROWS if most is None else most
    counts = df.groupBy(*keys) if keys else df.groupBy(F.lit(1))
    return bool(counts.count().where(F.col("count") > most).take(1))


def _ranged(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Written with the range's number, which grows with the order; equal keys share one."""
    return settled(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def _carried(ranged: DataFrame, per_range: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """ranged with the columns of per_range (a row for each group and range) beside it.  Ranges
    follow each other in the order of groups, so only the first group of a range goes on from
    the one before: the rows that carry anything are fewer than the ranges, and are broadcast."""
    names = {g: f"_g{i}" for i, g in enumerate([*group, "_p"])}
    goes_on = F.row_number().over(W.partitionBy(*group).orderBy("_p")) > 1
    right = per_range.withColumn("_on", goes_on).where("_on").select(*(F.col(g).alias(n) for g, n in names.items()), *columns)
    same = None
    for g, n in names.items():
        c = ranged[g].eqNullSafe(right[n])
        same = c if same is None else same & c
    return ranged.join(F.broadcast(right), same, "left").drop(*names.values())


def running_sum(df: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` up to and with each row, in its group and order."""
    r = _ranged(df.withColumn("_v", value), group, order)
    sums = r.groupBy(*group, "_p").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(W.partitionBy(*group).orderBy("_p").rowsBetween(*_BEFORE))
    inside = F.sum("_v").over(W.partitionBy("_p", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    out = _carried(r.withColumn("_i", inside), sums.withColumn("_b", before), group, ["_b"])
    return out.withColumn(name, F.col("_i") + F.coalesce("_b", F.lit(0))).drop("_v", "_i", "_b", "_p")


def fill_forward(df: DataFrame, group: list[str], order: list, column: str, name: str) -> DataFrame:
    """df with the last value of ``column`` that isn't null, up to and with each row."""
    r = _ranged(df, group, order)
    by = W.partitionBy("_p", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    filled = r.withColumn("_f", F.last(column, ignorenulls=True).over(by))
    # the last of each range, by an aggregate with partial results
    tops = r.groupBy(*group, "_p").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_t"))
    carry = F.last("_t", ignorenulls=True).over(W.partitionBy(*group).orderBy("_p").rowsBetween(*_BEFORE))
    out = _carried(filled, tops.withColumn("_c", carry), group, ["_c"])
    return out.withColumn(name, F.coalesce("_f", "_c")).drop("_f", "_c", "_p")
