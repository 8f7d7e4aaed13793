"""Ordered lookups: point finds, seeks, floors and predecessors over any orderable key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import fill_forward


def find(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("key").distinct(), "key")


def seek(index: DataFrame, key, n: int | None = None) -> DataFrame:
    """Entries from the first key at or above ``key``, ascending; n of them."""
    out = index.where(F.col("key") >= F.lit(key)).orderBy("key", "seq")
    return out if n is None else out.limit(n)


def ends(index: DataFrame) -> DataFrame:
    """(min_key, max_key)."""
    return index.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def floor_one(index: DataFrame, key, strict: bool = False) -> DataFrame:
    """The greatest key at or below ``key`` (below it, if strict): one row or none."""
    c = F.col("key") < F.lit(key) if strict else F.col("key") <= F.lit(key)
    return index.where(c).orderBy(F.desc("key"), F.desc("seq")).limit(1)


def floor_many(index: DataFrame, probes: DataFrame, strict: bool = False, group: str | None = None) -> DataFrame:
    """(probe, key, seq) for many probes at once: a forward fill over the merged keys, dealt
    by range, so no task sorts them all."""
    side = (1, 0) if strict else (0, 1)
    a = index.select(*([group] if group else []), F.col("key").alias("k"), F.lit(side[0]).alias("side"), F.struct("key", "seq").alias("hit"), F.col("seq").alias("o"))
    b = probes.select(*([group] if group else []), F.col("probe").alias("k"), F.lit(side[1]).alias("side"), F.lit(None).cast(a.schema["hit"].dataType).alias("hit"), F.lit(None).cast("long").alias("o"))
    both = a.withColumn("is_probe", F.lit(False)).unionByName(b.withColumn("is_probe", F.lit(True)))
    by = [group] if group else []
    out = fill_forward(both.withColumnRenamed("hit", "given"), by, ["k", "side", "o"], "given", "hit")
    return out.where("is_probe").select(*by, F.col("k").alias("probe"), "hit.key", "hit.seq")


def top(items: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows: each task keeps k, the driver merges them."""
    return items.orderBy(*order).limit(k)


def truncate_prefix(index: DataFrame, bound) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) for keys below the bound."""
    return index.where(F.col("key") >= F.lit(bound)), index.where(F.col("key") < F.lit(bound))


def truncate_range(index: DataFrame, low, high) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) for keys of [low, high)."""
    inside = (F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high))
    return index.where(~inside), index.where(inside)
