"""Hashes, sets and sorted sets by domain, as views of tables with one row a field or member."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.ordered import has_hot_key, running_sum

# -- any collection


def lookup(view: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Fields, members or scores of the wanted (domain, ...) rows that exist."""
    return view.join(wanted.select(*keys).distinct(), keys)


def exists(view: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows with ``present``."""
    return wanted.join(view.select(*keys, F.lit(True).alias("present")).distinct(), keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def domain(view: DataFrame, d: int) -> DataFrame:
    return view.where(F.col("domain") == d)


def cardinality(view: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """(domain, n); domains that are asked for but unknown have 0."""
    n = view.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return n if domains is None else domains.select("domain").distinct().join(n, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("n"))


def domains(view: DataFrame) -> DataFrame:
    return view.select("domain").distinct().orderBy("domain")


def stats(view: DataFrame, size: Column, written: str, ttl: int | None = None) -> DataFrame:
    """(domain, n, bytes, last_write, expires) of every domain."""
    last = F.max(written)
    return view.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), last.alias("last_write"), (last + ttl if ttl is not None else F.lit(None).cast("long")).alias("expires"))


def live_domains(view: DataFrame, written: str, now: int, ttl: int) -> DataFrame:
    """Members of domains whose last write is at most ``ttl`` old."""
    dead = view.groupBy("domain").agg(F.max(written).alias("_w")).where(F.lit(now) - F.col("_w") > ttl)
    return view.join(dead.select("domain"), "domain", "left_anti")


def truncate_domain(view: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped)."""
    return view.where(F.col("domain") != d), view.where(F.col("domain") == d)


def upsert(view: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new view, rows that are new): of repeated keys the last ``seq`` wins."""
    once = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
    fresh = once.join(view.select(*keys), keys, "left_anti")
    both = view.unionByName(once).groupBy(*keys).agg(F.max_by(F.struct(*view.columns), "seq").alias("r")).select("r.*")
    return both, fresh


def remove(view: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new view, rows that existed)."""
    gone = rows.select(*keys).distinct()
    return view.join(gone, keys, "left_anti"), gone.join(view.select(*keys), keys, "left_semi")


# -- set algebra over domains


def union(view: DataFrame, ids: list[int]) -> DataFrame:
    """Distinct members of any number of domains; of none, nothing."""
    return view.where(F.col("domain").isin(ids) if ids else F.lit(False)).select("member").distinct()


def intersect(view: DataFrame, a: int, b: int) -> DataFrame:
    return domain(view, a).select("member").intersect(domain(view, b).select("member"))


def difference(view: DataFrame, a: int, b: int) -> DataFrame:
    return domain(view, a).select("member").subtract(domain(view, b).select("member"))


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


# -- sorted sets; ties in score go by member, ascending


def checked_scores(rows: DataFrame) -> DataFrame:
    """A score that is NaN is an error; -0.0 becomes 0.0."""
    bad = F.raise_error(F.lit("the score is not a number")).cast("double")
    return rows.withColumn("score", F.when(F.isnan("score"), bad).when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score")))


def rank_range(view: DataFrame, start: int, stop: int, reverse: bool = False, spread: bool | None = None) -> DataFrame:
    """Members of ranks [start, stop] of every domain, with ``rank``; negative ranks count
    from the end.  The size of a domain comes from the same window partition, so there is
    one shuffle.  ``spread`` ranks domains that are too large for one task by ranges of
    scores; if it is not given, a count of the domains' members decides.  Ranks from the front
    need neither: tasks keep their own first members."""
    order = [F.desc("score"), F.desc("member")] if reverse else ["score", "member"]
    front = start >= 0 and stop >= 0
    if (not front and has_hot_key(view, ["domain"])) if spread is None else spread:
        ranked = running_sum(view, ["domain"], order, F.lit(1), "_r").withColumn("rank", (F.col("_r") - 1).cast("int")).drop("_r")
        sizes = view.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"))
        low = F.greatest(F.lit(0), F.lit(start) if start >= 0 else F.col("_n") + start)
        high = F.lit(stop) if stop >= 0 else F.col("_n") + stop
        return ranked.join(sizes, "domain").where((F.col("rank") >= low) & (F.col("rank") <= high)).drop("_n").select(*view.columns, "rank")
    number = F.row_number().over(W.partitionBy("domain").orderBy(*order))
    if front:  # a plain limit on row numbers, so that tasks drop rows before the shuffle
        few = view.withColumn("_r", number).where((F.col("_r") <= stop + 1) & (F.col("_r") > start))
        return few.withColumn("rank", F.col("_r") - 1).drop("_r")
    rank = number - 1
    n = F.count(F.lit(1)).over(W.partitionBy("domain"))
    low = F.greatest(F.lit(0), F.lit(start) if start >= 0 else F.col("_n") + start)
    high = F.lit(stop) if stop >= 0 else F.col("_n") + stop
    return view.withColumn("_n", n).withColumn("rank", rank).where((F.col("rank") >= low) & (F.col("rank") <= high)).drop("_n")


def score_range(view: DataFrame, low: float, high: float) -> DataFrame:
    """Members with scores in [low, high], by domain, score and member."""
    if low != low or high != high:
        raise ValueError("a bound is not a number")
    return view.where(F.col("score").between(low, high)).orderBy("domain", "score", "member")


def score_count(view: DataFrame, low: float, high: float) -> DataFrame:
    if low != low or high != high:
        raise ValueError("a bound is not a number")
    return view.groupBy("domain").agg(F.count_if(F.col("score").between(low, high)).alias("n"))


def pop(view: DataFrame, k: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): the k lowest, or highest, of every domain."""
    out = rank_range(view, 0, k - 1, reverse=highest)
    return out, view.join(out.select("domain", "member"), ["domain", "member"], "left_anti")
