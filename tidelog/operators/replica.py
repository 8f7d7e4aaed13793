"""Comparing replicas, failure detection, hybrid clocks and id allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.numeric import normal_tail
from tidelog.operators.ordered import has_hot_key, running_sum
from tidelog.timebase import floor_div


def block_checksums(rows: DataFrame, key: str, per_block: int, columns: list[str]) -> DataFrame:
    """(block, checksum): an order-free sum of row hashes by block of keys."""
    return rows.groupBy(floor_div(F.col(key), per_block).alias("block")).agg(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("checksum"))


def merkle_level(blocks: DataFrame, fan: int = 64) -> DataFrame:
    """(block, checksum) of the level above: each parent hashes its children in order."""
    ordered = F.array_sort(F.collect_list(F.struct("block", "checksum")))  # fan items at most
    return blocks.groupBy(floor_div(F.col("block"), fan).alias("parent")).agg(F.xxhash64(F.transform(ordered, lambda s: F.concat_ws(":", s["block"].cast("string"), s["checksum"].cast("string"))).cast("string")).alias("h")).select(F.col("parent").alias("block"), F.col("h").cast("decimal(38,0)").alias("checksum"))


def merkle_root(blocks: DataFrame, levels: int, fan: int = 64) -> DataFrame:
    """The one checksum (block 0) that ``levels`` of parents leave of fewer than fan**levels blocks."""
    for _ in range(levels):
        blocks = merkle_level(blocks, fan)
    return blocks


def block_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks whose checksums differ or that only one side has."""
    right = b.select("block", F.col("checksum").alias("_other"))
    both = a.join(right, "block", "full_outer")
    return both.where(~F.col("checksum").eqNullSafe(F.col("_other"))).select("block")


def pull_differences(peer: DataFrame, key: str, per_block: int, diff: DataFrame) -> DataFrame:
    """The peer's rows in differing blocks alone."""
    return peer.withColumn("block", floor_div(F.col(key), per_block)).join(diff, "block", "left_semi").drop("block")


def gap_statistics(beats: DataFrame, window: int = 12) -> DataFrame:
    """(node, last, n, mean, sd) of the last ``window`` gaps between beats (node, at)."""
    by = W.partitionBy("node").orderBy(F.desc("at"))
    # the 13 last times hold 12 gaps; equal times are alike, so ties decide nothing
    gaps = beats.select("node", "at", F.row_number().over(by).alias("back")).where(F.col("back") <= window + 1)
    gaps = gaps.withColumn("gap", F.col("at") - F.lead("at").over(by))
    few = gaps.where(F.col("back") <= window)
    return few.groupBy("node").agg(F.max("at").alias("last"), F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sd"))


def phi_accrual(beats: DataFrame, now: int, window: int = 12, least: int = 3) -> DataFrame:
    """(node, phi): -log10 of the chance that a beat comes later than now; 0 below
    ``least`` gaps.  A deviation of 0 counts as 1, and as 0.3 of the mean at least."""
    s = gap_statistics(beats, window)
    sd = F.greatest(F.when(F.coalesce("sd", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("sd")), 0.3 * F.col("mean"))
    tail = F.greatest(normal_tail((F.lit(now) - F.col("last") - F.col("mean")) / sd), F.lit(1e-300))
    return s.select("node", F.when(F.col("n") < least, F.lit(0.0)).otherwise(-F.log10(tail)).alias("phi"))


def hybrid_clock(events: DataFrame, now: str = "now") -> DataFrame:
    """(physical, logical) after each local event of a node, in ``seq`` order.  The clock starts
    at (0, 0): a later wall time sets (now, 0), any other counts the logical part up."""
    local = events.withColumns({"remote_physical": F.lit(None).cast("long"), "remote_logical": F.lit(None).cast("long")})
    return hybrid_receive(local, now).drop("remote_physical", "remote_logical")


def hybrid_receive(messages: DataFrame, now: str = "now") -> DataFrame:
    """(physical, logical) after each event (node, seq, now, remote_physical, remote_logical;
    null for local ones) of clocks that start at (0, 0).

    The physical part is the greatest time seen so far.  Where it rises, the logical part is the
    remote one plus 1 if the remote time is that greatest, else 0; where it stays, it is the
    greater of its own and the remote logical part (however old the remote time is) plus 1.
    Within the run of events that share a physical part that is a running maximum: the k-th is
    k plus the greatest of the first and of each remote part less the events before it."""
    by = W.partitionBy("node").orderBy("seq")
    seen = messages.withColumn("physical", F.max(F.greatest(now, F.coalesce("remote_physical", F.lit(0)), F.lit(0))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("node", "physical").orderBy("seq")
    # events before this one at the same physical part; the state (0, 0) counts at 0
    seen = seen.withColumn("_k", F.row_number().over(run).cast("long") - F.when(F.col("physical") == 0, 0).otherwise(1))
    rises = F.when(F.col("remote_physical") == F.col("physical"), F.col("remote_logical").cast("long") + 1).otherwise(F.lit(0).cast("long"))
    stays = F.greatest(F.col("remote_logical").cast("long") - (F.col("_k") - 1), F.when(F.col("physical") == 0, F.lit(0).cast("long")))
    least = F.when(F.col("_k") == 0, rises).otherwise(stays)
    top = F.max(least).over(run.rowsBetween(W.unboundedPreceding, 0))
    return seen.withColumn("logical", F.col("_k") + top).drop("_k")


def allocate_ids(requests: DataFrame, n: Column, spread: bool | None = None) -> DataFrame:
    """(first_id, last_id) of contiguous blocks by key, in ``seq`` order, ids from 1; a
    request for fewer than 1 is an error.  ``spread`` deals hot keys over ranges; if it is not
    given, a count of the keys' rows decides."""
    bad = F.raise_error(F.lit("an id block needs a count of 1 or more")).cast("long")
    r = requests.withColumn("_n", F.when(n < 1, bad).otherwise(n.cast("long")))
    end = F.sum("_n").over(W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    ended = running_sum(r, ["key"], ["seq"], F.col("_n"), "last_id") if (has_hot_key(requests, ["key"]) if spread is None else spread) else r.withColumn("last_id", end)
    return ended.withColumn("first_id", F.col("last_id") - F.col("_n") + 1).drop("_n")


def poll(feed: DataFrame, watermark: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(commands, new watermark): entries above the watermark; all kinds advance it, only
    commands are replayed."""
    some = feed.where(F.col("idx") > watermark)
    if limit is not None:
        some = some.orderBy("idx").limit(limit)
    return some.where("kind = 'command'"), some.agg(F.coalesce(F.max("idx"), F.lit(watermark)).alias("watermark"))


def apply_commands(commands: DataFrame) -> DataFrame:
    """The state that a replicated log of (idx, key, kind, value) commands leaves: puts and
    deletes by key, in index order."""
    from tidelog.operators.log import newest

    return newest(commands, ["key"], "idx").where("kind != 'delete'").select("key", "value", "idx")
