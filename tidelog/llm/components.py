"""Connected components of a link table by alternating large-star and small-star steps, and
joins by a key that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import discard, settled_at

from .common import release

#: Keys with more rows than this share of all are hot; there are no more of them than this.
HOT_KEYS = 10_000


#: Rows of links that one file of a round's table holds.
FILE_LINKS = 200_000


def hot_above(rows: int) -> int:
    """More rows of one key than this are hot: at most ``HOT_KEYS`` keys of ``rows`` rows are."""
    return max(100, rows // HOT_KEYS)


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """rows joined to per_key, which has one row a key and, in column ``n``, the number of rows
    of it.  Hot keys' few rows are broadcast (``hot_above`` bounds them), so their rows stay in
    the tasks that read them; all other keys are shuffled.  rows is read twice.  A null key
    matches nothing; empty tables give no rows."""
    per_key = per_key.withColumnRenamed(key, "_hot_key")
    hot = F.broadcast(per_key.where(F.col(n) > most))
    apart = F.broadcast(per_key.where(F.col(n) > most).select("_hot_key"))
    same = F.col(key) == F.col("_hot_key")
    near = rows.join(hot, same)
    rest = rows.join(apart, same, "left_anti").join(per_key.where(F.col(n) <= most).hint("merge"), same)
    return near.unionByName(rest).drop("_hot_key", n)


def connected_components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the component's least
    node.  Each round hangs every node's larger neighbours, then its smaller ones, under
    the least of them, so chains shorten by halves and hubs stay one row per link.  All
    steps are aggregations with partial sums and joins in which a hub's rows stay where they
    are; each round is written and the one before it removed, and only a row count and a hash
    reach the driver.  Links of a node with itself, repeated links and nulls add nothing;
    without links there are no rows."""
    spark = links.sparkSession
    pairs, path = settled_at(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), f"{name}-links")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    state = mark(pairs)
    for _ in range(rounds):
        most = hot_above(2 * state[0])
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_by_key(both, least, "u", "n", most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        files = -(-2 * state[0] // FILE_LINKS) or 1  # a round has no more links than twice those before
        large, between = settled_at(large.coalesce(files), f"{name}-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_by_key(large, down, "u", "n", most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after, next_path = settled_at(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct().coalesce(files), f"{name}-stars")
        now = mark(after)
        discard(spark, path)
        discard(spark, between)
        pairs, path = after, next_path
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    release(spark)
    roots = pairs.select(F.col("v").alias("node")).distinct().join(pairs.select(F.col("u").alias("node")), "node", "left_anti")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
