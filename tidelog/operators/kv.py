"""Versioned key-value views of a log: point reads, byte-order scans, sessions, folds, CAS.

Columns: ``key``, ``value``, ``expiry`` (ticks, 0 = never), ``seq``, ``is_tombstone``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.log import as_of, current, dead_prefix, newest, superseded
from tidelog.operators.ordered import has_hot_key, running_sum
from tidelog.timebase import expired, expiry_of

__all__ = ["as_of", "current", "dead_prefix", "newest", "superseded"]


def put(rows: DataFrame, now: int, ttl: str | None = None) -> DataFrame:
    """Log records for puts; ``ttl`` names a column of ticks."""
    return rows.withColumn("expiry", expiry_of(now, F.col(ttl)) if ttl else F.lit(0).cast("long")).withColumn("is_tombstone", F.lit(False))


def delete(keys: DataFrame, view: DataFrame) -> DataFrame:
    """(key, existed): each key to delete, and whether the live view held it."""
    return keys.select("key").distinct().join(view.select("key", F.lit(True).alias("existed")), "key", "left").select("key", F.coalesce("existed", F.lit(False)).alias("existed"))


def tombstones(keys: DataFrame, log: DataFrame, first_seq: int) -> DataFrame:
    """Log records that delete keys, one a key, at consecutive addresses."""
    from tidelog.operators.log import dense_index

    numbered = dense_index(keys.select("key").distinct(), ["key"], first_seq, "seq")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields if f.name not in ("key", "seq", "is_tombstone", "expiry")]
    return numbered.select("key", *empty, F.lit(0).cast("long").alias("expiry"), "seq", F.lit(True).alias("is_tombstone")).select(log.columns)


def get(view: DataFrame, key) -> DataFrame:
    """The live value of a key with its address; no row is a miss."""
    return view.where(F.col("key") == F.lit(key)).select("key", "value", "seq")


def get_into(view: DataFrame, key, room: int) -> DataFrame:
    """As get, but a value longer than ``room`` bytes is a miss, too."""
    return get(view, key).where(F.octet_length(F.col("value").cast("string")) <= room)


def get_many(view: DataFrame, keys: DataFrame) -> DataFrame:
    return view.join(keys.select("key").distinct(), "key")


def get_at(log: DataFrame, seq: int, now: int | None = None) -> DataFrame:
    """The version at an address, whatever the key holds now; a tombstone or an expired
    version is a miss."""
    out = log.where((F.col("seq") == seq) & ~F.col("is_tombstone"))
    return out.where(~expired(F.col("expiry"), now)) if now is not None else out


def count(log: DataFrame) -> DataFrame:
    """Index entries: newest records that are no tombstones, expired ones included."""
    return current(log, ["key"]).agg(F.count(F.lit(1)).alias("entries"))


# -- scans in raw byte order


def byte_key(key: Column) -> Column:
    """Sort key of a long's little-endian bytes: hex digits, byte pairs swapped.  Integer
    keys scan in this order, which isn't numeric."""
    h = F.lpad(F.hex(key), 16, "0")
    return F.concat(*(F.substring(h, i, 2) for i in range(15, 0, -2)))


def byte_key_of(key: int) -> str:
    return (key & (1 << 64) - 1).to_bytes(8, "little").hex().upper()


def has_prefix(key: Column, prefix: bytes, n: int) -> Column:
    """Whether the first n bytes of a binary key are the prefix's; n = 0 holds for all."""
    return F.lit(True) if n == 0 else F.substring(key, 1, n) == F.lit(prefix[:n])


def scan_prefix(view: DataFrame, prefix: int, n: int) -> DataFrame:
    """Live entries with integer keys whose first n raw bytes are the prefix's, in byte order."""
    out = view.withColumn("byte_key", byte_key(F.col("key")))
    if n:
        out = out.where(F.col("byte_key").startswith(byte_key_of(prefix)[: 2 * n]))
    return out.orderBy("byte_key").select("key", "value", "expiry", "seq")


def scan_range(view: DataFrame, start: int, end: int) -> DataFrame:
    """Live entries [start, end) in byte order."""
    out = view.withColumn("byte_key", byte_key(F.col("key")))
    return out.where((F.col("byte_key") >= byte_key_of(start)) & (F.col("byte_key") < byte_key_of(end))).orderBy("byte_key").select("key", "value", "expiry", "seq")


# -- sessions


def overlay(*layers: DataFrame) -> DataFrame:
    """What a session reads: of each key the record of the first layer that has one
    (staged batch, own writes, shared view); a tombstone there is a miss."""
    out = None
    for rank, layer in enumerate(layers):
        one = layer.withColumn("_rank", F.lit(-rank))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("key").agg(F.max_by(F.struct(*layers[0].columns), F.struct("_rank", "seq")).alias("r")).select("r.*").where(~F.col("is_tombstone"))


def last_wins(batch: DataFrame, pos: str = "pos") -> DataFrame:
    """Of an atomic batch the last record of each key."""
    return newest(batch, ["key"], pos)


def valid_upserts(rows: DataFrame, valid: Column) -> DataFrame:
    return rows.where(valid)


def read_with(view: DataFrame, **outputs: Column) -> DataFrame:
    return view.select("key", *(c.alias(n) for n, c in outputs.items()))


# -- folds


def increments(deltas: DataFrame, keys: list[str], spread: bool | None = None) -> DataFrame:
    """The value after every increment, in ``seq`` order; integer overflow is an error.
    ``spread`` deals keys that are too large for one task over ranges of addresses; if it is not
    given, a count of the keys' rows decides."""
    if has_hot_key(deltas, keys) if spread is None else spread:
        return running_sum(deltas, keys, ["seq"], F.col("delta"), "after")
    by = W.partitionBy(*keys).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return deltas.withColumn("after", F.sum("delta").over(by))


def increment_totals(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """The final value of each key; partial sums, so hot keys don't matter.  A NaN result
    of doubles is an error."""
    total = F.sum("delta")
    if dict(deltas.dtypes)["delta"] == "double":
        total = F.when(F.isnan(total), F.raise_error(F.lit("the score is not a number")).cast("double")).otherwise(total)
    return deltas.groupBy(*keys).agg(total.alias("value"))


class Functions:
    """A read-modify-write fold: override ``initial`` and ``update`` (and ``valid``).

    A fold that doesn't depend on the order of inputs may override ``merge`` of two states as
    well: then every task folds its own rows first, and only states are shuffled.  One that is a
    built-in aggregate returns it from ``aggregate``, and no Python runs at all."""

    #: merge(a, b) of two states; None if the fold depends on the order.
    merge = None

    def aggregate(self) -> Column | None:
        return None

    def initial(self, key, value):
        raise NotImplementedError

    def update(self, state, key, value):
        raise NotImplementedError

    def valid(self, key, value) -> bool:
        return True


#: States that a task holds before it passes them on.
_STATES = 100_000


def _folded(initial, update, valid, whole: bool = False):
    """A mapInPandas function: states by key of a task's rows, passed on when there are many.
    With ``whole``, rows are sorted by key, and each key comes out once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        last = None
        for pdf in batches:
            for k, v in zip(pdf["key"], pdf["value"], strict=True):
                if whole and last != k and len(states) >= _STATES:
                    yield pd.DataFrame(list(states.items()), columns=["key", "value"])
                    states = {}
                last = k
                if valid(k, v):
                    states[k] = initial(k, v) if k not in states else update(states[k], k, v)
            if not whole and len(states) >= _STATES:
                yield pd.DataFrame(list(states.items()), columns=["key", "value"])
                states = {}
        if states:
            yield pd.DataFrame(list(states.items()), columns=["key", "value"])

    return run


def read_modify_write(inputs: DataFrame, functions: Functions, schema: T.DataType) -> DataFrame:
    """(key, value): each key's inputs folded in ``seq`` order.  Sorted partitions are
    streamed, so a key's inputs are never held at once.  ``Functions`` says how folds that
    do not depend on the order avoid the sort and the shuffle of all inputs."""
    built_in = functions.aggregate()
    if built_in is not None:
        return inputs.groupBy("key").agg(built_in.cast(schema).alias("value"))
    key_type = inputs.schema["key"].dataType
    if functions.merge is not None:
        states = T.StructType([T.StructField("key", key_type), T.StructField("value", schema)])
        partial = inputs.select("key", "value").mapInPandas(_folded(functions.initial, functions.update, functions.valid), states)
        always = lambda k, v: True
        return partial.repartition("key").sortWithinPartitions("key").mapInPandas(_folded(lambda k, v: v, lambda s, k, v: functions.merge(s, v), always, whole=True), states)
    out_schema = T.StructType([T.StructField("key", key_type), T.StructField("value", schema)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, None, False
        for pdf in batches:
            done = []
            for k, v in zip(pdf["key"], pdf["value"], strict=True):
                if begun and k != key:
                    done.append((key, state))
                if not begun or k != key:
                    key, begun, state = k, True, None
                if functions.valid(k, v):
                    state = functions.initial(k, v) if state is None else functions.update(state, k, v)
            if done:
                yield pd.DataFrame(done, columns=["key", "value"])
        if begun:
            yield pd.DataFrame([(key, state)], columns=["key", "value"])

    return inputs.select("key", "seq", "value").repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, out_schema)


def fold(inputs: DataFrame, initial: Column, update: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column], bits: int = 16) -> DataFrame:
    """The same inside the engine: inputs are folded by ranges of 2**bits addresses, and the
    ranges' states, in order, by ``combine``, so no array is longer than a range's inputs or
    a key's ranges.  ``initial`` must be neutral: combine(initial, x) is x."""

    def ordered(rows: DataFrame, keys: list[str], f: Callable[[Column, Column], Column]) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"])
        return rows.groupBy(*keys).agg(F.aggregate(items, initial, f).alias("value"))

    near = ordered(inputs.withColumn("_r", F.shiftright("seq", bits)), ["key", "_r"], update).withColumnRenamed("_r", "seq")
    near = ordered(near.withColumn("_r", F.shiftright("seq", bits)), ["key", "_r"], combine).withColumnRenamed("_r", "seq")
    return ordered(near, ["key"], combine)


def compare_and_swap(attempts: DataFrame, by: str = "address") -> DataFrame:
    """Attempts (key, seq, expected, value), in order: one succeeds iff the key's current
    address (or value) is the expected one; null expects absence.  Each key is a serial
    fold over its sorted attempts, streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, begun = None, None, False
        for pdf in batches:
            won = []
            for k, seq, expected, value in zip(pdf["key"], pdf["seq"], pdf["expected"], pdf["value"], strict=True):
                if not begun or k != key:
                    key, now, begun = k, None, True
                ok = (pd.isna(expected) and now is None) or (now is not None and not pd.isna(expected) and expected == now)
                if ok:
                    now = seq if by == "address" else value
                won.append(ok)
            yield pdf.assign(success=won)

    schema = T.StructType([*attempts.schema.fields, T.StructField("success", T.BooleanType())])
    return attempts.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, schema)


# -- change feed


def watch(log: DataFrame, after: int, prefix: tuple[int, int] | None = None, begin: int | None = None) -> DataFrame:
    """Changes at addresses above ``after``: (key, kind, seq), once each, in address order.
    Expiry is no event.  Watching from below ``begin``, the log's start, is an error."""
    if begin is not None and after < begin - 1:
        raise ValueError(f"address {after} lies before the log's begin {begin}")
    out = log.where(F.col("seq") > after)
    if prefix and prefix[1]:
        out = out.where(byte_key(F.col("key")).startswith(byte_key_of(prefix[0])[: 2 * prefix[1]]))
    return out.select("key", F.when(F.col("is_tombstone"), F.lit("delete")).otherwise(F.lit("put")).alias("kind"), "seq").orderBy("seq")
