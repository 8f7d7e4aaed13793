"""Rounds over several logs: two-phase commit and its recovery, commit policies, checkpoints,
sessions, leases, watchers and index switches, as derivations of logged events.

Folds that are serial by nature (a lease, a commit policy) run key by key over sorted
partitions, streamed; all else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.kv import overlay
from tidelog.operators.log import newest

# -- two-phase commit


def commit_rounds(votes: DataFrame, participants: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(round, outcome) of rounds with votes (round, participant, vote): ``confirm`` if every one
    of ``participants`` (participant) prepared, else ``abort``.  With ``decisions`` (round,
    granted) of a replicated decider, a prepared round is confirmed only if granted, aborted
    if not, and ``pending`` before the decision."""
    need = participants.agg(F.count_distinct("participant").alias("_need"))  # one row
    ready = votes.where("vote = 'prepared'").join(participants.select("participant").distinct(), "participant", "left_semi")
    have = votes.select("round").distinct().join(ready.groupBy("round").agg(F.count_distinct("participant").alias("_have")), "round", "left")
    refused = votes.where("vote != 'prepared'").select("round", F.lit(True).alias("_no")).distinct()
    judged = have.join(refused, "round", "left").crossJoin(F.broadcast(need))
    all_in = (F.coalesce("_have", F.lit(0)) >= F.col("_need")) & F.col("_no").isNull()
    if decisions is None:
        return judged.select("round", F.when(all_in, "confirm").otherwise("abort").alias("outcome"))
    told = judged.join(decisions.groupBy("round").agg(F.bool_and("granted").alias("_granted")), "round", "left")
    outcome = F.when(~all_in, "abort").when(F.col("_granted").isNull(), "pending").when(F.col("_granted"), "confirm").otherwise("abort")
    return told.select("round", outcome.alias("outcome"))


def reconcile(commits: DataFrame, participants: DataFrame) -> DataFrame:
    """(participant, action, seq) after a crash, from the commit records (seq) and each
    participant's (participant, prepared, committed): one that is behind the last commit confirms
    up to it; one that prepared beyond it aborts; without commits hanging ones abort.  Those that
    agree do not appear."""
    last = commits.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("_last"))  # one row
    p = participants.crossJoin(F.broadcast(last))
    behind = (F.col("_last") > 0) & (F.col("committed") < F.col("_last"))
    ahead = F.when(F.col("_last") > 0, F.col("prepared") > F.col("_last")).otherwise(F.col("prepared") > F.col("committed"))
    action = F.when(behind, "confirm").when(ahead, "abort")
    return p.withColumn("action", action).where("action is not null").select("participant", "action", F.when(behind, F.col("_last")).otherwise(F.col("prepared")).alias("seq"))


def committed_only(log: DataFrame, rounds: DataFrame) -> DataFrame:
    """Records of confirmed rounds, and those of none; what a reader of ``round`` may see."""
    good = rounds.where("outcome = 'confirm'").select("round")
    return log.where("round is not null").join(good, "round", "left_semi").unionByName(log.where("round is null"))


# -- batches and sessions


def finish_batch(log: DataFrame, staged: DataFrame, commit: bool = True) -> DataFrame:
    """The log after a session's atomic batch (key, ..., pos): committed, the last record of each
    key is appended at the addresses after the log's last; aborted, nothing is."""
    if not commit:
        return log
    from tidelog.operators.log import dense_index

    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))  # one row
    new = dense_index(newest(staged, ["key"], "pos"), ["pos"], 1, "_n").crossJoin(F.broadcast(last))
    return log.unionByName(new.withColumn("seq", F.col("_last") + F.col("_n")).select(log.columns))


def session_read(shared: DataFrame, own: DataFrame, level: str = "read_my_writes", begin: int | None = None) -> DataFrame:
    """What a session sees of a version log: at ``none`` the shared records alone; at
    ``read_my_writes`` its own over them; at ``serializable`` its own over those up to ``begin``,
    where it began."""
    if level == "none":
        return newest(shared, ["key"]).where("not is_tombstone")
    if level == "serializable":
        if begin is None:
            raise ValueError("a serializable session needs the address where it began")
        shared = shared.where(F.col("seq") <= begin)
    elif level != "read_my_writes":
        raise ValueError(f"no consistency level {level}")
    return overlay(own, shared)


def read_scope(logs: dict[str, DataFrame], upto: int) -> dict[str, DataFrame]:
    """Every participant's log as of one address: reads of all of them agree."""
    return {name: df.where(F.col("seq") <= upto) for name, df in logs.items()}


def pending_writes(issued: DataFrame, persisted: DataFrame) -> DataFrame:
    """(session, pending): each session's writes (session, seq) above the address that is
    persisted (one row, seq); a session may go on when there are none."""
    mark = persisted.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_mark"))  # one row
    return issued.crossJoin(F.broadcast(mark)).groupBy("session").agg(F.count_if(F.col("seq") > F.col("_mark")).alias("pending"))


# -- commit policies, checkpoints


def _serial(rows: DataFrame, key: str, order: list[str], names: list[str], fold: Callable[[], Callable], schema: T.StructType) -> DataFrame:
    """rows with ``schema``'s columns from ``fold()(*values of names)``, a new fold for each key, in
    order; partitions are streamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, step = None, False, None
        for pdf in batches:
            out = []
            for k, *values in zip(pdf[key], *(pdf[c] for c in names), strict=True):
                if not begun or k != last:
                    last, begun, step = k, True, fold()
                out.append(step(*values))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=[f.name for f in schema.fields])], axis=1)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, T.StructType([*rows.schema.fields, *schema.fields]))


def group_commits(entries: DataFrame, max_bytes: int, max_count: int, interval_ms: int) -> DataFrame:
    """entries (log, seq, bytes, at_ms) with ``commits`` (whether a commit follows this append) and
    ``round`` (its number): one follows as soon as the bytes or entries since the last reach their
    limit, or the time since it the interval (-1: never); the first counts from its own time."""

    def fold() -> Callable:
        size = count = number = 0
        since = None

        def step(n: int, at: int) -> tuple[bool, int]:
            nonlocal size, count, number, since
            since = at if since is None else since
            size, count = size + int(n), count + 1
            due = size >= max_bytes or count >= max_count or (interval_ms >= 0 and at - since >= interval_ms)
            mine = number
            if due:
                size = count = 0
                number, since = number + 1, at
            return bool(due), mine

        return step

    schema = T.StructType([T.StructField("commits", T.BooleanType()), T.StructField("round", T.LongType())])
    return _serial(entries, "log", ["seq"], ["bytes", "at_ms"], fold, schema)


def checkpoint_rounds(events: DataFrame) -> DataFrame:
    """(session, seq, upto) of every checkpoint among a session's events (session, seq, kind):
    the last commit enqueued before it, which it holds and nothing after."""
    before = W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    upto = F.max(F.when(F.col("kind") == "commit", F.col("seq"))).over(before)
    return events.withColumn("upto", F.coalesce(upto, F.lit(0))).where("kind = 'checkpoint'").select("session", "seq", "upto")


# -- leases


def leases(requests: DataFrame) -> DataFrame:
    """requests (name, seq, at_ms, owner, op acquire or release, lease_ms, token) with ``granted`` and
    ``fence``: a free or run-out lock goes to who asks, with the request's address as its token; its
    owner renews it with the same token; a release needs owner and token; fence is null otherwise."""

    def fold() -> Callable:
        holder: list = [None, 0, 0]  # owner, token, end

        def step(seq: int, at: int, owner: str, op: str, lease: int, token) -> tuple[bool, int | None]:
            if op == "acquire":
                if holder[0] == owner and holder[2] > at:
                    holder[2] = at + lease
                elif holder[0] is None or holder[2] <= at:
                    holder[:] = [owner, int(seq), at + lease]
                else:
                    return False, None
                return True, holder[1]
            if holder[0] == owner and not pd.isna(token) and int(token) == holder[1]:
                holder[:] = [None, 0, 0]
                return True, None
            return False, None

        return step

    schema = T.StructType([T.StructField("granted", T.BooleanType()), T.StructField("fence", T.LongType())])
    return _serial(requests, "name", ["seq"], ["seq", "at_ms", "owner", "op", "lease_ms", "token"], fold, schema)


# -- watchers


def watch_hub(changes: DataFrame, subscribers: DataFrame, capacity: int) -> DataFrame:
    """(subscriber, buffered, connected, resume_after) of each subscriber (subscriber, consumed):
    changes (seq) above the address it has consumed wait for it; one with more than ``capacity``
    of them is cut off, and may resume after what it consumed.  Writers never wait.  Changes are
    counted once by ranges, so many subscribers cost one pass."""
    from tidelog.operators.queue import lag

    cursors = subscribers.select(F.col("subscriber").alias("group"), (F.col("consumed") + 1).alias("cursor"))
    waiting = lag(changes.select("seq"), cursors, F.lit(1).cast("long"))
    return waiting.select(F.col("group").alias("subscriber"), F.col("lag").alias("buffered"), (F.col("lag") <= capacity).alias("connected"), (F.col("cursor") - 1).alias("resume_after"))


# -- indexes


def switch_index(log: DataFrame, key: str, path: str, layout: str, after: DataFrame | None = None) -> DataFrame:
    """The index (key, seq) rebuilt in another layout, ``hash`` or ``ordered``, as a table that readers
    switch to; records logged meanwhile (``after``) are caught up."""
    built = log.groupBy(key).agg(F.max("seq").alias("seq"))
    if layout == "hash":
        built = built.repartition(key)
    elif layout == "ordered":
        built = built.repartitionByRange(key).sortWithinPartitions(key)
    else:
        raise ValueError(f"no index layout {layout}")
    built.write.mode("overwrite").parquet(path)
    index = log.sparkSession.read.schema(built.schema).parquet(path)
    return index if after is None else index.unionByName(after.select(key, "seq")).groupBy(key).agg(F.max("seq").alias("seq"))


# -- writes in place


def write_window(log: DataFrame, batches: DataFrame) -> DataFrame:
    """Records of batches (batch, pos, ...) with addresses after the log's last: each batch has a
    contiguous run of them, in its own order."""
    from tidelog.operators.log import dense_index

    last = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))  # one row
    return dense_index(batches, ["batch", "pos"], 1, "_n").crossJoin(F.broadcast(last)).withColumn("seq", F.col("_last") + F.col("_n")).drop("_last", "_n")


def update_in_place(log: DataFrame, updates: DataFrame, capacity: Column | None = None) -> DataFrame:
    """The log with values replaced at the addresses of ``updates`` (seq, value), without new versions.
    A value longer than ``capacity`` (an expression over the record) is an error; so is an address
    that holds no record."""
    given = updates.select("seq", F.col("value").alias("_value"), F.lit(True).alias("_given"))
    both = log.withColumn("_there", F.lit(True)).join(given, "seq", "full_outer")
    none = F.raise_error(F.concat(F.lit("no record at "), F.col("seq").cast("string"))).cast("boolean")
    value = F.when(F.col("_given"), F.col("_value")).otherwise(F.col("value"))
    if capacity is not None:
        long = F.raise_error(F.concat(F.lit("the value is too long at "), F.col("seq").cast("string"))).cast(log.schema["value"].dataType)
        value = F.when(F.col("_given") & (F.octet_length(F.col("_value").cast("string")) > capacity), long).otherwise(value)
    return both.where(F.when(F.col("_there").isNull(), none).otherwise(F.lit(True))).withColumn("value", value).select(log.columns)


def write_at(blobs: DataFrame, patches: DataFrame) -> DataFrame:
    """Contents with bytes replaced from an offset on (patches: object_id, offset, data); an offset at
    the end appends, one beyond it is an error."""
    some = blobs.join(patches, "object_id", "left")
    n, m = F.octet_length("content"), F.octet_length("data")
    beyond = F.raise_error(F.concat(F.lit("beyond the end of object "), F.col("object_id").cast("string"))).cast("binary")
    patched = F.concat(F.substring("content", F.lit(1), F.col("offset").cast("int")), F.col("data"), F.substring("content", (F.col("offset") + m).cast("int") + 1, F.lit((1 << 31) - 1)))
    content = F.when(F.col("data").isNull(), F.col("content")).when(F.col("offset") > n, beyond).otherwise(patched)
    out = some.withColumn("content", content)
    if "length" in blobs.columns:
        out = out.withColumn("length", F.octet_length("content").cast(blobs.schema["length"].dataType))
    return out.select(blobs.columns)
