"""Queues over a message log and group state: delivery order, cursors, delays, dead letters.

Messages: ``seq, payload, due_ts, producer_id, producer_seq`` (due_ts null: at once).
Group state: ``group, seq, consumer, deliver_ms, redelivery, epoch, acked``, and, where
deliveries expire or wait, ``next_ms`` (when an unacknowledged one may go out again) and
``waiting`` (it is backing off after a failure).
Groups: ``group, cursor, epoch, fenced``; a cursor of null is the log's first address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.log import dense_index
from tidelog.operators.ordered import running_sum

DEFAULT_GROUP = "$default"


def resolve_due(messages: DataFrame, now: int, max_delay: int | None = None) -> DataFrame:
    """A due time that has passed means at once; one too far ahead is an error."""
    due = F.when(F.col("due_ts") > now, F.col("due_ts"))
    if max_delay is not None:
        far = F.raise_error(F.lit("the delay exceeds its limit")).cast("long")
        due = F.when(F.col("due_ts") - now > max_delay, far).otherwise(due)
    return messages.withColumn("due_ts", due)


def numbered_batch(batch: DataFrame, payloads: str, first: str) -> DataFrame:
    """One message for each payload of an array; item i has producer_seq first + i."""
    rest = [c for c in batch.columns if c not in (payloads, first)]
    return batch.select(*rest, first, F.posexplode(payloads).alias("_i", "payload")).withColumn("producer_seq", F.col(first) + F.col("_i")).drop("_i", first)


def deduplicated(messages: DataFrame) -> DataFrame:
    """Of each (producer_id, producer_seq) the first address; messages without them stay."""
    named = messages.where("producer_id is not null and producer_seq is not null")
    first = named.groupBy("producer_id", "producer_seq").agg(F.min_by(F.struct(*messages.columns), "seq").alias("r")).select("r.*")
    return first.unionByName(messages.where("producer_id is null or producer_seq is null"))


def delayed(messages: DataFrame, start: int, end: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Due in [start, end], by due time and address, a page of them."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    out = messages.where(F.col("due_ts").between(start, end)).orderBy("due_ts", "seq")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def ready(messages: DataFrame, now: int) -> DataFrame:
    return messages.where(F.col("due_ts") <= now).orderBy("due_ts", "seq")


def deliverable(messages: DataFrame, state: DataFrame, now: int, limit: int, floor: int | None = None) -> DataFrame:
    """The next ``limit`` messages of a group, with ``place``: immediate ones by address,
    then ready delayed ones by due time; those that ``state`` holds (acknowledged, on their way,
    waiting or dead) and those below ``floor``, the group's cursor, are skipped."""
    some = messages if floor is None else messages.where(F.col("seq") >= floor)
    open_ = some.join(state.select("seq"), "seq", "left_anti")
    segment = F.when(F.col("due_ts").isNull(), 0).when(F.col("due_ts") <= now, 1)
    key = F.coalesce("due_ts", "seq")
    top = open_.withColumn("segment", segment).where("segment is not null").orderBy("segment", key, "seq").limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy("segment", key, "seq")))  # limit rows


def expire_overdue(state: DataFrame, now_ms: int, max_redeliveries: int, backoff: Column | None = None) -> DataFrame:
    """State with ``outcome`` of every delivery whose ``next_ms`` has come: after a wait it goes
    out again uncounted; after its visibility it counts one more and is a dead letter beyond
    ``max_redeliveries``, waits for ``backoff`` milliseconds (an expression over the new
    ``redelivery``) if those are more than 0, or goes out again.  Outcomes: dead_letter, backoff,
    redeliver; null for all others, which stay as they are."""
    due = ~F.col("acked") & (F.col("next_ms") <= now_ms)
    failed = due & ~F.col("waiting")
    out = state.withColumn("redelivery", F.when(failed, F.col("redelivery") + 1).otherwise(F.col("redelivery")))
    wait = backoff if backoff is not None else F.lit(0)
    outcome = F.when(~due, F.lit(None)).when(F.col("waiting"), F.lit("redeliver")).when(F.col("redelivery") > max_redeliveries, F.lit("dead_letter")).when(wait > 0, F.lit("backoff")).otherwise(F.lit("redeliver"))
    out = out.withColumn("outcome", outcome)
    later = F.col("outcome") == "backoff"
    return out.withColumns({
        "next_ms": F.when(later, F.lit(now_ms).cast("long") + wait).otherwise(F.col("next_ms")),
        "deliver_ms": F.when(later, F.lit(now_ms).cast("long")).otherwise(F.col("deliver_ms")),
        "waiting": F.coalesce(later, F.lit(False)) | (F.col("waiting") & ~due),
    })


def dequeue(messages: DataFrame, state: DataFrame, now: int, now_ms: int, limit: int, consumer: str, epoch: int, visibility_ms: int, max_redeliveries: int, backoff: Column | None = None, floor: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(deliveries, state after): one group's pull.  Overdue deliveries and waits that have ended
    come free first and are delivered again, with their counts; dead letters never are.
    ``state after`` holds the new deliveries as pending and marks dead letters in ``outcome``."""
    after = expire_overdue(state, now_ms, max_redeliveries, backoff)
    again = F.coalesce(F.col("outcome") == "redeliver", F.lit(False))
    kept = after.where(~again)
    counts = after.where(again).select("seq", "redelivery")
    out = deliverable(messages, kept, now, limit, floor).join(counts, "seq", "left").withColumn("redelivery", F.coalesce("redelivery", F.lit(0)))
    out = out.withColumn("epoch", F.lit(epoch).cast("long"))
    group = F.first("group") if "group" in state.columns else F.lit(None)
    named = state.agg(group.alias("_group"))  # one row
    fresh = out.crossJoin(F.broadcast(named)).select(
        F.col("_group").alias("group"), "seq", F.lit(consumer).alias("consumer"), F.lit(now_ms).cast("long").alias("deliver_ms"), "redelivery", "epoch", F.lit(False).alias("acked"),
        F.lit(now_ms + visibility_ms).cast("long").alias("next_ms"), F.lit(False).alias("waiting"), F.lit(None).cast("string").alias("outcome"),
    )
    waiting = after.where(again).join(out.select("seq"), "seq", "left_anti").withColumn("next_ms", F.lit(now_ms).cast("long"))  # free, not reached by the limit
    return out, kept.unionByName(waiting.select(kept.columns)).unionByName(fresh.select(kept.columns))


def ack_cursors(state: DataFrame) -> DataFrame:
    """(group, cursor, holes): the first address not acknowledged, and how many above it
    are."""
    first = state.groupBy("group").agg(F.min(F.when(~F.col("acked"), F.col("seq"))).alias("_open"), F.max("seq").alias("_last"))
    cursor = F.coalesce("_open", F.col("_last") + 1)
    both = state.join(first.select("group", cursor.alias("cursor")), "group")
    return both.groupBy("group", "cursor").agg(F.count_if(F.col("acked") & (F.col("seq") > F.col("cursor"))).alias("holes"))


def acknowledge(state: DataFrame, receipts: DataFrame, fenced: bool = True, max_in_flight: int = 4096) -> DataFrame:
    """State after receipts (group, seq, epoch): an older epoch is an error where fenced,
    receipts for unknown addresses do nothing, too many holes are an error."""
    got = receipts.groupBy("group", "seq").agg(F.max("epoch").alias("_epoch"))
    old = F.raise_error(F.lit("the receipt is of an older delivery")).cast("boolean")
    acked = F.when(F.col("_epoch").isNull(), F.col("acked"))
    if fenced:
        acked = acked.when(F.col("_epoch") < F.col("epoch"), old)
    out = state.join(got, ["group", "seq"], "left").withColumn("acked", acked.otherwise(F.lit(True))).drop("_epoch").select(state.columns)
    wide = F.raise_error(F.lit("too many acknowledged messages above the cursor")).cast("boolean")
    over = ack_cursors(out).where(F.col("holes") > max_in_flight).select("group", F.lit(True).alias("_over"))
    return out.join(over, "group", "left").where(F.when(F.col("_over"), wide).otherwise(F.lit(True))).drop("_over").select(state.columns)


def after_failure(state: DataFrame, failed: Column, now_ms: int, max_redeliveries: int, backoff: Column | None = None) -> DataFrame:
    """State rows where ``failed`` (a nack or an expired delivery) count one more delivery;
    ``outcome`` says dead_letter, backoff or redeliver, ``retry_ms`` when."""
    n = F.when(failed, F.col("redelivery") + 1).otherwise(F.col("redelivery"))
    outcome = F.when(~failed, F.lit(None)).when(n > max_redeliveries, F.lit("dead_letter")).when(F.lit(backoff is not None), F.lit("backoff")).otherwise(F.lit("redeliver"))
    wait = backoff if backoff is not None else F.lit(0)
    out = state.withColumns({"redelivery": n, "outcome": outcome})
    return out.withColumn("retry_ms", F.when(F.col("outcome") == "backoff", F.lit(now_ms) + wait).when(F.col("outcome") == "redeliver", F.lit(now_ms)))


def overdue(now_ms: int, visibility_ms: int) -> Column:
    """Whether an unacknowledged delivery has outlived its visibility."""
    return ~F.col("acked") & (F.col("deliver_ms") + visibility_ms <= now_ms)


def dead_letters(after: DataFrame, messages: DataFrame) -> DataFrame:
    """(source_seq, group, final_count, payload) of what goes to the dead-letter queue."""
    dead = after.where("outcome = 'dead_letter'").select("seq", "group", F.col("redelivery").alias("final_count"))
    return dead.join(messages.select("seq", "payload"), "seq").select(F.col("seq").alias("source_seq"), "group", "final_count", "payload")


def replay(letters: DataFrame, source_seq: int | None = None) -> DataFrame:
    """Payloads to enqueue again, of one letter or all."""
    out = letters if source_seq is None else letters.where(F.col("source_seq") == source_seq)
    return out.select("payload")


def claim(state: DataFrame, consumer: str, now_ms: int, min_idle_ms: int, limit: int | None = None) -> DataFrame:
    """Pending deliveries idle long enough, as the new consumer holds them: epoch one up."""
    idle = state.where(~F.col("acked") & (F.lit(now_ms) - F.col("deliver_ms") >= min_idle_ms))
    if limit is not None:
        idle = idle.orderBy("seq").limit(limit)
    return idle.withColumn("consumer", F.lit(consumer)).withColumn("epoch", F.col("epoch") + 1).withColumn("deliver_ms", F.lit(now_ms).cast("long"))


def pending(state: DataFrame, now_ms: int) -> DataFrame:
    return state.where(~F.col("acked")).withColumn("idle_ms", F.lit(now_ms) - F.col("deliver_ms"))


def cancel(messages: DataFrame, addresses: DataFrame | None = None, start: int | None = None, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, cancelled) delayed messages, by address or by a closed range of due times."""
    if addresses is not None:
        return messages.join(addresses.select("seq"), "seq", "left_anti"), messages.where("due_ts is not null").join(addresses.select("seq"), "seq", "left_semi")
    if start is None or end is None:
        raise ValueError("a range needs both bounds")
    hit = F.coalesce(F.col("due_ts").between(start, end), F.lit(False))
    return messages.where(~hit), messages.where(hit)


def lag(messages: DataFrame, cursors: DataFrame, size: Column) -> DataFrame:
    """(group, cursor, lag, lag_bytes) of each group: what lies at or above its cursor.  All
    messages are summed by ranges of 65,536 addresses with partial sums; only ranges that hold a
    cursor are read address by address, so the log is neither shuffled nor sorted.  Ranges in
    turn are summed by 65,536 of them: the one window without a partition has a row for each
    2**32 addresses."""
    asks = cursors.select("group", F.col("cursor").cast("long").alias("cursor"), F.shiftright(F.col("cursor").cast("long"), 16).alias("_r"))
    per = messages.select("seq", size.alias("_b"), F.shiftright("seq", 16).alias("_r"))
    by_range = per.groupBy("_r").agg(F.count("*").alias("_rn"), F.sum("_b").alias("_rb"))
    by_range = by_range.join(asks.select("_r", F.lit(True).alias("_ask")).distinct(), "_r", "full_outer").withColumn("_w", F.shiftright("_r", 16))
    zero = {"_rn": 0, "_rb": 0}
    by_range = by_range.fillna(zero)
    wide = by_range.groupBy("_w").agg(F.sum("_rn").alias("_wn"), F.sum("_rb").alias("_wb"))
    later = (W.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*later)), F.lit(0))
    wide = wide.select("_w", over("_wn", W.orderBy(F.desc("_w"))).alias("_wn"), over("_wb", W.orderBy(F.desc("_w"))).alias("_wb"))
    inner = W.partitionBy("_w").orderBy(F.desc("_r"))
    tail = by_range.select("_r", "_w", "_ask", over("_rn", inner).alias("_rn"), over("_rb", inner).alias("_rb")).where("_ask").join(wide, "_w")
    tail = tail.select("_r", (F.col("_rn") + F.col("_wn")).alias("_tn"), (F.col("_rb") + F.col("_wb")).alias("_tb"))
    # a range with a cursor: sums by address once, however many groups stand in it
    marks = per.join(asks.select("_r").distinct(), "_r", "left_semi").select("_r", "seq", F.lit(1).alias("_n"), "_b", F.lit(None).cast("string").alias("group"), F.lit(0).alias("_side"))
    both = marks.unionByName(asks.select("_r", F.col("cursor").alias("seq"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_b"), "group", F.lit(1).alias("_side")))
    inside = W.partitionBy("_r").orderBy(F.desc("seq"), "_side").rowsBetween(W.unboundedPreceding, 0)
    out = both.select("_r", "seq", "group", "_side", F.sum("_n").over(inside).alias("_n"), F.sum("_b").over(inside).alias("_b")).where("_side = 1").join(tail, "_r")
    return out.select("group", F.col("seq").alias("cursor"), (F.col("_n") + F.col("_tn")).alias("lag"), (F.col("_b") + F.col("_tb")).alias("lag_bytes"))


def _floors(groups: DataFrame, messages: DataFrame) -> DataFrame:
    """(group, cursor) of groups that are not fenced; a null cursor stands at the log's begin."""
    begin = messages.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("_begin"))  # one row
    return groups.where(~F.col("fenced")).crossJoin(F.broadcast(begin)).select("group", F.coalesce("cursor", "_begin").alias("cursor"))


def group_stats(messages: DataFrame, state: DataFrame, groups: DataFrame, size: Column) -> DataFrame:
    """(group, cursor, pending, fenced, lag, lag_bytes) of each group: deliveries that are not
    acknowledged, and what lies at or above its cursor; a fenced group pins nothing: lag 0."""
    floors = lag(messages, _floors(groups, messages), size).select("group", "lag", "lag_bytes")
    pending = state.groupBy("group").agg(F.count_if(~F.col("acked")).alias("pending"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(pending, "group", "left").join(floors, "group", "left").select("group", "cursor", zero("pending"), "fenced", zero("lag"), zero("lag_bytes"))


def backlog_bytes(messages: DataFrame, groups: DataFrame, size: Column, unready: DataFrame | None = None) -> DataFrame:
    """One row (backlog): bytes from the least floor on, of groups that are not fenced and of
    ``unready`` delayed messages (seq), which pin as well; 0 if nothing pins."""
    floors = _floors(groups, messages).select("cursor")
    if unready is not None:
        floors = floors.unionByName(unready.select(F.col("seq").alias("cursor")))
    least = floors.agg(F.min("cursor").alias("_floor"))  # one row
    return messages.select("seq", size.alias("_b")).crossJoin(F.broadcast(least)).agg(F.coalesce(F.sum(F.when(F.col("seq") >= F.col("_floor"), F.col("_b"))), F.lit(0)).cast("long").alias("backlog"))


def queue_stats(messages: DataFrame, groups: DataFrame, size: Column, flushed: int, unready: DataFrame | None = None) -> DataFrame:
    """One row (begin, tail, flushed, backlog)."""
    ends = messages.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("begin"), F.coalesce(F.max("seq") + 1, F.lit(0)).alias("tail"))
    return ends.crossJoin(backlog_bytes(messages, groups, size, unready)).select("begin", "tail", F.lit(flushed).cast("long").alias("flushed"), "backlog")  # one row each


def slowest(cursors: DataFrame) -> DataFrame:
    """The group to evict first: that with the least cursor among those not fenced."""
    some = cursors.where(~F.col("fenced")) if "fenced" in cursors.columns else cursors
    return some.agg(F.min_by("group", F.struct("cursor", "group")).alias("group"), F.min("cursor").alias("cursor"))


def truncation(cursors: DataFrame, target: int, flushed: int) -> DataFrame:
    """Where a truncation to ``target`` may go at most."""
    return cursors.agg(F.least(F.lit(target), F.lit(flushed), F.min("cursor")).alias("upto"))


def start_at(messages: DataFrame, where: str, address: int | None = None) -> DataFrame:
    """(cursor) of a group created or reset at ``earliest``, ``latest`` or an ``address``."""
    if where == "address":
        return messages.sparkSession.range(1).select(F.lit(address).cast("long").alias("cursor"))
    if where not in ("earliest", "latest"):
        raise ValueError(f"a group starts at earliest, latest or an address, not at {where}")
    c = F.min("seq") if where == "earliest" else F.max("seq") + 1
    return messages.agg(F.coalesce(c, F.lit(0)).cast("long").alias("cursor"))


def _known(groups: DataFrame, name: str, there: bool) -> DataFrame:
    """One row (_ok), true; an error if the group is missing (or, for there=False, exists)."""
    n = F.count_if(F.col("group") == name)
    bad = n == 0 if there else n > 0
    return groups.agg(F.when(bad, F.raise_error(F.lit(f"the group {name} {'does not exist' if there else 'exists'}")).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))


def create_group(groups: DataFrame, name: str, messages: DataFrame, where: str = "earliest", address: int | None = None) -> DataFrame:
    """groups with one more, of epoch 1; a name that is taken is an error."""
    new = start_at(messages, where, address).crossJoin(_known(groups, name, False)).where("_ok")
    return groups.unionByName(new.select(F.lit(name).alias("group"), "cursor", F.lit(1).cast("long").alias("epoch"), F.lit(False).alias("fenced")).select(groups.columns))


def delete_group(groups: DataFrame, state: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(groups, state) without a group; the built-in one, and one that is not there, are errors."""
    if name == DEFAULT_GROUP:
        raise ValueError(f"the group {DEFAULT_GROUP} cannot be deleted")
    kept = groups.crossJoin(F.broadcast(_known(groups, name, True))).where(F.col("_ok") & (F.col("group") != name)).drop("_ok")  # one row
    return kept, state.where(F.col("group") != name)


def reset_group(groups: DataFrame, state: DataFrame, name: str, messages: DataFrame, where: str = "earliest", address: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, state) after a group begins anew: no fence, no deliveries or acknowledgements, the
    cursor where it is told, and an epoch one higher, so receipts of before are refused."""
    at = start_at(messages, where, address).select(F.col("cursor").alias("_cursor")).crossJoin(_known(groups, name, True))  # one row
    mine = F.col("group") == name
    out = groups.crossJoin(F.broadcast(at)).where("_ok").withColumns({
        "cursor": F.when(mine, F.col("_cursor")).otherwise(F.col("cursor")), "epoch": F.when(mine, F.col("epoch") + 1).otherwise(F.col("epoch")),
        "fenced": F.when(mine, F.lit(False)).otherwise(F.col("fenced")),
    })
    return out.select(groups.columns), state.where(~mine)


def admit(incoming: DataFrame, messages: DataFrame, groups: DataFrame, size: Column, limit: int, policy: str = "reject", unready: DataFrame | None = None, waited: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(incoming with ``outcome``, groups after) under a limit of the backlog's bytes, which is
    tested before each message in ``seq`` order, so the one that crosses it is let in:

    ``reject`` turns away all that follow; ``block`` makes them wait, and turns away those that
    have waited long enough (``waited``); ``evict`` fences the slowest groups until the backlog
    fits, and turns messages away only if unready ones pin it.  Without groups that pin, all
    are admitted."""
    if policy not in ("reject", "block", "evict"):
        raise ValueError(f"no backlog policy {policy}")
    before = running_sum(incoming, [], ["seq"], size.cast("long"), "_upto").withColumn("_before", F.col("_upto") - size)
    pinned = messages.sparkSession.range(1).select(F.lit(0).cast("long").alias("_pinned")) if unready is None else backlog_bytes(messages, groups.limit(0), size, unready).select(F.col("backlog").alias("_pinned"))
    floors = lag(messages, _floors(groups, messages), size).select("group", "lag_bytes")
    held = floors.agg(F.max("lag_bytes").alias("_held")).crossJoin(pinned)  # one row each
    pins = F.greatest(F.coalesce("_held", F.lit(0)), F.col("_pinned")) if policy != "evict" else F.col("_pinned")
    some = F.col("_held").isNotNull() | (F.col("_pinned") > 0) if policy != "evict" else F.col("_pinned") > 0
    full = some & (pins + F.col("_before") > limit)
    away = F.lit("rejected") if policy != "block" else F.when(waited if waited is not None else F.lit(False), "rejected").otherwise("waiting")
    judged = before.crossJoin(F.broadcast(held)).withColumn("outcome", F.when(full, away).otherwise(F.lit("admitted")))
    out = judged.drop("_upto", "_held", "_pinned")
    if policy != "evict":
        return out.drop("_before"), groups
    last = out.where("outcome = 'admitted'").agg(F.max("_before").alias("_last"))  # one row
    over = floors.crossJoin(F.broadcast(last)).where(F.col("lag_bytes") + F.col("_last") > limit).select("group", F.lit(True).alias("_out"))
    fenced = groups.join(over, "group", "left").withColumn("fenced", F.col("fenced") | F.coalesce("_out", F.lit(False))).select(groups.columns)
    return out.drop("_before"), fenced


def enqueue(log: DataFrame, incoming: DataFrame, now: int, max_delay: int | None = None) -> DataFrame:
    """incoming (pos, payload, due_ts, producer_id, producer_seq) with its address ``seq`` and
    whether it is ``new``: a producer's number that the log, or an earlier row, holds gets the
    address of that one and is not appended; all others get addresses after the log's last."""
    rows = resolve_due(incoming, now, max_delay)
    key = ["producer_id", "producer_seq"]
    named = F.col("producer_id").isNotNull() & F.col("producer_seq").isNotNull()
    have = log.where(named).groupBy(*key).agg(F.min("seq").alias("_have"))
    first = rows.where(named).groupBy(*key).agg(F.min("pos").alias("_first"))
    known = rows.join(have, key, "left").join(first, key, "left")
    new = F.col("_have").isNull() & (F.coalesce("_first", "pos") == F.col("pos"))
    begin = log.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_begin"))  # one row
    numbered = dense_index(known.where(new).select("pos"), ["pos"], 0, "_n").crossJoin(F.broadcast(begin)).select(F.col("pos").alias("_first_pos"), (F.col("_begin") + F.col("_n")).alias("_address"))
    out = known.withColumn("_of", F.coalesce("_first", "pos")).join(numbered, F.col("_of") == F.col("_first_pos"), "left")
    return out.select(*rows.columns, F.coalesce("_have", "_address").alias("seq"), new.alias("new"))


def reconcile(index: DataFrame, log: DataFrame, begin: int, tail: int) -> DataFrame:
    """(seq, action): index entries outside [begin, tail) or without a record are stale,
    delayed records without an entry are missing."""
    have = log.where(F.col("due_ts").isNotNull() & F.col("seq").between(begin, tail - 1)).select("seq", F.lit(True).alias("in_log"))
    both = index.select("seq", F.lit(True).alias("in_index")).join(have, "seq", "full_outer")
    action = F.when(F.col("in_log").isNull(), F.lit("stale")).when(F.col("in_index").isNull(), F.lit("missing"))
    return both.select("seq", action.alias("action")).where("action is not null")


def by_priority(items: DataFrame, k: int | None = None) -> DataFrame:
    """Lower priority values first, first in first out inside one; the k first."""
    out = items.orderBy("priority", "seq")
    return out if k is None else out.limit(k)
