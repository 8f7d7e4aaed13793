"""Stateful delivery: a processor that keeps a group's pending messages and their timers.

Input rows (grp, seq, op, at_ms, epoch, payload): ``enqueue`` delivers a message, ``ack``
settles it (an epoch older than the last delivery's is refused), ``nack`` fails it.
Deliveries that outlive their visibility fail, too.  A failure counts one more delivery;
beyond ``max_redeliveries`` the message goes to the dead letters.  Output rows (grp, seq,
event, count, epoch): deliver, redeliver, acked, refused, dead_letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.schemas import struct

OUTPUT = struct("grp string, seq bigint, event string, count int, epoch bigint")
_STATE = struct("count int, epoch bigint, deadline_ms bigint")
_KEY = struct("seq bigint")


class Delivery(StatefulProcessor):
    def __init__(self, visibility_ms: int, max_redeliveries: int):
        self.visibility_ms, self.max_redeliveries = visibility_ms, max_redeliveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _KEY, _STATE)

    def _failed(self, grp: str, seq: int, now_ms: int, out: list) -> None:
        count, epoch, _ = self.pending.getValue((seq,))
        if count + 1 > self.max_redeliveries:
            self.pending.removeKey((seq,))
            out.append((grp, seq, "dead_letter", count + 1, epoch))
            return
        deadline = now_ms + self.visibility_ms
        self.pending.updateValue((seq,), (count + 1, epoch + 1, deadline))
        self.handle.registerTimer(deadline)
        out.append((grp, seq, "redeliver", count + 1, epoch + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        now = timerValues.getCurrentProcessingTimeInMs()
        every = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")
        for r in every.itertuples():
            seq = int(r.seq)
            known = self.pending.containsKey((seq,))
            if r.op == "enqueue" and not known:
                self.pending.updateValue((seq,), (0, 1, now + self.visibility_ms))
                self.handle.registerTimer(now + self.visibility_ms)
                out.append((key[0], seq, "deliver", 0, 1))
            elif r.op == "ack" and known:
                count, epoch, _ = self.pending.getValue((seq,))
                if pd.notna(r.epoch) and int(r.epoch) < epoch:
                    out.append((key[0], seq, "refused", count, epoch))
                else:
                    self.pending.removeKey((seq,))
                    out.append((key[0], seq, "acked", count, epoch))
            elif r.op == "nack" and known:
                self._failed(key[0], seq, now, out)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (seq,), (_, _, deadline) in list(self.pending.iterator()):
            if deadline <= now:
                self._failed(key[0], seq, timerValues.getCurrentProcessingTimeInMs(), out)
        if out:
            yield pd.DataFrame(out, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def deliver(commands: DataFrame, visibility_ms: int = 30_000, max_redeliveries: int = 3) -> DataFrame:
    """The stream of delivery events; needs the RocksDB state store provider."""
    return commands.select("grp", F.col("seq").cast("long"), "op", "at_ms", "epoch").groupBy("grp").transformWithStateInPandas(Delivery(visibility_ms, max_redeliveries), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
