"""Binary frames and envelopes, glob patterns and storage addresses as columns.

All codecs are built-in expressions over binary columns, little-endian.  Unwrapping gives a
struct, null where the bytes are no such frame.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The first byte of a framed value, the magic of each envelope, and flags.
FRAME_MARK = 0xC8
SAMPLE_MAGIC, DENSE_MAGIC, MESSAGE_MAGIC, LETTER_MAGIC = b"TTS1", b"TTS2", b"TQE1", b"QCDLQ01\0"
HAS_SEQ = 1
DELAYED, IDEMPOTENT = 1, 2


def little(x: Column, n: int) -> Column:
    """The n low bytes of a whole number, least first."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(n))))


def little_of(data: Column, at: int, n: int, signed: bool = True) -> Column:
    """The whole number in n bytes from ``at`` on, as a long."""
    h = F.hex(F.substring(data, at + 1, n))
    x = F.conv(F.concat(*(F.substring(h, 2 * i - 1, 2) for i in range(n, 0, -1))), 16, -10).cast("long")
    return F.when(x >= 1 << (8 * n - 1), x - (1 << 8 * n)).otherwise(x) if signed and n < 8 else x


def _bytes(raw: bytes) -> Column:
    return F.lit(bytearray(raw))


def _rest(data: Column, at: int) -> Column:
    return F.substring(data, at + 1, (1 << 31) - 1)


def _starts(data: Column, magic: bytes, size: int) -> Column:
    return (F.octet_length(data) >= size) & (F.substring(data, 1, len(magic)) == _bytes(magic))


def wrap_value(expiry: Column, payload: Column) -> Column:
    """Mark, 8 bytes of expiry, payload."""
    return F.concat(_bytes(bytes([FRAME_MARK])), little(expiry, 8), F.coalesce(payload, _bytes(b"")))


def unwrap_value(frame: Column) -> Column:
    """(expiry, payload) of a framed value."""
    return F.when(_starts(frame, bytes([FRAME_MARK]), 9), F.struct(little_of(frame, 1, 8).alias("expiry"), _rest(frame, 9).alias("payload")))


def sample_envelope(series: Column | None, ts: Column, seq: Column | None, payload: Column) -> Column:
    """A sample's bytes: magic, flags, the series (4 bytes, only of the dense form), time, sequence
    number (0 without one, which the flags tell), payload."""
    number = seq if seq is not None else F.lit(None).cast("long")
    flags = F.when(number.isNotNull(), HAS_SEQ).otherwise(0)
    head = [_bytes(SAMPLE_MAGIC), little(flags, 1)] if series is None else [_bytes(DENSE_MAGIC), little(flags, 1), little(series, 4)]
    return F.concat(*head, little(ts, 8), little(F.coalesce(number, F.lit(0)), 8), payload)


def unwrap_sample(data: Column, dense: bool = True) -> Column:
    """(flags, series_id, ts, seq, payload); the series only of the dense form.  Without the
    flag the sequence number is 0, whatever its bytes."""
    skip = 4 if dense else 0
    flags = little_of(data, 4, 1, signed=False).cast("int")
    seq = F.when(flags.bitwiseAND(HAS_SEQ) != 0, little_of(data, 13 + skip, 8)).otherwise(F.lit(0).cast("long"))
    series = [little_of(data, 5, 4, signed=False).alias("series_id")] if dense else []
    parts = F.struct(flags.alias("flags"), *series, little_of(data, 5 + skip, 8).alias("ts"), seq.alias("seq"), _rest(data, 21 + skip).alias("payload"))
    return F.when(_starts(data, DENSE_MAGIC if dense else SAMPLE_MAGIC, 21 + skip), parts)


def message_envelope(producer: Column, producer_seq: Column, due: Column, payload: Column) -> Column:
    """A message's bytes: magic, flags, producer, its number, due time, payload.  A due time
    makes a message delayed, a producer and number idempotent; slots without a value are 0."""
    named = producer.isNotNull() & producer_seq.isNotNull()
    flags = F.when(due.isNotNull(), DELAYED).otherwise(0) + F.when(named, IDEMPOTENT).otherwise(0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.concat(_bytes(MESSAGE_MAGIC), little(flags, 1), little(zero(producer), 8), little(zero(producer_seq), 8), little(zero(due), 8), payload)


def unwrap_message(data: Column) -> Column:
    """(flags, producer_id, producer_seq, due_ts, payload)."""
    parts = F.struct(
        little_of(data, 4, 1, signed=False).cast("int").alias("flags"), little_of(data, 5, 8).alias("producer_id"), little_of(data, 13, 8).alias("producer_seq"),
        little_of(data, 21, 8).alias("due_ts"), _rest(data, 29).alias("payload"),
    )
    return F.when(_starts(data, MESSAGE_MAGIC, 29), parts)


def dead_letter_envelope(segment: Column, extension: Column, offset: Column, group: Column, count: Column, payload: Column) -> Column:
    """A dead letter's bytes: magic, source address, final count, the group's length and name,
    payload."""
    name = F.encode(group, "UTF-8")
    return F.concat(_bytes(LETTER_MAGIC), little(segment, 4), little(extension, 4), little(offset, 8), little(count, 4), little(F.octet_length(name), 4), name, payload)


def unwrap_dead_letter(data: Column) -> Column:
    """(segment, extension, offset, final_count, group, payload)."""
    size = little_of(data, 28, 4)
    whole = _starts(data, LETTER_MAGIC, 32) & (size >= 0) & (size + 32 <= F.octet_length(data))
    parts = F.struct(
        little_of(data, 8, 4).cast("int").alias("segment"), little_of(data, 12, 4).cast("int").alias("extension"), little_of(data, 16, 8).alias("offset"),
        little_of(data, 24, 4).cast("int").alias("final_count"), F.decode(F.substring(data, F.lit(33), size.cast("int")), "UTF-8").alias("group"),
        F.substring(data, size.cast("int") + 33, F.lit((1 << 31) - 1)).alias("payload"),
    )
    return F.when(whole, parts)


def glob_to_like(pattern: str) -> str:
    """``*`` any run and ``?`` one character, all else literal, as an SQL pattern."""
    return re.sub(r"[%_\\]", lambda m: "\\" + m[0], pattern).replace("*", "%").replace("?", "_")


def glob(name: Column, pattern: str) -> Column:
    return name.like(glob_to_like(pattern))


def last_component(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def common_prefixes(keys: DataFrame, key: str, prefix: str, delimiter: str) -> DataFrame:
    """(name, is_prefix): objects right below the prefix, and distinct prefixes of the
    deeper ones up to the next delimiter, sorted."""
    rest = F.substring(F.col(key), len(prefix) + 1, 1 << 30)
    deep = F.locate(delimiter, rest) > 0
    name = F.when(deep, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col(key))
    return keys.where(F.col(key).startswith(prefix)).select(name.alias("name"), deep.alias("is_prefix")).distinct().orderBy("name")


def address(segment: Column, offset: Column) -> Column:
    """Compares by segment, then offset."""
    return F.struct(segment.alias("segment"), offset.alias("offset"))


def flat_addresses(segments: DataFrame) -> DataFrame:
    """(segment, base): each segment's first flat position, the sizes of those before it.  Sizes
    are summed by 65,536 segments first, so no window sees more rows than that."""
    wide = segments.withColumn("_w", F.shiftright(F.col("segment").cast("long"), 16))
    before = (W.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(*before)), F.lit(0))
    tops = wide.groupBy("_w").agg(F.sum("size").alias("_s")).select("_w", over("_s", W.orderBy("_w")).alias("_t"))
    inside = wide.select("segment", "_w", over("size", W.partitionBy("_w").orderBy("segment")).alias("_b"))
    return inside.join(tops, "_w").select("segment", (F.col("_b") + F.col("_t")).alias("base"))


def distance(a: Column, b: Column) -> Column:
    return b - a


def advance(a: Column, n: int) -> Column:
    return a + n


def locate_magic(data: Column, magics: bytes | list[bytes], last: bool = False, start: int = 0, end: int | None = None, page: int = 4096, step: int = 1) -> Column:
    """(offset, page): the least (or, for ``last``, the greatest) place of [start, end) that holds
    one of the magics whole inside its page, at a multiple of ``step`` from the page's start, and
    where that page starts; null if none does.  Pages are counted from ``start``.  It only
    nominates: the record's own structure and checksum decide (``records_from``).

    Bytes are read as characters of one byte each and cut at every match by one pass of a
    pattern, so the time grows with the bytes."""
    found = [magics] if isinstance(magics, bytes) else list(magics)
    if not found or len({len(m) for m in found}) != 1:
        raise ValueError("magics of one length are needed")
    width = len(found[0])
    some = F.substring(data, F.lit(start + 1), F.lit((1 << 31) - 1 if end is None else max(0, end - start)))
    text = F.decode(some, "ISO-8859-1")
    pattern = "|".join("".join(f"\\x{b:02x}" for b in m) for m in found)
    pieces, leads = F.split(text, f"(?s)(?={pattern})", -1), text.rlike(f"(?s)\\A(?:{pattern})")
    none = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"))
    inside = lambda at: (F.pmod(at, F.lit(page)) <= page - width) & (F.pmod(F.pmod(at, F.lit(page)), F.lit(step)) == 0)

    def walk(state: Column, piece: Column) -> Column:
        at = state["at"]
        hit = ((at > 0) | leads) & inside(at)  # every piece but the first begins with a match
        best = F.when(hit, at).otherwise(state["best"]) if last else F.coalesce(state["best"], F.when(hit, at))
        return F.struct((at + F.length(piece)).alias("at"), best.alias("best"))

    best = F.aggregate(pieces, none, walk)["best"]
    offset = best.cast("long") + start
    return F.when(best.isNotNull(), F.struct(offset.alias("offset"), (offset - F.pmod(best.cast("long"), F.lit(page))).alias("page")))
