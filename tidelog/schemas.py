"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType, "BINARY": T.BinaryType, "BIGINT": T.LongType, "INT": T.IntegerType, "TINYINT": T.ByteType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType}


def struct(text: str) -> T.StructType:
    """A flat schema from "name TYPE, ..."; unlike fromDDL it needs no session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind.upper()]()) for name, kind in pairs])


LOG = struct("key STRING, value BINARY, seq BIGINT, is_tombstone BOOLEAN")
SERIES = struct("series_id BIGINT, ts BIGINT, seq BIGINT, value DOUBLE")
WATERMARK = struct("series_id BIGINT, trimmed_until BIGINT")
KV = struct("key BIGINT, value STRING, expiry BIGINT, seq BIGINT, is_tombstone BOOLEAN")
HASH = struct("domain BIGINT, field STRING, value STRING, seq BIGINT")
SET = struct("domain BIGINT, member STRING, seq BIGINT")
ZSET = struct("domain BIGINT, member STRING, score DOUBLE, seq BIGINT")
QUEUE = struct("seq BIGINT, payload BINARY, due_ts BIGINT, producer_id BIGINT, producer_seq BIGINT")
GROUP_STATE = struct("`group` STRING, seq BIGINT, consumer STRING, deliver_ms BIGINT, redelivery INT, epoch BIGINT, acked BOOLEAN")
DEAD_LETTER = struct("source_seq BIGINT, `group` STRING, final_count INT, payload BINARY")
WAL = struct("idx BIGINT, payload BINARY, is_meta BOOLEAN")
BLOB = struct("object_id BIGINT, length BIGINT, created BIGINT, state TINYINT, content BINARY")
BLOB_CHUNK = struct("object_id BIGINT, chunk INT, data BINARY, crc BIGINT")
CHANGE = struct("key BIGINT, kind STRING, seq BIGINT")
HLC = struct("physical BIGINT, logical BIGINT")


def kv_schema(key: T.DataType, value: T.DataType) -> T.StructType:
    """A typed key-value log for any key and value type, structs included."""
    fields = [("key", key), ("value", value), ("expiry", T.LongType()), ("seq", T.LongType()), ("is_tombstone", T.BooleanType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def tagged_union(**variants: T.DataType) -> T.StructType:
    """A message that is one of several: its tag, and a nullable field for each variant."""
    return T.StructType([T.StructField("tag", T.StringType(), False), *(T.StructField(n, t, True) for n, t in variants.items())])
