"""Codecs and stores made from declarations: fixed layouts, tagged messages, key and value
formats, and typed key-value stores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import schemas
from tidelog.functions.frames import little, little_of
from tidelog.operators import kv, log
from tidelog.operators.kv import byte_key

#: Bytes of a field's kind.
WIDTHS = {"u8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "i64": 8}


@dataclass(frozen=True)
class Layout:
    """A structure of fixed width from its fields' kinds in order, little-endian."""

    fields: tuple[tuple[str, str], ...]

    @property
    def size(self) -> int:
        return sum(WIDTHS[k] for _, k in self.fields)

    def write(self, **values: Column) -> Column:
        return F.concat(*(little(values[n], WIDTHS[k]) for n, k in self.fields))

    def read(self, data: Column) -> Column:
        """The fields; null where there are too few bytes."""
        parts, at = [], 0
        for n, k in self.fields:
            parts.append(little_of(data, at, WIDTHS[k], signed=k[0] == "i").alias(n))
            at += WIDTHS[k]
        return F.when(F.octet_length(data) >= self.size, F.struct(*parts))


@dataclass(frozen=True)
class Message:
    """A message that is one of several layouts, told by its first byte."""

    variants: tuple[tuple[int, str, Layout], ...]

    def write(self, tag: str, **values: Column) -> Column:
        number, layout = next((n, x) for n, t, x in self.variants if t == tag)
        return F.concat(F.lit(bytearray([number])), layout.write(**values))

    def read(self, data: Column) -> Column:
        """(tag, one nullable structure for each variant); null for an unknown tag."""
        first, rest = little_of(data, 0, 1, signed=False), F.substring(data, 2, (1 << 31) - 1)
        tag = F.lit(None).cast("string")
        for n, t, _ in self.variants:
            tag = F.when(first == n, F.lit(t)).otherwise(tag)
        return F.when(tag.isNotNull(), F.struct(tag.alias("tag"), *(F.when(first == n, x.read(rest)).alias(t) for n, t, x in self.variants)))


@dataclass(frozen=True)
class Formatter:
    """How values become bytes and come back, and their length."""

    format: Callable[[Column], Column]
    parse: Callable[[Column], Column]

    def size(self, value: Column) -> Column:
        return F.octet_length(self.format(value))


TEXT = Formatter(lambda v: F.encode(v, "UTF-8"), lambda b: F.decode(b, "UTF-8"))
LONG = Formatter(lambda v: little(v, 8), lambda b: F.when(F.octet_length(b) == 8, little_of(b, 0, 8)))


@dataclass(frozen=True)
class KeyOrder:
    """Hash, equality and order of keys: Spark has no custom comparators, so each is a column."""

    sort_key: Callable[[Column], Column]

    def order(self, key: Column) -> Column:
        return self.sort_key(key)

    def hash(self, key: Column) -> Column:
        return F.xxhash64(self.sort_key(key))

    def equal(self, a: Column, b: Column) -> Column:
        return self.sort_key(a) == self.sort_key(b)

    def less(self, a: Column, b: Column) -> Column:
        return self.sort_key(a) < self.sort_key(b)


NUMERIC, BYTES = KeyOrder(lambda k: k), KeyOrder(byte_key)


class TypedStore:
    """A key-value store for one key and one value type over a version log in a folder."""

    def __init__(self, spark, path: str, key: T.DataType, value: T.DataType):
        self.spark, self.path, self.schema = spark, path, schemas.kv_schema(key, value)

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def write(self, records: DataFrame) -> None:
        """Appends records; other types than the store's are an error."""
        have = {f.name: f.dataType for f in records.schema.fields}
        for f in self.schema.fields:
            if have.get(f.name) != f.dataType:
                raise TypeError(f"{f.name} must be {f.dataType.simpleString()}")
        records.select(*self.schema.names).write.mode("append").parquet(self.path)

    def put(self, rows: DataFrame, now: int, ttl: str | None = None) -> None:
        """Puts rows (key, value, seq, and the column of ticks that ``ttl`` names)."""
        self.write(kv.put(rows, now, ttl))

    def current(self, now: int | None = None) -> DataFrame:
        return log.current(self.log(), ["key"], now)


def resolve_keys(records: DataFrame, addresses: DataFrame) -> DataFrame:
    """(seq, key) of the records at addresses; those that hold none are left out."""
    return log.gather(records, addresses).select("seq", "key")
