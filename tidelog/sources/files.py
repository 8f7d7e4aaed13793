"""Stores by URI, listings, and binary record files with checksums and resynchronisation."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.frames import glob, last_component

#: Scheme of a store's URI to that of Hadoop's file systems; memory stores are views.
SCHEMES = {"local": "file", "file": "file", "s3": "s3a", "s3a": "s3a", "hdfs": "hdfs", "viewfs": "viewfs", "memory": "memory"}


def parse_store(spec: str) -> tuple[str, str, dict[str, str]]:
    """(scheme, path, options) of "local:///data?codec=zstd"; an unknown scheme is an error."""
    parts = urlsplit(spec)
    if parts.scheme not in SCHEMES:
        raise ValueError(f"unknown store: {spec}")
    scheme = SCHEMES[parts.scheme]
    path = f"{parts.netloc}{parts.path}" if scheme == "memory" else f"{scheme}://{parts.netloc}{parts.path}"
    return scheme, path, dict(parse_qsl(parts.query))


def open_table(spark: SparkSession, spec: str, schema) -> DataFrame:
    """The Parquet table, or for memory stores the temporary view, that a URI names."""
    scheme, path, options = parse_store(spec)
    if scheme == "memory":
        return spark.table(path.strip("/").replace("/", "_"))
    return spark.read.options(**options).schema(schema).parquet(path)


def save_table(df: DataFrame, spec: str, mode: str = "append") -> None:
    scheme, path, options = parse_store(spec)
    if scheme == "memory":
        df.createOrReplaceTempView(path.strip("/").replace("/", "_"))
    else:
        df.write.mode(mode).options(**options).parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length, modified) of files whose last name component fits; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(glob(last_component(F.col("path")), pattern))


def list_entries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, is_folder, length) of what lies right below a path and fits the glob; one listing by
    the store's own client, a row each."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in found]
    return spark.createDataFrame(rows, "name string, is_folder boolean, length long").where(glob(F.col("name"), pattern))


#: Schemes whose files a Python worker can open and seek in.
_SEEKABLE = ("file", "s3", "s3a", "gs", "hdfs", "")


def read_bytes(spark: SparkSession, path: str, offset: int, n: int) -> DataFrame:
    """(path, content): n bytes from an offset of every file at a path.  Files are listed without
    their contents, and each is opened and sought in its own task; stores that Python cannot
    open are read whole by Spark."""
    listed = spark.read.format("binaryFile").load(path)
    if urlsplit(path).scheme not in _SEEKABLE:
        return listed.select("path", F.substring("content", offset + 1, n).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                store, at = fs.FileSystem.from_uri(p.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if not p.startswith("file://") else p)
                with store.open_input_file(at) as f:
                    size = f.size()
                    f.seek(min(offset, size))
                    out.append(f.read(min(n, max(0, size - offset))))
            yield pd.DataFrame({"path": pdf["path"], "content": out})

    return listed.select("path").mapInPandas(run, "path string, content binary")


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> DataFrame:
    """An image of tables in another root: (name, rows, same), a receipt for each with whether what
    is read there has the rows and checksum of what was sent."""
    from tidelog.operators.series import fingerprint

    out = None
    for name in names:
        sent = spark.read.parquet(f"{source}/{name}.parquet")
        sent.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        got = fingerprint(spark.read.schema(sent.schema).parquet(f"{target}/{name}.parquet"))
        one = fingerprint(sent).select("rows", F.col("checksum").alias("_sent")).crossJoin(got.select(F.col("rows").alias("_rows"), "checksum"))  # one row each
        one = one.select(F.lit(name).alias("name"), "rows", ((F.col("rows") == F.col("_rows")) & (F.col("_sent") == F.col("checksum"))).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


MAGIC = b"TLR1"
_HEAD = struct.Struct("<4sqqBI")  # magic, key, seq, flags, payload length; then payload, crc32
_SCHEMA = "path string, offset long, key long, seq long, is_tombstone boolean, payload binary"


def record_bytes(key: int, seq: int, tombstone: bool, payload: bytes) -> bytes:
    body = _HEAD.pack(MAGIC, key, seq, 1 if tombstone else 0, len(payload)) + payload
    return body + struct.pack("<I", zlib.crc32(body))


def parse_records(data: bytes) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(offset, key, seq, tombstone, payload) of every record whose checksum holds; after
    damage the next magic is tried, and the checksum decides."""
    at = 0
    while (at := data.find(MAGIC, at)) >= 0 and at + _HEAD.size + 4 <= len(data):
        _, key, seq, flags, n = _HEAD.unpack_from(data, at)
        end = at + _HEAD.size + n
        if end + 4 <= len(data) and zlib.crc32(data[at:end]) == struct.unpack_from("<I", data, end)[0]:
            yield at, key, seq, bool(flags & 1), data[at + _HEAD.size : end]
            at = end + 4
        else:
            at += 1


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for p, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = [(p, *r) for r in parse_records(bytes(content))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "offset", "key", "seq", "is_tombstone", "payload"])


def read_records(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Records of binary files, read by Spark from any file system it knows.  A file is parsed from
    its begin, as a record's payload may hold what looks like one, so a file is one task's."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return listed.select("path", "content").mapInPandas(_parsed, _SCHEMA)


def write_records(rows: DataFrame, path: str) -> str:
    """Records (key, seq, is_tombstone, payload) as binary record files, one a partition, by the
    store's own client; returns the path."""
    lines = rows.select("key", "seq", "is_tombstone", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"value": [b"".join(record_bytes(k, s, bool(t), bytes(p)) for k, s, t, p in zip(*(pdf[c] for c in pdf.columns), strict=True))]})

    # a sequence file would frame them again; Parquet holds the blocks, one binary value a batch
    lines.mapInPandas(run, "value binary").write.mode("append").parquet(path)
    return path


def read_record_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Records of blocks that ``write_records`` wrote."""
    blocks = spark.read.schema("value binary").parquet(path).select(F.lit(path).alias("path"), F.col("value").alias("content"))
    return blocks.mapInPandas(_parsed, _SCHEMA)
