"""Streams, restarts from a checkpoint, the change feed source, and record files."""

from __future__ import annotations

import datetime as dt
import glob
import time

import pytest

from tidelog import schemas
from tidelog.sources import change_feed, files
from tidelog.streaming import feeds, queue_processor


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream opens a store; two are enough here."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(df, path, sink="out", mode="append", **options):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/ck-{sink}").trigger(availableNow=True)
    q = w.options(**options).format("parquet").option("path", f"{path}/{sink}").start()
    q.awaitTermination(120)
    assert q.exception() is None


def run_until(df, path, rows):
    """A query whose timers keep it alive: stopped once so many rows are out."""
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/ck").format("parquet").option("path", f"{path}/out").start()
    try:
        for _ in range(120):
            assert q.exception() is None
            if glob.glob(f"{path}/out/_spark_metadata/*") and df.sparkSession.read.parquet(f"{path}/out").count() >= rows:
                return
            time.sleep(0.5)
        raise AssertionError("the rows did not come")
    finally:
        q.stop()


LOG = "key long, is_tombstone boolean, seq long"


def test_change_stream_resumes(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, False, 1), (2, False, 2)], LOG).write.parquet(f"{at}/log")
    stream = lambda: feeds.changes(spark, f"{at}/log", spark.read.parquet(f"{at}/log").schema, after=1)
    run(stream(), at)
    spark.createDataFrame([(1, True, 3)], LOG).write.mode("append").parquet(f"{at}/log")
    run(stream(), at)
    got = sorted((r.seq, r.key, r.kind) for r in spark.read.parquet(f"{at}/out").collect())
    assert got == [(2, 2, "put"), (3, 1, "delete")]


def test_change_feed_source(spark, tmp_path):
    at = str(tmp_path)
    spark.dataSource.register(change_feed.ChangeFeed)
    spark.createDataFrame([(i % 3, i % 4 == 0, i) for i in range(1, 21)], LOG).repartition(3).write.parquet(f"{at}/log")
    batch = spark.read.format("tidelog_changes").option("path", f"{at}/log").option("after", "5").load()
    assert sorted(r.seq for r in batch.collect()) == list(range(6, 21))
    stream = lambda: spark.readStream.format("tidelog_changes").option("path", f"{at}/log").load()
    run(stream(), at)
    spark.createDataFrame([(9, False, 21)], LOG).write.mode("append").parquet(f"{at}/log")
    run(stream(), at)
    run(stream(), at)
    assert sorted(r.seq for r in spark.read.parquet(f"{at}/out").collect()) == list(range(1, 22))


def test_rollup_and_dedup_streams(spark, tmp_path):
    at = str(tmp_path)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m), float(m), m % 5) for m in range(0, 300, 10)]
    spark.createDataFrame(rows, "series_id long, ts timestamp, value double, k long").write.parquet(f"{at}/in")
    src = lambda: spark.readStream.schema("series_id long, ts timestamp, value double, k long").parquet(f"{at}/in")
    run(feeds.rollup(src(), "1 hour", "0 seconds"), at, "roll")
    got = sorted((r.window.hour, r["sum"], r["count"]) for r in spark.read.parquet(f"{at}/roll").collect())
    assert got[:4] == [(h, sum(float(m) for m in range(h * 60, h * 60 + 60, 10)), 6) for h in range(4)]
    run(feeds.deduplicated(src(), ["k"], "ts", "10 days"), at, "once")
    assert spark.read.parquet(f"{at}/once").count() == 1  # all minutes are multiples of 5
    assert feeds.window_offset(7) == "4 days"


def test_late_rows_are_split(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([(1, 5, 1, 1.0), (1, 50, 2, 2.0)], schemas.SERIES).write.parquet(f"{at}/in")
    trimmed = lambda s: s.createDataFrame([(1, 10)], schemas.WATERMARK)
    fn = feeds.split_late(trimmed, feeds.write_once(f"{at}/ok"), feeds.write_once(f"{at}/late"))
    q = spark.readStream.schema(schemas.SERIES).parquet(f"{at}/in").writeStream.foreachBatch(fn).option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.ts for r in spark.read.parquet(f"{at}/ok").collect()] == [50]
    assert [r.ts for r in spark.read.parquet(f"{at}/late").collect()] == [5]


def test_federated_feed_applies_once(spark):
    mark, applied = [2], []
    fn = feeds.above_watermark(lambda: mark[0], lambda m: mark.__setitem__(0, m), lambda df: applied.extend(r.idx for r in df.collect()))
    batch = spark.createDataFrame([(1, "command"), (3, "command"), (4, "config")], "idx long, kind string")
    fn(batch, 0)
    fn(batch, 0)
    assert applied == [3] and mark == [4]


def test_delivery_processor(spark, tmp_path):
    at = str(tmp_path)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "grp string, seq long, op string, at_ms long, epoch long"
        put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{at}/in")
        stream = lambda: queue_processor.deliver(spark.readStream.schema(schema).parquet(f"{at}/in"), 10**9, 1)
        put([("g", 1, "enqueue", 1, None), ("g", 2, "enqueue", 2, None), ("g", 1, "enqueue", 3, None)])
        run_until(stream(), at, 2)
        put([("g", 1, "ack", 4, 1), ("g", 2, "nack", 5, None)])
        run_until(stream(), at, 4)
        put([("g", 2, "ack", 6, 1), ("g", 2, "nack", 7, None)])
        run_until(stream(), at, 6)
        got = sorted((r.seq, r.event, r["count"]) for r in spark.read.parquet(f"{at}/out").collect())
        assert got == sorted([(1, "deliver", 0), (2, "deliver", 0), (1, "acked", 0), (2, "redeliver", 1), (2, "refused", 1), (2, "dead_letter", 2)])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_record_files_resynchronise(spark, tmp_path):
    data = bytearray(b"".join(files.record_bytes(i, i * 10, i == 3, b"p" * i) for i in range(1, 6)))
    second = bytes(data).find(files.MAGIC, 4)
    data[second + 8] ^= 1  # damages record 2
    (tmp_path / "a.rec").write_bytes(b"junk" + bytes(data))
    rows = files.read_records(spark, str(tmp_path), "*.rec").orderBy("seq").collect()
    assert [(r.key, r.seq, r.is_tombstone, len(r.payload)) for r in rows] == [(1, 10, False, 1), (3, 30, True, 3), (4, 40, False, 4), (5, 50, False, 5)]
    listed = files.list_files(spark, str(tmp_path), "a.*").collect()
    assert len(listed) == 1 and listed[0].length == len(data) + 4
    assert bytes(files.read_bytes(spark, str(tmp_path), 0, 4).first()["content"]) == b"junk"


def test_stores(spark, tmp_path):
    assert files.parse_store("s3://bucket/a/b?codec=zstd") == ("s3a", "s3a://bucket/a/b", {"codec": "zstd"})
    with pytest.raises(ValueError):
        files.parse_store("nowhere://x")
    df = spark.createDataFrame([(1, 2, 3, 4.0)], schemas.SERIES)
    for spec in (f"local://{tmp_path}/t", "memory:///m/t"):
        files.save_table(df, spec)
        assert files.open_table(spark, spec, schemas.SERIES).count() == 1
