"""Literal expectations, guards and random models of the engine's operators."""

from __future__ import annotations

import math
import random
import struct as binary

import pytest
from pyspark.sql import functions as F

from tidelog import schemas
from tidelog import timebase as tb
from tidelog.functions import frames, hashes, numeric
from tidelog.operators import collections as co
from tidelog.operators import index, kv, log, queue, replica, series, wal

BASE, W = 10_000_000, 1_000_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def series_of(spark, pairs, sid=0):
    return frame(spark, [(sid, ts, i, float(v)) for i, (ts, v) in enumerate(pairs)], schemas.SERIES)


# -- rollups


def test_rollup_one_window_and_cascade(spark):
    s = series_of(spark, [(BASE + i * 10_000, i) for i in range(60)])
    one = series.rollup(s, W, aggregates=("sum",))
    assert [(r.window, r["sum"]) for r in one.collect()] == [(BASE, 1770.0)]
    two = series.rollup(series.as_series(one, "sum"), 2 * W, aggregates=("sum",))
    assert [r["sum"] for r in two.collect()] == [1770.0]


def test_rollup_family_skips_empty_windows(spark):
    s = series_of(spark, [(BASE + k * W + j, k * 10 + j) for k in range(3) for j in range(3)])
    r = {x.window: x for x in series.rollup(s, W, BASE, BASE + 4 * W).collect()}
    assert sorted(r) == [BASE, BASE + W, BASE + 2 * W]
    assert [r[BASE + k * W]["avg"] for k in range(3)] == [1.0, 11.0, 21.0]
    assert tuple(r[BASE][a] for a in ("min", "max", "sum", "count", "first", "last")) == (0.0, 2.0, 3.0, 3.0, 0.0, 2.0)


def test_rollup_out_of_order_and_guards(spark):
    s = series_of(spark, [(2 * W, 20), (0, 1), (2 * W + 1, 22), (1, 2)])
    assert sorted(r["sum"] for r in series.rollup(s, W, aggregates=("sum",)).collect()) == [3.0, 42.0]
    with pytest.raises(ValueError):
        series.rollup(s, 0)
    assert series.rollup(s, W, 5, 5).count() == 0


def test_rollup_target_appends_or_replaces(spark, tmp_path):
    s = series_of(spark, [(i * W, i) for i in range(3)])
    out = series.rollup(s, W, aggregates=("sum",))
    at = str(tmp_path / "t")
    assert [series.write_rollup(out, "sum", at, m) for m in ("append", "append", "replace")] == [3, 3, 3]
    assert spark.read.parquet(at).count() == 3


def test_rollup_nan_decides_minimum(spark):
    r = series.rollup(series_of(spark, [(0, 1), (1, math.nan), (2, -1)]), W).first()
    assert math.isnan(r["min"]) and math.isnan(r["max"])


def test_weekly_windows_begin_on_monday(spark):
    day = tb.TICKS_PER_DAY
    t = tb.UNIX_EPOCH + 19725 * day  # 2024-01-03
    w = series.rollup(series_of(spark, [(t, 1)]), 7 * day, aggregates=("sum",)).first()["window"]
    assert (w - tb.UNIX_EPOCH) // day == 19723


# -- lookups


def test_ties_latest_floor(spark):
    sec = tb.TICKS_PER_SECOND
    s = series_of(spark, [(i * sec, i) for i in range(11)])
    assert series.latest(s).first()["value"] == 10.0
    probes = frame(spark, [(0, 3 * sec + 1), (0, -1), (9, 5)], "series_id long, t long")
    got = {(r.series_id, r.t): r.value for r in series.floor(s, probes).collect()}
    assert got == {(0, 3 * sec + 1): 3.0, (0, -1): None, (9, 5): None}
    tied = series_of(spark, [(7, 1), (7, 2), (7, 3)])
    assert [r.value for r in series.range_ordered(tied, 0, 100, 0).collect()] == [1.0, 2.0, 3.0]
    assert series.latest(tied).first()["value"] == 3.0
    at = frame(spark, [(0, 7)], "series_id long, t long")
    assert series.floor(tied, at).first()["value"] == 3.0
    assert series.floor(tied, at, strict=True).first()["value"] is None


def test_shuffled_and_empty(spark):
    s = series_of(spark, [(t, t) for t in (5, 1, 4, 0, 3, 2)])
    rows = series.range_ordered(s, 0, 10, 0).collect()
    assert [r.ts for r in rows] == [0, 1, 2, 3, 4, 5] and [r.seq for r in rows] != sorted(r.seq for r in rows)
    none = s.limit(0)
    assert series.latest(none).count() == 0
    assert series.stats_all(none).first().asDict() == {"first_ts": None, "last_ts": None, "live": 0}


def test_guards_of_append(spark):
    trimmed = frame(spark, [(0, 50)], schemas.WATERMARK)
    assert series.admitted(series_of(spark, [(50, 1)]), trimmed).count() == 1
    with pytest.raises(Exception, match="rejected"):
        series.admitted(series_of(spark, [(20, 1)]), trimmed).collect()
    with pytest.raises(Exception, match="too late"):
        series.admitted(series_of(spark, [(20, 1)]), now=100, max_past=10).collect()


def test_truncate(spark):
    s = series_of(spark, [(i, i) for i in range(100)])
    kept, gone = series.truncate(s, 30)
    assert (kept.count(), gone.count()) == (70, 30)
    kept, gone = series.truncate(s, 1 << 62)
    assert (kept.count(), gone.count()) == (0, 100)


def test_byte_cutoff_against_walk(spark):
    rng = random.Random(1)
    day = tb.TICKS_PER_DAY
    rows = [(rng.randrange(20) * day + rng.randrange(50), rng.randrange(1, 9)) for _ in range(300)]
    sized = frame(spark, rows, "ts long, bytes long")
    for budget in (0, 100, 700, sum(b for _, b in rows)):
        excess, acc, want = sum(b for _, b in rows) - budget, 0, None
        for t, b in sorted(rows):
            acc += b
            if excess > 0 and acc >= excess:
                want = t
                break
        got = [r.cutoff for r in series.byte_cutoff(sized, budget).collect()]
        assert got == ([want] if want is not None else [])


# -- key-value


def kv_frame(spark, rows):
    return frame(spark, [(k, v, e, i, t) for i, (k, v, e, t) in enumerate(rows)], "key long, value long, expiry long, seq long, is_tombstone boolean")


def test_byte_order_scans(spark):
    view = kv_frame(spark, [(k, k, 0, False) for k in (0x10, 0x110, 0x210, 0x20, 0x30, -1)])
    assert [r.key for r in kv.scan_prefix(view, 0x10, 1).collect()] == [0x10, 0x110, 0x210]
    assert [r.key for r in kv.scan_prefix(view, 0, 0).collect()] == [0x10, 0x110, 0x210, 0x20, 0x30, -1]
    lg = kv_frame(spark, [(k, k, 0, False) for k in (0x10, 0x110, 0x210, 0x20, 0x30)] + [(0x110, 999, 0, False), (0x20, None, 0, True)])
    assert [(r.key, r.value) for r in kv.scan_range(log.current(lg, ["key"]), 0x110, 0x30).collect()] == [(0x110, 999), (0x210, 0x210)]
    assert kv.scan_range(view, 5, 1).count() == 0


def test_expiry_hides_older_versions(spark):
    lg = kv_frame(spark, [(1, 1, 0, False), (1, 2, 100, False), (2, 3, 101, False)])
    assert [r.key for r in log.current(lg, ["key"], now=100).collect()] == [2]
    assert log.current(lg, ["key"]).count() == 2


def test_watch(spark):
    lg = kv_frame(spark, [(1, 1, 0, False), (2, 2, 0, False), (1, None, 0, True)])
    assert [(r.key, r.kind) for r in kv.watch(lg, -1).collect()] == [(1, "put"), (2, "put"), (1, "delete")]
    assert [r.seq for r in kv.watch(lg, 1).collect()] == [2]
    with pytest.raises(ValueError):
        kv.watch(lg, 1, begin=5)


def test_incremental_view_equals_rebuild(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8), rng.randrange(100), 0, rng.random() < 0.3) for _ in range(60)]
    lg = kv_frame(spark, rows)
    step = log.refresh(log.newest(lg.where("seq < 40"), ["key"]), lg.where("seq >= 40"), ["key"])
    assert sorted(map(tuple, step.collect())) == sorted(map(tuple, log.newest(lg, ["key"]).collect()))
    model = {}
    for i, (k, v, _, t) in enumerate(rows):
        model[k] = (v, t)
    assert {r.key: r.value for r in log.current(lg, ["key"]).collect()} == {k: v for k, (v, t) in model.items() if not t}


def test_compare_and_swap_has_one_winner(spark):
    rows = [(1, 1, None, 10), (1, 2, None, 11), (1, 3, 10, 12), (1, 4, 10, 13), (2, 5, 7, 1)]
    a = frame(spark, rows, "key long, seq long, expected long, value long")
    got = {r.seq: r.success for r in kv.compare_and_swap(a, by="value").collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_increment_overflow_is_an_error(spark):
    d = frame(spark, [(1, 1, 2**63 - 1), (1, 2, 1)], "key long, seq long, delta long")
    with pytest.raises(Exception, match="(?i)overflow"):
        kv.increment_totals(d, ["key"]).collect()


def test_struct_keys(spark):
    from pyspark.sql import types as T

    schema = schemas.kv_schema(T.StructType([T.StructField("id", T.LongType()), T.StructField("tag", T.IntegerType())]), T.StringType())
    lg = frame(spark, [((1, 2), "a", 0, 0, False), ((1, 2), "b", 0, 1, False), ((1, 3), "c", 0, 2, False)], schema)
    assert sorted(r.value for r in log.current(lg, ["key"]).collect()) == ["b", "c"]


def test_tombstones_get_addresses(spark):
    lg = kv_frame(spark, [(1, 1, 0, False), (2, 2, 0, False)])
    dead = kv.tombstones(frame(spark, [(2,), (5,)], "key long"), lg, 10)
    assert sorted((r.key, r.seq, r.is_tombstone) for r in dead.collect()) == [(2, 10, True), (5, 11, True)]
    assert [r.key for r in log.current(lg.unionByName(dead), ["key"]).collect()] == [1]


# -- collections


def zset_of(spark, pairs):
    return frame(spark, [(0, m, float(s), i) for i, (m, s) in enumerate(pairs)], schemas.ZSET)


@pytest.mark.parametrize(("start", "stop", "want"), [(0, -1, "eacbd"), (1, 3, "acb"), (-2, -1, "bd"), (3, 100, "bd"), (4, 2, "")])
def test_rank_ranges(spark, start, stop, want):
    z = zset_of(spark, [("e", 10), ("a", 11), ("c", 12), ("b", 13), ("d", 14)])
    assert "".join(r.member for r in co.rank_range(z, start, stop).orderBy("rank").collect()) == want


def test_reverse_score_pops(spark):
    z = zset_of(spark, [(f"m{i}", i) for i in range(10)])
    assert [r.member for r in co.rank_range(z, 0, 1, reverse=True).orderBy("rank").collect()] == ["m9", "m8"]
    assert [r.member for r in co.rank_range(z, -1, -1, reverse=True).collect()] == ["m0"]
    assert co.score_count(z, 3, 6).first()["n"] == 4 and co.score_range(z, 6, 3).count() == 0
    assert co.score_count(z, -math.inf, math.inf).first()["n"] == 10
    with pytest.raises(ValueError):
        co.score_range(z, math.nan, 1)
    z = zset_of(spark, [("mid", 5), ("low", 1), ("high", 9), ("neg", -3.5)])
    popped, rest = co.pop(z)
    assert popped.first()["member"] == "neg" and rest.count() == 3
    assert co.pop(z, highest=True)[0].first()["member"] == "high"
    assert co.pop(z.limit(0))[0].count() == 0


def test_set_algebra(spark):
    rows = [(1, "s1"), (1, "s2"), (1, "a"), (2, "s1"), (2, "s2"), (2, "b"), (3, "x")]
    v = frame(spark, rows, "domain long, member string")
    assert co.intersect(v, 1, 2).count() == 2 and co.union(v, [1, 2, 3]).count() == 5
    assert [r.member for r in co.difference(v, 1, 2).collect()] == ["a"]
    assert co.intersect(v, 1, 77).count() == 0 and co.union(v, []).count() == 0


def test_nan_score_is_an_error(spark):
    with pytest.raises(Exception, match="not a number"):
        co.checked_scores(zset_of(spark, [("a", math.nan)])).collect()


def test_score_codec_is_monotone(spark):
    xs = [-math.inf, -1e300, -1.5, -1e-300, -0.0, 0.0, 1e-300, 2.5, 1e300, math.inf]
    rows = frame(spark, [(i, x) for i, x in enumerate(xs)], "i int, x double").withColumn("c", numeric.encode_score("x")).withColumn("y", numeric.decode_score("c")).orderBy("i").collect()
    codes = [bytes(r.c) for r in rows]
    assert codes == sorted(codes) and codes[4] == codes[5] and [r.y for r in rows] == xs
    with pytest.raises(Exception, match="not a number"):
        frame(spark, [(math.nan,)], "x double").select(numeric.encode_score("x")).collect()


# -- queues


def test_delay_order(spark):
    q = frame(spark, [(1, None), (2, 900), (3, 250)], "seq long, due_ts long")
    none = frame(spark, [], schemas.GROUP_STATE)
    assert [r.seq for r in queue.deliverable(q, none, 1000, 10).orderBy("place").collect()] == [1, 3, 2]
    assert [r.seq for r in queue.deliverable(q, none, 300, 10).orderBy("place").collect()] == [1, 3]
    with pytest.raises(ValueError):
        queue.delayed(q, 0, 1, offset=-1)
    with pytest.raises(ValueError):
        queue.cancel(q, start=1)
    with pytest.raises(Exception, match="delay"):
        queue.resolve_due(q, 0, 300).collect()


def state_of(spark, rows):
    return frame(spark, [("g", s, "c", 0, n, e, a) for s, n, e, a in rows], schemas.GROUP_STATE)


def test_cursor_holes_fencing(spark):
    s = state_of(spark, [(1, 0, 1, True), (2, 0, 2, False), (3, 0, 1, True), (4, 0, 1, False)])
    assert queue.ack_cursors(s).first().asDict() == {"group": "g", "cursor": 2, "holes": 1}
    old = frame(spark, [("g", 2, 1)], "group string, seq long, epoch long")
    with pytest.raises(Exception, match="older delivery"):
        queue.acknowledge(s, old).collect()
    assert queue.ack_cursors(queue.acknowledge(s, old, fenced=False)).first()["cursor"] == 4
    with pytest.raises(Exception, match="too many"):
        queue.acknowledge(s, old.limit(0), max_in_flight=0).collect()


def test_dead_letter_after_two_nacks(spark):
    m = frame(spark, [(1, bytearray(b"abc"), None, None, None)], schemas.QUEUE)
    s = state_of(spark, [(1, 0, 1, False)])
    once = queue.after_failure(s, ~F.col("acked"), 0, 1)
    assert (once.first()["redelivery"], once.first()["outcome"]) == (1, "redeliver")
    twice = queue.after_failure(once.select(s.columns), ~F.col("acked"), 0, 1)
    r = queue.dead_letters(twice, m).first()
    assert (r.source_seq, r.group, r.final_count, bytes(r.payload)) == (1, "g", 2, b"abc")


# -- log, wal, blobs


def test_dense_index_is_gapless(spark):
    df = spark.range(5000).withColumn("x", F.xxhash64("id"))
    got = [(r.x, r.idx) for r in log.dense_index(df, ["x"], 7).orderBy("idx").collect()]
    assert [i for _, i in got] == list(range(7, 5007)) and [x for x, _ in got] == sorted(x for x, _ in got)


def test_wal_guards_and_damage(spark, tmp_path):
    w = frame(spark, [(i, bytearray(b"x"), i == 2) for i in range(1, 6)], schemas.WAL)
    assert [r.idx for r in wal.read_from(w, 1).collect()] == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        wal.read_from(w, 1, head=3)
    assert wal.read_from(w, 99).count() == 0
    bad = w.withColumn("valid", F.col("idx") != 4)
    assert [r.idx for r in wal.read_from(bad, 1).collect()] == [1, 3]
    rest = wal.snapshot(w, 3, str(tmp_path / "snap"))
    assert [r.idx for r in rest.collect()] == [4, 5]
    w.where("idx = 1").write.mode("overwrite").parquet(str(tmp_path / "snap/entries"))
    with pytest.raises(ValueError, match="damaged"):
        wal.read_snapshot(spark, str(tmp_path / "snap"), w.schema)


def test_blob_chunk_damage(spark):
    b = frame(spark, [(1, 5, 0, 0, bytearray(b"hello")), (2, 0, 0, 0, bytearray(b""))], schemas.BLOB)
    parts = wal.chunks(b, 2)
    assert {r.object_id: bytes(r.content) for r in wal.assemble(parts).collect()} == {1: b"hello", 2: b""}
    with pytest.raises(Exception, match="checksum"):
        wal.assemble(parts.withColumn("crc", F.col("crc") + 1)).collect()


# -- replicas, indexes, functions


def test_phi(spark):
    steady = frame(spark, [("a", 10 * i) for i in range(20)] + [("b", 5), ("b", 6)], "node string, at long")
    got = {r.node: r.phi for r in replica.phi_accrual(steady, 200).collect()}
    assert got["b"] == 0.0
    assert got["a"] == pytest.approx(-math.log10(0.5), abs=1e-6)  # due now
    x = frame(spark, [(v / 10,) for v in range(-60, 61)], "x double")
    for r in x.withColumn("p", numeric.normal_tail(F.col("x"))).collect():
        assert r.p == pytest.approx(math.erfc(r.x / 2**0.5) / 2, rel=2e-7)


def test_hybrid_clock_of_known_events(spark):
    """State (10, 0), wall time 5, remote (7, 4): the physical part stays, so the logical part
    passes the remote one, however old it is."""
    e = [(1, 1, 10, None, None), (1, 2, 5, 7, 4), (1, 3, 5, 12, 3), (1, 4, 20, 20, 6), (1, 5, 20, None, None), (1, 6, 30, 25, 9), (2, 1, 0, None, None), (2, 2, 0, 0, 5), (2, 3, 0, 0, 1)]
    m = frame(spark, e, "node long, seq long, now long, remote_physical long, remote_logical long")
    got = {(r.node, r.seq): (r.physical, r.logical) for r in replica.hybrid_receive(m).collect()}
    assert got == {(1, 1): (10, 0), (1, 2): (10, 5), (1, 3): (12, 4), (1, 4): (20, 7), (1, 5): (20, 8), (1, 6): (30, 0), (2, 1): (0, 1), (2, 2): (0, 6), (2, 3): (0, 7)}


def test_hybrid_receive_against_model(spark):
    rng = random.Random(3)
    rows = [(n, i, rng.randrange(50), *((rng.randrange(60), rng.randrange(5)) if rng.random() < 0.5 else (None, None))) for n in (1, 2) for i in range(80)]
    m = frame(spark, rows, "node long, seq long, now long, remote_physical long, remote_logical long")
    got = {(r.node, r.seq): (r.physical, r.logical) for r in replica.hybrid_receive(m).collect()}
    for node in (1, 2):
        p = c = 0
        for n, i, now, rp, rc in rows:
            if n != node:
                continue
            if rp is None:  # a local event
                p, c = (now, 0) if now > p else (p, c + 1)
            elif max(p, rp, now) > p:
                p = max(p, rp, now)
                c = rc + 1 if p == rp else 0
            else:
                c = max(c, rc) + 1
            assert got[n, i] == (p, c)


def test_block_ids_and_guard(spark):
    r = frame(spark, [("k", 1, 3), ("k", 2, 1), ("j", 3, 2)], "key string, seq long, n long")
    got = {x.seq: (x.first_id, x.last_id) for x in replica.allocate_ids(r, F.col("n")).collect()}
    assert got == {1: (1, 3), 2: (4, 4), 3: (1, 2)}
    with pytest.raises(Exception, match="count of 1"):
        replica.allocate_ids(r, F.col("n") - 3).collect()


def test_floor_many_against_model(spark):
    rng = random.Random(4)
    keys = sorted({rng.randrange(1000) for _ in range(80)})
    probes = [rng.randrange(-5, 1010) for _ in range(100)]
    k = frame(spark, [(x, i) for i, x in enumerate(keys)], "key long, seq long")
    p = frame(spark, [(x,) for x in probes], "probe long").distinct()
    for strict in (False, True):
        for r in index.floor_many(k, p, strict).collect():
            below = [x for x in keys if (x < r.probe if strict else x <= r.probe)]
            assert r.key == (below[-1] if below else None)


def test_hashes_of_known_texts(spark):
    r = frame(spark, [(bytearray(b"123456789"),), (bytearray(b""),), (None,)], "b binary").select(hashes.crc32c("b").alias("c"), hashes.crc64("b").alias("d"), hashes.xxh64("b").alias("x")).collect()
    # the check value of CRC-64 of ECMA-182, its bytes in reverse order
    assert r[0].c == 0xE3069283 and r[0].d & (1 << 64) - 1 == int.from_bytes((0x6C40DF5F0B497347).to_bytes(8, "big"), "little") and r[1].c == 0 == r[1].d
    assert r[1].x & (1 << 64) - 1 == 0xEF46DB3751D8E999 and r[2].x is None


def test_checksums_of_any_length(spark):
    def plain(data, poly, bits, reflected, ones):
        c = (1 << bits) - 1 if ones else 0
        for byte in data:
            c ^= byte if reflected else byte << (bits - 8)
            for _ in range(8):
                if reflected:
                    c = c >> 1 ^ poly if c & 1 else c >> 1
                else:
                    c = (c << 1 & (1 << bits) - 1) ^ poly if c >> (bits - 1) else c << 1
        return c ^ (1 << bits) - 1 if ones else c

    rng = random.Random(7)
    rows = [(i, bytearray(rng.randbytes(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 7, 8, 9, 255, 256, 257, 511, 512, 513, 3000, 70_001])] + [(99, bytearray(300))]
    got = frame(spark, rows, "i int, b binary").select("i", hashes.crc32c("b").alias("c"), hashes.crc64("b").alias("d")).collect()
    for (_, b), r in zip(sorted(rows), sorted(got), strict=True):
        assert r.c == plain(b, 0x82F63B78, 32, True, True)
        assert (r.d & (1 << 64) - 1).to_bytes(8, "little") == plain(b, 0x42F0E1EBA9EA3693, 64, False, False).to_bytes(8, "big")


def test_frames(spark):
    one = frame(spark, [(5, bytearray(b"pay"))], "e long, p binary").withColumn("f", frames.wrap_value(F.col("e"), F.col("p")))
    assert bytes(one.first()["f"]) == b"\xc8" + binary.pack("<q", 5) + b"pay"
    back = one.select(frames.unwrap_value(F.col("f")).alias("u")).first()["u"]
    assert back.expiry == 5 and bytes(back.payload) == b"pay"
    assert frame(spark, [(bytearray(b"zz"),)], "f binary").select(frames.unwrap_value(F.col("f")).alias("u")).first()["u"] is None


def test_envelopes_are_bytes_with_flags(spark):
    x = frame(spark, [(3, -9, 4, bytearray(b"pay")), (1 << 31, 1 << 60, None, bytearray(b""))], "s long, t long, q long, p binary")
    s, t, q, p = (F.col(c) for c in "stqp")
    dense, sparse = frames.sample_envelope(s, t, q, p), frames.sample_envelope(None, t, q, p)
    rows = x.select(dense.alias("d"), sparse.alias("e"), frames.unwrap_sample(dense).alias("u"), frames.unwrap_sample(sparse, dense=False).alias("v"), frames.unwrap_sample(sparse).alias("none")).collect()
    assert bytes(rows[0].d) == b"TTS2\x01" + binary.pack("<Iqq", 3, -9, 4) + b"pay" and bytes(rows[1].d) == b"TTS2\x00" + binary.pack("<Iqq", 1 << 31, 1 << 60, 0)
    assert bytes(rows[0].e) == b"TTS1\x01" + binary.pack("<qq", -9, 4) + b"pay"
    assert (rows[0].u.flags, rows[0].u.series_id, rows[0].u.ts, rows[0].u.seq, bytes(rows[0].u.payload)) == (1, 3, -9, 4, b"pay")
    assert (rows[1].u.series_id, rows[1].u.seq, rows[1].v.ts, rows[1].v.flags) == (1 << 31, 0, 1 << 60, 0) and rows[0].none is None
    m = frame(spark, [(7, 8, 9, bytearray(b"x")), (7, None, None, bytearray(b"y"))], "a long, b long, c long, p binary")
    e = frames.message_envelope(F.col("a"), F.col("b"), F.col("c"), F.col("p"))
    rows = m.select(e.alias("e"), frames.unwrap_message(e).alias("u"), frames.unwrap_message(F.substring(e, 1, 20)).alias("none")).collect()
    assert bytes(rows[0].e) == b"TQE1\x03" + binary.pack("<qqq", 7, 8, 9) + b"x" and bytes(rows[1].e) == b"TQE1\x00" + binary.pack("<qqq", 7, 0, 0) + b"y"
    assert rows[0].u.due_ts == 9 and rows[0].none is None
    d = frame(spark, [("gröup", bytearray(b"dead"))], "g string, p binary")
    e = frames.dead_letter_envelope(F.lit(2), F.lit(0), F.lit(640), F.col("g"), F.lit(4), F.col("p"))
    r = d.select(e.alias("e"), frames.unwrap_dead_letter(e).alias("u"), frames.unwrap_dead_letter(F.substring(e, 1, 34)).alias("none")).first()
    name = "gröup".encode()
    assert bytes(r.e) == b"QCDLQ01\x00" + binary.pack("<iiqii", 2, 0, 640, 4, len(name)) + name + b"dead"
    assert (r.u.segment, r.u.offset, r.u.final_count, r.u.group, bytes(r.u.payload)) == (2, 640, 4, "gröup", b"dead") and r.none is None


def test_sizes(spark):
    ok = frame(spark, [("4k",), ("8MB",), ("1GiB",), ("12",), ("4ki",), ("3Tb",)], "s string").select(numeric.parse_size(F.col("s")).alias("n")).collect()
    assert [r.n for r in ok] == [4096, 8 << 20, 1 << 30, 12, 4096, 3 << 40]
    for bad in ("4x", "8B", "8iB", "1 k", " 4k", "k", "", "4kBx", "9999999999p"):
        with pytest.raises(Exception, match="not a size"):
            frame(spark, [(bad,)], "s string").select(numeric.parse_size(F.col("s"))).collect()
    want = {0: "0B", 512: "512B", 999: "999B", 1000: "0.9765625KB", 1536: "1.5KB", 4096: "4KB", 1 << 20: "1MB", 1_000_000: "976.5625KB", 5 << 40: "5TB", -5: "-5B"}
    got = frame(spark, [(k,) for k in want], "n long").select("n", numeric.pretty_size(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == want


def test_globs(spark):
    names = frame(spark, [("a%b",), ("axb",), ("ab",)], "n string")
    assert [r.n for r in names.where(frames.glob(F.col("n"), "a%b")).collect()] == ["a%b"]
    assert [r.n for r in names.where(frames.glob(F.col("n"), "a?b")).orderBy("n").collect()] == ["a%b", "axb"]


def test_magic_location(spark):
    m = frame(spark, [(bytearray(b"..TLR..TLR"),)], "d binary")
    at = lambda *a, **k: frames.locate_magic(F.col("d"), *a, **k)["offset"]
    assert m.select(at(b"TLR").alias("a"), at(b"TLR", last=True).alias("b"), at(b"TLR", step=3).alias("c"), at(b"Q").alias("e"), at([b"LR.", b"R.."], last=True).alias("f")).first() == (2, 7, None, None, 4)
    assert m.select(at(b"TLR", start=3).alias("a"), at(b"TLR", end=9).alias("b"), at(b"TLR", last=True, end=9).alias("c")).first() == (7, 2, 2)
    rng = random.Random(3)
    for magics, page, step in (([b"ab"], 16, 1), ([b"aa", b"ba"], 8, 2), ([b"\x00\xff"], 64, 4)):
        for _ in range(12):
            data = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(0, 90)))
            start, end = rng.randrange(0, 9), rng.randrange(40, 99)
            hits = [i for i in range(start, min(end, len(data)) - 1) if data[i : i + 2] in magics and (i - start) % page + 2 <= page and (i - start) % page % step == 0]
            df = frame(spark, [(bytearray(data),)], "d binary")
            a, b = df.select(frames.locate_magic(F.col("d"), magics, start=start, end=end, page=page, step=step).alias("a"), frames.locate_magic(F.col("d"), magics, True, start, end, page, step).alias("b")).first()
            assert (a and a.offset) == (hits[0] if hits else None) and (b and b.offset) == (hits[-1] if hits else None)
            assert not hits or b.page == start + (hits[-1] - start) // page * page
    big = frame(spark, [(bytearray(b"x." * 5_000_000 + b"TLR1" + b"y" * 9),)], "d binary")
    assert big.select(at(b"TLR1", page=1 << 30).alias("a")).first().a == 10_000_000  # linear: ten megabytes in a moment


# -- queues against a simulator of one group


class Group:
    """One group as the engine's rules have it: a pull frees what is overdue, then delivers."""

    def __init__(self, limit, backoff, visibility):
        self.limit, self.backoff, self.visibility = limit, backoff, visibility
        self.pending, self.count, self.dead, self.acked = {}, {}, set(), set()

    def pull(self, messages, now, n, floor):
        for s, (at, waits) in list(self.pending.items()):
            if at > now:
                continue
            if not waits:
                self.count[s] = self.count.get(s, 0) + 1
                if self.count[s] > self.limit:
                    self.dead.add(s)
                elif self.backoff(self.count[s]) > 0:
                    self.pending[s] = (now + self.backoff(self.count[s]), True)
                    continue
            del self.pending[s]
        open_ = [(0, s, s) for s, due in messages if due is None] + [(1, due, s) for s, due in messages if due is not None and due <= now]
        out = [s for _, _, s in sorted(open_) if s >= floor and s not in self.pending and s not in self.dead and s not in self.acked][:n]
        for s in out:
            self.pending[s] = (now + self.visibility, False)
        return [(s, self.count.get(s, 0)) for s in out]


def test_dequeue_against_simulator(spark):
    rng = random.Random(11)
    schema = "`group` string, seq long, consumer string, deliver_ms long, redelivery int, epoch long, acked boolean, next_ms long, waiting boolean"
    q = [(s, s * 7 if s % 4 == 0 else None) for s in range(30)]
    m = frame(spark, q, "seq long, due_ts long")
    back = F.when(F.col("redelivery") == 1, 15).otherwise(0)
    model = Group(2, lambda n: 15 if n == 1 else 0, 20)
    st, dead = frame(spark, [], schema), set()
    for now in (0, 10, 25, 45, 60, 90, 130):
        got, after = queue.dequeue(m, st, now, now, 6, "me", 1, 20, 2, back)
        assert sorted((r.place, r.seq, r.redelivery) for r in got.collect()) == [(i + 1, s, c) for i, (s, c) in enumerate(model.pull(q, now, 6, 0))]
        rows = after.collect()
        dead |= {r.seq for r in rows if r.outcome == "dead_letter"}
        assert dead == model.dead
        keep = []
        for r in rows:
            acked = r.acked or r.seq in dead  # a dead letter is settled where it was
            if r.seq in model.pending and not model.pending[r.seq][1] and rng.random() < 0.3:
                del model.pending[r.seq]
                model.acked.add(r.seq)
                acked = True
            keep.append((*r[:6], acked, r.next_ms, r.waiting))
        st = frame(spark, keep, schema)
    assert dead and model.acked


def test_backlog_policies(spark):
    log_ = frame(spark, [(i, "x" * 10) for i in range(10)], "seq long, payload string")
    g = frame(spark, [("a", 2, 1, False), ("b", 6, 1, False), ("c", 0, 1, True)], "`group` string, cursor long, epoch long, fenced boolean")
    new = frame(spark, [(i, "x" * 10) for i in range(10, 16)], "seq long, payload string")
    size = F.length("payload")
    out = lambda *a, **k: [r.outcome for r in queue.admit(new, log_, g, size, *a, **k)[0].orderBy("seq").collect()]
    # 80 bytes are held: the backlog is tested before each message, the one that crosses it enters
    assert out(95) == ["admitted", "admitted", *["rejected"] * 4]
    assert out(79) == ["rejected"] * 6
    assert out(95, "block", waited=F.col("seq") > 13) == ["admitted", "admitted", "waiting", "waiting", "rejected", "rejected"]
    fenced = lambda limit: {r.group for r in queue.admit(new, log_, g, size, limit, "evict")[1].where("fenced").collect()}
    assert out(95, "evict") == ["admitted"] * 6 and fenced(95) == {"a", "c"} and fenced(80) == {"a", "b", "c"} and fenced(500) == {"c"}
    pin = frame(spark, [(1,)], "seq long")
    assert out(95, "evict", unready=pin) == ["admitted", *["rejected"] * 5]
    none = g.withColumn("fenced", F.lit(True))
    assert {r.outcome for r in queue.admit(new, log_, none, size, 0)[0].collect()} == {"admitted"}
    with pytest.raises(ValueError):
        queue.admit(new, log_, g, size, 0, "never")
    assert queue.slowest(g).first().group == "a"
    stats = {r.group: (r.lag, r.lag_bytes, r.fenced) for r in queue.group_stats(log_, frame(spark, [], schemas.GROUP_STATE), g, size).collect()}
    assert stats == {"a": (8, 80, False), "b": (4, 40, False), "c": (0, 0, True)}


def test_lag_over_many_ranges(spark):
    rng = random.Random(5)
    seqs = sorted({rng.randrange(0, 1 << 40) for _ in range(300)} | {rng.randrange(0, 200_000) for _ in range(300)})
    log_ = frame(spark, [(s, s % 9) for s in seqs], "seq long, b long")
    cursors = [(f"g{i}", c) for i, c in enumerate([0, seqs[3], seqs[3], seqs[100] + 1, seqs[-1], seqs[-1] + 1, 1 << 45])]
    got = {r.group: (r.lag, r.lag_bytes) for r in queue.lag(log_, frame(spark, cursors, "`group` string, cursor long"), F.col("b")).collect()}
    assert got == {g: (sum(s >= c for s in seqs), sum(s % 9 for s in seqs if s >= c)) for g, c in cursors}


def test_groups_begin_anew_or_go(spark):
    m = frame(spark, [(i, "x") for i in range(5, 9)], "seq long, payload string")
    g = frame(spark, [("a", 6, 1, True), (queue.DEFAULT_GROUP, 5, 1, False)], "`group` string, cursor long, epoch long, fenced boolean")
    s = state_of(spark, [(6, 0, 1, False)]).withColumn("group", F.lit("a"))
    groups, left = queue.reset_group(g, s, "a", m, "latest")
    assert {tuple(r) for r in groups.collect()} == {("a", 9, 2, False), (queue.DEFAULT_GROUP, 5, 1, False)} and left.count() == 0
    assert queue.delete_group(g, s, "a")[0].count() == 1 and queue.delete_group(g, s, "a")[1].count() == 0
    with pytest.raises(ValueError):
        queue.delete_group(g, s, queue.DEFAULT_GROUP)
    with pytest.raises(Exception, match="does not exist"):
        queue.delete_group(g, s, "z")[0].collect()
    with pytest.raises(Exception, match="does not exist"):
        queue.reset_group(g, s, "z", m)[0].collect()
    with pytest.raises(Exception, match="exists"):
        queue.create_group(g, "a", m).collect()
    assert queue.create_group(g, "n", m, "address", 7).where("`group` = 'n'").first().cursor == 7


# -- transactions, leases, codecs


def test_leases_by_hand(spark):
    from tidelog.operators import transactions as tx

    rows = [("l", 1, 0, "a", "acquire", 10, None), ("l", 2, 5, "b", "acquire", 10, None), ("l", 3, 9, "a", "acquire", 10, None), ("l", 4, 12, "a", "release", 0, 9), ("l", 5, 13, "a", "release", 0, 1), ("l", 6, 13, "b", "acquire", 5, None), ("l", 7, 18, "c", "acquire", 5, None)]
    got = tx.leases(frame(spark, rows, "name string, seq long, at_ms long, owner string, op string, lease_ms long, token long")).orderBy("seq").collect()
    assert [(r.granted, r.fence) for r in got] == [(True, 1), (False, None), (True, 1), (False, None), (True, None), (True, 6), (True, 7)]


def test_reconcile_without_commits(spark):
    from tidelog.operators import transactions as tx

    p = frame(spark, [("x", 5, 3), ("y", 3, 3)], "participant string, prepared long, committed long")
    none = frame(spark, [], "seq long")
    assert [tuple(r) for r in tx.reconcile(none, p).collect()] == [("x", "abort", 5)]
    some = frame(spark, [(4,)], "seq long")
    assert sorted(tuple(r) for r in tx.reconcile(some, p).collect()) == [("x", "confirm", 4), ("y", "confirm", 4)]


def test_in_place_writes_have_limits(spark):
    from tidelog.operators import transactions as tx

    lg = frame(spark, [(1, "abc"), (2, "d")], "seq long, value string")
    put = lambda rows: tx.update_in_place(lg, frame(spark, rows, "seq long, value string"), F.lit(4)).orderBy("seq").collect()
    assert [r.value for r in put([(2, "long")])] == ["abc", "long"]
    with pytest.raises(Exception, match="too long"):
        put([(2, "longer")])
    with pytest.raises(Exception, match="no record"):
        put([(9, "x")])
    b = frame(spark, [(1, bytearray(b"0123456789"))], "object_id long, content binary")
    at = lambda off: bytes(tx.write_at(b, frame(spark, [(1, off, bytearray(b"AB"))], "object_id long, offset int, data binary")).first().content)
    assert at(0) == b"AB23456789" and at(9) == b"012345678AB" and at(10) == b"0123456789AB"
    with pytest.raises(Exception, match="beyond"):
        at(11)


def test_typed_store_refuses_other_types(spark, tmp_path):
    from pyspark.sql import types as T

    from tidelog.codecs import TypedStore

    store = TypedStore(spark, str(tmp_path / "s"), T.LongType(), T.StringType())
    store.put(frame(spark, [(1, "a", 1)], "key long, value string, seq long"), 0)
    with pytest.raises(TypeError):
        store.put(frame(spark, [(1, 2, 2)], "key long, value long, seq long"), 0)
    assert store.current().first().value == "a"


def test_folds_by_range_merge_and_order(spark):
    from pyspark.sql import types as T

    rng = random.Random(2)
    rows = [(rng.randrange(5), s, float(rng.randrange(100))) for s in rng.sample(range(1 << 20), 400)]
    inputs = frame(spark, rows, "key long, seq long, value double")
    more = lambda a, v: F.greatest(a, v)
    want = {k: max(v for x, _, v in rows if x == k) for k in range(5)}
    assert {r.key: r.value for r in kv.fold(inputs, F.lit(-1.0), more, more, bits=4).collect()} == want

    class Most(kv.Functions):
        def initial(self, key, value):
            return value

        def update(self, state, key, value):
            return max(state, value)

        def merge(self, a, b):
            return max(a, b)

    old, kv._STATES = kv._STATES, 2
    try:
        assert {r.key: r.value for r in kv.read_modify_write(inputs, Most(), T.DoubleType()).collect()} == want
    finally:
        kv._STATES = old


def test_hot_keys_are_found(spark, monkeypatch):
    from tidelog.operators import ordered

    df = frame(spark, [(1, i) for i in range(30)] + [(k, 0) for k in range(2, 20)], "key long, seq long")
    assert ordered.has_hot_key(df, ["key"], 20) and not ordered.has_hot_key(df, ["key"], 30)
    monkeypatch.setattr(ordered, "HOT_ROWS", 10)
    spread = kv.increments(df.withColumn("delta", F.lit(1)), ["key"]).where("key = 1").orderBy("seq").collect()
    assert [r.after for r in spread] == list(range(1, 31))


def test_command_line_lists(capsys):
    from tidelog.__main__ import main

    assert main(["--list"]) == 0 and "kv_cas_value" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["kv_cas_value"])
