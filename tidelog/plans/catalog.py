"""Every operator of the engine as a query over the driver's tables, with its DuckDB oracle.

Tables stand for logs: events are series (user, ticks, event_id, value) and queue messages,
orders a key-value log (customer, order key as address), part sorted sets by brand, users
by event type sets, documents blobs, lineitem blocks and id requests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import timebase as tb
from tidelog.functions import frames, hashes, numeric
from tidelog.operators import collections as co
from tidelog.operators import index, kv, log, queue, replica, series, wal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Query to the rows of the operator inventory that it shows.
INVENTORY: dict[str, str] = {}

HOUR, DAY = tb.TICKS_PER_HOUR, tb.TICKS_PER_DAY
#: 2024-01-01 in ticks.
BASE = tb.UNIX_EPOCH + 1_704_067_200 * tb.TICKS_PER_SECOND

#: Common table expressions of the oracles.
VIEWS = {
    "s": f"SELECT user_id AS series_id, epoch_us(ts) * 10 + {tb.UNIX_EPOCH} AS ts, event_id AS seq, value FROM events",
    "kvlog": "SELECT o_custkey AS key, o_totalprice AS value, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 1000 + 1 ELSE 0 END AS expiry, o_orderkey AS seq, o_orderkey % 7 = 0 AS is_tombstone FROM orders",
    "newest": "SELECT * FROM kvlog QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    "live": "SELECT * FROM newest WHERE NOT is_tombstone AND NOT (expiry != 0 AND expiry <= 500)",
    "z": "SELECT p_brand AS domain, CAST(p_partkey AS VARCHAR) AS member, p_retailprice AS score, p_partkey AS seq FROM part",
    "m": "SELECT DISTINCT event_type AS domain, user_id AS member FROM events",
    "h": "SELECT domain, field, value, seq FROM (SELECT o_custkey % 100 AS domain, o_orderpriority AS field, o_orderstatus AS value, o_orderkey AS seq FROM orders) QUALIFY row_number() OVER (PARTITION BY domain, field ORDER BY seq DESC) = 1",
    "q": "SELECT event_id AS seq, props AS payload, CASE WHEN event_id % 3 = 0 THEN event_id * 10 + event_id % 7 * 100 END AS due_ts, user_id AS producer_id, event_id % 50 AS producer_seq FROM events",
    "st": "SELECT event_type AS \"group\", event_id AS seq, 'c' || CAST(user_id % 5 AS VARCHAR) AS consumer, event_id * 10 AS deliver_ms, CAST(event_id % 6 AS INTEGER) AS redelivery, event_id % 3 + 1 AS epoch, event_id % 5 != 0 AND event_id > 20 AS acked FROM events",
    "cur": 'SELECT "group", min(seq) FILTER (NOT acked) AS cursor FROM st GROUP BY "group"',
    "w": "SELECT row_number() OVER (ORDER BY o_orderkey) AS idx, o_orderkey AS entry, o_orderkey % 13 = 0 AS is_meta FROM orders",
    "b": "SELECT doc_id AS object_id, octet_length(encode(text)) AS length, doc_id * 1000 AS created, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS state, text FROM documents",
}


def _with(sql: str) -> str:
    """The oracle with the views that it names, and those they name, in order."""
    import re

    need: set[str] = set()

    def add(text: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text):
                need.add(v)
                add(VIEWS[v])

    add(sql)
    ctes = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need]
    if not ctes:
        return f"WITH RECURSIVE {sql[5:]}" if "/* recursive */" in sql else sql
    if "/* recursive */" in sql:
        return f"WITH RECURSIVE {', '.join(ctes)}, {sql[5:]}"
    return f"WITH {', '.join(ctes)}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {', '.join(ctes)} {sql}"


def query(rows: str, sql: str | None = None):
    def keep(f):
        name = f.__name__
        QUERIES[name], INVENTORY[name] = f, rows
        if sql:
            ORACLE_SQL[name] = _with(sql)
        return f

    return keep


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events as samples; a range of ticks also becomes a filter of the scan."""
    return _read(spark, d, "events").where(tb.stored_between("ts", start, end)).select(F.col("user_id").alias("series_id"), tb.ticks_of("ts").alias("ts"), F.col("event_id").alias("seq"), "value")


def kv_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.when(k % 5 == 0, k % 1000 + 1).otherwise(0).cast("long").alias("expiry"), k.alias("seq"), (k % 7 == 0).alias("is_tombstone"))


NOW = 500


def live(spark: SparkSession, d: str) -> DataFrame:
    return log.current(kv_log(spark, d), ["key"], NOW)


def zset(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "part").select(F.col("p_brand").alias("domain"), F.col("p_partkey").cast("string").alias("member"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("seq"))


def members(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select(F.col("event_type").alias("domain"), F.col("user_id").alias("member")).distinct()


def fields_log(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select((F.col("o_custkey") % 100).alias("domain"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    return log.newest(fields_log(spark, d), ["domain", "field"])


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, d, "events").select(e.alias("seq"), F.col("props").alias("payload"), F.when(e % 3 == 0, e * 10 + e % 7 * 100).alias("due_ts"), F.col("user_id").alias("producer_id"), (e % 50).alias("producer_seq"))


def state(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, d, "events").select(
        F.col("event_type").alias("group"), e.alias("seq"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("consumer"), (e * 10).alias("deliver_ms"),
        (e % 6).cast("int").alias("redelivery"), (e % 3 + 1).alias("epoch"), ((e % 5 != 0) & (e > 20)).alias("acked"),
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_orderkey") % 13 == 0).alias("is_meta"))
    return log.dense_index(o, ["entry"])


def blobs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return _read(spark, d, "documents").select(i.alias("object_id"), F.octet_length("text").cast("long").alias("length"), (i * 1000).alias("created"), F.when(i % 11 == 0, 1).otherwise(0).alias("state"), F.encode("text", "UTF-8").alias("content"))


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- time series


@query("E1 E2 E3 E4 E5 E6 E7 E8", f"""SELECT series_id, ts - ts % {HOUR} AS "window", min(value) AS min, max(value) AS max, round(sum(value), 6) AS sum, CAST(count(*) AS DOUBLE) AS count,
round(avg(value), 6) AS avg, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last FROM s GROUP BY ALL""")
def ts_rollup_hour_all(spark, d):
    return _rounded(series.rollup(samples(spark, d), HOUR), "sum", "avg")


@query("E1 E4", f'SELECT series_id, ts - ts % {DAY} AS "window", round(sum(value), 6) AS sum FROM s GROUP BY ALL')
def ts_rollup_sum(spark, d):
    return _rounded(series.rollup(samples(spark, d), DAY, aggregates=("sum",)), "sum")


@query("E1", f"""SELECT series_id, ts - ts % {7 * DAY} AS "window", max(v) AS max FROM (SELECT series_id, ts - ts % {HOUR} AS ts, max(value) AS v FROM s GROUP BY ALL) GROUP BY ALL""")
def ts_rollup_cascade(spark, d):
    hourly = series.as_series(series.rollup(samples(spark, d), HOUR, aggregates=("max",)), "max")
    return series.rollup(hourly, 7 * DAY, aggregates=("max",))


@query("E1 C1", f'SELECT series_id, ts - ts % {DAY} AS "window", CAST(count(*) AS DOUBLE) AS count FROM s WHERE ts >= {BASE + 5 * DAY} AND ts < {BASE + 20 * DAY} GROUP BY ALL')
def ts_rollup_range(spark, d):
    return series.rollup(samples(spark, d, BASE + 5 * DAY, BASE + 20 * DAY), DAY, BASE + 5 * DAY, BASE + 20 * DAY, ("count",))


@query("C1", f"SELECT series_id, ts, seq, value FROM s WHERE series_id = 3 AND ts >= {BASE} AND ts < {BASE + 15 * DAY}")
def ts_range(spark, d):
    return series.range_ordered(samples(spark, d, BASE, BASE + 15 * DAY), BASE, BASE + 15 * DAY, 3)


@query("C2 J1", f"SELECT series_id, ts, seq, value FROM s WHERE ts < {BASE + 25 * DAY} AND ts >= {BASE} + series_id % 10 * {DAY}")
def ts_scan_trimmed(spark, d):
    s = samples(spark, d)
    trimmed = s.select("series_id").distinct().withColumn("trimmed_until", F.lit(BASE) + F.col("series_id") % 10 * DAY)
    return series.in_range(s, BASE, BASE + 25 * DAY, trimmed=trimmed)


@query("E9", "SELECT series_id, max(ts) AS ts, arg_max(seq, (ts, seq)) AS seq, arg_max(value, (ts, seq)) AS value FROM s GROUP BY series_id")
def ts_latest(spark, d):
    return series.latest(samples(spark, d))


@query("DJ1", f"""WITH p AS (SELECT DISTINCT series_id, {BASE} + k * {DAY} AS t FROM s, (SELECT unnest([0, 3, 7, 12, 29, 60]) AS k))
SELECT p.series_id, p.t, s.ts, s.seq, s.value FROM p ASOF LEFT JOIN s ON p.series_id = s.series_id AND p.t >= s.ts""")
def ts_floor_asof(spark, d):
    s = samples(spark, d)
    probes = s.select("series_id").distinct().select("series_id", F.explode(F.array(*(F.lit(BASE + k * DAY) for k in (0, 3, 7, 12, 29, 60)))).alias("t"))
    return series.floor(s, probes)


@query("DJ1", f"""WITH p AS (SELECT DISTINCT series_id, {BASE} + k * {DAY} AS t FROM s, (SELECT unnest([0, 3, 7, 12, 29, 60]) AS k))
SELECT p.series_id, p.t, s.ts, s.seq, s.value FROM p ASOF LEFT JOIN s ON p.series_id = s.series_id AND p.t >= s.ts""")
def ts_floor_spread(spark, d):
    s = samples(spark, d)
    probes = s.select("series_id").distinct().select("series_id", F.explode(F.array(*(F.lit(BASE + k * DAY) for k in (0, 3, 7, 12, 29, 60)))).alias("t"))
    return series.floor(s, probes, spread=True)


@query("DJ4 DJ5", """WITH p AS (SELECT series_id, max(ts) AS t FROM s GROUP BY series_id)
SELECT p.series_id, p.t, s.ts, s.seq, s.value FROM p ASOF LEFT JOIN s ON p.series_id = s.series_id AND p.t > s.ts""")
def ts_floor_strict(spark, d):
    s = samples(spark, d)
    return series.floor(s, s.groupBy("series_id").agg(F.max("ts").alias("t")), strict=True)


@query("E10", "SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS live, CAST(NULL AS BIGINT) AS trimmed_until FROM s GROUP BY series_id")
def ts_stats(spark, d):
    return series.stats(samples(spark, d))


@query("E10", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS live FROM s")
def ts_stats_all(spark, d):
    return series.stats_all(samples(spark, d))


@query("G1", "SELECT series_id, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY series_id")
def ts_extremes(spark, d):
    return series.extremes(samples(spark, d))


@query("G12", "SELECT DISTINCT series_id FROM s")
def ts_series_ids(spark, d):
    return series.series_ids(samples(spark, d))


@query("J3", f"SELECT series_id, ts, seq, value FROM s WHERE ts >= {BASE + 10 * DAY}")
def ts_truncate(spark, d):
    return series.truncate(samples(spark, d, BASE + 10 * DAY), BASE + 10 * DAY)[0]


@query("J3", f"SELECT count(*) AS deleted FROM s WHERE series_id = 3 AND ts < {BASE + 10 * DAY}")
def ts_truncate_series_deleted(spark, d):
    return series.truncate(samples(spark, d), BASE + 10 * DAY, 3)[1].agg(F.count(F.lit(1)).alias("deleted"))


@query("J1 J3", f"SELECT series_id, max(t) AS trimmed_until FROM (SELECT DISTINCT series_id, {BASE} + series_id % 10 * {DAY} AS t FROM s UNION ALL SELECT DISTINCT series_id, {BASE + 4 * DAY} FROM s) GROUP BY series_id")
def ts_raise_watermark(spark, d):
    ids = samples(spark, d).select("series_id").distinct()
    return series.raise_watermark(ids.withColumn("trimmed_until", F.lit(BASE) + F.col("series_id") % 10 * DAY), ids.withColumn("trimmed_until", F.lit(BASE + 4 * DAY)))


@query("J5", f"SELECT series_id, ts, seq, value FROM s WHERE ts >= {BASE + 30 * DAY - 7 * DAY}")
def ts_ttl_retention(spark, d):
    return series.truncate(samples(spark, d, BASE + 23 * DAY), series.ttl_cutoff(BASE + 30 * DAY, 7 * DAY))[0]


@query("J6", """WITH e AS (SELECT epoch_us(ts) * 10 + 621355968000000000 AS ts, event_id AS seq, length(props) AS b FROM events),
r AS (SELECT ts, sum(b) OVER (ORDER BY ts, seq) AS acc, sum(b) OVER () - 5000 AS excess FROM e) SELECT min(ts) AS cutoff FROM r WHERE excess > 0 AND acc >= excess HAVING min(ts) IS NOT NULL""")
def ts_bytes_cutoff(spark, d):
    sized = _read(spark, d, "events").select(tb.ticks_of("ts").alias("ts"), F.length("props").alias("bytes"))
    return series.byte_cutoff(sized, 5000)


@query("J7", "SELECT series_id, max(ts) + 1 AS cutoff FROM s WHERE seq < 5000 GROUP BY series_id")
def ts_bytes_cutoff_dense(spark, d):
    return series.dense_byte_cutoffs(samples(spark, d), 5000)


@query("J4", f"WITH f AS (SELECT series_id, min(seq) AS first_live FROM s WHERE ts >= {BASE} + series_id % 10 * {DAY} GROUP BY series_id) SELECT series_id, first_live, (SELECT min(first_live) FROM f) AS pin FROM f")
def ts_slow_series_pin(spark, d):
    s = samples(spark, d)
    trimmed = s.select("series_id").distinct().withColumn("trimmed_until", F.lit(BASE) + F.col("series_id") % 10 * DAY)
    return series.slow_series_pin(s, trimmed)


@query("J2", f"SELECT series_id, ts, seq, CASE WHEN ts < {BASE} + series_id % 10 * {DAY} THEN 'trimmed' WHEN ts < {BASE + 5 * DAY} THEN 'too late' END AS reject FROM s")
def ts_append_guard(spark, d):
    s = samples(spark, d)
    trimmed = s.select("series_id").distinct().withColumn("trimmed_until", F.lit(BASE) + F.col("series_id") % 10 * DAY)
    return series.admitted(s, trimmed, BASE + 30 * DAY, 25 * DAY, fail=False).select("series_id", "ts", "seq", "reject")


@query("B4 B5 B32 B39", "SELECT series_id, ts, seq, value FROM s")
def ts_export_restore(spark, d):
    from tidelog import schemas
    from tidelog.session import shared_folder

    import uuid

    path = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    series.export(samples(spark, d), path, 0, 1 << 62)
    return series.restore(spark, path, schemas.SERIES)


@query("B3", f"SELECT series_id, least({BASE + 2 * DAY}, min(ts)) AS trimmed_until FROM s GROUP BY series_id")
def ts_import_watermark(spark, d):
    from tidelog.session import shared_folder

    import uuid

    s = samples(spark, d)
    trimmed = s.select("series_id").distinct().withColumn("trimmed_until", F.lit(BASE + 2 * DAY))
    return series.import_backup(s, trimmed, f"{shared_folder(spark)}/import-{uuid.uuid4().hex}")


# -- the log and its key-value views


@query("A1 A2", "SELECT key, seq, is_tombstone FROM kvlog WHERE seq >= 1000 AND seq < 20000")
def log_scan(spark, d):
    return log.scan(kv_log(spark, d), 1000, 20000).select("key", "seq", "is_tombstone")


@query("A4 C27", "SELECT seq, key, value FROM kvlog WHERE seq IN (SELECT l_partkey FROM lineitem)")
def log_gather(spark, d):
    return log.gather(kv_log(spark, d), _read(spark, d, "lineitem").select(F.col("l_partkey").alias("seq"))).select("seq", "key", "value")


@query("DJ6", "SELECT key, seq, value FROM newest")
def log_gather_key_order(spark, d):
    lg = kv_log(spark, d)
    return log.gather_in_key_order(lg.groupBy("key").agg(F.max("seq").alias("seq")), lg, "key").select("key", "seq", "value")


@query("A5 A6 A15", "SELECT * FROM kvlog WHERE seq = 100")
def log_read_at(spark, d):
    return log.read_at(kv_log(spark, d), 100)


@query("A7 A8", "SELECT count(*) AS entries, CAST(count(*) FILTER (is_tombstone) AS BIGINT) AS tombstones, max(seq) AS tail FROM kvlog WHERE seq >= 500")
def log_replay(spark, d):
    return log.replay(kv_log(spark, d), 500, {"tombstones": F.count_if(F.col("is_tombstone")), "tail": F.max("seq")})


@query("F4", "SELECT * FROM newest WHERE NOT is_tombstone")
def kv_current(spark, d):
    return log.current(kv_log(spark, d), ["key"])


@query("C13 J39", "SELECT * FROM live")
def kv_ttl_live(spark, d):
    return live(spark, d)


@query("C3 C5 C6", "SELECT key, value, seq FROM live WHERE key = 10")
def kv_get(spark, d):
    return kv.get(live(spark, d), 10)


@query("C4", "SELECT key, value, seq FROM live WHERE key = 10 AND length(CAST(value AS VARCHAR)) <= 64")
def kv_get_into(spark, d):
    return kv.get_into(live(spark, d), 10, 64)


@query("C27", "SELECT * FROM live WHERE key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def kv_get_many(spark, d):
    return kv.get_many(live(spark, d), _read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")))


@query("C7", "SELECT * FROM kvlog WHERE seq = 33 AND NOT is_tombstone AND NOT (expiry != 0 AND expiry <= 500)")
def kv_get_at(spark, d):
    return kv.get_at(kv_log(spark, d), 33, NOW)


@query("C7", "SELECT * FROM (SELECT * FROM kvlog WHERE seq <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_tombstone")
def kv_time_travel(spark, d):
    return log.as_of(kv_log(spark, d), ["key"], 5000)


_SWAP = "concat(" + ", ".join(f"substr(printf('%016X', key), {i}, 2)" for i in range(15, 0, -2)) + ")"


@query("C8 C9", f"SELECT key, value, expiry, seq FROM live WHERE starts_with({_SWAP}, '10')")
def kv_prefix(spark, d):
    return kv.scan_prefix(live(spark, d), 0x10, 1)


@query("C10 C11 I13", f"SELECT key, value, expiry, seq FROM live WHERE {_SWAP} >= '1001000000000000' AND {_SWAP} < '3000000000000000'")
def kv_range(spark, d):
    return kv.scan_range(live(spark, d), 0x110, 0x30)


@query("C14 L4", "WITH o AS (SELECT *, CASE WHEN seq % 11 = 0 THEN 2 WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS rank FROM kvlog) SELECT key, value, expiry, seq, is_tombstone FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, seq DESC) = 1) WHERE NOT is_tombstone")
def kv_session_overlay(spark, d):
    lg = kv_log(spark, d)
    a, b = F.col("seq") % 11 == 0, F.col("seq") % 3 == 0
    return kv.overlay(lg.where(a), lg.where(b & ~a), lg.where(~a & ~b))


@query("B9 F3", "SELECT key, value, pos FROM (SELECT o_custkey AS key, o_totalprice AS value, o_orderkey AS pos FROM orders) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1")
def kv_batch_last_wins(spark, d):
    return kv.last_wins(_read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("pos")))


@query("B8 L22", "SELECT c_custkey AS key, c_custkey IN (SELECT key FROM live) AS existed FROM customer")
def kv_delete(spark, d):
    return kv.delete(_read(spark, d, "customer").select(F.col("c_custkey").alias("key")), live(spark, d))


@query("E11", "SELECT count(*) AS entries FROM newest WHERE NOT is_tombstone")
def kv_count(spark, d):
    return kv.count(kv_log(spark, d))


@query("L7", "SELECT * FROM kvlog WHERE value > 1000")
def kv_valid_upserts(spark, d):
    return kv.valid_upserts(kv_log(spark, d), F.col("value") > 1000)


@query("L6", "SELECT key, round(value * 2, 6) AS doubled FROM live")
def kv_read_with(spark, d):
    return kv.read_with(live(spark, d), doubled=F.round(F.col("value") * 2, 6))


@query("J10", "SELECT coalesce((SELECT min(seq) FROM live), max(seq) + 1) AS new_begin, count(*) FILTER (seq < coalesce((SELECT min(seq) FROM live), 1 << 62)) AS reclaimed FROM kvlog")
def kv_dead_prefix(spark, d):
    return log.dead_prefix(kv_log(spark, d), ["key"], NOW)


@query("J11", "SELECT seq, key FROM kvlog WHERE seq NOT IN (SELECT seq FROM newest WHERE NOT is_tombstone)")
def kv_superseded(spark, d):
    return log.superseded(kv_log(spark, d), ["key"]).select("seq", "key")


@query("J12 K11", "SELECT key, CASE WHEN is_tombstone THEN 'delete' ELSE 'put' END AS kind, seq FROM kvlog WHERE seq > 2000")
def kv_watch(spark, d):
    return kv.watch(kv_log(spark, d), 2000)


class _Sum(kv.Functions):
    def initial(self, key, value):
        return value

    def update(self, state, key, value):
        return state + value

    def aggregate(self):
        return F.sum("value")


class _Farthest(kv.Functions):
    """The value farthest from 150,000, the greater of two as far: any order gives the same."""

    def initial(self, key, value):
        return value

    def update(self, state, key, value):
        return max(state, value, key=lambda v: (abs(v - 150_000), v))

    def merge(self, a, b):
        return self.update(a, None, b)


class _Alternating(kv.Functions):
    """Each value less the state before: depends on the order."""

    def initial(self, key, value):
        return value

    def update(self, state, key, value):
        return value - state

    def valid(self, key, value):
        return value > 1000


@query("E19 K1 K2 L4", "SELECT key, round(sum(value), 4) AS value FROM kvlog GROUP BY key")
def kv_rmw_sum(spark, d):
    return _rounded(kv.read_modify_write(kv_log(spark, d), _Sum(), T.DoubleType()), "value", digits=4)


@query("E19 K1", "SELECT key, arg_max(value, (abs(value - 150000), value)) AS value FROM kvlog GROUP BY key")
def kv_rmw_merge(spark, d):
    return kv.read_modify_write(kv_log(spark, d), _Farthest(), T.DoubleType())


@query("E19 K1 K2", "WITH g AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM kvlog WHERE value > 1000) SELECT key, round(sum(CASE WHEN n % 2 = 1 THEN value ELSE -value END), 4) AS value FROM g GROUP BY key")
def kv_rmw_ordered(spark, d):
    some = kv_log(spark, d).where("value > 1000")
    return _rounded(kv.read_modify_write(some, _Alternating(), T.DoubleType()), "value", digits=4)


@query("E19", "SELECT key, round(max(value), 4) AS value FROM kvlog GROUP BY key")
def kv_fold_max(spark, d):
    more = lambda a, v: F.greatest(a, v)
    return _rounded(kv.fold(kv_log(spark, d), F.lit(0.0), more, more), "value", digits=4)


@query("L1", """WITH a AS (SELECT key, seq, value, CASE WHEN n = 1 THEN NULL WHEN n % 3 = 0 THEN seq ELSE p END AS expected, n FROM
(SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS p FROM kvlog)),
r AS (SELECT key, seq, expected, n, expected IS NULL AS success, CASE WHEN expected IS NULL THEN seq END AS now FROM a WHERE n = 1
UNION ALL SELECT a.key, a.seq, a.expected, a.n, coalesce(a.expected = r.now, false), CASE WHEN a.expected = r.now THEN a.seq ELSE r.now END FROM r JOIN a ON a.key = r.key AND a.n = r.n + 1)
SELECT key, seq, success FROM r /* recursive */""")
def kv_cas_address(spark, d):
    from pyspark.sql import Window as W

    by = W.partitionBy("key").orderBy("seq")
    n = F.row_number().over(by)
    a = kv_log(spark, d).select("key", "seq", "value", n.alias("n"), F.lag("seq").over(by).alias("p"))
    expected = F.when(F.col("n") == 1, None).when(F.col("n") % 3 == 0, F.col("seq")).otherwise(F.col("p"))
    return kv.compare_and_swap(a.select("key", "seq", expected.alias("expected"), "value")).select("key", "seq", "success")


# -- hashes, sets, sorted sets


@query("C17 B10", "SELECT * FROM h WHERE domain = 7")
def hash_get_all(spark, d):
    return co.domain(fields(spark, d), 7)


@query("C15", "SELECT * FROM h WHERE domain = 7 AND field = '1-URGENT'")
def hash_get(spark, d):
    return co.lookup(fields(spark, d), spark.createDataFrame([(7, "1-URGENT")], "domain long, field string"), ["domain", "field"])


@query("C16", "WITH w AS (SELECT DISTINCT o_custkey AS domain, o_orderpriority AS field FROM orders) SELECT domain, field, (domain, field) IN (SELECT (domain, field) FROM h) AS present FROM w".replace("WITH w", "WITH w0").replace("FROM w", "FROM w0"))
def hash_exists(spark, d):
    wanted = _read(spark, d, "orders").select(F.col("o_custkey").alias("domain"), F.col("o_orderpriority").alias("field")).distinct()
    return co.exists(fields(spark, d), wanted, ["domain", "field"])


@query("E12", "SELECT d0.domain, count(h.field) AS n FROM (SELECT DISTINCT o_custkey AS domain FROM orders) d0 LEFT JOIN h ON h.domain = d0.domain GROUP BY d0.domain")
def hash_length(spark, d):
    return co.cardinality(fields(spark, d), _read(spark, d, "orders").select(F.col("o_custkey").alias("domain")))


@query("B10", "WITH a AS (SELECT DISTINCT o_custkey % 100 AS domain, o_orderpriority AS field FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey % 100 AS domain, o_orderpriority AS field FROM orders WHERE o_orderkey % 2 = 1) SELECT * FROM b EXCEPT SELECT * FROM a".replace(" b AS", " b0 AS").replace("FROM b", "FROM b0"))
def hash_set_new_fields(spark, d):
    lg = fields_log(spark, d)
    return co.upsert(log.newest(lg.where("seq % 2 = 0"), ["domain", "field"]), lg.where("seq % 2 = 1"), ["domain", "field"])[1].select("domain", "field")


@query("B11", "SELECT * FROM h WHERE NOT (domain < 50 AND field = '1-URGENT')")
def hash_delete(spark, d):
    gone = fields_log(spark, d).where("domain < 50 and field = '1-URGENT'")
    return co.remove(fields(spark, d), gone, ["domain", "field"])[0]


@query("E17", "SELECT user_id AS key, event_id AS seq, CAST(sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS after FROM events")
def hash_incr_running(spark, d):
    deltas = _read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("delta"))
    return kv.increments(deltas, ["key"]).select("key", "seq", "after")


@query("E17", "SELECT user_id AS key, event_id AS seq, CAST(sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS after FROM events")
def hash_incr_spread(spark, d):
    deltas = _read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("delta"))
    return kv.increments(deltas, ["key"], spread=True).select("key", "seq", "after")


@query("E18", "SELECT user_id AS key, round(sum(value), 6) AS value FROM events GROUP BY user_id")
def zset_incr_totals(spark, d):
    deltas = _read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("value").alias("delta"))
    return _rounded(kv.increment_totals(deltas, ["key"]), "value")


@query("H1", "SELECT DISTINCT member FROM m WHERE domain IN ('click', 'view', 'purchase')")
def set_union(spark, d):
    return co.union(members(spark, d), ["click", "view", "purchase"])


def _of_domain(spark, d, least: bool) -> DataFrame:
    """Members of the least, or greatest, domain, which a join with its one row picks."""
    m = members(spark, d)
    name = m.agg((F.min("domain") if least else F.max("domain")).alias("_name"))
    return m.join(F.broadcast(name), F.col("domain") == F.col("_name")).select(F.lit(0 if least else 1).alias("domain"), "member")


_A, _B = "(SELECT min(event_type) FROM events)", "(SELECT max(event_type) FROM events)"


@query("H2 DJ8", f"SELECT member FROM m WHERE domain = {_A} INTERSECT SELECT member FROM m WHERE domain = {_B}")
def set_intersect(spark, d):
    return co.intersect(_of_domain(spark, d, True).unionByName(_of_domain(spark, d, False)), 0, 1)


@query("H3 DJ9", f"SELECT member FROM m WHERE domain = {_A} EXCEPT SELECT member FROM m WHERE domain = {_B}")
def set_difference(spark, d):
    return co.difference(_of_domain(spark, d, True).unionByName(_of_domain(spark, d, False)), 0, 1)


@query("C18", "SELECT c_custkey AS member, c_custkey IN (SELECT member FROM m) AS present FROM customer")
def set_is_member(spark, d):
    wanted = _read(spark, d, "customer").select(F.col("c_custkey").alias("member"))
    return co.exists(members(spark, d).select("member").distinct(), wanted, ["member"])


@query("C19", f"SELECT member FROM m WHERE domain = {_A}")
def set_members(spark, d):
    return co.domain(_of_domain(spark, d, True), 0).select("member")


@query("E13 E14", "SELECT domain, count(*) AS n FROM m GROUP BY domain")
def set_cardinality(spark, d):
    return co.cardinality(members(spark, d))


@query("B12", f"SELECT c_custkey AS member FROM customer WHERE c_custkey NOT IN (SELECT member FROM m)")
def set_add_new(spark, d):
    view = members(spark, d).select(F.lit(0).alias("domain"), "member", F.lit(0).cast("long").alias("seq")).distinct()
    rows = _read(spark, d, "customer").select(F.lit(0).alias("domain"), F.col("c_custkey").alias("member"), F.lit(1).cast("long").alias("seq"))
    return co.upsert(view, rows, ["domain", "member"])[1].select("member")


@query("B13", "SELECT domain, member FROM m WHERE member NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def set_remove(spark, d):
    gone = members(spark, d).join(_read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("member")), "member", "left_semi")
    return co.remove(members(spark, d), gone, ["domain", "member"])[0]


@query("B14", "SELECT domain, member, CASE WHEN seq % 2 = 1 THEN score * 2 ELSE score END AS score FROM z")
def zset_add(spark, d):
    view = zset(spark, d)
    new = co.checked_scores(view.where("seq % 2 = 1").withColumn("score", F.col("score") * 2).withColumn("seq", F.col("seq") + (1 << 40)))
    return co.upsert(view, new, ["domain", "member"])[0].select("domain", "member", "score")


@query("B15", "SELECT domain, member, score FROM z WHERE seq % 3 != 0")
def zset_remove(spark, d):
    return co.remove(zset(spark, d), zset(spark, d).where("seq % 3 = 0"), ["domain", "member"])[0].select("domain", "member", "score")


@query("C20", "SELECT domain, member, score FROM z WHERE member IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 7)")
def zset_score(spark, d):
    wanted = _read(spark, d, "lineitem").where("l_linenumber = 7").join(_read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("domain"), F.col("p_partkey").cast("string").alias("member"))
    return co.lookup(zset(spark, d), wanted, ["domain", "member"]).select("domain", "member", "score")


@query("C21", "SELECT domain, member, score FROM z WHERE score BETWEEN 1000 AND 1500")
def zset_by_score(spark, d):
    return co.score_range(zset(spark, d), 1000.0, 1500.0).select("domain", "member", "score")


@query("E15", "SELECT domain, count(*) FILTER (score BETWEEN 1000 AND 1500) AS n FROM z GROUP BY domain")
def zset_count(spark, d):
    return co.score_count(zset(spark, d), 1000.0, 1500.0)


@query("F1", "SELECT domain, member, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score, member) - 1 AS r, count(*) OVER (PARTITION BY domain) AS n FROM z) WHERE r >= greatest(0, n - 3) AND r <= n - 1")
def zset_range(spark, d):
    return co.rank_range(zset(spark, d), -3, -1).select("domain", "member", "score", "rank")


@query("F2", "SELECT domain, member, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, member DESC) - 1 AS r FROM z) WHERE r <= 2")
def zset_revrange(spark, d):
    return co.rank_range(zset(spark, d), 0, 2, reverse=True).select("domain", "member", "score", "rank")


@query("F2", "SELECT domain, member, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, member DESC) - 1 AS r, count(*) OVER (PARTITION BY domain) AS n FROM z) WHERE r >= greatest(0, n - 3) AND r <= n - 2")
def zset_revrange_spread(spark, d):
    return co.rank_range(zset(spark, d), -3, -2, reverse=True, spread=True).select("domain", "member", "score", "rank")


@query("G4 G6", "SELECT domain, member, score FROM z QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score, member) = 1")
def zset_popmin(spark, d):
    return co.pop(zset(spark, d))[0].select("domain", "member", "score")


@query("G4 G6", "SELECT domain, member, score FROM z QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score, member) > 1")
def zset_popmin_rest(spark, d):
    return co.pop(zset(spark, d))[1].select("domain", "member", "score")


@query("G5 G6", "SELECT domain, member, score FROM z QUALIFY row_number() OVER (PARTITION BY domain ORDER BY score DESC, member DESC) = 1")
def zset_popmax(spark, d):
    return co.pop(zset(spark, d), highest=True)[0].select("domain", "member", "score")


@query("E16 J8", "SELECT o_custkey % 100 AS domain, count(*) AS n, CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes, max(o_orderkey) AS last_write, max(o_orderkey) + 1000 AS expires FROM orders GROUP BY 1")
def domain_stats(spark, d):
    return co.stats(fields_log(spark, d), F.length("field"), "seq", 1000)


@query("J8", "SELECT domain, field, seq FROM h WHERE domain IN (SELECT domain FROM h GROUP BY domain HAVING 15000 - max(seq) <= 200)")
def domain_ttl(spark, d):
    view = fields(spark, d)
    return co.live_domains(view, "seq", 15_000, 200).select("domain", "field", "seq")


@query("J9", "SELECT domain, field, seq FROM h WHERE domain != 5")
def domain_truncate(spark, d):
    return co.truncate_domain(fields(spark, d), 5)[0].select("domain", "field", "seq")


# -- queues


@query("G10", """WITH o AS (SELECT q.*, CASE WHEN due_ts IS NULL THEN 0 WHEN due_ts <= 50000 THEN 1 END AS segment FROM q WHERE seq NOT IN (SELECT seq FROM st WHERE "group" = (SELECT min(event_type) FROM events)))
SELECT seq, segment, row_number() OVER (ORDER BY segment, coalesce(due_ts, seq), seq) AS place FROM o WHERE segment IS NOT NULL ORDER BY place LIMIT 500""")
def queue_deliverable(spark, d):
    first = _read(spark, d, "events").agg(F.min("event_type").alias("_first"))  # one row
    mine = state(spark, d).join(F.broadcast(first), F.col("group") == F.col("_first")).drop("_first")
    return queue.deliverable(messages(spark, d), mine, 50_000, 500).select("seq", "segment", "place")


@query("J22", """SELECT st."group", cursor, count(*) FILTER (acked AND seq > cursor) AS holes FROM st JOIN cur USING ("group") GROUP BY ALL""")
def queue_ack_cursor(spark, d):
    return queue.ack_cursors(state(spark, d))


@query("J22", """SELECT "group", seq, acked OR seq % 4 = 0 AS acked FROM st""")
def queue_acknowledge(spark, d):
    s = state(spark, d)
    return queue.acknowledge(s, s.where("seq % 4 = 0").select("group", "seq", "epoch"), max_in_flight=1 << 40).select("group", "seq", "acked")


@query("J18", "SELECT producer_id, producer_seq, min(seq) AS seq FROM q GROUP BY ALL")
def queue_dedup(spark, d):
    return queue.deduplicated(messages(spark, d)).select("producer_id", "producer_seq", "seq")


@query("C22", "SELECT seq, due_ts FROM q WHERE due_ts BETWEEN 1000 AND 40000 ORDER BY due_ts, seq LIMIT 300 OFFSET 50")
def queue_delayed_page(spark, d):
    return queue.delayed(messages(spark, d), 1000, 40_000, 50, 300).select("seq", "due_ts")


@query("C23", "SELECT seq, due_ts FROM q WHERE due_ts <= 30000")
def queue_ready(spark, d):
    return queue.ready(messages(spark, d), 30_000).select("seq", "due_ts")


@query("B16", "SELECT seq, CASE WHEN due_ts > 20000 THEN due_ts END AS due_ts FROM q")
def queue_resolve_due(spark, d):
    return queue.resolve_due(messages(spark, d), 20_000).select("seq", "due_ts")


@query("B17", "WITH b0 AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l, min(o_orderkey) AS f FROM orders GROUP BY o_custkey) SELECT o_custkey AS producer_id, unnest(l) AS payload, f + generate_subscripts(l, 1) - 1 AS producer_seq FROM b0")
def queue_batch_numbers(spark, d):
    batch = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("producer_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("payloads"), F.min("o_orderkey").alias("first"))
    return queue.numbered_batch(batch, "payloads", "first").select("producer_id", "payload", "producer_seq")


@query("E20", """SELECT "group", cursor, (SELECT count(*) FROM q WHERE q.seq >= cur.cursor) AS lag, CAST((SELECT sum(length(payload)) FROM q WHERE q.seq >= cur.cursor) AS BIGINT) AS lag_bytes FROM cur""")
def queue_lag(spark, d):
    cursors = queue.ack_cursors(state(spark, d)).select("group", "cursor")
    return queue.lag(messages(spark, d), cursors, F.length("payload").cast("long"))


@query("J26 K6", """SELECT "group", seq, CASE WHEN NOT acked THEN redelivery + 1 ELSE redelivery END AS redelivery, CASE WHEN acked THEN NULL WHEN redelivery + 1 > 3 THEN 'dead_letter' ELSE 'backoff' END AS outcome,
CASE WHEN NOT acked AND redelivery + 1 <= 3 THEN 1000000 + (redelivery + 1) * 100 END AS retry_ms FROM st""")
def queue_nack(spark, d):
    return queue.after_failure(state(spark, d), ~F.col("acked"), 1_000_000, 3, F.col("redelivery") * 100).select("group", "seq", "redelivery", "outcome", F.col("retry_ms").cast("long").alias("retry_ms"))


@query("J29", """SELECT st.seq AS source_seq, "group", redelivery + 1 AS final_count, payload FROM st JOIN q USING (seq) WHERE NOT acked AND redelivery + 1 > 3""")
def queue_dead_letters(spark, d):
    after = queue.after_failure(state(spark, d), ~F.col("acked"), 1_000_000, 3)
    return queue.dead_letters(after, messages(spark, d))


@query("J30", """SELECT payload FROM st JOIN q USING (seq) WHERE NOT acked AND redelivery + 1 > 3""")
def queue_replay(spark, d):
    return queue.replay(queue_dead_letters(spark, d))


@query("J27", """SELECT "group", seq, 'me' AS consumer, epoch + 1 AS epoch FROM st WHERE NOT acked AND 100000 - deliver_ms >= 5000""")
def queue_claim(spark, d):
    return queue.claim(state(spark, d), "me", 100_000, 5000).select("group", "seq", "consumer", "epoch")


@query("J28", """SELECT "group", seq, 100000 - deliver_ms AS idle_ms FROM st WHERE NOT acked""")
def queue_pending(spark, d):
    return queue.pending(state(spark, d), 100_000).select("group", "seq", "idle_ms")


@query("J31", "SELECT seq, due_ts FROM q WHERE due_ts IS NULL OR due_ts NOT BETWEEN 5000 AND 50000")
def queue_cancel(spark, d):
    return queue.cancel(messages(spark, d), start=5000, end=50_000)[0].select("seq", "due_ts")


_ADMIT = """WITH g AS (SELECT "group", cursor, (SELECT coalesce(sum(length(payload)), 0) FROM q WHERE q.seq >= cur.cursor) AS held FROM cur),
i AS (SELECT o_orderkey AS seq, coalesce(sum(length(o_orderpriority)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM orders)"""


def _arriving(spark, d) -> DataFrame:
    return _read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))


def groups(spark, d) -> DataFrame:
    c = queue.ack_cursors(state(spark, d)).select("group", "cursor")
    return c.select("group", "cursor", F.lit(1).cast("long").alias("epoch"), F.lit(False).alias("fenced"))


_ROOM = "(SELECT CAST(max(held) + 5000 AS BIGINT) FROM g)"


def _room(spark, d) -> int:
    """A limit that 5,000 bytes more than the backlog reach."""
    s = queue.backlog_bytes(messages(spark, d), groups(spark, d), F.length("payload"))
    return s.first()["backlog"] + 5000


@query("J32 B16", f"{_ADMIT} SELECT seq, CASE WHEN (SELECT max(held) FROM g) + bef > {_ROOM} THEN 'rejected' ELSE 'admitted' END AS outcome FROM i")
def queue_backlog_reject(spark, d):
    return queue.admit(_arriving(spark, d), messages(spark, d), groups(spark, d), F.length("payload"), _room(spark, d))[0].select("seq", "outcome")


@query("J32", f"{_ADMIT} SELECT seq, CASE WHEN (SELECT max(held) FROM g) + bef <= {_ROOM} THEN 'admitted' WHEN seq % 2 = 0 THEN 'rejected' ELSE 'waiting' END AS outcome FROM i")
def queue_backlog_block(spark, d):
    return queue.admit(_arriving(spark, d), messages(spark, d), groups(spark, d), F.length("payload"), _room(spark, d), "block", waited=F.col("seq") % 2 == 0)[0].select("seq", "outcome")


@query("J32 J33", f"""{_ADMIT} SELECT "group", cursor, held + (SELECT max(bef) FROM i) > {_ROOM} - 4990 AS fenced FROM g""")
def queue_backlog_evict(spark, d):
    return queue.admit(_arriving(spark, d), messages(spark, d), groups(spark, d), F.length("payload"), _room(spark, d) - 4990, "evict")[1].select("group", "cursor", "fenced")


@query("J33", 'SELECT arg_min("group", (cursor, "group")) AS "group", min(cursor) AS cursor FROM cur')
def queue_slowest(spark, d):
    return queue.slowest(queue.ack_cursors(state(spark, d)))


@query("J34", "SELECT least(5000, 4000, min(cursor)) AS upto FROM cur")
def queue_truncation(spark, d):
    return queue.truncation(queue.ack_cursors(state(spark, d)), 5000, 4000).select(F.col("upto").cast("long").alias("upto"))


@query("J35", "SELECT max(seq) + 1 AS cursor FROM q")
def queue_start_latest(spark, d):
    return queue.start_at(messages(spark, d), "latest")


@query("J35 J33", """SELECT "group", CASE WHEN "group" = 'view' THEN (SELECT max(seq) + 1 FROM q) ELSE cursor END AS cursor, CASE WHEN "group" = 'view' THEN 2 ELSE 1 END AS epoch, false AS fenced FROM cur""")
def queue_group_reset(spark, d):
    g = groups(spark, d).withColumn("fenced", F.col("group") == "view")
    return queue.reset_group(g, state(spark, d), "view", messages(spark, d), "latest")[0]


@query("J35", """SELECT "group", cursor FROM cur WHERE "group" != 'view' UNION ALL SELECT 'fresh', min(seq) FROM q""")
def queue_group_create_delete(spark, d):
    q = messages(spark, d)
    return queue.delete_group(queue.create_group(groups(spark, d), "fresh", q), state(spark, d), "view")[0].select("group", "cursor")


@query("E20 J33", """SELECT "group", cursor, (SELECT count(*) FROM st WHERE st."group" = cur."group" AND NOT acked) AS pending, "group" = 'view' AS fenced,
CASE WHEN "group" = 'view' THEN 0 ELSE (SELECT count(*) FROM q WHERE q.seq >= cur.cursor) END AS lag, CASE WHEN "group" = 'view' THEN 0 ELSE CAST((SELECT sum(length(payload)) FROM q WHERE q.seq >= cur.cursor) AS BIGINT) END AS lag_bytes FROM cur""")
def queue_group_stats(spark, d):
    g = groups(spark, d).withColumn("fenced", F.col("group") == "view")
    return queue.group_stats(messages(spark, d), state(spark, d), g, F.length("payload").cast("long"))


@query("E20", """SELECT (SELECT min(seq) FROM q) AS begin, (SELECT max(seq) + 1 FROM q) AS tail, 4000 AS flushed,
CAST((SELECT sum(length(payload)) FROM q WHERE seq >= (SELECT min(cursor) FROM cur WHERE "group" != 'view')) AS BIGINT) AS backlog""")
def queue_stats(spark, d):
    g = groups(spark, d).withColumn("fenced", F.col("group") == "view")
    return queue.queue_stats(messages(spark, d), g, F.length("payload"), 4000)


_WAITING = """SELECT *, deliver_ms + 2000 AS next_ms, event_wait AS waiting FROM (SELECT st.*, seq % 7 = 0 AS event_wait FROM st WHERE "group" = (SELECT min(event_type) FROM events))"""
_EXPIRED = f"""WITH s0 AS ({_WAITING}), x AS (SELECT *, NOT acked AND next_ms <= 50000 AS due FROM s0),
y AS (SELECT *, redelivery + CASE WHEN due AND NOT waiting THEN 1 ELSE 0 END AS n FROM x),
o AS (SELECT *, CASE WHEN NOT due THEN NULL WHEN waiting THEN 'redeliver' WHEN n > 3 THEN 'dead_letter' WHEN n % 2 = 0 THEN 'backoff' ELSE 'redeliver' END AS outcome FROM y)"""


def waiting_state(spark, d) -> DataFrame:
    """One group's state with deliveries that run out and some that wait after a failure."""
    first = _read(spark, d, "events").agg(F.min("event_type").alias("_first"))  # one row
    s = state(spark, d).join(F.broadcast(first), F.col("group") == F.col("_first")).drop("_first")
    return s.withColumns({"next_ms": F.col("deliver_ms") + 2000, "waiting": F.col("seq") % 7 == 0})


def _backoff():
    return F.when(F.col("redelivery") % 2 == 0, F.col("redelivery") * 100).otherwise(0)


@query("J21 K6", f"{_EXPIRED} SELECT seq, n AS redelivery, outcome, CASE WHEN outcome = 'backoff' THEN 50000 + n * 100 ELSE next_ms END AS next_ms, coalesce(outcome = 'backoff', false) OR (waiting AND NOT due) AS waiting FROM o")
def queue_expire(spark, d):
    return queue.expire_overdue(waiting_state(spark, d), 50_000, 3, _backoff()).select("seq", "redelivery", "outcome", "next_ms", "waiting")


@query("J20 J21 G10", f"""{_EXPIRED}, k AS (SELECT seq FROM o WHERE outcome IS DISTINCT FROM 'redeliver'),
f AS (SELECT q.seq, due_ts, CASE WHEN due_ts IS NULL THEN 0 WHEN due_ts <= 50000 THEN 1 END AS segment FROM q WHERE seq >= 15 AND seq NOT IN (SELECT seq FROM k))
SELECT f.seq, segment, row_number() OVER (ORDER BY segment, coalesce(due_ts, f.seq), f.seq) AS place, coalesce(n, 0) AS redelivery FROM f LEFT JOIN (SELECT seq, n FROM o WHERE outcome = 'redeliver') r ON r.seq = f.seq
WHERE segment IS NOT NULL ORDER BY place LIMIT 700""")
def queue_dequeue(spark, d):
    out, _ = queue.dequeue(messages(spark, d), waiting_state(spark, d), 50_000, 50_000, 700, "me", 4, 30_000, 3, _backoff(), floor=15)
    return out.select("seq", "segment", "place", "redelivery")


@query("B16 J18", """WITH n0 AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 4 != 0 THEN o_custkey END AS pid, CASE WHEN o_orderkey % 4 != 0 THEN o_orderkey % 60 END AS ps FROM orders),
h0 AS (SELECT producer_id, producer_seq, min(seq) AS have FROM q GROUP BY ALL),
f0 AS (SELECT n0.*, have, CASE WHEN pid IS NULL THEN pos ELSE min(pos) OVER (PARTITION BY pid, ps) END AS first FROM n0 LEFT JOIN h0 ON h0.producer_id = pid AND h0.producer_seq = ps),
a0 AS (SELECT pos, (SELECT max(seq) FROM q) + row_number() OVER (ORDER BY pos) AS address FROM f0 WHERE have IS NULL AND first = pos)
SELECT f0.pos, coalesce(have, address) AS seq, have IS NULL AND first = f0.pos AS "new" FROM f0 LEFT JOIN a0 ON a0.pos = f0.first""")
def queue_enqueue(spark, d):
    k = F.col("o_orderkey")
    incoming = _read(spark, d, "orders").select(k.alias("pos"), F.col("o_orderpriority").alias("payload"), F.lit(None).cast("long").alias("due_ts"), F.when(k % 4 != 0, F.col("o_custkey")).alias("producer_id"), F.when(k % 4 != 0, k % 60).alias("producer_seq"))
    return queue.enqueue(messages(spark, d), incoming, 0).select("pos", "seq", "new")


@query("J23 J24", """SELECT "group", coalesce(min(seq) FILTER (NOT a), max(seq) + 1) AS cursor FROM (SELECT st.*, (acked OR seq % 4 = 0 OR seq % 9 = 0) AS a FROM st) GROUP BY 1""")
def queue_ack_buffered(spark, d):
    s = state(spark, d)
    buffered = s.where("seq % 9 = 0").select("group", "seq", F.lit(0).cast("long").alias("epoch")).unionByName(s.where("seq % 4 = 0").select("group", "seq", F.lit(0).cast("long").alias("epoch")))
    return queue.ack_cursors(queue.acknowledge(s, buffered, fenced=False, max_in_flight=1 << 40)).select("group", "cursor")


@query("J41", "SELECT seq, CASE WHEN s2 IS NULL THEN 'stale' ELSE 'missing' END AS action FROM (SELECT seq AS s1 FROM q WHERE seq % 2 = 0) a0 FULL JOIN (SELECT seq AS s2 FROM q WHERE due_ts IS NOT NULL AND seq BETWEEN 100 AND 8999) b0 ON s1 = s2, LATERAL (SELECT coalesce(s1, s2) AS seq) WHERE s1 IS NULL OR s2 IS NULL")
def queue_reconcile(spark, d):
    q = messages(spark, d)
    return queue.reconcile(q.where("seq % 2 = 0"), q, 100, 9000)


@query("G9", "SELECT event_type AS priority, event_id AS seq FROM events ORDER BY 1, 2 LIMIT 200")
def queue_by_priority(spark, d):
    return queue.by_priority(_read(spark, d, "events").select(F.col("event_type").alias("priority"), F.col("event_id").alias("seq")), 200)


# -- write-ahead log, blobs, files


@query("B18 B19", "SELECT CASE WHEN entry % 2 = 0 THEN a ELSE (SELECT count(*) FROM orders WHERE o_orderkey % 2 = 0) + b END AS idx, entry FROM (SELECT o_orderkey AS entry, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS b FROM orders)")
def wal_append(spark, d):
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("entry"))
    first = wal.append(spark.createDataFrame([], "entry long, idx long"), o.where("entry % 2 = 0"), ["entry"])
    return first.unionByName(wal.append(first, o.where("entry % 2 = 1"), ["entry"])).select("idx", "entry")


@query("A10 A11", "SELECT idx, entry FROM w WHERE idx >= 100 AND NOT is_meta")
def wal_read_from(spark, d):
    return wal.read_from(entries(spark, d), 100).select("idx", "entry")


@query("A12", "SELECT idx, entry FROM w WHERE idx >= 100 AND NOT is_meta ORDER BY idx LIMIT 250")
def wal_read_batch(spark, d):
    return wal.read_from(entries(spark, d), 100, limit=250).select("idx", "entry")


@query("B21", "SELECT idx, entry FROM w WHERE idx <= 900")
def wal_truncate_suffix(spark, d):
    return wal.truncate_suffix(entries(spark, d), 900).select("idx", "entry")


@query("B22", "SELECT idx, entry FROM w WHERE idx >= 900")
def wal_truncate_prefix(spark, d):
    return wal.truncate_prefix(entries(spark, d), 900).select("idx", "entry")


@query("B23 B24 A13", "SELECT idx, entry FROM w WHERE idx <= 500")
def wal_snapshot(spark, d):
    import uuid

    from tidelog.session import shared_folder

    w, path = entries(spark, d), f"{shared_folder(spark)}/wal-{uuid.uuid4().hex}"
    wal.snapshot(w, 500, path)
    wal.copy_snapshot(spark, path, f"{path}-copy", w.schema)
    return wal.read_snapshot(spark, f"{path}-copy", w.schema).select("idx", "entry")


@query("B36", "SELECT coalesce(max(idx), 0) >= 1000 AS persisted FROM w")
def wal_persisted(spark, d):
    return wal.persisted(entries(spark, d), 1000)


@query("B25 L13", "SELECT o_orderpriority AS name, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS payload FROM orders GROUP BY 1")
def meta_newest(spark, d):
    return wal.newest_version(_read(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("payload")))


@query("A24", "SELECT object_id, length, created, state FROM b WHERE object_id >= 100 AND object_id < 700 AND state = 0")
def blob_list(spark, d):
    return wal.blob_list(blobs(spark, d), 100, 700)


@query("A25", "SELECT object_id, text FROM b WHERE object_id = 42 AND state = 0")
def blob_get(spark, d):
    return wal.blob_get(blobs(spark, d), 42).select("object_id", F.decode("content", "UTF-8").alias("text"))


@query("A26", "SELECT object_id, length, created, state FROM b WHERE object_id = 42")
def blob_stat(spark, d):
    return wal.blob_stat(blobs(spark, d), 42)


@query("A23", "SELECT object_id, hex(encode(text)[11:30]) AS part FROM b WHERE object_id = 42 AND state = 0")
def blob_range(spark, d):
    return wal.blob_range(blobs(spark, d), 42, 10, 20).select("object_id", F.hex("content").alias("part"))


@query("A27 B27", "SELECT object_id, md5(text) AS digest FROM b")
def blob_chunks(spark, d):
    return wal.assemble(wal.chunks(blobs(spark, d), 1024)).select("object_id", F.md5("content").alias("digest"))


@query("E21", "SELECT count(*) FILTER (state = 0) AS active, count(*) FILTER (state != 0) AS tombstones, CAST(sum(length) AS BIGINT) AS used_bytes, CAST(sum(length) FILTER (state != 0) AS BIGINT) AS reclaimable_bytes FROM b")
def blob_stats(spark, d):
    return wal.blob_stats(blobs(spark, d))


@query("B28", "SELECT object_id, CASE WHEN object_id % 2 = 0 THEN 1 ELSE state END AS state FROM b")
def blob_delete(spark, d):
    x = blobs(spark, d)
    return wal.blob_delete(x, x.where("object_id % 2 = 0")).select("object_id", "state")


@query("B37", "SELECT object_id, length FROM b WHERE state = 0")
def blob_reclaim(spark, d):
    return wal.blob_reclaim(blobs(spark, d)).select("object_id", "length")


@query("E22", "SELECT l_suppkey AS segment, round(1 - sum(CASE WHEN l_returnflag != 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS hole_ratio FROM lineitem GROUP BY 1")
def hole_ratio(spark, d):
    x = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("segment"), F.col("l_quantity").alias("total_bytes"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0).alias("live_bytes"))
    return _rounded(wal.hole_ratio(x), "hole_ratio")


@query("A20", "SELECT page_id, url FROM pages WHERE regexp_extract(url, '[^/]*$') LIKE '%a_%'")
def glob_filter(spark, d):
    return _read(spark, d, "pages").where(frames.glob(frames.last_component(F.col("url")), "*a?*")).select("page_id", "url")


@query("A21", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http')")
def list_prefix(spark, d):
    return _read(spark, d, "pages").where(F.col("url").startswith("http")).select("page_id", "url")


@query("A22", """SELECT DISTINCT CASE WHEN position('/' IN r) > 0 THEN 'https://' || string_split(r, '/')[1] || '/' ELSE url END AS name, position('/' IN r) > 0 AS is_prefix FROM
(SELECT url, substr(url, 9) AS r FROM pages WHERE starts_with(url, 'https://'))""")
def list_common_prefixes(spark, d):
    return frames.common_prefixes(_read(spark, d, "pages"), "url", "https://", "/")


# -- ordered lookups


@query("C28 C29 C30", "SELECT o_orderkey AS key, o_custkey AS seq FROM orders WHERE o_orderkey >= 777 ORDER BY 1 LIMIT 100")
def index_seek(spark, d):
    return index.seek(_read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("seq")), 777, 100)


@query("DJ2 DJ3", "WITH k AS (SELECT DISTINCT o_orderkey * 3 AS key FROM orders), p AS (SELECT DISTINCT l_partkey AS probe FROM lineitem) SELECT probe, key, key + 1 AS seq FROM p ASOF LEFT JOIN k ON probe >= key")
def index_floor_many(spark, d):
    k = _read(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("key"), (F.col("o_orderkey") * 3 + 1).alias("seq"))
    return index.floor_many(k, _read(spark, d, "lineitem").select(F.col("l_partkey").alias("probe")).distinct())


@query("DJ4 DJ5", "WITH k AS (SELECT DISTINCT o_orderkey * 3 AS key FROM orders), p AS (SELECT DISTINCT l_partkey AS probe FROM lineitem) SELECT probe, key, key + 1 AS seq FROM p ASOF LEFT JOIN k ON probe > key")
def index_predecessor_many(spark, d):
    k = _read(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("key"), (F.col("o_orderkey") * 3 + 1).alias("seq"))
    return index.floor_many(k, _read(spark, d, "lineitem").select(F.col("l_partkey").alias("probe")).distinct(), strict=True)


@query("DJ2", "SELECT max(o_orderkey) AS key FROM orders WHERE o_orderkey <= 1000")
def index_floor_one(spark, d):
    return index.floor_one(_read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("seq")), 1000).select("key")


@query("G2 G3", "SELECT min(o_orderkey) AS min_key, max(o_orderkey) AS max_key FROM orders")
def index_ends(spark, d):
    return index.ends(_read(spark, d, "orders").select(F.col("o_orderkey").alias("key")))


@query("G7", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def index_top(spark, d):
    return index.top(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("L16", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey >= 1234")
def index_truncate_prefix(spark, d):
    return index.truncate_prefix(_read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 1234)[0]


@query("L17", "SELECT o_orderkey AS key FROM orders WHERE NOT (o_orderkey >= 1234 AND o_orderkey < 5000)")
def index_truncate_range(spark, d):
    return index.truncate_range(_read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 1234, 5000)[0]


# -- replicas, clocks, ids


@query("E26", """SELECT key, seq, CAST(sum(n) OVER x - n + 1 AS BIGINT) AS first_id, CAST(sum(n) OVER x AS BIGINT) AS last_id FROM
(SELECT l_partkey AS key, l_orderkey AS seq, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL) WINDOW x AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def idblock_alloc(spark, d):
    r = _read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("seq")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return replica.allocate_ids(r, F.col("n")).select("key", "seq", "first_id", "last_id")


_BEATS = "SELECT user_id AS node, epoch_us(ts) // 1000000 AS beat FROM events"


@query("E25", f"""WITH b0 AS ({_BEATS}), g AS (SELECT *, beat - lag(beat) OVER (PARTITION BY node ORDER BY beat) AS gap, row_number() OVER (PARTITION BY node ORDER BY beat DESC) AS back FROM b0)
SELECT node, max(beat) AS last, count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS sd FROM g WHERE back <= 12 GROUP BY node""")
def phi_gap_statistics(spark, d):
    beats = _read(spark, d, "events").select(F.col("user_id").alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return _rounded(replica.gap_statistics(beats), "mean", "sd")


def _phi_sql() -> str:
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({poly} * t + {c})"
    return f"""WITH b0 AS ({_BEATS}), g AS (SELECT *, beat - lag(beat) OVER (PARTITION BY node ORDER BY beat) AS gap, row_number() OVER (PARTITION BY node ORDER BY beat DESC) AS back FROM b0),
a AS (SELECT node, max(beat) AS last, count(gap) AS n, avg(gap) AS mean, stddev_samp(gap) AS sd FROM g WHERE back <= 12 GROUP BY node),
x AS (SELECT node, n, (1706745600 - last - mean) / greatest(CASE WHEN coalesce(sd, 0) = 0 THEN 1.0 ELSE sd END, 0.3 * mean) AS x FROM a),
y AS (SELECT *, abs(x) / sqrt(CAST(2 AS DOUBLE)) AS zz, CAST(1 AS DOUBLE) / (1 + 0.5 * abs(x) / sqrt(CAST(2 AS DOUBLE))) AS t FROM x),
v AS (SELECT *, t * exp(-zz * zz + {poly}) / 2 AS half FROM y)
SELECT node, round(CASE WHEN n < 3 THEN 0 ELSE -log10(greatest(CASE WHEN x >= 0 THEN half ELSE 1 - half END, 1e-300)) END, 6) AS phi FROM v"""


@query("E25", _phi_sql())
def phi_accrual(spark, d):
    beats = _read(spark, d, "events").select(F.col("user_id").alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return _rounded(replica.phi_accrual(beats, 1_706_745_600), "phi")


_CLOCK = "SELECT user_id AS node, event_id AS seq, event_id * 7919 % 10007 AS now FROM events"


@query("F5", f"""WITH c AS ({_CLOCK}), p AS (SELECT *, max(now) OVER (PARTITION BY node ORDER BY seq ROWS UNBOUNDED PRECEDING) AS physical FROM c)
SELECT node, seq, physical, row_number() OVER (PARTITION BY node, physical ORDER BY seq) - CASE WHEN physical = 0 THEN 0 ELSE 1 END AS logical FROM p""")
def hlc_tick(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 10007).alias("now"))
    return replica.hybrid_clock(e).select("node", "seq", "physical", "logical")


@query("F6", """WITH e0 AS (SELECT user_id AS node, event_id AS seq, event_id * 7919 % 10007 AS now, CASE WHEN event_id % 3 = 0 THEN event_id * 31 % 12007 END AS rp, CASE WHEN event_id % 3 = 0 THEN event_id % 5 END AS rl,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT node, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS physical, CAST(0 AS BIGINT) AS logical FROM (SELECT DISTINCT user_id AS node FROM events)
UNION ALL SELECT e0.node, e0.n, e0.seq, greatest(r.physical, now, coalesce(rp, 0)),
CASE WHEN greatest(r.physical, now, coalesce(rp, 0)) > r.physical THEN CASE WHEN rp = greatest(r.physical, now, rp) THEN rl + 1 ELSE 0 END
WHEN rp IS NULL THEN r.logical + 1 ELSE greatest(r.logical, rl) + 1 END FROM r JOIN e0 ON e0.node = r.node AND e0.n = r.n + 1)
SELECT node, seq, physical, logical FROM r WHERE n > 0 /* recursive */""")
def hlc_receive(spark, d):
    e = _read(spark, d, "events").select(
        F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (F.col("event_id") * 7919 % 10007).alias("now"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 31 % 12007).alias("remote_physical"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5).alias("remote_logical"),
    )
    return replica.hybrid_receive(e).select("node", "seq", "physical", "logical")


def _blocks(spark, d, changed: bool) -> DataFrame:
    x = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    if changed:
        x = x.where("l_orderkey % 9973 != 5").withColumn("l_quantity", F.when(F.col("l_orderkey") % 4999 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return x


@query("DJ10", "SELECT DISTINCT l_orderkey // 64 AS block FROM lineitem WHERE l_orderkey % 9973 = 5 OR l_orderkey % 4999 = 7")
def merkle_diff(spark, d):
    a, b = (replica.block_checksums(_blocks(spark, d, c), "l_orderkey", 64, ["l_orderkey", "l_linenumber", "l_quantity"]) for c in (False, True))
    return replica.block_diff(a, b)


@query("E23", "SELECT DISTINCT l_orderkey // 4096 AS block FROM lineitem WHERE l_orderkey % 9973 = 5 OR l_orderkey % 4999 = 7")
def merkle_subtree_diff(spark, d):
    a, b = (replica.merkle_level(replica.block_checksums(_blocks(spark, d, c), "l_orderkey", 64, ["l_orderkey", "l_linenumber", "l_quantity"])) for c in (False, True))
    return replica.block_diff(a, b)


@query("J42", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey // 64 IN (SELECT l_orderkey // 64 FROM lineitem WHERE l_orderkey % 9973 = 5 OR l_orderkey % 4999 = 7)")
def anti_entropy_pull(spark, d):
    return replica.pull_differences(_blocks(spark, d, False), "l_orderkey", 64, merkle_diff(spark, d))


@query("J17 K11", "SELECT o_orderkey AS idx, o_custkey AS key FROM orders WHERE o_orderkey > 3000 AND o_orderstatus != 'F'")
def feed_poll(spark, d):
    feed = _read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "config").otherwise("command").alias("kind"))
    return replica.poll(feed, 3000)[0].select("idx", "key")


@query("J36 K10", "SELECT key, value, idx FROM (SELECT o_custkey AS key, o_totalprice AS value, o_orderkey AS idx, o_orderstatus AS k FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) WHERE k != 'F'")
def commands_apply(spark, d):
    c = _read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("kind"), F.col("o_totalprice").alias("value"))
    return replica.apply_commands(c)


# -- scalar functions


@query("I3", "SELECT event_id, CAST(floor((event_id - 5000) / 7.0) AS BIGINT) AS q FROM events")
def floor_division(spark, d):
    return _read(spark, d, "events").select("event_id", tb.floor_div(F.col("event_id") - 5000, 7).alias("q"))


@query("I1 I2", "SELECT p_partkey, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS place FROM part")
def score_codec(spark, d):
    p = _read(spark, d, "part").select("p_partkey", numeric.encode_score("p_retailprice").alias("code"))
    return log.dense_index(p, ["code", "p_partkey"], name="place").select("p_partkey", numeric.decode_score("code").alias("score"), "place")


def _le(x: str, n: int) -> str:
    """The n low bytes of a whole number as hex digits, least first, in DuckDB."""
    return "concat(" + ", ".join(f"substr(printf('%016X', CAST({x} AS BIGINT)), {15 - 2 * i}, 2)" for i in range(n)) + ")"


@query("I4 I5", "SELECT o_orderkey, o_totalprice AS price, o_custkey - 500 AS number FROM orders")
def numbers_decoded(spark, d):
    # the code of a positive score is its bits with the sign's turned, most significant first
    h = F.hex(numeric.encode_score("o_totalprice"))
    bits = F.unhex(F.concat(*(F.substring(h, i, 2) for i in range(15, 1, -2)), F.lpad(F.hex(F.conv(F.substring(h, 1, 2), 16, 10).cast("long") - 128), 2, "0")))
    o = _read(spark, d, "orders").select("o_orderkey", F.concat(bits, F.lit(bytearray(b"rest"))).alias("p"), frames.little(F.col("o_custkey") - 500, 8).alias("n"))
    return o.select("o_orderkey", numeric.decode_double("p").alias("price"), numeric.decode_long("n").alias("number"))


@query("I22", "SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def size_literal(spark, d):
    unit = F.element_at(F.array(*(F.lit(u) for u in ("", "k", "MB", "GiB"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, d, "part").select("p_partkey", numeric.parse_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


def _pretty_sql(n: str) -> str:
    unit, v = "''", f"CAST({n} AS DOUBLE)"
    for u in "KMGT":
        unit = f"CASE WHEN length(CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR)) > 3 THEN '{u}' ELSE {unit} END"
        v = f"CASE WHEN length(CAST(CAST(floor({v}) AS BIGINT) AS VARCHAR)) > 3 THEN round_even({v} / 1024, 12) ELSE {v} END"
    return f"regexp_replace(CAST({v} AS VARCHAR), '\\.0$', '') || {unit} || 'B'"


@query("I23", f"SELECT doc_id, {_pretty_sql('n_chars * CAST(pow(1000, doc_id % 4) AS BIGINT)')} AS size FROM documents")
def size_text(spark, d):
    n = F.col("n_chars") * F.pow(F.lit(1000.0), F.col("doc_id") % 4).cast("long")
    return _read(spark, d, "documents").select("doc_id", numeric.pretty_size(n).alias("size"))


@query("I24", "SELECT o_orderkey, CAST(floor(log2(o_orderkey)) AS INTEGER) AS log2, bit_count(o_orderkey) = 1 AS power FROM orders WHERE o_orderkey > 0")
def bit_tricks(spark, d):
    k = F.col("o_orderkey")
    return _read(spark, d, "orders").where(k > 0).select(k, numeric.log2_floor(k).alias("log2"), numeric.is_power_of_two(k).alias("power"))


@query("I25", "SELECT o_orderkey, (o_orderkey >> 3) | CASE WHEN o_orderkey % 8 >= 4 THEN -9223372036854775808 ELSE 0 END | ((o_orderkey % 4) << 61) AS r FROM orders")
def rotate_right(spark, d):
    return _read(spark, d, "orders").select("o_orderkey", numeric.rotate_right(F.col("o_orderkey"), 3).alias("r"))


def _crc_sql(data: str, poly: str, mask: str, top: int, ones: bool, reflected: bool, kind: str) -> str:
    """A checksum byte by byte over a list of bytes, from the definition: no table."""
    one = f"CAST(1 AS {kind})"
    if reflected:
        bit = f"CASE WHEN c & {one} = {one} THEN xor(c >> 1, CAST({poly} AS {kind})) ELSE c >> 1 END"
        step = f"list_reduce([xor(s, b)] || [CAST(0 AS {kind}) FOR i IN range(8)], lambda c, k: {bit})"
    else:
        half = f"CAST({1 << (top - 1)} AS {kind})"
        bit = f"CASE WHEN c >= {half} THEN xor((c - {half}) * 2, CAST({poly} AS {kind})) ELSE c * 2 END"
        step = f"list_reduce([xor(s, b * CAST({1 << (top - 8)} AS {kind}))] || [CAST(0 AS {kind}) FOR i IN range(8)], lambda c, k: {bit})"
    start = f"CAST({mask if ones else 0} AS {kind})"
    out = f"list_reduce([{start}] || list_transform({data}, lambda x: CAST(x AS {kind})), lambda s, b: {step})"
    return f"xor({out}, CAST({mask} AS {kind}))" if ones else out


_BYTES = "list_transform(range(0, length(url)), lambda i: ascii(substr(url, i + 1, 1)))"


@query("I6 I7 I8", f"""SELECT page_id, CAST({_crc_sql('x', '3988292384', '4294967295', 32, True, True, 'UBIGINT')} AS BIGINT) AS crc32, CAST({_crc_sql('x', '2197175160', '4294967295', 32, True, True, 'UBIGINT')} AS BIGINT) AS crc32c,
printf('%016X', {_crc_sql('x', str(0x42F0E1EBA9EA3693), '0', 64, False, False, 'UBIGINT')}) AS crc64 FROM (SELECT page_id, {_BYTES} AS x FROM pages)""")
def checksums(spark, d):
    t = F.encode("url", "UTF-8")
    back = F.hex(hashes.crc64(t))
    swapped = F.lpad(back, 16, "0")
    return _read(spark, d, "pages").select("page_id", F.crc32(t).alias("crc32"), hashes.crc32c(t).alias("crc32c"), F.concat(*(F.substring(swapped, i, 2) for i in range(15, 0, -2))).alias("crc64"))


@query("I9 I10 I11")
def hashes_of_texts(spark, d):
    t = F.encode("text", "UTF-8")
    return _read(spark, d, "documents").select("doc_id", hashes.xxh64(t).alias("xxh64"), F.hex(hashes.xxh128(t)).alias("xxh128"), F.xxhash64("text").alias("key_hash"), F.crc32(t).alias("crc32"), hashes.crc32c(t).alias("crc32c"), hashes.crc64(t).alias("crc64"))


@query("I18", "SELECT doc_id, doc_id * 3 AS expiry, md5(text) AS digest FROM documents")
def frame_round_trip(spark, d):
    x = _read(spark, d, "documents").select("doc_id", numeric_frame().alias("u"))
    return x.select("doc_id", "u.expiry", F.md5("u.payload").alias("digest"))


def numeric_frame():
    return frames.unwrap_value(frames.wrap_value((F.col("doc_id") * 3), F.encode("text", "UTF-8")))


_HEX = "hex(encode(props))"


@query("I19", f"""SELECT event_id, '54545332' || CASE WHEN event_id % 4 = 0 THEN '00' ELSE '01' END || {_le("user_id", 4)} || {_le(f"epoch_us(ts) * 10 + {tb.UNIX_EPOCH}", 8)} || {_le("CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END", 8)} || {_HEX} AS bytes FROM events""")
def envelope_sample(spark, d):
    seq = F.when(F.col("event_id") % 4 != 0, F.col("event_id"))
    return _read(spark, d, "events").select("event_id", F.hex(frames.sample_envelope(F.col("user_id"), tb.ticks_of("ts"), seq, F.encode("props", "UTF-8"))).alias("bytes"))


@query("I19", f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS flags, epoch_us(ts) * 10 + {tb.UNIX_EPOCH} AS ts, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS seq, props FROM events""")
def envelope_sample_read(spark, d):
    seq = F.when(F.col("event_id") % 4 != 0, F.col("event_id"))
    wrapped = frames.sample_envelope(None, tb.ticks_of("ts"), seq, F.encode("props", "UTF-8"))
    return _read(spark, d, "events").select("event_id", frames.unwrap_sample(wrapped, dense=False).alias("u")).select("event_id", "u.flags", "u.ts", "u.seq", F.decode("u.payload", "UTF-8").alias("props"))


@query("I20", f"""SELECT event_id, '54514531' || CASE WHEN event_id % 3 = 0 THEN '03' ELSE '02' END || {_le("user_id", 8)} || {_le("event_id", 8)} || {_le("CASE WHEN event_id % 3 = 0 THEN event_id * 7 ELSE 0 END", 8)} || {_HEX} AS bytes FROM events""")
def envelope_message(spark, d):
    due = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 7)
    return _read(spark, d, "events").select("event_id", F.hex(frames.message_envelope(F.col("user_id"), F.col("event_id"), due, F.encode("props", "UTF-8"))).alias("bytes"))


@query("I20", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS flags, user_id AS producer_id, event_id AS producer_seq, CASE WHEN event_id % 3 = 0 THEN event_id * 7 ELSE 0 END AS due_ts, props FROM events""")
def envelope_message_read(spark, d):
    due = F.when(F.col("event_id") % 3 == 0, F.col("event_id") * 7)
    wrapped = frames.message_envelope(F.col("user_id"), F.col("event_id"), due, F.encode("props", "UTF-8"))
    return _read(spark, d, "events").select("event_id", frames.unwrap_message(wrapped).alias("u")).select("event_id", "u.flags", "u.producer_id", "u.producer_seq", "u.due_ts", F.decode("u.payload", "UTF-8").alias("props"))


@query("I21 J29", f"""SELECT event_id, '5143444C51303100' || {_le("event_id % 5", 4)} || {_le("1", 4)} || {_le("event_id * 64", 8)} || {_le("event_id % 7", 4)} || {_le("length(event_type)", 4)} || hex(encode(event_type)) || {_HEX} AS bytes FROM events""")
def envelope_dead_letter(spark, d):
    e = F.col("event_id")
    return _read(spark, d, "events").select("event_id", F.hex(frames.dead_letter_envelope(e % 5, F.lit(1), e * 64, F.col("event_type"), e % 7, F.encode("props", "UTF-8"))).alias("bytes"))


@query("I21 J30", "SELECT event_id, event_id % 5 AS segment, event_id * 64 AS \"offset\", event_id % 7 AS final_count, event_type AS \"group\", props FROM events")
def envelope_dead_letter_read(spark, d):
    e = F.col("event_id")
    wrapped = frames.dead_letter_envelope(e % 5, F.lit(1), e * 64, F.col("event_type"), e % 7, F.encode("props", "UTF-8"))
    return _read(spark, d, "events").select("event_id", frames.unwrap_dead_letter(wrapped).alias("u")).select("event_id", F.col("u.segment").cast("long").alias("segment"), "u.offset", F.col("u.final_count").cast("long").alias("final_count"), "u.group", F.decode("u.payload", "UTF-8").alias("props"))


@query("I12 I14 I15 I16", "SELECT o_orderkey, (o_orderkey // 1000) * 1000 + o_orderkey % 1000 + 17 AS position, o_orderkey + 17 - (SELECT min(o_orderkey) FROM orders) AS distance FROM orders")
def address_arithmetic(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", frames.address(tb.floor_div(F.col("o_orderkey"), 1000), F.col("o_orderkey") % 1000).alias("a"))
    # a size for each segment up to the last one that holds a record
    last = o.agg(F.max("a.segment").alias("m"))
    segments = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)))).alias("segment"), F.lit(1000).cast("long").alias("size"))
    at = o.join(frames.flat_addresses(segments), F.col("a.segment") == F.col("segment"))
    least = o.agg(F.min("a").alias("first")).select((F.col("first.segment") * 1000 + F.col("first.offset")).alias("first"))  # one row
    position = frames.advance(F.col("base") + F.col("a.offset"), 17)
    return at.crossJoin(F.broadcast(least)).select("o_orderkey", position.alias("position"), frames.distance(F.col("first"), position).alias("distance"))


@query("A16", "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN octet_length(encode(left(text, strpos(text, 'the') - 1))) END AS first, CASE WHEN strpos(text, 'the') > 0 THEN octet_length(encode(text)) - octet_length(encode(right(text, strpos(reverse(text), 'eht') + 2))) END AS last FROM documents")
def magic_locate(spark, d):
    data = F.encode("text", "UTF-8")
    a, b = (frames.locate_magic(data, b"the", last=x, page=1 << 30) for x in (False, True))
    return _read(spark, d, "documents").select("doc_id", a["offset"].alias("first"), b["offset"].alias("last"))


from tidelog.plans import actions  # noqa: E402, F401  (registers its queries)
