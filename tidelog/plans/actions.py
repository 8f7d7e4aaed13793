"""More of the catalog: writes, sources, streams, sessions, transactions and codecs as queries.

Streams run to their end over what is there (``availableNow``) and their output is read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog import codecs, schemas
from tidelog import timebase as tb
from tidelog.functions import frames
from tidelog.operators import collections as co
from tidelog.operators import index, kv, log, queue, replica, series, wal
from tidelog.operators import transactions as tx
from tidelog.plans.catalog import _SWAP, BASE, DAY, HOUR, NOW, _le, _read, _rounded, blobs, kv_log, live, messages, query, samples, state, zset
from tidelog.session import new_path, settled
from tidelog.sources import change_feed, files
from tidelog.streaming import feeds

# -- writes


@query("B6 B7 I17", "SELECT c_custkey AS key, c_acctbal AS value, CASE WHEN c_custkey % 3 = 0 THEN 500 + c_custkey ELSE 0 END AS expiry, c_custkey * 2 AS seq, false AS is_tombstone FROM customer")
def kv_put(spark, d):
    rows = _read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), (F.col("c_custkey") * 2).alias("seq"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("ttl"))
    return kv.put(rows, NOW, "ttl").select("key", "value", "expiry", "seq", "is_tombstone")


@query("K12 B7 K3", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS value FROM customer")
def kv_typed_store(spark, d):
    store = codecs.TypedStore(spark, new_path(spark, "typed"), T.LongType(), T.StringType())
    c = _read(spark, d, "customer")
    store.put(c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), (F.col("c_custkey") * 2).alias("seq")), NOW)
    store.put(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.upper("c_name").alias("value"), (F.col("c_custkey") * 2 + (1 << 40)).alias("seq")), NOW)
    return store.current().select("key", "value")


@query("B1 B2", f"SELECT series_id, ts, seq, value FROM s WHERE ts >= {BASE + 5 * DAY}")
def ts_append(spark, d):
    path = new_path(spark, "samples")
    s = samples(spark, d).where(F.col("ts") >= BASE + 5 * DAY)
    trimmed = s.select("series_id").distinct().withColumn("trimmed_until", F.lit(BASE + 5 * DAY))
    series.append(s.where("seq % 2 = 0"), path, trimmed=trimmed)
    series.append(s.where("seq % 2 = 1"), path, trimmed=trimmed, now=BASE + 40 * DAY, max_past=40 * DAY)
    return spark.read.schema(s.schema).parquet(path)


@query("B26 A25", "SELECT (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY page_id) AS object_id, octet_length(encode(html)) AS length, 77 AS created, md5(html) AS digest FROM pages")
def blob_put(spark, d):
    b = blobs(spark, d)
    new = _read(spark, d, "pages").select(F.lpad(F.col("page_id").cast("string"), 20, "0").alias("name"), F.encode("html", "UTF-8").alias("content"))
    out = wal.put_blob(b, new, 77)
    return out.where("created = 77").select("object_id", "length", "created", F.md5("content").alias("digest"))


@query("B31", "SELECT doc_id AS object_id, md5(left(text, 10) || 'PATCH' || substr(text, 16)) AS digest FROM documents WHERE length(text) > 20 AND lang = 'en' AND octet_length(encode(text)) = length(text)")
def blob_write_at(spark, d):
    docs = _read(spark, d, "documents").where("length(text) > 20 and lang = 'en' and octet_length(text) = length(text)")
    b = docs.select(F.col("doc_id").alias("object_id"), F.encode("text", "UTF-8").alias("content"))
    out = tx.write_at(b, docs.select(F.col("doc_id").alias("object_id"), F.lit(10).alias("offset"), F.lit(bytearray(b"PATCH")).alias("data")))
    return out.select("object_id", F.md5("content").alias("digest"))


@query("B30", "SELECT seq, key, CASE WHEN seq % 10 = 0 THEN round(value / 2, 6) ELSE value END AS value FROM kvlog")
def log_update_in_place(spark, d):
    lg = kv_log(spark, d)
    return tx.update_in_place(lg, lg.where("seq % 10 = 0").select("seq", F.round(F.col("value") / 2, 6).alias("value")), F.lit(64)).select("seq", "key", "value")


@query("B29", "SELECT l_orderkey AS batch, l_linenumber AS pos, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS seq FROM lineitem")
def log_write_window(spark, d):
    batches = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("pos"))
    return tx.write_window(kv_log(spark, d), batches).select("batch", "pos", "seq")


@query("B32 B33", "SELECT 'region' AS name, count(*) AS rows, true AS same FROM region UNION ALL SELECT 'nation', count(*), true FROM nation UNION ALL SELECT 'orders', count(*), true FROM orders")
def image_transfer(spark, d):
    return files.copy_tables(spark, d, new_path(spark, "image"), ["region", "nation", "orders"])


@query("B20 J37 K9", """WITH e0 AS (SELECT user_id AS log, event_id AS seq, length(props) AS b, event_id * 10 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT log, seq, n, b AS size, 1 AS k, t AS since, 0 AS rnd, b >= 200 AS due, t FROM e0 WHERE n = 1
UNION ALL SELECT e0.log, e0.seq, e0.n, CASE WHEN due THEN 0 ELSE size END + b, CASE WHEN due THEN 0 ELSE k END + 1, CASE WHEN due THEN r.t ELSE since END, rnd + CASE WHEN due THEN 1 ELSE 0 END,
CASE WHEN due THEN 0 ELSE size END + b >= 200 OR CASE WHEN due THEN 0 ELSE k END + 1 >= 12 OR e0.t - CASE WHEN due THEN r.t ELSE since END >= 4000, e0.t FROM r JOIN e0 ON e0.log = r.log AND e0.n = r.n + 1)
SELECT log, seq, due AS commits, rnd AS round FROM r /* recursive */""")
def wal_group_commits(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), F.length("props").alias("bytes"), (F.col("event_id") * 10).alias("at_ms"))
    return tx.group_commits(e, 200, 12, 4000).select("log", "seq", "commits", "round")


@query("B20", "SELECT idx, entry FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS idx, o_orderkey AS entry FROM orders)")
def wal_commit(spark, d):
    path = new_path(spark, "wal")
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("entry"))
    return wal.commit(wal.append(spark.createDataFrame([], "entry long, idx long"), o, ["entry"]), path).select("idx", "entry")


@query("B34", "SELECT count(*) AS live FROM s")
def ts_flush(spark, d):
    path = new_path(spark, "flush")
    series.append(samples(spark, d), path)
    return series.stats_all(spark.read.schema(schemas.SERIES).parquet(path)).select("live")


@query("B38", "SELECT domain, count(*) AS n FROM z GROUP BY domain")
def collection_flush(spark, d):
    return co.cardinality(wal.commit(zset(spark, d), new_path(spark, "flush")))


@query("B35", "SELECT true AS persisted, count(*) AS n FROM q")
def queue_flush(spark, d):
    q = wal.commit(messages(spark, d), new_path(spark, "flush"))
    return wal.persisted(q.withColumnRenamed("seq", "idx"), 10).crossJoin(q.agg(F.count("*").alias("n")))  # one row each


# -- the log


@query("DJ7", "SELECT seq, key FROM kvlog WHERE seq IN (SELECT seq FROM newest WHERE key < 100)")
def log_gather_by_size(spark, d):
    lg = kv_log(spark, d)
    few = lg.where("key < 100").groupBy("key").agg(F.max("seq").alias("seq"))
    return log.gather_by_size(few, lg)[0].select("seq", "key")


@query("G11 A4", "SELECT seq, key FROM kvlog WHERE seq IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3) ORDER BY seq")
def log_gather_sorted(spark, d):
    return log.gather_sorted(kv_log(spark, d), _read(spark, d, "lineitem").where("l_linenumber = 3").select(F.col("l_partkey").alias("seq"))).select("seq", "key")


@query("J38 F4 L18", "SELECT key, seq, is_tombstone FROM newest")
def kv_checkpoint(spark, d):
    """The newest records as a written checkpoint, brought up to date by what was logged after it."""
    lg = kv_log(spark, d)
    kept = settled(log.newest(lg.where("seq <= 3000"), ["key"]), "checkpoint")
    return log.refresh(kept, lg.where("seq > 3000"), ["key"]).select("key", "seq", "is_tombstone")


@query("G12", "SELECT DISTINCT domain FROM z")
def collection_domains(spark, d):
    return co.domains(zset(spark, d))


@query("E24", "SELECT true AS same_self, false AS same_other")
def merkle_root(spark, d):
    from tidelog.plans.catalog import _blocks

    roots = []
    for changed in (False, False, True):
        b = replica.block_checksums(_blocks(spark, d, changed), "l_orderkey", 64, ["l_orderkey", "l_linenumber", "l_quantity"])
        roots.append(replica.merkle_root(b, 4).agg(F.max("checksum").alias(f"c{len(roots)}")))
    return roots[0].crossJoin(roots[1]).crossJoin(roots[2]).select((F.col("c0") == F.col("c1")).alias("same_self"), (F.col("c0") == F.col("c2")).alias("same_other"))  # one row each




@query("L14 J11", "SELECT seq, key FROM newest WHERE NOT is_tombstone")
def log_compact(spark, d):
    return log.compact(kv_log(spark, d), ["key"], new_path(spark, "compact")).select("seq", "key")


@query("L14", "SELECT seq, key FROM kvlog WHERE seq < 1000 OR seq >= 20000 OR seq IN (SELECT seq FROM newest)")
def log_compact_range(spark, d):
    return log.compact(kv_log(spark, d), ["key"], new_path(spark, "compact"), 1000, 20_000).select("seq", "key")


@query("L15", "SELECT seq, key FROM kvlog WHERE seq >= 100 AND seq < 40000 AND NOT (seq >= 2000 AND seq < 3000)")
def log_reclaim(spark, d):
    return log.reclaim(kv_log(spark, d), new_path(spark, "reclaim"), 100, 40_000, (2000, 3000)).select("seq", "key")


@query("K7 K8 A7", "SELECT key, count(*) AS n FROM kvlog WHERE seq >= 500 AND is_tombstone GROUP BY key")
def log_replay_handler(spark, d):
    schema = T.StructType([T.StructField("key", T.LongType())])
    return log.fold_records(kv_log(spark, d), 500, lambda records: ((r["key"],) for r in records if r["is_tombstone"]), schema).groupBy("key").agg(F.count("*").alias("n"))


@query("K5", "SELECT seq, key FROM kvlog WHERE seq IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)")
def key_resolve(spark, d):
    return codecs.resolve_keys(kv_log(spark, d), _read(spark, d, "lineitem").where("l_linenumber = 2").select(F.col("l_partkey").alias("seq")))


@query("A9 A3", "SELECT seq, key FROM kvlog WHERE seq >= 1000 AND seq < 20000")
def log_cursor(spark, d):
    lg = settled(kv_log(spark, d).withColumn("crc", F.crc32(F.col("value").cast("string").cast("binary"))), "cursor")  # a fixed listing: what is appended later is not seen
    good = F.crc32(F.col("value").cast("string").cast("binary")) == F.col("crc")
    checked = F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("checksum differs at "), F.col("seq").cast("string"))).cast("boolean"))
    return log.scan(lg, 1000, 20_000).where(checked).orderBy("seq").select("seq", "key")


# -- key-value sessions


@query("L2", """WITH a AS (SELECT key, seq, value, CASE WHEN n = 1 THEN NULL WHEN n % 3 = 0 THEN -1 ELSE p END AS expected, n FROM
(SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n, lag(value) OVER (PARTITION BY key ORDER BY seq) AS p FROM kvlog)),
r AS (SELECT key, seq, n, true AS success, value AS now FROM a WHERE n = 1
UNION ALL SELECT a.key, a.seq, a.n, a.expected = r.now, CASE WHEN a.expected = r.now THEN a.value ELSE r.now END FROM r JOIN a ON a.key = r.key AND a.n = r.n + 1)
SELECT key, seq, success FROM r /* recursive */""")
def kv_cas_value(spark, d):
    by = W.partitionBy("key").orderBy("seq")
    n = F.row_number().over(by)
    a = kv_log(spark, d).select("key", "seq", "value", n.alias("n"), F.lag("value").over(by).alias("p"))
    expected = F.when(F.col("n") == 1, None).when(F.col("n") % 3 == 0, F.lit(-1.0)).otherwise(F.col("p"))
    return kv.compare_and_swap(a.select("key", "seq", expected.alias("expected"), "value"), by="value").select("key", "seq", "success")


@query("C12", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def kv_prefix_bytes(spark, d):
    return _read(spark, d, "part").where(kv.has_prefix(F.encode("p_brand", "UTF-8"), b"Brand#1 and more", 7)).select("p_partkey")


@query("L3 B9", "SELECT key, value FROM newest WHERE NOT is_tombstone AND key NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def kv_batch_commit(spark, d):
    lg = kv_log(spark, d)
    c = _read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(0).cast("long").alias("expiry"), F.lit(False).alias("is_tombstone"), F.col("c_custkey").alias("pos"))
    earlier = c.withColumn("value", F.lit(-1.0)).withColumn("pos", F.col("pos") - (1 << 40))
    return log.current(tx.finish_batch(lg, earlier.unionByName(c)), ["key"]).select("key", "value")


@query("L3", "SELECT key, value FROM newest WHERE NOT is_tombstone")
def kv_batch_abort(spark, d):
    lg = kv_log(spark, d)
    return log.current(tx.finish_batch(lg, lg.withColumn("pos", F.col("seq")), commit=False), ["key"]).select("key", "value")


_OWN = "SELECT key, value * 10 AS value, seq + 1000000 AS seq, is_tombstone FROM kvlog WHERE seq % 9 = 0"
_SESSION = f"WITH own0 AS ({_OWN}), both0 AS (SELECT key, value, seq, is_tombstone, 0 AS r FROM kvlog {{}} UNION ALL SELECT *, 1 FROM own0) SELECT key, round(value, 6) AS value FROM (SELECT * FROM both0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC, seq DESC) = 1) WHERE NOT is_tombstone"


def _session(spark, d, level: str, begin: int | None = None) -> DataFrame:
    lg = kv_log(spark, d)
    own = lg.where("seq % 9 = 0").withColumns({"value": F.col("value") * 10, "seq": F.col("seq") + 1_000_000})
    return _rounded(tx.session_read(lg, own, level, begin).select("key", "value"), "value")


@query("L5 L4", _SESSION.format(""))
def session_read_my_writes(spark, d):
    return _session(spark, d, "read_my_writes")


@query("L5", _SESSION.format("WHERE seq <= 3000"))
def session_serializable(spark, d):
    return _session(spark, d, "serializable", 3000)


@query("L5", "SELECT key, round(value, 6) AS value FROM newest WHERE NOT is_tombstone")
def session_plain(spark, d):
    return _session(spark, d, "none")


@query("L20 L22 B8", "SELECT key, value FROM newest WHERE NOT is_tombstone AND key % 5 != 0 AND key % 7 != 0 UNION ALL SELECT DISTINCT o_custkey, 1.5 FROM orders WHERE o_custkey % 7 = 0 AND o_custkey % 5 != 0")
def session_put_delete(spark, d):
    lg = kv_log(spark, d)
    keys = _read(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct()
    put = kv.put(keys.where("key % 7 = 0").select("key", F.lit(1.5).alias("value"), (F.col("key") + (1 << 40)).alias("seq")), NOW).select(lg.columns)
    own = put.unionByName(kv.tombstones(keys.where("key % 5 = 0"), lg, 1 << 41))
    return tx.session_read(lg, own).select("key", "value")


@query("L21", "SELECT user_id AS session, count(*) FILTER (event_id > 4000) AS pending FROM events GROUP BY user_id")
def session_pending(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    return tx.pending_writes(e, e.where("seq <= 4000").agg(F.max("seq").alias("seq")))


@query("L23", "SELECT 'kv' AS name, count(*) AS n, max(seq) AS top FROM kvlog WHERE seq <= 3000 UNION ALL SELECT 'queue', count(*), max(seq) FROM q WHERE seq <= 3000")
def read_scope(spark, d):
    both = tx.read_scope({"kv": kv_log(spark, d), "queue": messages(spark, d)}, 3000)
    out = None
    for name, df in both.items():
        one = df.agg(F.count("*").alias("n"), F.max("seq").alias("top")).select(F.lit(name).alias("name"), "n", "top")
        out = one if out is None else out.unionByName(one)
    return out


# -- transactions

_VOTES = "SELECT o_orderkey AS round, n AS participant, CASE WHEN (o_orderkey + n) % 17 = 0 THEN 'refused' ELSE 'prepared' END AS vote FROM orders, (SELECT unnest([1, 2, 3]) AS n) WHERE (o_orderkey * n) % 23 != 0"


def _votes(spark, d) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("round"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("participant")).where("(round * participant) % 23 != 0")
    return o.withColumn("vote", F.when((F.col("round") + F.col("participant")) % 17 == 0, "refused").otherwise("prepared")), spark.range(1, 4).select(F.col("id").cast("int").alias("participant"))


@query("L9 L10", f"WITH v0 AS ({_VOTES}) SELECT round, CASE WHEN count(*) FILTER (vote = 'prepared') = 3 THEN 'confirm' ELSE 'abort' END AS outcome FROM v0 GROUP BY round")
def commit_rounds(spark, d):
    return tx.commit_rounds(*_votes(spark, d))


@query("L11", f"WITH v0 AS ({_VOTES}), x0 AS (SELECT round, count(*) FILTER (vote = 'prepared') = 3 AS good FROM v0 GROUP BY round) SELECT round, CASE WHEN NOT good THEN 'abort' WHEN round % 5 = 0 THEN 'pending' WHEN round % 5 = 1 THEN 'abort' ELSE 'confirm' END AS outcome FROM x0")
def commit_replicated(spark, d):
    votes, who = _votes(spark, d)
    decided = votes.select("round").distinct().where("round % 5 != 0").withColumn("granted", F.col("round") % 5 != 1)
    return tx.commit_rounds(votes, who, decided)


@query("L12", "SELECT user_id AS participant, CASE WHEN c < 2000 THEN 'confirm' ELSE 'abort' END AS action, CASE WHEN c < 2000 THEN 2000 ELSE p END AS seq FROM (SELECT user_id, max(event_id) AS p, min(event_id) * 40 AS c FROM events GROUP BY user_id) WHERE c < 2000 OR p > 2000")
def transaction_reconcile(spark, d):
    e = _read(spark, d, "events").groupBy(F.col("user_id").alias("participant")).agg(F.max("event_id").alias("prepared"), (F.min("event_id") * 40).alias("committed"))
    return tx.reconcile(spark.range(0, 2001, 500).select(F.col("id").alias("seq")), e)


@query("L9 K10", f"WITH v0 AS ({_VOTES}), x0 AS (SELECT round FROM v0 GROUP BY round HAVING count(*) FILTER (vote = 'prepared') = 3) SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey IN (SELECT round FROM x0)")
def committed_only(spark, d):
    lg = _read(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey")).alias("round"))
    return tx.committed_only(lg, tx.commit_rounds(*_votes(spark, d))).select("seq")


@query("J40 J38", "SELECT user_id AS session, event_id AS seq, coalesce(u, 0) AS upto FROM (SELECT *, max(CASE WHEN event_id % 4 != 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM events) WHERE event_id % 4 = 0")
def checkpoint_rounds(spark, d):
    e = _read(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "checkpoint").otherwise("commit").alias("kind"))
    return tx.checkpoint_rounds(e)


@query("L19", """WITH q0 AS (SELECT user_id % 20 AS name, event_id AS seq, event_id * 10 AS t, user_id % 3 AS owner, event_id % 4 = 0 AS rel, event_id % 8 = 0 AS good, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
r AS (SELECT name, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, false AS granted, CAST(NULL AS BIGINT) AS fence, CAST(-1 AS BIGINT) AS held, CAST(0 AS BIGINT) AS token, CAST(0 AS BIGINT) AS fin FROM (SELECT DISTINCT user_id % 20 AS name FROM events)
UNION ALL SELECT q0.name, q0.n, q0.seq,
NOT rel AND ((held = owner AND fin > t) OR held = -1 OR fin <= t),
CASE WHEN rel THEN NULL WHEN held = owner AND fin > t THEN token WHEN held = -1 OR fin <= t THEN q0.seq END,
CASE WHEN NOT rel AND (held = owner OR held = -1 OR fin <= t) THEN owner ELSE held END,
CASE WHEN NOT rel AND NOT (held = owner AND fin > t) AND (held = -1 OR fin <= t) THEN q0.seq ELSE token END,
CASE WHEN NOT rel AND (held = owner OR held = -1 OR fin <= t) THEN t + 900 ELSE fin END
FROM r JOIN q0 ON q0.name = r.name AND q0.n = r.n + 1)
SELECT name, seq, granted, fence FROM r WHERE n > 0 /* recursive */""")
def leases(spark, d):
    e = F.col("event_id")
    r = _read(spark, d, "events").select(
        (F.col("user_id") % 20).alias("name"), e.alias("seq"), (e * 10).alias("at_ms"), (F.col("user_id") % 3).cast("string").alias("owner"),
        F.when(e % 4 == 0, "release").otherwise("acquire").alias("op"), F.lit(900).alias("lease_ms"), F.when(e % 4 == 0, F.lit(-7)).cast("long").alias("token"),
    )
    return tx.leases(r).select("name", "seq", "granted", "fence")


@query("J13", "SELECT user_id AS subscriber, (SELECT count(*) FROM kvlog WHERE seq > u * 37) AS buffered, (SELECT count(*) FROM kvlog WHERE seq > u * 37) <= 5000 AS connected, u * 37 AS resume_after FROM (SELECT DISTINCT user_id, user_id AS u FROM events)")
def watch_hub(spark, d):
    subscribers = _read(spark, d, "events").select(F.col("user_id").alias("subscriber")).distinct().withColumn("consumed", F.col("subscriber") * 37)
    out = tx.watch_hub(kv_log(spark, d), subscribers.withColumn("subscriber", F.col("subscriber").cast("string")), 5000)
    return out.withColumn("subscriber", F.col("subscriber").cast("long"))


# -- indexes


@query("C24 C25 C26 L18", "SELECT key, seq FROM newest WHERE key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def index_find(spark, d):
    built = kv_log(spark, d).groupBy("key").agg(F.max("seq").alias("seq"))
    return index.find(built, _read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key")))


@query("L8 L18", "SELECT key, seq FROM newest")
def index_switch(spark, d):
    lg = kv_log(spark, d)
    return tx.switch_index(lg.where("seq <= 3000"), "key", new_path(spark, "index"), "ordered", lg.where("seq > 3000"))


@query("K4 I12 I13", f"SELECT key, row_number() OVER (ORDER BY {_SWAP}) AS place FROM (SELECT DISTINCT key FROM kvlog)")
def key_order(spark, d):
    keys = kv_log(spark, d).select("key").distinct().withColumn("k", codecs.BYTES.order(F.col("key")))
    return log.dense_index(keys, ["k"], 1, "place").select("key", "place")


@query("G8 G9", "SELECT event_type AS priority, event_id AS seq FROM events WHERE event_id % 2 = 0 ORDER BY 1, 2 LIMIT 150")
def queue_priority_async(spark, d):
    path = new_path(spark, "priority")
    items = _read(spark, d, "events").select(F.col("event_type").alias("priority"), F.col("event_id").alias("seq"))
    items.write.mode("append").parquet(path)
    q = spark.readStream.schema(items.schema).parquet(path).where("seq % 2 = 0").writeStream.format("parquet").option("path", f"{path}-out").option("checkpointLocation", f"{path}-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return queue.by_priority(spark.read.schema(items.schema).parquet(f"{path}-out"), 150)


# -- sources by URI


@query("A17 A18 B31", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def store_by_uri(spark, d):
    import uuid

    kept = new_path(spark, "store")
    n = _read(spark, d, "nation").select("n_nationkey", "n_name")
    schema = n.schema
    files.save_table(n, f"local://{kept.removeprefix('file://').removeprefix('file:')}?compression=zstd", "append")
    memory = f"memory:///t{uuid.uuid4().hex}"
    files.save_table(_read(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), memory)
    return files.open_table(spark, f"local://{kept.removeprefix('file://').removeprefix('file:')}?compression=zstd", schema).unionByName(files.open_table(spark, memory, schema))


@query("A18", "SELECT 's3a' AS scheme, 's3a://bucket/a' AS path, 'zstd' AS codec UNION ALL SELECT 'file', 'file:///data', NULL UNION ALL SELECT 'memory', '/t', '1'")
def store_specs(spark, d):
    rows = []
    for spec in ("s3://bucket/a?codec=zstd", "local:///data", "memory:///t?codec=1"):
        scheme, path, options = files.parse_store(spec)
        rows.append((scheme, path, options.get("codec")))
    return spark.createDataFrame(rows, "scheme string, path string, codec string")


@query("A19 A20 A21", "SELECT t AS name FROM (VALUES ('customer.parquet'), ('conversations.parquet')) v(t)")
def list_files(spark, d):
    return files.list_entries(spark, d, "c*.parquet").select("name")


@query("A14 A23", "SELECT '50415231' AS head UNION ALL SELECT '50415231'")
def read_range(spark, d):
    one = files.read_bytes(spark, f"{d}/region.parquet", 0, 4).select(F.hex("content").alias("head"))
    return one.unionByName(files.read_bytes(spark, f"{d}/nation.parquet", 0, 4).select(F.hex("content").alias("head")))


@query("A14 K5", "SELECT c_custkey AS key, c_custkey * 2 AS seq, c_custkey % 4 = 0 AS is_tombstone, c_name AS payload FROM customer")
def record_files(spark, d):
    path = new_path(spark, "records")
    rows = _read(spark, d, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") * 2).alias("seq"), (F.col("c_custkey") % 4 == 0).alias("is_tombstone"), F.encode("c_name", "UTF-8").alias("payload"))
    return files.read_record_blocks(spark, files.write_records(rows, path)).select("key", "seq", "is_tombstone", F.decode("payload", "UTF-8").alias("payload"))


# -- codecs

_POINT = codecs.Layout((("kind", "u8"), ("key", "i32"), ("seq", "i64"), ("small", "i16")))
_EVENT = codecs.Message(((1, "put", codecs.Layout((("key", "i64"), ("size", "u32")))), (2, "delete", codecs.Layout((("key", "i64"),)))))


@query("K14 K13", f"SELECT event_id, '07' || {_le('event_id - 3000', 4)} || {_le('event_id * 1000003', 8)} || {_le('-event_id % 300', 2)} AS bytes FROM events")
def layout_write(spark, d):
    e = F.col("event_id")
    return _read(spark, d, "events").select("event_id", F.hex(_POINT.write(kind=F.lit(7), key=e - 3000, seq=e * 1_000_003, small=-e % 300)).alias("bytes"))


@query("K14", "SELECT event_id, 7 AS kind, event_id - 3000 AS key, event_id * 1000003 AS seq, -event_id % 300 AS small FROM events")
def layout_read(spark, d):
    e = F.col("event_id")
    x = _read(spark, d, "events").select("event_id", _POINT.read(_POINT.write(kind=F.lit(7), key=e - 3000, seq=e * 1_000_003, small=-e % 300)).alias("u"))
    return x.select("event_id", "u.*")


@query("K15", "SELECT seq, CASE WHEN is_tombstone THEN 'delete' ELSE 'put' END AS tag, key, CASE WHEN NOT is_tombstone THEN seq % 1000 END AS size FROM kvlog")
def tagged_messages(spark, d):
    lg = kv_log(spark, d)
    data = F.when(F.col("is_tombstone"), _EVENT.write("delete", key=F.col("key"))).otherwise(_EVENT.write("put", key=F.col("key"), size=F.col("seq") % 1000))
    u = lg.select("seq", _EVENT.read(data).alias("u"))
    return u.select("seq", "u.tag", F.coalesce("u.put.key", "u.delete.key").alias("key"), F.col("u.put.size").alias("size"))


@query("K3", "SELECT c_custkey, octet_length(encode(c_name)) AS size, c_name AS text, c_custkey * 3 AS number FROM customer")
def value_formats(spark, d):
    c = _read(spark, d, "customer")
    t, n = codecs.TEXT, codecs.LONG
    return c.select("c_custkey", t.size(F.col("c_name")).cast("long").alias("size"), t.parse(t.format(F.col("c_name"))).alias("text"), n.parse(n.format(F.col("c_custkey") * 3)).alias("number"))


@query("K16")
def command_list(spark, d):
    """What the command line offers (``python -m tidelog --list``)."""
    from tidelog.plans.catalog import INVENTORY, ORACLE_SQL

    return spark.createDataFrame([(n, r, n in ORACLE_SQL) for n, r in sorted(INVENTORY.items())], "name string, rows string, has_oracle boolean")


# -- streams


def _drain(df: DataFrame, path: str, mode: str = "append") -> None:
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()


_CHANGES = "SELECT key, CASE WHEN is_tombstone THEN 'delete' ELSE 'put' END AS kind, seq FROM kvlog WHERE seq > 500"


@query("J12 J14 J15 J16", f"SELECT 'a' AS consumer, * FROM ({_CHANGES}) UNION ALL SELECT 'b', * FROM ({_CHANGES}) WHERE key % 2 = 0")
def feed_history_then_live(spark, d):
    """Two consumers of a log that grows between their runs: each resumes from its checkpoint."""
    path, lg = new_path(spark, "feed"), kv_log(spark, d).select("key", "is_tombstone", "seq")
    stream = lambda: feeds.changes(spark, f"{path}/log", lg.schema, after=500)
    out = []
    for part in (lg.where("seq <= 3000"), lg.where("seq > 3000")):
        part.write.mode("append").parquet(f"{path}/log")
        _drain(stream(), f"{path}/a")
        _drain(stream().where("key % 2 = 0"), f"{path}/b")
    for name in ("a", "b"):
        out.append(spark.read.schema(schemas.CHANGE).parquet(f"{path}/{name}/out").select(F.lit(name).alias("consumer"), "key", "kind", "seq"))
    return out[0].unionByName(out[1])


@query("A3 J15 K5", _CHANGES.replace("500", "100"))
def feed_source(spark, d):
    """The change feed data source, batch for history and a stream for the rest, by offsets."""
    path, lg = new_path(spark, "source"), kv_log(spark, d).select("key", "is_tombstone", "seq")
    spark.dataSource.register(change_feed.ChangeFeed)
    lg.where("seq <= 2000").write.mode("append").parquet(f"{path}/log")
    history = settled(spark.read.format("tidelog_changes").option("path", f"{path}/log").option("after", "100").load(), "history")
    lg.where("seq > 2000").write.mode("append").parquet(f"{path}/log")
    _drain(spark.readStream.format("tidelog_changes").option("path", f"{path}/log").option("after", "2000").load(), f"{path}/live")
    return history.unionByName(spark.read.schema(schemas.CHANGE).parquet(f"{path}/live/out"))


@query("E1 E6 E7 E8", f"""SELECT series_id, ts - ts % {HOUR} AS "window", min(value) AS min, max(value) AS max, round(sum(value), 6) AS sum, CAST(count(*) AS DOUBLE) AS count,
round(avg(value), 6) AS avg, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last FROM s GROUP BY ALL""")
def ts_rollup_stream(spark, d):
    """All seven aggregates of every window, by a stream whose state a last late row closes."""
    path = new_path(spark, "rollup")
    s = _read(spark, d, "events").select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    s.write.mode("append").parquet(f"{path}/in")
    end = s.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("long").alias("series_id"), (F.col("m") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("value"))
    src = lambda: spark.readStream.schema(s.schema).parquet(f"{path}/in")
    _drain(feeds.rollup(src(), "1 hour", "1 day"), f"{path}/r")
    end.write.mode("append").parquet(f"{path}/in")
    _drain(feeds.rollup(src(), "1 hour", "1 day"), f"{path}/r")
    out = spark.read.parquet(f"{path}/r/out").where("series_id >= 0")
    return _rounded(out.withColumn("window", tb.ticks_of("window")).withColumn("count", F.col("count").cast("double")), "sum", "avg")


@query("J19 J18", "SELECT DISTINCT producer_id, producer_seq FROM q")
def queue_dedup_stream(spark, d):
    path = new_path(spark, "dedup")
    e = _read(spark, d, "events").select(F.col("user_id").alias("producer_id"), (F.col("event_id") % 50).alias("producer_seq"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.mode("append").parquet(f"{path}/in")
    src = spark.readStream.schema(e.schema).parquet(f"{path}/in")
    _drain(feeds.deduplicated(src, ["producer_id", "producer_seq"], "ts", "3650 days"), f"{path}/d")
    return spark.read.parquet(f"{path}/d/out").select("producer_id", "producer_seq")


@query("J25 L10", "SELECT event_type AS \"group\", count(*) AS acked FROM events WHERE event_id % 4 = 0 GROUP BY 1")
def ack_in_round(spark, d):
    """Acknowledgements take effect with the batch that writes the results, once each."""
    path = new_path(spark, "round")
    acks = state(spark, d).where("seq % 4 = 0").select("group", "seq")
    acks.write.mode("append").parquet(f"{path}/in")
    write = feeds.write_once(f"{path}/done")
    q = spark.readStream.schema(acks.schema).parquet(f"{path}/in").writeStream.foreachBatch(lambda b, i: (write(b, i), write(b, i))).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/done").groupBy("group").agg(F.count("*").alias("acked"))
