"""Secret scans judged by who owns a candidate, in DataFrame functions only.

Candidates are found by patterns in whole texts.  Their values' hashes are counted over
the corpus by distinct owners (``source``) and repositories (here: documents of an
owner).  A value that ``EXAMPLE_OWNERS`` owners or more share is a copied example; one
that a single owner holds and that looks random is live.  Of those between, which owners'
numbers leave open, values with a placeholder's word are taken for examples (``PLACEHOLDER``).  Live free-standing tokens that no base
pattern covers are added to the spans.

Positions come from ``split`` and ``regexp_extract_all`` of the same pattern: gaps and
matches alternate, and running sums over them (a window by text) give code point
offsets.  Counting is by (value, owner, document), then (value, owner), then value, each
with partial sums, so a value that a third of all rows hold is never gathered.

Defined results: null text counts as empty; a null source is an owner of its own; rows
that repeat id and text give equal rows; spans that begin alike go by kind as listed; texts of
any length are matched whole; extra columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, read_table, small_batches, written
from .components import hot_above, join_by_key

EXAMPLE_OWNERS = 3
MASK = "[secret]"
_NAME = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: kind: (pattern, group of the value, least length of the value), in listed order.
#: A run of hex digits or capitals is maximal, so its least length may stand in the
#: pattern; a short assignment must still be consumed, so its length is tested after.
PATTERNS = {
    "assign": (f"({_NAME})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),
    "token": ("[A-Za-z0-9+/_-]{24,}", 0, 24),
}
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|your|xxxx|12345678"


def _row_key(docs: DataFrame) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)


def _found(text: Column, kind: str) -> Column:
    """Array of (gap, size, value): what lies before a match, its length, its value."""
    pattern, group, _ = PATTERNS[kind]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    found = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.zip_with(whole, value, lambda a, b: F.struct(F.length(a).alias("size"), b.alias("value"))), lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(pattern), found)


def _mixed(v: Column) -> Column:
    return v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")


def _random_looking(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= 8)


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (k, doc_id) of docs and judged spans (k, rank, kind, start, end, live, base);
    k identifies an id and text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.coalesce(F.col("source").cast("string"), F.lit("\x00none")) if "source" in docs.columns else F.lit("\x00none")
    kinds = list(PATTERNS)
    # all kinds of a text in one array, so that the texts are read once
    empty = F.array().cast("array<struct<rank:int,kind:string,pos:int,gap:int,size:int,value:string>>")

    def tagged(rank: int, kind: str) -> Column:
        item = lambda m, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("pos"), m["gap"].alias("gap"), m["size"].alias("size"), m["value"].alias("value"))
        return F.coalesce(F.transform(_found(text, kind), item), empty)

    each = [tagged(rank, kind) for rank, kind in enumerate(kinds)]
    found = docs.select(_row_key(docs).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), F.explode(F.concat(*each)).alias("m"))
    # repeated rows of an owner give the same matches once; every owner is counted
    parts = found.select("k", "doc_id", "owner", "m.rank", "m.kind", "m.pos", "m").dropDuplicates(["k", "owner", "rank", "pos"])
    run = W.partitionBy("k", "owner", "rank").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(run)
    least = F.element_at(F.create_map(*(F.lit(x) for kind in kinds for x in (kind, PATTERNS[kind][2]))), F.col("kind"))
    value = F.col("m.value")
    at = parts.select("k", "doc_id", "owner", "rank", "kind", (end - F.col("m.size")).alias("start"), end.alias("end"), value.alias("value"))
    at = at.where((F.length("value") >= least) & ((F.col("kind") != "token") | _mixed(F.col("value"))))
    # a token that a base span touches is no token of its own
    before = W.partitionBy("k", "owner").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("k", "owner").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, -1)
    base = F.col("kind") != "token"
    free = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    at = at.select("*", base.alias("base"), (base | free).alias("keep")).where("keep")
    at = written(at.select("k", "doc_id", "owner", "rank", "kind", "start", "end", "base", F.sha2("value", 256).alias("hash"), _random_looking(F.col("value")).alias("random"), F.col("value").rlike(PLACEHOLDER).alias("placeholder")), "secret-spans")
    spread = (
        at.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    once = at.drop("owner", "doc_id").dropDuplicates(["k", "rank", "start"])
    # a value that very many rows hold stays where it is read
    spread = spread.withColumn("_rows", F.col("repositories"))
    judged = join_by_key(once, spread, "hash", "_rows", hot_above(at.count())).withColumn("live", F.col("random") & ((F.col("owners") == 1) | ((F.col("owners") < EXAMPLE_OWNERS) & ~F.col("placeholder"))))
    return docs.select(_row_key(docs).alias("k"), F.col("doc_id").cast("long").alias("doc_id")), judged.where("base or live").select("k", "rank", "kind", "start", "end", "base", "live", "owners", "repositories")


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(items), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for every row of docs: counts by kind, digest of the base spans, all spans,
    and how many are live or copied examples."""
    rows, judged = spans(docs)
    item = F.struct("start", "rank", "kind", "end")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    by_text = judged.groupBy("k").agg(
        *(count(kind) for kind in PATTERNS),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(F.col("owners") >= EXAMPLE_OWNERS, 1)).alias("n_example"),
        _joined(F.collect_list(F.when(F.col("base"), item))).alias("base"),
        _joined(F.collect_list(item)).alias("spans"),
    )
    full = rows.join(by_text, "k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return full.select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_token"), zero("n_live"), zero("n_example"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every live secret masked (and ``n_chars``, if there is one, as it then is);
    all columns and rows stay."""
    _, judged = spans(docs)
    by = W.partitionBy("k").orderBy("start", "end")
    apart = F.col("start") >= F.coalesce(F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = judged.where("live").select("k", "start", "end", F.when(apart, 1).otherwise(0).alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    cuts = runs.groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    k, cut = fresh(docs, "_k", "_cuts")
    cuts = cuts.groupBy(F.col("k").alias(k)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    joined = docs.withColumn(k, _row_key(docs)).join(cuts, k, "left")
    n, spot = F.size(cut), F.col(cut)
    begin = lambda i: F.when(i == 0, 0).otherwise(spot[i - 1]["end"])
    between = lambda i: F.substring("text", begin(i) + 1, F.when(i == n, F.length("text")).otherwise(spot[i]["start"]) - begin(i))
    masked = F.array_join(F.transform(F.sequence(F.lit(0), n), between), MASK)
    out = joined.withColumn("text", F.when(spot.isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spot.isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT rid, doc_id, owner, {rank} AS rank, '{kind}' AS kind, generate_subscripts(g, 1) AS pos, unnest(g[1:len(w)]) AS gap, unnest(w) AS w, unnest(v) AS v FROM "
        f"(SELECT rid, doc_id, owner, string_split_regex(t, {quote(p)}) AS g0, regexp_extract_all(t, {quote(p)}, 0) AS w, regexp_extract_all(t, {quote(p)}, {group}) AS v, g0[1:len(w)] AS g FROM d) WHERE len(w) > 0"
        for rank, (kind, (p, group, _)) in enumerate(PATTERNS.items())
    )
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, (_, _, n) in PATTERNS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT *, sum(length(gap) + length(w)) OVER (PARTITION BY rid, rank ORDER BY pos) AS fin FROM m),
c AS (SELECT rid, doc_id, owner, rank, kind, CAST(fin - length(w) AS BIGINT) AS s, CAST(fin AS BIGINT) AS f, v FROM e
      WHERE length(v) >= CASE kind {least} END
        AND (kind != 'token' OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
k AS (SELECT * FROM c WHERE kind != 'token' OR NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = c.rid AND b.kind != 'token' AND b.s < c.f AND b.f > c.s)),
o AS (SELECT v, count(DISTINCT owner) AS owners FROM k GROUP BY v),
j AS (SELECT k.*, o.owners, (o.owners = 1 OR o.owners < {EXAMPLE_OWNERS} AND NOT regexp_matches(k.v, {quote(PLACEHOLDER)})) AND regexp_matches(k.v, '[0-9]') AND regexp_matches(k.v, '[A-Za-z]')
             AND len(list_distinct(string_split(k.v, ''))) >= 8 AS live FROM k JOIN o USING (v)),
z AS (SELECT * FROM j WHERE kind != 'token' OR live),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             count(*) FILTER (kind = 'token') AS n_token, count(*) FILTER (live) AS n_live, count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example,
             string_agg(kind || ':' || s || ':' || f, ',' ORDER BY s, rank) FILTER (kind != 'token') AS base,
             string_agg(kind || ':' || s || ':' || f, ',' ORDER BY s, rank) AS spans FROM z GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_token, 0) AS n_token, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN a USING (rid)"""


ORACLE_SQL = _sql()
