"""Random histories against plain models."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import collections as co
from tidelog.operators import kv, log, ordered, series

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.booleans(), st.integers(0, 3)), max_size=25), st.integers(0, 3))
def test_current_view(spark, ops, now):
    lg = spark.createDataFrame([(k, v, e, i, t) for i, (k, v, t, e) in enumerate(ops)], "key long, value long, expiry long, seq long, is_tombstone boolean")
    model = {}
    for k, v, t, e in ops:
        model[k] = None if t or (e and e <= now) else v
    got = {r.key: r.value for r in log.current(lg, ["key"], now).collect()}
    assert got == {k: v for k, v in model.items() if v is not None}
    assert {r.seq for r in log.superseded(lg, ["key"]).collect()} == set(range(len(ops))) - {r.seq for r in log.current(lg, ["key"]).collect()}


@FEW
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.integers(-3, 3), max_size=12), st.integers(-14, 14), st.integers(-14, 14), st.booleans())
def test_rank_slices(spark, scores, start, stop, reverse):
    z = spark.createDataFrame([(1, m, float(s), 0) for m, s in scores.items()], "domain long, member string, score double, seq long")
    members = [m for m, _ in sorted(scores.items(), key=lambda x: (x[1], x[0].encode()), reverse=reverse)]
    n = len(members)
    low, high = (max(0, start + n if start < 0 else start), stop + n if stop < 0 else stop)
    want = members[low : high + 1] if high >= 0 else []
    for spread in (False, True):
        assert [r.member for r in co.rank_range(z, start, stop, reverse, spread).orderBy("rank").collect()] == want


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20)), max_size=25), st.lists(st.tuples(st.integers(0, 3), st.integers(-2, 22)), max_size=10), st.booleans())
def test_floor(spark, rows, probes, strict):
    s = spark.createDataFrame([(a, t, i, float(i)) for i, (a, t) in enumerate(rows)], "series_id long, ts long, seq long, value double")
    p = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(probes)], "series_id long, t long, n long")
    want = {}
    for i, (a, t) in enumerate(probes):
        below = [(ts, k) for k, (b, ts) in enumerate(rows) if b == a and (ts < t if strict else ts <= t)]
        want[i] = max(below)[1] if below else None
    for spread in (False, True):
        assert {r.n: r.seq for r in series.floor(s, p, strict, spread).collect()} == want


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-9, 9)), max_size=30))
def test_running_sums(spark, rows):
    d = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], "key string, seq long, delta long")
    total, want = {}, {}
    for i, (k, v) in enumerate(rows):
        want[i] = total[k] = total.get(k, 0) + v
    assert {r.seq: r.after for r in kv.increments(d, ["key"], spread=True).collect()} == want
    assert {r.seq: r.t for r in ordered.running_sum(d, [], ["seq"], F.lit(1), "t").collect()} == {i: i + 1 for i in range(len(rows))}
