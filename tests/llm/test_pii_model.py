"""The network, the decoding and the added spans of op8 against brute force."""

from __future__ import annotations

import ctypes
from itertools import product

import numpy as np
import pytest

from tidelog.llm import pii_bilstm as pii
from tidelog.llm.common import keep_freed

SF = "/root/testdata/sf0.01"


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    p = pii.first_weights(rng, 5)
    x, y = rng.integers(0, len(p["wxf"]), (3, 7)), rng.integers(0, 5, (3, 7))
    _, g = pii.loss_and_gradients(x, y, p)
    for name, v in p.items():
        spots = [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]
        spots += [(int(x[0, 2]), 3), (int(x[2, 6]), 1)] if name.startswith("wx") else []
        for at in spots:
            old, eps = v[at], 1e-5
            v[at] = old + eps
            up = pii.loss_and_gradients(x, y, p)[0]
            v[at] = old - eps
            down = pii.loss_and_gradients(x, y, p)[0]
            v[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-7)


def test_plain_states_equal_those_of_training():
    rng = np.random.default_rng(4)
    p = pii.first_weights(rng)
    x = rng.integers(0, len(p["wxf"]), (9, 30))
    h, _, _ = pii._states(x, p)
    assert np.allclose(pii.emissions(x.T, p), h @ p["wo"] + p["bo"])


@pytest.mark.parametrize("by_tanh", [True, False])
def test_states_by_tanh_and_by_exponentials(by_tanh, monkeypatch):
    """Either form equals the network of training, gates and cells far beyond what exponentials
    of 32 bits hold included (a step, since such networks are chaotic); without a quick tanh
    none is taken."""
    rng = np.random.default_rng(8)
    for size, factor, steps in ((pii.HIDDEN, 1, 60), (5, 1, 60), (pii.HIDDEN, 400, 1)):
        p = {n: (v * factor).astype(np.float32) for n, v in pii.first_weights(rng, size).items()}
        x = rng.integers(0, len(p["wxf"]), (40, steps))
        h, _, _ = pii._states(x, p)
        with monkeypatch.context() as m:
            m.setattr(pii, "_BY_TANH", by_tanh)
            if not by_tanh:
                m.delattr(np, "tanh")
            got = pii.emissions(x.T, p)
        assert np.isfinite(got).all() and np.allclose(got, h @ p["wo"] + p["bo"], atol=2e-5 * factor)


def test_freed_memory_is_kept():
    """Arrays of megabytes are not cleared anew each time."""
    resource = pytest.importorskip("resource")
    if not hasattr(ctypes.CDLL(None), "mallopt"):
        pytest.skip("no mallopt")
    keep_freed()
    faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    many = lambda: [np.ones(300_000) for _ in range(8)]  # noqa: E731  19 MB
    many()
    before = faults()
    for _ in range(20):
        many()
    assert faults() - before < 20_000  # of 94,000 pages


def best_path(score, trans):
    paths = product(range(score.shape[1]), repeat=len(score))
    return max(paths, key=lambda y: sum(score[t, k] for t, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))


def test_viterbi_and_decode_equal_enumeration():
    rng = np.random.default_rng(1)
    for k in range(30):
        sizes = [6, 0, 1, 4, 7]
        at = np.concatenate([[0], np.cumsum(sizes)])
        score, trans = rng.normal(0, 3, (at[-1], 3)), rng.normal(0, 1, (3, 3))
        score[:, 0] += k % 4  # from no anchored characters to many
        want = [y for a, b in zip(at, at[1:], strict=False) for y in (best_path(score[a:b], trans) if b > a else ())]
        assert pii.viterbi(score, trans, at).tolist() == want
        assert pii.decode(score, trans, at).tolist() == want
        assert not np.array(want)[pii.anchored(score, trans)].any()


@pytest.fixture(scope="module")
def model(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0 and length(text) between 1 and 8000").orderBy("doc_id").limit(400).collect()]
    return pii.fit(*pii.training_windows(texts))


@pytest.fixture(scope="module")
def held(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1 and length(text) > 0").orderBy("doc_id").limit(300).collect()]


def test_whole_texts_decode_as_one_chain(model, held):
    """Stretches between anchored characters give what one chain over the whole text gives,
    over number tables of many windows, too; a text alone gives what it gives among others."""
    rng = np.random.default_rng(2)
    table = " ".join(pii.generated(rng)[0] for _ in range(1500))
    texts = [*held[:40], table, "", "9" * 3000, "7"]
    score, at = pii.evidence(texts, model)
    trans = model["trans"].astype(float)
    tags = pii.decode(score, trans, at)
    assert tags.tolist() == pii.viterbi(score, trans, at).tolist() and tags.any()
    assert pii.anchored(score, trans)[: at[40]].mean() > 0.9
    alone, _ = pii.evidence([table], model)
    assert np.allclose(alone, score[at[40] : at[41]], atol=1e-4)


def test_characters_are_summed_once_and_by_tag_only_where_unsure(model, held, monkeypatch):
    """What is anchored is what running sums over the whole chain give for each tag, while only a
    small part of the characters is summed for each."""
    table = " ".join(pii.generated(np.random.default_rng(7))[0] for _ in range(100))
    score, _ = pii.evidence([*held[:100], table], model)
    trans = model["trans"].astype(float)
    outside, summed = pii._outside, []
    monkeypatch.setattr(pii, "_outside", lambda lost, gain: (summed.append(len(lost)), outside(lost, gain))[1])
    got = pii.anchored(score, trans)
    assert sum(summed) <= 1.5 * len(score)
    want = np.ones(len(score), dtype=bool)
    for y in range(1, 5):
        others = [a for a in range(5) if a != y]
        gain = max(0, (trans[others, y] - trans[others, 0]).max()) + max(0, (trans[y, others] - trans[0, others]).max()) - trans[y, y] + trans[0, 0]
        want &= outside(score[:, 0] - score[:, y] - (trans[y, y] - trans[0, 0]), gain)
    assert not (got & ~want).any() and (want & ~got).mean() <= 0.01 and not got.all()


def test_evidence_of_texts_that_end_anywhere_in_a_window(model):
    """Texts of every length about the windows' borders, among others, by brute force."""
    rng = np.random.default_rng(6)
    texts = ["".join("+49 ab@C.d1"[i] for i in rng.integers(0, 11, n)) for n in (1, 95, 96, 97, 127, 128, 129, 191, 192, 193, 223, 224, 225, 0, 320, 321, 1000)]
    score, at = pii.evidence(texts, model)
    weight = np.minimum(np.arange(1, pii.WINDOW + 1), np.arange(pii.WINDOW, 0, -1))
    for text, a, b in zip(texts, at, at[1:], strict=False):
        n = len(text)
        assert b - a == n
        total, share = np.zeros((n + 2 * pii.WINDOW, 5)), np.zeros(n + 2 * pii.WINDOW)
        for start in range(0, max(1, n - pii.WINDOW + pii.STEP), pii.STEP) if n else ():
            window = np.full(pii.WINDOW, pii._BLANK)
            some = pii.classes(text[start : start + pii.WINDOW])
            window[: len(some)] = some
            total[start : start + pii.WINDOW] += pii.emissions(window[:, None], model)[:, 0] * weight[:, None]
            share[start : start + pii.WINDOW] += weight
        assert np.allclose(score[a:b], total[:n] / np.maximum(share[:n, None], 1), atol=1e-4)


def test_evidence_is_the_weighted_mean_of_all_windows(model):
    text = "call +49 (030) 123-4567 or 4111.1111.1111.1111 " * 11
    score, _ = pii.evidence([text], model)
    x = np.concatenate([pii.classes(text), np.full(pii.WINDOW, pii._BLANK)])
    total, share = np.zeros((len(x), 5)), np.zeros(len(x))
    for start in range(0, max(1, len(text) - pii.WINDOW + pii.STEP), pii.STEP):
        w = np.minimum(np.arange(1, pii.WINDOW + 1), np.arange(pii.WINDOW, 0, -1))
        n = min(pii.WINDOW, len(x) - start)
        window = np.full(pii.WINDOW, pii._BLANK)
        window[:n] = x[start : start + n]
        e = pii.emissions(window[:, None], model)[:, 0]
        total[start : start + n] += (e * w[:, None])[:n]
        share[start : start + n] += w[:n]
    n = len(text)
    assert np.allclose(score, total[:n] / share[:n, None], atol=1e-4)


def test_added_spans_on_held_out_forms(model, held):
    """Exact borders, in documents and strings that training did not see."""
    pieces = pii.planted(held, 3000, np.random.default_rng(99))
    hit = miss = wrong = 0
    for (text, kind, a, b), (base, every) in zip(pieces, pii.all_spans([t for t, *_ in pieces], model), strict=True):
        added = set(every) - set(base)
        wanted = kind and pii.holds(kind, text[a:b]) and not any(x < b and y > a for _, x, y in base)
        hit += bool(wanted and (kind, a, b) in added)
        miss += bool(wanted and (kind, a, b) not in added)
        wrong += len(added - {(kind, a, b)} if wanted else added)
    assert hit > 800 and hit >= 0.9 * (hit + miss) and hit >= 0.95 * (hit + wrong)


def test_digit_runs_that_fail_the_check_are_no_cards(model):
    rng = np.random.default_rng(5)
    runs = ["".join(str(rng.integers(10)) for _ in range(n)) for n in range(13, 20) for _ in range(60)]
    texts = [f"order {r} sent" for r in runs if not pii.luhn(r)]
    assert not any(k == "card" for _, every in pii.all_spans(texts, model) for k, _, _ in every)


def test_base_addresses_with_leading_zeros():
    for text in ("0" * 25 + "1.2.3.4", "1.2.3." + "0" * 21 + "4", "0.0.0." + "0" * 4000):
        assert pii.base_spans(text)[0] == ("ip", 0, len(text))
    assert not pii.base_spans("0" * 30 + "256.1.1.1")


def test_sample_is_bounded_however_ids_repeat(spark):
    from tidelog.llm.training import documents_sample

    rows = [(7, f"text {k} of one id") for k in range(3000)] + [(None, "no id")] * 500 + [(k, f"own text {k}") for k in range(100, 300)]
    got = documents_sample(spark.createDataFrame(rows, "doc_id long, text string"), 50, 100)
    assert len(got) == 50 and sum("one id" in t for t in got) <= 1 and "no id" not in got
