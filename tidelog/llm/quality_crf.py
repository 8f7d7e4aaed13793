"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad.  A line's evidence is linear in its own features and in those
of the lines before and after it; transitions tie neighbouring labels.  Marginals come
from forward-backward, and a document's quality is the mean probability of "good" over
its lines, weighted by their lengths.

Fitting uses at most ``TRAIN_PER_CLASS`` documents of each label, each of at most
``TRAIN_CHARS`` characters (a bounded sample); every line of a labelled document carries
the document's label.  Since no such document changes its label, documents are also put
together from runs of lines of a good and a bad one (``MIXED`` of them for each ten of the
sample), from which transitions learn how surely neighbours agree.

Defined results: null text counts as empty; a text without a non-blank line is one empty
line; no usable labels give 0.5 for all; repeated rows get one result each; a score of
exactly ``THRESHOLD`` is predicted 1; a text of any length is read whole; extra columns are
ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ids_and_texts, map_batches, read_table, release, texts_of
from .textvec import _word_hashes_of, code_points, pieces, tables_for
from .training import labelled_sample, minimise

TRAIN_PER_CLASS = 2000
TRAIN_CHARS = 20_000
THRESHOLD = 0.3
FEATURES = 11
#: Documents put together from two, for each ten of the sample.
MIXED = 2


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, line lengths, where each text's lines begin); blank lines are
    left out, and a text with no other has one empty line."""
    lines = np.array([t.count("\n") + 1 if t else 1 for t in texts], dtype=np.int64)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lines, out=at[1:])
    # letters, upper case, digits, marks, spaces, words, repeats, near repeats, characters
    stat = np.zeros((at[-1], 9))
    key = np.zeros(at[-1], dtype=np.uint64)
    done = at[:-1].copy()
    for who, part, _ in pieces(texts, overlap=0):
        cp = code_points("".join(part))
        if not len(cp):
            continue
        begin = np.cumsum([0] + [len(p) for p in part])[:-1]
        nl = cp == 10
        after = np.flatnonzero(nl) + 1
        starts = np.unique(np.concatenate([begin[begin < len(cp)], after[after < len(cp)]]))
        # the line that each fragment belongs to
        owner = np.searchsorted(begin, starts, side="right") - 1
        owner = np.array(who, dtype=np.int64)[owner]
        line = np.zeros(len(starts), dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(nl)])
        of_piece = np.searchsorted(begin, starts, side="right") - 1
        line = np.array([done[w] for w in who], dtype=np.int64)[of_piece] + before[starts] - before[begin[of_piece]]
        for w, p in zip(who, part, strict=True):
            done[w] += p.count("\n")
        lower, alnum = tables_for(cp)
        letter = alnum[cp]
        digit = (cp >= 48) & (cp <= 57)
        space = (cp == 32) | (cp == 9) | (cp == 13)
        upper = lower[cp] != cp
        mark = ~(letter | space | nl) & (cp != 46) & (cp != 44) & (cp != 39)
        add = np.add.reduceat
        cols = [add(x.astype(np.int32), starts) for x in (letter & ~digit, upper, digit, mark, space)]
        h, wb, _ = _word_hashes_of(cp)
        home = np.searchsorted(starts, wb, side="right") - 1
        same = np.zeros(len(h), dtype=bool)
        near = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (home[1:] == home[:-1])
        near[2:] = (h[2:] == h[:-2]) & (home[2:] == home[:-2])
        n = len(starts)
        cols += [np.bincount(home, minlength=n), np.bincount(home[same], minlength=n), np.bincount(home[near], minlength=n)]
        cols.append(add((~nl).astype(np.int32), starts))
        np.add.at(stat, line, np.stack(cols, axis=1))
        if len(h):
            total = np.zeros(n, dtype=np.uint64)
            np.add.at(total, home, h)
            np.add.at(key, line, total)
    size = stat[:, 8]
    keep = size - stat[:, 4] > 0
    owner = np.repeat(np.arange(len(texts)), lines)
    counts = np.bincount(owner[keep], minlength=len(texts))
    empty = counts == 0
    keep[at[:-1][empty]] = True
    counts[empty] = 1
    stat, key, owner, size = stat[keep], key[keep], owner[keep], size[keep]
    to = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=to[1:])
    order = np.lexsort((np.arange(len(key)), key, owner))
    again = np.zeros(len(key))
    twin = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again[order[1:]] = twin
    full = np.maximum(size, 1)
    words = stat[:, 5]
    per_word = np.maximum(words, 1)
    out = np.stack(
        [
            stat[:, 0] / full,
            stat[:, 1] / np.maximum(stat[:, 0], 1),
            stat[:, 2] / full,
            np.minimum(1, 4 * stat[:, 3] / full),
            np.minimum(1, stat[:, 3] / per_word),
            stat[:, 4] / full,
            np.minimum(1, full / per_word / 20),
            stat[:, 6] / per_word,
            stat[:, 7] / per_word,
            again,
            np.log1p(size) / 10,
        ],
        axis=1,
    )
    return out, size, to


def with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in the same text
    (its own at the ends), and a constant."""
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[at[:-1]] = x[at[:-1]]
    after[at[1:] - 1] = x[at[1:] - 1]
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(emit: np.ndarray, trans: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all texts at once.  emit: log potentials (line, 2); trans:
    (2, 2) log potentials.  Returns P(label) by line, the expected transition counts
    summed over the texts, and the sum of log partition functions."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, sizes = at[:-1][order], n[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    e = np.exp(trans)

    def step(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        top = v.max(axis=1, keepdims=True)
        return np.log(np.exp(v - top) @ m) + top

    if longest:
        a[begin] = emit[begin]
    for t in range(1, longest):
        k = begin[: live[t]] + t
        a[k] = emit[k] + step(a[k - 1], e)
    for t in range(longest - 2, -1, -1):
        k = begin[: live[t + 1]] + t
        b[k] = step(emit[k + 1] + b[k + 1], e.T)
    both = a + b
    top = both.max(axis=1, keepdims=True)
    z = np.log(np.exp(both - top).sum(axis=1, keepdims=True)) + top
    inner = np.ones(len(emit), dtype=bool)
    inner[at[1:] - 1] = False
    k = np.flatnonzero(inner)
    pair = a[k][:, :, None] + trans + (emit[k + 1] + b[k + 1])[:, None, :] - z[k][:, :, None]
    return np.exp(both - z), np.exp(pair).sum(axis=0), float(z[at[:-1], 0].sum())


def mixed_documents(sample: list[tuple[str, str]], n: int, seed: int = 6) -> list[tuple[str, list[int]]]:
    """n texts of runs of lines, in turn from a good and from a bad document, with their lines'
    labels; blank lines, which are no lines of their own, are left out."""
    rng = np.random.default_rng(seed)
    lines = {c: [x for x in ([line for line in t.split("\n") if line.strip()] for t, label in sample if (label == "1") == c) if x] for c in (True, False)}
    out = []
    while len(out) < n and all(lines.values()):
        text, labels, turn = [], [], bool(rng.integers(2))
        source = {c: lines[c][rng.integers(len(lines[c]))] for c in lines}
        for _ in range(int(rng.integers(2, 5))):
            own = source[turn]
            at = int(rng.integers(len(own)))
            run = own[at : at + int(rng.integers(1, 9))]
            text += run
            labels += [int(turn)] * len(run)
            turn = not turn
        out.append(("\n".join(text), labels))
    return out


def fit(sample: list[tuple[str, str]]) -> dict | None:
    """Weights by maximum conditional likelihood: lines of good and of bad documents weigh the
    same together, those of mixed ones as their number among the sample says."""
    if len({label for _, label in sample}) < 2:
        return None
    x, _, at = line_features([t for t, _ in sample])
    full = with_neighbours(x, at)
    y = np.array([int(label == "1") for _, label in sample])
    groups = []  # features, where sequences begin, labels of lines, weight of a line
    for c in (0, 1):
        keep = np.flatnonzero(y == c)
        n = np.diff(at)[keep]
        to = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(at[:-1][keep] - to[:-1], n) + np.arange(to[-1])
        groups.append((full[index], to, np.full(len(index), c), 1.0 / len(index)))
    some = mixed_documents(sample, len(sample) * MIXED // 10)
    if some:
        x, _, to = line_features([t for t, _ in some])
        labels = np.array([v for _, own in some for v in own])
        if len(labels) == to[-1]:
            groups.append((with_neighbours(x, to), to, labels, MIXED / 10 / len(labels)))
    width = full.shape[1]

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, trans = p[:width], p[width:].reshape(2, 2)
        cost, grad = 5e-4 * float(p @ p), 1e-3 * p
        for f, to, label, weight in groups:
            s = f @ w
            emit = np.stack([np.zeros(len(s)), s], axis=1)
            prob, pairs, z = marginals(emit, trans, to)
            inner = np.ones(len(s), dtype=bool)
            inner[to[1:] - 1] = False
            k = np.flatnonzero(inner)
            own = np.zeros((2, 2))
            np.add.at(own, (label[k], label[k + 1]), 1)
            cost += weight * (z - s[label == 1].sum() - (own * trans).sum())
            grad[:width] += weight * (f.T @ (prob[:, 1] - label))
            grad[width:] += weight * (pairs - own).ravel()
        return cost, grad

    p = minimise(value, np.zeros(width + 4), 80)
    return {"w": p[:width], "trans": p[width:].reshape(2, 2)}


def line_marginals(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) by line, line lengths, where each text's lines begin."""
    x, size, at = line_features(texts)
    s = with_neighbours(x, at) @ model["w"]
    prob, _, _ = marginals(np.stack([np.zeros(len(s)), s], axis=1), model["trans"], at)
    return prob[:, 1], size, at


def document_scores(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    good, size, at = line_marginals(texts, model)
    weight = np.maximum(size, 1)
    return np.clip(np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1]), 0, 1)


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    model = fit(labelled_sample(docs, labels, "quality", 5, 0, TRAIN_PER_CLASS, TRAIN_CHARS))
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) of every row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(document_scores(texts_of(batch), model))], names=["doc_id", "score"])

    return map_batches(ids_and_texts(docs), run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects; all columns stay."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(document_scores(texts_of(batch), model) >= THRESHOLD))

    return map_batches(docs, run, schema)
