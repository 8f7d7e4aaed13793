"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

The log ratio of an n-gram's smoothed frequencies in toxic and other texts scales the
n-gram's feature, and a regularised logistic model is fitted on the scaled features.  A
text is read in windows of ``WINDOW`` characters (each begins half a window after the
last), so that length doesn't dilute abuse.  Its score is logistic in three sums of the
n-grams' weights, the most toxic window's, the second most toxic one's, and the mean over
the text; how they count is fitted on documents that the weights have not seen, fold by
fold.  The sample holds both labels alike, so the log odds of the labels' true share are
added with a weight of ``PRIOR_WEIGHT``.  By cross-validation over the rows that may teach
(sf0.1), weights of 0, 0.25, 0.5 and 1 find 0.946, 0.934, 0.919 and 0.855 of toxic documents
and flag 0.048, 0.025, 0.012 and 0.007 of others; 0.25 gives up little of the first.
A word right after itself counts once, as repeated lines and words are no evidence each.

Fitting uses at most ``TRAIN_PER_CLASS`` documents of each label, each of at most
``TRAIN_CHARS`` characters.  Defined results: null text counts as empty and scores as a
text without n-grams; without usable labels all score 0.5; repeated rows get one result
each; of windows with equal weights one is the first and one the second; a text of any
length is read whole, in pieces whose windows join exactly; only doc_id and text are read, so
other columns, whatever their names, change nothing; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ids_and_texts, map_batches, read_table, texts_of
from .linear_chars import gram_rows
from .textvec import _word_hashes_of, folded, gram_index, pieces
from .training import Rows, fit_linear, labelled_sample

TRAIN_PER_CLASS = 600
TRAIN_CHARS = 20_000
ORDERS = (4, 6, 8)
BITS = 19
THRESHOLD = 0.5
WINDOW = 256
#: A multiple of half a window, less one for the space before a text.
PIECE = (1 << 18) - 1
SCALE = 100.0
FOLDS = 3
#: How far the rarity of toxic documents lowers the scores, 0 to 1.
PRIOR_WEIGHT = 0.25


def _gram_values(cp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The summed weight, by position, of the n-grams that begin there."""
    out = np.zeros(len(cp))
    for k in ORDERS:
        index = gram_index(cp, k, BITS)
        out[: len(index)] += table[index]
    return out


def window_statistics(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """By text: the largest, the second largest and the mean weight of a window's
    n-grams.  Windows are two neighbouring blocks of half a window; the last may be
    shorter.  A text's blocks are the same however it is cut for memory."""
    half = WINDOW // 2
    first, second = np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    last: dict[int, float] = {}
    for who, part, own in pieces(texts, size=PIECE, overlap=max(ORDERS)):
        cp, at = folded(part)
        value = _gram_values(cp, table)
        for k in range(1, max(ORDERS)):  # no n-gram runs over the end of its text
            tail = at[1:] - k
            value[tail[tail >= at[:-1]]] = 0.0
        word, begin, end = _word_hashes_of(cp)
        again = np.flatnonzero(word[1:] == word[:-1]) + 1  # a word right after itself counts once
        if len(again):
            edge = np.zeros(len(cp) + 1, dtype=np.int32)
            np.add.at(edge, begin[again] - 1, 1)
            np.add.at(edge, end[again] - 1, -1)
            value[np.cumsum(edge[:-1]) > 0] = 0.0
        sums = np.zeros(len(cp) + 1)
        np.cumsum(value, out=sums[1:])
        n = np.array(own, dtype=np.int64) + 1
        blocks = -(-n // half)
        to = np.concatenate([[0], np.cumsum(blocks)])
        start = np.repeat(at[:-1] - to[:-1] * half, blocks) + np.arange(to[-1]) * half
        end = np.minimum(start + half, np.repeat(at[:-1] + n, blocks))
        block = sums[end] - sums[start]
        pair = block.copy()
        inner = np.ones(len(block), dtype=bool)
        inner[to[1:] - 1] = False
        pair[:-1][inner[:-1]] += block[1:][inner[:-1]]
        for j, i in enumerate(who):
            mine = block[to[j] : to[j + 1]]
            both = pair[to[j] : to[j + 1]]
            if i in last:
                both = np.append(both, last[i] + mine[0])
            if len(texts[i] or "") > PIECE:
                last[i] = float(mine[-1])
            top = both.max()
            rest = np.delete(both, [both.argmax()])
            far = rest.max() if len(rest) else -np.inf
            if top > first[i]:
                second[i] = max(first[i], far)
                first[i] = top
            else:
                second[i] = max(second[i], top)
            total[i] += mine.sum()
            count[i] += own[j] + 1
    second = np.where(np.isfinite(second), second, first)
    return np.stack([first / WINDOW, second / WINDOW, total / np.maximum(count, 1)], axis=1)


def fit(sample: list[tuple[str, str]], share: float = 0.5) -> dict | None:
    """share: of toxic documents among all labelled ones; the sample holds both alike."""
    if len({label for _, label in sample}) < 2:
        return None
    columns, means, at = gram_rows([t for t, _ in sample], ORDERS, BITS)
    y = np.array([1.0 if label == "1" else -1.0 for _, label in sample])

    def table_of(some: np.ndarray) -> np.ndarray:
        """Weights of n-grams: naive Bayes ratio times fitted weight."""
        x = Rows(columns, means, at, 1 << BITS).take(some)
        seen = [np.bincount(x.columns[(y[some] == c)[x.row]], minlength=1 << BITS) + 1.0 for c in (1.0, -1.0)]
        ratio = np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum())
        x.values = (x.values * ratio[x.columns] * SCALE).astype(np.float32)
        w, _ = fit_linear(x, y[some], 1e-3)
        return (w * ratio * SCALE).astype(np.float32)

    # how windows' weights add up to a document's score: fitted on texts that the weights
    # have not seen, fold by fold
    rank = np.zeros(len(y), dtype=np.int64)
    for c in (1.0, -1.0):
        rank[y == c] = np.arange((y == c).sum())
    z = np.zeros((len(y), 3))
    for k in range(FOLDS):
        out = np.flatnonzero(rank % FOLDS == k)
        rest = np.flatnonzero(rank % FOLDS != k)
        if len(out) and len(set(y[rest])) == 2:
            z[out] = window_statistics([sample[i][0] for i in out], table_of(rest))
    mid, spread = z.mean(axis=0), z.std(axis=0) + 1e-9
    top = Rows(np.tile(np.arange(3), len(z)), ((z - mid) / spread).ravel(), np.arange(len(z) + 1) * 3, 3)
    v, b = fit_linear(top, y, 1e-4)
    return {"table": table_of(np.arange(len(y))), "v": v / spread, "b": b - float((v / spread) @ mid) + PRIOR_WEIGHT * float(np.log(share / (1 - share)))}


def document_scores(texts: list[str | None], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    m = window_statistics(texts, model["table"]) @ model["v"] + model["b"]
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0)).agg(F.avg("toxic").alias("share")).first()["share"]
    share = min(0.99, max(0.01, known if known is not None else 0.5))
    return fit(labelled_sample(docs, labels, "toxic", 5, 0, TRAIN_PER_CLASS, TRAIN_CHARS), share)


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
