"""Bounded samples of labelled rows, and the sparse linear solver that fits on them."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, ids_and_texts, small_batches


def documents_sample(docs: DataFrame, most: int, max_chars: int) -> list[str]:
    """Texts of at most ``most`` documents of 1 to ``max_chars`` characters, chosen by a hash
    of the id.  Ids are drawn from the id column alone; texts are joined to those drawn, and
    the least of those that share an id counts, so at most ``most`` texts reach the driver."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null")
    share = min(1.0, 8 * most / max(1, docs.count()))
    texts = ids_and_texts(docs).where(f"length(text) between 1 and {max_chars}")
    while True:
        drawn = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().orderBy(F.xxhash64("_id"), "_id").limit(2 * most)
        found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"))  # 2 * most ids
        rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        if len(rows) >= most // 2 or share >= 1.0:
            return [r["text"] for r in rows]
        share = min(1.0, share * 8)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, per_class: int, max_chars: int, most_labels: int = 1000
) -> list[tuple[str, str]]:
    """(text, label) of at most ``per_class`` documents of each label, chosen by a hash
    of the id among those outside the held-out fold and of at most ``max_chars``
    characters.  Both bounds hold for fitting only; scoring sees whole texts of all rows.
    More than ``most_labels`` labels are an error: none is left out silently.
    Rows whose id, label or text is null teach nothing; of repeated ids one counts, with the
    least of its labels and texts, chosen before anything reaches the driver."""
    small_batches(docs.sparkSession)
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("string").alias("label"))
        .where("_id is not null and label is not null")
        .where(fold(F.col("_id"), folds) != held_out)
        .groupBy("_id")
        .agg(F.min("label").alias("label"))
    )
    classes = sorted(r[0] for r in marked.select("label").distinct().limit(most_labels + 1).collect())
    if len(classes) > most_labels:
        raise ValueError(f"more than {most_labels} labels to learn")
    if not classes:
        return []
    short = ids_and_texts(docs).where((fold(F.col("doc_id"), folds) != held_out) & (F.length("text") <= max_chars))
    draw = 2 * per_class
    while True:  # a label whose drawn documents are mostly too long or missing is drawn from again
        chosen = None
        for label in classes:
            some = marked.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(draw)
            chosen = some if chosen is None else chosen.unionByName(some)
        drawn = {r[0]: r[1] for r in chosen.groupBy("label").count().collect()}
        found = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
        place = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
        rows = found.withColumn("place", place).where(F.col("place") <= per_class).drop("place").collect()
        have = Counter(r["label"] for r in rows)
        if all(have[c] >= per_class or drawn.get(c, 0) < draw for c in classes):
            return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
        draw *= 8


class Rows:
    """Sparse rows (CSR) with the two products that a linear solver needs."""

    def __init__(self, columns: np.ndarray, values: np.ndarray, at: np.ndarray, width: int):
        self.columns, self.values, self.at, self.width = columns.astype(np.int32), values.astype(np.float32), at, width
        self.row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * w[self.columns], minlength=len(self.at) - 1)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=self.values * g[self.row], minlength=self.width)

    def take(self, keep: np.ndarray) -> "Rows":
        n = np.diff(self.at)[keep]
        at = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=at[1:])
        index = np.repeat(self.at[:-1][keep] - at[:-1], n) + np.arange(at[-1])
        return Rows(self.columns[index], self.values[index], at, self.width)


def fit_linear(x: Rows, y: np.ndarray, penalty: float, loss: str = "logistic", steps: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised linear model, y in {-1, 1}, both classes
    weighing the same.  ``loss`` is "logistic" or "squared_hinge" (a linear support
    vector machine); L-BFGS with a backtracking line search."""
    pos = y > 0
    weight = np.where(pos, 0.5 / max(1, pos.sum()), 0.5 / max(1, (~pos).sum()))

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        m = y * (x.dot(w) + b)
        if loss == "logistic":
            cost = np.logaddexp(0, -m)
            slope = -1 / (1 + np.exp(np.clip(m, -60, 60)))
        else:
            gap = np.maximum(0, 1 - m)
            cost, slope = gap * gap, -2 * gap
        g = weight * slope * y
        return float(weight @ cost + 0.5 * penalty * w @ w), np.append(x.back(g) + penalty * w, g.sum())

    p = minimise(value, np.zeros(x.width + 1), steps)
    return p[:-1], float(p[-1])


def minimise(value, p: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS; value(p) gives the cost and its gradient."""
    f, g = value(p)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d = g.copy()
        back = []
        for s, t, r in reversed(pairs):
            a = r * (s @ d)
            d -= a * t
            back.append(a)
        if pairs:
            s, t, _ = pairs[-1]
            d *= (s @ t) / (t @ t)
        else:
            d /= max(1.0, np.sqrt(g @ g))
        for (s, t, r), a in zip(pairs, reversed(back), strict=True):
            d += s * (a - r * (t @ d))
        slope, step = -(g @ d), 1.0
        if slope >= 0:
            break
        for _ in range(25):
            q = p - step * d
            f2, g2 = value(q)
            if f2 <= f + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, t = q - p, g2 - g
        if s @ t > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, t, 1 / (s @ t))]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        p, f, g = q, f2, g2
        if done:
            break
    return p
