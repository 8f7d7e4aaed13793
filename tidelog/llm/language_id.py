"""Language identification: first the family, then the language within it.

One-versus-rest linear support vector machines over hashed character n-grams choose the
family; within a family, one-versus-one machines vote on the closely related languages,
ties going to the larger sum of margins.  Languages outside ``FAMILIES`` form a family
of their own.  Fitting uses at most ``TRAIN_PER_CLASS`` documents of each language, each
of at most ``TRAIN_CHARS`` characters.

Defined results: a text that is null or has no letter is ``und`` with score 0; without
usable labels everything is ``und``; repeated rows get one result each; votes and margins that
are equal go to the language that comes first; a text of any length is scored whole; only
doc_id and text are read for a prediction, so other columns' names don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, ids_and_texts, map_batches, read_table, texts_of
from .linear_chars import gram_rows, gram_sums
from .training import Rows, fit_linear, labelled_sample

TRAIN_PER_CLASS = 500
TRAIN_CHARS = 20_000
ORDERS = (1, 2, 3)
BITS = 15
SCALE = 30.0
#: Language to family, fixed values.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "af": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic", "nn": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "pt": "romance", "it": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "be": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic", "bs": "slavic", "sl": "slavic", "mk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic",
    "hi": "indic", "mr": "indic", "ne": "indic", "bn": "indic", "ur": "indic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
}


def fit(sample: list[tuple[str, str]]) -> dict | None:
    """sample: (text, language)."""
    sample = [(t, lang) for t, lang in sample if any(c.isalpha() for c in t)]
    if not sample:
        return None
    langs = np.array([lang for _, lang in sample])
    families = np.array([FAMILIES.get(lang, lang) for lang in langs])
    x = Rows(*gram_rows([t for t, _ in sample], ORDERS, BITS), 1 << BITS)
    x.values = x.values * SCALE

    def machine(rows: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, float]:
        w, b = fit_linear(x.take(rows), np.where(positive, 1.0, -1.0), 1e-4, "squared_hinge")
        return (w * SCALE).astype(np.float32), b

    everything = np.arange(len(langs))
    names = sorted(set(families))
    model: dict = {"families": names, "members": {f: sorted(set(langs[families == f])) for f in names}}
    model["family"] = [machine(everything, families == f) for f in names] if len(names) > 1 else []
    model["pairs"] = {}
    for f, members in model["members"].items():
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((langs == a) | (langs == b))
            model["pairs"][a, b] = machine(rows, langs[rows] == a)
    return model


def predict(texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray]:
    lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if model is None:
        return lang.tolist(), score
    # a text with upper and lower case is one with a letter; others are looked at in full
    ok = np.array([bool(t) and (t.lower() != t.upper() or any(c.isalpha() for c in t)) for t in texts], dtype=bool)
    rows = np.flatnonzero(ok)
    if not len(rows):
        return lang.tolist(), score
    some = [texts[i] for i in rows]
    squash = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -15, 15)))
    names = model["families"]
    if model["family"]:
        margin = gram_sums(some, [w for w, _ in model["family"]], ORDERS, BITS) + np.array([b for _, b in model["family"]])
        best = margin.argmax(axis=1)
        sure = squash(margin[np.arange(len(some)), best])
    else:
        best, sure = np.zeros(len(some), dtype=int), np.ones(len(some))
    for k, f in enumerate(names):
        members, mine = model["members"][f], np.flatnonzero(best == k)
        if not len(mine):
            continue
        if len(members) == 1:
            lang[rows[mine]], score[rows[mine]] = members[0], sure[mine]
            continue
        pairs = list(combinations(range(len(members)), 2))
        machines = [model["pairs"][members[a], members[b]] for a, b in pairs]
        margin = gram_sums([some[i] for i in mine], [w for w, _ in machines], ORDERS, BITS) + np.array([b for _, b in machines])
        votes, sums = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
        for j, (a, b) in enumerate(pairs):
            votes[:, a] += margin[:, j] >= 0
            votes[:, b] += margin[:, j] < 0
            sums[:, a] += np.tanh(margin[:, j])
            sums[:, b] -= np.tanh(margin[:, j])
        top = (votes + sums / (4 * len(members))).argmax(axis=1)
        lang[rows[mine]] = np.array(members, dtype=object)[top]
        score[rows[mine]] = sure[mine] * squash(sums[np.arange(len(mine)), top] / (len(members) - 1) * 2)
    return lang.tolist(), np.clip(score, 0, 1)


def train(docs: DataFrame) -> dict | None:
    marked = docs.select("doc_id", F.col("lang").alias("label"))
    return fit(labelled_sample(docs, marked, "label", 4, 2, TRAIN_PER_CLASS, TRAIN_CHARS))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = predict(texts_of(batch), model)
        return pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return map_batches(ids_and_texts(docs), run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
