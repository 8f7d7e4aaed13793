"""The stages one by one on real rows, and all of them on awkward and empty tables."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tidelog.llm import decontaminate, jaccard_join, quality_crf

from .conftest import prose

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_is_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    a, b, c, d, e = (f for _, f in corpus_pipeline.STAGES)
    good = a(spark, docs, SF).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    once = b(spark, good, SF).cache()
    groups = jaccard_join.links(good).collect()
    assert {r.doc_id for r in once.collect()} == {r.class_id for r in groups}
    clean = c(spark, once, SF).cache()
    leaks = {r.doc_id for r in decontaminate.contaminated(once, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect()} - leaks
    masked = d(spark, clean, SF).cache()
    assert masked.columns == docs.columns and masked.count() == clean.count()
    assert not any("password=" in (r.text or "") for r in masked.collect())
    assert {r.doc_id for r in e(spark, masked, SF).collect()} == {r.doc_id for r in clean.collect()}


def test_awkward_and_empty(spark, folder):
    out = corpus_pipeline.run(spark, f"{folder}/some").collect()
    texts = {r.doc_id for r in out}
    assert None in texts and len(out) > 5
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_quality_needs_labels(spark, awkward):
    assert quality_crf.fit([]) is None and list(quality_crf.document_scores(["a", None], None)) == [0.5, 0.5]


def test_decontamination_learns_from_every_passage(spark, monkeypatch):
    """The stage's latent space is the same whatever ids its rows have: no passage is drawn by one."""
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(9000)]
    spaces = []
    project = decontaminate.Index.project

    def kept(index, rows, space):
        spaces.append(space @ (space.T @ np.linspace(-1, 1, len(space))))  # of the space, whatever its basis
        project(index, rows, space)

    monkeypatch.setattr(decontaminate.Index, "project", kept)
    for first in (0, 70_000):
        frame = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        decontaminate.keep_clean(spark, frame, SF)
    assert len(spaces) == 2 and np.abs(spaces[0] - spaces[1]).max() <= 1e-3 * np.abs(spaces[0]).max()
