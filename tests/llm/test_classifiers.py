"""Held-out accuracy of the classifiers, and that held-out labels are never read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import quality, toxicity
from sieveline.llm._common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def area(score, label):
    """Area under the curve: how often a random positive is above a random negative."""
    a, b = score[label == 1], score[label == 0]
    return float((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2)


@pytest.mark.parametrize("name,floor", [("quality", 0.9), ("toxic", 0.9)])
def test_held_out_rows(spark, tables, name, floor):
    docs, labels = tables
    score, held = (quality.quality_scores, fold("doc_id", 4) == 2) if name == "quality" else (toxicity.toxicity_scores, fold("doc_id", 3) == 1)
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    other = labels.withColumn(name, F.when(held, 1 - F.col(name)).otherwise(F.col(name)))
    assert {k: r.score for k, r in got.items()} == {r.doc_id: r.score for r in score(docs, other).collect()}
    known = [(got[r.doc_id].score, r[name]) for r in labels.where(held).collect() if r.doc_id in got and r[name] is not None]
    s, y = np.array(known).T
    assert len(s) > 50 and area(s, y) >= floor and all(r.held_out == (k in {q.doc_id for q in docs.where(held).select("doc_id").collect()}) for k, r in list(got.items())[:20])


def test_weights_undo_the_sampling():
    """Calibration on classes sampled at different rates gives the probabilities of the whole."""
    rng = np.random.default_rng(0)
    f = np.concatenate([rng.normal(1, 1, 9000), rng.normal(-1, 1, 1000)])
    y = np.concatenate([np.ones(9000), np.zeros(1000)])
    whole = quality.calibrate(f, y)
    some = np.concatenate([np.arange(0, 9000, 9), np.arange(9000, 10_000)])
    part = quality.calibrate(f[some], y[some], np.where(y[some] == 1, 9.0, 1.0))
    plain = quality.calibrate(f[some], y[some])
    assert abs(part[1] - whole[1]) < 0.3 < abs(plain[1] - whole[1])


def test_prior_of_unlabelled_scores():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.9):
        n = 40_000
        mixed = np.where(rng.random(n) < share, rng.normal(2, 1, n), rng.normal(-2, 1, n))
        got = quality.estimated_prior(quality.histogram(rng.normal(2, 1, 3000)), quality.histogram(mixed))
        assert abs(got - share) < 0.06
