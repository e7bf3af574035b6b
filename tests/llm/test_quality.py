import os
import random

import numpy as np
import pytest

from textquarry.llm import quality as Q
from tests.llm.conftest import DOCS, words


def _labelled(n=300, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, rng.randrange(5, 200), 3000)
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "%%%" for x in w] if kind == 1 else [w[0]] * len(w)
        rows.append((i, " ".join(w).capitalize() + ".", "en", "s", 0))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_posterior_is_the_gaussian_one():
    rng = np.random.default_rng(1)
    d = len(Q.NAMES)
    x = {y: rng.normal(y, 1 + y, (500, d)) for y in (0, 1)}
    model = Q.fit({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()}, pooled=0.0, ridge=0.1)
    point = rng.normal(0.5, 1, (4, d))
    logs = []
    pooled = sum(np.cov(x[y].T, ddof=1) * (len(x[y]) - 1) for y in (0, 1)) / 998
    scale = np.sqrt(np.diag(pooled))
    for y in (0, 1):
        w = d / (d + 500)
        cov = ((1 - w) * np.cov(x[y].T, ddof=1) + w * pooled) / np.outer(scale, scale)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / d * np.eye(d)
        z = point / scale - x[y].mean(0) / scale
        logs.append(-0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)) + np.log(0.5))
    assert np.allclose(Q.posterior(model, point), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-9)


def test_held_out_accuracy_and_edges(spark, table):
    rows, labels = _labelled()
    table("labels", labels + [(5, None, 0)], "doc_id long, quality int, toxic int")
    path = table("documents", rows + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "\U0001f600" * 9, "en", "s", 0), (3, rows[3][1], "de", "t", 1)], DOCS)
    out = Q.op6_quality(spark, path).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1


def test_without_labels_or_documents(spark, table):
    table("labels", [], "doc_id long, quality int, toxic int")
    assert [r.score for r in Q.op6_quality(spark, table("documents", [(1, "a", "en", "s", 1)], DOCS)).collect()] == [0.0]
    assert Q.op6_quality(spark, table("documents", [], DOCS)).count() == 0


def test_steps_and_very_long_texts():
    rng = random.Random(8)
    text = " ".join(rng.choice(["Ab", "cde!", "fgh", "%x", "ij\n", "1", "é|"]) for _ in range(3000)) + "\n\n end."
    assert np.allclose(Q.statistics(text), Q.statistics(text, step=17), atol=1e-12)
    long = Q.statistics("word word " * 1_000_000)
    assert len(long) == len(Q.NAMES) and np.isfinite(long).all()


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a b", [1.0], 5)], "doc_id long, text string, x array<double>, score int")
    assert Q.described(docs).collect()[0].x == Q.statistics("a b")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_held_out_labels_of_the_test_tables(spark):
    path = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in Q.op6_quality(spark, path).collect() if r.held_out}
    held = [(r.quality, out[r.doc_id].predicted) for r in spark.read.parquet(f"{path}/labels.parquet").where("quality is not null").collect() if r.doc_id in out]
    for y in (0, 1):
        own = [p == y for t, p in held if t == y]
        assert len(own) >= 5 and np.mean(own) >= 0.9
