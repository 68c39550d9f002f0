import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import toxicity as tx
from sextant.llm.toxicity import fit, grams, ratios, scores, toxicity, toxicity_model
from tests.llm.common import documents, words


def slow_grams(text):
    c, out = [ord(x) for x in " " + " ".join(text.lower().split()) + " "], Counter()
    for n in tx.ORDERS:
        for i in range(len(c) - n + 1):
            h = c[i]
            for x in c[i + 1 : i + n]:
                h = (h * 0x01000193 + x) & 0xFFFFFFFF
            out[((h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF) >> (32 - tx.BITS)] += 1
    return out


@pytest.mark.parametrize("text", ["", " ", "a", "ab", "Aba  aba", "\tЁлка\n日本 🙂🙂 ", "x" * 500, "word " * 200, " ".join(words(1, 400))])
def test_grams_against_a_loop(text):
    g, n = grams(text)
    assert dict(zip(g.tolist(), n.tolist())) == slow_grams(text) and (np.diff(g.astype(int)) > 0).all()


def slow_shares(text):
    g = slow_grams(text)
    norm = max(1.0, math.sqrt(sum(n * n for n in g.values())))
    return {k: n * tx.LENGTH / norm for k, n in g.items()}


def test_ratios_and_scores_against_loops():
    many = [texts(i, i % 3 == 0) for i in range(30)] + ["", "a"]
    y = np.array([i % 3 == 0 for i in range(30)] + [0, 0]).astype(int)
    shares = [slow_shares(t) for t in many]
    rows = [grams(t) for t in many]
    row = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    got = ratios(np.concatenate([g for g, _ in rows]).astype(np.int64), np.concatenate([tx._shares(n) for _, n in rows]), y[row] == 1, y.astype(float))
    least = np.mean([v for s in shares for v in s.values()])
    for k in list(shares[0])[:200]:
        p, q = (sum(s.get(k, 0) for s, label in zip(shares, y) if label == c) for c in (1, 0))
        assert math.isclose(got[k], math.log((p + least) / y.sum()) - math.log((q + least) / (1 - y).sum()), abs_tol=1e-9)
    model = fit(pa.array(many, pa.large_string()), y)
    for t, s in zip(many, scores(many, model["weights"], float(model["bias"][0]))):
        z = sum(float(model["weights"][k]) * v for k, v in slow_shares(t).items()) + float(model["bias"][0])
        assert math.isclose(s, 1 / (1 + math.exp(-max(-60, min(60, z)))), abs_tol=1e-6)


def test_more_steps_lower_the_loss():
    many = [texts(i, i % 3 == 0) for i in range(60)]
    y = np.array([i % 3 == 0 for i in range(60)])
    loss = []
    for steps in (1, 10, 40, 400):
        m = fit(pa.array(many, pa.large_string()), y.astype(int), steps=steps, penalty=0.0)
        s = scores(many, m["weights"], float(m["bias"][0]))
        loss.append(-np.log(s[y]).mean() - np.log(1 - s[~y]).mean())
    assert loss == sorted(loss, reverse=True) and ((s >= 0.5) == y).all()


def test_sparse_products_against_dense_ones():
    r = np.random.default_rng(3)
    x = np.where(r.random((9, 13)) < 0.3, r.random((9, 13)), 0)
    x[4], x[:, 6] = 0, 0
    t = tx._Table(*np.nonzero(x), x[np.nonzero(x)], x.shape)
    assert np.allclose(t.times(np.arange(13.0)), x @ np.arange(13.0), rtol=1e-5) and np.allclose(t.times(np.arange(9.0), True), x.T @ np.arange(9.0), rtol=1e-5)


def texts(seed, bad):
    r = np.random.default_rng(seed)
    w = words(seed, int(r.integers(20, 300)))
    for k in range(0, len(w), 15 if bad else 10**9):
        if bad:
            w[k] = ["vileling", "scumbert"][k % 2]
    return " ".join(w)


def test_held_out(spark):
    train = [texts(i, i % 3 == 0) for i in range(300)]
    model = fit(pa.array(train, pa.large_string()), np.array([i % 3 == 0 for i in range(300)]).astype(int))
    s = scores([texts(1000 + i, i % 3 == 0) for i in range(150)], model["weights"], float(model["bias"][0]))
    y = np.array([i % 3 == 0 for i in range(150)])
    assert (s[y] >= 0.5).mean() >= 0.95 and (s[~y] >= 0.5).mean() <= 0.02


def test_every_case_has_a_result(spark):
    docs = documents(spark, [(i, texts(i, i % 2 == 0)) for i in range(80)])
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity_model(docs, labels)
    rows = [(1, None), (2, " \n "), (None, texts(2001, False)), (3, texts(2002, True)), (3, texts(2002, True)), (4, "vileling scumbert " * 30_000), (5, "a")]
    odd = documents(spark, rows).withColumns({"toxic": F.lit("x"), "toxic_score": F.lit(1)})
    got = toxicity(odd, model)
    assert got.columns == ["doc_id", "toxic_score", "toxic"]
    by = sorted((x.doc_id or 0, x.toxic, x.toxic_score == 0) for x in got.collect())
    assert by == [(0, False, False), (1, False, True), (2, False, True), (3, True, False), (3, True, False), (4, True, False), (5, by[-1][1], False)]
    assert toxicity(odd.limit(0), model).count() == 0
    assert toxicity(odd, toxicity_model(docs, labels.limit(0))).where("toxic or toxic_score is not null").count() == 0
    one = toxicity_model(docs, labels.where("toxic = 0"))
    assert toxicity(odd, one).where("toxic").count() == 0
