import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sextant.llm import quality
from sextant.llm.quality import fit, latent, quality_model, term_counts, votes, with_quality
from tests.llm.common import documents, words


def test_votes_against_a_loop():
    r = np.random.default_rng(1)
    known, labels = r.standard_normal((60, 5)).astype(np.float32), r.integers(0, 2, 60).astype(np.float32)
    known[30:] = known[:30]  # ties
    v = r.standard_normal((40, 5)).astype(np.float32)
    got = votes(v, known, labels, 7)
    for x, g in zip(v, got):
        c = x @ known.T
        near = sorted(range(60), key=lambda i: (-c[i], i))[:7]
        w = np.maximum(c[near], 0).astype(float)
        want = (w * labels[near]).sum() / w.sum() if w.sum() else np.nan
        assert np.isclose(g, want, atol=1e-5, equal_nan=True)


TEXTS = ["", None, "ab", "abc", "der der Der das", "ёлка ёлка 日本語 日本", "a  a\ta b" * 9, "x" * 400, " the cat the cat ", "word " * 300 + "end"]


def slow_counts(text):
    raw, out = (text or "").encode(), np.zeros(quality.WIDTH + 1)
    for x, y, z in zip(raw, raw[1:], raw[2:]):
        out[((x * 2654435761 + y * 2246822519 + z * 3266489917) & 0xFFFFFFFF) >> 21] += 1
    w = (text or "").lower().split()
    out[quality.WIDTH] = sum(a == b for a, b in zip(w, w[1:]))
    return out


def test_features_and_vectors_against_loops():
    texts = pa.array(TEXTS + [" ".join(words(k, 30)) for k in range(60)], pa.large_string())
    counts = term_counts(texts)
    want = np.array([slow_counts(t) for t in texts.to_pylist()])
    assert (counts == want).all()
    assert (term_counts(texts.slice(3, 4)) == want[3:7]).all()
    model = fit(texts, np.arange(70) % 2)
    idf = np.array([np.log((1 + 70) / (1 + sum(row[k] > 0 for row in want))) + 1 for k in range(quality.WIDTH + 1)])
    idf[quality.WIDTH] *= quality.REPEAT_WEIGHT
    assert np.allclose(model["idf"], idf, rtol=1e-5)
    x = np.log1p(want) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    axes = model["axes"].astype(float)
    value = np.linalg.svd(x, compute_uv=False)[: quality.DIMENSIONS]
    assert np.allclose(np.linalg.norm(x @ axes, axis=0)[:20], value[:20], rtol=1e-3)  # the leading directions
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-4)
    v = x @ axes
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    assert np.allclose(latent(texts, model["idf"], model["axes"]), v, atol=1e-4) and np.allclose(model["vectors"], v, atol=1e-4)


def test_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = with_quality(docs, quality_model(docs, fit)).join(held, "doc_id").select("quality", "keep").collect()
    clean = [r.keep for r in rows if r.quality == 1]
    assert np.mean(clean) >= 0.98 and np.mean([r.keep == bool(r.quality) for r in rows]) >= 0.9


def test_every_case_has_a_result(spark):
    good = [(i, " ".join(words(i, 60))) for i in range(30)]
    bad = [(100 + i, "$$$ ### " * (10 + i)) for i in range(30)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (1, None, 0), (2, 0, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_model(docs, labels)
    rows = [(1, None), (None, " ".join(words(3, 60))), (2, ""), (3, "ab"), (4, "$$$ ### " * 50_000), (5, " ".join(words(5, 60))), (5, " ".join(words(5, 60)))]
    odd = documents(spark, rows).withColumns({"Keep": F.lit(0), "label": F.lit(1), "QUALITY": F.lit(2), "Quality_Score": F.lit(3)})
    got = with_quality(odd, model)
    assert got.columns == [*(c for c in odd.columns if c.lower() not in ("keep", "quality_score")), "quality_score", "keep"]
    out = [(x.doc_id, x.quality_score is None, x.keep) for x in got.collect()]
    assert sorted(out, key=str) == sorted([(1, True, True), (None, False, True), (2, True, True), (3, True, True), (4, False, False), (5, False, True), (5, False, True)], key=str)
    assert with_quality(odd.limit(0), model).count() == 0
    none = quality_model(docs, labels.limit(0))
    assert none == {} and with_quality(odd, none).where("keep and quality_score is null").count() == len(rows)
    assert not latent(pa.array(["", None], pa.large_string()), model["idf"], model["axes"]).any()
