from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.operators import ann, blocks, clusters, compare, components, context, retrieval

PASSAGE = "passage_idx long, source_file string, char_offset int, vector array<float>"


def unit(n, d=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, files=3, offsets=4):
    return spark.createDataFrame([(i, f"f{i % files}", i % offsets, v.tolist()) for i, v in enumerate(x)], PASSAGE)


def asked(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, vector array<float>")


def pairs(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


def model(x, q, k, dedup, files=3, offsets=4):
    out = []
    for n, y in enumerate(q):
        s = np.round(x.astype(float) @ y.astype(float), 6)
        seen, rank = set(), 0
        for i in sorted(range(len(x)), key=lambda i: (-s[i], i)):
            place = (i % files, i % offsets)
            if rank < k and not (dedup and place in seen):
                seen.add(place)
                rank += 1
                out.append((n, rank, i, s[i]))
    return out


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("broadcast_bytes", [blocks.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("k", [0, 1, 7, 500])
def test_best_of(spark, dedup, broadcast_bytes, k, monkeypatch):
    monkeypatch.setattr(blocks, "STRIP_BYTES", 40 * 16 * 8)
    x = unit(150)
    x[50:60] = x[40:50]  # ties
    got = blocks.best_of(table(spark, x).repartition(5), asked(spark, x[:9]), k, dedup, broadcast_bytes=broadcast_bytes).collect()
    want = model(x, x[:9], k, dedup)
    assert sorted(map(tuple, got)) == sorted(want)


def test_null_vectors_empty_sides_and_sizes_that_differ(spark):
    x = unit(5)
    rows = table(spark, x).union(spark.createDataFrame([(9, "f", 0, None)], PASSAGE))
    assert blocks.best_of(rows, asked(spark, x[:1]), 10, False).count() == 5
    assert blocks.best_of(rows.limit(0), asked(spark, x), 3, True).count() == 0
    assert blocks.best_of(rows, asked(spark, x).limit(0), 3, True).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        blocks.best_of(rows, asked(spark, unit(1, 8)), 3, False).collect()


@pytest.mark.parametrize("small", ["both", "left", "right", "none"])
@pytest.mark.parametrize("strip", [7, None])
def test_pairs_and_best(spark, strip, small):
    x, y = unit(60, 6), unit(40, 6, 1)
    if small == "left":
        x, y = y, x
    most = {"both": 1 << 20, "none": 0}.get(small, 40 * 6 * 8)
    how = {"strip_rows": strip, "broadcast_bytes": most}
    s = np.round(x.astype(float) @ x.astype(float).T, 6)
    got = sorted((r.a, r.b, r.score) for r in blocks.pairs_over(pairs(spark, x), None, 0.5, **how).collect())
    assert got == [(i, j, s[i, j]) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= 0.5]
    s = np.round(x.astype(float) @ y.astype(float).T, 6)
    assert {(r.a, r.b) for r in blocks.pairs_over(pairs(spark, x), pairs(spark, y), 0.5, **how).collect()} == set(zip(*map(list, np.nonzero(s >= 0.5))))
    assert {r.a: r.score for r in blocks.best_over(pairs(spark, x), pairs(spark, y), **how).collect()} == dict(enumerate(s.max(1)))
    assert {r.score for r in blocks.best_over(pairs(spark, x), pairs(spark, y).limit(0), **how).collect()} == {float("-inf")}
    assert blocks.pairs_over(pairs(spark, x).limit(0), None, 0.5, **how).count() == 0
    assert blocks.best_over(pairs(spark, x).limit(0), pairs(spark, y)).count() == 0


def test_components(spark):
    r = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1100)]
    edges = spark.createDataFrame([*e, (5, None), (7, 7)], "a long, b long")
    one, many = (dict(map(tuple, components.connected_components(edges, one_task_edges=n).collect())) for n in (10**6, 0))
    assert one == many and one[1100] == 1000
    assert all(one[a] == one[b] <= min(a, b) for a, b in e)
    assert components.connected_components(edges.limit(0)).count() == 0


def test_single_linkage_goes_by_chains(spark):
    angle = np.deg2rad([0, 15, 30, 90])
    x = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    got = {r.id: r.cluster_id for r in clusters.clusters(pairs(spark, x), 0.95).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    near = clusters.near_duplicates(pairs(spark, x), 0.95).collect()
    assert [(r.cluster_id, r.size, list(r.members)) for r in near] == [(0, 3, [0, 1, 2])]
    assert near[0].mean_cosine == pytest.approx((2 * np.cos(angle[1]) + np.cos(angle[2])) / 3, abs=1e-6)


def test_centroid_of_none_and_of_opposites(spark):
    assert clusters.centroid(pairs(spark, unit(3)).limit(0)).count() == 0
    both = clusters.centroid(pairs(spark, np.array([[1.0, 0.0], [-1.0, 0.0]]))).first().vector
    assert both == [0.0, 0.0]


def test_comparison_laws(spark):
    a, b = pairs(spark, unit(30, 8)), pairs(spark, unit(20, 8, 1))
    own = compare.compare(a, a).first()
    assert own.centroid_cosine == own.overlap == 1.0
    ab, ba = compare.compare(a, b, 10).first(), compare.compare(b, a, 10).first()
    assert (ab.overlap, ab.coverage_ab) == (ba.overlap, ba.coverage_ba)
    assert compare.unique(a, a, 0.99).count() == 0 and compare.unique(a, b.limit(0)).count() == 30 and compare.unique(a.limit(0), b).count() == 0
    assert compare.intersection(a, a, 0.99).count() >= 30
    assert {r.side for r in compare.corpus_diff(a, a).collect()} == {"unchanged"}
    assert compare.merged(a, b, 0.92).count() <= 50 and compare.merged(a, a).where("side = 1").count() == 0
    assert sorted(r.passage_idx for r in compare.merged(a, b, 1.01).collect()) == list(range(50))
    empty = compare.compare(a, b.limit(0)).first()
    assert (empty.centroid_cosine, empty.overlap) == (0.0, 0.0)


def test_guards():
    meta = lambda dim, rev, band="base": {"bands": {band: {"dim": dim}}, "encoder": {"revision": rev}}
    assert compare.require_pair(meta(8, "a"), meta(8, "a"))
    assert not compare.require_pair(meta(8, "a"), meta(8, "b"), strict=False)
    for x, y in ((meta(8, "a"), meta(8, "b")), (meta(8, "a"), meta(9, "a")), (meta(8, "a", "optimised"), meta(8, "a"))):
        with pytest.raises(compare.Mismatch):
            compare.require_pair(x, y)
    with pytest.raises(ValueError):
        compare.compose()


@pytest.fixture(scope="module")
def clustered():
    x = unit(6000, 32, 5)
    x = x[np.random.default_rng(1).integers(0, 300, 6000)] + 0.3 * x
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "index")
    ann.save(ann.build(table(spark, clustered, 6000, 6000)), path)
    return ann.load(spark, path)


def test_the_index_finds_the_nearest_in_few_cells(spark, clustered, index):
    assert ann.should_index(6000) and not ann.should_index(5000)
    assert index.rows.count() == 6000 and index.probes < 0.1 * len(index.centres) and index.recall >= ann.RECALL
    n, found = ann.recall(index, asked(spark, clustered[::50])).agg(F.sum("n_exact"), F.sum("n_found")).first()
    assert n == 1200 and found >= 0.95 * n
    assert ann.search(index, asked(spark, clustered).limit(0), 10).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        ann.search(index, asked(spark, unit(1, 8)), 3).collect()


@pytest.mark.parametrize("dedup", [False, True])
def test_what_a_search_finds_depends_neither_on_other_queries_nor_on_the_way(spark, clustered, index, dedup, monkeypatch):
    q = asked(spark, clustered[:12])
    want = sorted(map(tuple, ann.search(index, q, 10, dedup).collect()))
    alone = [r for i in (0, 7) for r in map(tuple, ann.search(index, q.where(F.col("query_id") == i), 10, dedup).collect())]
    assert sorted(alone) == [r for r in want if r[0] in (0, 7)]
    monkeypatch.setattr(blocks, "STRIP_BYTES", 5 * 8 * 32)
    assert sorted(map(tuple, ann.search(index, q, 10, dedup, broadcast_bytes=0).collect())) == want
    cells = (clustered[:12].astype(float) @ index.centres.T).argsort(1)[:, ::-1][:, : index.probes]
    own = {r.passage_idx: r.cell for r in index.rows.select("passage_idx", "cell").collect()}
    assert all(own[r[2]] in cells[r[0]] for r in want)


def test_the_index_of_vectors_that_lie_any_way_looks_at_more_cells(spark):
    index = ann.build(table(spark, unit(900, 16, 9)))
    got = ann.recall(index, asked(spark, unit(900, 16, 9)[::30])).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert got >= 0.9 and 3 < index.probes <= len(index.centres)
    none = ann.build(table(spark, unit(3)).limit(0))
    assert ann.search(none, asked(spark, unit(2)), 3).count() == 0


def test_sums_of_vectors_against_numpy(spark):
    x = unit(90, 5)
    rows = spark.createDataFrame([(i % 4, v.tolist()) for i, v in enumerate(x)] + [(1, None), (9, None)], "g int, vector array<float>").repartition(6)
    got = {r.g: (r.sums, r.own, r.n) for r in clusters.vector_sums(rows, "g").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for g, (sums, own, n) in got.items():
        mine = x[g::4].astype(float)
        assert np.allclose(sums, mine.sum(0)) and np.isclose(own, (mine**2).sum()) and n == len(mine)


def cited(spark, texts):
    from sextant.functions.text import content_hash, passage_id

    rows = spark.createDataFrame([(i, f"f{i}", 0, len(t), t, v.tolist()) for i, (t, v) in enumerate(zip(texts, unit(len(texts))))], "passage_idx long, source_file string, char_offset int, char_length int, t string, vector array<float>")
    return rows.select("passage_idx", "source_file", "char_offset", "char_length", content_hash("t").alias("content_hash"), passage_id("source_file", "char_offset", "char_length").alias("passage_id"), "vector")


def test_drift_and_confidence(spark):
    rows = cited(spark, ["same", "changed", "gone", "grown"])
    now = spark.createDataFrame([("f0", "same"), ("f1", "chanGed"), ("f3", "grown and more")], "source_file string, text string")
    got = {r.source_file: (r.drift_status, r.text) for r in retrieval.verified(rows, now).collect()}
    assert got == {"f0": ("verified", "same"), "f1": ("drifted", ""), "f2": ("missing", ""), "f3": ("verified", "grown")}
    assert {r.drift_status: r.n for r in retrieval.drift_counts(retrieval.drift_report(rows, now)).collect()} == {"verified": 2, "drifted": 1, "missing": 1}
    hits, metrics = retrieval.evidence(rows, now, asked(spark, unit(1)), 1)
    m = metrics.first()
    assert (m.n_hits, m.top1_top2_gap, m.source_diversity) == (1, 1.0, 1.0)
    none = retrieval.evidence(rows.limit(0), now, asked(spark, unit(2)), 5)[1].collect()
    assert {(r.n_hits, r.top1_score, r.drift_fraction) for r in none} == {(0, 0.0, 0.0)}
    for bad in (retrieval.locate, retrieval.neighbors):
        with pytest.raises(IndexError):
            bad(rows, 99)
    assert retrieval.neighbors(rows, 2, 99).count() == 3
    some = rows.select("passage_idx").where("passage_idx in (1, 3)").union(spark.createDataFrame([(77,)], "passage_idx long"))
    assert sorted(r.passage_idx for r in retrieval.locate(rows, some).collect()) == [1, 3]
    many = sorted(tuple(r) for r in retrieval.neighbors(rows, some, 2).collect())
    assert many == [(q, *r) for q in (1, 3) for r in sorted(map(tuple, retrieval.neighbors(rows, q, 2).collect()))]


def test_verified_against_slices_and_pins(spark):
    text = "ab\u00e9 \U0001f642 and so on\n" * 40
    cuts = [(0, 5), (3, 4), (100, 7), (500, 900), (9999, 3)]
    rows = spark.createDataFrame([(i, "f", a, n, "sha256:" + sha256(text[a : a + n].encode()).hexdigest(), str(i)) for i, (a, n) in enumerate(cuts)], "passage_idx long, source_file string, char_offset int, char_length int, content_hash string, passage_id string")
    now = spark.createDataFrame([("f", text)], "source_file string, text string")
    got = retrieval.verified(rows, now).orderBy("passage_idx").collect()
    assert [(r.drift_status, r.text) for r in got] == [("verified", text[a : a + n]) for a, n in cuts]
    other = retrieval.verified(rows, now.withColumn("drifted", F.lit(True)))
    assert {(r.drift_status, r.text) for r in other.collect()} == {("drifted", "")} and other.columns == [*rows.columns, "drift_status", "text"]


@pytest.mark.parametrize("mode,top,drift,held", [("augment", 0.1, 0.4, True), ("augment", 0.2, 0.0, True), ("augment", 0.65, 0.0, False), ("augment", 0.4, 0.6, True), ("knowledge", 0.2, 0.9, False), ("knowledge", 0.1, 0.0, True), ("constrain", 0.0, 1.0, False)])
def test_gate(spark, mode, top, drift, held):
    assert spark.range(1).select(context.suppressed(F.lit(mode), F.lit(top), F.lit(drift))).first()[0] == held


def test_context_keeps_the_first_block_and_a_prefix(spark):
    rows = [(0, r, 0.9 - r / 10, f"f{r}", 0, n, "verified", "x" * n) for r, n in ((1, 500), (2, 50), (3, 900), (4, 10))] + [(0, 5, 0.1, "f5", 0, 3, "missing", "")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, score double, source_file string, char_offset int, char_length int, drift_status string, text string")
    assert [r.rank for r in context.rendered(hits, 700).orderBy("rank").collect()] == [1, 2]
    assert [r.rank for r in context.rendered(hits, 10).collect()] == [1]
    metrics = retrieval.with_all_queries(retrieval.confidence(hits), spark.createDataFrame([(0,), (1,)], "query_id long"))
    questions = spark.createDataFrame([(0, "What is MVE?"), (1, "Nothing")], "query_id long, question string")
    got = {r.query_id: r for r in context.contexts(hits, metrics, questions, budget_chars=700).collect()}
    assert got[0].missing_names == ["MVE"] and got[0].n_passages == 2 and "`MVE`" in got[0].context and "score=0.800" in got[0].context
    assert got[1].suppressed and got[1].n_passages == 0
    blocks_ = context.question_blocks(hits, metrics, questions, "constrain").orderBy("query_id").collect()
    assert "missing=MVE" in blocks_[0].block and "no passage found" in blocks_[1].block and blocks_[0].drifted


def test_plans_push_filters_and_keep_relational_work_off_python(spark, sf_dir):
    from sextant import queries as q

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for f in (q.profile, q.drift_report, q.delta_buckets, q.manifest_delta, q.memory_decay, q.memory_gc, q.approach_aggregate, q.stratified_sample, q.summary_structure):
        text = plan(f(spark, sf_dir))
        assert not any(x in text for x in ("InArrow", "InPandas", "PythonUDF", "BatchEvalPython"))
    assert "ReadSchema: struct<label:" in plan(q.profile(spark, sf_dir))
    assert "WindowGroupLimit" in plan(q.stratified_sample(spark, sf_dir)) and "TakeOrderedAndProject" in plan(q.memory_gc(spark, sf_dir))
