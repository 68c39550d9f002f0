"""What must not grow faster than the tables: rows that tasks send on, pairs that are written, texts that are held."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import blocks, clusters, compare, context, evaluation, retrieval
from tests.test_search import asked, model, pairs, table, unit


def arrow(x, files=3, offsets=4):
    vectors = pa.array([v.tolist() for v in x], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), vectors, pa.array([f"f{i % files}" for i in range(len(x))]), pa.array([i % offsets for i in range(len(x))])], ["passage_idx", "vector", "source_file", "char_offset"])


@pytest.mark.parametrize("dedup", [False, True])
@pytest.mark.parametrize("scale", [1, 1e25])
def test_a_task_sends_no_more_than_the_best_of_each_query(dedup, scale):
    x = unit(3000)
    x[700:710] = x[40:50]  # ties
    x = x.astype(np.float64) * np.sqrt(scale) if scale > 1 else x
    top = blocks.Leaders(np.arange(300), x[:300], 7, dedup)
    batch = arrow(x) if scale == 1 else pa.RecordBatch.from_arrays([arrow(x).column(0), pa.array(list(x), pa.list_(pa.float64())), *arrow(x).columns[2:]], arrow(x).schema.names)
    for lo in range(0, 3000, 1300):
        top.see(batch.slice(lo, 1300))
    got = [(int(q), int(p), float(s)) for b in top.batches() for q, p, s in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy())]
    want = [(q, p, s) for q, _, p, s in model(x, x[:300], 7, dedup)]
    assert len(got) == 300 * 7
    assert sorted((q, p) for q, p, _ in got) == sorted((q, p) for q, p, _ in want)


@pytest.mark.parametrize("dedup", [False, True])
def test_passages_of_one_vector_are_scored_once(spark, dedup, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_STRIP", 200)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    x = np.concatenate([unit(20)] * 4)
    met = []
    meet = blocks._meet
    monkeypatch.setattr(blocks, "_meet", lambda rows, *a: met.append(rows.count()) or meet(rows, *a))
    got = blocks.best_of(table(spark, x, 80, 80), asked(spark, x[:9]), 6, dedup).collect()
    assert sorted(map(tuple, got)) == sorted(model(x, x[:9], 6, dedup, 80, 80)) and met == [20]


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_copies_are_found_by_their_bytes(spark, kind, monkeypatch):
    """Comparing arrays of floats goes through all their numbers for each comparison of a sort."""
    from sextant import scratch

    monkeypatch.setattr(blocks, "LEAST_STRIP", 0)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    plans, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or written(df, name))
    x = np.concatenate([np.round(unit(20) * 9)] * 4)
    x[::20, 0], x[20::20, 0] = 0.0, -0.0  # the same number
    rows = table(spark, x, 80, 80).withColumn("vector", F.col("vector").cast(f"array<{kind}>")).repartition(3)
    got = blocks.best_of(rows, asked(spark, x[:9]), 6, False).collect()
    assert sorted(map(tuple, got)) == sorted(model(x, x[:9], 6, False, 80, 80))
    assert len(plans) == 2 and "row_number" in plans[1] and "normalize" not in plans[1].lower()


def test_bytes_of_vectors_are_read_again():
    x = pa.array([[0.5, None], [1.5, -0.0], [], [2.0, 3.0, 4.0]], pa.list_(pa.float32())).slice(1)
    keys = blocks._bits(x)
    assert blocks._unbits(keys, np.float32).to_pylist() == x.to_pylist() and blocks._unbits(keys.slice(1), np.float32).to_pylist() == [[], [2.0, 3.0, 4.0]]
    assert np.isnan(blocks._unbits(blocks._bits(pa.array([[0.5, None]], pa.list_(pa.float64()))), np.float64).to_pylist()[0][1])
    assert blocks._unbits(blocks._bits(x.slice(3)), np.float32).to_pylist() == []


def test_nothing_large_is_gathered(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_gathered", lambda df: pytest.fail("sent to the driver"))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 1000)
    x, y = unit(40), unit(50, seed=1)
    want = np.round(x.astype(float) @ y.astype(float).T, 6).max(1)
    assert {r.a: r.score for r in blocks.best_over(pairs(spark, x), pairs(spark, y)).collect()} == dict(enumerate(want))
    assert blocks.BROADCAST_BYTES < 16 << 20 and blocks.pairs_over(pairs(spark, x), None, 0.5).count() > 0


def test_the_smaller_side_is_gathered(spark, monkeypatch):
    sizes, gathered = [], blocks._gathered
    monkeypatch.setattr(blocks, "_gathered", lambda df: sizes.append(df.count()) or gathered(df))
    x, y = unit(4), unit(50, seed=1)
    want = np.round(x.astype(float) @ y.astype(float).T, 6)
    assert {r.a: r.score for r in blocks.best_over(pairs(spark, x), pairs(spark, y)).collect()} == dict(enumerate(want.max(1)))
    assert blocks.pairs_over(pairs(spark, x), pairs(spark, y), 0.3).count() == (want >= 0.3).sum() and sizes == [4, 4]


@pytest.mark.parametrize("one", [False, True])
@pytest.mark.parametrize("rows", [50_000, 615_384, 2_500_000])
def test_a_cell_takes_no_longer_as_the_sides_grow(rows, one):
    n, m = blocks._cut(((rows, rows * 512),) * 2, one, None)
    assert (rows / n) * (rows / m) <= 1 << 31 and rows * 512 / min(n, m) <= blocks.STRIP_BYTES


def test_a_bound_of_single_precision_is_not_above():
    for x in (np.concatenate([unit(9).astype(np.float64).ravel(), [0.0, -np.inf, np.inf, 1e300, -1e300, 1e-300]]), np.float64(0.35)):
        low = blocks._below(x, np.dtype(np.float32))
        assert low.dtype == np.float32 and (low.astype(np.float64) <= x).all() and blocks._below(x, np.dtype(np.float64)) is x


@pytest.mark.parametrize("copies", [4, 6])
def test_copies_are_ranked_in_tasks_of_as_many_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_STRIP", 200)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    counts, ranked = [], blocks.ranked
    monkeypatch.setattr(blocks, "ranked", lambda found, k, dedup, count=0: counts.append((found.count(), count)) or ranked(found, k, dedup, count))
    x = np.concatenate([unit(20)] * copies)
    got = blocks.best_of(table(spark, x, len(x), len(x)), asked(spark, x[:9]), 6, False).collect()
    assert sorted(map(tuple, got)) == sorted(model(x, x[:9], 6, False, len(x), len(x)))
    assert counts[1] == (9 * 6 * copies,) * 2


def test_blocks_are_not_sent_where_their_sizes_do(spark):
    hits = spark.createDataFrame([(1, r, 0.5, r, "f", 0, 9, "verified", "x" * r) for r in (1, 2, 3)], "query_id long, rank int, score double, passage_idx long, source_file string, char_offset int, char_length int, drift_status string, text string")
    rows = context.rendered(hits)
    assert rows.where("n_chars <> length(block)").isEmpty() and rows.count() == 3
    plan = rows.select("query_id", "rank", "n_chars")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "AS block" not in plan


@pytest.mark.parametrize("strip", [7, None])
def test_a_difference_multiplies_each_pair_once(spark, strip, monkeypatch):
    grids, grid = [], blocks._grid
    monkeypatch.setattr(blocks, "_grid", lambda *a: grids.append(a) or grid(*a[:-1], strip))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "TILE", (8, 16))
    x, y = unit(40), np.concatenate([unit(40)[:25], unit(30, seed=1)])
    x[3, 0] = np.nan
    s = np.round(x.astype(float) @ y.astype(float).T, 6)
    best = [np.where(np.isnan(s), -np.inf, s).max(k) for k in (1, 0)]
    want = [(i, "removed" if v < 0.95 else "unchanged") for i, v in enumerate(best[0])] + [(i, "added") for i, v in enumerate(best[1]) if v < 0.95]
    assert sorted(map(tuple, compare.corpus_diff(pairs(spark, x), pairs(spark, y)).collect())) == sorted(want) and len(grids) == 1
    got = {(r.other, r.a): r.score for r in blocks.best_of_both(pairs(spark, x), pairs(spark, y)).collect()}
    assert got == {(bool(k), i): v for k in (0, 1) for i, v in enumerate(best[k])}


@pytest.mark.parametrize("strip", [7, None])
def test_clusters_of_copies_keep_a_forest(spark, strip, monkeypatch):
    x = np.concatenate([unit(12, 3)] * 6)
    s = np.round(x.astype(float) @ x.astype(float).T, 6) >= 0.9
    for _ in range(8):
        s = s @ s
    edges = []
    join = clusters.connected_components
    monkeypatch.setattr(clusters, "connected_components", lambda e: edges.append(e.count()) or join(e))
    got = {r.id: r.cluster_id for r in clusters.clusters(pairs(spark, x), 0.9, strip).collect()}
    assert got == {i: int(np.flatnonzero(s[i])[0]) for i in range(len(x))} and edges[0] < 60 + 12 * 4
    short = {r.id: r.cluster_id for r in clusters.clusters(pairs(spark, np.concatenate([x[:2] / 2] * 2)), 0.9).collect()}
    assert short == {i: i for i in range(4)}  # too short to be alike to their own copies


@pytest.mark.parametrize("tried", [3, 10_000])
def test_contradictions_read_all_pairs_if_the_most_alike_do_not_do(spark, tried):
    x = unit(60, 4)
    words = [" ".join(f"w{(i % 7) * 3 + j}" for j in range(6 + i % 2)) for i in range(60)]
    words[3], words[5] = None, "two words"
    texts = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, text string")
    got = [tuple(r) for r in compare.contradictions(pairs(spark, x), texts, 0.5, 0.3, 40, tried).collect()]

    def grams(w):
        t = w.split()
        return {tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 3 else None

    s, want = np.round(x.astype(float) @ x.astype(float).T, 6), []
    for a in range(60):
        for b in range(a + 1, 60):
            if s[a, b] >= 0.5 and words[a] and words[b]:
                p, q = grams(words[a]), grams(words[b])
                j = 1.0 if p is None or q is None else round(len(p & q) / len(p | q), 6)
                if j <= 0.3:
                    want.append((a, b, s[a, b], j))
    assert got == sorted(want, key=lambda r: (-r[2], r[0], r[1]))[:40]


def test_wording_meets_in_cells(spark):
    words = {i: " ".join(f"w{(i * 5 + j * j) % 23}" for j in range(3 + i % 9)) for i in range(40)} | {40: "too short", 41: None}
    texts = spark.createDataFrame(list(words.items()), "id long, text string")
    every = spark.createDataFrame([(a, b, a * 0.5) for a in range(42) for b in range(42) if a != b], "a long, b long, score double")
    one, many = (sorted(map(tuple, compare.worded(every, texts, n).collect())) for n in (None, 300))
    grams = texts.where("text is not null").select("id", text.hashed_trigrams("text").alias("g"))
    joined = every.join(grams.toDF("a", "x"), "a").join(grams.toDF("b", "y"), "b").select("a", "b", "score", F.round(text.jaccard("x", "y"), 6))
    assert one == many == sorted(map(tuple, joined.collect())) and len(one) == 41 * 40


def test_metrics_by_label_are_those_of_all_its_passages(spark):
    r = np.random.default_rng(1)
    labels = spark.createDataFrame([(i, int(r.integers(0, 4)) if i % 9 else None) for i in range(60)], "id long, label int")
    ranked = spark.createDataFrame([(q, n + 1, int(p)) for q in range(50) for n, p in enumerate(r.permutation(60)[:10])], "query_id long, rank int, passage_idx long")
    wanted = labels.toDF("query_id", "label").join(labels.toDF("passage_idx", "label"), "label").select("query_id", "passage_idx", F.lit(1).alias("gain"))
    got = sorted(map(tuple, evaluation.label_metrics(ranked, labels, 8).collect()))
    assert got == sorted(map(tuple, evaluation.ranking_metrics(ranked, wanted, 8).collect())) and len(got) == 53


def test_texts_are_taken_out_in_parts(spark):
    texts = ["é" * 10, None, "b" * 100, "", "c" * 15, "d" * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.string())], ["i", "t"])
    parts = list(text.in_parts([batch, batch.slice(0, 0)], 1, 20))
    assert [p.num_rows for p in parts] == [2, 1, 3] and [t for p in parts for t in p.column(1).to_pylist()] == texts
    rows = spark.createDataFrame([(i, f"f{i % 3}", i, 2, "", str(i)) for i in range(30)], "passage_idx long, source_file string, char_offset int, char_length int, content_hash string, passage_id string")
    now = spark.createDataFrame([(f"f{i}", "abcdefgh" * 9) for i in range(3)], "source_file string, text string")
    want = sorted(map(tuple, retrieval.verified(rows, now).collect()))
    keep, text.PART_BYTES = text.PART_BYTES, 10
    try:
        assert sorted(map(tuple, retrieval.verified(rows.coalesce(1), now.coalesce(1)).collect())) == want and len(want) == 30
    finally:
        text.PART_BYTES = keep


def test_questions_without_room_are_not_searched_for(spark, sf_dir, monkeypatch):
    from sextant import queries as q

    asked_, evidence = [], retrieval.evidence
    monkeypatch.setattr(q.retrieval, "evidence", lambda p, s, queries, k: asked_.append(queries.count()) or evidence(p, s, queries, k))
    got = [tuple(r) for r in q.skill_context(spark, sf_dir).collect()]
    assert asked_ == [context.blocks_at_most()]
    hits, metrics = evidence(q.T.passages(spark, sf_dir), q.T.edited_files(spark, sf_dir), q.T.asked(spark, sf_dir), 5)
    every = context.question_blocks(hits, metrics, q._questions(spark, sf_dir), "knowledge").select("query_id", "drifted", F.array_join("missing_names", ","), "block")
    assert got and got == [tuple(r) for r in every.collect()]
