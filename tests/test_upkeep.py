import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.functions import chunks
from sextant.operators import delta, evaluation, memory, projection
from sextant.plans import deep
from sextant.sources import convert, encoders, files, model, remote
from sextant.streaming import files as streams

A, B, C = "# A\nAlpha is the first letter of all.", "# B\nBeta comes after it, most of the time.", "# C\nGamma is third in every list."
ENCODER = encoders.HashingEncoder(16)


def sources(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()] or [("x", "x")], "source_file string, text string").where("source_file <> 'x'")


def built(spark, mode="local", **texts):
    src = sources(spark, **texts)
    passages = chunks.registry(src, 10, 400)
    rows = passages.drop("text").join(encoders.encoded(passages.select("passage_id", "text"), ENCODER), "passage_id")
    manifest = remote.compose_manifest(src, "https://x.example/v1/") if mode == "remote" else None
    return model.KnowledgeModel(rows, model.new_metadata(mode, 16, ENCODER.name, ENCODER.revision), src if mode == "bundled" else None, manifest)


def ids(df):
    return {r.source_file: (r.passage_id, r.content_hash) for r in df.select("source_file", "passage_id", "content_hash").collect()}


def test_model_round_trip_and_versions(spark, tmp_path):
    path = str(tmp_path / "km")
    with pytest.raises(FileNotFoundError):
        model.read(spark, path)
    km = built(spark, "bundled", a=A, b=B)
    km = model.KnowledgeModel(km.passages, km.metadata | {"unknown": {"kept": 1}}, km.sources)
    assert model.write(km, path) == 0
    back = model.read(spark, path)
    assert back.metadata == km.metadata and ids(back.passages) == ids(km.passages) and back.sources.count() == 2
    assert model.write(model.with_optimised(back, [[float(i == j) for j in range(16)] for i in range(4)]), path) == 1
    two = model.read(spark, path)
    assert two.band() == "optimised" and two.band("base") == "vector" and len(two.projection) == 4
    assert ids(two.passages) == ids(km.passages) and len(two.passages.first().optimised) == 4
    q = encoders.query_table(spark, ENCODER, ["alpha"], two.metadata)
    assert len(two.queries_for(q).first().vector) == 4 and len(two.queries_for(q, "base").first().vector) == 16
    with pytest.raises(KeyError):
        back.band("optimised")
    with pytest.raises(ValueError):
        encoders.query_table(spark, ENCODER, ["alpha"], {"encoder": {"revision": "other"}})
    open(os.path.join(path, "v=1", "metadata.json"), "w").write(json.dumps(two.metadata | {"version": 3}))
    for name in os.listdir(os.path.join(path, "v=1")):
        if name.endswith(".crc"):
            os.remove(os.path.join(path, "v=1", name))
    with pytest.raises(ValueError, match="version 3"):
        model.read(spark, path)


def test_parts_that_disagree_are_refused(spark):
    km = built(spark, "local", a=A)
    for meta, src in (({"version": 1}, None), ({"store_mode": "cloud"}, None), ({"store_mode": "bundled"}, None), ({"store_mode": "remote"}, None), ({"bands": {"base": {}, "optimised": {}}}, None), ({}, sources(spark, a=A))):
        with pytest.raises(ValueError):
            model.check(model.KnowledgeModel(km.passages, km.metadata | meta, src))


def test_registry_lines(spark, tmp_path):
    rows = built(spark, "local", a=A, b=B).passages
    model.write_registry(rows, str(tmp_path / "r"))
    assert ids(model.read_registry(spark, str(tmp_path / "r"))) == ids(rows)
    with pytest.raises(ValueError):
        model.write_registry(rows.withColumn("passage_idx", F.col("passage_idx") + 1), str(tmp_path / "s"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"passage_idx": 0, "source_file": "a", "char_offset": 0, "char_length": 3, "content_hash": "h"}\nnot json\n')
    with pytest.raises(Exception):
        model.read_registry(spark, str(tmp_path / "bad")).collect()


def test_walk(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "a.MD").write_bytes(b"one\r\ntwo\rthree")
    (tmp_path / "docs" / "deep" / "b.txt").write_text("é")
    (tmp_path / "docs" / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "docs" / "x.bin").write_bytes(b"x")
    (tmp_path / "README.md").write_text("top")
    good, bad = files.walk(spark, [str(tmp_path / "docs"), str(tmp_path / "docs" / "a.MD")], root=str(tmp_path))
    assert {r.source_file: r.text for r in good.collect()} == {"docs/a.MD": "one\ntwo\nthree", "docs/deep/b.txt": "é"}
    assert [r.source_file for r in bad.collect()] == ["docs/bad.txt"]
    outside, _ = files.walk(spark, [str(tmp_path / "README.md")], root=str(tmp_path / "docs"))
    assert [r.source_file for r in outside.collect()] == [str(tmp_path / "README.md")]
    assert files.common_root([str(tmp_path / "README.md")]) == str(tmp_path) == files.common_root([str(tmp_path / "docs"), str(tmp_path / "README.md")])
    assert files.project_sources(str(tmp_path)) == [str(tmp_path / "docs"), str(tmp_path / "README.md")]
    assert files.resolve_inside(str(tmp_path), "docs/a.MD").endswith("a.MD")
    with pytest.raises(ValueError):
        files.resolve_inside(str(tmp_path / "docs"), "../README.md")


def test_delta_keeps_what_is_unchanged_and_encodes_the_rest_once(spark):
    km = built(spark, "local", a=A, b=B, c=C)
    marked = km.passages.withColumn("vector", F.array(F.lit(7.0).cast("float")))
    now = chunks.candidates(sources(spark, a=A, b=B.replace("Beta", "Zeta"), d=C), 10, 400)
    assert {r.bucket: r.n for r in delta.bucket_counts(delta.bucketise(marked, now)).collect()} == {"unchanged": 1, "updated": 1, "added": 1, "removed": 1}
    done = delta.apply_delta(marked, now.union(now), encoders.encode_with(ENCODER)).orderBy("passage_idx").collect()
    assert [(r.source_file, len(r.vector)) for r in done] == [("a.md", 1), ("b.md", 16), ("d.md", 16)]
    same = chunks.candidates(sources(spark, a=A, b=B, c=C), 10, 400)
    assert {r.bucket: r.n for r in delta.bucket_counts(delta.bucketise(marked, same)).collect()} == {"unchanged": 3, "updated": 0, "added": 0, "removed": 0}
    assert ids(delta.apply_delta(marked, same, encoders.encode_with(ENCODER))) == ids(marked)


def test_remote_sync_and_freshness(spark):
    km = built(spark, "remote", a=A, b=B)
    base = "https://x.example/v1/"
    live = {base + "a.md": A, base + "b.md": B.replace("Beta", "Zeta"), base + "c.md": C}

    def opener(url):
        if url not in live:
            raise OSError("404")
        return live[url].replace("\n", "\r\n").encode()

    states = lambda: {r.source_file: r.drift_status for r in delta.freshness(km.manifest, remote.fetched(km.manifest, opener)).collect()}
    assert states() == {"a.md": "verified", "b.md": "drifted"}
    catalog = remote.compose_manifest(sources(spark, a=A, b=B.replace("Beta", "Zeta"), c=C), base)
    change = delta.manifest_delta(km.manifest, catalog)
    assert {r.source_file: r.bucket for r in change.collect()} == {"a.md": "unchanged", "b.md": "modified", "c.md": "added"}
    got = remote.fetched(catalog.join(delta.changed_files(change), "source_file"), opener)
    passages, manifest = delta.sync(km.passages, km.manifest, change, got, encoders.encode_with(ENCODER), least=10, most=400)
    assert sorted(ids(passages)) == ["a.md", "b.md", "c.md"] and ids(passages)["a.md"] == ids(km.passages)["a.md"]
    assert sorted(r.passage_idx for r in passages.collect()) == [0, 1, 2]
    assert sorted(map(tuple, manifest.select("source_file", "sha256").collect())) == sorted(map(tuple, catalog.select("source_file", "sha256").collect()))
    del live[base + "b.md"]
    assert states() == {"a.md": "verified", "b.md": "missing"}
    polled = delta.poll_delta(km.manifest, remote.fetched(km.manifest, opener))
    with pytest.raises(delta.Unavailable, match="b.md"):
        delta.sync(km.passages, km.manifest, polled, got.limit(0), encoders.encode_with(ENCODER))
    kept, _ = delta.sync(km.passages, km.manifest, polled, got.limit(0), encoders.encode_with(ENCODER), allow_unavailable=True)
    assert ids(kept) == ids(km.passages)
    assert remote.poll_ref(km.manifest) != remote.poll_ref(manifest) and remote.poll_ref(manifest) == remote.poll_ref(catalog)


def test_pins_and_cache(spark):
    src = sources(spark, a=A, b=B)
    pins = remote.compose_manifest(src, "u")
    texts = lambda opener, cache=None: {r.source_file: r.text for r in remote.pinned_texts(pins, opener, cache).collect()}
    good = lambda url: {"u/a.md": A, "u/b.md": B}[url].encode()
    assert texts(good) == {"a.md": A, "b.md": B}
    cache = pins.join(src, "source_file").where("source_file = 'a.md'")
    only_b = lambda url: {"u/b.md": B}[url].encode()
    assert texts(only_b, cache) == {"a.md": A, "b.md": B}
    with pytest.raises(Exception, match="ShaMismatch"):
        texts(lambda url: b"other")


@pytest.mark.parametrize("way", [("bundled", "local"), ("bundled", "remote"), ("local", "bundled"), ("local", "remote"), ("remote", "local"), ("remote", "bundled")])
def test_conversion(spark, way):
    km = built(spark, way[0], a=A, b=B)
    out = convert.converted(km, way[1], sources(spark, a=A, b=B, c=C), "https://y.example")
    assert out.mode == way[1] and ids(out.passages) == ids(km.passages)
    assert (out.sources is not None, out.manifest is not None) == (way[1] == "bundled", way[1] == "remote")
    for src in (sources(spark, a=A, b="other"), sources(spark, a=A)):
        with pytest.raises(convert.Drifted, match="b.md"):
            convert.converted(km, way[1], src, "https://y.example")
    with pytest.raises(ValueError):
        convert.converted(km, way[0], sources(spark, a=A, b=B))


def test_stream_of_documents_is_replayable(spark, tmp_path):
    path, folder = str(tmp_path / "km"), tmp_path / "in"
    model.write(built(spark, "local", a=A, b=B), path)
    schema = "source_file string, text string, modified long"
    spark.createDataFrame([("b.md", "old", 1), ("b.md", B + " More.", 2), ("c.md", C, 1), ("a.md", None, 3)], schema).write.parquet(str(folder))
    for run in range(2):
        stream = spark.readStream.schema(schema).parquet(str(folder))
        q = streams.maintain(stream, path, ENCODER, str(tmp_path / f"check{run}"))
        q.awaitTermination()
        got = ids(model.read(spark, path).passages)
        assert sorted(got) == ["b.md", "c.md"]
        assert run == 0 or got == before
        before = got


def test_memories_told_twice_and_windows(spark, tmp_path):
    folder = str(tmp_path / "m")
    spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:10:00"), ("y", "2024-01-01 00:20:00")], "text string, c string").select("text", F.to_timestamp("c").alias("created")).write.parquet(folder)
    stream = spark.readStream.schema("text string, created timestamp").parquet(folder)
    q = streams.told_once(stream).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("told").collect()) == ["x", "y"]
    events = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(events).schema
    (tmp_path / "e").mkdir()
    spark.read.parquet(events).write.mode("overwrite").parquet(str(tmp_path / "e"))
    q = streams.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, streams.windowed(spark.read.parquet(events)).collect()))


MEMORY = memory.SCHEMA


def entries(spark, rows):
    full = [(i, f"text {i}", s, "src", session, created, tier, 1, [float(x) for x in v]) for i, s, session, created, tier, v in rows]
    return spark.createDataFrame(full, MEMORY)


def test_decay_by_age(spark):
    now = "2024-01-15T00:00:00Z"
    rows = entries(spark, [(0, 1.0, None, "2024-01-14T00:00:00Z", "working", [1, 0]), (1, 1.0, None, "2024-01-01T00:00:00+00:00", "episodic", [1, 0]), (2, 1.0, None, "", "working", [1, 0]), (3, 1.0, None, "whenever", "semantic", [1, 0]), (4, 1.0, None, "2030-01-01T00:00:00Z", "working", [1, 0]), (5, 1.0, None, "1990-01-01T00:00:00Z", "semantic", [1, 0]), (6, 1.0, None, "2024-01-14T02:00:00+02:00", "working", [1, 0])])
    got = {r.memory_id: round(r.effective, 6) for r in memory.effective(rows, now).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: 0.5}
    assert sorted(r.memory_id for r in memory.collected(rows, now, caps={"working": 2, "episodic": 5, "semantic": 5}).collect()) == [1, 2, 4, 5]


def test_consolidation_of_three_not_two_and_of_one_session(spark):
    v = {"x": [1, 0, 0], "y": [0, 1, 0]}
    rows = entries(spark, [(i, 1.0, "s" if i != 4 else "t", "", "episodic", v["x" if i < 5 else "y"]) for i in range(7)] + [(9, 1.0, None, "", "semantic", v["x"])])
    got = {r.memory_id: (r.tier, r.recurrence_count) for r in memory.consolidated(rows).collect()}
    assert got == {0: ("semantic", 5), 5: ("episodic", 1), 6: ("episodic", 1), 9: ("semantic", 1)}
    got = {r.memory_id: r.tier for r in memory.consolidated(rows, session="s").collect()}
    assert got == {0: "semantic", 4: "episodic", 5: "episodic", 6: "episodic", 9: "semantic"}


def test_recall_weights_and_adding(spark):
    rows = entries(spark, [(0, 1.0, None, "", "working", [1, 0]), (1, 2.0, None, "", "episodic", [1, 0]), (2, 1.0, None, "", "semantic", [1, 0]), (3, 1.0, None, "", "working", [0, 1])])
    assert [(r.memory_id, r.score) for r in memory.recall(rows, [1.0, 0.0]).orderBy("rank").collect()] == [(1, 0.6), (0, 0.5), (2, 0.2), (3, 0.0)]
    assert [r.score for r in memory.recall(rows, [1.0, 0.0], 1, {"episodic": 0.1}).collect()] == [0.2]
    assert [r.memory_id for r in memory.recall(rows, [1.0, 0.0], tiers=["semantic"]).collect()] == [2] and memory.recall(rows, [1.0, 0.0], 0).count() == 0
    more = memory.added(rows, spark.createDataFrame([(7, "new", [0.5, 0.5])], "memory_id long, text string, vector array<float>"))
    assert more.where("memory_id = 7 and tier = 'working' and salience = 1 and recurrence_count = 1").count() == 1
    with pytest.raises(Exception, match="no such tier"):
        memory.added(rows, spark.createDataFrame([(7, "new", "other", [0.5, 0.5])], "memory_id long, text string, tier string, vector array<float>")).collect()


def test_training_learns_and_its_slope_is_right():
    r = np.random.default_rng(0)
    w = r.standard_normal((4, 6))
    q, p, neg = r.standard_normal((3, 6)), r.standard_normal((3, 6)), r.standard_normal((3, 2, 6))
    _, g = projection.loss_and_slope(w, q, p, neg, (2, 4), 0.5)
    for i, j in ((0, 0), (1, 3), (3, 5)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        up, down = (projection.loss_and_slope(w + s * e, q, p, neg, (2, 4), 0.5)[0] for s in (1, -1))
        assert g[i, j] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    topics = r.standard_normal((40, 8))
    noise = lambda n: np.concatenate([topics[np.arange(n) % 40], 3 * r.standard_normal((n, 24))], axis=1)
    p, q = noise(40), noise(400)
    own = np.arange(400) % 40
    neg = np.stack([r.choice(np.setdiff1d(np.arange(40), [k]), 7) for k in own])
    args = dict(dims=(8, 16), steps=120, rate=5e-3)
    t = projection.train(q, p, own, neg, **args)
    assert t.losses[-1] < t.losses[0] and t.recall > 0.3 and (projection.train(q, p, own, neg, **args).weights == t.weights).all()
    bad = projection.train(r.standard_normal((400, 32)), r.standard_normal((40, 32)), own, neg, dims=(16,), steps=150, rate=1e-9)
    assert bad.stopped and len(bad.losses) < 150


def test_negatives_are_repeated_in_turn(spark):
    x = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5]]
    rows = spark.createDataFrame(list(enumerate(x)), "passage_idx long, vector array<float>")
    q = spark.createDataFrame([(0, x[0], 0), (1, x[0], 99)], "query_id long, vector array<float>, positive long")
    got = projection.hard_negatives(q, rows).collect()
    zero = [r.passage_idx for r in sorted(got, key=lambda r: r.place) if r.query_id == 0]
    assert len(zero) == 7 and set(zero) == {1, 2} and zero[0] == zero[2] == zero[4]
    assert projection.hard_negatives(q, rows.where("passage_idx = 0")).where("query_id = 0").count() == 0
    assert projection.estimated_cost(10) > 0 and projection.estimated_seconds(10, 10, "cuda") < projection.estimated_seconds(10, 10)


def test_percentiles_and_missing_verdicts(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None)], "k string, v double")
    assert {r.k: (r.p50, r.p95) for r in evaluation.percentiles(rows, "v", ["k"]).collect()} == {"a": (2.0, 3.8), "b": (0.0, 0.0)}
    t = spark.createDataFrame([("m", "answerable", None, None, 2.0), ("m", "distractor", None, 1.0, None)], "approach string, kind string, verdict string, cost_usd double, wall_seconds double")
    r = evaluation.by_approach(t).first()
    assert (r.answerable_wrong, r.distractor_hallucinated, r.mean_cost_usd, r.mean_wall_seconds) == (1, 1, 0.5, 1.0)


class Script:
    def __init__(self, *texts):
        self.texts, self.prompts = list(texts), []

    def __call__(self, system, prompt):
        self.prompts.append(prompt)
        return self.texts.pop(0), 100, 50


def hop(spark, *texts):
    def search(query):
        if query == "fail":
            raise RuntimeError("no index")
        return spark.createDataFrame([(f"f{i}.md", 0, len(t), 0.9 - i / 10, "verified", t) for i, t in enumerate(texts)], "source_file string, char_offset int, char_length int, score double, drift_status string, text string")

    return search


@pytest.mark.parametrize("script,kinds,answer", [
    (["q", '{"action": "answer", "answer": "42"}'], ["plan", "search", "decide_answer"], "42"),
    (["q", 'Well {"action": "search", "query": "r"}', '{"action": "answer", "answer": "ok"}'], ["plan", "search", "decide_search", "search", "decide_answer"], "ok"),
    (["q", '{"action": "give_up"}'], ["plan", "search", "decide_give_up"], deep.GIVEN_UP),
    (["q", *['{"action": "search", "query": "r"}'] * 3, "in sum"], ["plan", *["search", "decide_search"] * 3, "sum_up"], "in sum"),
    (["q", "no json"], ["plan", "search", "parse_failed"], "no json"),
    (["q", '{"action": "dance"}'], ["plan", "search"], deep.NO_DECISION),
    (["fail"], ["plan", "search_failed"], deep.NO_DECISION),
])
def test_deep_search(spark, script, kinds, answer):
    m = Script(*script)
    got = deep.deep_search(spark, "what is it?", hop(spark, "alpha", "beta"), m)
    assert [h.kind for h in got.hops] == kinds and got.answer == answer and not m.texts
    assert got.tokens_in == 100 * len(m.prompts) and got.cost_usd > 0
    assert [p["source_file"] for p in got.evidence] == (["f0.md", "f1.md"] if "search" in kinds else [])


def test_deep_search_checks_names_against_passages_alone(spark):
    script = ["MVE default", '{"action": "answer", "answer": "yes"}']
    soft = deep.deep_search(spark, "What is MVE?", hop(spark, "alpha"), Script(*script))
    assert soft.missing == ["MVE"] and soft.answer.endswith("yes") and "`MVE`" in soft.answer and not soft.aborted
    hard = deep.deep_search(spark, "What is MVE?", hop(spark, "alpha"), Script(*script), strict_names=True)
    assert hard.answer == deep.WRONG_NAME and hard.aborted
    assert deep.deep_search(spark, "What is MVE?", hop(spark, "the MVE"), Script(*script)).missing == []
    with pytest.raises(ValueError):
        deep.deep_search(spark, "q", hop(spark), Script(), max_hops=1)


def test_files_that_cannot_be_read_are_named(spark, tmp_path):
    from sextant.sources import files

    for name, data in (("a b.md", b"one"), ("c.md", b"\xff\xfe\xfa"), ("gone.md", b"two"), ("x.bin", b"no")):
        (tmp_path / name).write_bytes(data)
    good, bad = files.walk(spark, [str(tmp_path)])
    (tmp_path / "gone.md").unlink()  # between the list and the reading
    assert [tuple(r) for r in good.collect()] == [("a b.md", "one")]
    assert sorted(map(tuple, bad.collect())) == [("c.md", "not utf-8"), ("gone.md", "can't be read")]


def test_the_pointer_moves_in_one_step_and_versions_are_claimed_once(spark, tmp_path, monkeypatch):
    from sextant.sources import model

    path = str(tmp_path / "km")
    assert [model.claimed(spark, path) for _ in range(3)] == [0, 1, 2] and model.current(spark, path) == -1
    model._put(spark, f"{path}/CURRENT", "1")
    import os

    def fails(*_):
        raise OSError("no more")

    monkeypatch.setattr(os, "replace", fails)
    with pytest.raises(OSError, match="no more"):
        model._put(spark, f"{path}/CURRENT", "2")
    assert model.current(spark, path) == 1 and model.claimed(spark, path) == 3


def test_texts_that_are_not_those_pinned_have_drifted_as_a_whole(spark):
    from sextant.operators import retrieval
    from sextant.sources import model, remote, store

    src = spark.createDataFrame([("a.md", "Alpha one. Alpha two."), ("b.md", "Beta one. Beta two."), ("c.md", "Gamma")], "source_file string, text string")
    passages = spark.createDataFrame([(i, f, 0, 5) for i, f in enumerate(("a.md", "b.md", "c.md"))], "passage_idx long, source_file string, char_offset int, char_length int").join(src, "source_file")
    passages = passages.selectExpr("passage_idx", "source_file", "char_offset", "char_length", "'sha256:' || sha2(substring(text, 1, 5), 256) as content_hash", "'id' || passage_idx as passage_id", "array(1f) as vector")
    km = model.KnowledgeModel(passages, model.new_metadata("remote", 1, "none", "1"), None, remote.compose_manifest(src, "https://x.example"))

    def opener(url):
        if url.endswith("c.md"):
            raise OSError("gone")
        return {"a": b"Alpha one. Alpha two.", "b": b"Beta one. Beta three."}[url[-4]]

    got = retrieval.verified(km.passages, store.open_sources(km, opener=opener))
    assert {r.source_file: r.drift_status for r in got.collect()} == {"a.md": "verified", "b.md": "drifted", "c.md": "missing"}


def test_a_store_of_memories_grows_by_files_and_swaps_a_tier(spark, tmp_path):
    import glob

    from sextant.operators import memory
    from sextant.sources import store

    root = str(tmp_path / "memory")
    entry = lambda i, tier: spark.createDataFrame([(i, f"t{i}", 1.0, "", None, "", tier, 1, [1.0])], memory.SCHEMA)
    assert store.append_memory(entry(0, "working"), root) == 0
    before = set(glob.glob(f"{root}/v=0/*/*.parquet"))
    assert store.append_memory(entry(1, "episodic"), root) == 0 and before < set(glob.glob(f"{root}/v=0/*/*.parquet"))
    assert store.replace_tier(entry(2, "working"), "episodic", root) == 1
    assert sorted((r.memory_id, r.tier) for r in store.read_memory(spark, root).collect()) == [(0, "working"), (2, "episodic")]
    with pytest.raises(ValueError, match="tier"):
        store.replace_tier(entry(3, "working"), "other", root)
    with pytest.raises(Exception, match="no such tier"):
        store.append_memory(entry(3, "other"), root)


def test_models_that_do_not_go_together_are_not_merged_or_composed(spark):
    from dataclasses import replace

    from sextant.operators import compare
    from sextant.sources import model

    rows = spark.createDataFrame([(i, f"f{i}", 0, 1, "h", f"p{i}", v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]])], "passage_idx long, source_file string, char_offset int, char_length int, content_hash string, passage_id string, vector array<float>")
    km = model.KnowledgeModel(rows, model.new_metadata("local", 2, "none", "1", root="r"))
    other = replace(km, passages=rows.where("passage_idx = 1"), metadata=km.metadata | {"ann": {"vector": "x"}})
    got = compare.merged_model(km, other)
    assert sorted((r.passage_idx, r.source_file) for r in got.passages.collect()) == [(0, "f0"), (1, "f1")]
    config = got.metadata["build_config"]
    assert (config["n_a"], config["n_b"], config["n_merged"], config["merged_from"]) == (2, 1, 2, ["r", "r"]) and "ann" not in got.metadata
    model.check(got)
    wide = replace(km, metadata=km.metadata | {"bands": {"base": {"dim": 3}}})
    newer = replace(km, metadata=km.metadata | {"encoder": {"name": "none", "revision": "2"}})
    for bad, why in ((replace(km, metadata=km.metadata | {"store_mode": "bundled"}), "bundled"), (wide, "size"), (newer, "revision")):
        with pytest.raises(ValueError, match=why):
            compare.merged_model(km, bad)
    with pytest.raises(compare.Mismatch):
        compare.compose_models(a=km, b=wide)
    assert compare.compose_models(a=km, b=newer).count() == 4


def test_actions_are_read_as_the_search_reads_them(spark):
    from sextant.plans import deep

    raw = ['x {"action": "answer", "answer": {"a": 1}} y', '{"query": 1} {"action": "search", "query": "q {z}"}', "none", None, '{"action": "give_up"', '[{"action": null}]']
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, r string").select("i", deep.parsed_action("r").alias("a")).orderBy("i").collect()
    assert [tuple(r.a) for r in rows] == [("answer", None, '{"a": 1}'), ("search", "q {z}", None), *[(None, None, None)] * 4]
    assert [deep._action(x or "") is not None for x in raw] == [True, True, False, False, False, True]
