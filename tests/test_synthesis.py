from sextant.plans import synthesis


def model(system, prompt):
    if prompt.endswith("none"):
        return "", 10, 0
    return f"what does it say about {prompt[-1]}?\nshort\nthis passage is about nothing at all\n", 10, 5


def broken(system, prompt):
    if system == synthesis._WRITE and prompt.endswith("d"):
        raise RuntimeError("over quota")
    return model(system, prompt)


def test_queries_are_filtered_kept_and_not_asked_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"f{i}", 0, f"text {t}") for i, t in enumerate(["a", "b", "none", "d"])], "passage_idx long, source_file string, char_offset int, text string")
    monkeypatch.setattr(synthesis, "SLICE", 2)
    folder = str(tmp_path)
    try:
        synthesis.synthesised(rows, broken, folder)
        raise AssertionError("the model broke off")
    except Exception as e:
        assert "over quota" in str(e)
    done = spark.read.parquet(f"{folder}/*")
    assert sorted({r.passage_idx for r in done.collect()}) == [0, 1]
    got = synthesis.synthesised(rows, model, folder)
    assert sorted(map(tuple, got.collect())) == [(0, "what does it say about a?"), (1, "what does it say about b?"), (3, "what does it say about d?")]
    kept = spark.read.parquet(f"{folder}/*")
    assert kept.where("tokens_in > 0").count() == 4 and kept.where("query is null").count() == 1
    assert sorted(map(tuple, synthesis.synthesised(rows, broken, folder).collect())) == sorted(map(tuple, got.collect()))
