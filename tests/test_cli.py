import json

import pytest

from sextant.cli import main


@pytest.fixture
def run(spark, capsys):
    def call(*args):
        code = main(["--encoder", "hashing:32", *map(str, args)], spark)
        return code, capsys.readouterr().out

    return call


def scripted(system, prompt):
    return ('{"action": "answer", "answer": "alpha"}' if "Evidence" in prompt else "alpha letter"), 10, 5


def writer(system, prompt):
    return "what is the first letter of all\nwhich of the letters comes first\nwho writes the lists of letters\n", 10, 5


def test_models_from_the_command_line(run, tmp_path, monkeypatch):
    docs, km = tmp_path / "docs", tmp_path / "a.km"
    docs.mkdir()
    (docs / "a.md").write_text("Alpha is the first letter, MVE says, of all the letters there are.")
    (docs / "b.md").write_text("Beta comes after it in most of the lists that people write down.")
    assert run("build", docs, "-o", km, "--min-chars", 10)[0] == 0
    assert run("build", docs, "-o", tmp_path / "x", "--ext", "zzz")[0] == 1
    code, out = run("search", km, "alpha first letter", "--format", "json", "--top-k", 2)
    hits = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and hits[0]["source_file"] == "a.md" and hits[0]["drift_status"] == "verified" and len(hits) == 2
    assert run("search", km, "alpha first letter", "--format", "context", "--mode", "constrain")[0] == 0
    assert run("search", km, "what is XYZ9", "--format", "context", "--mode", "constrain", "--strict-names")[0] == 3
    code, out = run("skill-context", km, "--query", "alpha first letter", "--query", "beta lists", "--mode", "constrain")
    assert code == 0 and out.index("alpha first") < out.index("beta lists")
    assert json.loads(run("profile", km)[1])["drift"] == {"verified": 2, "drifted": 0, "missing": 0}
    assert json.loads(run("compare", km, km)[1])["centroid_cosine"] == 1.0
    assert "## Evidence" in run("summary", km, "--query", "alpha letter")[1]
    assert json.loads(run("install-encoder")[1])["dim"] == 32
    assert json.loads(run("deep-search", km, "what is alpha?", "--client", "tests.test_cli:scripted", "--format", "json")[1])["answer"] == "alpha"
    (docs / "b.md").write_text("Beta has changed; it now comes before everything else in the lists.")
    assert run("skill-context", km, "--query", "beta lists", "--strict")[0] == 2
    assert run("convert", km, "--mode", "bundled", "-o", tmp_path / "c.km")[0] == 2
    assert json.loads(run("refresh", km, "--dry-run")[1])["removed"] == 1
    assert run("refresh", km)[0] == 0 and json.loads(run("refresh", km)[1]) == {"unchanged": 2, "updated": 0, "added": 0, "removed": 0}
    assert run("convert", km, "--mode", "bundled", "-o", tmp_path / "c.km")[0] == 0 and run("convert", km, "--mode", "local")[0] == 0
    assert json.loads(run("profile", tmp_path / "c.km")[1])["mode"] == "bundled"
    assert run("convert", km, "--mode", "remote")[0] == 1 and run("freshness", km)[0] == 1
    assert run("convert", km, "--mode", "remote", "--remote-url-base", f"file://{docs}", "-o", tmp_path / "r.km")[0] == 0
    assert run("freshness", tmp_path / "r.km")[0] == 0
    (docs / "a.md").unlink()
    assert run("freshness", tmp_path / "r.km")[0] == 2 and run("sync", tmp_path / "r.km")[0] == 2
    assert run("sync", tmp_path / "r.km", "--allow-unavailable")[0] == 0
    assert run("search", tmp_path / "none", "x")[0] == 1 and run("build", docs, "-o", tmp_path / "y", "--store-mode", "remote")[0] == 2
    assert run("optimise", km, "--estimate")[0] == 0
    (tmp_path / "q.json").write_text('{"query": "what is the first letter", "passage_idx": 0}\n')
    assert run("optimise", km, "--queries", tmp_path / "q.json")[0] == 1 and run("optimise", km)[0] == 2
    (docs / "a.md").write_text("Alpha is the first letter, MVE says, of all the letters there are.")
    code, out = run("optimise", km, "--client", "tests.test_cli:writer", "--least-queries", 4)
    assert code in (0, 4) and "recall_at_1" in out
    (docs / "a.md").unlink()
    monkeypatch.chdir(docs)
    assert run("init-project", "-o", tmp_path / "p.km", "--primer", tmp_path / "primer.md")[0] == 0 and "# Primer" in (tmp_path / "primer.md").read_text()


def test_memory_from_the_command_line(run, tmp_path):
    m = ("memory", "--memory-root", tmp_path / "m")
    for text in ("the sky is blue", "the sky is blue", "the sky is blue", "grass is green"):
        assert run(*m, "add", text, "--tier", "episodic", "--session", "s")[0] == 0
    assert run(*m, "add", "  ")[0] == 1 and run(*m, "recall", "sky", "--tier-weights", "{")[0] == 1
    assert run(*m, "consolidate")[0] == 0
    rows = [json.loads(x) for x in run(*m, "recall", "the sky is blue", "--format", "json")[1].splitlines()]
    assert {(r["tier"], r["text"]) for r in rows} == {("episodic", "grass is green"), ("semantic", "the sky is blue")}
    assert "seen 3 times" in run(*m, "primer", "--novelty", "0")[1]
    assert json.loads(run(*m, "gc")[1]) == {"removed": 0}
