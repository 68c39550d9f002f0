import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import chunks, text


def ends(t, pattern):
    return [m.span() for m in re.finditer(pattern, t)]


def model(t, least, most):
    """Passages by labels of single characters: slow, and put together in another way."""
    if not t.strip():
        return []
    gaps = [(0, 0), *ends(t, r"\n[ \t]*\n+"), (len(t), len(t))]
    paragraphs = [(b, c) for (_, b), (c, _) in zip(gaps, gaps[1:]) if c > b]
    out, k = [], 0
    while k < len(paragraphs):
        a, b = paragraphs[k]
        if b - a > most:
            cuts = [a + e for _, e in ends(t[a:b], r"(?<=[.!?])\s+")]
            bounds = [a, *cuts, *([b] if not cuts or cuts[-1] < b else [])]
            sentences = list(zip(bounds, bounds[1:]))
            while sentences:
                s, e = sentences.pop(0)
                if e - s > most:
                    out += [(x, min(x + most, e)) for x in range(s, e, most)]
                    continue
                while sentences and sentences[0][1] - s <= most:
                    e = sentences.pop(0)[1]
                out.append((s, e))
            k += 1
        elif b - a >= least:
            out.append((a, b))
            k += 1
        else:
            k += 1
            while b - a < least and k < len(paragraphs):
                c, d = paragraphs[k]
                if d - c >= least or d - c > most or d - a > most:
                    break
                b = d
                k += 1
            out.append((a, b))
    return [(a, b - a) for a, b in out]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.!? \n\t🙂", max_size=120), st.integers(1, 12), st.integers(0, 30))
def test_chunks_against_a_model(t, least, more):
    most = least + more
    got = chunks.chunk_spans(t, least, most)
    assert got == model(t, least, most)
    assert all(0 < n <= most for _, n in got)
    assert all(a + n <= b for (a, n), (b, _) in zip(got, got[1:]))


@pytest.mark.parametrize("t,want", [("", []), (None, []), (" \n\t", []), ("a" * 8000, [(0, 3200), (3200, 3200), (6400, 1600)]), ("x" * 200, [(0, 200)]), ("x" * 3200, [(0, 3200)]), ("short", [(0, 5)]), ("a" * 100 + "\n\n" + "b" * 100, [(0, 202)]), ("a" * 100 + "\n \t\n" + "b" * 300, [(0, 100), (104, 300)])])
def test_chunk_examples(t, want):
    assert chunks.chunk_spans(t) == want


def test_registry_numbers_places_and_hashes(spark):
    files = spark.createDataFrame([("b.md", "🙂" * 10), ("a.md", "x" * 7000), ("n.md", None), ("e.md", " ")], "source_file string, text string")
    rows = chunks.registry(files).orderBy("passage_idx").collect()
    assert [(r.passage_idx, r.source_file, r.char_offset, r.char_length) for r in rows] == [(0, "a.md", 0, 3200), (1, "a.md", 3200, 3200), (2, "a.md", 6400, 600), (3, "b.md", 0, 10)]
    for r in rows:
        assert r.content_hash == "sha256:" + hashlib.sha256(r.text.encode()).hexdigest()
        assert r.passage_id == hashlib.sha256(f"{r.source_file}\x1f{r.char_offset}\x1f{r.char_length}".encode()).hexdigest()[:16]
    assert chunks.registry(files.limit(0)).count() == 0


@pytest.mark.parametrize("question,want", [
    ("What is MVE?", ["MVE"]),
    ("Compare F4096 and gen2 pricing", ["F4096", "gen2"]),
    ("Tell me about 'Quantum Lakes' and \"x\"", ["Quantum Lakes"]),
    ("Is (SKU) the SKU of Power BI data?", ["SKU"]),
    ("summarize login behaviour", []),
    (None, []),
])
def test_names(spark, question, want):
    assert spark.createDataFrame([(question,)], "q string").select(text.names("q")).first()[0] == want


@pytest.mark.parametrize("name,passage,found", [("MVE", "the MVE is", True), ("MVE", "the mve is", False), ("MVE", "MVEX", False), ("F4096", "on F40961", False), ("Quantum Lakes", "of quantum lakes", True), ("gen2", "GEN2s", True), ("C.D", "aC.D b", False), ("C.D", "CxD", False), ("C.D", "(C.D)", True)])
def test_presence(spark, name, passage, found):
    got = spark.createDataFrame([(name, passage)], "n string, t string").select(text.contains_name("t", F.col("n"))).first()[0]
    assert got == found


def test_jaccard_of_trigrams(spark):
    rows = [("a b c d", "a b c e", 1 / 3), ("A b c", "a b c", 1.0), ("a b", "c d e f", 1.0), ("a b c", "d e f", 0.0)]
    for a, b, want in rows:
        got = spark.createDataFrame([(a, b)], "a string, b string").select(text.jaccard(text.trigrams("a"), text.trigrams("b"))).first()[0]
        assert got == pytest.approx(want)


def test_quoted_paths_previews_and_refusals(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.quoted_path(F.lit("a b/c#d/é~*.md"))) == "a%20b/c%23d/%C3%A9~%2A.md"
    assert one(text.preview(F.lit(" " + "x" * 300))) == "x" * 279 + "…"
    assert one(text.refusal(F.array().cast("array<string>"))) == "" and "`MVE`" in one(text.refusal(F.array(F.lit("MVE"))))
