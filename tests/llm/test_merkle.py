import random
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from sextant.llm.merkle import edits, fingerprints, merkle_trees, tree
from sextant.llm.queries import ORACLE, QUERIES
from tests.llm.common import documents, words
from tests.oracle import assert_same


def test_sql(spark, sf_dir):
    assert_same(spark, QUERIES["op6_fingerprints"], ORACLE["op6_fingerprints"], sf_dir)


def test_sql_of_edits(spark, sf_dir):
    assert_same(spark, QUERIES["fingerprint_edits"], ORACLE["fingerprint_edits"], sf_dir)


def test_rows_that_repeat_an_id_have_one_tree(spark):
    a = merkle_trees(documents(spark, [(1, "x\ny"), (1, "z"), (1, None), (None, "q"), (2, "same"), (2, "same")]))
    b = merkle_trees(documents(spark, [(1, "z"), (1, "x\ny"), (2, "same"), (3, None)]))
    assert edits(a, b).count() == 0
    least = min((tree(t)[0], t) for t in ("x\ny", "z"))[1]
    assert edits(a, b.limit(0)).where("doc_id = 1").count() == len(least.split("\n"))


def test_edits_are_located(spark):
    r = random.Random(2)
    old, new = {}, {}
    for i in range(30):
        lines = [" ".join(words(100 * i + k, 6)) for k in range(40)]
        lines[10] = "# heading"
        old[i] = "\n".join(lines)
        for k in r.sample(range(40), i % 4):
            lines[k] = f"changed {i} {k}"
        new[i] = "\n".join(lines)
    got = edits(merkle_trees(documents(spark, list(old.items()))), merkle_trees(documents(spark, list(new.items())))).collect()
    for i in old:
        a, b = (Counter(sha256(x.encode()).hexdigest() for x in t[i].split("\n")) for t in (old, new))
        mine = [x for x in got if x.doc_id == i]
        assert Counter(x.hash for x in mine if x.change == "removed") == a - b
        assert Counter(x.hash for x in mine if x.change == "added") == b - a
        sections = tree(new[i])[1]
        assert all(sections[x.section][1][x.paragraph] == x.hash for x in mine if x.change == "added")
        assert (not mine) == (tree(old[i])[0] == tree(new[i])[0])


def test_documents_on_one_side(spark):
    a, b = merkle_trees(documents(spark, [(1, "x\ny"), (2, None)])), merkle_trees(documents(spark, [(2, "z"), (3, "")]))
    assert sorted((x.doc_id, x.change) for x in edits(a, b).collect()) == [(1, "removed"), (1, "removed"), (2, "added")]


def test_every_case_has_a_result(spark):
    docs = documents(spark, [(1, None), (None, "a"), (2, ""), (3, "\n \n"), (4, "p\n" * 50_000), (5, "a"), (5, "a")]).withColumns({"root": F.lit(1), "sections": F.lit(2)})
    got = {(x.doc_id, x.n_paragraphs) for x in fingerprints(docs).collect()}
    assert got == {(1, None), (None, 1), (2, 0), (3, 0), (4, 50_000), (5, 1)} and fingerprints(docs).count() == 7
    assert fingerprints(docs.limit(0)).count() == 0
