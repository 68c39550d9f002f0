import difflib
import random

import pytest
from pyspark.sql import functions as F

from sextant.llm.line_dedup import common_blocks, line_dedup, patience_matches
from tests.llm.common import documents, words


def longest_rising(pairs):
    best = []
    for n, (_, j) in enumerate(pairs):
        best.append(1 + max((best[m] for m in range(n) if pairs[m][1] < j), default=0))
    return max(best, default=0)


def test_patience_matches_are_aligned_and_use_the_longest_rising_run_of_unique_lines():
    for seed in range(200):
        r = random.Random(seed)
        a = [r.randint(1, 12) for _ in range(r.randint(0, 14))]
        b = [r.randint(1, 12) for _ in range(r.randint(0, 14))]
        got = patience_matches(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
        if a and b and a[0] != b[0] and a[-1] != b[-1]:
            assert len(got) >= longest_rising(once)


def test_equal_sequences_match_whole_and_blank_lines_do_not_anchor():
    assert patience_matches([1, 2, 1, 2], [1, 2, 1, 2]) == [(k, k) for k in range(4)]
    assert patience_matches([5, 0, 6], [7, 0, 8]) == []


def test_blocks_shorter_than_the_least_stay():
    assert common_blocks([1, 2, 3], [9, 1, 2, 8], [50, 60, 70, 50], 120) == [1, 2]
    assert common_blocks([1, 2, 3], [9, 1, 2, 8], [50, 60, 59, 50], 120) == []


def brute(rows, least):
    """Every pair of documents in order, aligned; lines of an earlier one count although it lost them."""
    docs = sorted({(i, t) for i, t, *_ in rows if i is not None and t}, key=lambda x: x[0])
    gone = {d: set() for d in docs}
    lines = {d: [x.rstrip("\r").strip(" ") for x in d[1].split("\n")] for d in docs}
    for n, d in enumerate(docs):
        for e in docs[:n]:
            for block in difflib.SequenceMatcher(None, lines[e], lines[d], False).get_matching_blocks():
                if sum(len(x) for x in lines[d][block.b : block.b + block.size]) >= least:
                    gone[d] |= set(range(block.b, block.b + block.size))
    return gone


def test_against_brute_force(spark):
    r = random.Random(3)
    blocks = [[" ".join(words(100 * k + j, 8)) for j in range(4)] for k in range(6)]
    rows = []
    for i in range(40):
        own = [[" ".join(words(9000 + 10 * i + j, 8)) for j in range(2)] for _ in range(2)]
        shared = [blocks[k] for k in sorted(r.sample(range(6), r.randint(0, 2)))]
        rows.append((i, "\n".join(x for part in [own[0], *shared, own[1]] for x in part)))
    got = {x.doc_id: x for x in line_dedup(documents(spark, rows)).collect()}
    for (i, t), gone in brute(rows, 120).items():
        kept = [x for k, x in enumerate(t.split("\n")) if k not in gone]
        assert got[i].text == "\n".join(kept)
        assert got[i].removed_lines == len(gone)
        assert got[i].n_chars == len(got[i].text)
        assert got[i].removed_chars == len(t) - len(got[i].text)


def test_a_run_that_many_share_stays_in_the_first_alone(spark):
    passage = " ".join(words(1, 40))
    rows = [(i, f"{' '.join(words(50 + i, 9))}\n{passage}\nend {i}") for i in range(30)]
    got = line_dedup(documents(spark, rows)).orderBy("doc_id").collect()
    assert passage in got[0].text and not any(passage in x.text for x in got[1:])


def test_nulls_repeats_long_texts_extra_columns_and_empty_tables(spark):
    long = "\n".join(" ".join(words(k, 20)) for k in range(3000))
    rows = [(1, long), (2, long), (2, long), (None, long), (3, None), (4, ""), (5, "\n\n"), (6, "ab\n" * 400)]
    docs = documents(spark, rows).withColumns({"removed_lines": F.lit("x"), "lines": F.lit(1), "gone": F.lit(2), "id_": F.lit(3), "ld_gone": F.lit(4)})
    got = line_dedup(docs)
    assert got.columns == [*(c for c in docs.columns if c != "removed_lines"), "removed_lines", "removed_chars"]
    by = sorted((x.doc_id or 0, x.text, x.removed_lines, x.ld_gone) for x in got.collect())
    assert [(i, n) for i, _, n, _ in by] == [(0, 0), (1, 0), (2, 3000), (2, 3000), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert [t for i, t, *_ in by if i == 2] == ["", ""] and all(g == 4 for *_, g in by)
    assert line_dedup(docs.limit(0)).count() == 0


def held(rows, least):
    """Every run of lines that an earlier document has too, wherever it is there."""
    lines = [x.split("\n") for _, x in rows]
    gone = [set() for _ in rows]
    for n, d in enumerate(lines):
        for e in lines[:n]:
            for i in range(len(d)):
                for j in range(len(e)):
                    k = 0
                    while i + k < len(d) and j + k < len(e) and d[i + k] == e[j + k]:
                        k += 1
                    if sum(len(x) for x in d[i : i + k]) >= least:
                        gone[n] |= set(range(i, i + k))
    return gone


@pytest.mark.parametrize("holders", [2, 8, 9, 200])
@pytest.mark.parametrize("kind", ["swapped", "twice", "longer"])
def test_no_run_stays_in_a_later_document_however_the_first_has_it(spark, holders, kind):
    one, two = " ".join(words(1, 40)), [" ".join(words(2 + k, 9)) for k in range(4)]
    tail = " ".join(words(7, 4))
    shapes = {"swapped": ([one, "-", *two], [*two, "+", one]), "twice": ([one, "-", one, *two], [*two, one]), "longer": ([one], [one, tail])}
    rows = [(i, "\n".join([" ".join(words(50 + i, 9)), *shapes[kind][i > 0], f"end {i}"])) for i in range(holders)]
    got = line_dedup(documents(spark, rows)).orderBy("doc_id").collect()
    for (_, text), gone, x in zip(rows, held(rows, 120), got):
        assert x.text == "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    assert got[0].text == rows[0][1] and not any(one in x.text or two[0] in x.text for x in got[1:])


def test_where_rare_ends_and_common_begins_changes_nothing(spark):
    r = random.Random(11)
    blocks = [[" ".join(words(700 + 10 * k + j, 9)) for j in range(3)] for k in range(8)]
    rows = []
    for i in range(60):
        parts = [blocks[k] for k in r.sample(range(8), r.randint(1, 4))] + [[f"own {i} {n}"] for n in range(3)]
        r.shuffle(parts)
        rows.append((i, "\n".join(x for p in parts for x in p)))
    docs = documents(spark, rows)
    got = [sorted((x.doc_id, x.text) for x in line_dedup(docs, rare=rare).collect()) for rare in (1, 8, 1000)]
    assert got[0] == got[1] == got[2]
    for (_, text), gone, (_, left) in zip(rows, held(rows, 120), got[0]):
        assert left == "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
