import random

import pyarrow as pa
from pyspark.sql import functions as F

from sextant.llm.tokens import MARK, VOCABULARY, Automaton, read_pieces, token_counts
from tests.llm.common import documents


def greedy(word, begin, go_on):
    n, at, known = 0, 0, begin
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size and not (at == 0 and "" in known):
            return -1
        at, n, known = at + size, n + 1, go_on
    return n


def test_against_greedy_matching():
    for seed in range(60):
        r = random.Random(seed)
        text = lambda n: "".join(r.choice("abcé") for _ in range(n))
        begin = {text(r.randint(1, 4)) for _ in range(8)}
        go_on = {text(r.randint(1, 4)) for _ in range(8)} | ({*"abcé"} if seed % 2 else set())
        words = [text(r.randint(1, 14)) for _ in range(80)]
        got = Automaton([MARK + b for b in begin] + sorted(go_on)).counts(pa.array(words)).tolist()
        assert got == [greedy(w, begin, go_on) for w in words]


def test_public_vocabulary_against_greedy_matching():
    pieces = read_pieces(VOCABULARY)
    begin = {p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:]}
    go_on = {p for p in pieces if MARK not in p}
    words = ["the", "tokenization", "éeauxvipa", "Donaudampfschiff", "x" * 300, "日本語", "naïve", "a.b,c!!", "233.233.171.252"]
    assert Automaton(pieces).counts(pa.array(words)).tolist() == [greedy(w, begin, go_on) for w in words]


def test_every_case_has_a_result(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, " \n "), (None, "ab"), (4, "ab cab  zz"), (4, "ab cab  zz"), (5, "ab " * 60_000)]).withColumns({"n_tokens": F.lit(1), "n_words": F.lit(2)})
    got = sorted((x.doc_id or 0, x.n_tokens, x.n_words, x.n_unknown) for x in token_counts(docs, [MARK + "a", MARK + "c", "a", "b"]).collect())
    assert got == [(0, 2, 1, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 6, 3, 1), (4, 6, 3, 1), (5, 120_000, 60_000, 0)]
    assert token_counts(docs.limit(0), ["a"]).count() == 0
