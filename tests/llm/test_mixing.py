import pytest
from pyspark.sql import functions as F

from sextant.llm.mixing import mixed, source_epochs, with_copies
from sextant.llm.queries import ORACLE, QUERIES
from tests.llm.common import documents
from tests.oracle import assert_same


def test_sql(spark, sf_dir):
    assert_same(spark, QUERIES["op8_source_mixing"], ORACLE["op8_source_mixing"], sf_dir)


def filled(chars, weight, most, budget):
    """Clamps and redistributes until nothing is above its cap."""
    left, open_, out = budget, {s for s in chars if chars[s] and weight[s]}, dict.fromkeys(chars, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * chars[s]]
        if not over:
            return out | {s: left * weight[s] / total / chars[s] for s in open_}
        for s in over:
            out[s] = most
            open_.discard(s)
        left -= sum(most * chars[s] for s in over)
    return out


@pytest.mark.parametrize("sizes,weights,most,budget", [
    ({"a": 100, "b": 100, "c": 800}, {"a": 5.0, "b": 1.0}, 2.0, None),
    ({"a": 10, "b": 20, "c": 30, "d": 1000}, {"a": 8.0, "b": 4.0, "c": 2.0}, 1.5, None),
    ({"a": 10, "b": 20}, {}, 1.0, 1000.0),
    ({"a": 10, "b": 20, "c": 0}, {"b": 0.0}, 3.0, 12.0),
    ({"a": 50, "b": 50, "c": 50}, {}, 2.0, None),
])
def test_against_repeated_clamping(spark, sizes, weights, most, budget):
    docs = documents(spark, [(i, "x" * n, s) for i, (s, n) in enumerate(sizes.items())])
    got = {x.source: x.epochs for x in source_epochs(docs, weights, 1.0, most, budget).collect()}
    want = filled(sizes, {s: weights.get(s, 1.0) for s in sizes}, most, budget if budget is not None else float(sum(sizes.values())))
    assert got == pytest.approx(want)


def test_copies_follow_epochs_and_the_mix_its_weights(spark):
    docs = documents(spark, [(i, "x" * 20, "a" if i % 10 == 0 else "b") for i in range(4000)])
    rows = mixed(docs, weights={"a": 1.0, "b": 3.0}, max_epochs=3.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in rows}
    assert n["a"] == pytest.approx(1000, rel=0.1) and n["b"] == pytest.approx(3000, rel=0.05)
    assert all(0 <= r.copies <= 3 for r in with_copies(docs, weights={"a": 99.0}, max_epochs=3.0).select("copies").distinct().collect())


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, "x" * 10, None), (2, None, None), (None, "y" * 10, "b"), (None, "y" * 10, "b"), (3, "", "c"), (4, "z" * 100_000, "d")]
    docs = documents(spark, rows).withColumns({"copies": F.lit("x"), "mix_copy": F.lit(1), "mix_source": F.lit(2), "mix_epochs": F.lit(3), "epochs": F.lit(4), "weight": F.lit(5)})
    got = with_copies(docs)
    assert got.columns == [*(c for c in docs.columns if c != "copies"), "copies"] and got.count() == len(rows)
    copies = {(x.doc_id, x.source): x.copies for x in got.collect()}
    assert copies[3, "c"] == 0
    out = mixed(docs)
    assert out.columns == [c for c in docs.columns if c != "copies"] and out.where("mix_copy <> 1").count() == 0
    assert out.count() == sum(x.copies for x in got.collect())
    assert mixed(docs.limit(0)).count() == 0 and with_copies(docs.limit(0)).count() == 0
