import random

from pyspark.sql import functions as F

from sextant.llm.packing import pack, pack_documents
from tests.llm.common import documents


def plain(sizes, capacity):
    """The same rules with lists scanned from end to end."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    large = [i for i in order if 3 * sizes[i] > capacity]
    out, room, made, stack = {}, [], 0, []
    left = list(large)
    while left:
        i = left.pop(0)
        out[i], space = made, capacity - sizes[i]
        mate = next((j for j in left if sizes[j] <= space), None)
        if mate is not None:
            left.remove(mate)
            out[mate] = made
            space -= sizes[mate]
        stack.append((space, made))
        made += 1
    for i in order[len(large) :]:
        fits = [(s, -k, b) for k, (s, b) in enumerate(stack) if s >= sizes[i]]
        if fits:
            s, k, b = min(fits)
            stack.pop(-k)
        else:
            s, b, made = capacity, made, made + 1
        out[i] = b
        stack.append((s - sizes[i], b))
    return [out[i] for i in range(len(sizes))]


def test_pack_against_scanning():
    for seed in range(300):
        r = random.Random(seed)
        cap = r.choice([10, 30, 100])
        sizes = [r.randint(1, cap) for _ in range(r.randint(0, 40))]
        got = pack(sizes, cap)
        assert got == plain(sizes, cap)
        for b in set(got):
            inside = [s for s, x in zip(sizes, got) if x == b]
            assert sum(inside) <= cap and sum(3 * s > cap for s in inside) <= 2


def test_pieces_cover_each_text_and_bins_hold(spark):
    rows = [(i, "x" * n) for i, n in enumerate([1, 99, 100, 101, 200, 350, 30, 30, 30, 70, 60, 40])] + [(None, "y" * 120), (50, None), (51, ""), (52, "z" * 70_000)] + [(53, "same")] * 3
    docs = documents(spark, rows).withColumns({"piece": F.lit("p"), "size": F.lit(1), "shard": F.lit(2), "hash_": F.lit(0), "copy_": F.lit(0)})
    for shard_pieces in (50_000, 40):
        got = pack_documents(docs, 100, shard_pieces).collect()
        by = {}
        for x in got:
            by.setdefault(x.doc_id, []).append(x)
        for i, t in rows:
            if t and i != 53:
                spans = sorted((x.first_char, x.n_chars) for x in by[i])
                assert [a for a, _ in spans] == list(range(0, len(t), 100)) and sum(n for _, n in spans) == len(t)
        assert len(by[53]) == 3 and 50 not in by and 51 not in by
        bins = {}
        for x in got:
            bins[x.bin_id] = bins.get(x.bin_id, 0) + x.n_chars
        assert max(bins.values()) <= 100
    assert pack_documents(docs.limit(0)).count() == 0


def test_same_rows_in_any_order_give_the_same_bins(spark):
    rows = [(i, "x" * (i % 90 + 1)) for i in range(500)]
    a = pack_documents(documents(spark, rows), 100, 100)
    b = pack_documents(documents(spark, rows[::-1]).repartition(7), 100, 100)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
