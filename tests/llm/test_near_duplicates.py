import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import near_duplicates as nd
from sextant.llm.smallworld import SmallWorld, exact_within, searched
from tests.llm.common import documents, words


def jaccard(a, b):
    x, y = ({*zip(t.lower().split(), t.lower().split()[1:])} or {(t.lower(),)} for t in (a, b))
    return len(x & y) / len(x | y)


def groups(texts, least):
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (texts[i].lower().split() == texts[j].lower().split() or jaccard(texts[i], texts[j]) >= least):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def corpus(seed, families=30):
    r, out, n = random.Random(seed), {}, 0
    for f in range(families):
        base = words(1000 * seed + f, r.choice([12, 60, 300]))
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for k in range(len(w)):
                if r.random() < 0.04:
                    w[k] = words(n * 7919 + k, 1)[0]
            out[n] = " ".join(w)
            n += 1
    return out


@pytest.mark.parametrize("shard_rows", [nd.SHARD_ROWS, 25])
def test_pairs_of_brute_force_are_found(spark, shard_rows):
    texts = corpus(1)
    want = groups(texts, nd.SIMILARITY)
    got = {x.doc_id: x.group_id for x in nd.near_duplicates(documents(spark, list(texts.items())), shard_rows=shard_rows).collect()}
    pairs = [(i, j) for i in texts for j in texts if i < j and want[i] == want[j]]
    found = [got.get(i, -1) == got.get(j, -2) for i, j in pairs]
    assert len(pairs) > 30 and np.mean(found) >= (0.99 if shard_rows > 1000 else 0.9)
    assert all(want[i] == want[g] for i, g in got.items())


def pairs_of(search):
    out = set()
    search(lambda q, node: out.update(zip(q.tolist(), node.tolist())))
    return out


def planted_codes():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (400, 2), dtype=np.uint64)
    near = np.repeat(base, 5, axis=0)
    for _ in range(6):
        near[np.arange(len(near)), r.integers(0, 2, len(near))] ^= np.uint64(1) << r.integers(0, 63, len(near), dtype=np.uint64)
    return np.unique(np.concatenate([near, r.integers(0, 1 << 63, (1000, 2), dtype=np.uint64)]), axis=0)


@pytest.mark.parametrize("foreign", [False, True])
def test_graph_search_against_looking_at_all(foreign):
    codes = planted_codes()
    queries = codes[::2] if foreign else codes
    recall = []
    got = pairs_of(lambda f: recall.append(searched(codes, queries, 14, f)))
    true = pairs_of(lambda f: exact_within(codes, queries, 14, f))
    assert got <= true and len(got) >= 0.95 * len(true) and recall[0] >= 0.95
    want = np.argwhere(np.bitwise_count(queries[:, None] ^ codes[None]).sum(2) <= 14)
    assert true == {(i, j) for i, j in want.tolist()}


def test_a_graph_that_no_link_holds_together_is_searched_exactly():
    codes, link = planted_codes(), SmallWorld._link
    SmallWorld._link = lambda *_: None
    try:
        got = pairs_of(lambda f: searched(codes, codes, 14, f))
    finally:
        SmallWorld._link = link
    assert got == pairs_of(lambda f: exact_within(codes, codes, 14, f))


def edited(seed, n, share):
    """Two texts of n words, the second with a share of its words replaced, never two neighbours."""
    w = words(seed, n)
    v = list(w)
    for k in random.Random(seed).sample(range(n // 2), int(share * n)):
        v[2 * k] = f"q{seed}x{k}"
    return " ".join(w), " ".join(v)


@pytest.mark.parametrize("shard_rows", [nd.SHARD_ROWS, 25])
def test_pairs_of_two_are_found_in_every_band_of_similarity(spark, shard_rows):
    texts, bands = {}, {}
    for k in range(900):
        a, b = edited(50_000 + k, 80, (0.06, 0.09, 0.115)[k % 3])
        s = jaccard(a, b)
        if s >= nd.SIMILARITY:
            texts[2 * k], texts[2 * k + 1] = a, b
            bands.setdefault(min(int(s * 20), 14), []).append(k)
    got = {x.doc_id: x.group_id for x in nd.near_duplicates(documents(spark, list(texts.items())), shard_rows=shard_rows).collect()}
    assert set(bands) >= {12, 13, 14}
    for ks in bands.values():
        assert np.mean([got.get(2 * k, -1) == got.get(2 * k + 1, -2) for k in ks]) >= 0.99
    assert all(i // 2 == g // 2 for i, g in got.items())


def test_a_route_that_many_share_loses_no_pair(spark):
    """All texts share most of what they say, so that every route is cut into several graphs, and twenty pairs are alike beyond that."""
    base, texts = words(3, 60), {}
    for i in range(150):
        w = list(base)
        for x in random.Random(i % 130).sample(range(30), 11):
            w[2 * x] = f"d{i % 130}x{x}"
        if i >= 130:
            w[1] = f"e{i}"
        texts[i] = " ".join(w)
    pairs = [(i, i + 130) for i in range(20)]
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in pairs)
    got = {x.doc_id: x.group_id for x in nd.near_duplicates(documents(spark, list(texts.items())), shard_rows=40).collect()}
    assert {i: got.get(i, i) for i in texts} == groups(texts, nd.SIMILARITY)


def test_what_a_pool_lets_go_is_joined_by_what_it_keeps():
    r, n = np.random.default_rng(6), 120
    sketch = np.tile(r.integers(1, 200, nd.SKETCH).astype(np.uint8), (n, 1))
    for k in range(n):
        sketch[k, r.permutation(nd.SKETCH)[: (8, 20, 60)[k % 3]]] = 201 + k % 50
    a, b = np.triu_indices(n, 1)
    big, small = nd.Pool(sketch, 0.6), nd.Pool(sketch, 0.6, 200)
    for i in range(0, len(a), 500):
        for pool in (big, small):
            pool.add(b[i : i + 500], a[i : i + 500])
    (x, y), (u, v) = big.edges(), small.edges()
    assert len(u) < len(x)
    est, used = nd.estimated(sketch[x], sketch[y])
    sure = est >= 0.6 + 4 * np.sqrt(0.24 / used)
    label = nd.min_labels(x[sure], y[sure], n)
    kept = {*zip(u.tolist(), v.tolist())}
    assert all((i, j) in kept for i, j in zip(x[~sure].tolist(), y[~sure].tolist()) if label[i] != label[j])
    e2, u2 = nd.estimated(sketch[u], sketch[v])
    again = e2 >= 0.6 + 4 * np.sqrt(0.24 / u2)
    assert (nd.min_labels(u[again], v[again], n) == label).all()


def test_more_copies_than_a_beam_holds_are_one_group(spark):
    base = words(4, 80)
    rows = [(i, " ".join(base[:70] + [f"w{i}"] + base[70:])) for i in range(300)]
    got = nd.near_duplicates(documents(spark, rows))
    assert got.count() == 300 and got.where("group_id = 0").count() == 300 and got.where("keep").count() == 1


def test_an_edge_to_something_else_does_not_stand_in_for_one_between_copies():
    sketch = np.zeros((3, nd.SKETCH), np.uint8)
    sketch[0] = sketch[1] = np.arange(nd.SKETCH) % 200 + 1
    sketch[1, ::4] = 250
    sketch[2] = 210
    keep = nd.likely(np.array([0, 1, 0]), np.array([2, 2, 1]), sketch, 3, 0.6)
    assert keep.tolist() == [2]


def test_sketches_estimate_the_overlap():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 63, 1400, dtype=np.uint64)
    s = nd.sketches(np.concatenate([x[:1200], x[200:]]), np.array([0, 1200, 2400]))
    est, used = nd.estimated(s[:1], s[1:])
    assert used[0] == nd.SKETCH and abs(est[0] - 1000 / 1400) < 0.2


def test_nulls_blank_and_long_texts_repeats_extra_columns_and_empty_tables(spark):
    long = " ".join(words(8, 40_000))
    rows = [(5, long), (3, long.upper().replace(" ", "  ")), (3, long), (None, long), (7, None), (8, ""), (9, " \n "), (10, ""), (11, "one"), (12, "ONE "), (13, "two")]
    docs = documents(spark, rows).withColumns({"rep": F.lit(1), "grams": F.lit(2), "group_id": F.lit(3), "routes": F.lit(5), "n_links": F.lit(6), "gone_": F.lit(4), "keep": F.lit(False)})
    got = sorted(tuple(x) for x in nd.near_duplicates(docs).collect())
    assert got == [(3, 3, 1, True), (5, 3, 1, False), (11, 11, 1, True), (12, 11, 1, False)]
    rest = nd.without_near_duplicates(docs)
    assert rest.columns == docs.columns
    assert sorted((x.doc_id or 0) for x in rest.collect()) == [0, 3, 3, 7, 8, 9, 10, 11, 13]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_a_copy_whose_family_looks_more_alike_by_sketch_is_left_for_verification():
    r, n = np.random.default_rng(4), 40
    sketch = np.tile(np.arange(nd.SKETCH, dtype=np.uint8) % 200 + 1, (n, 1))
    for k in range(n):  # any two agree in about 0.66 to 0.8 of the buckets, the true pair in 0.62
        sketch[k, r.permutation(nd.SKETCH)[:18]] = 201 + k
    sketch[1, :24], sketch[0, 24:48] = 250, 251
    a, b = np.triu_indices(n, 1)
    keep, left = nd.narrowed(a, b, sketch, n, 0.6)
    est, used = nd.estimated(sketch[a], sketch[b])
    unsure = np.flatnonzero((est >= 0.6 - 4 * np.sqrt(0.24 / used)) & (est < 0.6 + 4 * np.sqrt(0.24 / used)))
    assert not ((a[keep] == 0) & (b[keep] == 1)).any() and ((a[left] == 0) & (b[left] == 1)).any()
    assert len(np.intersect1d(keep, left)) == 0 and {*unsure.tolist()} <= {*keep.tolist(), *left.tolist()}


def test_all_that_the_forests_leave_is_verified(spark):
    base, texts, r = words(77, 60), {}, random.Random(8)
    for i in range(40):
        w = list(base)
        for x in r.sample(range(60), r.choice([2, 4, 6])):
            w[x] = f"d{i}x{x}"
        texts[i] = " ".join(w)
    pairs = [(i, j) for i in texts for j in texts if i < j]
    good = {(i, j) for i, j in pairs if jaccard(texts[i], texts[j]) >= nd.SIMILARITY}
    first = sorted(good)[:3]
    docs = documents(spark, [*texts.items(), (7, "another text under one id"), (7, "")])
    rest = spark.createDataFrame([(i, j, k) for i, j in pairs for k in (0, 1)], "a long, b long, shard long")
    for part_edges in (nd.PART_EDGES, 100):
        got = [tuple(x) for x in nd.verified_rest(docs, rest, spark.createDataFrame(first, "a long, b long"), part_edges=part_edges).collect()]
        assert 0 < len(good) < len(pairs) and {*got} <= good
        label = lambda edges: nd.min_labels(*np.array(sorted(edges)).T, 40).tolist()
        assert label([*first, *got]) == label(good)


def test_parts_cover_a_column_and_stay_within_their_bytes():
    import pyarrow as pa

    from sextant.llm.words import cuts

    r = random.Random(5)
    texts = pa.array([r.choice([None, "", "x" * r.randint(1, 90), "y" * 700]) for _ in range(300)])
    for column in (texts, texts.slice(13, 200), texts.slice(0, 0)):
        got = list(cuts(column, 200, 7))
        assert [k for i, j in got for k in range(i, j)] == list(range(len(column)))
        sizes = [[len(x or "") for x in column.slice(i, j - i).to_pylist()] for i, j in got]
        assert all(len(s) <= 7 and (sum(s) <= 200 or len(s) == 1) for s in sizes)
