import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import canonical, components, cooccurrence, group_splits, leakage, mixing, nearest, packing, spans


def test_components_in_many_cells(spark):
    rnd = random.Random(1)
    rows = [(f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}") for _ in range(50)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(80)] + [(None, "lone"), ("s", "s")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(rows, "a string, b string")
    assert dict(components.connected_components(df, "a", "b", edges_per_cell=20).collect()) == {x: find(x) for x in parent}
    assert components.connected_components(df.limit(0), "a", "b").count() == 0


def test_cooccurrence_blocks_equal_plain(spark):
    rnd = random.Random(2)
    baskets = {f"k{i}": {f"i{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 10))} for i in range(15)}
    df = spark.createDataFrame([(k, i) for k, v in baskets.items() for i in v for _ in range(2)] + [(None, "i1"), ("k1", None)], "k string, i string")
    want = {}
    for v in baskets.values():
        for p in itertools.combinations(sorted(v), 2):
            want[p] = want.get(p, 0) + 1
    for chunk in (2, 48):
        got = {(r.item_a, r.item_b): r.n_ab for r in cooccurrence.cooccurrence(df, "k", "i", chunk=chunk).collect()}
        assert got == want


def test_paths_and_differencing(spark):
    df = spark.createDataFrame([("a//b/./c",), ("a/x/../b/c",), ("./a/b/c",), (" ",), (None,)], "p string")
    assert [r[0] for r in df.select(group_splits.normalized_path("p")).collect()] == ["a/b/c"] * 3 + [None] * 2
    w = np.array([8, 7, 6, 5, 4])
    sums = np.bincount(group_splits.differencing(w, 2), w)
    assert abs(sums[0] - sums[1]) <= 2
    m = spark.range(1000).select((F.col("id") % 100).alias("c"))
    t = spark.createDataFrame([("train", 0.7), ("val", 0.1), ("test", 0.2)], "split_name string, target_share double")
    out = group_splits.assign_splits(m, "c", t, per_group=10, bins=20, fan_in=3)
    assert out.count() == 100 and dict(out.groupBy("split_name").agg(F.sum("n_records")).collect())["train"] == 700


def test_canonical(spark):
    terms = spark.createDataFrame([(1, "f", "North Korrin", ["Upper Korrin"]), (2, "f", "Egg passage 1", ["E1"]), (3, "f", "Egg passage 2", None)], "term_id bigint, field_name string, term string, also_known_as array<string>")
    cases = {"N. Korrin": 1, "Korrin, North": 1, "NorthKorrin": 1, "Nörth Kori": 1, "upper korrin": 1, "egg pass. 2": 3, "e1": 2, "Egg passage 7": 0, "Elsewhere": 0}
    df = spark.createDataFrame([("f", k) for k in cases] + [("f", " "), ("f", None)], "field string, value string")
    assert {r.value: r.term_id for r in canonical.map_to_canonical(df, terms).collect()} == cases


def test_nearest_is_exact_with_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    df = spark.createDataFrame([(f"n{i}", [float(v) for v in r]) for i, r in enumerate(x)] + [("zero", [0.0] * 8), ("null", None)], "id string, e array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in nearest.nearest_vectors(df, "id", "e", k=3, per_shard=40).collect():
        got.setdefault(r["query"], set()).add(r["neighbour"])
    assert got == {f"n{i}": {f"n{j}" for j in np.argsort(-s[i])[:3]} for i in range(200)}


def test_fm_index_and_edits():
    fm = leakage.FMIndex([b"MISSISSIPPI", b"PIPPI"])
    q = fm.code[np.frombuffer(b"IPPI", np.uint8)]
    at, lo, hi = fm.search(q, np.array([3]), 4)
    assert sorted(fm.sa[lo[0] : hi[0]]) == [7, 13]
    m = leakage.near_matches([b"A" * 20 + b"CDEFGHIKLMNPQRSTVWYACDEFGHIK"], [b"A" * 20 + b"CDEFGHIKLMNPQRSTVWACDEFGHIK", b"Y" * 47], 0.05)
    assert m["h"].tolist() == [0] and m["edits"].tolist() == [1]


def test_packing():
    sizes = np.random.default_rng(4).integers(1, 100, 300)
    used = np.bincount(packing.pack_items(sizes, 128), sizes)
    assert used.max() <= 128 and used.sum() == sizes.sum() and used.mean() > 115


def test_containers_split_only_what_is_too_large(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 0), (4, None)], "id bigint, n bigint")
    c = spark.createDataFrame([("k", 10)], "container_kind string, capacity_tokens int")
    got = sorted((r.item_id, r.piece, r.piece_start, r.piece_size) for r in packing.fill_containers(df, "id", "n", c).collect())
    assert got == [(1, 1, 0, 10), (2, 1, 0, 10), (2, 2, 10, 10), (2, 3, 20, 5)]


def test_budgets():
    tree = {("a", "x"): ((1.0, 1.0), 10.0), ("a", "y"): ((1.0, 1.0), 100.0), ("b", "x"): ((1.0, 1.0), 20.0)}
    got = mixing.budgets(tree, 80.0)
    assert got[("a", "x")] == 10 and got[("b", "x")] == 20 and got[("a", "y")] == pytest.approx(50)


def test_spans_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh \né") for _ in range(n))
    common = [word(n) for n in (199, 200, 260, 400)]
    docs = [(i, word(rnd.randrange(50)) + rnd.choice(common) + word(rnd.randrange(300))) for i in range(40)] + [(100, None), (101, ""), (102, "a" * 500), (103, "a" * 400)]
    docs.append((104, docs[0][1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    grams = {}
    for i, t in docs:
        for k in range(len(t or "") - 199):
            grams.setdefault(t[k : k + 200], set()).add(i)
    want = {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}
    assert {tuple(r) for r in spans.documents_sharing(df, "doc_id", "text").collect()} == want
    assert spans.shared_share(df, "doc_id", "text").count() == len(docs)


def test_shared_chars_against_brute_force(spark):
    docs = []
    for seed in (1, 4809, 19712):  # 19712: the last run of tokens ends 83 code points before the common stretch does
        rnd = random.Random(seed)
        word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        common = word(330)
        docs += [(2 * seed + j, word(60) + common + word(60)) for j in (0, 1)]
    grams = {}
    for i, t in docs:
        for k in range(len(t) - 199):
            grams.setdefault(t[k : k + 200], set()).add(i)
    want = {i: len({p for k in range(len(t) - 199) if len(grams[t[k : k + 200]]) > 1 for p in range(k, k + 200)}) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(df, "doc_id", "text").collect()}
    assert sum(got[i] != want[i] for i in want) == 0
