"""Hot groups, short texts, routing between shards, relaxed search and mixes: against brute force on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import canonical, components, cooccurrence, group_splits, leakage, mixing, nearest, packing, spans

PAIR = "pair_row_id bigint, split_name string, source string, prot_hash_a string, prot_hash_b string, ctg_dna_hash_a string, ctg_dna_hash_b string, prot_seq_a string, prot_seq_b string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[k] = rnd.choice("ACDEFGHIKLMNPQRSTVWY")
        elif kind == 1 and len(s) > 1:
            del s[k]
        else:
            s.insert(k, rnd.choice("ACDEFGHIKLMNPQRSTVWY"))
    return "".join(s)


def pair_rows(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (6, 18, 19, 25, 40, 60, 61, 90)]
    pool = base + [mutate(rnd, b, rnd.randrange(1, 4)) for b in base for _ in range(3)] + ["", None]
    rows = []
    for i in range(90):
        a, b = rnd.choice(pool), rnd.choice(pool)
        h = lambda s: rnd.choice([None, None, f"p{s}"]) if s else None
        rows.append((i, rnd.choice(["train", "train", "val", "test", "other"]), rnd.choice(["x", None]), h(a), h(b), rnd.choice([None, "c1", "c2"]), None, a, b))
    return rows


def brute(rows):
    def side(r, s):
        return (r[3 + s], r[5 + s], r[7 + s])

    def alike(x, y):
        if (x[0] and x[0] == y[0]) or (x[1] and x[1] == y[1]):
            return True
        return bool(x[2] and y[2]) and edits(x[2], y[2]) <= int(0.05 * max(len(x[2]), len(y[2])) + 1e-9)

    return {
        (t[0], h[0])
        for t in rows if t[1] == "train" for h in rows if h[1] in ("val", "test")
        if any(alike(side(t, 0), side(h, k)) and alike(side(t, 1), side(h, 1 - k)) for k in (0, 1))
    }


def test_cross_split_pairs_and_report(spark):
    rows = pair_rows(11)
    df = spark.createDataFrame(rows, PAIR)
    want = brute(rows)
    assert len(want) > 10
    assert {(r.train_row, r.held_row) for r in leakage.cross_split_pairs(df).collect()} == want
    report = {(r.split_name, r.source): (r.n_rows, r.n_overlapping, r.n_train_rows) for r in leakage.overlap_report(df).collect()}
    for key, got in report.items():
        mine = [r[0] for r in rows if (r[1], r[2]) == key]
        assert got == (len(mine), len({h for _, h in want if h in mine}), sum(h in mine for _, h in want))
    assert leakage.cross_split_pairs(df.limit(0)).count() == 0
    assert leakage.cross_split_pairs(df.where("split_name = 'train'")).count() == 0


def test_short_sequences_without_hashes_are_found(spark):
    df = spark.createDataFrame([(1, "train", None, None, None, None, None, "MKLV", "MKLVAAAAA"), (2, "test", None, None, None, None, None, "MKLVAAAAA", "MKLV"), (3, "test", None, None, None, None, None, "MKLW", "MKLVAAAAA")], PAIR)
    assert [tuple(r)[:2] for r in leakage.cross_split_pairs(df).collect()] == [(1, 2)]


def test_routing_between_shards_loses_nothing(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rnd.randrange(40, 120))) for _ in range(25)]
    held = list(dict.fromkeys(mutate(rnd, b, rnd.randrange(0, 3)) for b in base for _ in range(3)))
    train = list(dict.fromkeys(mutate(rnd, b, rnd.randrange(0, 4)) for b in base for _ in range(5)))
    df = lambda x: spark.createDataFrame(list(enumerate(x)), "key bigint, text string")
    want = {(i, j) for i, t in enumerate(train) for j, h in enumerate(held) if edits(t, h) <= int(0.05 * max(len(t), len(h)) + 1e-9)}
    for size in (6_000_000, 400):
        got = [(r.train_key, r.held_key) for r in leakage.near_texts(df(train), df(held), shard_chars=size, chunk_chars=2_000).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_minimizers_agree_on_common_blocks():
    rnd = random.Random(3)
    for block in (4, 9, 12, 18):
        common = "".join(rnd.choice("ACDEFG") for _ in range(block))
        a, b = (("".join(rnd.choice("HIKL") for _ in range(30)) + common + "".join(rnd.choice("HIKL") for _ in range(30))).encode() for _ in range(2))
        assert len(np.intersect1d(leakage.minimizers(a, block), leakage.minimizers(b, block)))
    assert len(leakage.minimizers(b"AC", 9)) == 0


def test_hub_cells_are_cut(spark):
    rows = [("hub", f"l{i:04}") for i in range(600)] + [(f"l{i:04}", f"m{i:04}") for i in range(0, 600, 7)] + [("x", "y")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = dict(components.connected_components(df, "a", "b", edges_per_cell=40).collect())
    assert got["x"] == got["y"] == "x" and {got[v] for r in rows[:-1] for v in r} == {"hub"}


def test_cooccurrence_scores_and_bounds(spark):
    rnd = random.Random(5)
    baskets = {f"k{i}": {f"i{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 7))} for i in range(40)}
    df = spark.createDataFrame([(k, i, "extra") for k, v in baskets.items() for i in v], "k string, i string, n_ab string")
    n = {i: sum(i in v for v in baskets.values()) for i in {i for v in baskets.values() for i in v}}
    got = {(r.item_a, r.item_b): r for r in cooccurrence.cooccurrence(df, "k", "i", min_count=2, min_lift=1.2, chunk=3).collect()}
    want = {p: c for p in itertools.combinations(sorted(n), 2) if (c := sum(set(p) <= v for v in baskets.values())) >= 2 and c * 40 >= 1.2 * n[p[0]] * n[p[1]]}
    assert {p: r.n_ab for p, r in got.items()} == want
    for (a, b), r in got.items():
        assert r.lift == pytest.approx(r.n_ab * 40 / (n[a] * n[b]))


def test_relaxed_search_keeps_its_recall(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(300, 32))
    x = np.concatenate([centre + rng.normal(size=centre.shape) * 0.15 for _ in range(4)])
    df = spark.createDataFrame([(f"n{i:04}", [float(v) for v in r], "x") for i, r in enumerate(x)], "id string, e array<double>, name string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {tuple(sorted((f"n{i:04}", f"n{j:04}"))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    found = {tuple(r) for r in nearest.similar_pairs(df, "id", "e").collect()}
    assert len(true & found) >= 0.99 * len(true) and len(found - true) <= 0.01 * len(true)
    asks = df.where("id < 'n0050'").select("id")
    near = nearest.nearest_vectors(df, "id", "e", k=10, factor=0.8, queries=asks).collect()
    hit = sum(r["neighbour"] in {f"n{j:04}" for j in np.argsort(-s[int(r["query"][1:])])[:10]} for r in near)
    assert hit >= 0.9 * 500
    same = spark.createDataFrame([(f"c{i}", [1.0, 2.0]) for i in range(30)] + [("z", [0.0, 0.0]), ("q", None), (None, [1.0, 1.0])], "id string, e array<double>")
    assert nearest.nearest_vectors(same, "id", "e", k=3).groupBy("query").count().where("count = 3").count() == 30


def test_abbreviations_alone_name_nothing(spark):
    terms = spark.createDataFrame([(1, "f", "Chantemerle", None), (2, "f", "Port Asterby", None)], "term_id bigint, field_name string, term string, also_known_as array<string>")
    cases = {"drawer C": 0, "Chant": 0, "P. Asterby": 2, "P. A.": 0, "Prt. Asterbi": 2, "": None}
    df = spark.createDataFrame([("f", k) for k in cases], "field string, value string")
    assert {r.value: r.term_id for r in canonical.map_to_canonical(df, terms).collect()} == {k: v for k, v in cases.items() if v is not None}
    assert {r.term_id for r in canonical.map_to_canonical(df, terms.limit(0)).collect()} == {0}


def test_mix_gives_shortages_to_siblings_first(spark):
    docs = [(i, "d1", "en", "small", 10) for i in range(5)] + [(100 + i, "d1", "en", "big", 10) for i in range(200)] + [(400 + i, "d2", "en", "far", 10) for i in range(200)]
    docs += [(900, "d1", None, "big", 10), (901, "d1", "en", None, 10), (None, "d1", "en", "big", 10), (902, "d1", "en", "big", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, domain string, lang string, source string, n bigint")
    goals = spark.createDataFrame([("small", 0.25, 2), ("big", 0.25, 1), ("far", 0.5, 1), ("absent", 0.3, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    picked, report = mixing.mix_sources(df, "doc_id", "n", goals, ("domain", "lang", "source"), total=1000.0)
    got = {r.source: r for r in report.collect()}
    # small can give 100 of its 250; its sibling takes the other 150, the other domain keeps its half
    assert got["small"].tokens == 100 and got["far"].tokens == 500 and abs(got["big"].tokens - 400) <= 10
    assert got["absent"].tokens == 0 and got["far"].goal_share == pytest.approx(0.5)
    uses = picked.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("e")).collect()
    assert all(r.n == r.e and r.n <= (2 if r.doc_id < 5 else 1) for r in uses)
    again, _ = mixing.mix_sources(df.repartition(3), "doc_id", "n", goals, ("domain", "lang", "source"), total=1000.0)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, picked.collect()), key=str)
    assert mixing.mix_sources(df.limit(0), "doc_id", "n", goals, ("domain", "lang", "source"))[0].count() == 0


def test_many_tiny_items_are_cut_into_shards(spark):
    df = spark.range(900).select("id", F.lit(1).alias("n"))
    kinds = spark.createDataFrame([("k", 100), ("none", None)], "container_kind string, capacity_tokens int")
    out = packing.fill_containers(df, "id", "n", kinds, items_per_shard=100)
    used = out.groupBy("window_id").agg(F.sum("piece_size").alias("u"))
    assert out.count() == 900 and used.agg(F.max("u")).first()[0] <= 100
    assert packing.fill_containers(df.limit(0), "id", "n", kinds).count() == 0


def test_groups_stay_together(spark):
    rows = [(1, "a", "u"), (2, "a", None), (3, None, "u"), (4, None, None), (4, "z", None), (5, "z", "w")]
    df = spark.createDataFrame(rows, "r bigint, x string, key string")
    got = dict(group_splits.record_components(df, "r", [F.col("x"), F.col("key")]).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_boilerplate_in_most_texts(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    boiler = word(240)
    docs = [(i, word(80) + (boiler if i % 3 else "") + word(120)) for i in range(60)] + [(100 + i, "same " * 60) for i in range(3)] + [(200, None), (201, ""), (202, word(150))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("did", F.lit(1))
    grams = {}
    for i, t in docs:
        for k in range(len(t or "") - 199):
            grams.setdefault(t[k : k + 200], set()).add(i)
    want = {p for g in grams.values() for p in itertools.combinations(sorted(g), 2)}
    assert {tuple(r) for r in spans.documents_sharing(df, "doc_id", "text").collect()} == want
    cover = {i: len({p for k in range(len(t or "") - 199) if len(grams[t[k : k + 200]]) > 1 for p in range(k, k + 200)}) for i, t in docs}
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, "doc_id", "text").collect()} == cover
