"""Split builds, negatives, clustering, joins of hot groups, and the bookkeeping around them."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom import config, scratch
from seqloom.checks import DataCheckError
from seqloom.functions import sequences
from seqloom.functions.metadata import regime
from seqloom.operators import aggregates, audits, builds, clustering, dedup, graph, joins, models, vectors
from seqloom.schema import REGIMES


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([("h", i) for i in range(40)] + [("c", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("h", i) for i in range(30)] + [("c", 5), (None, 6)], "k string, y int")
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    assert sorted(tuple(r) for r in scratch.spread_join(left, right, "k", per=7).select("k", "x", "y").collect()) == want
    one = right.groupBy("k").agg(F.max("y").alias("y"))
    assert scratch.skew_join(left, one, "k", hot_rows=5).count() == 41
    assert scratch.skew_join(left, one, "k", "left", hot_rows=5).count() == 42


def test_pairs_within_blocks(spark):
    rows = [("g", f"i{i:03}") for i in range(50)] + [("s", "a"), ("s", "b"), ("t", "a"), (None, "x"), (None, "y"), ("u", None)]
    df = spark.createDataFrame(rows, "g string, i string")
    got = [tuple(r) for r in scratch.pairs_within(df, "g", "i", per=8).collect()]
    want = {("g", f"i{a:03}", f"i{b:03}") for a, b in itertools.combinations(range(50), 2)} | {("s", "a", "b")}
    assert len(got) == len(want) and set(got) == want
    assert scratch.pairs_within(df.limit(0), "g", "i").count() == 0


def cells_of(rnd, n):
    v = lambda *x: rnd.choice([*x, None])
    return [(f"i{i}", v("Human", "Duck"), v("H1N1", "H3N2"), v("2016-2020", "2021+")) for i in range(n)]


def with_cells(spark, rows):
    df = spark.createDataFrame(rows, "assembly_id string, host string, hn_subtype string, year string")
    return df.select("assembly_id", F.struct("host", "hn_subtype", "year").alias("cell"))


def test_supply_equals_counting_pairs(spark):
    cells = with_cells(spark, cells_of(random.Random(1), 40))
    a, b = cells.toDF("p", "a"), cells.toDF("q", "b")
    want = dict.fromkeys(REGIMES, 0) | {r[0]: r[1] for r in a.crossJoin(b).where("p <> q").groupBy(regime("a", "b")).count().collect()}
    assert {r.regime: r.n_available for r in aggregates.regime_supply(cells).collect()} == want
    assert aggregates.regime_supply(cells.limit(0), ["assembly_id"]).count() == 0


def test_allocation_redistributes():
    supply = {"host_only": 5, "year_only": 100, "none_match": 1000}
    got = builds.allocate({"host_only": 0.5, "year_only": 0.25, "none_match": 0.25}, 100, supply)
    assert got["host_only"] == 5 and sum(got.values()) == 100 and abs(got["year_only"] - got["none_match"]) <= 1
    assert sum(builds.allocate({"host_only": 1.0}, 10, supply).values()) == 10
    assert sum(builds.allocate({"host_only": 1.0}, 10, {"host_only": 3}).values()) == 3
    assert sum(builds.allocate({}, 7, {"none_match": 20}).values()) == 7


def test_regime_negatives_go_on_until_supply_ends(spark):
    rnd = random.Random(4)
    rows = cells_of(rnd, 12)
    cell = with_cells(spark, rows)
    pool = spark.createDataFrame([("g", f"i{i}", f"a{i % 5}", f"b{i % 4}") for i in range(12)], "g string, assembly_id string, prot_hash_a string, prot_hash_b string").join(cell, "assembly_id")
    observed = pool.select(F.concat_ws("__", "prot_hash_a", "prot_hash_b").alias("pair_key"))
    need = spark.createDataFrame([("g", r, 1000) for r in REGIMES], "g string, regime string, need bigint")
    got = builds.regime_negatives(pool, "g", need, observed, first_step=1).collect()
    seen = {r[0] for r in observed.collect()}
    every = {f"a{i % 5}__b{j % 4}" for i in range(12) for j in range(12) if i != j} - seen
    assert {r.pair_key for r in got} == every and len(got) == len(every)
    by = {r[0]: r[1:] for r in rows}
    for r in got:
        same = [x is not None and x == y for x, y in zip(by[r.assembly_id_a], by[r.assembly_id_b])]
        assert r.metadata_match_count == sum(same) and (r.neg_regime == "none_match") == (not any(same))
    few = builds.regime_negatives(pool, "g", need.where("regime = 'none_match'").withColumn("need", F.lit(2)), observed)
    assert few.count() == 2
    cover = builds.covering_negatives(pool, "g", observed, first_step=1)
    free_a = {k.split("__")[0] for k in every}
    assert {r.prot_hash_a for r in cover.collect()} >= free_a and not {r.pair_key for r in cover.collect()} & seen


def test_regime_negatives_do_not_pair_all_cells(spark, monkeypatch):
    rows = [("g", f"i{i:03}", f"a{i}", f"b{i}", (f"host{i % 20}", f"H{i}", str(i // 20))) for i in range(300)]
    pool = spark.createDataFrame(rows, "g string, assembly_id string, prot_hash_a string, prot_hash_b string, cell struct<host: string, hn_subtype: string, year: string>")
    observed = spark.createDataFrame([(f"a{i}__b{i}",) for i in range(300)], "pair_key string")
    need = spark.createDataFrame([("g", "none_match", 6), ("g", "host_only", 5), ("g", "year_only", 7), ("g", "subtype_only", 3)], "g string, regime string, need bigint")
    written, real = [], builds.materialize
    monkeypatch.setattr(builds, "materialize", lambda df: written.append(scratch.rows_of(out := real(df))) or out)
    got = builds.regime_negatives(pool, "g", need, observed)
    assert {r.neg_regime: r["count"] for r in got.groupBy("neg_regime").count().collect()} == {"none_match": 6, "host_only": 5, "year_only": 7}
    assert max(written) <= 4 * 300  # all cells with each other are 90,000
    one = builds.regime_negatives(pool, "g", need.where("regime = 'host_only'").withColumn("need", F.lit(10_000)), observed)
    assert one.count() == 300 * 14 and one.select("pair_key").distinct().count() == 300 * 14


def test_split_dataset_keeps_its_rules(spark):
    fa, fb = "A", "B"
    rows = [(f"{g}{i}.gto", f"{g}{i}", f"{g}{i}.{f}", f, f"{f.lower()}{g}{i % 6 if f == fa else i // 2 % 4}") for g in "wxyz" for i in range(9) for f in (fa, fb)]
    rec = spark.createDataFrame(rows + [("q.gto", None, "q", fa, "aq"), ("r.gto", "r", "r", fa, None)], "file string, assembly_id string, brc_fea_id string, function string, prot_hash string")
    clusters = rec.where("prot_hash is not null").select(F.col("prot_hash").alias("hash")).distinct().withColumn("cluster_id", F.col("hash"))
    cells = rec.where("assembly_id is not null").select("assembly_id").distinct().withColumn("cell", F.struct(F.lit("Human").alias("host"), F.lit(None).cast("string").alias("hn_subtype"), F.substring("assembly_id", 2, 1).alias("year")))
    d = scratch.materialize(builds.split_dataset(rec, fa, fb, clusters, cells, shares={"train": 0.5, "test": 0.5}))
    assert d.where("label = 1").select("split").distinct().count() == 2 and d.where("label = 0").count() > 0
    atoms = builds.assign_atoms(builds.build_positives(rec, fa, fb, clusters)[0].drop("cluster_id_a", "cluster_id_b", "cc_id"), clusters)
    assert builds.atoms_apart(builds.partition(atoms, "holdout"), "cc_id", "split").count() == 0
    bad = d.unionByName(d.limit(1).withColumn("split", F.lit("other")))
    with pytest.raises(DataCheckError):
        builds.check_split_dataset(bad, d.limit(0))
    for arm in ("kfold", "matched", "random", "leave_out"):
        assert builds.partition(atoms, arm, k=2).count() == atoms.count()
    with pytest.raises(ValueError):
        builds.partition(atoms, "none")
    with pytest.raises(DataCheckError):
        builds.cluster_folds(atoms, 2, min_test=0.9)


def test_clustering_by_order_of_length(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    core = word(120)
    near = core[:60] + ("A" if core[60] != "A" else "C") + core[61:]
    rows = [("h1", core), ("h2", near), ("h3", core[:117]), ("h4", word(120)), ("h5", None), ("h1", core), ("h6", core[:40])]
    df = spark.createDataFrame(rows, "hash string, seq string")
    for method in ("greedy", "connected"):
        for links in ("linear", "all"):
            got = {r.hash: (r.cluster_rep, r.cluster_id) for r in clustering.cluster_sequences(df, method=method, links=links).collect()}
            assert got == {"h1": ("h1", "C_0"), "h2": ("h1", "C_0"), "h3": ("h1", "C_0"), "h4": ("h4", "C_1"), "h6": ("h6", "C_2")}
    hits = {(r.query, r.target) for r in clustering.search(df).collect()}
    assert hits == {("h1", "h2"), ("h1", "h3"), ("h2", "h3")}
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "query string, target string")
    nodes = spark.createDataFrame([(x, n) for x, n in zip("abcd", (4, 9, 3, 2))], "hash string, n int")
    assert dict(clustering.greedy_representatives(nodes, chain).collect()) == {"a": "b", "b": "b", "c": "b", "d": "d"}
    assert clustering.cluster_functions(df.withColumn("function", F.lit("f")), ["none"], [0.9]).count() == 0


def test_search_is_complete_without_pairs_of_common_pieces(spark, monkeypatch):
    rnd = random.Random(8)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))

    def edited(text, n):
        for _ in range(n):
            i, new = rnd.randrange(len(text)), rnd.choice(letters)
            text = rnd.choice((text[:i] + new + text[i + 1 :], text[:i] + text[i + 1 :], text[:i] + new + text[i:]))
        return text

    mark = word(12)
    core = [word(60) + mark + word(70) for _ in range(150)]
    near = [edited(c, n) for c in core[:8] for n in (1, 4, 7, 8)]
    short = [edited(c, n) for c in (word(19), word(21), word(39), word(41), "\U0001d49c" * 30) for n in (0, 0, 1, 2)] + ["ACD", "ACD", "", ""]
    rows = [(f"h{i:03}", x) for i, x in enumerate(core + near + short)]
    met, real = [], clustering.verified
    monkeypatch.setattr(clustering, "verified", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    got = {(r.query, r.target): (r.fident, r.qcov, r.tcov) for r in clustering.search(spark.createDataFrame(rows, "hash string, seq string"), m=1_000).collect()}
    x = spark.createDataFrame([(a, b, p, q) for (a, p), (b, q) in itertools.combinations(rows, 2)], "a string, b string, p string, q string")
    n, k = F.greatest(F.length("p"), F.length("q")), F.least(F.length("p"), F.length("q"))
    every = x.where((k > 0) & (k >= 0.95 * n)).withColumn("i", 1 - F.levenshtein("p", "q") / n).where("i >= 0.95 - 1e-12")
    assert got == {(r.a, r.b): (r.i, r.u, r.v) for r in every.select("a", "b", "i", (k / F.length("p")).alias("u"), (k / F.length("q")).alias("v")).collect()}
    assert len(got) > 30 and met[0] < 3 * len(got)  # the shared mark alone would make 11,175 pairs


def test_large_graphs_contract_before_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "ONE_TASK", 5)
    rows = [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)] + [("x", "y")]
    got = dict(graph.components(spark.createDataFrame(rows, "src string, dst string")).collect())
    assert {got[f"n{i:02}"] for i in range(31)} == {"n00"} and got["y"] == "x"


def test_kmers_in_batches(spark):
    df = spark.createDataFrame([("a", "acgNACG"), ("a", "ACG"), ("b", None), ("c", "AC"), (None, "ACGT")], "k string, s string")
    got = {(r.k, r.kmer): r.n for r in sequences.kmer_counts(df.where("k is not null"), "k", "s", 3).collect()}
    assert got == {("a", "ACG"): 3}
    f = {r.k: r.features for r in sequences.kmer_features(df, "k", "s", 3, norm="l1").collect()}
    assert f == {"a": {6: 1.0}, "b": {}, "c": {}}
    index, matrix = sequences.kmer_store(spark.createDataFrame([("x", "MKV"), ("y", " mkv "), ("z", None)], "k string, s string"), "k", "s", 2, "aa")
    assert index.count() == 2 and matrix.count() == 1
    assert joins.kmer_bridge(spark.createDataFrame([("x",), ("q",), (None,)], "k string"), index, matrix, "k").count() == 1


def test_dna_filter_and_codes(spark):
    df = spark.createDataFrame([(1, "ACGN"), (2, "ACGT"), (3, None), (4, "")], "i int, s string")
    kept, out = sequences.clean_dna(df, "s", 0.2)
    assert {r.i for r in kept.collect()} == {2, 3, 4} and [(r.i, r.ambig_frac) for r in out.collect()] == [(1, 0.25)]
    r = df.where("i = 1").select(sequences.encode_codes("s", 6, 0).alias("c")).first()
    assert r.c == [65, 67, 71, 78, 0, 0]


def test_duplicate_chains(spark):
    rows = [("GCA_1", "i", "f1", "HA", "MK", "c2"), ("GCF_1", "i", "f2", "HA", "MK", "c1"), ("GCA_1", "i", "f3", "HA", "MV", "c1"), ("GCA_1", None, "f4", "HA", "MK", "c1"), ("GCA_1", "i", "f5", "HA", None, "c9")]
    df = spark.createDataFrame(rows, "file string, assembly_id string, brc_fea_id string, function string, prot_seq string, genbank_ctg_id string")
    assert {r.brc_fea_id for r in dedup.genome_duplicates(df, "prot_seq").collect()} == {"f2", "f3", "f4", "f5"}
    with pytest.raises(DataCheckError):
        dedup.protein_duplicates(df, 1)
    assert dedup.protein_duplicates(df, 5).count() == 4


def test_audits(spark):
    e = spark.createDataFrame([("p", "q"), ("p", "r"), ("s", "t"), (None, "q")], "cluster_id_a string, cluster_id_b string").withColumn("pair_key", F.concat_ws("_", "cluster_id_a", "cluster_id_b"))
    assert {(r.node, r.cc_rank) for r in audits.component_ranks(e).collect()} == {("a:p", 0), ("b:q", 0), ("b:r", 0), ("a:s", 1), ("b:t", 1)}
    cut = spark.createDataFrame([("b:q", "a:p")], "src string, dst string")
    assert audits.crossing_pairs(e, cut).count() == 1
    with pytest.raises(ValueError):
        audits.with_parent(e, e)
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, l string")
    b = spark.createDataFrame([(1, 7), (2, 8), (3, 9)], "k int, l int")
    assert not audits.same_partition(a, b, "k", "l").first().same
    assert audits.same_partition(b, b.withColumn("l", -F.col("l")), "k", "l").first().same
    kept, audit = audits.cut_within_budget(e, 1.0, drift=1.0)
    assert kept.count() == 4 and audit["n_cuts"] == 0


def test_vector_edge_cases(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [3.0, 4.0], 0), (2, None, 1), (3, [3.0, 4.0], 1)], "id int, v array<double>, y int")
    got = {r.id: r.u for r in df.select("id", vectors.unit_norm("v").alias("u")).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.6, 0.8], 2: None, 3: [0.6, 0.8]}
    m = vectors.mmd(df, "v", "y", shuffles=10).first()
    assert (m.n_1, m.n_0) == (2, 1) and 0 < m.p_value <= 1
    pooled = df.select(vectors.masked_mean(F.array("v", "v"), F.array(F.lit(True), F.lit(False))).alias("p")).first().p
    assert pooled == [0.0, 0.0]


def test_settings(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"x": {"k": 1, "l": [1]}, "functions": {"HA": {"name": "Hemagglutinin"}, "NA": "Neuraminidase"}}))
    b.write_text(json.dumps({"x": {"k": 2}}))
    c = config.load([a, b], ["x.m=3", "name=text"])
    assert (config.pick(c, "x.k"), config.pick(c, "x.l"), config.pick(c, "x.m"), config.pick(c, "name"), config.pick(c, "x.z", 9)) == (2, [1], 3, "text", 9)
    assert config.function_names(c, ["NA"]) == {"NA": "Neuraminidase"}
    with pytest.raises(ValueError):
        config.function_names(c, ["PB1"])
    with pytest.raises(ValueError):
        config.load([], ["x"])


def test_slowest_mode_equals_dense():
    import numpy as np

    for seed in range(20):
        rnd = random.Random(seed)
        n = rnd.randrange(3, 50)
        edges = {(rnd.randrange(i), i) for i in range(1, n)} | {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(rnd.randrange(20))}
        u, v = (np.array([e[k] for e in edges] + [e[1 - k] for e in edges]) for k in (0, 1))
        m = np.zeros((n, n))
        m[u, v] = 1
        laplace = np.diag(m.sum(1)) - m
        x = graph.slowest_mode(u, v, np.ones(len(u)), n)
        assert x @ laplace @ x == pytest.approx(np.linalg.eigvalsh(laplace)[1], abs=1e-7)


def test_out_of_fold_scores_after_an_observation(spark):
    rows = [(i, i % 2, [float(i % 2) + (i % 7) / 10, 1.0], i % 3 if i % 11 else None) for i in range(66)]
    df = scratch.materialize(spark.createDataFrame(rows, "row int, label int, features array<double>, fold int"))  # observes its rows
    got = models.out_of_fold(df, "features", 3).collect()
    assert {r.row for r in got} == {r[0] for r in rows if r[3] is not None}
    assert all((r.pred_prob > 0.5) == (r.label == 1) for r in got)
