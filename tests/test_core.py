import pytest
from pyspark.sql import functions as F

from seqloom.checks import DataCheckError, unique_key
from seqloom.functions import keys, metadata, sequences
from seqloom.operators import filters, graph, metrics, pairs, splits, windows
from seqloom.plans import model_queries, registry, sequence_queries  # noqa: F401


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_keys(spark):
    assert one(spark, keys.pair_key(F.lit("b"), F.lit("a"))) == "a__b"
    assert one(spark, keys.pair_key(F.lit("b"), F.lit(None).cast("string"))) is None
    assert one(spark, keys.threshold_label(F.lit(0.95))) == "t095"


def test_sequences(spark):
    assert one(spark, sequences.reverse_complement(F.lit("AACgRN"))) == "NYcGTT"
    assert one(spark, sequences.translate_dna(F.lit("ATGTTYNNNTAA"))) == "MFX*"
    assert one(spark, sequences.translate_dna(F.lit("ATGT"))) is None
    assert one(spark, sequences.parse_location(F.lit("[['c', '0', '+', '3']]"))) is None
    spans = sequences.parse_location(F.lit("[['c', '2', '-', '3'], ['c', '6', '-', '2']]"))
    assert one(spark, sequences.extract_cds(F.lit("TACGTCC"), spans)) == "GGCGT"
    a = one(spark, sequences.protein_ambiguities(F.lit("MX*BX*")))
    assert (a.ambiguity_count, a.has_terminal_stop, a.internal_stop_positions, a.ambiguity_positions["X"]) == (3, True, [3], [2, 5])
    assert one(spark, sequences.kmers(F.lit("acgNac"), 2)) == ["AC", "CG", "AC"]


def test_metadata(spark):
    assert one(spark, metadata.clean_host(F.lit("red-knobbed coot"))) == "Red-Knobbed Coot"
    assert one(spark, metadata.clean_host(F.lit("null"))) is None
    assert metadata.parse_name("Influenza A virus (A/wood pigeon/Pirovanna/79/2004(H3N2))") == ("wood pigeon", "Pirovanna", 2004, "79")


def test_null_rules(spark):
    df = spark.createDataFrame([("S1", "CDS", None, None, "Segment 1"), ("S1", "CDS", "Poor", None, "Segment 1"), (None, "CDS", "Good", None, "x")], "canonical_segment string, type string, quality string, feature_quality string, replicon_type string")
    assert filters.keep(df, filters.protein_rules()).count() == 1
    with pytest.raises(ValueError):
        filters.validate_spec({"host_range": (1, 2)})
    with pytest.raises(DataCheckError):
        unique_key(df, "type")


def test_components_do_not_depend_on_order(spark):
    rows = [("b", "c"), ("a", "b"), ("x", "y"), ("q", "q"), (None, "z"), ("a", "b")]
    want = {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q", "z": "z"}
    for n in (1, 4):
        df = spark.createDataFrame(rows, "src string, dst string").repartition(n)
        assert dict(graph.components(df).collect()) == want
    assert graph.components(df.limit(0)).count() == 0


def test_bridge_is_cut(spark):
    rows = [(f"{g}{i}", f"{g}{j}") for g in "pq" for i in range(3) for j in range(3, 6)] + [("p0", "q3")]
    df = spark.createDataFrame([(a, b) for a, b in rows], "cluster_id_a string, cluster_id_b string")
    kept, dropped, audit = graph.fragment_to_atoms(df, 2)
    assert (kept.count(), dropped.count(), audit["n_cuts"], audit["n_atoms"]) == (18, 1, 1, 2)


def test_packing_and_positions(spark):
    assert splits.pack_largest_first([(1, 5), (2, 5), (3, 2)], {"a": 6, "b": 6}) == {1: "a", 2: "b", 3: "a"}
    df = spark.range(50).withColumn("g", F.col("id") % 7)
    folds = splits.group_folds(df, "g", 3)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(r[0] for r in windows.row_positions(df, "id").select("pos").collect()) == list(range(50))


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, pred_prob double")
    r = metrics.ranking_metrics(df).first()
    assert r.auc_roc == pytest.approx(0.625) and r.auc_pr == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert metrics.predict(df, 0.9).where("pred_label = 1").count() == 0
    assert metrics.ranking_metrics(df.where("label = 1")).first().auc_roc is None


def test_residues_of_all_documents(spark, tmp_path):
    docs = [(1, "en", " MX*bx* "), (2, "de", "Straße*é*"), (3, None, "ac 𐐷*\n*d"), (4, "fr", None), (5, None, ""), (6, "en", "**")]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, _, t in docs:
        s = (t or "").strip(" ").upper()
        want.add((i, sum(c not in "*" + sequences.STANDARD_RESIDUES for c in s), s.endswith("*"), s[:-1].count("*")))
    assert {tuple(r) for r in registry.QUERIES["residue_ambiguities"](spark, str(tmp_path)).collect()} == want


def test_components_of_all_clusters(spark, tmp_path):
    ha, hb = ["00a", "01a", "10a", "20a", "30a", None], ["10b", "10b", "20b", "20b", "31b", "40b"]
    spark.createDataFrame([(h,) for h in ha + hb], "prot_hash string").write.parquet(f"{tmp_path}/protein_final.parquet")
    spark.createDataFrame(list(zip(ha, hb)), "prot_hash_a string, prot_hash_b string").write.parquet(f"{tmp_path}/segment_pairs.parquet")
    want = {"a:C_00": "a:C_00", "a:C_01": "a:C_00", "b:C_10": "a:C_00", "a:C_10": "a:C_10", "a:C_20": "a:C_10", "b:C_20": "a:C_10", "a:C_30": "a:C_30", "b:C_31": "a:C_30"}
    assert dict(registry.QUERIES["graph_components"](spark, str(tmp_path)).collect()) == want


def test_budgets_of_uneven_groups_are_met(spark):
    rows = [("g", f"a{i % 2}", f"b{i:02}") for i in range(40)] + [("h", "a8", "b90"), ("h", "a9", "b91"), ("h", "a9", "b90")]
    df = spark.createDataFrame(rows, "cc string, prot_hash_a string, prot_hash_b string").withColumn("pair_key", keys.pair_key("prot_hash_a", "prot_hash_b"))
    got = pairs.within_group_negatives(df, "cc", df.select("pair_key"), 1.0, per_row=2).collect()
    want = {("g", f"a{1 - i % 2}", f"b{i:02}") for i in range(40)} | {("h", "a8", "b91")}
    assert len(got) == 41 and {(r.cc, r.prot_hash_a, r.prot_hash_b) for r in got} == want
