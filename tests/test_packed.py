from seqloom.functions.packed import accession_grammar, strain_grammar, unpack
from seqloom.plans import packed_queries


def values(g, s):
    return [v[1] for v in g.parse(s)]


def test_strains():
    g = strain_grammar()
    assert values(g, 'A/x/1/2000; "A/y; z/2/2001" // A/q/3/2002') == ["A/x/1/2000", "A/y; z/2/2001", "A/q/3/2002"]
    assert values(g, "A/x; sector 2/1/2000") == ["A/x; sector 2/1/2000"]
    assert values(g, "Influenza A virus (A/x/1/2000(H1N1))") == ["Influenza A virus (A/x/1/2000(H1N1))"]
    assert values(g, '"A/x ""old"" y/1/2000",,A/q/3/2002;') == ['A/x "old" y/1/2000', "A/q/3/2002"]
    assert g.parse('"A/x/1/2000')[0][3] == "bad_quote"
    assert g.parse("  ") == []


def test_accessions():
    g = accession_grammar()
    assert values(g, '[X1.1\tX2.1,"X3.1, partial" X4.1]') == ["X1.1", "X2.1", "X3.1, partial", "X4.1"]
    assert values(g, "X1.1,,X1.1") == ["X1.1", "X1.1"]


def test_table(spark):
    df = spark.createDataFrame([("a", "X1;X2", 1), ("a", "X1;X2", 2), ("b", None, 3), ("c", " ", 4), ("d", "X9", 5)], "hash_id string, seg_1 string, item_pos int")
    rows = sorted(tuple(r) for r in unpack(df, "hash_id", "seg_1", accession_grammar, simple=r"^[A-Za-z0-9.]+$").collect())
    assert [r[:4] for r in rows] == [("a", "seg_1", 1, "X1"), ("a", "seg_1", 2, "X2"), ("d", "seg_1", 1, "X9")]
    assert unpack(df.limit(0), "hash_id", "seg_1", accession_grammar).count() == 0


def test_slashes_alone_separate_strains(spark, tmp_path):
    names = ["A/x y/P/K1/2016 // Influenza A virus A/z/P/2/2002", "A/x/1/2000/A/y/2/2001", "A/x/1/2000 / A/y/2/2001", "Influenza A virus A/x/1/2000", "A/x/USA/1/2000", "A/x/1/2000 //", "x/1/2000;A/y/2/2001", None]
    key = spark.createDataFrame([(f"h{i}", n, "X1") for i, n in enumerate(names)], "hash_id string, virus_name string, seg_1 string")
    key.write.parquet(f"{tmp_path}/flu_genomes_key.parquet")
    got = sorted((r.hash_id, r.item_pos, r.item_value) for r in packed_queries.p1_found(spark, str(tmp_path)).collect())
    g = strain_grammar()
    assert got == [(f"h{i}", v[0], v[1]) for i, n in enumerate(names) if n and len(g.parse(n)) > 1 for v in g.parse(n)]
    assert {"h0", "h1", "h2", "h6"} == {h for h, _, _ in got}
