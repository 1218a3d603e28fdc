"""The registered queries on tables that are empty and on rows of nulls: a defined result, never a crash."""

import pytest

from seqloom.llm import queries

S = "string"
TABLES = {
    "protein_final": "assembly_id string, prot_hash string, extra string",
    "cc_members": "record_id bigint, assembly_id string, function string, cluster_id_path string, threshold string, cluster_id string, cc_id bigint",
    "flu_genomes_metadata_parsed": "hash_id string, geo_location_raw string",
    "flu_first_seg_meta": "hash_id string, host_common_name string, passage string",
    "master_esm2_embeddings": "cache_key string, row_idx bigint, brc_fea_id string, emb array<float>",
    "cluster_pair_edges": "edge_id bigint, cluster_id_a string, cluster_id_b string, n_pairs int, fident double",
    "segment_pairs": "pair_row_id bigint, prot_seq_a string, prot_seq_b string, prot_hash_a string, prot_hash_b string, ctg_dna_hash_a string, ctg_dna_hash_b string, split_name string, source string",
    "documents": "doc_id bigint, text string, lang string, source string",
}
SMALL = {
    "canonical_terms": ("term_id bigint, field_name string, term string, also_known_as array<string>", [(1, "passage", "Egg passage 1", ["E1"]), (2, "passage", None, None), (None, None, None, None)]),
    "split_targets": ("split_name string, target_share double", [("train", 0.8), ("val", 0.1), ("test", 0.1)]),
    "token_containers": ("container_kind string, capacity_tokens int", [("k", 64)]),
    "mix_targets": ("source string, target_share double, max_repeats int", [("a", 0.5, 1), ("b", 0.5, 2)]),
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        d = tmp_path_factory.mktemp(kind)
        for name, ddl in TABLES.items():
            n = len(ddl.replace("array<float>", "x").split(","))
            ids = {"record_id", "edge_id", "pair_row_id", "doc_id"}
            cols = [c.split()[0] for c in ddl.split(",")]
            rows = [] if kind == "empty" else [tuple(i if c in ids else "test" if c == "split_name" and i else "train" if c == "split_name" else None for c in cols) for i in range(3)]
            assert n == len(cols)
            spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")
        for name, (ddl, rows) in SMALL.items():
            spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


#: Queries that report on every record, target or document even where there is nothing to say about it, and their rows for three of nulls.
ROWS = {"p3_found": 3, "p3_splits": 3, "p3_shares": 3, "p9_mix_report": 2, "p10_shared": 3, "p7_overlap": 1}


#: Those that another one runs through.
WITHIN = {"p2_cooccurrence", "p3_splits", "p8_containers", "p8_checks", "p9_mix", "p9_checks"}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - WITHIN))
def test_empty_and_null_tables(spark, folders, name):
    run = queries.queries()[name]
    always = {"p3_shares": 3, "p9_mix_report": 2}
    assert run(spark, folders["empty"]).count() == always.get(name, 0)
    assert run(spark, folders["nulls"]).count() == ROWS.get(name, 0)
