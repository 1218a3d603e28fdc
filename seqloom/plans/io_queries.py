"""Queries that write tables in every format and read them back: what comes out must be what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as X
from ..sources import readers as R
from ..sources import sinks as K
from .registry import own_folder, query


def _genomes(t):
    """The isolates of protein_final as nested genome documents, one file each, written and read back."""
    p = t("protein_final").where("assembly_id is not null and brc_fea_id is not null and genbank_ctg_id is not null")
    doc = p.groupBy("file").agg(
        F.first("ncbi_taxonomy_id").alias("ncbi_taxonomy_id"), F.first("genetic_code").alias("genetic_code"), F.min("scientific_name").alias("scientific_name"), F.struct(F.min("quality").alias("genome_quality")).alias("quality"),
        F.collect_set(F.struct(F.col("genbank_ctg_id").alias("id"), F.col("replicon_type").alias("replicon_type"), F.lit("Good").alias("contig_quality"), F.concat(F.lit("ac"), "genbank_ctg_id").alias("dna"))).alias("contigs"),
        F.collect_set(F.struct(F.col("brc_fea_id").alias("id"), "type", "function", F.col("prot_seq").alias("protein_translation"), F.array(F.array("genbank_ctg_id", F.lit("1"), F.lit("+"), F.lit("3"))).alias("location"), "feature_quality", F.array(F.array(F.lit("x"), "family")).alias("family_assignments"))).alias("features"),
    )
    path = own_folder(t.spark)
    folder = path.removeprefix("file://")

    def save(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["doc"]):
                with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                    f.write(text)
            yield pdf[["file"]]

    # genome files are what comes in from outside; here each is a document of its own, written by the tasks to the shared folder
    doc.select("file", F.to_json(F.struct(*[c for c in doc.columns if c != "file"])).alias("doc")).mapInPandas(save, "file string").count()
    return R.read_genomes(t.spark, path)


_GEN = "g AS (SELECT DISTINCT file, brc_fea_id, type, function, prot_seq, feature_quality, genbank_ctg_id, family FROM protein_final WHERE assembly_id IS NOT NULL AND brc_fea_id IS NOT NULL AND genbank_ctg_id IS NOT NULL)"


@query(f"WITH {_GEN} SELECT file, brc_fea_id, type, function, md5(prot_seq) AS prot_hash, feature_quality, genbank_ctg_id, family, coalesce(length(prot_seq), 0) AS length, regexp_extract(file, '(GCA|GCF)_(\\d+\\.\\d+)', 2) AS assembly_id FROM g")
def genome_proteins(t):
    """Features of nested genome documents."""
    return R.protein_rows(_genomes(t)).select("file", "brc_fea_id", "type", "function", F.md5("prot_seq").alias("prot_hash"), "feature_quality", "genbank_ctg_id", "family", "length", "assembly_id")


@query("WITH c AS (SELECT DISTINCT file, genbank_ctg_id, replicon_type FROM protein_final WHERE assembly_id IS NOT NULL AND brc_fea_id IS NOT NULL AND genbank_ctg_id IS NOT NULL) SELECT file, genbank_ctg_id, coalesce(replicon_type, 'Unassigned') AS replicon_type, 'ac' || genbank_ctg_id AS ctg_dna_seq FROM c")
def genome_contigs(t):
    """Contigs of nested genome documents."""
    return R.contig_rows(_genomes(t)).select("file", "genbank_ctg_id", "replicon_type", "ctg_dna_seq")


def _clean(df, cols):
    """Text without the characters that a tab-separated file can't hold, blanks as null."""
    text = lambda c: F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n\"\\]", "_")
    return df.select(*[F.when(F.trim(text(c)) != "", F.trim(text(c))).alias(c) for c in cols])


def _sql_clean(cols):
    return ", ".join(f"nullif(trim(regexp_replace({c}::VARCHAR, '[\\t\\r\\n\"\\\\]', '_', 'g'), ' '), '') AS {c}" for c in cols)


_KEY = ["hash_id", "virus_name", "hn_subtype", *[f"seg_{i}" for i in range(1, 9)]]
_SEG = ["hash_id", "virus_name", "hn_subtype", "first_seg_id", "host_common_name", "lab_host", "passage"]


@query(f"SELECT {_sql_clean(_KEY)} FROM flu_genomes_key")
def isolate_key_file(t):
    """S5."""
    path = own_folder(t.spark)
    _clean(t("flu_genomes_key"), _KEY).write.csv(path, sep="\t", header=False, nullValue="", emptyValue="")
    return R.read_isolate_key(t.spark, path)


@query(f"SELECT {_sql_clean(_SEG)} FROM flu_first_seg_meta")
def first_segment_file(t):
    """S6."""
    path = own_folder(t.spark)
    _clean(t("flu_first_seg_meta"), _SEG).write.csv(path, sep="\t", header=False, nullValue="", emptyValue="")
    return R.read_first_segment_meta(t.spark, path)


@query("SELECT term_id::VARCHAR AS term_id, field_name, term FROM canonical_terms UNION ALL SELECT container_kind, NULL, capacity_tokens::VARCHAR FROM token_containers")
def tables_by_stem(t):
    """Parquet where there is one, else CSV."""
    path = own_folder(t.spark)
    t("canonical_terms").select("term_id", "field_name", "term").write.parquet(f"{path}/terms.parquet")
    t("token_containers").write.csv(f"{path}/containers.csv", header=True)
    a, b = R.read_table(t.spark, f"{path}/terms"), R.read_table(t.spark, f"{path}/containers")
    return a.select(F.col("term_id").cast("string").alias("term_id"), "field_name", "term").unionByName(b.select(F.col("container_kind").alias("term_id"), F.lit(None).cast("string").alias("field_name"), F.col("capacity_tokens").alias("term")))


@query("SELECT hash_id AS assembly_id, nullif(nullif(trim(geo_location_raw, ' '), 'nan'), '') AS geo_location_raw, year::INT AS year FROM flu_genomes_metadata_parsed")
def isolate_metadata(t):
    """S8."""
    return R.isolate_metadata(t("flu_genomes_metadata_parsed").withColumn("year", F.col("year").cast("string"))).select("assembly_id", "geo_location_raw", "year")


@query("SELECT DISTINCT prot_hash AS hash, 'C_' || substr(prot_hash, 1, 2) AS cluster_id FROM protein_final WHERE prot_hash IS NOT NULL")
def cluster_lookup(t):
    """Look-ups of two files, put together and checked."""
    path, c = own_folder(t.spark), t.clusters()
    c.where("hash < '8'").write.parquet(f"{path}/a")
    c.where("hash >= '8'").write.parquet(f"{path}/b")
    both = R.cluster_lookup(K.combined_lookup(t.spark, [f"{path}/a", f"{path}/b"]).withColumnRenamed("hash", "prot_hash"))
    return R.cluster_map(both.withColumnsRenamed({"cluster_id": "t095"}).withColumn("function", F.lit("x")), "x", "t095")


@query("SELECT cluster_id_a AS query, cluster_id_b AS target, fident, n_pairs::DOUBLE AS qcov, NULL::DOUBLE AS tcov FROM cluster_pair_edges")
def hits_file(t):
    """S12."""
    path = own_folder(t.spark)
    t("cluster_pair_edges").select("cluster_id_a", "cluster_id_b", "fident", F.col("n_pairs").cast("double"), F.lit(None).cast("double")).write.csv(path, sep="\t", nullValue="")
    return R.read_hits(t.spark, path)


@query("WITH m AS (SELECT record_id AS ord, coalesce(cc_id, 0)::VARCHAR AS rep FROM cc_members), f AS (SELECT rep, row_number() OVER (ORDER BY min(ord), rep) - 1 AS i FROM m GROUP BY 1) SELECT ord::VARCHAR AS hash, rep AS cluster_rep, 'HA_' || i AS cluster_id FROM m JOIN f USING (rep)")
def cluster_pairs(t):
    """S13."""
    m = t("cc_members").select(F.coalesce("cc_id", F.lit(0)).cast("string").alias("rep"), F.col("record_id").cast("string").alias("member"), F.col("record_id").alias("ord"))
    return R.clusters_from_pairs(m, "HA")


@query("SELECT DISTINCT md5(prot_seq) AS hash FROM protein_final WHERE prot_seq IS NOT NULL AND function = 'Neuraminidase surface protein'")
def fasta_names(t):
    """Distinct sequences as FASTA, and the names read back."""
    path = own_folder(t.spark)
    K.write_fasta(t("protein_final").where("function = 'Neuraminidase surface protein'"), path, "prot_seq", "prot_hash")
    return R.read_fasta_names(t.spark, path)


@query("WITH v AS (SELECT brc_fea_id, arg_min(emb, row_idx) AS emb FROM master_esm2_embeddings GROUP BY 1) SELECT brc_fea_id, list_sum(emb::DOUBLE[]) AS total FROM v WHERE brc_fea_id IN (SELECT brc_fea_id FROM protein_final) AND emb IS NOT NULL")
def vectors_by_id(t):
    """S16."""
    v = R.vectors_by_id(t("master_esm2_embeddings").where("emb is not null"), t("protein_final").select("brc_fea_id").distinct(), ["brc_fea_id"])
    return v.select("brc_fea_id", F.aggregate("emb", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT pair_key, label::VARCHAR AS label, split_name FROM segment_pairs")
def pairs_csv(t):
    """S17."""
    path = own_folder(t.spark)
    t("segment_pairs").select("pair_key", "label", "split_name", "source").write.csv(path, header=True, nullValue="")
    return R.read_pairs_csv(t.spark, path, ["pair_key", "label", "split_name"])


@query("WITH l AS (SELECT split_name AS split, label, 'a' AS side, prot_hash_a AS v FROM segment_pairs UNION ALL SELECT split_name, label, 'b', prot_hash_b FROM segment_pairs) SELECT split, label, side, count(*) AS n_pairs, count(DISTINCT v) AS n_unique FROM l WHERE v IS NOT NULL GROUP BY ALL")
def written_splits(t):
    """K1: pairs by split, with the overlap audit that is stored beside them."""
    path = own_folder(t.spark)
    audit = K.write_splits(t("segment_pairs").withColumnRenamed("split_name", "split"), path, families=["prot_hash"])
    return audit.groupBy("split", "label", "side").agg(F.max("n_pairs").alias("n_pairs"), F.max("n_unique").alias("n_unique"))


@query("SELECT (record_id % 3)::INT AS fold, CASE record_id % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM cc_members GROUP BY 1, 2")
def written_folds(t):
    """K2."""
    path = own_folder(t.spark)
    K.write_folds(t("cc_members").select("record_id", (F.col("record_id") % 3).cast("int").alias("fold"), F.when(F.col("record_id") % 2 == 0, "train").otherwise("test").alias("split")), path)
    return t.spark.read.parquet(path).groupBy("fold", "split").agg(F.count("*").alias("n"))


@query("SELECT source, n::VARCHAR AS n FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE source >= 'f' UNION ALL SELECT DISTINCT source, '0' FROM documents WHERE source < 'f'")
def upserted_counts(t):
    """K5: old counts, of which those of the sources before 'f' are replaced."""
    path = own_folder(t.spark)
    n = t("documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    K.upsert_csv(t.spark, f"{path}/counts", n, ["source"])
    return K.upsert_csv(t.spark, f"{path}/counts", n.where("source < 'f'").withColumn("n", F.lit(0)), ["source"])


@query("SELECT cc_id, n, row_number() OVER (ORDER BY n DESC, cc_id) AS rank, round(n / sum(n) OVER (), 4) AS share, round(sum(n) OVER (ORDER BY n DESC, cc_id) / sum(n) OVER (), 4) AS cum_share FROM (SELECT record_id % 7 AS cc_id, count(*) AS n FROM cc_members GROUP BY 1)")
def written_components(t):
    """K6."""
    m = t("cc_members").select((F.col("record_id") % 7).alias("cc_id"), F.coalesce("assembly_id", F.lit("none")).alias("cluster_id_a"), F.coalesce("function", F.lit("none")).alias("cluster_id_b"))
    return K.write_components(m, own_folder(t.spark))


@query("SELECT CASE WHEN canonical_segment IS NULL THEN 'unassigned_segment' WHEN type IS DISTINCT FROM 'CDS' THEN 'not_cds' WHEN quality IS NOT DISTINCT FROM 'Poor' OR feature_quality IS NOT DISTINCT FROM 'Poor' THEN 'poor_quality' WHEN replicon_type IS NOT DISTINCT FROM 'Unassigned' THEN 'unassigned_replicon' ELSE 'kept' END AS reject_reason, count(*) AS n, count(DISTINCT prot_hash) AS n_sequences FROM protein_final GROUP BY 1")
def written_rejects(t):
    """K7."""
    path = own_folder(t.spark)
    K.write_by_reason(X.tag_rejects(t("protein_final"), X.protein_rules()), path)
    return t.spark.read.parquet(path).groupBy("reject_reason").agg(F.count("*").alias("n"), F.count_distinct("prot_hash").alias("n_sequences"))


@query("SELECT cache_key, arg_min(brc_fea_id, coalesce(row_idx, 0)) AS brc_fea_id FROM master_esm2_embeddings WHERE cache_key IS NOT NULL AND cache_key NOT IN (SELECT cache_key FROM master_esm2_embeddings WHERE row_idx % 2 = 0 AND cache_key IS NOT NULL) GROUP BY 1")
def appended_vectors(t):
    """K8: of all vectors those that a store of the even rows lacks."""
    m = t("master_esm2_embeddings")
    return K.append_vectors(m.where("row_idx % 2 = 0"), m).select("cache_key", "brc_fea_id")
