"""Queries on filters, dedup, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import dedup as D
from ..operators import filters as X
from ..operators import joins as J
from ..operators import pairs as N
from ..operators import windows as V
from .registry import CLUSTERED, CLUSTERS, FLAGGED, META, query

_REASON = "CASE WHEN canonical_segment IS NULL THEN 'unassigned_segment' WHEN type IS DISTINCT FROM 'CDS' THEN 'not_cds' WHEN quality IS NOT DISTINCT FROM 'Poor' OR feature_quality IS NOT DISTINCT FROM 'Poor' THEN 'poor_quality' WHEN replicon_type IS NOT DISTINCT FROM 'Unassigned' THEN 'unassigned_replicon' ELSE 'kept' END"


@query(f"SELECT {_REASON} AS reject_reason, count(*) AS n FROM protein_final GROUP BY 1")
def protein_rejects(t):
    return X.reject_counts(t("protein_final"), X.protein_rules())


@query(f"SELECT file, brc_fea_id FROM protein_final WHERE {_REASON} = 'kept'")
def protein_kept(t):
    return X.keep(t("protein_final"), X.protein_rules()).select("file", "brc_fea_id")


@query(f"WITH {META} SELECT p.file, p.brc_fea_id FROM protein_final p WHERE assembly_id IN (SELECT assembly_id FROM meta WHERE host = 'Human' AND year BETWEEN 2005 AND 2020 AND hn_subtype IN ('H1N1', 'H3N2'))")
def metadata_filter(t):
    df = t("protein_final").join(t.meta(), "assembly_id", "left")
    return X.filter_by_metadata(df, {"host": "Human", "year_range": (2005, 2020), "hn_subtype": ["H1N1", "H3N2"]}).select("file", "brc_fea_id")


@query(f"WITH {META} SELECT coalesce(hn_subtype, '<null>') AS value, count(*) AS n_isolates FROM meta WHERE NOT coalesce(regexp_full_match(hn_subtype, 'H\\d+N\\d+'), false) GROUP BY 1")
def ambiguous_subtypes(t):
    return X.drop_ambiguous_subtype(t.meta())[1]


@query("""WITH x AS (SELECT prot_hash AS seq_hash, nullif(regexp_extract(hn_subtype, '^(H\\d+)', 1), '') AS p FROM protein_final JOIN flu_genomes_key ON assembly_id = hash_id WHERE prot_hash IS NOT NULL)
SELECT seq_hash, string_agg(DISTINCT p, ',' ORDER BY p) AS parts, count(DISTINCT p) AS n_parts, count(*) AS n_rows FROM x WHERE p IS NOT NULL GROUP BY 1 HAVING count(DISTINCT p) > 1""")
def multi_subtype_sequences(t):
    k = t("flu_genomes_key").select(F.col("hash_id").alias("assembly_id"), "hn_subtype")
    return X.multi_subtype_sequences(t("protein_final").join(k, "assembly_id"), "prot_hash", "hn_subtype")


@query(f"WITH {FLAGGED} SELECT count_if(same_host AND host_a <> 'unknown') AS n_within, count_if(NOT same_host AND host_a <> 'unknown' AND host_b <> 'unknown') AS n_cross, count(*) AS n FROM flagged")
def within_cross_hosts(t):
    w, c = X.within_cross("host")
    return t.flagged().agg(F.count_if(w).alias("n_within"), F.count_if(c).alias("n_cross"), F.count("*").alias("n"))


_DUP = "count(*) OVER (PARTITION BY prot_seq, assembly_id)"


@query(f"""WITH x AS (SELECT *, {_DUP} AS n, prot_seq IS NOT NULL AND assembly_id IS NOT NULL AS known FROM protein_final), f AS (SELECT prot_seq, assembly_id, count(DISTINCT file) AS nf FROM x WHERE known GROUP BY 1, 2)
SELECT CASE WHEN known AND n > 1 THEN CASE WHEN nf > 1 THEN 'different_files' ELSE 'same_file' END END AS dup_type, count(*) AS n_rows, count(DISTINCT CASE WHEN known THEN x.prot_seq || x.assembly_id END) + count_if(NOT known) AS n_kept
FROM x LEFT JOIN f ON x.prot_seq = f.prot_seq AND x.assembly_id = f.assembly_id GROUP BY 1""")
def assembly_duplicates(t):
    return D.assembly_duplicates(t("protein_final"), "prot_seq").groupBy("dup_type").agg(F.count("*").alias("n_rows"), F.count_if("kept").alias("n_kept"))


@query("""WITH c AS (SELECT assembly_id, min((CASE WHEN starts_with(file, 'GCF_') THEN '0' ELSE '1' END) || file) AS m FROM protein_final WHERE assembly_id IS NOT NULL GROUP BY 1)
SELECT assembly_id, min(file) AS file, count(DISTINCT coalesce(prot_seq, '<null>')) AS n FROM protein_final JOIN c USING (assembly_id) WHERE file = substr(m, 2) GROUP BY 1""")
def single_files(t):
    return D.single_file(t("protein_final")).groupBy("assembly_id").agg(F.min("file").alias("file"), F.count("*").alias("n"))


_HA, _NA = "Hemagglutinin surface protein", "Neuraminidase surface protein"


@query(f"SELECT count(*) AS n_isolates FROM (SELECT assembly_id FROM protein_final WHERE function IN ('{_HA}', '{_NA}') AND assembly_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT function) = 2)")
def complete_isolates(t):
    return D.one_per_function(t("protein_final"), [_HA, _NA]).agg(F.count_distinct("assembly_id").alias("n_isolates"))


@query("SELECT DISTINCT h AS prot_hash FROM (SELECT prot_hash_a AS h FROM segment_pairs UNION SELECT prot_hash_b FROM segment_pairs) WHERE h IS NOT NULL")
def pair_sequences(t):
    return D.unique_sequences_from_pairs(t("segment_pairs"), "prot_hash")


@query("WITH m AS (SELECT function, replicon_type, min(canonical_segment) AS s FROM protein_final GROUP BY 1, 2) SELECT p.function, p.replicon_type, m.s AS canonical_segment, count(*) AS n FROM protein_final p LEFT JOIN m ON p.function = m.function AND p.replicon_type = m.replicon_type GROUP BY ALL")
def assigned_segments(t):
    p = t("protein_final")
    m = p.select("function", "replicon_type", "canonical_segment").distinct()
    return D.assign_segments(p, m.where("function < 'M'"), m.where("function >= 'M'")).groupBy("function", "replicon_type", "canonical_segment").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT prot_hash AS h, assembly_id AS k FROM protein_final WHERE prot_hash IS NOT NULL AND assembly_id IS NOT NULL), n AS (SELECT h, count(*) AS n FROM o GROUP BY 1 HAVING count(*) > 1), r AS (SELECT o.k, o.h, n.n FROM o JOIN n USING (h))
SELECT a.h AS seq_a, b.h AS seq_b, count(*) AS n_common, any_value(a.n) - count(*) AS only_a, any_value(b.n) - count(*) AS only_b FROM r a JOIN r b ON a.k = b.k AND a.h < b.h GROUP BY 1, 2 HAVING any_value(a.n) > count(*) AND any_value(b.n) > count(*)""")
def contradictory_pairs(t):
    return D.contradictory_pairs(t("protein_final"), "prot_hash")


@query("SELECT prot_hash AS seq_hash, count(DISTINCT assembly_id) AS n_assemblies, count(*) AS n_records, CASE WHEN count(DISTINCT assembly_id) = 1 THEN 'case_1' WHEN count(DISTINCT assembly_id) = count(*) THEN 'case_2' ELSE 'other' END AS dup_case FROM protein_final WHERE prot_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_cases(t):
    return D.duplicate_cases(t("protein_final"), "prot_hash")


@query(f"WITH {META} SELECT p.file, p.brc_fea_id, m.host, m.hn_subtype, m.year FROM protein_final p LEFT JOIN meta m USING (assembly_id)")
def enriched_proteins(t):
    return J.lookup(t("protein_final"), t.meta(), ["assembly_id"]).select("file", "brc_fea_id", "host", "hn_subtype", "year")


@query(f"SELECT a.assembly_id, a.prot_hash AS prot_hash_a, b.prot_hash AS prot_hash_b FROM protein_final a JOIN protein_final b USING (assembly_id) WHERE a.function = '{_HA}' AND b.function = '{_NA}'")
def co_isolate_pairs(t):
    return J.co_isolate_pairs(t("protein_final"), _HA, _NA, ["prot_hash"])


@query(f"WITH {CLUSTERED} SELECT count_if(cluster_id_a IS NULL AND cluster_id_b IS NOT NULL) AS missing_a, count_if(cluster_id_a IS NOT NULL AND cluster_id_b IS NULL) AS missing_b, count_if(cluster_id_a IS NULL AND cluster_id_b IS NULL) AS missing_both, count_if(cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL) AS kept FROM clustered")
def cluster_attachment(t):
    return X.cluster_attach_drops(t.clustered())


@query(f"WITH {CLUSTERS}, h AS (SELECT DISTINCT least(prot_hash_a, prot_hash_b) AS query, greatest(prot_hash_a, prot_hash_b) AS target FROM segment_pairs WHERE prot_hash_a IS NOT NULL AND prot_hash_b IS NOT NULL) SELECT query, target FROM h JOIN clusters a ON a.hash = query JOIN clusters b ON b.hash = target WHERE a.cluster_id <> b.cluster_id")
def cluster_violations(t):
    return J.cluster_violations(t("segment_pairs").select(F.col("prot_hash_a").alias("query"), F.col("prot_hash_b").alias("target")), t.clusters())


@query(f"""WITH obs AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL)
SELECT a.h AS hash_a, b.h AS hash_b, count(*) AS num_isolates, a.h || '__' || b.h AS pair_key FROM obs a JOIN obs b ON a.k = b.k AND a.h < b.h GROUP BY 1, 2""")
def observed_pairs(t):
    return A.observed_pairs(t("protein_final"), "prot_hash")


@query(f"""WITH obs AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL), o AS (SELECT DISTINCT a.h || '__' || b.h AS pair_key FROM obs a JOIN obs b ON a.k = b.k AND a.h < b.h)
SELECT pair_row_id FROM segment_pairs s WHERE label = 0 AND pair_key IS NOT NULL AND pair_key NOT IN (SELECT pair_key FROM o)""")
def unobserved_negatives(t):
    neg = t("segment_pairs").where("label = 0 and pair_key is not null")
    return J.without_observed(neg, A.observed_pairs(t("protein_final"), "prot_hash")).select("pair_row_id")


@query(f"""WITH p AS (SELECT a.assembly_id, least(a.prot_hash, b.prot_hash) || '__' || greatest(a.prot_hash, b.prot_hash) AS pair_key, row_number() OVER (PARTITION BY least(a.prot_hash, b.prot_hash) || '__' || greatest(a.prot_hash, b.prot_hash) ORDER BY a.assembly_id, a.brc_fea_id, b.brc_fea_id) AS r
FROM protein_final a JOIN protein_final b USING (assembly_id) WHERE a.function = '{_HA}' AND b.function = '{_NA}' AND a.prot_hash IS NOT NULL AND b.prot_hash IS NOT NULL) SELECT assembly_id, pair_key FROM p WHERE r = 1""")
def positive_pairs(t):
    return N.positive_pairs(t("protein_final"), _HA, _NA).select("assembly_id", "pair_key")


@query("""WITH n AS (SELECT assembly_id, function, count(*) AS n FROM protein_final WHERE assembly_id IS NOT NULL AND function IS NOT NULL GROUP BY 1, 2) SELECT assembly_id, ((sum(n) * (sum(n) - 1) - sum(n * (n - 1))) / 2)::BIGINT AS n_pairs FROM n GROUP BY 1""")
def isolate_pair_counts(t):
    return A.isolate_pair_counts(t("protein_final"))


@query(f"""WITH {META}, n AS (SELECT prot_hash, coalesce(host, 'unknown') AS host, count(*) AS n FROM protein_final LEFT JOIN meta USING (assembly_id) WHERE prot_hash IS NOT NULL GROUP BY 1, 2)
SELECT prot_hash, host, n FROM n QUALIFY row_number() OVER (PARTITION BY prot_hash ORDER BY n DESC, host) = 1""")
def modal_hosts(t):
    return A.modal_value(t("protein_final").join(t.meta(), "assembly_id", "left"), "prot_hash", "host")


@query(f"WITH {META} SELECT 'host' AS field, host AS value, count(*) AS n_isolates FROM meta GROUP BY 2 UNION ALL SELECT 'hn_subtype', hn_subtype, count(*) FROM meta GROUP BY 2 UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM meta GROUP BY 2")
def metadata_distributions(t):
    return A.distributions(t.meta(), ["host", "hn_subtype", "year"])


_COV = " UNION ALL ".join(
    f"SELECT '{a}' AS axis, count(*) AS n_rows, round(count_if({a} IS NULL) * 100 / count(*), 3) AS null_pct, count(DISTINCT {a}) AS n_values, count(DISTINCT prot_hash) AS n_sequences, count(DISTINCT prot_hash) - count(DISTINCT CASE WHEN {a} IS NOT NULL THEN prot_hash END) AS n_sequences_without FROM x" for a in ("host", "hn_subtype", "year")
)


@query(f"WITH {META}, x AS (SELECT * FROM protein_final LEFT JOIN meta USING (assembly_id)) {_COV}")
def metadata_coverage(t):
    return A.metadata_coverage(t("protein_final").join(t.meta(), "assembly_id", "left"), ["host", "hn_subtype", "year"], "prot_hash")


_LONG = "l AS (SELECT label, split_name AS split, 'a' AS slot, prot_hash_a AS h FROM segment_pairs UNION ALL SELECT label, split_name, 'b', prot_hash_b FROM segment_pairs)"


@query(f"""WITH {_LONG}, e AS (SELECT h, count_if(slot = 'a' AND label = 1) AS pos_a, count_if(slot = 'b' AND label = 1) AS pos_b, count_if(slot = 'a' AND label = 0) AS neg_a, count_if(slot = 'b' AND label = 0) AS neg_b FROM l WHERE h IS NOT NULL GROUP BY 1)
SELECT CASE WHEN pos_a + pos_b > 0 AND neg_a + neg_b > 0 THEN 'dual' WHEN pos_a + pos_b > 0 THEN 'pos_only' ELSE 'neg_only' END AS exposure, count(*) AS n_sequences, sum(pos_a + pos_b)::BIGINT AS n_pos, sum(neg_a + neg_b)::BIGINT AS n_neg FROM e GROUP BY 1""")
def exposure(t):
    return A.exposure_summary(A.exposure(t("segment_pairs")))


@query(f"WITH {FLAGGED}, x AS (SELECT label, 'host' AS axis, same_host AS same FROM flagged UNION ALL SELECT label, 'hn_subtype', same_hn_subtype FROM flagged UNION ALL SELECT label, 'year', same_year FROM flagged) SELECT label, axis, count_if(same) AS n_same, count_if(NOT same) AS n_different, count_if(same IS NULL) AS n_unknown FROM x GROUP BY 1, 2")
def axis_flag_summary(t):
    return A.axis_flag_summary(t.flagged(), ["host", "hn_subtype", "year"])


_FAM = "f AS (SELECT 'prot_hash' AS family, 'a' AS side, split_name AS split, label, prot_hash_a AS value FROM segment_pairs UNION ALL SELECT 'prot_hash', 'b', split_name, label, prot_hash_b FROM segment_pairs UNION ALL SELECT 'ctg_dna_hash', 'a', split_name, label, ctg_dna_hash_a FROM segment_pairs UNION ALL SELECT 'ctg_dna_hash', 'b', split_name, label, ctg_dna_hash_b FROM segment_pairs)"


@query(f"""WITH {_FAM}, x AS (SELECT * FROM f WHERE value IS NOT NULL), s AS (SELECT DISTINCT family, side, value, split AS other FROM x), n AS (SELECT family, side, label, split, count(*) AS n_pairs, count(DISTINCT value) AS n_unique FROM x GROUP BY ALL)
SELECT x.family, x.side, x.label, x.split, s.other, count(DISTINCT x.value) AS n_overlap, any_value(n.n_pairs) AS n_pairs, any_value(n.n_unique) AS n_unique, round(count(DISTINCT x.value) * 100 / any_value(n.n_unique), 2) AS overlap_pct FROM x JOIN s USING (family, side, value) JOIN n ON n.family = x.family AND n.side = x.side AND n.label = x.label AND n.split = x.split GROUP BY 1, 2, 3, 4, 5""")
def split_overlap(t):
    return A.split_overlap(t("segment_pairs"), ["prot_hash", "ctg_dna_hash"])


@query(f"WITH {_FAM}, s AS (SELECT family, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM f WHERE value IS NOT NULL GROUP BY 1, 2) SELECT family, splits, count(*) AS n_values FROM s GROUP BY 1, 2")
def split_sets(t):
    return A.split_sets(t("segment_pairs"), ["prot_hash", "ctg_dna_hash"])


@query(f"WITH {_FAM}, s AS (SELECT value, count(DISTINCT split) AS n, min(split) AS m FROM f WHERE family = 'prot_hash' AND value IS NOT NULL GROUP BY 1) SELECT value, CASE WHEN n > 1 THEN 'leakage' ELSE m END AS split_label, n > 1 AS is_ambiguous FROM s")
def sequence_split_labels(t):
    return A.sequence_split_labels(t("segment_pairs"), "prot_hash")


@query(f"WITH {_FAM}, s AS (SELECT family, value, count(DISTINCT split) AS n FROM f WHERE value IS NOT NULL GROUP BY 1, 2) SELECT family, count(*) AS n_values, count_if(n >= 2) AS n_shared, round(count_if(n >= 2) * 100 / count(*), 4) AS shared_pct FROM s GROUP BY 1")
def leakage_share(t):
    return A.leakage_pct(t("segment_pairs"), ["prot_hash", "ctg_dna_hash"])


@query("SELECT split_name AS split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM segment_pairs GROUP BY 1")
def split_shares(t):
    return A.split_shares(t("segment_pairs"))


@query("SELECT file, count(*) AS total, count_if(function LIKE 'Polymerase%') AS core, count_if(function LIKE 'Accessory%') AS aux, count(*) - count_if(function LIKE 'Polymerase%') - count_if(function LIKE 'Accessory%') AS other FROM protein_final GROUP BY 1")
def counts_per_file(t):
    return A.counts_per_file(t("protein_final"), ["Polymerase basic subunit 1", "Polymerase basic subunit 2", "Polymerase acidic subunit"], ["Accessory protein PB1-F2"])


@query("WITH g AS (SELECT file, function, count(*) AS n, list_sort(list(DISTINCT brc_fea_id)) AS f FROM protein_final WHERE function IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT file, function, n, array_to_string(f[1:3], ',') AS preview FROM g")
def function_duplicates(t):
    return A.function_duplicates(t("protein_final"))


@query("SELECT function, replicon_type, count(*) AS n FROM protein_final WHERE function IS NOT NULL AND replicon_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5")
def function_counts(t):
    return A.function_counts(t("protein_final"), ["function", "replicon_type"], more_than=5)


@query(f"WITH {CLUSTERS}, n AS (SELECT cluster_id, count(DISTINCT hash) AS n FROM clusters GROUP BY 1) SELECT count(*) AS n_clusters, max(n) AS largest, quantile_cont(n, 0.5) AS median, avg(n) AS mean, floor(quantile_cont(n, 0.9))::BIGINT AS p90, floor(quantile_cont(n, 0.99))::BIGINT AS p99, count_if(n = 1) / count(*) AS singleton_share FROM n")
def cluster_size_distribution(t):
    return A.cluster_size_distribution(t.clusters())


_N = "WITH n AS (SELECT prot_hash, count(*) AS n FROM protein_final WHERE prot_hash IS NOT NULL GROUP BY 1)"


@query(_N + ", r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM n) SELECT any_value(k) AS n_items, any_value(t)::BIGINT AS total, 2 * sum(i * n) / (any_value(k) * any_value(t)) - (any_value(k) + 1) / any_value(k) AS gini, exp(-sum(n / t * ln(n / t))) AS shannon_n, 1 / sum((n / t) * (n / t)) AS hill_2 FROM r")
def sequence_diversity(t):
    return A.diversity(t("protein_final"), "prot_hash")


@query(_N + ", t AS (SELECT n, row_number() OVER (ORDER BY n DESC, prot_hash) AS r, sum(n) OVER () AS total FROM n) SELECT count_if(n = 1) AS n_once, count_if(n BETWEEN 2 AND 9) AS n_2_9, count_if(n BETWEEN 10 AND 99) AS n_10_99, count_if(n BETWEEN 100 AND 999) AS n_100_999, count_if(n >= 1000) AS n_1000, sum(CASE WHEN r <= 1 THEN n ELSE 0 END) / any_value(total) AS top_1_share, sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / any_value(total) AS top_10_share, sum(CASE WHEN r <= 100 THEN n ELSE 0 END) / any_value(total) AS top_100_share FROM t")
def frequency_tiers(t):
    return A.frequency_tiers(t("protein_final"), "prot_hash")


@query("SELECT DISTINCT length, t AS threshold, (length - ceil(round(length * t, 9)))::BIGINT AS n_mutations FROM protein_final, (VALUES (1.0::DOUBLE), (0.99::DOUBLE), (0.95::DOUBLE)) v(t) WHERE length IS NOT NULL")
def mutations_tolerated(t):
    return A.mutations_tolerated(t("protein_final"), [1.0, 0.99, 0.95])


@query("SELECT function, count(*) AS n_seqs, min(length(prot_seq))::INT AS shortest, quantile_cont(length(prot_seq), 0.25) AS q25, quantile_cont(length(prot_seq), 0.5) AS median, quantile_cont(length(prot_seq), 0.75) AS q75, max(length(prot_seq))::INT AS longest, avg(length(prot_seq)) AS mean FROM protein_final WHERE prot_seq IS NOT NULL AND function IS NOT NULL GROUP BY 1")
def length_stats(t):
    return A.length_stats(t("protein_final"), "function", "prot_seq")


_CELL = "CASE WHEN year <= 2015 THEN '<=2015' WHEN year BETWEEN 2016 AND 2020 THEN '2016-2020' WHEN year >= 2021 THEN '2021+' END"


@query(f"""WITH {META}, c AS (SELECT host, hn_subtype AS s, {_CELL} AS y, count(*) AS n FROM meta GROUP BY ALL), p AS (SELECT ['none_match','year_only','subtype_only','subtype_year_only','host_only','host_year_only','host_subtype_only','host_subtype_year'][1 + 4 * coalesce(a.host = b.host, false)::INT + 2 * coalesce(a.s = b.s, false)::INT + coalesce(a.y = b.y, false)::INT] AS regime,
CASE WHEN a.host IS NOT DISTINCT FROM b.host AND a.s IS NOT DISTINCT FROM b.s AND a.y IS NOT DISTINCT FROM b.y THEN a.n * (a.n - 1) ELSE a.n * b.n END AS n FROM c a, c b)
SELECT r AS regime, coalesce(sum(n), 0)::BIGINT AS n_available FROM unnest(['none_match','year_only','subtype_only','subtype_year_only','host_only','host_year_only','host_subtype_only','host_subtype_year']) x(r) LEFT JOIN p ON p.regime = r GROUP BY 1""")
def regime_supply(t):
    from ..functions.metadata import isolate_cells

    return A.regime_supply(isolate_cells(t.meta()))


@query("WITH x AS (SELECT coalesce(lang, 'unknown') AS row, coalesce(source, 'unknown') AS col FROM documents) SELECT coalesce(row, 'All') AS row, count_if(col = 'run_log') AS run_log, count_if(col = 'fasta_dump') AS fasta_dump, count_if(col = 'unknown') AS unknown, count(*) AS \"All\" FROM x GROUP BY ROLLUP (row)")
def crosstab(t):
    return A.crosstab(t("documents"), "lang", "source", ["run_log", "fasta_dump", "unknown"])


@query(f"WITH {META}, k AS (SELECT year, hn_subtype AS category FROM meta WHERE year IS NOT NULL AND hn_subtype IS NOT NULL), b AS (SELECT category FROM k GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3) SELECT y.year, b.category, (SELECT count(*) FROM k WHERE k.year = y.year AND k.category = b.category) AS n FROM (SELECT DISTINCT year FROM k) y, b")
def year_matrix(t):
    return A.year_matrix(t.meta(), "hn_subtype", 3)


@query("SELECT count(*) AS n_rows, count_if(host_common_name IS NULL) AS host_common_name_null, count_if(passage IS NULL) AS passage_null, count_if(trim(host_common_name, ' ') = '') AS host_common_name_blank, count_if(trim(passage, ' ') = '') AS passage_blank FROM flu_first_seg_meta")
def null_report(t):
    return A.null_report(t("flu_first_seg_meta"), ["host_common_name", "passage"])


@query("SELECT function, count(*) AS n_seqs, count_if(length(prot_seq) > 150) AS n_truncated, count_if(length(prot_seq) > 150) / count(*) AS truncated_share, sum(greatest(length(prot_seq) - 150, 0))::BIGINT AS residues_lost FROM protein_final WHERE prot_seq IS NOT NULL GROUP BY 1")
def truncation(t):
    return A.truncation(t("protein_final"), "prot_seq", 150, "function")


@query(f"WITH {FLAGGED} SELECT ['none_match','year_only','subtype_only','subtype_year_only','host_only','host_year_only','host_subtype_only','host_subtype_year'][1 + 4 * coalesce(same_host, false)::INT + 2 * coalesce(same_hn_subtype, false)::INT + coalesce(same_year, false)::INT] AS regime, count(*) AS n FROM flagged GROUP BY 1")
def regime_counts(t):
    return A.regime_counts(t.flagged())


@query("SELECT split_name, label, count(*) AS n, sha256(string_agg(pair_key, chr(10) ORDER BY pair_key)) AS sha256 FROM segment_pairs WHERE pair_key IS NOT NULL GROUP BY 1, 2")
def split_digests(t):
    return A.digest(t("segment_pairs"), ["split_name", "label"])


@query(f"WITH {CLUSTERED} SELECT cluster_id_a, cluster_id_b, count(*) AS n_pairs FROM clustered WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL GROUP BY 1, 2")
def occupied_cells(t):
    return A.occupied_cells(t.clustered())


@query("WITH n AS (SELECT cc_id, count(*) AS n FROM cc_members WHERE cc_id IS NOT NULL GROUP BY 1) SELECT cc_id, n, row_number() OVER (ORDER BY n DESC, cc_id) AS rank, round(n / sum(n) OVER (), 4) AS share, round(sum(n) OVER (ORDER BY n DESC, cc_id) / sum(n) OVER (), 4) AS cum_share FROM n")
def component_sizes(t):
    return A.component_sizes(t("cc_members"))


@query("WITH n AS (SELECT cc_id, count(*) AS n FROM cc_members WHERE cc_id IS NOT NULL GROUP BY 1) SELECT sum(n)::BIGINT AS n_pairs, count(*) AS n_components, max(n) AS largest, floor(sum(n) / max(n))::BIGINT AS max_balanced_k, max(n) / sum(n) AS largest_share FROM n")
def component_summary(t):
    return A.component_summary(t("cc_members"))


@query("SELECT source, md5('7|' || doc_id) AS o, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) <= 5")
def sample_per_source(t):
    from ..functions.keys import order_key

    d = t("documents").where("source is not null").select("source", "doc_id")
    return V.first_m_per_group(d, "source", "doc_id", 5, 7).select("source", order_key(7, "doc_id").alias("o"), "doc_id")


@query("WITH n AS (SELECT lab_id, count(*) AS size FROM documents WHERE lab_id IS NOT NULL GROUP BY 1) SELECT lab_id, size, row_number() OVER (ORDER BY size DESC, lab_id) - 1 AS rank FROM n")
def lab_ranks(t):
    return V.rank_by_size(t("documents"), "lab_id", "rank")


@query("WITH n AS (SELECT lab_id, count(*) AS n FROM documents WHERE lab_id IS NOT NULL GROUP BY 1), c AS (SELECT row_number() OVER (ORDER BY n DESC, lab_id) AS r, sum(n) OVER (ORDER BY n DESC, lab_id) AS s, sum(n) OVER () AS t FROM n) SELECT v AS share, min(r) AS n_groups FROM c, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) x(v) WHERE s >= v * t - 1e-9 GROUP BY 1")
def labs_to_reach(t):
    return V.groups_to_reach(t("documents"), "lab_id", [0.5, 0.9, 0.99])


@query("WITH e AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM documents) SELECT doc_id, CASE WHEN n_chars IS NOT NULL THEN (n_chars >= e[1])::INT + (n_chars >= e[2])::INT + (n_chars >= e[3])::INT END AS bucket FROM documents, e")
def length_buckets(t):
    return V.quantile_buckets(t("documents"), "n_chars", 4).select("doc_id", "bucket")


@query(f"WITH {CLUSTERED}, n AS (SELECT cluster_id_a, cluster_id_b, count(*) AS n FROM clustered WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster_id_a, cluster_id_b) AS rank, sum(n) OVER (ORDER BY n DESC, cluster_id_a, cluster_id_b) / sum(n) OVER () AS cum_share FROM n) SELECT * FROM r WHERE rank <= 10")
def heaviest_cells(t):
    return V.weight_top_k(t.clustered(), 10)


@query("SELECT assembly_id FROM (SELECT DISTINCT assembly_id FROM protein_final WHERE assembly_id IS NOT NULL) ORDER BY md5('3|' || assembly_id), assembly_id LIMIT 50")
def sampled_isolates(t):
    return V.hash_order_limit(t("protein_final"), "assembly_id", 50, 3)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('5|' || doc_id), doc_id) - 1 AS pos FROM documents")
def hash_positions(t):
    return V.row_positions(t("documents").select("doc_id"), "doc_id", 5)
