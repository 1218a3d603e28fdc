"""Queries on look-ups, dedup chains, rule chains and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.keys import seed_number
from ..operators import aggregates as A
from ..operators import audits as D
from ..operators import dedup as U
from ..operators import filters as X
from ..operators import joins as J
from ..operators import pairs as N
from ..scratch import materialize
from .registry import FLAGGED, META, query
from .table_queries import _HA, _NA

_CONTIGS = "ctg AS (SELECT ctg_a AS genbank_ctg_id, min(ctg_dna_seq_a) AS ctg_dna_seq FROM segment_pairs WHERE ctg_a IS NOT NULL GROUP BY 1)"


def _contigs(t):
    return t("segment_pairs").where("ctg_a is not null").groupBy(F.col("ctg_a").alias("genbank_ctg_id")).agg(F.min("ctg_dna_seq_a").alias("ctg_dna_seq"))


@query(f"WITH {_CONTIGS} SELECT file, brc_fea_id, md5(ctg_dna_seq) AS ctg_dna_hash FROM protein_final LEFT JOIN ctg USING (genbank_ctg_id)")
def contigs_of_proteins(t):
    """Every protein with its contig's sequence; the contig table must be unique."""
    return J.lookup(t("protein_final"), _contigs(t), ["genbank_ctg_id"]).select("file", "brc_fea_id", F.md5("ctg_dna_seq").alias("ctg_dna_hash"))


@query(f"WITH {_CONTIGS} SELECT count(ctg.genbank_ctg_id) AS n_found, count(*) - count(ctg.genbank_ctg_id) AS n_missing FROM protein_final p LEFT JOIN ctg ON p.genbank_ctg_id = ctg.genbank_ctg_id")
def probed_contigs(t):
    """J16."""
    return J.probe_contigs(t("protein_final"), _contigs(t), ["genbank_ctg_id"])[1]


_HASHES = "h AS (SELECT brc_a AS brc_fea_id, min(cds_dna_hash_a) AS cds_dna_hash FROM segment_pairs WHERE brc_a IS NOT NULL AND cds_dna_hash_a IS NOT NULL GROUP BY 1)"


def _hashes(t):
    return t("segment_pairs").where("brc_a is not null and cds_dna_hash_a is not null").groupBy(F.col("brc_a").alias("brc_fea_id")).agg(F.min("cds_dna_hash_a").alias("cds_dna_hash"))


@query(f"WITH {_HASHES} SELECT brc_fea_id, cds_dna_hash IS NOT NULL AS matched, count(*) AS n FROM protein_final LEFT JOIN h USING (brc_fea_id) GROUP BY ALL")
def attached_hashes(t):
    """Proteins with the hash of their coding sequence, and those without."""
    p = t("protein_final").select("brc_fea_id")
    hit, miss = J.attach_hash(p, _hashes(t), ["brc_fea_id"], "cds_dna_hash")
    both = hit.select("brc_fea_id", F.lit(True).alias("matched")).unionByName(miss.select("brc_fea_id", F.lit(False).alias("matched")))
    return both.groupBy("brc_fea_id", "matched").agg(F.count("*").alias("n"))


@query(f"WITH {_HASHES} SELECT pair_row_id, a.cds_dna_hash AS cds_dna_hash_a, b.cds_dna_hash AS cds_dna_hash_b FROM segment_pairs s LEFT JOIN h a ON s.brc_a = a.brc_fea_id LEFT JOIN h b ON s.brc_b = b.brc_fea_id")
def ensured_hashes(t):
    """DD10 on pairs whose hash columns are empty placeholders."""
    s = t("segment_pairs").withColumns({f"cds_dna_hash_{x}": F.lit(None).cast("string") for x in "ab"}).withColumnsRenamed({"brc_a": "brc_fea_id_a", "brc_b": "brc_fea_id_b"})
    return J.ensure_hash(s, _hashes(t), "brc_fea_id", "cds_dna_hash").select("pair_row_id", "cds_dna_hash_a", "cds_dna_hash_b")


@query("WITH k AS (SELECT hash_id, min(virus_name) AS virus_name, min(hn_subtype) AS key_subtype FROM flu_genomes_key GROUP BY 1), m AS (SELECT hash_id, min(hn_subtype) AS hn_subtype, min(host_common_name) AS host_common_name FROM flu_first_seg_meta GROUP BY 1) SELECT hash_id, key_subtype, hn_subtype, coalesce(host_common_name, 'unknown') AS host FROM k LEFT JOIN m USING (hash_id)")
def key_with_meta(t):
    """The isolate key with its first-segment metadata; an explicit host is preferred."""
    k = t("flu_genomes_key").groupBy("hash_id").agg(F.min("virus_name").alias("virus_name"), F.min("hn_subtype").alias("key_subtype"))
    m = t("flu_first_seg_meta").groupBy("hash_id").agg(F.min("hn_subtype").alias("hn_subtype"), F.min("host_common_name").alias("host_common_name"))
    return J.lookup(k, m, ["hash_id"]).select("hash_id", "key_subtype", "hn_subtype", F.coalesce("host_common_name", F.lit("unknown")).alias("host"))


@query(f"WITH atoms AS (SELECT prot_hash AS h, substr(prot_hash, 1, 1) AS atom_id FROM protein_final WHERE prot_hash IS NOT NULL GROUP BY 1) SELECT DISTINCT a.assembly_id, a.prot_hash AS prot_hash_a, b.prot_hash AS prot_hash_b, x.atom_id FROM protein_final a JOIN protein_final b USING (assembly_id) JOIN atoms x ON x.h = a.prot_hash JOIN atoms y ON y.h = b.prot_hash WHERE a.function = '{_HA}' AND b.function = '{_NA}' AND x.atom_id = y.atom_id")
def isolate_pool(t):
    """J11, N-15."""
    atoms = t("protein_final").where("prot_hash is not null").select(F.col("prot_hash").alias("hash")).distinct().withColumn("atom_id", F.substring("hash", 1, 1))
    return J.isolate_pool(t("protein_final"), _HA, _NA, atoms)


@query("SELECT prot_hash, assembly_id, brc_fea_id FROM protein_final WHERE prot_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prot_hash ORDER BY assembly_id NULLS FIRST, brc_fea_id NULLS FIRST) = 1")
def representatives(t):
    """J12."""
    return J.representatives(t("protein_final"), "prot_hash", ["assembly_id", "brc_fea_id"], ["assembly_id", "brc_fea_id"])


@query("SELECT pair_row_id FROM segment_pairs WHERE split_name = 'test' AND (pair_key IS NULL OR pair_key NOT IN (SELECT pair_key FROM segment_pairs WHERE split_name <> 'test' AND pair_key IS NOT NULL))")
def uncollided_pairs(t):
    """J14."""
    s = t("segment_pairs")
    return J.without_observed(s.where("split_name = 'test'"), s.where("split_name <> 'test'")).select("pair_row_id")


@query("WITH c AS (SELECT DISTINCT prot_hash AS hash, 'C_' || substr(prot_hash, 1, 2) AS cluster_id FROM protein_final WHERE prot_hash IS NOT NULL) SELECT DISTINCT pair_key, a.cluster_id AS cluster_id_a, b.cluster_id AS cluster_id_b FROM segment_pairs JOIN c a ON a.hash = prot_hash_a JOIN c b ON b.hash = prot_hash_b WHERE pair_key IS NOT NULL")
def feasible_pairs(t):
    """J15."""
    return D.feasible_pairs(t("segment_pairs"), t.clusters())


@query("SELECT file, count(DISTINCT function) AS n_functions, count(*) FILTER (quality = 'Poor') AS n_poor FROM protein_final GROUP BY 1")
def file_statistics(t):
    """J19."""
    p = t("protein_final")
    return D.file_statistics(p, [p.groupBy("file").agg(F.count_distinct("function").alias("n_functions")), p.where("quality = 'Poor'").groupBy("file").agg(F.count("*").alias("n_poor"))])


@query("SELECT container_kind, capacity_tokens, n AS n_documents FROM token_containers, (SELECT count(*) AS n FROM documents)")
def with_parent_row(t):
    """J21."""
    return D.with_parent(t("token_containers"), t("documents").agg(F.count("*").alias("n_documents")))


@query("SELECT record_id AS hash, min(CASE WHEN threshold = 't095' THEN cluster_id END) AS t095, min(CASE WHEN threshold = 't090' THEN cluster_id END) AS t090 FROM cc_members WHERE threshold IN ('t090', 't095', 't099') OR threshold IS NULL OR true GROUP BY 1")
def membership_table(t):
    """J22, C4."""
    return J.membership_wide(t("cc_members").withColumnRenamed("record_id", "hash"), ["t095", "t090"])


@query("WITH r AS (SELECT DISTINCT pair_key, split_name FROM segment_pairs WHERE pair_key IS NOT NULL), o AS (SELECT pair_key, min(split_name) AS b, max(split_name) AS a FROM r GROUP BY 1) SELECT b AS before, a AS after, count(*) AS n FROM o GROUP BY 1, 2")
def split_transitions(t):
    """Keys by their first and last split."""
    s = t("segment_pairs").where("pair_key is not null").groupBy("pair_key").agg(F.min("split_name").alias("lo"), F.max("split_name").alias("hi"))
    return J.split_transition(s.select("pair_key", F.col("lo").alias("split")), s.select("pair_key", F.col("hi").alias("split")))


_BIN = "CASE WHEN year <= 2015 THEN '<=2015' WHEN year BETWEEN 2016 AND 2020 THEN '2016-2020' WHEN year >= 2021 THEN '2021+' END"


@query(f"WITH {META}, c AS (SELECT DISTINCT host, hn_subtype AS s, {_BIN} AS y FROM meta) SELECT ['none_match','year_only','subtype_only','subtype_year_only','host_only','host_year_only','host_subtype_only','host_subtype_year'][1 + 4 * coalesce(a.host = b.host, false)::INT + 2 * coalesce(a.s = b.s, false)::INT + coalesce(a.y = b.y, false)::INT] AS regime, count(*) AS n FROM c a, c b GROUP BY 1")
def cell_partners(t):
    """N-6, J25."""
    from ..operators.builds import cell_partners as partners

    return partners(M.isolate_cells(t.meta())).groupBy("regime").agg(F.count("*").alias("n"))


@query("SELECT coalesce(canonical_segment, 'unassigned') AS segment, count(*) AS n_rows, count(DISTINCT assembly_id) AS n_isolates, count(DISTINCT function) AS n_functions, avg(length) AS mean_length, min(length) AS shortest, max(length) AS longest FROM protein_final GROUP BY 1")
def segment_assignment(t):
    return D.segment_assignment(t("protein_final"))


@query("SELECT prot_hash, count(*) AS n_rows, count(DISTINCT file) AS n_files, count(DISTINCT assembly_id) AS n_isolates FROM protein_final WHERE prot_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def sequence_spread(t):
    return D.sequence_spread(t("protein_final"))


@query("WITH e AS (SELECT split_name AS split, assembly_id_a AS i, prot_hash_a AS h FROM segment_pairs UNION ALL SELECT split_name, assembly_id_b, prot_hash_b FROM segment_pairs), d AS (SELECT split, count(DISTINCT i) AS n_isolates, count(DISTINCT h) AS n_sequences FROM e GROUP BY 1) SELECT split_name AS split, count(*) AS n_pairs, count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg, any_value(n_isolates) AS n_isolates, any_value(n_sequences) AS n_sequences, count_if(label = 0) / nullif(count_if(label = 1), 0) AS neg_ratio FROM segment_pairs JOIN d ON d.split = split_name GROUP BY 1")
def dataset_statistics(t):
    return D.dataset_statistics(t("segment_pairs"))


@query("SELECT least(coalesce(func_a, 'unknown'), coalesce(func_b, 'unknown')) AS first, greatest(coalesce(func_a, 'unknown'), coalesce(func_b, 'unknown')) AS second, count_if(split_name = 'train') AS train, count_if(split_name = 'val') AS val, count_if(split_name = 'test') AS test FROM segment_pairs GROUP BY 1, 2")
def function_pairs(t):
    return D.function_pairs(t("segment_pairs"), ["train", "val", "test"])


@query("WITH e AS (SELECT split_name AS s, assembly_id_a AS i FROM segment_pairs UNION SELECT split_name, assembly_id_b FROM segment_pairs), g AS (SELECT i, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM e WHERE i IS NOT NULL GROUP BY 1) SELECT splits, count(*) AS n_isolates FROM g GROUP BY 1")
def isolate_overlap(t):
    return D.isolate_overlap(t("segment_pairs"))


@query("WITH k AS (SELECT DISTINCT pair_key, split_name AS s FROM segment_pairs WHERE pair_key IS NOT NULL) SELECT a.s AS first, b.s AS second, count(*) AS n FROM k a JOIN k b ON a.pair_key = b.pair_key AND a.s < b.s GROUP BY 1, 2")
def common_keys(t):
    return D.common_keys(t("segment_pairs"))


@query("SELECT DISTINCT assembly_id FROM protein_final WHERE assembly_id IS NOT NULL AND assembly_id NOT IN (SELECT assembly_id_a FROM segment_pairs WHERE assembly_id_a IS NOT NULL)")
def dropped_isolates(t):
    return D.dropped_isolates(t("protein_final"), t("segment_pairs").select(F.col("assembly_id_a").alias("assembly_id")))


@query("SELECT count(*) AS n_rows, count(DISTINCT cc_id) AS n_labels_a, count(DISTINCT cc_id) AS n_labels_b, count(DISTINCT cc_id) AS n_meets, true AS same FROM cc_members WHERE cc_id IS NOT NULL")
def same_partition(t):
    m = t("cc_members").where("cc_id is not null")
    return D.same_partition(m.select("record_id", "cc_id"), m.select("record_id", (F.lit(7) - F.col("cc_id") * 3).alias("cc_id")), "record_id", "cc_id")


@query("WITH o AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL) SELECT a.h || '__' || b.h AS pair_key, count(*) AS num_isolates FROM o a JOIN o b ON a.k = b.k AND a.h < b.h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def most_observed(t):
    """T2."""
    return D.by_count(A.observed_pairs(t("protein_final"), "prot_hash"), 25).select("pair_key", "num_isolates")


@query("SELECT split_name AS split, count(*) AS n, CASE split_name WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS position FROM segment_pairs GROUP BY 1")
def ordered_splits(t):
    """T3."""
    return D.in_split_order(t("segment_pairs").groupBy(F.col("split_name").alias("split")).agg(F.count("*").alias("n")))


@query("SELECT source AS value, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_sources(t):
    """T4."""
    return A.top_values(t("documents"), "source", 5)


@query(f"WITH {META}, m AS (SELECT assembly_id, min(hn_subtype) AS s FROM meta GROUP BY 1) SELECT edge_id, cluster_id_a, cluster_id_b, substr(cluster_id_a, 4, 1) AS atom_a, substr(cluster_id_b, 4, 1) AS atom_b, coalesce(substr(cluster_id_a, 4, 1) = substr(cluster_id_b, 4, 1), false) AS kept FROM cluster_pair_edges")
def pair_table(t):
    """A57."""
    e = t("cluster_pair_edges").withColumn("assembly_id_a", F.lit(None).cast("string"))
    ids = e.select(F.explode(F.array("cluster_id_a", "cluster_id_b")).alias("cluster_id")).where("cluster_id is not null").distinct()
    return D.pair_table(e, ids.withColumn("atom_id", F.substring("cluster_id", 4, 1)), t.meta()).select("edge_id", "cluster_id_a", "cluster_id_b", "atom_a", "atom_b", "kept")


@query("SELECT source AS category, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents WHERE source IS NOT NULL AND lang = 'en' GROUP BY 1 QUALIFY rank <= 4")
def category_scheme(t):
    """Categories over a slice, here the English documents."""
    return D.category_scheme(t("documents"), "source", 4, F.col("lang") == "en").select("category", "rank")


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) >= 4 AS plot FROM segment_pairs" for c in ("label", "split_name", "source", "func_a")))
def worth_plotting(t):
    """A60."""
    return D.worth_plotting(t("segment_pairs"), ["label", "split_name", "source", "func_a"], 4)


@query("WITH r AS (SELECT DISTINCT split_name AS run FROM segment_pairs), m AS (SELECT split_name AS run, avg(label) AS f1, max(label) AS auc FROM segment_pairs GROUP BY 1) SELECT run, auc, f1, NULL::DOUBLE AS mcc FROM r LEFT JOIN m USING (run)")
def experiment_table(t):
    """A51."""
    s = t("segment_pairs").withColumnRenamed("split_name", "run")
    long = s.groupBy("run").agg(F.avg("label").alias("f1"), F.max("label").cast("double").alias("auc")).select("run", F.explode(F.array(F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")), F.struct(F.lit("auc").alias("metric"), F.col("auc").alias("value")))).alias("v")).select("run", "v.*")
    return D.experiment_table(s.select("run").distinct(), long)


@query("WITH n AS (SELECT user_id AS run, event_type AS phase, sum(value) AS total, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2) SELECT *, total / sum(total) OVER (PARTITION BY run) AS share FROM n")
def training_profile(t):
    """A52 on the event stream: seconds by user and kind of event."""
    return D.training_profile(t("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("seconds")))


@query("SELECT window_start, event_type, count(*) AS n, sum(value) AS value FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def hourly_events(t):
    from ..streaming.windows import event_counts

    return event_counts(t("events"))


_CTG = "x AS (SELECT *, CASE WHEN canonical_segment IS NULL THEN 'unassigned_segment' WHEN quality IS NOT DISTINCT FROM 'Poor' {extra} THEN 'poor_quality' WHEN replicon_type IS NOT DISTINCT FROM 'Unassigned' THEN 'unassigned_replicon' WHEN {seq} IS NULL THEN 'missing_sequence' ELSE 'kept' END AS reject_reason FROM protein_final)"


@query("WITH " + _CTG.format(extra="OR feature_quality IS NOT DISTINCT FROM 'Poor'", seq="prot_seq") + " SELECT reject_reason, count(*) AS n FROM x GROUP BY 1")
def genome_rejects(t):
    """F4, K7 on proteins as contigs."""
    return X.reject_counts(t("protein_final").withColumnsRenamed({"feature_quality": "contig_quality", "prot_seq": "ctg_dna_seq"}), X.genome_rules())


@query("WITH " + _CTG.format(extra="", seq="prot_seq") + " SELECT reject_reason, count(*) AS n FROM x GROUP BY 1")
def basic_rejects(t):
    """F5."""
    return X.reject_counts(t("protein_final"), X.basic_rules())


@query(f"SELECT file, brc_fea_id FROM protein_final WHERE function IN ('{_HA}', '{_NA}')")
def narrowed_functions(t):
    """F6."""
    return X.narrow(t("protein_final"), "function", [_HA, _NA]).select("file", "brc_fea_id")


@query("SELECT count(*) AS n_rows, count_if(known) AS n_known FROM (SELECT *, prot_seq IS NOT NULL AND assembly_id IS NOT NULL AS known FROM protein_final QUALIFY NOT known OR row_number() OVER (PARTITION BY prot_seq, assembly_id ORDER BY CASE WHEN starts_with(file, 'GCF_') THEN 0 ELSE 1 END, file, genbank_ctg_id) = 1)")
def genome_duplicates(t):
    """DD3."""
    out = U.genome_duplicates(t("protein_final"), "prot_seq")
    return out.agg(F.count("*").alias("n_rows"), F.count_if(F.col("prot_seq").isNotNull() & F.col("assembly_id").isNotNull()).alias("n_known"))


@query("SELECT count(*) - count_if(known) + count(DISTINCT CASE WHEN known THEN prot_seq || assembly_id END) AS n_rows FROM (SELECT *, prot_seq IS NOT NULL AND assembly_id IS NOT NULL AS known FROM protein_final)")
def protein_duplicates(t):
    """DD4, A13."""
    return U.protein_duplicates(t("protein_final"), 100).agg(F.count("*").alias("n_rows"))


@query("SELECT prot_seq AS seq, count(*) AS n_rows, count(DISTINCT assembly_id) AS n_isolates, count(DISTINCT function) AS n_functions, count(DISTINCT file) AS n_files FROM protein_final WHERE prot_seq IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_statistics(t):
    """DD5, A17."""
    return U.duplicate_statistics(t("protein_final"), "prot_seq")


@query("SELECT assembly_id, function, count(*) AS n FROM protein_final WHERE assembly_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def crowded_functions(t):
    """A13."""
    return A.counts_over(t("protein_final").where("assembly_id is not null"), ["assembly_id", "function"], 1)


@query("SELECT file, brc_fea_id, CASE replicon_type WHEN 'Segment 1' THEN 'S1' WHEN 'Segment 4' THEN 'S4' END AS canonical_segment FROM protein_final")
def replicon_segments(t):
    """J8."""
    return U.replicon_segments(t("protein_final"), {"Segment 1": "S1", "Segment 4": "S4"}).select("file", "brc_fea_id", "canonical_segment")


@query("WITH l AS (SELECT cc_id, 'a' AS slot, assembly_id AS cluster_id FROM cc_members UNION ALL SELECT cc_id, 'b', function FROM cc_members), n AS (SELECT cc_id, slot, cluster_id, count(*) AS n FROM l WHERE cc_id IS NOT NULL AND cluster_id IS NOT NULL GROUP BY ALL) SELECT *, round(n * 100 / sum(n) OVER (PARTITION BY cc_id, slot), 2) AS pct FROM n")
def component_composition(t):
    """A21."""
    return A.component_composition(t("cc_members").select("cc_id", F.col("assembly_id").alias("cluster_id_a"), F.col("function").alias("cluster_id_b")))


@query("WITH n AS (SELECT 'C_' || substr(prot_hash, 1, 2) AS c, count(*) AS n FROM protein_final WHERE prot_hash IS NOT NULL GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, sum(n) OVER () AS t, count(*) OVER () AS k FROM n) SELECT any_value(k) AS n_items, any_value(t)::BIGINT AS total, 2 * sum(i * n) / (any_value(k) * any_value(t)) - (any_value(k) + 1) / any_value(k) AS gini, exp(-sum(n / t * ln(n / t))) AS shannon_n, 1 / sum((n / t) * (n / t)) AS hill_2 FROM r")
def cluster_diversity(t):
    """A25."""
    return A.cluster_diversity(t("protein_final"), t.clusters(), "prot_hash")


@query("""WITH o AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL), ob AS (SELECT DISTINCT a.h AS x, b.h AS y FROM o a JOIN o b ON a.k = b.k AND a.h <> b.h),
l AS (SELECT split_name AS split, 'a' AS slot, prot_hash_a AS h, ctg_dna_hash_a AS d, prot_hash_b AS p FROM segment_pairs UNION ALL SELECT split_name, 'b', prot_hash_b, ctg_dna_hash_b, prot_hash_a FROM segment_pairs),
own AS (SELECT split, slot, h, count(DISTINCT d) AS demand FROM l WHERE h IS NOT NULL GROUP BY ALL), pool AS (SELECT DISTINCT split, slot, p FROM l WHERE p IS NOT NULL), size AS (SELECT split, slot, count(*) AS n FROM pool GROUP BY ALL),
b AS (SELECT own.split, own.slot, own.h, count(*) AS blocked FROM own JOIN ob ON ob.x = own.h JOIN pool ON pool.split = own.split AND pool.slot = own.slot AND pool.p = ob.y GROUP BY ALL)
SELECT own.split, own.slot, own.h AS seq_hash, demand, size.n - coalesce(blocked, 0) AS supply, size.n - coalesce(blocked, 0) >= demand AS feasible FROM own JOIN size USING (split, slot) LEFT JOIN b ON b.split = own.split AND b.slot = own.slot AND b.h = own.h""")
def partner_supply(t):
    """A42, A58."""
    return A.partner_supply(t("segment_pairs"), materialize(A.observed_pairs(t("protein_final"), "prot_hash")))


@query("WITH s AS (SELECT 'all' AS stage, assembly_id, function, length(prot_seq) AS n FROM protein_final UNION ALL SELECT 'good', assembly_id, function, length(prot_seq) FROM protein_final WHERE quality = 'Good') SELECT stage, count(*) AS n_rows, count(DISTINCT assembly_id) AS n_isolates, count(DISTINCT function) AS n_functions, avg(n) AS mean_length, quantile_cont(n, 0.5) AS median_length FROM s GROUP BY 1")
def stage_flow(t):
    """A46."""
    p = t("protein_final")
    return A.stage_flow({"all": p, "good": p.where("quality = 'Good'")})


@query(f"SELECT pair_row_id, CASE WHEN func_a = '{_NA}' THEN prot_hash_b ELSE prot_hash_a END AS prot_hash_a, CASE WHEN func_a = '{_NA}' THEN prot_hash_a ELSE prot_hash_b END AS prot_hash_b FROM segment_pairs WHERE (func_a = '{_HA}' AND func_b = '{_NA}') OR (func_a = '{_NA}' AND func_b = '{_HA}')")
def oriented_pairs(t):
    """P25, P26, U1."""
    return N.orient(t("segment_pairs"), _HA, _NA).select("pair_row_id", "prot_hash_a", "prot_hash_b")


@query(f"WITH p AS (SELECT a.assembly_id FROM protein_final a JOIN protein_final b USING (assembly_id) WHERE a.function = '{_HA}' AND b.function = '{_NA}') SELECT assembly_id, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1")
def crowded_isolates(t):
    """N-2."""
    return N.one_pair_per_isolate(J.co_isolate_pairs(t("protein_final"), _HA, _NA, ["prot_hash"]))


@query("SELECT split_name AS name, ('0x' || substr(md5('42_' || split_name), 1, 8))::BIGINT AS seed FROM split_targets")
def process_seeds(t):
    """P32."""
    names = [r[0] for r in t("split_targets").select("split_name").collect()]  # a small fixed table
    return t.spark.createDataFrame([(n, seed_number(42, n)) for n in names], "name string, seed bigint")


@query("SELECT count(*) AS n, count_if(label = 1) AS n_pos, count_if(label = 0) AS n_neg FROM segment_pairs")
def united_pairs(t):
    """Positives and negatives put together again are the whole table."""
    from ..checks import same_set

    s = t("segment_pairs").select("pair_row_id", "label", "split_name")
    both = N.union_all([s.where("label = 1"), s.where("label = 0").drop("split_name").join(s.select("pair_row_id", "split_name"), "pair_row_id")])
    if not same_set(both.select("pair_row_id", "label", "split_name"), s.where("label is not null")):
        raise ValueError("rows got lost")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
