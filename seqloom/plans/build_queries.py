"""Queries on split builds: positives, routing, folds, negatives, cuts and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.metadata import isolate_cells
from ..operators import aggregates as A
from ..operators import audits as D
from ..operators import builds as B
from ..operators import clustering as C
from ..operators import graph as G
from ..operators import pairs as N
from ..operators import splits as S
from ..scratch import materialize
from .registry import META, SQL, query
from .table_queries import _HA, _NA

_SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
#: One pair per key, of isolates with both functions; every sequence is a cluster of its own.
POSITIVES = f"""one AS (SELECT * FROM protein_final WHERE function IN ('{_HA}', '{_NA}') AND assembly_id IS NOT NULL AND prot_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY assembly_id, function ORDER BY file, brc_fea_id, prot_hash) = 1),
pos AS (SELECT a.assembly_id, a.prot_hash AS ha, b.prot_hash AS hb, least(a.prot_hash, b.prot_hash) || '__' || greatest(a.prot_hash, b.prot_hash) AS pair_key FROM one a JOIN one b USING (assembly_id) WHERE a.function = '{_HA}' AND b.function = '{_NA}' QUALIFY row_number() OVER (PARTITION BY least(a.prot_hash, b.prot_hash) || '__' || greatest(a.prot_hash, b.prot_hash) ORDER BY assembly_id, a.brc_fea_id, b.brc_fea_id) = 1)"""
#: Components of the positives, those without a possible negative left out, ranked by (-pairs, smallest node).
ATOMS = POSITIVES + """, nb AS (SELECT DISTINCT 'a:' || ha AS u, 'b:' || hb AS v FROM pos UNION SELECT DISTINCT 'b:' || hb, 'a:' || ha FROM pos),
reach AS (SELECT DISTINCT u, u AS v FROM nb UNION SELECT reach.u, nb.v FROM reach JOIN nb ON reach.v = nb.u), root AS (SELECT u, min(v) AS root FROM reach GROUP BY 1),
tagged AS (SELECT pos.*, root FROM pos JOIN root ON u = 'a:' || ha), big AS (SELECT root, count(*) AS n, count(DISTINCT ha) * count(DISTINCT hb) = count(DISTINCT ha || hb) AS infeasible FROM tagged GROUP BY 1),
ranked AS (SELECT root, n, infeasible, row_number() OVER (ORDER BY n DESC, root) - 1 AS cc_id FROM big)"""


def _lpt(sizes: str, names: list[str], shares: list[float]) -> str:
    """Whole groups of ``sizes`` (n, o) in order to the split that lacks most, as a recursive query ``filled`` (split, n, k)."""
    start = "[" + ", ".join(f"{s} * (SELECT sum(n) FROM g)" for s in shares) + "]::DOUBLE[]"
    zero = "[" + ", ".join("0" for _ in names) + "]::BIGINT[]"
    return f"""g AS (SELECT n, row_number() OVER (ORDER BY n DESC, o) AS i FROM {sizes}),
walk AS (SELECT 0::BIGINT AS i, {start} AS lack, {zero} AS k, {zero} AS c UNION ALL SELECT g.i, list_transform(lack, lambda v, j: CASE WHEN j = list_position(lack, list_max(lack)) THEN v - g.n ELSE v END), list_transform(k, lambda v, j: CASE WHEN j = list_position(lack, list_max(lack)) THEN v + g.n ELSE v END), list_transform(c, lambda v, j: CASE WHEN j = list_position(lack, list_max(lack)) THEN v + 1 ELSE v END) FROM walk JOIN g ON g.i = walk.i + 1),
done AS (SELECT k, c FROM walk ORDER BY i DESC LIMIT 1), filled AS (SELECT unnest({names}) AS split, unnest(k) AS n, unnest(c) AS n_groups FROM done)"""


def _own_clusters(t):
    return t("protein_final").where("prot_hash is not null").select(F.col("prot_hash").alias("hash")).distinct().withColumn("cluster_id", F.col("hash"))


@query(f"WITH RECURSIVE {ATOMS}, {_lpt('(SELECT n, cc_id AS o FROM ranked WHERE NOT infeasible)', list(_SHARES), list(_SHARES.values()))} SELECT split, n, n_groups FROM filled WHERE n > 0")
def routed_positives(t):
    """N-16, N-17, B10: whole components of the positives, routed to splits."""
    pos, _ = B.build_positives(t("protein_final"), _HA, _NA, _own_clusters(t))
    return B.partition(pos, "holdout", shares=_SHARES).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("cc_id").alias("n_groups"))


@query("SELECT 0::BIGINT AS keys_in_two_splits, 0::BIGINT AS keys_twice, 0::BIGINT AS isolates_in_two_splits, 0::BIGINT AS observed_negatives, 0::BIGINT AS negatives_of_one_isolate, 0::BIGINT AS splits_without_negatives")
def split_dataset_checks(t):
    """N-14: a whole labelled build; counts of broken rules, among them splits that got no negative at all (fewer than asked for they have where no more exist)."""
    d = materialize(B.split_dataset(t("protein_final"), _HA, _NA, _own_clusters(t), isolate_cells(t.meta()), shares=_SHARES))
    few = d.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).agg(F.count_if((F.col("p") > 0) & (F.col("n") == 0)).alias("splits_without_negatives"))
    return B.split_invariants(d, A.observed_pairs(t("protein_final"), "prot_hash")).join(F.broadcast(few))


@query(f"""WITH {META}, obs AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL)
SELECT 'host_only' AS regime, 40::BIGINT AS target, 'met' AS reason, 0::BIGINT AS n_bad UNION ALL SELECT 'none_match', 40, 'met', 0 UNION ALL SELECT 'year_only', 120, 'met', 0""")
def negative_quotas(t):
    """N-3 to N-5, N-7, N-8: negatives for 200 pairs at three regimes' quotas; whether each was met and how many negatives are wrong."""
    cells, n, targets = isolate_cells(t.meta()), 200, {"host_only": 0.2, "none_match": 0.2, "year_only": 0.6}
    observed = materialize(A.observed_pairs(t("protein_final"), "prot_hash").select("pair_key"))
    neg = materialize(B.negative_pairs(t("protein_final"), _HA, _NA, observed, n, cells=cells, targets=targets))
    m = N.regime_manifest(neg, A.regime_supply(cells), targets, n).where("target > 0").select("regime", "target", "reason")
    bad = neg.join(observed, "pair_key", "left_semi").unionByName(neg.where("assembly_id_a = assembly_id_b")).groupBy(F.col("neg_regime").alias("regime")).agg(F.count("*").alias("n_bad"))
    return m.join(bad, "regime", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))


@query(f"WITH obs AS (SELECT DISTINCT assembly_id AS k, prot_hash AS h FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL), o AS (SELECT DISTINCT a.h || '__' || b.h AS pair_key FROM obs a JOIN obs b ON a.k = b.k AND a.h < b.h), {POSITIVES}, a AS (SELECT DISTINCT ha AS h FROM pos), b AS (SELECT DISTINCT hb AS h FROM pos), c AS (SELECT 'a' AS slot, a.h, count_if(a.h <> b.h AND least(a.h, b.h) || '__' || greatest(a.h, b.h) NOT IN (SELECT pair_key FROM o)) AS free FROM a, b GROUP BY 1, 2 UNION ALL SELECT 'b', b.h, count_if(a.h <> b.h AND least(a.h, b.h) || '__' || greatest(a.h, b.h) NOT IN (SELECT pair_key FROM o)) FROM a, b GROUP BY 1, 2) SELECT slot, count(*) AS n_sequences, count_if(free > 0) AS n_covered, count_if(free = 0) AS n_uncovered FROM c GROUP BY 1")
def negative_coverage(t):
    """N-3: sequences of the positives with a negative: all that have any possible partner."""
    pos, observed = B.build_positives(t("protein_final"), _HA, _NA, _own_clusters(t), drop_infeasible=False)
    pool = pos.select("assembly_id", "prot_hash_a", "prot_hash_b").withColumn("all", F.lit(1)).withColumn("cell", F.struct(*[F.lit(None).cast("string").alias(a) for a in ("host", "hn_subtype", "year")]))
    neg = B.covering_negatives(pool, "all", observed)
    records = pos.select(F.explode(F.array(F.struct(F.lit("a").alias("function"), F.col("prot_hash_a").alias("prot_hash")), F.struct(F.lit("b").alias("function"), F.col("prot_hash_b").alias("prot_hash")))).alias("v")).select("v.*")
    return N.coverage(neg, records, "a", "b")


@query()
def fold_negatives(t):
    """N-9, N-10, N-12, N-13: negatives inside each fold of the positives, half as many as it has positives."""
    pos, observed = B.build_positives(t("protein_final"), _HA, _NA, _own_clusters(t))
    folds = materialize(S.isolate_folds(pos, "assembly_id", 3, 1).withColumn("split", F.col("fold").cast("string")))
    neg = N.within_split_negatives(folds, observed, 0.5, ["0", "1", "2"])
    return neg.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("pair_key").alias("n_keys"))


@query("SELECT split, 0::BIGINT AS n_true, 0::BIGINT AS n_equal FROM (SELECT DISTINCT split_name AS split FROM segment_pairs)")
def shuffled_negatives(t):
    """The next pair's b sequence for each a sequence of a split; true pairs and equal sequences among them."""
    s = t("segment_pairs").withColumnRenamed("split_name", "split").where("pair_key is not null")
    neg = materialize(B.shuffled_negatives(s, "split"))
    true = neg.join(s.select("pair_key"), "pair_key", "left_semi").groupBy("split").agg(F.count("*").alias("n_true"))
    out = neg.groupBy("split").agg(F.count_if(F.col("prot_hash_a") == F.col("prot_hash_b")).alias("n_equal")).join(true, "split", "left")
    return out.select("split", F.coalesce("n_true", F.lit(0)).alias("n_true"), "n_equal")


@query("SELECT source, least(count(*), 20) AS n FROM segment_pairs WHERE pair_key IS NOT NULL GROUP BY 1")
def sampled_positives(t):
    s = t("segment_pairs").where("pair_key is not null").withColumn("row", F.col("pair_row_id").cast("string"))
    return B.sample_positives(s, ["source"], 20, key="row").groupBy("source").agg(F.count("*").alias("n"))


SQL["routed_holdout"] = f"WITH RECURSIVE s AS (SELECT count(*) AS n, cc_id AS o FROM cc_members WHERE cc_id IS NOT NULL GROUP BY cc_id), {_lpt('s', list(_SHARES), list(_SHARES.values()))} SELECT split, n, n / sum(n) OVER () AS share, CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END AS target, abs(n / sum(n) OVER () - CASE split WHEN 'train' THEN 0.8 ELSE 0.1 END) AS deviation FROM filled"
_FOLDS5 = _lpt("s", ["0", "1", "2", "3", "4"], [0.0] * 5).replace("0.0 * (SELECT sum(n) FROM g)", "0")
SQL["group_folds"] = f"WITH RECURSIVE s AS (SELECT count(*) AS n, cc_id AS o FROM cc_members WHERE cc_id IS NOT NULL GROUP BY cc_id), {_FOLDS5} SELECT split::INT AS fold, n FROM filled UNION ALL SELECT NULL, count(*) FROM cc_members WHERE cc_id IS NULL"


@query(f"WITH RECURSIVE s AS (SELECT count(*) AS n, cc_id AS o FROM cc_members WHERE cc_id IS NOT NULL GROUP BY cc_id), {_FOLDS5} SELECT split::INT AS fold, n_groups, n / sum(n) OVER () AS test_share, abs(n / sum(n) OVER () - 0.2) AS drift, abs(n / sum(n) OVER () - 0.2) <= 0.05 AND n / sum(n) OVER () >= 0.05 AND 0.1 < 1 - n / sum(n) OVER () AS feasible FROM filled")
def fold_feasibility(t):
    m = t("cc_members").where("cc_id is not null")
    return B.fold_feasibility(S.group_folds(m, "cc_id", 5), 5)


@query("WITH g AS (SELECT lab_id, count(*) AS n FROM documents WHERE lab_id IS NOT NULL GROUP BY 1), b AS (SELECT lab_id, coalesce(sum(n) OVER (ORDER BY md5('2|' || lab_id), lab_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g) SELECT doc_id, CASE WHEN lab_id IN (SELECT lab_id FROM b WHERE before < 0.2 * (SELECT count(*) FROM documents)) THEN 'val' ELSE 'train' END AS split FROM documents")
def carved_groups(t):
    return S.carve_groups(t("documents").select("doc_id", "lab_id"), "lab_id", 0.2, 2).select("doc_id", "split")


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('4|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r < (n * 0.8)::DOUBLE::BIGINT THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM p")
def random_splits(t):
    return S.random_split(t("documents").select("doc_id"), "doc_id", _SHARES, 4)


@query("WITH i AS (SELECT assembly_id, row_number() OVER (ORDER BY md5('6|' || assembly_id), assembly_id) - 1 AS r FROM (SELECT DISTINCT assembly_id FROM protein_final WHERE assembly_id IS NOT NULL)) SELECT (r % 4)::INT AS fold, count(*) AS n, count(DISTINCT assembly_id) AS n_isolates FROM protein_final LEFT JOIN i USING (assembly_id) GROUP BY 1")
def isolate_folds(t):
    return S.isolate_folds(t("protein_final"), "assembly_id", 4, 6).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("assembly_id").alias("n_isolates"))


@query("WITH top AS (SELECT cc_id, row_number() OVER (ORDER BY count(*) DESC, cc_id) - 1 AS i FROM cc_members WHERE cc_id IS NOT NULL GROUP BY 1), n AS (SELECT i, count_if(m.cc_id = top.cc_id) AS test, count_if(m.cc_id IS DISTINCT FROM top.cc_id) AS rest FROM cc_members m, top WHERE i < 2 GROUP BY 1) SELECT i::INT AS fold, test AS n_test, round_even(0.1 * rest, 0)::BIGINT AS n_val, rest - round_even(0.1 * rest, 0)::BIGINT AS n_train FROM n")
def left_out_groups(t):
    m = t("cc_members").withColumn("label", F.lit(1))
    out = None
    for i, f in enumerate(S.leave_one_out(m, "cc_id", 2, "record_id", 0.1, 3)):
        part = f.agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("test", "val", "train")]).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r < n // 3 THEN 0 WHEN r < 2 * (n // 3) THEN 1 ELSE 2 END AS fold FROM p")
def matched_folds(t):
    d = t("documents").select("doc_id")
    n = d.count()
    return S.random_folds(d, "doc_id", [n // 3, n // 3, n - 2 * (n // 3)], 8)


@query("WITH f AS (SELECT record_id, record_id % 4 AS fold FROM cc_members), r AS (SELECT record_id, row_number() OVER (ORDER BY md5('5|' || record_id), record_id) AS i FROM f WHERE fold <> 1) SELECT record_id, 'test' AS split FROM f WHERE fold = 1 UNION ALL SELECT record_id, CASE WHEN i <= round_even(0.1 * (SELECT count(*) FROM f), 0) THEN 'val' ELSE 'train' END FROM r")
def fold_rows(t):
    return S.fold_rows(t("cc_members").select("record_id", (F.col("record_id") % 4).alias("fold")), 1, "record_id", 0.1, 5).select("record_id", "split")


@query(f"WITH {META}, i AS (SELECT assembly_id, min(hn_subtype) AS s, min(year) AS y FROM meta GROUP BY 1), c AS (SELECT assembly_id, CASE WHEN s = 'H3N2' AND y BETWEEN 2015 AND 2030 THEN 'test' WHEN s = 'H1N1' THEN 'train' ELSE 'dropped' END AS k FROM i WHERE assembly_id IS NOT NULL), n AS (SELECT count_if(k = 'train') AS t, count_if(k = 'test') AS e, count_if(k = 'dropped') AS d FROM c) SELECT 'test' AS slot, e AS n FROM n UNION ALL SELECT 'val', round_even(0.1 * t, 0)::BIGINT FROM n UNION ALL SELECT 'train', t - round_even(0.1 * t, 0)::BIGINT FROM n UNION ALL SELECT 'dropped', d FROM n")
def metadata_holdout(t):
    return S.metadata_holdout(t.meta(), {"hn_subtype": "H1N1"}, {"hn_subtype": "H3N2", "year_range": (2015, 2030)}, 0.1, 9).groupBy("slot").agg(F.count("*").alias("n"))


@query(f"WITH {META}, k AS (SELECT hn_subtype, count(DISTINCT assembly_id) AS n FROM meta WHERE hn_subtype IS NOT NULL AND assembly_id IS NOT NULL GROUP BY 1) SELECT hn_subtype, (SELECT min(n) FROM k) AS n_isolates FROM k")
def balanced_pool(t):
    return S.balanced_pool(t.meta(), "hn_subtype", 3).groupBy("hn_subtype").agg(F.count_distinct("assembly_id").alias("n_isolates"))


@query("WITH g AS (SELECT cc_id FROM (SELECT DISTINCT cc_id FROM cc_members WHERE cc_id IS NOT NULL) ORDER BY md5('1|' || cc_id), cc_id LIMIT 5) SELECT record_id FROM cc_members WHERE cc_id IN (FROM g)")
def sampled_groups(t):
    return S.sample_groups(t("cc_members"), "cc_id", 5, 1).select("record_id")


@query("WITH i AS (SELECT id FROM (SELECT assembly_id_a AS id FROM segment_pairs UNION SELECT assembly_id_b FROM segment_pairs) WHERE id IS NOT NULL ORDER BY md5('1|' || id), id LIMIT 30) SELECT pair_row_id FROM segment_pairs WHERE assembly_id_a IN (FROM i) OR assembly_id_b IN (FROM i)")
def sampled_either_side(t):
    return S.sample_either_side(t("segment_pairs"), 30, 1).select("pair_row_id")


_GRAPH = """nb AS (SELECT DISTINCT 'a:' || cluster_id_a AS u, 'b:' || cluster_id_b AS v FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL UNION SELECT DISTINCT 'b:' || cluster_id_b, 'a:' || cluster_id_a FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL),
reach AS (SELECT DISTINCT u, u AS v FROM nb UNION SELECT reach.u, nb.v FROM reach JOIN nb ON reach.v = nb.u), root AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY 1),
tagged AS (SELECT e.*, root FROM cluster_pair_edges e LEFT JOIN root ON node = 'a:' || cluster_id_a AND cluster_id_b IS NOT NULL), sized AS (SELECT root, count(*) AS n FROM tagged WHERE root IS NOT NULL GROUP BY 1), ranked AS (SELECT root, n, row_number() OVER (ORDER BY n DESC, root) - 1 AS cc_id FROM sized)"""


@query(f"WITH RECURSIVE {_GRAPH} SELECT edge_id, cc_id FROM tagged LEFT JOIN ranked USING (root)")
def cluster_components(t):
    return G.cluster_components(t("cluster_pair_edges")).select("edge_id", "cc_id")


@query(f"WITH RECURSIVE {_GRAPH} SELECT node, cc_id AS cc_rank FROM root JOIN ranked USING (root)")
def component_ranks(t):
    return D.component_ranks(t("cluster_pair_edges"))


@query(f"WITH RECURSIVE {_GRAPH}, s AS (SELECT root.root, count(*) AS n_nodes, any_value(n) AS n_pairs FROM root JOIN sized USING (root) GROUP BY 1) SELECT root, n_nodes, n_pairs, n_nodes >= 2 AS is_live, row_number() OVER (ORDER BY n_pairs DESC, root) = 1 AS is_largest FROM s")
def atom_weights(t):
    return D.atom_weights(materialize(G.pair_bigraph(t("cluster_pair_edges"))))


@query(f"""WITH RECURSIVE {_GRAPH}, e AS (SELECT root, cluster_id_a AS a, cluster_id_b AS b, count(*) AS w FROM tagged WHERE root IS NOT NULL GROUP BY ALL), n AS (SELECT root, count_if(starts_with(node, 'a:')) AS n_a, count_if(starts_with(node, 'b:')) AS n_b FROM root GROUP BY 1),
d AS (SELECT root, max(w) AS hub FROM (SELECT root, 'a' || a AS x, sum(w) AS w FROM e GROUP BY ALL UNION ALL SELECT root, 'b' || b, sum(w) FROM e GROUP BY ALL) GROUP BY 1)
SELECT e.root, any_value(n_a) AS n_a, any_value(n_b) AS n_b, count(*) AS n_edges, sum(w)::BIGINT AS n_pairs, any_value(hub) / sum(w) AS hub_share FROM e JOIN n USING (root) JOIN d USING (root) GROUP BY 1""")
def component_structure(t):
    return G.component_structure(materialize(G.pair_bigraph(t("cluster_pair_edges"))))


@query(f"WITH RECURSIVE {_GRAPH}, s AS (SELECT round(n / sum(n) OVER (), 4) AS share, row_number() OVER (ORDER BY n DESC, cc_id) AS r FROM ranked) SELECT max(CASE WHEN r = 1 THEN share END) AS largest_share, coalesce(max(CASE WHEN r = 2 THEN share END), 0.0) AS second_share, count(*) AS n_components, max(CASE WHEN r = 1 THEN share END) <= 0.8 AND coalesce(max(CASE WHEN r = 2 THEN share END), 0.0) <= 0.2 AS feasible FROM s")
def split_feasibility(t):
    return G.feasibility(G.cluster_components(t("cluster_pair_edges")))


@query("""WITH RECURSIVE h AS (SELECT cluster_id_a AS u, cluster_id_b AS v FROM cluster_pair_edges WHERE fident >= 0.95 AND cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL), b AS (SELECT u, v FROM h UNION SELECT v, u FROM h), n AS (SELECT cluster_id_a AS u FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL UNION SELECT cluster_id_b FROM cluster_pair_edges WHERE cluster_id_b IS NOT NULL),
reach AS (SELECT u, u AS v FROM n UNION SELECT reach.u, b.v FROM reach JOIN b ON reach.v = b.u), root AS (SELECT u, min(v) AS root FROM reach GROUP BY 1), k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS i FROM root GROUP BY 1) SELECT u AS hash, 'C_' || i AS cluster_id FROM root JOIN k USING (root)""")
def hit_clusters(t):
    e = t("cluster_pair_edges")
    hits = e.where("cluster_id_a is not null and cluster_id_b is not null").select(F.col("cluster_id_a").alias("query"), F.col("cluster_id_b").alias("target"), "fident")
    return G.clusters_from_hits(hits, e.select(F.explode(F.array("cluster_id_a", "cluster_id_b")).alias("hash")).where("hash is not null"), least_identity=0.95)


@query("SELECT edge_id FROM cluster_pair_edges WHERE (cluster_id_a, cluster_id_b) IN (SELECT (cluster_id_a, cluster_id_b) FROM cluster_pair_edges WHERE n_pairs > 80 AND cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL)")
def crossing_pairs(t):
    e = t("cluster_pair_edges")
    cut = e.where("n_pairs > 80 and cluster_id_a is not null and cluster_id_b is not null").select(F.concat(F.lit("b:"), "cluster_id_b").alias("src"), F.concat(F.lit("a:"), "cluster_id_a").alias("dst"))
    return D.crossing_pairs(e, cut).select("edge_id")


@query("SELECT 'a:' || cluster_id_a AS src, 'b:' || cluster_id_b AS dst, count(*) AS weight FROM (SELECT DISTINCT edge_id, cluster_id_a, cluster_id_b FROM cluster_pair_edges) WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL GROUP BY 1, 2")
def stored_bigraph(t):
    return D.bigraph_of_stored(t("cluster_pair_edges").withColumn("pair_key", F.col("edge_id").cast("string")))


@query()
def graph_cut(t):
    """The cluster graph cut until its splits pack; the audit."""
    _, dropped, audit = G.fragment_to_targets(t("cluster_pair_edges"), _SHARES, 0.05)
    return t.spark.createDataFrame([(audit["n_cuts"], audit["n_atoms"], audit["pairs_dropped"], audit["dropped_frac"], audit["stopped_reason"], dropped.count())], "n_cuts int, n_atoms int, pairs_dropped bigint, dropped_frac double, stopped_reason string, n_dropped_rows bigint")


@query()
def peeled_hubs(t):
    """Cluster nodes removed, busiest first, until no component holds more than a twentieth of the pairs."""
    return t.spark.createDataFrame(G.hub_peel(G.pair_bigraph(t("cluster_pair_edges")), 0.05), "step int, node string, largest_share_before double")


@query("""WITH s AS (SELECT prot_hash AS h, min(prot_seq) AS q FROM protein_final WHERE prot_hash IS NOT NULL AND prot_seq IS NOT NULL AND function = 'Neuraminidase surface protein' GROUP BY 1)
SELECT a.h AS query, b.h AS target, 1 - levenshtein(a.q, b.q) / greatest(length(a.q), length(b.q)) AS fident, least(length(a.q), length(b.q)) / length(a.q) AS qcov, least(length(a.q), length(b.q)) / length(b.q) AS tcov FROM s a JOIN s b ON a.h < b.h
WHERE least(length(a.q), length(b.q)) >= 0.95 * greatest(length(a.q), length(b.q)) AND 1 - levenshtein(a.q, b.q) / greatest(length(a.q), length(b.q)) >= 0.95""")
def sequence_hits(t):
    """All hits among the sequences of one protein."""
    s = t("protein_final").where(F.col("function") == _NA).select(F.col("prot_hash").alias("hash"), F.col("prot_seq").alias("seq"))
    return C.search(s, least_identity=0.95, m=1_000)


@query()
def sequence_clusters(t):
    """Greedy clusters of two proteins at two thresholds."""
    s = t("protein_final").select("function", F.col("prot_hash").alias("hash"), F.col("prot_seq").alias("seq"))
    c = C.cluster_functions(s, [_HA, _NA, "No such protein"], [0.95, 0.9])
    return c.groupBy("function", "threshold").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("n_clusters"))
