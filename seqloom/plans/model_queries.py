"""Queries on metrics, graphs, splits and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as M
from ..operators import splits as S
from ..operators import vectors as V
from .registry import CLUSTERED, PREDICTIONS, query


@query(f"WITH {PREDICTIONS} SELECT l_linenumber, count_if(label = 0 AND pred_label = 0) AS tn, count_if(label = 0 AND pred_label = 1) AS fp, count_if(label = 1 AND pred_label = 0) AS fn, count_if(label = 1 AND pred_label = 1) AS tp FROM predictions GROUP BY 1")
def confusion(t):
    return M.confusion(t.predictions(), ["l_linenumber"])


@query(f"""WITH {PREDICTIONS}, s AS (SELECT l_linenumber, pred_prob, count_if(label = 1) AS p, count_if(label = 0) AS n FROM predictions GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM s WINDOW w AS (PARTITION BY l_linenumber ORDER BY pred_prob DESC))
SELECT l_linenumber, sum(n * (tp - p) + n * p / 2) / (sum(p)::DOUBLE * sum(n)) AS auc_roc, sum(p * tp / (tp + fp)) / sum(p) AS auc_pr FROM r GROUP BY 1""")
def ranking_metrics(t):
    return M.ranking_metrics(t.predictions(), ["l_linenumber"])


@query()
def classification_metrics(t):
    return M.classification_metrics(t.predictions(), ["l_linenumber"])


@query()
def stratum_metrics(t):
    return M.stratum_metrics(t.predictions(), ["l_linestatus"])


@query()
def best_threshold(t):
    return M.best_threshold(t.predictions())


@query(f"WITH {PREDICTIONS} SELECT least(floor(pred_prob * 10), 9)::INT AS bin, count(*) AS n, avg(pred_prob) AS mean_prob, avg(label::DOUBLE) AS positive_rate FROM predictions GROUP BY 1")
def calibration(t):
    return M.calibration(t.predictions())


@query("SELECT count(DISTINCT pair_key) AS n_keys, count(*) AS n_rows, count_if(label <> lo OR label <> hi) AS n_conflicts FROM segment_pairs JOIN (SELECT pair_key, min(label) AS lo, max(label) AS hi FROM segment_pairs WHERE split_name = 'train' AND pair_key IS NOT NULL GROUP BY 1) USING (pair_key) WHERE split_name = 'test'")
def split_leakage(t):
    s = t("segment_pairs")
    return M.split_leakage(s.where("split_name = 'train'"), s.where("split_name = 'test'"))


@query(f"""WITH RECURSIVE {CLUSTERED}, e AS (SELECT DISTINCT 'a:' || cluster_id_a AS u, 'b:' || cluster_id_b AS v FROM clustered WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), reach AS (SELECT u, u AS v FROM b UNION SELECT reach.u, b.v FROM reach JOIN b ON reach.v = b.u) SELECT u AS node, min(v) AS root FROM reach GROUP BY 1""")
def graph_components(t):
    return G.components(G.pair_bigraph(t.clustered()))


@query("SELECT function, count(DISTINCT prot_hash_a) AS n_a, count(DISTINCT prot_hash_b) AS n_b, count(DISTINCT prot_hash_a || prot_hash_b) AS n_pairs, count(DISTINCT prot_hash_a) * count(DISTINCT prot_hash_b) = count(DISTINCT prot_hash_a || prot_hash_b) AS infeasible FROM (SELECT func_a AS function, * FROM segment_pairs) WHERE prot_hash_a IS NOT NULL AND prot_hash_b IS NOT NULL AND function IS NOT NULL GROUP BY 1")
def infeasible_groups(t):
    return G.infeasible_components(t("segment_pairs").withColumn("function", F.col("func_a")), cc="function")


@query()
def routed_holdout(t):
    return S.drift(S.route_holdout(t("cc_members"), "cc_id", {"train": 0.8, "val": 0.1, "test": 0.1}), {"train": 0.8, "val": 0.1, "test": 0.1})


@query()
def group_folds(t):
    return S.group_folds(t("cc_members"), "cc_id", 5).groupBy("fold").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('1|' || doc_id), doc_id) <= round_even(0.1 * (SELECT count(*) FROM documents), 0) THEN 'val' ELSE 'train' END AS split FROM documents")
def carved_rows(t):
    return S.carve_rows(t("documents").select("doc_id"), "doc_id", 0.1, 1)


@query("SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) = 1")
def nearest_cosine(t):
    e = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return V.top_matches(e.where("id % 50 = 0"), e, 1).select("qid", "id", "similarity")
