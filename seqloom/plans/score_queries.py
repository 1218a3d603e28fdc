"""Queries on scored pairs: strata, calibration, thresholds and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters as X
from ..operators import metrics as M
from ..operators import models as L
from .registry import FLAGGED, PREDICTIONS, SQL, query

#: Every pair with a score that depends on its id alone.
SCORED = FLAGGED + ", scored AS (SELECT *, (pair_row_id * 37 % 101) / 100 AS pred_prob, ((pair_row_id * 37 % 101) / 100 > 0.5)::INT AS pred_label FROM flagged)"


def scored(t):
    return M.predict(t.flagged().withColumn("pred_prob", (F.col("pair_row_id") * 37 % 101) / 100), 0.5)


def _regimes(t):
    return scored(t).withColumn("neg_regime", F.coalesce("neg_regime", F.lit("none_match")))


_REG = ", reg AS (SELECT * REPLACE (coalesce(neg_regime, 'none_match') AS neg_regime) FROM scored)"


@query(f"WITH {SCORED} SELECT label, count(*) AS n, avg(pred_prob) AS mean, quantile_cont(pred_prob, 0.5) AS median, stddev_samp(pred_prob) AS std, min(pred_prob) AS least, max(pred_prob) AS most, quantile_cont(pred_prob, 0.1) AS q10, quantile_cont(pred_prob, 0.9) AS q90 FROM scored GROUP BY 1")
def score_distribution(t):
    return M.score_distribution(scored(t))


_HITS = "coalesce(same_host, false)::INT + coalesce(same_hn_subtype, false)::INT + coalesce(same_year, false)::INT"


@query(f"WITH {SCORED} SELECT {_HITS} AS match_count, count(*) AS n, avg(pred_label) AS fp_rate, avg(pred_prob) AS mean_prob, quantile_cont(pred_prob, 0.5) AS median_prob FROM scored WHERE label = 0 GROUP BY 1")
def match_count_strata(t):
    return M.match_count_strata(scored(t))


@query(f"WITH {SCORED}, p AS (SELECT *, concat_ws(',', CASE WHEN same_host THEN 'host' END, CASE WHEN same_hn_subtype THEN 'hn_subtype' END, CASE WHEN same_year THEN 'year' END) AS k FROM scored WHERE label = 0) SELECT CASE WHEN k = '' THEN 'none' ELSE k END AS pattern, count(*) AS n, count_if(pred_label = 1) AS n_fp, avg(pred_label) AS fp_rate FROM p GROUP BY 1")
def hardness_patterns(t):
    return M.hardness_patterns(scored(t))


@query(f"WITH {SCORED} SELECT least(seg_a, seg_b) || '-' || greatest(seg_a, seg_b) AS segments, count(*) AS n, avg((label = pred_label)::INT) AS accuracy FROM scored WHERE seg_a IS NOT NULL AND seg_b IS NOT NULL GROUP BY 1 HAVING count(*) > 10")
def segment_performance(t):
    return M.segment_performance(scored(t))


_BINS = " ".join(f"WHEN c > {lo}::DOUBLE AND c <= {hi}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(((0.0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0))))


@query(f"WITH {SCORED}, x AS (SELECT *, abs(pred_prob - 0.5) * 2 AS c FROM scored) SELECT CASE {_BINS} END AS bin, count(*) AS n, avg((label = pred_label)::INT) AS accuracy FROM x GROUP BY 1")
def confidence_bins(t):
    return M.confidence_bins(scored(t))


@query(f"WITH {SCORED}{_REG}, o AS (SELECT * FROM (VALUES (0, 'positive'), (1, 'none_match'), (2, 'host_only'), (3, 'subtype_only'), (4, 'year_only'), (5, 'host_subtype_only'), (6, 'host_year_only'), (7, 'subtype_year_only'), (8, 'host_subtype_year')) v(position, neg_regime)), m AS (SELECT CASE WHEN label = 1 THEN 'positive' ELSE neg_regime END AS neg_regime, count(*) AS n, count_if(label = pred_label) AS k FROM reg GROUP BY 1) SELECT position, neg_regime, coalesce(n, 0) AS n, k / n AS rate FROM o LEFT JOIN m USING (neg_regime)")
def level1(t):
    return M.level1(_regimes(t))


@query(f"WITH {SCORED}, m AS (SELECT metadata_match_count AS c, count(*) AS n, count_if(pred_label = 0) AS k FROM scored WHERE label = 0 GROUP BY 1) SELECT i::INT AS metadata_match_count, coalesce(n, 0) AS n, k / n AS tnr FROM range(4) r(i) LEFT JOIN m ON m.c = i")
def level1_by_count(t):
    return M.level1_by_count(scored(t))


_STRATUM = "CASE WHEN host_a IS NULL OR host_b IS NULL OR host_a = 'unknown' OR host_b = 'unknown' THEN 'unknown' WHEN host_a = host_b THEN host_a ELSE 'mixed' END"


@query(f"WITH {SCORED}, x AS (SELECT {_STRATUM} AS s, label, pred_label FROM scored), n AS (SELECT s, count(*) AS k FROM x GROUP BY 1) SELECT CASE WHEN k < 10 AND s NOT IN ('unknown', 'mixed') THEN 'other' ELSE s END AS stratum, count(*) AS n, count_if(label = pred_label) AS n_right FROM x JOIN n USING (s) GROUP BY 1")
def level2_hosts(t):
    return M.level2_strata(scored(t), "host").groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred_label")).alias("n_right"))


@query("WITH seen AS (SELECT prot_hash_a AS h FROM segment_pairs WHERE split_name = 'train' UNION SELECT prot_hash_b FROM segment_pairs WHERE split_name = 'train') SELECT pair_row_id, (coalesce(prot_hash_a IN (SELECT h FROM seen WHERE h IS NOT NULL), false)::INT + coalesce(prot_hash_b IN (SELECT h FROM seen WHERE h IS NOT NULL), false)::INT) AS n_seen FROM segment_pairs WHERE split_name = 'test'")
def hash_overlap(t):
    s = t("segment_pairs")
    return M.hash_overlap(s.where("split_name = 'test'"), s.where("split_name = 'train'")).select("pair_row_id", "n_seen")


@query(f"WITH {PREDICTIONS}, g AS (SELECT (i * 0.05)::DECIMAL(3,2)::DOUBLE AS threshold FROM range(1, 20) r(i)), c AS (SELECT threshold, count_if(label = 1 AND pred_prob > threshold) AS tp, count_if(label = 0 AND pred_prob > threshold) AS fp, count_if(label = 1 AND pred_prob <= threshold) AS fn, count_if(label = 0 AND pred_prob <= threshold) AS tn FROM predictions, g GROUP BY 1) SELECT threshold, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2 AS f1_macro FROM c")
def threshold_grid(t):
    return M.threshold_grid(t.predictions())


@query(f"WITH {PREDICTIONS} SELECT count(*) AS n, count_if(label = 1) AS n_pos, CASE WHEN 2 * count_if(label = 1) >= count(*) THEN 2 * count_if(label = 1) / (count(*) + count_if(label = 1)) ELSE 0 END AS f1 FROM predictions")
def majority_baseline(t):
    return M.majority_baseline(t.predictions())


@query(f"WITH {PREDICTIONS} SELECT count_if(pred_prob >= 0.5) AS n_inclusive, count_if(pred_prob > 0.5) AS n_exclusive FROM predictions")
def threshold_edges(t):
    n = lambda i: F.sum("pred_label").cast("bigint")
    p = t.predictions()
    return M.predict(p, 0.5, inclusive=True).agg(n(1).alias("n_inclusive")).join(F.broadcast(M.predict(p, 0.5).agg(n(0).alias("n_exclusive"))))


@query(f"WITH {SCORED} SELECT pair_row_id, CASE WHEN label = 0 AND pred_label = 1 THEN 'fp' WHEN label = 1 AND pred_label = 0 THEN 'fn' END AS kind, abs(pred_prob - 0.5) < 0.1 AS is_uncertain FROM scored WHERE label <> pred_label")
def wrong_predictions(t):
    s = scored(t)
    both = X.errors(s, "fp").withColumn("kind", F.lit("fp")).unionByName(X.errors(s, "fn").withColumn("kind", F.lit("fn")))
    return both.select("pair_row_id", "kind", X.uncertain().alias("is_uncertain"))


_C = "count(*) AS n, count_if(label = 0 AND pred_label = 0)::DOUBLE AS tn, count_if(label = 0 AND pred_label = 1)::DOUBLE AS fp, count_if(label = 1 AND pred_label = 0)::DOUBLE AS fn, count_if(label = 1 AND pred_label = 1)::DOUBLE AS tp"


def _rank_sql(by: str) -> str:
    return f"""rs AS (SELECT {by}, pred_prob, count_if(label = 1) AS p, count_if(label = 0) AS n FROM predictions GROUP BY 1, 2),
rr AS (SELECT *, sum(p) OVER w AS utp, sum(n) OVER w AS ufp FROM rs WINDOW w AS (PARTITION BY {by} ORDER BY pred_prob DESC)),
rk AS (SELECT {by}, sum(n * (utp - p) + n * p / 2) / (sum(p)::DOUBLE * sum(n)) AS auc_roc, sum(p * utp / (utp + ufp)) / sum(p) AS auc_pr FROM rr GROUP BY 1)"""


SQL["classification_metrics"] = f"""WITH {PREDICTIONS}, {_rank_sql("l_linenumber")},
c AS (SELECT l_linenumber, {_C}, avg((pred_prob - label) * (pred_prob - label)) AS brier, avg(-(label * ln(least(1 - 1e-7, greatest(1e-7, pred_prob))) + (1 - label) * ln(1 - least(1 - 1e-7, greatest(1e-7, pred_prob))))) AS bce FROM predictions GROUP BY 1),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0) AS f0 FROM c)
SELECT l_linenumber, n, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, (tp + tn) / n AS accuracy, precision, recall, f1, (f1 + f0) / 2 AS f1_macro, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, brier, bce, coalesce(auc_roc, 0.5) AS auc_roc, auc_pr FROM d JOIN rk USING (l_linenumber)"""

SQL["stratum_metrics"] = f"""WITH {PREDICTIONS}, {_rank_sql("l_linestatus")},
c AS (SELECT l_linestatus, {_C}, avg(CASE WHEN label = 0 THEN pred_prob END) AS neg_mean_prob, avg(CASE WHEN label = 1 THEN pred_prob END) AS pos_mean_prob FROM predictions GROUP BY 1),
d AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
SELECT l_linestatus, n, (tp + fn)::BIGINT AS n_pos, (tn + fp)::BIGINT AS n_neg, tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, (tp + tn) / n AS accuracy, precision, recall, tn / nullif(tn + fp, 0) AS tnr,
CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1_score, auc_roc, auc_pr, fp / n AS fp_rate, fn / n AS fn_rate, (fp + fn) / n AS error_rate, neg_mean_prob, pos_mean_prob FROM d JOIN rk USING (l_linestatus)"""

SQL["best_threshold"] = f"""WITH {PREDICTIONS}, s AS (SELECT pred_prob, count_if(label = 1) AS p, count_if(label = 0) AS n FROM predictions GROUP BY 1),
r AS (SELECT pred_prob, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp FROM s WINDOW w AS (ORDER BY pred_prob DESC)),
f AS (SELECT pred_prob, 2 * (tp / (tp + fp)) * (tp / pp) / ((tp / (tp + fp)) + (tp / pp) + 1e-10) AS score FROM r)
SELECT pred_prob AS threshold, score FROM f ORDER BY round(score, 12) DESC, pred_prob LIMIT 1"""

_FOLD = "fold AS (SELECT l_linenumber % 4 AS fold, l_linestatus AS arm, count_if(label = 0 AND pred_label = 1) AS fp, count_if(label = 1 AND pred_label = 0) AS fn, avg((label = pred_label)::INT) AS accuracy FROM predictions GROUP BY 1, 2)"


def _folds(t):
    p = t.predictions().withColumns({"fold": F.col("l_linenumber") % 4, "arm": F.col("l_linestatus")})
    return p.groupBy("fold", "arm").agg(F.count_if((F.col("label") == 0) & (F.col("pred_label") == 1)).alias("fp"), F.count_if((F.col("label") == 1) & (F.col("pred_label") == 0)).alias("fn"), F.avg((F.col("label") == F.col("pred_label")).cast("double")).alias("accuracy"))


@query(f"WITH {PREDICTIONS}, {_FOLD} SELECT arm, count(*) AS n_folds, avg(accuracy) AS accuracy_mean, stddev_samp(accuracy) AS accuracy_std, sum(fp) / sum(fn) AS fp_fn_ratio FROM fold GROUP BY 1")
def cv_summary(t):
    return M.cv_summary(_folds(t), ["arm"], ["accuracy"])


@query(f"WITH {PREDICTIONS}, {_FOLD} SELECT arm, avg(accuracy) AS mean, stddev_samp(accuracy) AS std, min(accuracy) AS least, max(accuracy) AS most, count(accuracy) AS n FROM fold GROUP BY 1")
def fold_spread(t):
    return A.mean_std(_folds(t), ["arm"], "accuracy")


@query(f"WITH {PREDICTIONS}, {_FOLD} SELECT fold, sum(CASE WHEN arm = 'F' THEN accuracy * (fp + fn) END) / sum(CASE WHEN arm = 'F' THEN fp + fn END) AS F, sum(CASE WHEN arm = 'O' THEN accuracy * (fp + fn) END) / sum(CASE WHEN arm = 'O' THEN fp + fn END) AS O FROM fold GROUP BY 1")
def pooled_accuracy(t):
    f = _folds(t).withColumn("errors", F.col("fp") + F.col("fn"))
    return A.pooled_matrix(f, "fold", "arm", ["F", "O"], "accuracy", "errors")


@query(f"WITH {SCORED}, x AS (SELECT least(seg_a, seg_b) AS p, greatest(seg_a, seg_b) AS q, avg(pred_prob) AS v FROM scored WHERE seg_a IS NOT NULL AND seg_b IS NOT NULL GROUP BY 1, 2), b AS (SELECT p AS r, q AS c, v FROM x UNION ALL SELECT q, p, v FROM x WHERE p <> q) SELECT r, avg(CASE WHEN c = 'S4' THEN v END) AS S4, avg(CASE WHEN c = 'S6' THEN v END) AS S6 FROM b WHERE c IN ('S4', 'S6') GROUP BY 1")
def segment_matrix(t):
    s = scored(t).where("seg_a is not null and seg_b is not null")
    m = s.groupBy(F.least("seg_a", "seg_b").alias("p"), F.greatest("seg_a", "seg_b").alias("q")).agg(F.avg("pred_prob").alias("v"))
    return A.symmetric_matrix(m, "p", "q", "v", ["S4", "S6"])


@query(f"WITH {FLAGGED}, l AS (SELECT * FROM (VALUES ('Human'), ('Domestic Chicken')) v(h)) SELECT pair_row_id, coalesce((host_a = 'Human')::INT::DOUBLE, 0) AS human_a, coalesce((host_b = 'Human')::INT::DOUBLE, 0) AS human_b, coalesce((host_a = 'Domestic Chicken')::INT::DOUBLE, 0) AS chicken_a, coalesce((host_b = 'Domestic Chicken')::INT::DOUBLE, 0) AS chicken_b, coalesce(abs(year_a - year_b), -1)::DOUBLE AS gap, coalesce(same_host::INT, -1)::DOUBLE AS same_host, coalesce(same_hn_subtype::INT, -1)::DOUBLE AS same_hn_subtype, coalesce(same_year::INT, -1)::DOUBLE AS same_year FROM flagged")
def metadata_features(t):
    f = L.metadata_features(t.flagged(), {"host": ["Human", "Domestic Chicken"]})
    names = ["human_a", "chicken_a", "human_b", "chicken_b"]
    return f.select("pair_row_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)], *[F.col("features")[4 + i].alias(n) for i, n in enumerate(["gap", "same_host", "same_hn_subtype", "same_year"])])


@query()
def fold_scores(t):
    """AUC of out-of-fold scores of each model on metadata features."""
    f = L.metadata_features(t.flagged(), {"host": ["Human"], "hn_subtype": ["H1N1", "H3N2"]}).withColumn("fold", (F.col("pair_row_id") % 3).cast("int")).select("label", "features", "fold")
    out = None
    for m, o in (("logistic", {}), ("gbt", {"maxIter": 5}), ("mlp", {"maxIter": 20})):
        part = M.ranking_metrics(L.out_of_fold(f, "features", 3, model=m, **o)).select(F.lit(m).alias("model"), "auc_roc")
        out = part if out is None else out.unionByName(part)
    return out
