"""Exact classification metrics with ties, per group, without sorting rows: everything runs over distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import REGIMES


def predict(df: DataFrame, threshold: float, *, prob: str = "pred_prob", inclusive: bool = False) -> DataFrame:
    """Adds ``pred_label``; a score equal to the threshold is 0 unless ``inclusive``."""
    return df.withColumn("pred_label", (F.col(prob) >= threshold if inclusive else F.col(prob) > threshold).cast("int"))


def _scores(df: DataFrame, by: list[str], prob: str, label: str) -> DataFrame:
    """Per group and distinct score: positives, negatives."""
    y = F.col(label) == 1
    return df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(prob).alias("_s")).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n"))


def ranking_metrics(df: DataFrame, by: list[str] | None = None, *, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """``auc_roc`` (ties count half) and ``auc_pr`` (average precision over distinct scores); null with one class."""
    by = by or []
    s = _scores(df, by, prob, label)
    w = W.partitionBy(*by).orderBy(F.desc("_s"))
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    r = s.select(*by, "_p", "_n", F.sum("_p").over(upto).alias("tp"), F.sum("_n").over(upto).alias("fp"), F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("above"))
    P, N = F.sum("_p"), F.sum("_n")
    wins = F.sum(F.col("_n") * F.col("above") + F.col("_n") * F.col("_p") / 2)
    ap = F.sum(F.col("_p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (P > 0) & (N > 0)
    return r.groupBy(*by).agg(F.when(both, wins / (P.cast("double") * N)).alias("auc_roc"), F.when(both, ap / P).alias("auc_pr"))


def confusion(df: DataFrame, by: list[str] | None = None, *, label: str = "label", pred: str = "pred_label") -> DataFrame:
    """Tn, fp, fn, tp per group."""
    c = lambda y, p: F.count_if((F.col(label) == y) & (F.col(pred) == p))
    return df.groupBy(*(by or [])).agg(c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(1, 1).alias("tp"))


def _f(b: float, p: Column, r: Column) -> Column:
    return F.try_divide((1 + b * b) * p * r, b * b * p + r)


def classification_metrics(df: DataFrame, by: list[str] | None = None, *, label: str = "label", pred: str = "pred_label", prob: str = "pred_prob") -> DataFrame:
    """Counts, accuracy, precision, recall, f1, f1_macro, mcc, brier, bce (eps 1e-7), auc_roc (0.5 with one class), auc_pr.

    A ratio without a denominator is 0.
    """
    by = by or []
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col(prob)))
    y = F.col(label).cast("double")
    c = confusion(df, by, label=label, pred=pred)
    loss = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("bce"))
    rank = ranking_metrics(df, by, prob=prob, label=label)
    join = (lambda a, b: a.join(b, by, "left")) if by else (lambda a, b: a.join(F.broadcast(b)))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec, rec = z(F.try_divide(tp, tp + fp)), z(F.try_divide(tp, tp + fn))
    prec0, rec0 = z(F.try_divide(tn, tn + fn)), z(F.try_divide(tn, tn + fp))
    f1, f0 = z(_f(1, prec, rec)), z(_f(1, prec0, rec0))
    mcc = z(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))))
    return join(join(loss, c), rank).select(
        *by, "n", "tn", "fp", "fn", "tp", ((tp + tn) / F.col("n")).alias("accuracy"), prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("f1_macro"), mcc.alias("mcc"), "brier", "bce", F.coalesce("auc_roc", F.lit(0.5)).alias("auc_roc"), "auc_pr"
    )


def stratum_metrics(df: DataFrame, by: list[str], *, fp_rate_of: str = "n", label: str = "label", pred: str = "pred_label", prob: str = "pred_prob") -> DataFrame:
    """Per stratum, null where a figure isn't defined. ``fp_rate`` is of all rows ('n') or of the negatives ('negatives')."""
    c = confusion(df, by, label=label, pred=pred)
    m = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(F.col(label) == 0, F.col(prob))).alias("neg_mean_prob"), F.avg(F.when(F.col(label) == 1, F.col(prob))).alias("pos_mean_prob"))
    d = F.try_divide
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    prec, rec = d(tp, tp + fp), d(tp, tp + fn)
    return m.join(c, by).join(ranking_metrics(df, by, prob=prob, label=label), by, "left").select(
        *by, "n", (tp + fn).alias("n_pos"), (tn + fp).alias("n_neg"), "tp", "tn", "fp", "fn", d(tp + tn, n).alias("accuracy"), prec.alias("precision"), rec.alias("recall"), d(tn, tn + fp).alias("tnr"),
        F.when((prec > 0) & (rec > 0), _f(1, prec, rec)).alias("f1_score"), "auc_roc", "auc_pr", d(fp, n if fp_rate_of == "n" else tn + fp).alias("fp_rate"), d(fn, n).alias("fn_rate"), d(fp + fn, n).alias("error_rate"), "neg_mean_prob", "pos_mean_prob",
    )


def best_threshold(df: DataFrame, *, beta: float = 1.0, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """M3: one row (threshold, score): the distinct score that, used inclusively, gives the best F-beta; ties to the lowest score. No scores: (0.5, 0)."""
    s = _scores(df, [], prob, label)
    w = W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, 0)  # one row per distinct score
    P = F.sum("_p").over(W.partitionBy())
    r = s.select("_s", F.sum("_p").over(w).alias("tp"), F.sum("_n").over(w).alias("fp"), P.alias("P"))
    p, rec = F.col("tp") / (F.col("tp") + F.col("fp")), F.coalesce(F.try_divide("tp", "P"), F.lit(1.0))
    score = (1 + beta * beta) * p * rec / (beta * beta * p + rec + 1e-10)
    best = r.select("_s", score.alias("score")).agg(F.min(F.struct((-F.round("score", 12)).alias("neg"), F.col("_s"), F.col("score"))).alias("m"))
    return best.select(F.coalesce("m._s", F.lit(0.5)).alias("threshold"), F.coalesce("m.score", F.lit(0.0)).alias("score"))


def threshold_grid(df: DataFrame, *, grid: list[float] | None = None, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """(threshold, f1_macro) for 0.05 to 0.95."""
    grid = grid or [round(0.05 * i, 2) for i in range(1, 20)]
    s = _scores(df, [], prob, label).crossJoin(F.broadcast(df.sparkSession.createDataFrame([(t,) for t in grid], "threshold double")))  # distinct scores times the grid
    hit = F.col("_s") > F.col("threshold")
    n = lambda c, h: F.coalesce(F.sum(F.when(h, F.col(c))), F.lit(0)).cast("double")
    g = s.groupBy("threshold").agg(n("_p", hit).alias("tp"), n("_n", hit).alias("fp"), n("_p", ~hit).alias("fn"), n("_n", ~hit).alias("tn"))
    f = lambda a, b, c: F.coalesce(F.try_divide(2 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c)), F.lit(0.0))
    return g.select("threshold", ((f("tp", "fp", "fn") + f("tn", "fn", "fp")) / 2).alias("f1_macro"))


def level1(df: DataFrame) -> DataFrame:
    """M5: nine rows in fixed order: positives with their TPR, then each negative regime with its TNR; empty ones stay."""
    names = ["positive", *REGIMES]
    order = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, neg_regime string")
    m = df.groupBy(F.when(F.col("label") == 1, "positive").otherwise(F.col("neg_regime")).alias("neg_regime")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred_label")).alias("n_right"))
    return F.broadcast(order).join(m, "neg_regime", "left").select("position", "neg_regime", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("n_right", "n").alias("rate"))


def level1_by_count(df: DataFrame) -> DataFrame:
    """M6: TNR of negatives by the number of matching axes, 0 to 3."""
    order = df.sparkSession.createDataFrame([(i,) for i in range(4)], "metadata_match_count int")
    m = df.where("label = 0").groupBy("metadata_match_count").agg(F.count("*").alias("n"), F.count_if(F.col("pred_label") == 0).alias("n_right"))
    return F.broadcast(order).join(m, "metadata_match_count", "left").select("metadata_match_count", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide("n_right", "n").alias("tnr"))


def level2_strata(df: DataFrame, axis: str, *, least: int = 10) -> DataFrame:
    """M7: adds ``stratum``: the common value of both sides, 'mixed', 'unknown', rare common values 'other'."""
    a, b = F.col(f"{axis}_a").cast("string"), F.col(f"{axis}_b").cast("string")
    s = F.when(a.isNull() | b.isNull() | (a == "unknown") | (b == "unknown"), "unknown").when(a == b, a).otherwise("mixed")
    x = df.withColumn("stratum", s)
    few = x.groupBy("stratum").agg(F.count("*").alias("_n")).where((F.col("_n") < least) & ~F.col("stratum").isin("unknown", "mixed")).select("stratum", F.lit(True).alias("_few"))
    return x.join(F.broadcast(few), "stratum", "left").withColumn("stratum", F.when(F.col("_few"), "other").otherwise(F.col("stratum"))).drop("_few")


def hash_overlap(df: DataFrame, train: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """M8: adds ``n_seen``: how many of a pair's two sequences also are in a training pair (on either side)."""
    seen = train.select(F.explode(F.array(f"{hash_col}_a", f"{hash_col}_b")).alias("h")).where("h is not null").distinct()
    for s in "ab":
        df = df.join(seen.select(F.col("h").alias(f"{hash_col}_{s}"), F.lit(1).alias(f"_s{s}")), f"{hash_col}_{s}", "left")
    return df.withColumn("n_seen", F.coalesce("_sa", F.lit(0)) + F.coalesce("_sb", F.lit(0))).drop("_sa", "_sb")


def split_leakage(a: DataFrame, b: DataFrame, key: str = "pair_key") -> DataFrame:
    """M9: one row: keys that both have, rows of ``b`` with a key of ``a``, and those of them whose label ``a`` contradicts."""
    labels = a.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    j = b.join(labels, key)
    return j.agg(F.count_distinct(key).alias("n_keys"), F.count("*").alias("n_rows"), F.count_if((F.col("label") != F.col("lo")) | (F.col("label") != F.col("hi"))).alias("n_conflicts"))


def calibration(df: DataFrame, bins: int = 10, *, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """Per uniform bin (the last includes 1) rows, mean score and positive rate; empty bins are left out."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(prob).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def score_distribution(df: DataFrame, *, prob: str = "pred_prob", label: str = "label") -> DataFrame:
    """Per label mean, median, sample deviation, extremes and outer deciles."""
    p = lambda q: F.percentile(prob, q)
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(prob).alias("mean"), p(0.5).alias("median"), F.stddev_samp(prob).alias("std"), F.min(prob).alias("least"), F.max(prob).alias("most"), p(0.1).alias("q10"), p(0.9).alias("q90"))


def match_count_strata(df: DataFrame) -> DataFrame:
    """Negatives by matching axes (flags summed, unknown ones not): rows, false positive rate, mean and median score."""
    n = sum((F.coalesce(F.col(f"same_{a}").cast("int"), F.lit(0)) for a in ("host", "hn_subtype", "year")), F.lit(0))
    return df.where("label = 0").groupBy(n.alias("match_count")).agg(F.count("*").alias("n"), F.avg(F.col("pred_label").cast("double")).alias("fp_rate"), F.avg("pred_prob").alias("mean_prob"), F.percentile("pred_prob", 0.5).alias("median_prob"))


def hardness_patterns(df: DataFrame) -> DataFrame:
    """Negatives by the comma list of their matching axes ('none' for no axis)."""
    names = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.col(f"same_{a}"), F.lit(False)), F.lit(a)) for a in ("host", "hn_subtype", "year")]), lambda x: x.isNotNull()), ",")
    return df.where("label = 0").groupBy(F.when(names == "", "none").otherwise(names).alias("pattern")).agg(F.count("*").alias("n"), F.count_if(F.col("pred_label") == 1).alias("n_fp"), F.avg(F.col("pred_label").cast("double")).alias("fp_rate"))


def segment_performance(df: DataFrame, least: int = 10) -> DataFrame:
    """Per unordered segment pair with more than ``least`` rows: rows and accuracy."""
    k = F.concat_ws("-", F.least("seg_a", "seg_b"), F.greatest("seg_a", "seg_b"))
    return df.where("seg_a is not null and seg_b is not null").groupBy(k.alias("segments")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred_label")).cast("double")).alias("accuracy")).where(F.col("n") > least)


def confidence_bins(df: DataFrame, edges: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) -> DataFrame:
    """Accuracy by confidence |p - 0.5| * 2 in bins open below and closed above; exactly the lowest edge has no bin."""
    c = F.abs(F.col("pred_prob") - 0.5) * 2
    b = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        cond = (c > lo) & (c <= hi)
        b = F.when(cond, i) if b is None else b.when(cond, i)
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred_label")).cast("double")).alias("accuracy"))


def majority_baseline(df: DataFrame) -> DataFrame:
    """F1 of predicting the more frequent label always (ties predict 1)."""
    p, n = F.count_if(F.col("label") == 1), F.count("*")
    return df.agg(n.alias("n"), p.alias("n_pos"), F.when(2 * p >= n, F.try_divide(2 * p, n + p)).otherwise(F.lit(0.0)).alias("f1"))


def cv_summary(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation over folds, and false positives to false negatives as a ratio of totals."""
    agg = [f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(*by).agg(F.count("*").alias("n_folds"), *agg, F.try_divide(F.sum("fp"), F.sum("fn")).alias("fp_fn_ratio"))
