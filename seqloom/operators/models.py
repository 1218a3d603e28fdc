"""Classifiers behind one interface: features and labels in, probabilities out (trained here, none is stored)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(df: DataFrame, features: str, label: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))


def fit_predict(train: DataFrame, test: DataFrame, features: str, label: str = "label", *, model: str = "logistic", seed: int = 0, **options) -> DataFrame:
    """``test`` with ``pred_prob``. ``model`` is logistic, gbt or mlp; rows without features or label aren't trained on."""
    make = {
        "logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="_y", **options),
        "gbt": lambda: GBTClassifier(featuresCol="_x", labelCol="_y", seed=seed, **({"maxIter": 20} | options)),
        "mlp": lambda: MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", seed=seed, **({"layers": [train.select(F.size(features)).first()[0], 16, 2]} | options)),
    }[model]
    fitted = make().fit(_vectors(train.where(F.col(features).isNotNull() & F.col(label).isNotNull()), features, label))
    if getattr(fitted, "hasSummary", False):
        # a logistic model's summary holds the session, which can't be sent with tasks once an Observation was used in it (``scratch.materialize``)
        fitted._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    out = fitted.transform(_vectors(test.where(F.col(features).isNotNull()), features, label))
    return out.withColumn("pred_prob", F.get(vector_to_array("probability"), F.lit(1))).select(*test.columns, "pred_prob")


def metadata_features(pairs: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Adds ``features``: one-hot host and subtype of both sides over the training levels, the year difference and three match flags; unknown is -1."""
    hot = [F.coalesce((F.col(f"{a}_{s}") == v).cast("double"), F.lit(0.0)) for a in sorted(levels) for s in "ab" for v in levels[a]]
    gap = F.coalesce(F.abs(F.col("year_a") - F.col("year_b")).cast("double"), F.lit(-1.0))
    same = [F.coalesce((F.col(f"{a}_a") == F.col(f"{a}_b")).cast("double"), F.lit(-1.0)) for a in ("host", "hn_subtype", "year")]
    return pairs.withColumn("features", F.array(*hot, gap, *same))


def out_of_fold(pairs: DataFrame, features: str, n_folds: int, *, model: str = "logistic", seed: int = 0, **options) -> DataFrame:
    """Every pair with the score of a model trained on the other folds; ``pairs`` has ``fold``, rows without one are left out."""
    out = None
    for f in range(n_folds):
        part = fit_predict(pairs.where(F.col("fold") != f), pairs.where(F.col("fold") == f), features, model=model, seed=seed, **options)
        out = part if out is None else out.unionByName(part)
    return out
