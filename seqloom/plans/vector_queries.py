"""Queries on vectors, similarity and two-sample distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from .registry import query

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_NORM = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"


def _base(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query(f"WITH {_E}, s AS (SELECT id, v, {_NORM} AS n, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM e) SELECT id, v[1] / greatest(n, 1e-8) AS unit_1, v[2] / greatest(n, 1e-8) AS unit_2, (v[1] - m) / (sd + 1e-5) AS slot_1, (v[2] - m) / (sd + 1e-5) AS slot_2 FROM s")
def slot_transforms(t):
    """V-5."""
    u, s = V.unit_norm("v"), V.slot_norm("v")
    return _base(t).select("id", u[0].alias("unit_1"), u[1].alias("unit_2"), s[0].alias("slot_1"), s[1].alias("slot_2"))


_PAIRED = f"{_E}, p AS (SELECT a.id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.id = a.id + 1), d AS (SELECT id, x, y, list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])) AS df, list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i]) AS pr FROM p)"


def _paired(t):
    e = _base(t)
    return e.select("id", F.col("v").alias("x")).join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("y")), "id")


@query(f"WITH {_PAIRED} SELECT id, 5 * len(x) + len(x) AS n, df[3] AS diff_3, df[3] / greatest(sqrt(list_sum(list_transform(df, lambda v: v * v))), 1e-8) AS unit_diff_3, pr[3] AS prod_3, pr[3] / greatest(sqrt(list_sum(list_transform(pr, lambda v: v * v))), 1e-8) AS unit_prod_3, (x[3] - y[3]) / greatest(sqrt(list_sum(list_transform(df, lambda v: v * v))), 1e-8) AS signed_3 FROM d")
def interactions(t):
    """V-6 to V-8, V-17."""
    f = V.interaction("x", "y", "concat+diff+unit_diff+prod+unit_prod")
    p = _paired(t).withColumn("f", f).withColumn("k", F.size("x"))
    at = lambda block: F.element_at("f", F.lit(3) + F.col("k") * block)
    return p.select("id", F.size("f").alias("n"), at(2).alias("diff_3"), at(3).alias("unit_diff_3"), at(4).alias("prod_3"), at(5).alias("unit_prod_3"), V.signed_unit_diff("x", "y")[2].alias("signed_3"))


@query(f"WITH {_PAIRED} SELECT id, list_cosine_similarity(x, y) AS cosine FROM d")
def pair_cosines(t):
    """V-11."""
    return _paired(t).select("id", V.cosine("x", "y").alias("cosine"))


@query(f"WITH {_E}, l AS (SELECT id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e), f AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE id % 2 = 0 GROUP BY 1) SELECT id, sum((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END) AS total FROM l JOIN f USING (i) GROUP BY 1")
def standardized(t):
    """V-9: fitted on the even ids."""
    e = _base(t)
    return V.standardize(e, "v", e.where("id % 2 = 0")).select("id", V.total("v").alias("total"))


_NEAR = f"{_E}, q AS (SELECT id, v FROM e WHERE id % 50 = 0), s AS (SELECT q.id AS qid, e.id, (e.label % 2)::INT AS label, list_cosine_similarity(q.v, e.v) AS c FROM q JOIN e ON q.id <> e.id)"


@query(f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS k FROM s) SELECT qid, sum(label / greatest(1 - c, 1e-12)) / sum(1 / greatest(1 - c, 1e-12)) AS prob FROM r WHERE k <= 5 GROUP BY 1")
def neighbour_votes(t):
    """M13."""
    e = _base(t).select("id", F.col("v").alias("vec"), (F.col("label") % 2).cast("int").alias("label"))
    return V.knn_vote(e.where("id % 50 = 0").select("id", "vec"), e)


@query(f"WITH {_NEAR}, r AS (SELECT qid, label, c, row_number() OVER (PARTITION BY qid, label ORDER BY c DESC, id) AS k FROM s), b AS (SELECT qid, label, CASE WHEN 1 - max(CASE WHEN k = 1 THEN c END) < 1e-6 THEN max(CASE WHEN k = 2 THEN c END) ELSE max(CASE WHEN k = 1 THEN c END) END AS c FROM r GROUP BY 1, 2), m AS (SELECT qid, max(CASE WHEN label = 1 THEN c END) AS p, max(CASE WHEN label = 0 THEN c END) AS n FROM b GROUP BY 1) SELECT qid, greatest(0.0, least(1.0, (p - n + 2) / 4)) AS prob, (p > n)::INT AS pred FROM m")
def nearest_margins(t):
    """M12."""
    e = _base(t).select("id", F.col("v").alias("vec"), (F.col("label") % 2).cast("int").alias("label"))
    return V.knn1_margin(e.where("id % 50 = 0").select("id", "vec"), e)


@query("WITH q AS (SELECT DISTINCT prot_hash_a AS id, prot_seq_a AS s FROM segment_pairs WHERE split_name = 'test' AND pair_row_id % 50 = 0 AND prot_hash_a IS NOT NULL AND prot_seq_a IS NOT NULL), b AS (SELECT DISTINCT prot_seq_b AS s FROM segment_pairs WHERE prot_seq_b IS NOT NULL) SELECT q.id AS qid, max(100 * list_sum(list_transform(range(1, least(length(q.s), length(b.s)) + 1), lambda i: (substr(q.s, i::BIGINT, 1) = substr(b.s, i::BIGINT, 1))::INT)) / greatest(length(q.s), length(b.s))) AS best_identity FROM q, b GROUP BY 1")
def nearest_identities(t):
    """V-12, J26: every pair row divisible by 50 against all rows."""
    s = t("segment_pairs")
    q = s.where("split_name = 'test' and pair_row_id % 50 = 0 and prot_hash_a is not null and prot_seq_a is not null").select(F.col("prot_hash_a").alias("id"), F.col("prot_seq_a").alias("seq")).distinct()
    return V.nearest_identity(q, s.where("prot_seq_b is not null").select(F.col("prot_seq_b").alias("seq")))


@query("SELECT pair_row_id, 100 * list_sum(list_transform(range(1, least(length(prot_seq_a), length(prot_seq_b)) + 1), lambda i: (substr(prot_seq_a, i::BIGINT, 1) = substr(prot_seq_b, i::BIGINT, 1))::INT)) / greatest(length(prot_seq_a), length(prot_seq_b)) AS identity FROM segment_pairs WHERE prot_seq_a IS NOT NULL AND prot_seq_b IS NOT NULL")
def pair_identities(t):
    """V-12."""
    return t("segment_pairs").where("prot_seq_a is not null and prot_seq_b is not null").select("pair_row_id", V.identity("prot_seq_a", "prot_seq_b").alias("identity"))


@query(f"WITH {_E}, p AS (SELECT a.label = b.label AS w, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.id < b.id WHERE a.label IS NOT NULL AND b.label IS NOT NULL) SELECT avg(CASE WHEN w THEN c END) AS within, avg(CASE WHEN NOT w THEN c END) AS between, count_if(w) AS n_within, count_if(NOT w) AS n_between FROM p")
def group_distances(t):
    """A45, A49."""
    return V.group_distances(_base(t), "v", "label")


@query(f"WITH {_E}, p AS (SELECT id, label, v FROM e), m AS (SELECT label, list_avg(v) AS a FROM p GROUP BY ALL) SELECT id, list_avg(v) AS pooled FROM p")
def pooled_vectors(t):
    """V-16: masked mean over a vector's components taken as one-dimensional vectors, all of them unmasked."""
    one = F.transform("v", lambda x: F.array(x))
    return _base(t).select("id", V.masked_mean(one, F.transform("v", lambda x: F.lit(True)))[0].alias("pooled"))


@query()
def two_sample_distance(t):
    """V-13, V-15, V-18: MMD between the vectors of label 0 and 1."""
    return V.mmd(_base(t).where("label in (0, 1)"), "v", "label")


@query()
def leading_components(t):
    """V-14: variance along the first two principal components."""
    p = V.principal_components(_base(t), "v", 2)
    return p.agg(F.var_pop(F.col("pca")[0]).alias("var_1"), F.var_pop(F.col("pca")[1]).alias("var_2"))
