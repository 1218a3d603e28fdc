"""Vector features, similarity and two-sample distance on array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Name, _c

FLOOR = 1e-8
INTERACTIONS = ("concat", "diff", "unit_diff", "prod", "unit_prod")


def total(x: Name) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def norm(x: Name) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v.cast("double") * v))


def unit_norm(x: Name) -> Column:
    """V-5: divided by its length, which counts as 1e-8 at least."""
    n = F.greatest(norm(x), F.lit(FLOOR))
    return F.zip_with(_c(x), F.array_repeat(n, F.size(_c(x))), lambda v, m: v / m)  # repeated, as a lambda would work it out for every component


def slot_norm(x: Name) -> Column:
    """V-5: (v - mean) / (population deviation + 1e-5)."""
    k = F.size(_c(x))
    around = F.zip_with(_c(x), F.array_repeat(total(x) / k, k), lambda v, m: v - m)
    sd = norm(around) / F.sqrt(k)
    return F.zip_with(around, F.array_repeat(sd + 1e-5, k), lambda v, s: v / s)


def dot(a: Name, b: Name) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Name, b: Name) -> Column:
    """V-11: null where either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def interaction(a: Name, b: Name, kinds: str) -> Column:
    """V-6/V-8/V-17: '+'-joined kinds in fixed order: concat, |a-b|, that at unit length, a*b, that at unit length."""
    want = kinds.split("+")
    if not want or any(k not in INTERACTIONS for k in want):
        raise ValueError(f"unknown interaction {kinds!r}")
    diff = F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    made = {"concat": F.concat(_c(a), _c(b)), "diff": diff, "unit_diff": unit_norm(diff), "prod": prod, "unit_prod": unit_norm(prod)}
    return F.concat(*[made[k] for k in INTERACTIONS if k in want])


def signed_unit_diff(a: Name, b: Name) -> Column:
    """V-7: the older kind, a - b at unit length with its signs."""
    return unit_norm(F.zip_with(_c(a), _c(b), lambda x, y: x - y))


def standardize(df: DataFrame, col: str, fit: DataFrame) -> DataFrame:
    """V-9: every component minus its mean over ``fit``, by its population deviation there (1 where that is 0)."""
    m = fit.select(F.posexplode(col).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_f"))
    return df.join(F.broadcast(m)).withColumn(col, F.zip_with(F.col(col), F.col("_f"), lambda v, f: (v - f["m"]) / F.when(f["s"] > 0, f["s"]).otherwise(F.lit(1.0)))).drop("_f")


def masked_mean(vectors: Name, mask: Name) -> Column:
    """V-16 pooling: mean of the vectors whose mask is true; null if none is."""
    kept = F.filter(F.arrays_zip(_c(vectors).alias("v"), _c(mask).alias("m")), lambda z: z["m"])
    rows = F.transform(kept, lambda z: z["v"])
    summed = F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), F.get(rows, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(summed, lambda v: v / F.size(kept)))


def _unit(col: pd.Series) -> np.ndarray:
    x = np.array(col.tolist(), dtype=np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)


def top_matches(queries: DataFrame, base: DataFrame, k: int = 1, *, block: int = 4096) -> DataFrame:
    """J26/V-10/M12/M13: (qid, id, similarity, rank): the ``k`` most similar base vectors of each query, exactly.

    Both have ``id, vec``; base may have ``label``. The base is cut into blocks of about ``block`` rows, every query meets
    every block as a matrix product, and blocks' best are merged by a pre-aggregated top-k: no row pair is ever
    shuffled. A query's own id isn't its match. Zero vectors have similarity 0 with everything.
    """
    label = "label" in base.columns
    n = max(1, -(-base.count() // block))
    rows = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n)))
    kind, qk = base.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    tiles = rows.groupBy("part").agg(F.collect_list(F.struct("id", "vec", *(["label"] if label else []))).alias("tile"))  # one bounded block each
    blocks = queries.select(F.col("id").alias("qid"), "vec").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // block))))).groupBy("chunk").agg(F.collect_list(F.struct("qid", "vec")).alias("asks"))
    jobs = blocks.crossJoin(tiles)  # block pairs, not row pairs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asks, tile in zip(pdf["asks"], pdf["tile"]):
                q, b = pd.DataFrame(list(asks)), pd.DataFrame(list(tile))
                s = _unit(q["vec"]) @ _unit(b["vec"]).T
                groups = [(None, np.arange(len(b)))] if not label else [(g, np.flatnonzero(b["label"].to_numpy() == g)) for g in sorted(b["label"].unique())]
                for g, cols in groups:
                    t = s[:, cols].copy()
                    t[q["qid"].to_numpy()[:, None] == b["id"].to_numpy()[cols][None]] = -np.inf
                    order = np.argsort(-t, axis=1, kind="stable")[:, : k + 1]
                    r = np.repeat(np.arange(len(q)), order.shape[1])
                    v = t[r, order.ravel()]
                    out = pd.DataFrame({"qid": q["qid"].to_numpy()[r], "id": b["id"].to_numpy()[cols][order.ravel()], "similarity": v})
                    if label:
                        out["label"] = int(g)
                    yield out[np.isfinite(v)]

    got = jobs.mapInPandas(run, f"qid {qk}, id {kind}, similarity double" + (", label int" if label else ""))
    by = ["qid", *(["label"] if label else [])]
    best = got.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("neg"), F.col("id").alias("id")))), 1, k).alias("l"))
    return best.select(*by, F.posexplode("l").alias("pos", "h")).select(*by, F.col("h.id").alias("id"), (-F.col("h.neg")).alias("similarity"), (F.col("pos") + 1).alias("rank"))


def identity(a: Name, b: Name) -> Column:
    """V-12: share (%) of equal letters at equal positions, of the longer sequence."""
    same = F.size(F.filter(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda v: v))
    return F.when(F.greatest(F.length(_c(a)), F.length(_c(b))) > 0, same * 100 / F.greatest(F.length(_c(a)), F.length(_c(b))))


def nearest_identity(queries: DataFrame, base: DataFrame) -> DataFrame:
    """V-12/J26: (qid, best_identity) of distinct sequences against distinct sequences, in blocks as ``top_matches``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for asks, tile in zip(pdf["asks"], pdf["tile"]):
                q, b = pd.DataFrame(list(asks)), [r["seq"] for r in tile]
                w = max([1, *map(len, b), *map(len, q["seq"])])
                # two different fillers, so that padding never matches
                code = lambda x, f: np.pad(np.frombuffer(x.encode("utf-32-le"), np.uint32), (0, w - len(x)), constant_values=f)  # noqa: B023, E731
                m = np.stack([code(x, 1) for x in b])
                n = np.array([len(x) for x in b])
                out = [float((100.0 * (m == code(x, 2)[None]).sum(1) / np.maximum(n, max(1, len(x)))).max()) for x in q["seq"]]
                yield pd.DataFrame({"qid": q["qid"], "s": out})

    qk = queries.schema["id"].dataType.simpleString()
    cut = lambda df, k, block: df.withColumn("p", F.pmod(F.xxhash64(k), F.lit(max(1, -(-df.count() // block)))))
    a = cut(queries.select(F.col("id").alias("qid"), "seq"), "qid", 512).groupBy("p").agg(F.collect_list(F.struct("qid", "seq")).alias("asks")).drop("p")
    b = cut(base.select("seq").distinct(), "seq", 2048).groupBy("p").agg(F.collect_list(F.struct("seq")).alias("tile")).drop("p")
    return a.crossJoin(b).mapInPandas(run, f"qid {qk}, s double").groupBy("qid").agg(F.max("s").alias("best_identity"))


def knn1_margin(queries: DataFrame, train: DataFrame, *, self_distance: float = 1e-6) -> DataFrame:
    """(qid, prob, pred): cosine margin between the nearest positive and the nearest negative, as (margin + 2) / 4 in 0..1.

    A nearest one closer than ``self_distance`` is the query itself and the second counts.
    """
    near = top_matches(queries, train, 2)
    first, second = F.max(F.when(F.col("rank") == 1, F.col("similarity"))), F.max(F.when(F.col("rank") == 2, F.col("similarity")))
    sim = near.groupBy("qid", "label").agg(F.when(1 - first < self_distance, second).otherwise(first).alias("s"))
    both = sim.groupBy("qid").agg(F.max(F.when(F.col("label") == 1, F.col("s"))).alias("p"), F.max(F.when(F.col("label") == 0, F.col("s"))).alias("n"))
    return both.select("qid", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p") - F.col("n") + 2) / 4)).alias("prob"), (F.col("p") > F.col("n")).cast("int").alias("pred"))


def knn_vote(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(qid, prob): share of the positive ones among the ``k`` nearest, weighted by 1 / distance."""
    near = top_matches(queries, train.drop("label"), k).join(train.select("id", "label"), "id")
    w = 1 / F.greatest(1 - F.col("similarity"), F.lit(1e-12))
    return near.groupBy("qid").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("prob"))


def group_distances(df: DataFrame, vec: str, group: str) -> DataFrame:
    """Mean cosine within and between groups over all pairs, without making pairs.

    The sum of dot products over all pairs is the squared length of the summed unit vectors less the vectors' own.
    """
    rows = df.where(F.col(group).isNotNull() & (norm(vec) > 0)).select(F.col(group).alias("g"), F.posexplode(unit_norm(vec)).alias("i", "v"))
    per = rows.groupBy("g", "i").agg(F.sum("v").alias("s"))
    n = df.where(F.col(group).isNotNull() & (norm(vec) > 0)).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))
    within = per.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(n, "g").agg(F.sum((F.col("q") - F.col("n")) / 2).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("nw"), F.sum("n").alias("n"))
    all_ = per.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("q"))
    x = within.join(all_)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return x.select(F.try_divide("w", "nw").alias("within"), F.try_divide((F.col("q") - F.col("n")) / 2 - F.col("w"), pairs - F.col("nw")).alias("between"), F.col("nw").cast("bigint").alias("n_within"), (pairs - F.col("nw")).cast("bigint").alias("n_between"))


def mmd(df: DataFrame, vec: str, label: str, *, most: int = 2000, shuffles: int = 200, seed: int = 0) -> DataFrame:
    """V-13/V-18/V-15: one row: biased squared MMD between labels 1 and 0 with an RBF kernel of median bandwidth, and a permutation p-value.

    Two-sample tests work on at most ``most`` rows of either label, taken in seeded hash order (a documented sample bound).
    """
    from ..functions.keys import order_key

    take = lambda y: df.where((F.col(label) == y) & F.col(vec).isNotNull()).orderBy(order_key(seed, F.to_json(F.struct(vec))), F.to_json(F.struct(vec))).limit(most).select(F.col(label).alias("y"), F.col(vec).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["x"].tolist(), dtype=float), pdf["y"].to_numpy() == 1
        if y.all() or not y.any():
            return pd.DataFrame({"mmd2": [None], "p_value": [None], "n_1": [int(y.sum())], "n_0": [int((~y).sum())]})
        order = np.lexsort((*x.T[::-1], ~y))
        x, y = x[order], y[order]
        sq = (x * x).sum(1)
        d = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
        med = np.median(d[np.triu_indices(len(x), 1)])
        k = np.exp(-d / (med if med > 0 else 1.0))

        def stat(m):
            a, b = m / m.sum(), ~m / (~m).sum()
            return float(a @ k @ a + b @ k @ b - 2 * a @ k @ b)

        own, rng = stat(y), np.random.default_rng(seed)
        above = sum(stat(rng.permutation(y)) >= own for _ in range(shuffles))
        return pd.DataFrame({"mmd2": [own], "p_value": [(above + 1) / (shuffles + 1)], "n_1": [int(y.sum())], "n_0": [int((~y).sum())]})

    return take(1).unionByName(take(0)).withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "mmd2 double, p_value double, n_1 bigint, n_0 bigint")


def principal_components(df: DataFrame, vec: str, k: int) -> DataFrame:
    """V-14: adds ``pca``, the first ``k`` principal components (signs as the solver gives them)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.where(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(x).transform(x).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
