"""Most similar vectors for every vector: vantage-point trees per shard with relaxed triangle-inequality pruning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, skew_join


class VPTree:
    """Vantage-point tree over unit vectors, searched by blocks of queries.

    Inner nodes keep a vantage point and the median distance to it; leaves keep up to ``leaf`` points. A block of queries
    visits a child only with those queries whose ball can reach it. ``factor`` scales the ball: 1 is exact, smaller
    values prune more and may miss neighbours.
    """

    def __init__(self, x: np.ndarray, leaf: int = 96, seed: int = 7) -> None:
        self.exact, self.x, self.nodes, rng = x, x.astype(np.float32), [], np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)), leaf, rng)

    def _build(self, ids: np.ndarray, leaf: int, rng) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if len(ids) <= leaf:
            self.nodes[me] = (None, ids)
            return me
        vantage = self.x[ids[rng.integers(len(ids))]]
        d = _dist(self.x[ids], vantage[None])[:, 0]
        order = np.argsort(d, kind="stable")
        half = len(ids) // 2
        if d[order[0]] == d[order[-1]]:  # all at one distance, copies for instance: nothing can separate them
            self.nodes[me] = (None, ids)
            return me
        inner, outer = order[:half], order[half:]
        bounds = (d[inner].min(), d[inner].max(), d[outer].min(), d[outer].max())
        a, b = self._build(ids[inner], leaf, rng), self._build(ids[outer], leaf, rng)
        self.nodes[me] = (vantage, bounds, a, b)
        return me

    def search(self, q: np.ndarray, tau: np.ndarray, k: int, names: np.ndarray, own: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest points within ``tau`` of every query: distances and indices (inf and -1 where there are fewer).

        Points whose name is the query's own are passed over. Ties go to the smaller name.
        """
        m, exact = len(q), q
        q = q.astype(np.float32)  # distances are first taken in single precision with slack; those of finds are recomputed
        dist, idx, tau = np.full((m, k), np.inf), np.full((m, k), -1), tau.astype(float).copy()

        def visit(node: int, act: np.ndarray) -> None:
            if not len(act):
                return
            n = self.nodes[node]
            if n[0] is None:
                for s in range(0, len(n[1]), 2048):
                    ids = n[1][s : s + 2048]
                    dot = q[act] @ self.x[ids].T
                    near = dot >= (1 - np.minimum(tau[act], 2.0) ** 2 / 2 - 1e-5)[:, None]
                    hit = np.flatnonzero(near.any(1))
                    if not len(hit):
                        continue
                    rows, near = act[hit], near[hit]
                    near &= names[ids][None, :] != own[rows][:, None]
                    d = np.full(near.shape, np.inf)
                    a, b = np.nonzero(near)
                    for s0 in range(0, len(a), 100_000):
                        i, j = a[s0 : s0 + 100_000], b[s0 : s0 + 100_000]
                        e = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", exact[rows[i]], self.exact[ids[j]])))
                        d[i, j] = np.where(e <= tau[rows[i]] + 1e-9, e, np.inf)
                    hit = np.arange(len(rows))
                    alld = np.concatenate([dist[rows], d[hit]], 1)
                    alli = np.concatenate([idx[rows], np.broadcast_to(ids, (len(hit), len(ids)))], 1)
                    rank = np.where(np.isfinite(alld), names[alli], np.iinfo(np.int64).max)
                    order = np.lexsort((rank, np.round(alld, 9)), axis=1)[:, :k]
                    dist[rows], idx[rows] = np.take_along_axis(alld, order, 1), np.take_along_axis(alli, order, 1)
                    tau[rows] = np.minimum(tau[rows], dist[rows, k - 1])
                return
            vantage, (lo0, hi0, lo1, hi1), a, b = n
            d = _dist(q[act], vantage[None])[:, 0]
            near_inner = d <= (hi0 + lo1) / 2
            reach = lambda lo, hi, s: (d[s] - factor * tau[act[s]] <= hi + 1e-6) & (d[s] + factor * tau[act[s]] >= lo - 1e-6)
            for child, lo, hi, first in ((a, lo0, hi0, near_inner), (b, lo1, hi1, ~near_inner)):
                s = np.flatnonzero(first)
                visit(child, act[s[reach(lo, hi, s)]])
            for child, lo, hi, first in ((b, lo1, hi1, near_inner), (a, lo0, hi0, ~near_inner)):
                s = np.flatnonzero(first)
                visit(child, act[s[reach(lo, hi, s)]])

        for s in range(0, m, 4096):
            visit(self.root, np.arange(s, min(m, s + 4096)))
        return dist, np.where(np.isfinite(dist), idx, -1)


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _ids(col: pd.Series) -> np.ndarray:
    return col.to_numpy(np.int64)


def _matrix(col: pd.Series) -> np.ndarray:
    """Array column as unit rows; vectors of the wrong length can't get here."""
    x = np.array(col.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pivots(vectors: DataFrame, shards: int) -> np.ndarray:
    """Shard centres: vectors of a sample (20,000 or eight per shard, the first by hash), moved to the means of the sample's cells five times."""
    rows = vectors.select("e").orderBy(F.xxhash64("name")).limit(max(20_000, 8 * shards)).toPandas()
    x = _matrix(rows["e"]).astype(np.float32)
    c = x[np.sort(np.random.default_rng(11).choice(len(x), min(shards, len(x)), replace=False))]
    for _ in range(5):
        own = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        mean = np.zeros_like(c)
        np.add.at(mean, own, x)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        c = np.where(size > 1e-6, mean / np.maximum(size, 1e-6), c)
    return c.astype(np.float64)


def nearest_vectors(
    vectors: DataFrame, name: str, emb: str, *, k: int = 5, factor: float = 1.0, shard_factor: float | None = None, max_distance: float = 2.0, per_shard: int | None = None, queries: DataFrame | None = None
) -> DataFrame:
    """Rows ``(query, neighbour, similarity, rank)``: for every vector the ``k`` others most similar by cosine.

    One vector per name: repeats count once (of different vectors under one name the smallest array). Null and zero
    vectors, null names and vectors of another length than the first take no part. Ties go to the smaller hash of the name.
    ``max_distance`` limits the search to a ball (Euclidean between unit vectors; 2 takes all). ``queries`` (one column
    of names) limits who asks, never who is found.

    Vectors go to the nearest of S pivots, S growing as the square root of ten times the row count (or so that a shard has
    about ``per_shard`` rows), which balances the comparisons with pivots against those inside shards. The pivots come
    from a sample of 8 S vectors, all rows are indexed. Shards that still are too large are cut by hash into further
    trees with the same centre. Every shard builds a vantage-point tree. Queries search their home tree first;
    the distance of the k-th find is the ball for the second round, in which a query goes only to the shards that
    the triangle inequality (centre and radius, counted over all rows) can't rule out, with ``factor`` times that ball.
    ``factor`` 1 gives the exact result; below 1 it trades recall for fewer visits.
    """
    rows = vectors.select(F.col(name).alias("label"), F.col(emb).cast("array<float>").alias("e")).where("label is not null and e is not null and exists(e, v -> v <> 0) and forall(e, v -> v is not null and not isnan(v))")
    rows = materialize(rows.groupBy("label").agg(F.min("e").alias("e")).withColumn("name", F.xxhash64("label")))
    top = rows.select(F.size("e")).groupBy("size(e)").count().orderBy(F.desc("count"), "size(e)").first()
    kind = vectors.schema[name].dataType.simpleString()
    if top is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, similarity double, rank int")
    dim, n = top[0], rows.count()
    rows = rows.where(F.size("e") == dim)
    per_shard = per_shard or max(64, math.ceil(math.sqrt(n / 10)))
    centres = _pivots(rows, max(1, math.ceil(n / per_shard)))

    def home(it):
        for pdf in it:
            if not len(pdf):
                continue
            x = _matrix(pdf["e"])
            d = np.concatenate([_dist(x[s : s + 4096], centres) for s in range(0, len(x), 4096)])
            yield pd.DataFrame({"label": pdf["label"], "name": pdf["name"], "e": pdf["e"], "shard": d.argmin(1), "d": d.min(1)})

    placed = materialize(rows.mapInPandas(home, f"label {kind}, name bigint, e array<float>, shard int, d double"))
    stats = placed.groupBy("shard").agg(F.max("d").alias("radius"), F.count("*").alias("n")).orderBy("shard").toPandas()  # one row per shard
    radius = np.full(len(centres), -np.inf)
    radius[stats["shard"]] = stats["radius"]
    cuts = np.ones(len(centres), int)
    cuts[stats["shard"]] = np.ceil(stats["n"] / (8 * per_shard)).astype(int)

    def per_centre(name: str, values) -> DataFrame:
        """One row per shard, of which there are the square root of the rows."""
        return F.broadcast(placed.sparkSession.createDataFrame(pd.DataFrame({"shard": np.arange(len(centres), dtype=np.int32), name: np.asarray(values, dtype=np.int32)})))

    placed = placed.join(per_centre("cut", cuts), "shard")
    cut = F.col("cut")
    data = placed.withColumn("part", F.pmod(F.hash("name"), cut)).select("shard", "part", "name", "e")
    asks = placed if queries is None else placed.join(queries.select(F.col(queries.columns[0]).alias("label")).distinct(), "label", "left_semi")

    def tree_search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": np.zeros(0, np.int64), "f": np.zeros(0, np.int64), "dist": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        tree, names, own = VPTree(_matrix(left["y"])), _ids(left["t"]), _ids(right["q"])
        dist, idx = tree.search(_matrix(right["x"]), np.minimum(right["tau"].to_numpy(float), max_distance), k, names, own, factor)
        r, c = np.nonzero(idx >= 0)
        return pd.DataFrame({"q": own[r], "f": names[idx[r, c]], "dist": dist[r, c]})

    def run(where: DataFrame) -> DataFrame:
        """Cogroup trees with the queries sent to them; hot shards' queries are salted, the tree is built per salt."""
        asked = where.join(per_centre("salts", salts), "shard").withColumn("salt", F.pmod(F.hash("name", F.lit(1)), F.col("salts")))
        asked = asked.select(F.col("shard").alias("qs"), F.col("part").alias("qp"), F.col("salt").alias("qt"), F.col("name").alias("q"), F.col("e").alias("x"), "tau")  # own names: cogroup mixes up columns of one source
        trees = data.join(per_centre("salts", salts), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        trees = trees.select("shard", "part", "salt", F.col("name").alias("t"), F.col("e").alias("y"))
        return trees.groupBy("shard", "part", "salt").cogroup(asked.groupBy("qs", "qp", "qt")).applyInPandas(tree_search, "q bigint, f bigint, dist double")

    def salted(counts: dict[int, int]):
        return [max(1, math.ceil(counts.get(s, 0) / 20_000)) for s in range(len(centres))]

    parts = F.explode(F.sequence(F.lit(0), cut - 1)).alias("part")
    salts = salted(dict(zip(stats["shard"], stats["n"])))
    first = materialize(run(asks.select("shard", "name", "e", F.lit(float(max_distance)).alias("tau"), parts)))
    tau = first.groupBy("q").agg(F.sort_array(F.collect_list("dist")).alias("l")).select("q", F.when(F.size("l") >= k, F.element_at("l", k)).otherwise(F.lit(2.0)).alias("tau"))
    known = asks.join(tau, F.col("name") == F.col("q"), "left").select("name", "e", F.col("shard").alias("home"), F.least(F.coalesce("tau", F.lit(2.0)), F.lit(float(max_distance))).alias("tau"))

    def reach(it):
        for pdf in it:
            if not len(pdf):
                continue
            x, tau_ = _matrix(pdf["e"]), pdf["tau"].to_numpy(float)
            for s in range(0, len(x), 4096):
                d = _dist(x[s : s + 4096], centres)
                mine = d.min(1)
                t = (factor if shard_factor is None else shard_factor) * tau_[s : s + 4096]
                # ball against the shard's ball, and against its cell: d(q, c) - d(q, own centre) <= 2 t for points nearer to c
                ok = (d <= radius[None] + t[:, None] + 1e-6) & (d - mine[:, None] <= 2 * t[:, None] + 1e-6)
                ok[np.arange(len(d)), pdf["home"].to_numpy()[s : s + 4096]] = False
                r, c = np.nonzero(ok)
                yield pd.DataFrame({"shard": c.astype(np.int32), "name": pdf["name"].to_numpy()[s + r], "tau": tau_[s + r]})

    both = first
    if len(centres) > 1:
        sent = materialize(known.mapInPandas(reach, "shard int, name bigint, tau double"))
        salts = salted({r[0]: r[1] for r in sent.groupBy("shard").count().collect()})
        both = first.unionByName(run(sent.join(asks.select("name", "e"), "name").join(per_centre("cut", cuts), "shard").select("shard", "name", "e", "tau", parts)))
    best = (
        both.groupBy("q")
        .agg(F.array_sort(F.collect_list(F.struct(F.round("dist", 9).alias("d"), F.col("f").alias("f"), F.col("dist").alias("x")))).alias("l"))
        .select("q", F.posexplode(F.slice("l", 1, k)).alias("pos", "h"))
        .select("q", F.col("h.f").alias("f"), (1 - F.col("h.x") * F.col("h.x") / 2).alias("similarity"), (F.col("pos") + 1).alias("rank"))
    )
    labels = placed.select("name", "label")
    out = best.join(labels.withColumnsRenamed({"name": "q", "label": "query"}), "q")
    return skew_join(materialize(out), labels.withColumnsRenamed({"name": "f", "label": "neighbour"}), "f").select("query", "neighbour", "similarity", "rank")


def similar_pairs(vectors: DataFrame, name: str, emb: str, *, k: int = 5, least_similarity: float = 0.9, factor: float = 0.4, shard_factor: float = 0.1) -> DataFrame:
    """Rows ``(a, b)``, a < b: names with cosine of at least ``least_similarity``, one among the other's ``k`` most similar."""
    ball = math.sqrt(2 - 2 * least_similarity) + 1e-7
    near = nearest_vectors(vectors, name, emb, k=k, factor=factor, shard_factor=shard_factor, max_distance=ball).where(F.col("similarity") >= least_similarity - 1e-9)
    return near.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b")).distinct()
