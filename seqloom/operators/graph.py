"""Pair graphs between clusters: components, ranks, cuts and structure."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, rows_of, skew_join

#: Largest number of edges that cutting and bridge search take to the driver; both work on cluster graphs, not on pairs.
MOST_EDGES = 2_000_000
#: Edges that one task joins up: some 100 MB of names.
ONE_TASK = 500_000


def pair_bigraph(pairs: DataFrame, a: str = "cluster_id_a", b: str = "cluster_id_b") -> DataFrame:
    """(src, dst, weight) with 'a:' and 'b:' nodes, weight = pairs; rows with a null end are left out."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.concat(F.lit("a:"), F.col(a)).alias("src"), F.concat(F.lit("b:"), F.col(b)).alias("dst")).agg(F.count("*").alias("weight"))


def local_roots(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest vertex of the group of every vertex 0..n-1 joined by the edges ``u``-``v`` (n = largest index + 1).

    Vectorised union-find: every root hooks on to the smallest root it meets, then all paths are compressed.
    """
    parent = np.arange(int(max(u.max(initial=-1), v.max(initial=-1))) + 1)
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        if not len(u):
            break
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _one_task(edges: pd.DataFrame) -> pd.DataFrame:
    """(x, p): every vertex of a bounded set of edges with the smallest of its component."""
    names, ids = np.unique(np.concatenate([edges["u"].to_numpy(), edges["v"].to_numpy()]), return_inverse=True)
    return pd.DataFrame({"x": names, "p": names[local_roots(ids[: len(edges)], ids[len(edges) :])]})


def components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) with root = the smallest node of the component.

    Star contraction: every node points to the least of itself and its neighbours (one pre-aggregated minimum), pointers
    are doubled until they are flat, edges are moved on to the roots and those inside a root vanish. Rounds go on
    until no edge is left, each on fewer nodes than the one before; the last ``ONE_TASK`` edges are joined up by one task.
    Null ends link nothing; ``nodes`` (one column) adds single nodes.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    every = raw.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    label = None
    live = materialize(raw.where("u is not null and v is not null and u <> v").distinct())
    while rows_of(live):
        if rows_of(live) <= ONE_TASK:
            kind = live.schema["u"].dataType.simpleString()
            up = materialize(live.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(_one_task, f"x {kind}, p {kind}"))
            if label is None:
                label = up
            else:
                label = materialize(skew_join(label, up.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left").select("x", F.coalesce("q", "p").alias("p")))
            break
        both = live.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")
        up = materialize(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("p")))
        while True:
            nxt = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            flat = materialize(skew_join(up, nxt, "p", "left").select("x", F.coalesce("q", "p").alias("q"), F.col("p").alias("old")))
            done = flat.where("q <> old").isEmpty()
            up = flat.select("x", F.col("q").alias("p"))
            if done:
                break
        if label is None:
            label = up
        else:
            moved = skew_join(label, up.select(F.col("x").alias("p"), F.col("p").alias("q")), "p", "left").select("x", F.coalesce("q", "p").alias("p"))
            label = materialize(moved)
        a = materialize(skew_join(live, up.select(F.col("x").alias("u"), F.col("p").alias("pu")), "u").select("pu", "v").distinct())
        live = materialize(skew_join(a, up.select(F.col("x").alias("v"), F.col("p").alias("pv")), "v").where("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
    every = every.where("node is not null").distinct()
    if label is None:
        return every.select("node", F.col("node").alias("root"))
    return every.join(label.withColumnsRenamed({"x": "node", "p": "root"}), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def ranked_components(labels: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(root, size, cc_id): 0 for the largest, ties to the smaller root. ``weights`` (root, size) replaces node counts."""
    n = weights if weights is not None else labels.groupBy("root").agg(F.count("*").alias("size"))
    return n.withColumn("cc_id", F.row_number().over(W.orderBy(F.desc("size"), "root")) - 1)  # one row per component


def cluster_components(pairs: DataFrame, a: str = "cluster_id_a", b: str = "cluster_id_b") -> DataFrame:
    """Pairs with ``cc_id`` by the number of pairs; rows with a null cluster have none."""
    labels = components(pair_bigraph(pairs, a, b))
    on_a = labels.select(F.expr("substring(node, 3)").alias(a), F.col("root").alias("_root")).where(F.col("node").startswith("a:"))
    tagged = pairs.join(on_a, a, "left").withColumn("_root", F.when(F.col(b).isNotNull(), F.col("_root")))
    sizes = tagged.where("_root is not null").groupBy(F.col("_root").alias("root")).agg(F.count("*").alias("size"))
    ranks = ranked_components(labels, sizes).select(F.col("root").alias("_root"), "cc_id")
    return tagged.join(ranks, "_root", "left").drop("_root")


def sequence_components(pairs: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """As ``cluster_components`` over the sequences themselves."""
    return cluster_components(pairs, f"{hash_col}_a", f"{hash_col}_b")


def clusters_from_hits(hits: DataFrame, nodes: DataFrame, prefix: str = "C", *, least_identity: float = 0.0) -> DataFrame:
    """(hash, cluster_id) from similarity hits; single nodes kept; a hit on an unknown node is an error.

    Clusters are numbered by size, ties by their smallest hash.
    """
    from ..checks import DataCheckError

    known = nodes.select(F.col(nodes.columns[0]).alias("hash")).distinct()
    used = hits.where(F.col("fident") >= least_identity)
    odd = used.select(F.explode(F.array("query", "target")).alias("hash")).where("hash is not null").join(known, "hash", "left_anti").limit(3).collect()
    if odd:
        raise DataCheckError(f"hits on unknown nodes: {[r[0] for r in odd]}")
    labels = components(used, "query", "target", known)
    return skew_join(labels, ranked_components(labels).select("root", "cc_id"), "root").select(F.col("node").alias("hash"), F.concat(F.lit(f"{prefix}_"), F.col("cc_id")).alias("cluster_id"))


def infeasible_components(pairs: DataFrame, hash_col: str = "prot_hash", cc: str = "cc_id") -> DataFrame:
    """Components in which every recombination of an a with a b sequence was observed, so no negative exists."""
    g = pairs.where(F.col(cc).isNotNull() & F.col(f"{hash_col}_a").isNotNull() & F.col(f"{hash_col}_b").isNotNull()).groupBy(cc)
    return g.agg(F.count_distinct(f"{hash_col}_a").alias("n_a"), F.count_distinct(f"{hash_col}_b").alias("n_b"), F.count_distinct(f"{hash_col}_a", f"{hash_col}_b").alias("n_pairs")).withColumn("infeasible", F.col("n_a") * F.col("n_b") == F.col("n_pairs"))


def feasibility(pairs: DataFrame, cc: str = "cc_id", *, largest: float = 0.8, second: float = 0.2) -> DataFrame:
    """The shares of the two largest components and whether a split can hold both."""
    from .aggregates import component_sizes

    s = component_sizes(pairs, cc)
    one = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("share"))), F.lit(0.0))
    return s.agg(one(1).alias("largest_share"), one(2).alias("second_share"), F.count("*").alias("n_components")).withColumn("feasible", (F.col("largest_share") <= largest) & (F.col("second_share") <= second))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, weight)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def component_structure(edges: DataFrame) -> DataFrame:
    """Per component: nodes on each side, edges, pairs, and the share of its pairs at its busiest node."""
    labels = components(edges)
    e = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy("root").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("n_pairs"))
    n = labels.groupBy("root").agg(F.count_if(F.col("node").startswith("a:")).alias("n_a"), F.count_if(F.col("node").startswith("b:")).alias("n_b"))
    hub = degrees(edges).join(labels, "node").groupBy("root").agg(F.max("weight").alias("hub"))
    return n.join(e, "root").join(hub, "root").select("root", "n_a", "n_b", "n_edges", "n_pairs", (F.col("hub") / F.col("n_pairs")).alias("hub_share"))


# --- small cluster graphs, on the driver -------------------------------------------------------------------------


def _collect(edges: DataFrame) -> dict[tuple[str, str], int]:
    rows = edges.select("src", "dst", "weight").limit(MOST_EDGES + 1).toPandas()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"cluster graph has more than {MOST_EDGES} edges; cluster more coarsely before cutting")
    return {(u, v): int(w) for u, v, w in sorted(rows.itertuples(index=False))}


def _adjacency(edges: dict) -> dict[str, dict[str, int]]:
    adj: dict = defaultdict(dict)
    for (u, v), w in edges.items():
        adj[u][v] = w
        adj[v][u] = w
    return adj


def _parts(nodes, adj) -> list[list[str]]:
    seen, out = set(), []
    for s in sorted(nodes):
        if s in seen:
            continue
        part, todo = [], [s]
        seen.add(s)
        while todo:
            x = todo.pop()
            part.append(x)
            for y in adj.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out.append(sorted(part))
    return out


def bridges_and_cut_nodes(edges: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """Edges and nodes whose removal takes a component apart (depth-first low points, without recursion)."""
    adj = _adjacency(_collect(edges))
    order: dict = {}
    low: dict = {}
    bridges, cuts = [], set()
    for root in sorted(adj):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children, stack = 0, [(root, None, iter(sorted(adj[root])))]
        while stack:
            x, parent, it = stack[-1]
            for y in it:
                if y == parent:
                    continue
                if y in order:
                    low[x] = min(low[x], order[y])
                else:
                    order[y] = low[y] = len(order)
                    stack.append((y, x, iter(sorted(adj[y]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[x])
                    if low[x] > order[parent]:
                        bridges.append((min(parent, x), max(parent, x)))
                    if parent == root:
                        children += 1
                    elif low[x] >= order[parent]:
                        cuts.add(parent)
        if children > 1:
            cuts.add(root)
    return sorted(bridges), sorted(cuts)


def slowest_mode(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, steps: int = 300) -> np.ndarray:
    """Eigenvector of the second smallest eigenvalue of a connected graph's Laplacian, by Lanczos steps on its edge list
    (both directions of every edge), each made orthogonal to the constant vector and to all before it.

    Up to ``steps`` + 1 nodes the result is exact; beyond it is the best vector of that many steps.
    """
    degree = np.bincount(u, w, minlength=n)
    q = np.sin(np.arange(1, n + 1) * 1.7)
    constant = np.full(n, n**-0.5)
    basis, diagonal, beside = [], [], []
    for _ in range(min(steps, n - 1)):
        for b in (constant, *basis, constant, *basis):  # twice, against rounding
            q = q - (q @ b) * b
        size = np.linalg.norm(q)
        if size < 1e-7:
            break
        if basis:
            beside.append(size)
        q = q / size
        image = degree * q - np.bincount(u, w * q[v], minlength=n)
        basis.append(q)
        diagonal.append(q @ image)
        q = image
    t = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
    return np.array(basis).T @ np.linalg.eigh(t)[1][:, 0]


def bisect(nodes: list[str], adj: dict, method: str = "spectral", seed: int = 1) -> set[str]:
    """One side of a bisection of a connected graph.

    'spectral' takes the negative side of the Laplacian's second eigenvector over sorted nodes (the lower half where the
    signs separate nothing); up to two nodes give the first. 'kl' swaps nodes between two halves (halves by seeded
    hash) as long as a pass of swaps lowers the cut weight.
    """
    nodes = sorted(nodes)
    if len(nodes) <= 2:
        return {nodes[0]}
    at = {n: i for i, n in enumerate(nodes)}
    ends = np.array([(at[u], at[v], w) for u in nodes for v, w in adj[u].items() if v in at], float).reshape(-1, 3)
    if method == "spectral":
        vec = slowest_mode(ends[:, 0].astype(int), ends[:, 1].astype(int), ends[:, 2], len(nodes))
        below = vec < 0 if vec[np.abs(vec).argmax()] > 0 else vec > 0  # the sign of an eigenvector is arbitrary: the largest entry is positive
        chosen = np.flatnonzero(below & (np.abs(vec) > 1e-9))
        if len(chosen) in (0, len(nodes)):
            chosen = vec.argsort(kind="stable")[: len(nodes) // 2]
        return {nodes[i] for i in chosen}
    m = np.zeros((len(nodes), len(nodes)))
    m[ends[:, 0].astype(int), ends[:, 1].astype(int)] = ends[:, 2]
    if method != "kl":
        raise ValueError(f"unknown method {method!r}")
    import hashlib

    shuffled = sorted(range(len(nodes)), key=lambda i: hashlib.md5(f"{seed}|{nodes[i]}".encode()).hexdigest())
    inside = np.zeros(len(nodes), bool)
    inside[shuffled[: len(nodes) // 2]] = True
    for _ in range(10):
        side, free, gains, swaps = inside.copy(), np.ones(len(nodes), bool), [], []
        for _ in range(len(nodes) // 2):
            cross = np.where(side[:, None] != side[None], m, 0).sum(1) - np.where(side[:, None] == side[None], m, 0).sum(1)
            a, b = np.flatnonzero(side & free), np.flatnonzero(~side & free)
            if not len(a) or not len(b):
                break
            g = cross[a][:, None] + cross[b][None] - 2 * m[np.ix_(a, b)]
            i, j = np.unravel_index(np.argmax(g), g.shape)
            gains.append(g[i, j])
            swaps.append((a[i], b[j]))
            side[a[i]], side[b[j]] = False, True
            free[[a[i], b[j]]] = False
        if not gains or np.max(np.cumsum(gains)) <= 1e-12:
            break
        for a, b in swaps[: int(np.argmax(np.cumsum(gains))) + 1]:
            inside[a], inside[b] = False, True
    return {nodes[i] for i in np.flatnonzero(inside)}


def lpt_drift(sizes: list[int], targets: dict[str, float]) -> float:
    """Worst deviation of a split's share from its target after packing; 1 for nothing to pack."""
    from .splits import pack_largest_first

    total = float(sum(sizes))
    if total <= 0:
        return 1.0
    packed = pack_largest_first([(i, s) for i, s in enumerate(sizes)], {k: t * total for k, t in targets.items()})
    filled = dict.fromkeys(targets, 0)
    for i, s in enumerate(sizes):
        filled[packed[i]] += s
    return max(abs(filled[k] / total - targets[k]) for k in targets)


def fragment(pairs: DataFrame, stop: Callable[[list[int], int, int], bool], *, a: str = "cluster_id_a", b: str = "cluster_id_b", method: str = "spectral", seed: int = 1, max_drop: float = 1.0, max_cuts: int = 1000) -> tuple[DataFrame, DataFrame, dict]:
    """(kept pairs, dropped pairs, audit): cuts the heaviest component until ``stop(atom weights, cuts, dropped)``.

    Before each cut ``stop`` is asked; a heaviest component of fewer than three nodes is the floor; a cut that would
    bring the dropped share over ``max_drop`` isn't made. Only the cluster graph comes to the driver (bounded by
    MOST_EDGES), the cut edges go back as a table that the pairs are split by.
    """
    left = _collect(pair_bigraph(pairs, a, b))
    total, dropped, cut, gone, reason = sum(left.values()), 0, 0, [], "max_cuts"
    while True:
        adj = _adjacency(left)
        parts = [(sum(left.get((u, v), 0) for u in p for v in adj[u]), p) for p in _parts(adj, adj)]
        if not parts or stop([w for w, p in parts if len(p) > 1], cut, dropped):
            reason = "stop_fn"
            break
        if cut >= max_cuts:
            break
        weight, heaviest = max(parts, key=lambda x: x[0])
        if len(heaviest) < 3:
            reason = "cut_floor"
            break
        side = bisect(heaviest, adj, method, seed)
        inside = set(heaviest)
        cross = [(u, v) for (u, v) in left if u in inside and (u in side) != (v in side)]
        loss = sum(left[e] for e in cross)
        if (dropped + loss) / total > max_drop:
            reason = "max_drop_frac"
            break
        for e in cross:
            gone.append(e)
            del left[e]
        dropped += loss
        cut += 1
    audit = {"n_cuts": cut, "n_atoms": len(_parts(_adjacency(left), _adjacency(left))), "pairs_dropped": dropped, "dropped_frac": round(dropped / total, 6) if total else 0.0, "stopped_reason": reason}
    table = pairs.sparkSession.createDataFrame([(u[2:], v[2:]) for u, v in gone] or [], f"{a} string, {b} string")
    return pairs.join(table, [a, b], "left_anti"), pairs.join(table, [a, b], "left_semi"), audit


def fragment_to_atoms(pairs: DataFrame, n_atoms: int, **options):
    """G9 with the count stop."""
    return fragment(pairs, lambda sizes, cuts, dropped: len(sizes) >= n_atoms, **options)


def fragment_to_targets(pairs: DataFrame, targets: dict[str, float], drift: float = 0.02, **options):
    """Until the packed splits are within ``drift`` of their targets."""
    return fragment(pairs, lambda sizes, cuts, dropped: lpt_drift(sorted(sizes, reverse=True), targets) <= drift, **options)


def hub_peel(edges: DataFrame, target_share: float, *, by: str = "degree") -> pd.DataFrame:
    """Nodes in the order they are removed (busiest first, ties to the smaller name) until the largest component holds at most ``target_share`` of all pairs."""
    left = _collect(edges)
    total, out = sum(left.values()), []
    while left:
        adj = _adjacency(left)
        share = max(sum(left.get((u, v), 0) for u in p for v in adj[u]) for p in _parts(adj, adj)) / total
        if share <= target_share:
            break
        score = (lambda n: len(adj[n])) if by == "degree" else (lambda n: sum(adj[n].values()))
        node = min(adj, key=lambda n: (-score(n), n))
        out.append((len(out) + 1, node, share))
        left = {e: w for e, w in left.items() if node not in e}
    return pd.DataFrame(out, columns=["step", "node", "largest_share_before"])
