"""Whole builds: positives, components, routing, regime-targeted negatives and the checks that a labelled split must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checks import DataCheckError
from ..functions.keys import order_key, pair_key
from ..functions.metadata import regime
from ..schema import AXES, REGIME_CHAIN, REGIMES
from ..scratch import materialize
from . import aggregates as A
from . import graph as G
from . import joins as J
from . import pairs as N
from . import splits as S
from .dedup import keep_first, one_per_function
from .windows import first_m_per_group, positions_within


def build_positives(records: DataFrame, left: str, right: str, clusters: DataFrame, *, key: str = "assembly_id", drop_infeasible: bool = True, max_atoms: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """N-16: (positives with ``cluster_id_a``, ``cluster_id_b`` and ``cc_id``, observed pairs).

    One row per isolate and function first, then one pair per key; pairs without both clusters go. Components without any
    possible negative are dropped before the cap on whole components.
    """
    one = one_per_function(records.where(F.col("prot_hash").isNotNull()), [left, right], key)
    observed = materialize(A.observed_pairs(records, "prot_hash", key).select("pair_key"))
    atoms = assign_atoms(N.positive_pairs(one, left, right, key=key), clusters)
    if drop_infeasible:
        atoms = atoms.join(G.infeasible_components(atoms).where("infeasible").select("cc_id"), "cc_id", "left_anti")
    if max_atoms is not None:
        atoms = S.sample_groups(atoms, "cc_id", max_atoms, seed)
    return materialize(atoms), observed


def assign_atoms(positives: DataFrame, clusters: DataFrame, hash_col: str = "prot_hash", *, cut: dict | None = None) -> DataFrame:
    """N-17/B24: pairs whose two sequences have a cluster, with ``cc_id`` of their component; ``cut`` are options of ``graph.fragment_to_targets``.

    With a cut, ``natural_cc_id`` keeps the component before it and the pairs that straddle the cut are gone.
    """
    both = J.attach_cluster_ids(positives, clusters, hash_col).where("cluster_id_a is not null and cluster_id_b is not null")
    out = G.cluster_components(materialize(both))
    if cut is None:
        return out
    kept = G.fragment_to_targets(materialize(out.withColumnRenamed("cc_id", "natural_cc_id")), **cut)[0]
    return G.cluster_components(materialize(kept))


def atoms_apart(df: DataFrame, atom: str, split: str) -> DataFrame:
    """(atom, n_splits) of the atoms that more than one split has; none in a sound build."""
    return df.where(F.col(atom).isNotNull()).groupBy(atom).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def partition(pairs: DataFrame, arm: str, *, group: str = "cc_id", key: str = "pair_key", shares: dict[str, float] | None = None, k: int = 5, fold: int = 0, val_share: float = 0.1, seed: int = 0) -> DataFrame:
    """``split`` by one of the arms: 'holdout' routes whole groups, 'kfold' takes one of k group folds, 'random' the rows,
    'leave_out' the ``fold``-th largest group as test, 'matched' a random re-cut at the sizes of 'kfold'.
    """
    if arm == "holdout":
        return S.route_holdout(pairs, group, shares or {"train": 0.8, "val": 0.1, "test": 0.1})
    if arm == "random":
        return S.random_split(pairs, key, shares or {"train": 0.8, "val": 0.1, "test": 0.1}, seed)
    if arm == "leave_out":
        return S.leave_one_out(pairs, group, fold + 1, key, val_share, seed)[fold]
    if arm not in ("kfold", "matched"):
        raise ValueError(f"unknown arm {arm!r}")
    folds = materialize(S.group_folds(pairs, group, k))
    if arm == "matched":
        sizes = {r[0]: r[1] for r in folds.where("fold is not null").groupBy("fold").count().collect()}  # k rows
        folds = S.random_folds(folds.where("fold is not null").drop("fold"), key, [sizes[i] for i in range(k)], seed)
    return S.fold_rows(folds, fold, key, val_share, seed).drop("fold")


def cluster_folds(pairs: DataFrame, k: int, *, group: str = "cc_id", val_share: float = 0.1, max_drift: float = 0.05, min_test: float = 0.05, seed: int = 0) -> DataFrame:
    """Pairs with ``fold``; all folds are looked at before any is refused, and the error names each with its reason.

    A fold's drift is that of its test share from 1 / k, or of what whole groups leave for validation from ``val_share``.
    """
    folds = materialize(S.group_folds(pairs.where(F.col(group).isNotNull()), group, k))
    bad = fold_feasibility(folds, k, group=group, val_share=val_share, max_drift=max_drift, min_test=min_test, seed=seed).where("not feasible").orderBy("fold").collect()
    if bad:
        raise DataCheckError("folds not feasible: " + "; ".join(f"{r.fold}: test {r.test_share:.4f}, drift {r.drift:.4f}" for r in bad))
    return folds


def fold_feasibility(folds: DataFrame, k: int, *, group: str = "cc_id", val_share: float = 0.1, max_drift: float = 0.05, min_test: float = 0.05, seed: int = 0) -> DataFrame:
    """Per fold ``test_share``, ``drift`` and ``feasible``."""
    n = folds.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct(group).alias("n_groups"))
    total = F.sum("n").over(W.partitionBy())  # k rows
    out = n.select("fold", "n_groups", (F.col("n") / total).alias("test_share"))
    drift = F.abs(F.col("test_share") - 1 / k)
    return out.withColumn("drift", drift).withColumn("feasible", (F.col("drift") <= max_drift) & (F.col("test_share") >= min_test) & (F.lit(val_share) < 1 - F.col("test_share")))


def sample_positives(pairs: DataFrame, unit: list[str], most: int, seed: int = 0, key: str = "pair_key") -> DataFrame:
    """Up to ``most`` pairs of every unit (a component, or a pair of clusters) in seeded hash order."""
    return first_m_per_group(pairs.withColumn("_u", F.xxhash64(*unit)), "_u", key, most, seed).drop("_u")


def shuffled_negatives(pairs: DataFrame, group: str, seed: int = 0, hash_col: str = "prot_hash") -> DataFrame:
    """Every pair's a sequence with the b sequence of the next pair of its group in seeded hash order; true pairs and equal sequences go."""
    a, b = f"{hash_col}_a", f"{hash_col}_b"
    at = materialize(positions_within(pairs.where(F.col(group).isNotNull()).withColumn("_k", F.col("pair_key")), [group], "_k", seed, "_at"))
    n = at.groupBy(group).agg(F.count("*").alias("_n"))
    nxt = at.select(group, F.col("_at"), F.col(b).alias("_b"))
    moved = at.select(group, a, "_at").join(n, group).withColumn("_at", F.pmod(F.col("_at") + 1, F.col("_n"))).join(nxt, [group, "_at"])
    made = moved.select(group, F.col(a), F.col("_b").alias(b)).where(F.col(a) != F.col(b)).withColumn("pair_key", pair_key(a, b))
    return J.without_observed(made, pairs).dropDuplicates(["pair_key"])


def cell_partners(cells: DataFrame) -> DataFrame:
    """N-6/J25: (cell, regime, partner) of every ordered pair of distinct metadata cells; there are as many cells as value combinations."""
    one = materialize(cells.select("cell").distinct())
    return one.crossJoin(one.select(F.col("cell").alias("partner"))).select("cell", regime("cell", "partner").alias("regime"), "partner")


def allocate(targets: dict[str, float], budget: int, available: dict[str, int]) -> dict[str, int]:
    """N-11: counts per regime: the quotas of N-7, none above what is available; a shortage goes to regimes with spare
    supply in proportion to their targets (evenly where none has one), remainders to the larger target, then by name.
    """
    want = N.quotas(targets, budget) if any(targets.get(r, 0) > 0 for r in REGIMES) else dict.fromkeys(REGIMES, 0)
    got = {r: min(max(0, want[r]), available.get(r, 0)) for r in REGIMES}
    while True:
        short = budget - sum(got.values())
        spare = {r: available.get(r, 0) - got[r] for r in REGIMES if available.get(r, 0) > got[r]}
        if short <= 0 or not spare:
            return got
        weight = {r: targets.get(r, 0.0) for r in spare}
        if not sum(weight.values()):
            weight = dict.fromkeys(spare, 1.0)
        order = sorted(spare, key=lambda r: (-weight[r], r))
        share = {r: min(spare[r], int(short * weight[r] / sum(weight.values()))) for r in order}
        for r in order:  # remainders one by one
            if sum(share.values()) < short and share[r] < spare[r] and (weight[r] > 0 or not any(weight[x] > 0 and share[x] < spare[x] for x in spare)):
                share[r] += 1
        for r in order:
            got[r] += share[r]


def regime_budgets(pool: DataFrame, group: str, targets: dict[str, float], budgets: DataFrame) -> DataFrame:
    """N-11: (group, regime, need): each group's ``budget`` allocated over its own supply; one small row per group and regime."""
    supply = A.regime_supply(pool, [group])
    table = budgets.select(group, "budget").join(supply.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("regime", "n_available"))).alias("m")), group)
    kind = pool.schema[group].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = [(g, r, int(n)) for g, b, m in zip(pdf[group], pdf["budget"], pdf["m"]) for r, n in allocate(targets, int(b), dict(m)).items() if n > 0]
            yield pd.DataFrame(out, columns=[group, "regime", "need"])

    return table.mapInPandas(run, f"`{group}` {kind}, regime string, need bigint")


def _place(seed: int, key: str):
    """Seeded start of a walk."""
    return F.conv(F.substring(order_key(seed, key), 1, 12), 16, 10).cast("bigint")


def _by_regime(cells: DataFrame, cell: str, regimes: list[str]) -> DataFrame:
    """A row of ``cells`` per regime that it can have a partner in, with the values of the ``axes`` to agree on."""
    agreed = dict(zip(REGIMES, ((), AXES[:1], AXES[1:2], AXES[2:], AXES[:2], AXES[::2], AXES[1:], AXES)))
    known = lambda r: F.when(F.forall(F.array(F.lit(""), *[F.col(cell)[x].cast("string") for x in agreed[r]]), lambda v: v.isNotNull()), F.concat_ws("\x1f", *[F.col(cell)[x] for x in agreed[r]]))
    return cells.withColumn("_r", F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), known(r).alias("axes")) for r in regimes]))).select("*", "_r.*").drop("_r").where("axes is not null")


def regime_negatives(pool: DataFrame, group: str, need: DataFrame, observed: DataFrame, *, seed: int = 0, taken: DataFrame | None = None, key: str = "assembly_id", first_step: int = 8) -> DataFrame:
    """N-4/N-11/N-20: label-0 pairs of isolates of one group with exactly ``need`` (group, regime, need) rows, as far as pairs exist.

    ``pool`` has ``group``, ``key``, ``prot_hash_a``, ``prot_hash_b`` and ``cell``. The cells that agree on a regime's axes are
    laid on a ring, where a cell looks at ``first_step`` of them from its own seeded start; each of its isolates walks as many
    places among the isolates of those that give the regime. The isolates to ask are the first in seeded order, four times as
    many as pairs are needed. Where need is left, all three are doubled each round, until all is met or every pair was seen,
    so that cells are never all paired with each other before that. A candidate is a key that is neither observed nor taken,
    once; the least seeded hashes are placed. A pair of isolates never meets twice.
    """
    name = F.to_json("cell", {"ignoreNullFields": "false"})
    rows = materialize(pool.where(F.col(group).isNotNull()).select(group, F.col(key).alias("i"), F.col("prot_hash_a").alias("ha"), F.col("prot_hash_b").alias("hb"), "cell", name.alias("ck")))
    ring = materialize(positions_within(rows.where("hb is not null"), [group, "ck"], "i", seed, "at").select(group, F.col("ck").alias("ck2"), F.col("cell").alias("cell2"), "at", F.col("i").alias("ib"), "hb"))
    a = materialize(positions_within(rows.where("ha is not null"), [group], "i", seed, "turn").select(group, "turn", "ck", "cell", F.col("i").alias("ia"), "ha", _place(seed, "i").alias("o")))
    wanted = materialize(need.where("need > 0").withColumn("goal", F.col("need")))
    regimes = [r[0] for r in wanted.where(F.col("regime").isin(*REGIMES)).select("regime").distinct().collect()] or [REGIMES[0]]  # eight at most
    sizes = ring.groupBy(group, "ck2").agg(F.count("*").alias("len"), F.first("cell2").alias("cell2"))
    side = [group, "regime", "axes"]
    cells = materialize(positions_within(_by_regime(sizes, "cell2", regimes), side, "ck2", seed, "at").select(*side, "at", "ck2", "cell2", "len"))
    rings = cells.groupBy(*side).agg(F.count("*").alias("n"), F.sum("len").alias("n_rows"))
    own = materialize(_by_regime(a.groupBy(group, "ck").agg(F.first("cell").alias("cell")), "cell", regimes).join(rings, side).withColumn("o", _place(seed, "ck")))
    far = own.groupBy(group, "regime").agg(F.max(F.greatest("n", "n_rows")).alias("most")).join(a.groupBy(group).agg(F.count("*").alias("n_asking")), group)
    far = materialize(far)  # where a walk ends
    by = W.partitionBy(group, "ck", "regime")  # cells looked at, not rows
    out, todo, step, per_need = None, wanted, first_step, 4
    while True:
        asks = a.join(todo, group).where(F.col("turn") < F.col("goal") * per_need).select(group, "regime", "need", "ck", "ia", "ha", "o")
        seen = own.join(asks.select(group, "regime", "ck").distinct(), [group, "regime", "ck"], "left_semi")
        seen = seen.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(step).cast("bigint"), F.col("n")) - 1))).withColumn("at", F.pmod(F.col("o") + F.col("k"), F.col("n")))
        table = seen.join(cells, [*side, "at"]).where(regime("cell", "cell2") == F.col("regime"))
        table = table.withColumn("end", F.sum("len").over(by.orderBy("k"))).withColumn("total", F.sum("len").over(by)).select(group, "regime", "ck", "ck2", "len", "end", "total")
        met = asks.join(table, [group, "regime", "ck"])
        start = F.pmod("o", "total")
        stop, least = start + F.least(F.lit(step).cast("bigint"), F.col("total")), F.col("end") - F.col("len")
        spans = [(F.greatest(least, start - lap), F.least("end", stop - lap) - 1) for lap in (F.lit(0), F.col("total"))]  # the way may go over the ring's end
        met = met.withColumn("at", F.explode(F.concat(*[F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>")) for x, y in spans]))).withColumn("at", F.col("at") - least)
        cand = met.join(ring, [group, "ck2", "at"]).where("ia <> ib and ha <> hb").select(group, "regime", "need", "ia", "ib", "ha", "hb").withColumn("pair_key", pair_key("ha", "hb"))
        for known in (observed, taken, out):
            if known is not None:
                cand = J.without_observed(cand, known)
        cand = keep_first(cand, ["pair_key"], [F.col(group), F.col("regime"), F.col("ia"), F.col("ib")]).withColumn("h", order_key(seed, "pair_key"))
        near = cand.withColumn("r", F.row_number().over(W.partitionBy(group, "regime", F.substring("h", 1, 2)).orderBy("h", "pair_key"))).where("r <= need")
        part = near.withColumn("r", F.row_number().over(W.partitionBy(group, "regime").orderBy("h", "pair_key"))).where("r <= need").drop("r", "h", "need")
        out = materialize(part if out is None else out.unionByName(part))
        got = out.groupBy(group, "regime").agg(F.count("*").alias("got"))
        todo = materialize(wanted.join(got, [group, "regime"], "left").withColumn("need", F.col("goal") - F.coalesce("got", F.lit(0))).where("need > 0").drop("got"))
        if todo.join(far, [group, "regime"]).where((F.col("most") > step) | (F.col("n_asking") > F.col("goal") * per_need)).isEmpty():
            break
        step, per_need = 2 * step, 2 * per_need
    n = sum((F.col("neg_regime").contains(x).cast("int") for x in ("host", "subtype", "year")), F.lit(0))
    out = out.select(group, "pair_key", F.col("ia").alias(f"{key}_a"), F.col("ib").alias(f"{key}_b"), F.col("ha").alias("prot_hash_a"), F.col("hb").alias("prot_hash_b"), F.lit(0).alias("label"), F.col("regime").alias("neg_regime"))
    return out.withColumn("metadata_match_count", F.when(F.col("neg_regime") == REGIMES[0], 0).otherwise(n))


def covering_negatives(pool: DataFrame, group: str, observed: DataFrame, *, seed: int = 0, key: str = "assembly_id", first_step: int = 4) -> DataFrame:
    """N-3/N-5: for each sequence of either slot of a group one negative, the hardest regime on its way: every open sequence
    walks the ring of the group's other slot, twice as far each round, until it has a partner or saw all of them.

    Rows ``(group, pair_key, ia, ib, prot_hash_a, prot_hash_b, label, neg_regime)``; a pair that covers both its ends counts once.
    """
    rows = pool.where(F.col(group).isNotNull()).select(group, F.col(key).alias("i"), F.col("prot_hash_a").alias("a"), F.col("prot_hash_b").alias("b"), "cell")
    chain = F.array(*[F.lit(r) for r in REGIME_CHAIN])
    found = None
    for slot, other in (("a", "b"), ("b", "a")):
        one = lambda c: keep_first(rows.where(F.col(c).isNotNull()).select(group, F.col(c).alias("h"), "i", "cell"), [group, "h"], [F.col("i")])
        ring = materialize(positions_within(one(other), [group], "h", seed, "at").select(group, "at", F.col("h").alias("h2"), F.col("i").alias("i2"), F.col("cell").alias("cell2")))
        sizes = materialize(ring.groupBy(group).agg(F.count("*").alias("n")))
        open_, done, step = materialize(one(slot).join(sizes, group)), 0, first_step
        while True:
            asks = open_.where(F.col("n") > done).withColumn("at", F.explode(F.sequence(F.lit(done).cast("bigint"), F.least(F.lit(done + step), F.col("n")) - 1)))
            asks = asks.withColumn("at", F.pmod(F.col("at") + F.conv(F.substring(order_key(seed, "h"), 1, 12), 16, 10).cast("bigint"), F.col("n")))
            cand = asks.join(ring, [group, "at"]).where("i <> i2 and h <> h2").withColumn("pair_key", pair_key("h", "h2")).withColumn("neg_regime", regime("cell", "cell2"))
            cand = J.without_observed(cand, observed)
            best = cand.groupBy(group, "h").agg(F.min(F.struct(F.array_position(chain, F.col("neg_regime")).alias("hard"), order_key(seed, "pair_key").alias("o"), "pair_key", "i", "i2", "h2", "neg_regime")).alias("m"))
            mine, theirs = ("i", "i2") if slot == "a" else ("i2", "i")
            left, right = (F.col("h"), F.col("m.h2")) if slot == "a" else (F.col("m.h2"), F.col("h"))
            part = materialize(best.select(group, F.col("h"), F.col("m.pair_key").alias("pair_key"), F.col(f"m.{mine}").alias("ia"), F.col(f"m.{theirs}").alias("ib"), left.alias("prot_hash_a"), right.alias("prot_hash_b"), F.lit(0).alias("label"), F.col("m.neg_regime").alias("neg_regime")))
            found = part.drop("h") if found is None else found.unionByName(part.drop("h"))
            open_ = materialize(open_.join(part.select(group, "h"), [group, "h"], "left_anti"))
            done, step = done + step, done + step
            if open_.where(F.col("n") > done).isEmpty():
                break
    return materialize(keep_first(found, ["pair_key"], [F.col(group), F.col("ia"), F.col("ib")]))


def _left_over(need: DataFrame, placed: DataFrame, group: str) -> DataFrame:
    """The need that ``placed`` pairs leave, regime by regime."""
    got = placed.groupBy(group, F.col("neg_regime").alias("regime")).agg(F.count("*").alias("_got"))
    return need.join(got, [group, "regime"], "left").withColumn("need", F.col("need") - F.coalesce("_got", F.lit(0))).where("need > 0").drop("_got")


def negative_pairs(records: DataFrame, left: str, right: str, observed: DataFrame, n: int, *, seed: int = 0, cells: DataFrame | None = None, targets: dict[str, float] | None = None, forbidden: DataFrame | None = None, key: str = "assembly_id") -> DataFrame:
    """N-3/N-4/N-5/N-8: ``n`` label-0 pairs of sequences of different isolates that were never observed together.

    ``observed`` and ``forbidden`` hold keys that can't be taken. Coverage comes first: each sequence of either slot gets a
    partner (the hardest regime on its way), then the quotas are filled regime by regime; both walk on until quota or
    supply ends, so that a shortfall means that no pair is left. Without ``cells`` there is one regime, 'none_match'.
    """
    one = one_per_function(records.where(F.col("function").isin(left, right) & F.col("prot_hash").isNotNull()), [left], key).unionByName(one_per_function(records.where(F.col("prot_hash").isNotNull()), [right], key))
    pool = one.groupBy(key).agg(F.min(F.when(F.col("function") == left, F.col("prot_hash"))).alias("prot_hash_a"), F.min(F.when(F.col("function") == right, F.col("prot_hash"))).alias("prot_hash_b"))
    if cells is None:
        empty = F.struct(*[F.lit(None).cast("string").alias(a) for a in AXES])
        pool, targets = pool.withColumn("cell", empty), {REGIMES[0]: 1.0}
    else:
        pool = pool.join(cells.select(key, "cell"), key)
    pool = materialize(pool.withColumn("all", F.lit(1)))
    known = observed.select("pair_key") if forbidden is None else observed.select("pair_key").unionByName(forbidden.select("pair_key"))
    cover = covering_negatives(pool, "all", known, seed=seed, key=key)
    need = regime_budgets(pool, "all", targets or dict.fromkeys(REGIMES, 1 / len(REGIMES)), pool.sparkSession.createDataFrame([(1, n)], "all int, budget bigint"))
    neg = regime_negatives(pool, "all", _left_over(need, cover, "all"), known, seed=seed, taken=cover, key=key)
    cols = ["pair_key", f"{key}_a", f"{key}_b", "prot_hash_a", "prot_hash_b", "label", "neg_regime"]
    return cover.withColumnsRenamed({"ia": f"{key}_a", "ib": f"{key}_b"}).select(*cols, F.lit("coverage").alias("phase")).unionByName(neg.select(*cols, F.lit("fill").alias("phase")))


def split_dataset(records: DataFrame, left: str, right: str, clusters: DataFrame, cells: DataFrame, *, arm: str = "holdout", shares: dict[str, float] | None = None, ratio: float = 1.0, targets: dict[str, float] | None = None, seed: int = 0, key: str = "assembly_id") -> DataFrame:
    """N-14: labelled pairs with ``split``: positives, their components, routing by ``arm``, negatives inside each split, and the checks.

    Every sequence gets a negative first where a partner exists; they are filled up to ``ratio`` (half-even) times a
    split's positives, by regime as ``targets`` (all regimes alike by default), allocated and redistributed per split.
    An observed pair is no negative and no key is in two splits. Broken invariants raise.
    """
    pos, observed = build_positives(records, left, right, clusters, key=key, seed=seed)
    routed = materialize(partition(pos, arm, shares=shares, seed=seed).where("split is not null"))
    pool = materialize(routed.select("split", key, "prot_hash_a", "prot_hash_b").join(cells.select(key, "cell"), key))
    budgets = routed.groupBy("split").agg(F.bround(F.count("*") * ratio).cast("bigint").alias("budget"))
    need = regime_budgets(pool, "split", targets or dict.fromkeys(REGIMES, 1 / len(REGIMES)), budgets)
    cover = covering_negatives(pool, "split", observed, seed=seed, key=key)
    neg = regime_negatives(pool, "split", _left_over(need, cover, "split"), observed, seed=seed, taken=cover, key=key)
    cover = cover.withColumnsRenamed({"ia": f"{key}_a", "ib": f"{key}_b"})
    cols = ["pair_key", f"{key}_a", f"{key}_b", "prot_hash_a", "prot_hash_b", "label", "neg_regime", "split", "phase"]
    p = routed.select("*", F.col(key).alias(f"{key}_a"), F.col(key).alias(f"{key}_b"), F.lit(None).cast("string").alias("neg_regime"), F.lit("positive").alias("phase"))
    out = p.select(*cols).unionByName(neg.withColumn("phase", F.lit("fill")).select(*cols)).unionByName(cover.withColumn("phase", F.lit("coverage")).select(*cols))
    return check_split_dataset(materialize(out), observed, key)


def split_invariants(pairs: DataFrame, observed: DataFrame, key: str = "assembly_id") -> DataFrame:
    """N-14/U2/U6: one row of counts that must all be 0: keys in two splits or twice, isolates in two splits, observed negatives, pairs of one isolate."""
    keys = pairs.groupBy("pair_key").agg(F.count("*").alias("n"), F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("keys_in_two_splits"), F.count_if(F.col("n") > 1).alias("keys_twice"))
    iso = pairs.select("split", F.explode(F.array(f"{key}_a", f"{key}_b")).alias("i")).groupBy("i").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("isolates_in_two_splits"))
    neg = pairs.where("label = 0")
    seen = neg.join(observed.select("pair_key").distinct(), "pair_key", "left_semi").agg(F.count("*").alias("observed_negatives"))
    own = neg.agg(F.count_if(F.col(f"{key}_a") == F.col(f"{key}_b")).alias("negatives_of_one_isolate"))
    return keys.join(F.broadcast(iso)).join(F.broadcast(seen)).join(F.broadcast(own))  # one row each


def check_split_dataset(pairs: DataFrame, observed: DataFrame, key: str = "assembly_id") -> DataFrame:
    """Returns ``pairs``; a broken invariant or a missing split is an error."""
    bad = {k: v for k, v in split_invariants(pairs, observed, key).first().asDict().items() if v}
    if bad:
        raise DataCheckError(f"split dataset breaks its rules: {bad}")
    return pairs


def labelled_axes(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """N-14: the pairs with their axis flags."""
    from ..functions.metadata import axis_flags

    return axis_flags(pairs, meta, AXES)
