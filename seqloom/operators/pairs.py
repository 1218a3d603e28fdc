"""Positive pairs and constrained negatives as set operations: candidates, anti-joins and quotas by seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import order_key, pair_key
from ..schema import REGIMES
from ..scratch import materialize
from .dedup import keep_first
from .joins import co_isolate_pairs, without_observed

_SIDE = ["brc_fea_id", "prot_hash", "ctg_dna_hash", "function"]


def positive_pairs(df: DataFrame, left: str, right: str, *, hash_col: str = "prot_hash", cols: list[str] | None = None, key: str = "assembly_id") -> DataFrame:
    """N-1/N-18/N-19: one row per distinct pair key: sequences of function ``left`` and ``right`` of one isolate, label 1.

    Of several isolates with one key the first by (isolate, features) stays. Rows without isolate or hash make no pair.
    """
    cols = cols or [c for c in _SIDE if c in df.columns]
    pairs = co_isolate_pairs(df.where(F.col(hash_col).isNotNull()), left, right, cols, key)
    out = pairs.withColumn("pair_key", pair_key(f"{hash_col}_a", f"{hash_col}_b")).withColumn("label", F.lit(1))
    return keep_first(out, ["pair_key"], [F.col(key), F.col("brc_fea_id_a"), F.col("brc_fea_id_b")])


def one_pair_per_isolate(pairs: DataFrame, key: str = "assembly_id") -> DataFrame:
    """N-2: the isolates that break the rule."""
    return pairs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def quotas(targets: dict[str, float], n: int) -> dict[str, int]:
    """N-7: shares to counts, half-even; the rounding is settled on the largest share (ties by name)."""
    out = {r: round(n * targets.get(r, 0.0)) for r in REGIMES}
    best = max(sorted(r for r in REGIMES if targets.get(r, 0) > 0 or out[r] > 0), key=lambda r: targets.get(r, 0.0))
    out[best] += n - sum(out.values())
    return out


def coverage(negatives: DataFrame, records: DataFrame, left: str, right: str) -> DataFrame:
    """Per slot: sequences, covered ones, and the uncovered rest."""
    out = None
    for slot, f in (("a", left), ("b", right)):
        want = records.where((F.col("function") == f) & F.col("prot_hash").isNotNull()).select("prot_hash").distinct()
        part = want.join(negatives.select(F.col(f"prot_hash_{slot}").alias("prot_hash"), F.lit(1).alias("hit")).distinct(), "prot_hash", "left").agg(F.count("*").alias("n_sequences"), F.count("hit").alias("n_covered")).select(F.lit(slot).alias("slot"), "n_sequences", "n_covered", (F.col("n_sequences") - F.col("n_covered")).alias("n_uncovered"))
        out = part if out is None else out.unionByName(part)
    return out


def regime_manifest(negatives: DataFrame, supply: DataFrame, targets: dict[str, float], n: int) -> DataFrame:
    """N-8: per regime its target, supply, coverage and fill placements, shortfall and why."""
    goal = negatives.sparkSession.createDataFrame(list(quotas(targets, n).items()), "regime string, target bigint")
    got = negatives.groupBy(F.col("neg_regime").alias("regime")).agg(F.count_if(F.col("phase") == "coverage").alias("coverage_placed"), F.count_if(F.col("phase") == "fill").alias("fill_placed"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = F.broadcast(goal).join(got, "regime", "left").join(supply.select("regime", "n_available"), "regime", "left")
    out = out.select("regime", "target", z("n_available").alias("available"), z("coverage_placed").alias("coverage_placed"), z("fill_placed").alias("fill_placed"), (z("coverage_placed") + z("fill_placed")).alias("achieved"))
    return out.withColumn("reason", F.when(F.col("achieved") >= F.col("target"), "met").when(F.col("available") == 0, "no_supply").otherwise("candidates_exhausted"))


def within_group_negatives(positives: DataFrame, group: str, observed: DataFrame, ratio: float, *, seed: int = 0, per_row: int = 8, seen: DataFrame | None = None) -> DataFrame:
    """N-9/N-10/N-12: label-0 recombinations of a and b sequences inside a group (a component, or a split), never observed.

    Each group's budget is half-even ``ratio`` times its positives. Candidates pair every a sequence with ``per_row``
    b sequences of its group, chosen by hash position, so a group's product isn't built. Groups whose budget isn't met
    that way go twice as far round, until it is met or every pair of theirs was seen. ``seen`` holds keys placed in
    earlier groups.
    """
    g = positives.where(F.col(group).isNotNull())
    budget = g.groupBy(group).agg(F.bround(F.count("*") * ratio).cast("bigint").alias("budget"))
    a = g.select(group, F.col("prot_hash_a").alias("ha")).where("ha is not null").distinct()
    b = g.select(group, F.col("prot_hash_b").alias("hb")).where("hb is not null").distinct()
    sized = b.groupBy(group).agg(F.count("*").alias("n"))
    # positions inside a group in two steps, so that no task ranks a whole group
    o = b.withColumn("o", order_key(seed, "hb")).withColumn("s", F.substring("o", 1, 2))
    slices = o.groupBy(group, "s").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(W.partitionBy(group).orderBy("s")) - F.col("k")).drop("k")
    ring = materialize(o.withColumn("r", F.row_number().over(W.partitionBy(group, "s").orderBy("o", "hb")) - 1).join(slices, [group, "s"]).select(group, "hb", (F.col("r") + F.col("before")).alias("at")))
    wanted = materialize(budget.join(sized, group))
    out, todo = None, wanted
    while True:
        asks = a.join(todo, group).withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.lit(per_row), F.col("n").cast("int"))))).withColumn("at", F.pmod(F.conv(F.substring(order_key(seed, "ha"), 1, 15), 16, 10).cast("bigint") + F.col("i"), F.col("n")))
        cand = asks.join(ring, [group, "at"]).where("ha <> hb").select(group, "budget", F.col("ha").alias("prot_hash_a"), F.col("hb").alias("prot_hash_b"), pair_key("ha", "hb").alias("pair_key"))
        cand = without_observed(cand, observed)
        for placed in (seen, out):
            if placed is not None:
                cand = without_observed(cand, placed)
        cand = keep_first(cand, ["pair_key"], [F.col(group), F.col("prot_hash_a")]).withColumn("o", order_key(seed, "pair_key"))
        near = cand.withColumn("r", F.row_number().over(W.partitionBy(group, F.substring("o", 1, 2)).orderBy("o", "pair_key"))).where("r <= budget")
        part = materialize(near.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy("o", "pair_key"))).where("r <= budget").select(group, "pair_key", "prot_hash_a", "prot_hash_b", F.lit(0).alias("label")))
        new = not part.isEmpty()  # then a key that another group had first may be free for a group that saw all its pairs
        out = materialize(part if out is None else out.unionByName(part))
        got = out.groupBy(group).agg(F.count("*").alias("got"))
        left = wanted.join(got, group, "left").withColumn("budget", F.col("budget") - F.coalesce("got", F.lit(0)))
        todo = materialize(left.where((F.col("budget") > 0) & ((F.col("n") > per_row) | F.lit(new))).select(group, "budget", "n"))
        if todo.isEmpty():
            return out
        per_row *= 2


def within_split_negatives(positives: DataFrame, observed: DataFrame, ratio: float, splits: list[str], *, seed: int = 0) -> DataFrame:
    """N-12/N-13: ``within_group_negatives`` split by split, no key twice in all of them."""
    out = None
    for s in splits:
        part = materialize(within_group_negatives(positives.where(F.col("split") == s), "split", observed, ratio, seed=seed, seen=out))
        out = part if out is None else out.unionByName(part)
    return out


def swap_sides(pairs: DataFrame) -> DataFrame:
    """Every ``_a`` column becomes its ``_b`` and the other way round."""
    flip = lambda c: f"{c[:-2]}_b" if c.endswith("_a") and f"{c[:-2]}_b" in pairs.columns else f"{c[:-2]}_a" if c.endswith("_b") and f"{c[:-2]}_a" in pairs.columns else c
    return pairs.select(*[F.col(flip(c)).alias(c) for c in pairs.columns])


def orient(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """P25: pairs whose functions fit the schema, sides swapped where they stand the other way round; others go."""
    straight = pairs.where((F.col("func_a") == left) & (F.col("func_b") == right))
    turned = pairs.where((F.col("func_a") == right) & (F.col("func_b") == left)) if left != right else pairs.limit(0)
    return straight.unionByName(swap_sides(turned))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
