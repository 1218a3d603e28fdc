"""How often items occur together, and how far that exceeds chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, rows_of, skew_join


def _products(left: str, right: str):
    """All pairs of two item arrays, smaller item first."""
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def cooccurrence(baskets: DataFrame, basket: str, item: str, *, min_count: int = 1, min_lift: float | None = None, chunk: int = 48) -> DataFrame:
    """Pairs of different items with ``item_a < item_b``, ``n_ab``, ``n_a``, ``n_b``, ``n``, ``lift``, ``pmi`` and ``jaccard``.

    ``n_ab`` counts the distinct baskets that hold both, ``n_a`` and ``n_b`` those of each, ``n`` all baskets. Rows with
    a null basket or item don't count, repeats count once, an empty table gives no rows.

    Pairs need ``n_ab >= min_count`` and ``n_ab * n >= min_lift * n_a * n_b``. Both also bound single items without any
    loss (n_ab is at most the smaller count, so ``n_a >= min_count`` and ``min_lift * n_a <= n``); items that can be in
    no such pair go before pairs are made, the very frequent ones among them. A basket of more than ``chunk`` items is
    cut into item chunks and each pair of chunks is a row, and so a task share, of its own: no basket, however large,
    is expanded in one place. Ordinary baskets are their own only chunk pair.
    """
    base = materialize(baskets.select(F.col(basket).alias("k"), F.col(item).alias("i")).where("k is not null and i is not null").distinct())
    n = base.agg(F.count_distinct("k")).first()[0]
    counts = base.groupBy("i").agg(F.count("*").alias("n_i")).where(F.col("n_i") >= min_count)
    if min_lift is not None:
        counts = counts.where(F.col("n_i") * F.lit(float(min_lift)) <= F.lit(float(n)))
    counts = materialize(counts)
    rows = materialize(skew_join(base, counts.select("i"), "i", hot=[r[0] for r in counts.where("n_i > 200000").orderBy(F.desc("n_i"), "i").limit(10_000).select("i").collect()]))
    sizes = rows.groupBy("k").agg(F.count("*").alias("size"))
    big = sizes.where(F.col("size") > chunk)
    small = rows.join(big.select("k"), "k", "left_anti").groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("l"))
    # each unordered pair of a small basket: element x with those behind it
    inner = F.flatten(F.transform("l", lambda x, p: F.transform(F.slice(F.col("l"), p + 2, F.size("l")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = small.where(F.size("l") > 1).select(F.explode(inner).alias("p"))

    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    placed = skew_join(rows, big, "k", at_most=rows_of(base)).select("k", "i", parts.alias("m")).withColumn("c", F.pmod(F.xxhash64("i"), F.col("m")).cast("int"))
    blocks = placed.select("k", "i", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("d"))
    halves = blocks.groupBy("k", F.least("c", "d").alias("x"), F.greatest("c", "d").alias("y")).agg(
        F.collect_list(F.when(F.col("c") <= F.col("d"), F.col("i"))).alias("l"), F.collect_list(F.when(F.col("c") > F.col("d"), F.col("i"))).alias("r")
    )
    across = halves.where("x < y").select(F.explode(_products("l", "r")).alias("p"))
    within = halves.where("x = y").select(F.explode(_products("l", "l")).alias("p")).where("p.a < p.b")
    # within one chunk both orders of a pair appear: least/greatest folds them, so each is counted twice
    counted = (
        pairs.withColumn("w", F.lit(2))
        .unionByName(across.withColumn("w", F.lit(2)))
        .unionByName(within.withColumn("w", F.lit(1)))
        .groupBy(F.col("p.a").alias("item_a"), F.col("p.b").alias("item_b"))
        .agg((F.sum("w") / 2).cast("bigint").alias("n_ab"))
        .where(F.col("n_ab") >= min_count)
    )
    side = lambda s: counts.select(F.col("i").alias(f"item_{s}"), F.col("n_i").alias(f"n_{s}"))
    counted = materialize(counted)
    n_pairs = rows_of(counted)
    out = skew_join(skew_join(counted, side("a"), "item_a"), side("b"), "item_b", at_most=n_pairs).withColumn("n", F.lit(int(n)).cast("bigint"))
    joint = F.col("n_ab").cast("double") * F.col("n")
    alone = F.col("n_a").cast("double") * F.col("n_b")
    if min_lift is not None:
        out = out.where(joint >= alone * float(min_lift))
    return out.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n", (joint / alone).alias("lift"), F.log(joint / alone).alias("pmi"), (F.col("n_ab") / (F.col("n_a") + F.col("n_b") - F.col("n_ab"))).alias("jaccard")
    )
