"""Rank and running-sum operators without a global sort of the rows: windows run over counts, never over raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import order_key


def first_m_per_group(df: DataFrame, group: str, key: str, m: int, seed: int = 0) -> DataFrame:
    """The first ``m`` rows of each group in seeded hash order (ties by key).

    Large groups are cut by hash prefix first, so that no task sorts a whole group: a group's ``m`` smallest are among the
    ``m`` smallest of its 64 slices.
    """
    o = order_key(seed, key)
    slices = df.withColumn("_o", o).withColumn("_s", F.pmod(F.hash(key), F.lit(64)))
    near = slices.withColumn("_r", F.row_number().over(W.partitionBy(group, "_s").orderBy("_o", key))).where(F.col("_r") <= m)
    return near.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_o", key))).where(F.col("_r") <= m).drop("_o", "_s", "_r")


def rank_by_size(df: DataFrame, group: str, name: str, *, start: int = 0) -> DataFrame:
    """(group, size, name): groups ranked by size, ties by the group's own value."""
    n = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    return n.withColumn(name, F.row_number().over(W.orderBy(F.desc("size"), group)) - 1 + start)  # one row per group


def groups_to_reach(df: DataFrame, group: str, shares: list[float]) -> DataFrame:
    """How many of the largest groups hold each share of the rows.

    The running sum is over distinct sizes, of which there are few, with as many groups each.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    w = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    r = sizes.select("n", "k", F.coalesce(F.sum(F.col("n") * F.col("k")).over(w), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("groups_before"), F.sum(F.col("n") * F.col("k")).over(W.partitionBy()).alias("total"))
    targets = r.select("*", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    need = F.ceil((F.col("share") * F.col("total") - F.col("rows_before")) / F.col("n") - 1e-9)
    hit = (F.col("rows_before") < F.col("share") * F.col("total")) & (F.col("rows_before") + F.col("n") * F.col("k") >= F.col("share") * F.col("total") - 1e-9)
    return targets.where(hit).groupBy("share").agg(F.min(F.col("groups_before") + need).cast("bigint").alias("n_groups"))


def quantile_buckets(df: DataFrame, col: str, n: int) -> DataFrame:
    """Adds ``bucket`` 0..n-1 from exact interpolated quantile edges; a value on an inner edge goes up, the largest stays in the last."""
    edges = df.agg(F.percentile(col, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("e"))
    bucket = F.aggregate("e", F.lit(0), lambda acc, x: acc + F.when(F.col(col) >= x, 1).otherwise(0))
    return df.join(F.broadcast(edges)).withColumn("bucket", F.when(F.col(col).isNotNull(), bucket)).drop("e")


def weight_top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` heaviest (cluster_a, cluster_b) cells with running share of all pairs."""
    n = pairs.where("cluster_id_a is not null and cluster_id_b is not null").groupBy("cluster_id_a", "cluster_id_b").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    w = W.orderBy(F.desc("n"), "cluster_id_a", "cluster_id_b")
    top = n.orderBy(F.desc("n"), "cluster_id_a", "cluster_id_b").limit(k)
    return top.join(F.broadcast(total)).select("cluster_id_a", "cluster_id_b", "n", F.row_number().over(w).alias("rank"), (F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) / F.col("total")).alias("cum_share"))


def hash_order_limit(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys in seeded hash order (take-ordered: no full sort)."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().orderBy(order_key(seed, key), key).limit(n)


def positions_within(df: DataFrame, groups: list[str], key: str, seed: int = 0, name: str = "at") -> DataFrame:
    """Position (from 0) of every row inside its group in seeded hash order of ``key``, in 256 slices a group, so that no task ranks a hot group."""
    o = df.withColumn("_o", order_key(seed, key)).withColumn("_s", F.substring("_o", 1, 2))
    slices = o.groupBy(*groups, "_s").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(W.partitionBy(*groups).orderBy("_s")) - F.col("_k")  # 256 rows a group at most
    ranked = o.withColumn("_r", F.row_number().over(W.partitionBy(*groups, "_s").orderBy("_o", key)) - 1)
    return ranked.join(slices.withColumn("_before", before).drop("_k"), [*groups, "_s"]).withColumn(name, (F.col("_r") + F.col("_before")).cast("bigint")).drop("_o", "_s", "_r", "_before")


def row_positions(df: DataFrame, key: str, seed: int = 0, name: str = "pos", buckets: int = 4096) -> DataFrame:
    """Position (from 0) of every row in seeded hash order of a unique ``key``, without one global sort.

    The order key's first hex digits are the bucket; bucket sizes are summed in order (4,096 rows at most), and positions
    inside a bucket are ranked per bucket.
    """
    o = df.withColumn("_o", order_key(seed, key)).withColumn("_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))
    sizes = o.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_o", key)) - 1
    return o.withColumn("_in", inside).join(F.broadcast(sizes), "_b").withColumn(name, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_o", "_b", "_in", "_before")
