"""Splits, folds and packing over whole groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import order_key
from .filters import matching_isolates, validate_spec
from .windows import hash_order_limit, row_positions

#: Groups a packing takes to the driver; atoms are components or clusters, far fewer than rows.
MOST_GROUPS = 5_000_000


def pack_largest_first(groups: list[tuple], targets: dict) -> dict:
    """B1: largest group to the bin that lacks most; ties to the earlier bin. Groups of one size go by number, else by text."""

    def key(g):
        try:
            return (-g[1], 0, int(g[0]), "")
        except (TypeError, ValueError):
            return (-g[1], 1, 0, str(g[0]))

    lack, out = dict(targets), {}
    for name, size in sorted(groups, key=key):
        best = max(lack, key=lambda b: lack[b])
        out[name] = best
        lack[best] -= size
    return out


def _group_sizes(df: DataFrame, group: str) -> list[tuple]:
    rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).limit(MOST_GROUPS + 1).toPandas()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: pack coarser groups")
    return list(zip(rows[group].tolist(), rows["n"].tolist()))


def _attach(df: DataFrame, group: str, placed: dict, name: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(group, df.schema[group].dataType), T.StructField(name, kind)])
    return df.join(df.sparkSession.createDataFrame([(k, v) for k, v in placed.items()], schema), group, "left")


def route_holdout(df: DataFrame, group: str, shares: dict[str, float], name: str = "split") -> DataFrame:
    """Whole groups to splits near the given shares (in tie order); rows without a group have no split."""
    sizes = _group_sizes(df, group)
    total = sum(n for _, n in sizes)
    return _attach(df, group, pack_largest_first(sizes, {k: s * total for k, s in shares.items()}), name, T.StringType())


def group_folds(df: DataFrame, group: str, k: int, name: str = "fold") -> DataFrame:
    """Whole groups to ``k`` folds, the largest left to the lightest fold; ties by (-size, id) and the lower fold."""
    sizes = _group_sizes(df, group)
    if len(sizes) < k:
        raise ValueError(f"{len(sizes)} groups can't make {k} folds")
    return _attach(df, group, pack_largest_first(sizes, {i: 0 for i in range(k)}), name, T.IntegerType())


def fold_rows(df: DataFrame, fold: int, key: str, val_share: float, seed: int, *, total: int | None = None) -> DataFrame:
    """Rows of one of ``group_folds``' folds as test, of the others the first by seeded hash as val, the rest as train.

    Val has exactly half-even rounded ``val_share * total`` rows (of all rows by default); more than there are is an error.
    """
    n = df.count() if total is None else total
    rest = df.where(F.col("fold") != fold)
    return carve_rows(rest, key, val_share, seed, total=n).unionByName(df.where(F.col("fold") == fold).withColumn("split", F.lit("test")))


def carve_rows(df: DataFrame, key: str, val_share: float, seed: int, *, total: int | None = None) -> DataFrame:
    """Adds ``split`` train or val; val is an exact number of rows in seeded hash order of the unique ``key``."""
    have = df.count()
    n = round(val_share * (have if total is None else total))
    if n > have:
        raise ValueError(f"val needs {n} rows of {have}")
    return row_positions(df, key, seed, "_pos").withColumn("split", F.when(F.col("_pos") < n, "val").otherwise("train")).drop("_pos")


def carve_groups(df: DataFrame, group: str, val_share: float, seed: int, *, total: int | None = None) -> DataFrame:
    """Whole groups in seeded hash order go to val while it has fewer than ``val_share * total`` rows."""
    from pyspark.sql import Window as W

    n = df.count() if total is None else total
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).withColumn("_o", order_key(seed, group))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_o", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per group
    picked = sizes.withColumn("_before", before).where(F.col("_before") < val_share * n).select(group, F.lit("val").alias("split"))
    return df.join(picked, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def random_split(df: DataFrame, key: str, shares: dict[str, float], seed: int, name: str = "split") -> DataFrame:
    """Exact shares of the rows in seeded hash order; the last split takes the rounding."""
    n, cut, expr = df.count(), 0, None
    names = list(shares)
    for s in names[:-1]:
        cut += int(n * shares[s])
        expr = F.when(F.col("_pos") < cut, s) if expr is None else expr.when(F.col("_pos") < cut, s)
    out = row_positions(df, key, seed, "_pos")
    return out.withColumn(name, expr.otherwise(F.lit(names[-1])) if expr is not None else F.lit(names[-1])).drop("_pos")


def isolate_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Whole isolates to ``k`` folds of equal numbers of isolates by seeded hash order."""
    ids = row_positions(df.where(F.col(key).isNotNull()).select(key).distinct(), key, seed, "_pos").select(key, (F.col("_pos") % k).cast("int").alias("fold"))
    return df.join(ids, key, "left")


def leave_one_out(df: DataFrame, group: str, n_groups: int, key: str, val_share: float, seed: int) -> list[DataFrame]:
    """Each of the ``n_groups`` groups with most positives is the test fold once; val is carved from the rest."""
    top = [r[0] for r in df.where(F.col(group).isNotNull() & (F.col("label") == 1)).groupBy(group).count().orderBy(F.desc("count"), group).limit(n_groups).collect()]
    test = lambda g: F.coalesce(F.col(group) == g, F.lit(False))
    return [carve_rows(df.where(~test(g)), key, val_share, seed + i).unionByName(df.where(test(g)).withColumn("split", F.lit("test"))) for i, g in enumerate(top)]


def random_folds(df: DataFrame, key: str, sizes: list[int], seed: int) -> DataFrame:
    """Rows cut into folds of exactly ``sizes`` in seeded hash order of a unique key."""
    if sum(sizes) != df.count():
        raise ValueError("sizes must add up to the number of rows")
    expr, end = F.lit(None).cast("int"), sum(sizes)
    for i in reversed(range(len(sizes))):
        expr = F.when(F.col("_pos") < end, F.lit(i)).otherwise(expr)
        end -= sizes[i]
    return row_positions(df, key, seed, "_pos").withColumn("fold", expr).drop("_pos")


def drift(df: DataFrame, shares: dict[str, float], split: str = "split") -> DataFrame:
    """Per split its rows, share, target and deviation."""
    n = df.where(F.col(split).isNotNull()).groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"))
    goal = df.sparkSession.createDataFrame(list(shares.items()), "split string, target double")
    total = df.where(F.col(split).isNotNull()).agg(F.count("*").alias("total"))
    out = F.broadcast(goal).join(n, "split", "left").join(F.broadcast(total)).select("split", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)).alias("share"), "target")
    return out.withColumn("deviation", F.abs(F.col("share") - F.col("target")))


def max_feasible_k(largest_share: float, drift_allowed: float, n_groups: int) -> int:
    """B16."""
    gap = largest_share - drift_allowed
    return n_groups if gap <= 0 else min(int(1 / gap), n_groups)


def metadata_holdout(df: DataFrame, train: dict, test: dict, val_share: float, seed: int, key: str = "assembly_id") -> DataFrame:
    """(isolate, slot): test and train isolates by spec, val an exact share of train, 'dropped' those that match neither.

    A spec pair that shares isolates is an error, as is one that leaves a side empty.
    """
    validate_spec(train)
    validate_spec(test)
    a, b = matching_isolates(df, train, key), matching_isolates(df, test, key)
    if a.isEmpty() or b.isEmpty():
        raise ValueError("a side of the holdout matches no isolate")
    if not a.join(b, key, "left_semi").isEmpty():
        raise ValueError("train and test share isolates")
    placed = carve_rows(a, key, val_share, seed).unionByName(b.withColumn("split", F.lit("test")))
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(placed, key, "left").select(key, F.coalesce("split", F.lit("dropped")).alias("slot"))


def balanced_pool(df: DataFrame, stratum: str, seed: int, *, per_stratum: int | None = None, key: str = "assembly_id") -> DataFrame:
    """Rows of as many isolates of every stratum, the smallest stratum's number by default; never more than there are."""
    from .windows import first_m_per_group

    ids = df.where(F.col(key).isNotNull() & F.col(stratum).isNotNull()).groupBy(key).agg(F.min(stratum).alias(stratum))
    n = per_stratum if per_stratum is not None else ids.groupBy(stratum).count().agg(F.min("count")).first()[0]
    return df.join(first_m_per_group(ids, stratum, key, n or 0, seed).select(key), key, "left_semi")


def sample_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` groups in seeded hash order."""
    return df.join(hash_order_limit(df, group, n, seed), group, "left_semi")


def sample_either_side(pairs: DataFrame, n: int, seed: int, key: str = "assembly_id") -> DataFrame:
    """Pairs of which either side's isolate is among ``n`` sampled ones."""
    ids = pairs.select(F.explode(F.array(f"{key}_a", f"{key}_b")).alias("id"))
    picked = hash_order_limit(ids, "id", n, seed)
    flag = lambda s: picked.select(F.col("id").alias(f"{key}_{s}"), F.lit(True).alias(f"_{s}"))
    return pairs.join(flag("a"), f"{key}_a", "left").join(flag("b"), f"{key}_b", "left").where("_a or _b").drop("_a", "_b")
