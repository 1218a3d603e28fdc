"""Mixing sources to target weights (hierarchical budgets, seeded epochs)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize

PER_BUCKET = 2_000  # documents of a leaf's hash bucket; only the bucket in which a budget ends is ordered


def water_fill(total: float, weights: dict, caps: dict) -> dict:
    """``total`` divided in proportion to ``weights``, nothing above its cap; what a full one can't take goes to the others."""
    out, open_, left = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and caps[k] > 0}, total
    while open_ and left > 1e-9:
        scale = left / sum(weights[k] for k in sorted(open_, key=str))
        full = {k for k in open_ if weights[k] * scale >= caps[k] - out[k] - 1e-9}
        if not full:
            for k in open_:
                out[k] += weights[k] * scale
            break
        for k in sorted(full, key=str):
            left -= caps[k] - out[k]
            out[k] = caps[k]
        open_ -= full
    return out


def budgets(tree: dict, total: float) -> dict:
    """Leaf budgets of ``{path: (weight of each step, capacity)}`` from the root down.

    A node's budget is divided among its children by weight, each up to the capacity of its whole subtree. A leaf's
    shortage therefore goes to its siblings first; only what a subtree can't take at all is shared one level up.
    """
    depth = len(next(iter(tree)))
    out: dict = {}

    def down(prefix: tuple, amount: float) -> None:
        level = len(prefix)
        if level == depth:
            out[prefix] = amount
            return
        weights, caps = {}, {}
        for path, (w, cap) in tree.items():
            if path[:level] == prefix:
                child = path[: level + 1]
                weights[child] = w[level]
                caps[child] = caps.get(child, 0.0) + cap
        for child, share in water_fill(amount, weights, caps).items():
            down(child, share)

    down((), total)
    return out


def mix_sources(docs: DataFrame, doc_id: str, size: str, targets: DataFrame, levels: tuple[str, ...], *, target_level: str = "source", total: float | str | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``picked`` (doc_id, levels, epoch, size) and ``report``.

    ``targets`` (small and fixed: ``source``, ``target_share``, ``max_repeats``) weighs the sources, which are one of
    ``levels`` (``target_level``); a source's share is spread over its leaves by what they hold, and an inner node weighs
    as much as the leaves below it. What a leaf can't deliver, its siblings take, and only what a whole subtree can't
    is shared one level up. Null values of other levels are a node of their own; documents of a null or
    untargeted source, without size or without id take no part. Shares that are null or not positive are none; the
    rest counts in proportion. ``total`` is the size to reach: 'held' for all that the targeted sources hold, by default
    the largest that leaves no present source short of its share. ``goal_share`` is a source's share among those
    present, ``share_gap`` the difference of the actual share to it, ``target_gap`` that to the target as given.

    A leaf's budget is taken as whole epochs, each of all its documents, and a last one of which the prefix by a
    seeded hash is taken that comes nearest to the rest. No document is used more than ``max_repeats`` times. The
    prefix needs no sort of the leaf: hash buckets are summed, those before the cut are in, those behind it out,
    and only the bucket with the cut is ordered.
    """
    spark, first, at = docs.sparkSession, target_level, levels.index(target_level)
    want: dict = {}
    for r in targets.select("source", "target_share", "max_repeats").distinct().orderBy("source", "target_share", "max_repeats").collect():
        if r[0] is not None and r[1] is not None and r[1] > 0:
            want[r[0]] = (float(r[1]), int(r[2] or 0))
    leaf = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    kt = docs.schema[doc_id].dataType.simpleString()
    src = docs.where(F.col(doc_id).isNotNull() & (F.col(size) > 0) & F.col(first).isin(list(want))).select(F.col(doc_id).alias("doc_id"), *[leaf(c).alias(c) for c in levels], F.col(size).cast("bigint").alias("size"))
    src = materialize(src)
    held = src.groupBy(*levels).agg(F.count("*").alias("docs"), F.sum("size").alias("held")).collect()  # one row per leaf of the targeted sources
    by_source: dict = {}
    for r in held:
        by_source[r[at]] = by_source.get(r[at], 0) + r["held"]
    present = {s: w for s, w in want.items() if by_source.get(s, 0) * w[1] > 0}
    scale = sum(w for w, _ in present.values())
    if total == "held":
        total = float(sum(by_source[s] for s in present))
    elif total is None:
        total = min((by_source[s] * rep * scale / w for s, (w, rep) in present.items()), default=0.0)
    weight = {tuple(r[:-2]): want[r[at]][0] * r["held"] / by_source[r[at]] for r in held}
    below: dict = {}
    for path, w in weight.items():
        for i in range(len(levels)):
            below[path[: i + 1]] = below.get(path[: i + 1], 0.0) + w
    tree = {tuple(r[:-2]): (tuple(below[tuple(r[: i + 1])] for i in range(len(levels))), float(r["held"] * want[r[at]][1])) for r in held}
    plan = budgets(tree, total) if tree else {}
    rows = []
    for r in held:
        path, n, most = tuple(r[:-2]), r["held"], want[r[at]][1]
        whole = min(int(plan[path] / n + 1e-9), most)
        rest = plan[path] - whole * n if whole < most else 0.0
        rows.append((*path, whole, float(max(0.0, rest)), math.ceil(r["docs"] / PER_BUCKET)))
    plan_df = F.broadcast(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in levels) + ", whole int, rest double, buckets int"))  # one row per leaf
    placed = src.join(plan_df, list(levels)).withColumn("h", F.xxhash64(F.lit(seed), F.col("whole") + 1, "doc_id", *levels)).withColumn("bucket", F.pmod("h", F.col("buckets")).cast("int"))
    every = placed.where("whole > 0").select("doc_id", *levels, F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("epoch"), "size")
    sums = placed.where("rest > 0").groupBy(*levels, "bucket").agg(F.sum("size").alias("b"))
    before = sums.select(*levels, "bucket", (F.sum("b").over(W.partitionBy(*levels).orderBy("bucket")) - F.col("b")).alias("before"), "b")
    # of each leaf the one bucket in which its budget ends
    ends = before.join(plan_df, list(levels)).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("b") >= F.col("rest")))
    cuts = F.broadcast(ends.groupBy(*levels).agg(F.min("bucket").alias("cut"), F.min("before").alias("before")))
    part = placed.where("rest > 0").join(cuts, list(levels))
    inside = part.where("bucket < cut")
    run = F.sum("size").over(W.partitionBy(*levels).orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = part.where("bucket = cut").withColumn("end", F.col("before") + run).where(F.col("end") - F.col("size") / 2 <= F.col("rest"))
    last = lambda df: df.select("doc_id", *levels, (F.col("whole") + 1).alias("epoch"), "size")
    null_back = [F.when(F.col(c) != "\x00", F.col(c)).alias(c) for c in levels]
    picked = materialize(every.unionByName(last(inside)).unionByName(last(cut)).select(F.col("doc_id").cast(kt).alias("doc_id"), *null_back, "epoch", "size"))

    used = picked.groupBy(first).agg(F.sum("size").alias("tokens"), F.count("*").alias("n_uses"), F.max("epoch").alias("most_repeats")).withColumnRenamed(first, "source")
    goal = spark.createDataFrame([(s, w, w / scale if s in present else 0.0, rep, int(by_source.get(s, 0))) for s, (w, rep) in sorted(want.items())] or [], "source string, target_share double, goal_share double, max_repeats int, held_tokens bigint")
    report = F.broadcast(goal).join(used, "source", "left").select(
        "source", "target_share", "goal_share", "max_repeats", "held_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
    every_token = F.sum("tokens").over(W.partitionBy())  # one row per target
    return picked, report.withColumn("actual_share", F.when(every_token > 0, F.col("tokens") / every_token).otherwise(F.lit(0.0))).withColumns({"share_gap": F.col("actual_share") - F.col("goal_share"), "target_gap": F.col("actual_share") - F.col("target_share")})
