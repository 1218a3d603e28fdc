"""Train / validation / test splits that keep related records together (largest differencing over component weights)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, skew_join
from .components import connected_components


def normalized_path(path: str | Column) -> Column:
    """One spelling for a file path: trimmed, no empty or '.' steps, each '..' taken back with the step before it.

    Leading '/' is kept; '..' at the very start stays. Null and blank give null.
    """
    p = F.trim(F.col(path) if isinstance(path, str) else path)
    steps = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.trim(x).isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(F.trim(x)))),
    )
    return F.when(F.length(p) > 0, F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(steps, "/")))


def record_components(records: DataFrame, record_id: str, ties: list[Column]) -> DataFrame:
    """Rows ``(record_id, first_record_id)``: the smallest record id among all a record is tied to, directly or through others.

    Each of ``ties`` is a column expression; records with equal non-null values are tied, null ties nothing. Every value
    becomes links to the smallest record that holds it, found by a pre-aggregated minimum, so that a value in a third
    of all rows makes as many links and no more. Record ids must not be null; repeated ids are one record.
    """
    keys = F.array(*[F.when(t.isNotNull(), F.concat(F.lit(f"{i}\x1f"), t.cast("string"))) for i, t in enumerate(ties)])
    named = materialize(records.select(F.col(record_id).alias("r"), F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key")).where("r is not null").distinct())
    first = named.groupBy("key").agg(F.min("r").alias("f"))
    links = skew_join(named, first, "key").select("r", "f")
    ids = records.select(F.col(record_id).alias("r")).where("r is not null")
    return connected_components(links, "r", "f", vertices=ids).select(F.col("vertex").alias("record_id"), F.col("group_id").alias("first_record_id"))


def differencing(weights: np.ndarray, bins: int) -> np.ndarray:
    """Largest differencing into ``bins`` near-equal bins: the bin of every weight.

    Every weight starts as a partial partition with one filled bin. The two partitions with the largest spread are
    merged, the fullest bins of one with the emptiest of the other, until one is left. Only filled bins are kept, so a
    merge of two small partitions is cheap. Ties go to the earlier weight.
    """
    n = len(weights)
    if not n:
        return np.zeros(0, int)
    # a partition: filled bins as (sum, members), fullest first
    heap: list = [(-float(w), i, [(float(w), [i])]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i, a), (_, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        # a's bins fullest first against b's bins emptiest first, empty bins included
        free = bins - len(a)
        out = list(a)
        rest = b if len(b) <= free else b[:free]
        out += rest
        for k, (s, m) in enumerate(b[free:] if len(b) > free else []):
            t, o = a[len(a) - 1 - k]
            out[len(a) - 1 - k] = (t + s, o + m)
        out.sort(key=lambda x: -x[0])
        low = out[-1][0] if len(out) == bins else 0.0
        heapq.heappush(heap, (-(out[0][0] - low), min(i, j), out))
    slot = np.zeros(n, int)
    for k, (_, m) in enumerate(heap[0][2]):
        slot[m] = k
    return slot


def _allocate(sums: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Whole bins to splits by target proportion: largest bin first to the split that lacks most; ties to the earlier split."""
    lack, out = shares * sums.sum(), np.zeros(len(sums), int)
    for b in np.lexsort((np.arange(len(sums)), -sums)):
        out[b] = int(np.argmax(lack))
        lack[out[b]] -= sums[b]
    return out


def assign_splits(members: DataFrame, component: str, targets: DataFrame, *, bins: int = 200, per_group: int = 20_000, fan_in: int = 50) -> DataFrame:
    """Rows ``(component, split_name, n_records)`` with whole components in one split each, near the target shares.

    Component sizes are counted first. Components are hashed into groups of about ``per_group``; every group is divided
    into ``bins`` near-equal bins by largest differencing. The groups' bins are then items themselves: up to ``fan_in``
    groups at a time are differenced into ``bins`` bins again, round by round, until one set of bins is left (its
    size is fixed by ``bins``). Those few bins go to the splits by what each still lacks. A component larger than
    a bin simply fills its bin further. ``targets`` has ``split_name`` and ``target_share`` (null or non-positive shares
    get nothing, the rest is scaled to one) and is a small fixed table. Null components are left out; an empty table
    gives no rows; no usable target is an error.
    """
    wanted = [(r[0], float(r[1])) for r in targets.select("split_name", "target_share").distinct().collect() if r[0] is not None and r[1] is not None and r[1] > 0]
    if not wanted:
        raise ValueError("targets has no split with a positive share")
    wanted.sort(key=lambda x: (-x[1], x[0]))
    names, shares = [w[0] for w in wanted], np.array([w[1] for w in wanted])
    shares = shares / shares.sum()
    sizes = materialize(members.where(F.col(component).isNotNull()).groupBy(F.col(component).alias("component")).agg(F.count("*").alias("n_records")))
    groups = max(1, math.ceil(sizes.count() / per_group))
    kind = sizes.schema["component"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable").reset_index(drop=True)
        return pd.DataFrame({"item": pdf["item"], "bin": [f"{g}/{s}" for g, s in zip(pdf["g"], differencing(pdf["w"].to_numpy(float), bins))], "w": pdf["w"]})

    level = sizes.select(F.col("component").alias("item"), F.col("n_records").alias("w"), F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g"))
    packed = materialize(level.groupBy("g").applyInPandas(pack, f"item {kind}, bin string, w bigint"))
    path = packed.select(F.col("item").alias("component"), F.col("w").alias("n_records"), "bin")
    while groups > 1:
        groups = math.ceil(groups / fan_in)
        sums = packed.groupBy("bin").agg(F.sum("w").cast("bigint").alias("w"))
        level = sums.select(F.col("bin").alias("item"), "w", F.floor(F.split("bin", "/")[0].cast("bigint") / fan_in).alias("g"))
        packed = materialize(level.groupBy("g").applyInPandas(pack, "item string, bin string, w bigint"))
        path = materialize(skew_join(path.withColumnRenamed("bin", "item"), packed.select("item", "bin"), "item").drop("item"))
    final = packed.groupBy("bin").agg(F.sum("w").alias("w")).orderBy("bin").limit(bins).toPandas()
    to = _allocate(final["w"].to_numpy(float), shares)
    table = members.sparkSession.createDataFrame([(b, names[s]) for b, s in zip(final["bin"], to)] or [], "bin string, split_name string")
    return path.join(F.broadcast(table), "bin").select("component", "split_name", "n_records")
