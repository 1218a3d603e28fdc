"""Filling fixed-capacity containers with items (multiway differencing)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .group_splits import differencing


def pack_items(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of every item, no window above ``capacity`` (no item may be).

    Multiway differencing divides the items into near-equal windows, at first as few as the total allows. While one
    exceeds the capacity the number rises, in doubling steps; a bisection then goes back to the smallest number
    that fits between the last two.
    """
    if not len(sizes):
        return np.zeros(0, int)
    fits = lambda s: np.bincount(s, sizes).max() <= capacity
    low = max(1, math.ceil(sizes.sum() / capacity)) - 1
    high, step = low + 1, 1
    slots = differencing(sizes, high)
    while not fits(slots):
        low, high, step = high, min(high + step, len(sizes)), step * 2
        slots = differencing(sizes, high)
    while high - low > 1:
        mid = (low + high) // 2
        tried = differencing(sizes, mid)
        if fits(tried):
            high, slots = mid, tried
        else:
            low = mid
    return slots


def fill_containers(items: DataFrame, item_id: str, size: str, containers: DataFrame, *, windows_per_shard: int = 192, items_per_shard: int = 20_000) -> DataFrame:
    """Rows ``(container_kind, window_id, item_id, piece, piece_start, piece_size)``: every item once per container kind.

    ``containers`` is a small fixed table of ``container_kind, capacity_tokens``. An item larger than the capacity, and no
    other, is split: into full windows of its own and a rest that is packed like an item. Items of size 0 or null fill
    nothing and are left out, as are null ids and kinds without a positive capacity; repeated rows are items of their own.

    Items are hashed into shards of about ``windows_per_shard`` windows, or of ``items_per_shard`` items where those are
    small, so a shard's size is bounded and its last, partly filled windows weigh little; every shard is packed by
    ``pack_items``.
    """
    kinds = [(r[0], int(r[1])) for r in containers.distinct().collect() if r[0] is not None and r[1] and r[1] > 0]
    kt = items.schema[item_id].dataType.simpleString()
    schema = f"container_kind string, window_id string, item_id {kt}, piece int, piece_start bigint, piece_size bigint"
    src = items.where(F.col(item_id).isNotNull() & (F.col(size) > 0)).select(F.col(item_id).alias("item_id"), F.col(size).cast("bigint").alias("n"))
    total, n_items = src.agg(F.sum("n"), F.count("*")).first()
    if not kinds or not total:
        return items.sparkSession.createDataFrame([], schema)
    table = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("cap"), F.lit(max(1, math.ceil(total / (c * windows_per_shard)), math.ceil(n_items / items_per_shard))).alias("shards")) for k, c in kinds])
    each = src.select("item_id", "n", F.explode(table).alias("t")).select("item_id", "n", "t.*").withColumn("shard", F.pmod(F.xxhash64("item_id"), F.col("shards")))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "n"], kind="stable")
        kind, cap, shard = pdf["container_kind"].iat[0], int(pdf["cap"].iat[0]), int(pdf["shard"].iat[0])
        ids, n = pdf["item_id"].to_numpy(), pdf["n"].to_numpy()
        full = n // cap * (n > cap)
        rest = n - full * cap
        has = np.flatnonzero(rest > 0)
        slots = pack_items(rest[has], cap)
        whole = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        window = [*(f"{kind}/{shard}/{s}" for s in slots), *(f"{kind}/{shard}/f{i}.{p}" for i, p in zip(whole, nth))]
        return pd.DataFrame(
            {
                "container_kind": kind,
                "window_id": window,
                "item_id": np.concatenate([ids[has], ids[whole]]),
                "piece": np.concatenate([full[has] + 1, nth + 1]).astype(np.int32),
                "piece_start": np.concatenate([full[has] * cap, nth * cap]),
                "piece_size": np.concatenate([rest[has], np.full(len(whole), cap)]),
            }
        )

    return each.groupBy("container_kind", "shard").applyInPandas(pack, schema)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: ``n_windows, n_items, n_pieces, used, unused, fill_share, least_fill`` (of the fullest to the emptiest window)."""
    windows = packed.groupBy("container_kind", "window_id").agg(F.sum("piece_size").alias("used"), F.count("*").alias("pieces"), F.count_if(F.col("piece_start") == 0).alias("items"))
    caps = containers.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("cap")).distinct()
    return (
        windows.join(F.broadcast(caps), "container_kind")
        .groupBy("container_kind")
        .agg(
            F.count("*").alias("n_windows"), F.sum("items").alias("n_items"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("used"),
            F.sum(F.col("cap") - F.col("used")).alias("unused"), (F.sum("used") / F.sum("cap")).alias("fill_share"), F.min(F.col("used") / F.col("cap")).alias("least_fill"),
        )
    )
