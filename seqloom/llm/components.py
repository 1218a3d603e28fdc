"""Groups of records linked by pairwise matches (two-dimensional grid union-find)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import local_roots
from ..scratch import materialize, rows_of, skew_join


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Star forest of one grid cell: every vertex that isn't the smallest of its local group, with that smallest one."""
    names, ids = np.unique(np.concatenate([pdf["u"].to_numpy(), pdf["v"].to_numpy()]), return_inverse=True)
    n = len(pdf)
    root = local_roots(ids[:n], ids[n:])
    moved = root != np.arange(len(root))
    return pd.DataFrame({"v": names[moved], "root": names[root[moved]]})


def connected_components(edges: DataFrame, src: str, dst: str, *, edges_per_cell: int = 500_000, least_blocks: int = 1, vertices: DataFrame | None = None) -> DataFrame:
    """Rows ``(vertex, group_id)``: the smallest vertex (by code point or number) of the group of each vertex.

    Vertices are hashed into B blocks and edges into the B x B grid of block pairs, so that the edges of one hot vertex
    spread over B cells. Every cell runs union-find on its own edges; the representatives found in a vertex's row and
    column of cells are exchanged by taking their minimum, the edges are contracted on to them, and the rounds go on
    until no edge joins two different representatives. B grows with the edge count, and a cell that still holds more
    than twice ``edges_per_cell``, as those of a hub do, is cut by edge hash (any part of the edges has its own forest),
    so a cell's memory doesn't grow.

    Nulls on either side link nothing, but the other side still is a vertex; self-links and repeated or turned links
    change nothing; an empty table gives an empty result. ``vertices`` (one column) adds vertices without links.
    """
    kind = edges.schema[src].dataType.simpleString()
    raw = edges.select(F.col(src).alias("u"), F.col(dst).cast(kind).alias("v"))
    all_v = raw.select(F.col("u").alias("v")).unionByName(raw.select("v"))
    if vertices is not None:
        all_v = all_v.unionByName(vertices.select(F.col(vertices.columns[0]).cast(kind).alias("v")))
    all_v = all_v.where(F.col("v").isNotNull()).distinct()
    now = materialize(raw.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    size = rows_of(now)
    while size:
        blocks = max(least_blocks, math.ceil(math.sqrt(2 * size / edges_per_cell)))
        block = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(len(steps))), F.lit(blocks))  # noqa: B023, E731
        grid = now.withColumn("a", block("u")).withColumn("b", block("v")).select("u", "v", F.least("a", "b").alias("row"), F.greatest("a", "b").alias("col"))
        part = F.lit(0)
        if blocks > 1:
            full = grid.groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") > 2 * edges_per_cell).collect()  # at most size / (2 * edges_per_cell) cells
            if full:
                cuts = F.create_map(*[F.lit(x) for r in full for x in (r["row"] * blocks + r["col"], math.ceil(r["n"] / edges_per_cell))])
                part = F.pmod(F.xxhash64("u", "v"), F.coalesce(F.try_element_at(cuts, F.col("row") * blocks + F.col("col")), F.lit(1)))
        forest = materialize(grid.withColumn("part", part).groupBy("row", "col", "part").applyInPandas(lambda pdf: _cell(pdf), f"v {kind}, root {kind}"))
        parent = materialize(forest.groupBy("v").agg(F.min("root").alias("p")))
        steps.append(parent)
        up = parent.withColumnRenamed("v", "root").withColumnRenamed("p", "q")
        half = materialize(forest.join(parent, "v").select(F.col("p").alias("pv"), "root").distinct())
        now = materialize(
            skew_join(half, up, "root", "left")
            .select("pv", F.coalesce("q", "root").alias("pr"))
            .where("pv <> pr")
            .select(F.least("pv", "pr").alias("u"), F.greatest("pv", "pr").alias("v"))
            .distinct()
        )
        size = rows_of(now)
    label = None
    for parent in reversed(steps):
        if label is None:
            label = parent
        else:
            nxt = label.select(F.col("v").alias("p"), F.col("p").alias("q"))
            moved = skew_join(parent, nxt, "p", "left").select("v", F.coalesce("q", "p").alias("p"))
            label = materialize(moved.unionByName(label.join(parent.select("v"), "v", "left_anti")))  # some move only in a later round
    if label is None:
        return all_v.select(F.col("v").alias("vertex"), F.col("v").alias("group_id"))
    return all_v.join(label, "v", "left").select(F.col("v").alias("vertex"), F.coalesce("p", "v").alias("group_id"))
