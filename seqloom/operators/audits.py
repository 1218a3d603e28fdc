"""Reports on builds and runs, and the bookkeeping of cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import h_part, n_part
from ..scratch import skew_join
from . import graph as G
from .aggregates import split_sets


def segment_assignment(df: DataFrame) -> DataFrame:
    """Per canonical segment (null as 'unassigned') rows, isolates, functions, and lengths: mean, least, most."""
    return df.groupBy(F.coalesce("canonical_segment", F.lit("unassigned")).alias("segment")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("assembly_id").alias("n_isolates"), F.count_distinct("function").alias("n_functions"), F.avg("length").alias("mean_length"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    )


def sequence_spread(df: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """Per sequence its rows, distinct files and isolates, for those with more than one row."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files"), F.count_distinct("assembly_id").alias("n_isolates")).where("n_rows > 1")


def dataset_statistics(pairs: DataFrame, split: str = "split_name") -> DataFrame:
    """Per split pairs, positives, negatives, their ratio (null without positives), isolates and sequences on either side."""
    base = pairs.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    ends = lambda c, n: pairs.select(F.col(split).alias("split"), F.explode(F.array(f"{c}_a", f"{c}_b")).alias("v")).where("v is not null").groupBy("split").agg(F.count_distinct("v").alias(n))
    out = base.join(ends("assembly_id", "n_isolates"), "split", "left").join(ends("prot_hash", "n_sequences"), "split", "left")
    return out.withColumn("neg_ratio", F.try_divide("n_neg", "n_pos"))


def function_pairs(pairs: DataFrame, splits: list[str], split: str = "split_name") -> DataFrame:
    """Unordered function pairs by split, one column per split; nulls are 'unknown'."""
    f = lambda s: F.coalesce(F.col(f"func_{s}"), F.lit("unknown"))
    long = pairs.select(F.least(f("a"), f("b")).alias("first"), F.greatest(f("a"), f("b")).alias("second"), F.col(split).alias("s"))
    return long.groupBy("first", "second").agg(*[F.count_if(F.col("s") == s).alias(s) for s in splits])


def isolate_overlap(pairs: DataFrame, split: str = "split_name") -> DataFrame:
    """Isolates by the combination of splits they occur in."""
    return split_sets(pairs, ["assembly_id"], split).select("splits", F.col("n_values").alias("n_isolates"))


def experiment_table(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per run: its settings, and the metrics of a long (run, metric, value) table as columns ``auc``, ``f1``, ``mcc`` where it has them."""
    wide = metrics.groupBy("run").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("auc", "f1", "mcc")])
    return runs.join(wide, "run", "left")


def training_profile(steps: DataFrame) -> DataFrame:
    """Per phase of a run the summed and mean seconds and its share of the run's time."""
    n = steps.groupBy("run", "phase").agg(F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.count("*").alias("n"))
    return n.withColumn("share", F.try_divide("total", F.sum("total").over(W.partitionBy("run"))))  # phases of a run


def pair_table(pairs: DataFrame, atoms: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs with the atom of each cluster, ``kept`` (both in one atom) and the subtype with its parts; ``atoms`` is (cluster_id, atom_id), each cluster once."""
    out = pairs
    for s in "ab":
        out = out.join(atoms.select(F.col("cluster_id").alias(f"cluster_id_{s}"), F.col("atom_id").alias(f"atom_{s}")), f"cluster_id_{s}", "left")
    m = meta.where("assembly_id is not null").groupBy(F.col("assembly_id").alias("assembly_id_a")).agg(F.min("hn_subtype").alias("hn_subtype"))
    out = out.join(m, "assembly_id_a", "left").withColumn("kept", F.coalesce(F.col("atom_a") == F.col("atom_b"), F.lit(False)))
    return out.withColumns({"h": h_part("hn_subtype"), "n": n_part("hn_subtype")})


def category_scheme(df: DataFrame, col: str, k: int, where=None) -> DataFrame:
    """(category, rank) of the ``k`` most frequent values of a slice, ties by value."""
    part = df if where is None else df.where(where)
    n = part.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(k)
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "category")))  # k rows


def worth_plotting(df: DataFrame, cols: list[str], least: int = 2) -> DataFrame:
    """(field, n_distinct, plot) per column: whether it has ``least`` values to show."""
    one = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_distinct")) for c in cols])).alias("v")).select("v.*", (F.col("v.n_distinct") >= least).alias("plot"))


def feasible_pairs(pairs: DataFrame, clusters: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """Distinct keys with the clusters of both sides; pairs without either go."""
    from .joins import attach_cluster_ids

    return attach_cluster_ids(pairs.where("pair_key is not null"), clusters, hash_col).where("cluster_id_a is not null and cluster_id_b is not null").select("pair_key", "cluster_id_a", "cluster_id_b").distinct()


def file_statistics(files: DataFrame, counts: list[DataFrame], file: str = "file") -> DataFrame:
    """Every file with the counts of each table, 0 where it has none; a table's file column is unique."""
    out = files.select(file).distinct()
    for c in counts:
        names = [x for x in c.columns if x != file]
        out = out.join(c, file, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})
    return out


def with_parent(children: DataFrame, parent: DataFrame) -> DataFrame:
    """Every child row with the columns of a one-row table (more rows are an error)."""
    if len(parent.limit(2).collect()) > 1:
        raise ValueError("the parent table must have one row")
    return children.join(F.broadcast(parent.limit(1)), how="inner")


def common_keys(pairs: DataFrame, key: str = "pair_key", split: str = "split_name") -> DataFrame:
    """(first, second, n) for each two splits with a common key; none in a sound build."""
    one = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    two = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return one.select(F.explode(two).alias("p")).groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def dropped_isolates(df: DataFrame, placed: DataFrame, key: str = "assembly_id") -> DataFrame:
    """Isolates that no slot took."""
    return df.where(F.col(key).isNotNull()).select(key).distinct().join(placed.select(key).distinct(), key, "left_anti")


def same_partition(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """One row (n_rows, n_labels_a, n_labels_b, n_meets, same): two labellings are one partition if their labels map one to one."""
    both = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    n = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_rows"), F.count_distinct("x").alias("n_labels_a"), F.count_distinct("y").alias("n_labels_b"), F.count("*").alias("n_meets")).withColumn("same", (F.col("n_meets") == F.col("n_labels_a")) & (F.col("n_meets") == F.col("n_labels_b")))


def by_count(observed: DataFrame, n: int) -> DataFrame:
    """The ``n`` pairs observed in most isolates, ties by key."""
    return observed.orderBy(F.desc("num_isolates"), "pair_key").limit(n)


def in_split_order(df: DataFrame, split: str = "split", order: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows with ``position`` of their split in a fixed order, sorted by it (others last, then by name)."""
    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(split))
    return df.withColumn("position", F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")).orderBy("position", split)


def crossing_pairs(pairs: DataFrame, edges: DataFrame, a: str = "cluster_id_a", b: str = "cluster_id_b") -> DataFrame:
    """The pairs that lie on ``edges`` (src, dst), given in either direction, with or without slot prefixes."""
    bare = lambda c: F.regexp_replace(c, "^[ab]:", "")
    turned = F.col("src").startswith("b:")
    e = edges.select(F.when(turned, bare("dst")).otherwise(bare("src")).alias(a), F.when(turned, bare("src")).otherwise(bare("dst")).alias(b)).distinct()
    return pairs.join(e, [a, b], "left_semi")


def atom_weights(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(root, n_nodes, n_pairs, is_live, is_largest): components by pairs; live are those of two nodes or more; ties to the smaller root."""
    labels = G.components(edges) if labels is None else labels
    w = skew_join(edges, labels.withColumnsRenamed({"node": "src"}), "src").groupBy("root").agg(F.sum("weight").alias("n_pairs"))
    n = labels.groupBy("root").agg(F.count("*").alias("n_nodes")).join(w, "root", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))
    top = n.orderBy(F.desc("n_pairs"), "root").limit(1).select("root", F.lit(True).alias("is_largest"))
    return n.join(F.broadcast(top), "root", "left").select("root", "n_nodes", "n_pairs", (F.col("n_nodes") >= 2).alias("is_live"), F.coalesce("is_largest", F.lit(False)).alias("is_largest"))


def cut_within_budget(pairs: DataFrame, max_drop: float, *, targets: dict[str, float] | None = None, drift: float = 0.05, **options) -> tuple[DataFrame, dict]:
    """Kept pairs and audit of a cut to packable components; one that would drop more than ``max_drop`` of the pairs is an error."""
    kept, _, audit = G.fragment_to_targets(pairs, targets or {"train": 0.8, "val": 0.1, "test": 0.1}, drift, max_drop=max_drop, **options)
    if audit["stopped_reason"] == "max_drop_frac":
        raise ValueError(f"no cut within the drop budget of {max_drop}")
    return kept, audit


def bigraph_of_stored(pairs: DataFrame) -> DataFrame:
    """The cluster bigraph of a stored pair table; pairs listed twice (by key) count once."""
    one = pairs.where("pair_key is not null").select("pair_key", "cluster_id_a", "cluster_id_b").distinct()
    return G.pair_bigraph(one)


def component_ranks(pairs: DataFrame) -> DataFrame:
    """(node, cc_rank): every cluster node with the rank of its component by pairs, 0 the largest, ties to the smaller root."""
    edges = G.pair_bigraph(pairs)
    labels = G.components(edges)
    sizes = skew_join(edges, labels.withColumnRenamed("node", "src"), "src").groupBy("root").agg(F.sum("weight").alias("size"))
    return skew_join(labels, G.ranked_components(labels, sizes).select("root", F.col("cc_id").alias("cc_rank")), "root").select("node", "cc_rank")
