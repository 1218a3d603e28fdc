"""Counts, modes, overlaps, exposure and diversity measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import pair_key
from ..scratch import pairs_within


def isolate_pair_counts(df: DataFrame, *, mode: str = "unordered", schema: tuple[str, str] | None = None, key: str = "assembly_id") -> DataFrame:
    """A1: pairs an isolate can make: 'ordered' n_A * n_B of the two schema functions, 'unordered' pairs with different functions."""
    n = df.where(F.col(key).isNotNull() & F.col("function").isNotNull()).groupBy(key, "function").agg(F.count("*").alias("n"))
    if mode == "ordered":
        one = lambda f: F.coalesce(F.sum(F.when(F.col("function") == f, F.col("n"))), F.lit(0))
        return n.groupBy(key).agg((one(schema[0]) * one(schema[1])).alias("n_pairs"))
    t = F.sum("n")
    return n.groupBy(key).agg(((t * (t - 1) - F.sum(F.col("n") * (F.col("n") - 1))) / 2).cast("bigint").alias("n_pairs"))


def observed_pairs(df: DataFrame, hash_col: str, key: str = "assembly_id") -> DataFrame:
    """A2: unordered pairs of distinct hashes seen in one isolate: (pair_key, hash_a, hash_b, num_isolates)."""
    one = df.where(F.col(key).isNotNull() & F.col(hash_col).isNotNull()).select(key, F.col(hash_col).alias("h")).distinct()
    both = pairs_within(one, key, "h").withColumnsRenamed({"a": "hash_a", "b": "hash_b"})
    return both.groupBy("hash_a", "hash_b").agg(F.count("*").alias("num_isolates")).withColumn("pair_key", pair_key("hash_a", "hash_b"))


def observed_pair_stats(observed: DataFrame) -> DataFrame:
    return observed.agg(F.count("*").alias("n_pairs"), F.max("num_isolates").alias("max_isolates"), F.count_if(F.col("num_isolates") > 1).alias("n_multi"))


def modal_value(df: DataFrame, key: str, field: str) -> DataFrame:
    """Most frequent value per key, ties to the smallest; missing counts as 'unknown'. Null keys are left out."""
    n = df.where(F.col(key).isNotNull()).groupBy(key, F.coalesce(F.col(field).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("m")).select(key, F.col("m.value").alias(field), (-F.col("m.neg")).alias("n"))


def distributions(df: DataFrame, fields: list[str], key: str = "assembly_id") -> DataFrame:
    """A5: (field, value, n_isolates) in one pass, nulls counted, one value per isolate (its smallest)."""
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(f).cast("string").alias(f) for f in fields])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")).select("v.*")
    return long.groupBy("field", "value").agg(F.count("*").alias("n_isolates"))


def metadata_coverage(df: DataFrame, axes: list[str], hash_col: str) -> DataFrame:
    """A6 per axis: rows, share of null rows (%), distinct sequences, sequences without any value, distinct values."""
    long = df.select(hash_col, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("v")).select(hash_col, "v.*")
    rows = long.groupBy("axis").agg(F.count("*").alias("n_rows"), F.round(F.count_if(F.col("value").isNull()) * 100 / F.count("*"), 3).alias("null_pct"), F.count_distinct("value").alias("n_values"))
    seqs = long.where(F.col(hash_col).isNotNull()).groupBy("axis", hash_col).agg(F.count("value").alias("n")).groupBy("axis").agg(F.count("*").alias("n_sequences"), F.count_if(F.col("n") == 0).alias("n_sequences_without"))
    return rows.join(seqs, "axis", "left")


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """T4."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def exposure(pairs: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """Per sequence its pairs by slot and label and whether it is seen in positives, negatives or both."""
    long = pairs.select("label", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"{hash_col}_{s}").alias("seq_hash")) for s in "ab"])).alias("v")).select("label", "v.*").where("seq_hash is not null")
    n = lambda s, y: F.count_if((F.col("slot") == s) & (F.col("label") == y))
    out = long.groupBy("seq_hash").agg(n("a", 1).alias("pos_a"), n("b", 1).alias("pos_b"), n("a", 0).alias("neg_a"), n("b", 0).alias("neg_b"))
    pos, neg = F.col("pos_a") + F.col("pos_b") > 0, F.col("neg_a") + F.col("neg_b") > 0
    return out.withColumn("exposure", F.when(pos & neg, "dual").when(pos, "pos_only").otherwise("neg_only"))


def exposure_summary(exposed: DataFrame) -> DataFrame:
    """A8."""
    return exposed.groupBy("exposure").agg(F.count("*").alias("n_sequences"), F.sum(F.col("pos_a") + F.col("pos_b")).alias("n_pos"), F.sum(F.col("neg_a") + F.col("neg_b")).alias("n_neg"))


def axis_flag_summary(pairs: DataFrame, axes: list[str]) -> DataFrame:
    """Per label and axis how many pairs agree, differ, are unknown."""
    long = pairs.select("label", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"same_{a}").alias("same")) for a in axes])).alias("v")).select("label", "v.*")
    return long.groupBy("label", "axis").agg(F.count_if(F.col("same")).alias("n_same"), F.count_if(~F.col("same")).alias("n_different"), F.count_if(F.col("same").isNull()).alias("n_unknown"))


def _long_hashes(pairs: DataFrame, families: list[str], split: str) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("family"), F.lit(s).alias("side"), F.col(f"{f}_{s}").alias("value")) for f in families for s in "ab"]
    return pairs.select(F.col(split).alias("split"), "label", F.explode(F.array(*parts)).alias("v")).select("split", "label", "v.*").where("value is not null")


def split_overlap(pairs: DataFrame, families: list[str], split: str = "split_name") -> DataFrame:
    """Per family, side, label and split: pairs, unique values, and of those the number also in each split (any label).

    One (family, side, value) row carries the splits it occurs in, so no split is joined with another.
    """
    long = _long_hashes(pairs, families, split)
    n = long.groupBy("family", "side", "label", "split", "value").agg(F.count("*").alias("n"))
    where = long.groupBy("family", "side", "value").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    both = n.join(where, ["family", "side", "value"]).select("family", "side", "label", "split", "n", F.explode("splits").alias("other"))
    total = n.groupBy("family", "side", "label", "split").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_unique"))
    hits = both.groupBy("family", "side", "label", "split", "other").agg(F.count("*").alias("n_overlap"))
    return hits.join(total, ["family", "side", "label", "split"]).withColumn("overlap_pct", F.round(F.col("n_overlap") * 100 / F.col("n_unique"), 2))


def split_sets(pairs: DataFrame, families: list[str], split: str = "split_name") -> DataFrame:
    """Per family the number of values by the combination of splits they occur in."""
    long = _long_hashes(pairs, families, split)
    return long.groupBy("family", "value").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")).groupBy("family", "splits").agg(F.count("*").alias("n_values"))


def sequence_split_labels(pairs: DataFrame, family: str, split: str = "split_name") -> DataFrame:
    """A55/A56/V-15: (value, split_label, is_ambiguous): the one split of a value, 'leakage' where there are several."""
    one = _long_hashes(pairs, [family], split).groupBy("value").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return one.select("value", F.when(F.size("s") > 1, "leakage").otherwise(F.element_at("s", 1)).alias("split_label"), (F.size("s") > 1).alias("is_ambiguous"))


def leakage_pct(pairs: DataFrame, families: list[str], split: str = "split_name") -> DataFrame:
    """Share of values that are in two or more splits."""
    long = _long_hashes(pairs, families, split).groupBy("family", "value").agg(F.count_distinct("split").alias("n"))
    return long.groupBy("family").agg(F.count("*").alias("n_values"), F.count_if(F.col("n") >= 2).alias("n_shared"), F.round(F.count_if(F.col("n") >= 2) * 100 / F.count("*"), 4).alias("shared_pct"))


def split_shares(df: DataFrame, split: str = "split_name") -> DataFrame:
    """A12."""
    n = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 4))  # one row per split


def counts_over(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Groups with more than ``limit`` rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit)


def counts_per_file(df: DataFrame, core: list[str], aux: list[str], file: str = "file") -> DataFrame:
    """Total, core, aux and other rows of each file."""
    c, a = F.count_if(F.col("function").isin(core)), F.count_if(F.col("function").isin(aux))
    return df.groupBy(file).agg(F.count("*").alias("total"), c.alias("core"), a.alias("aux"), (F.count("*") - c - a).alias("other"))


def function_duplicates(df: DataFrame, file: str = "file") -> DataFrame:
    """Functions that a file has more than once, with up to three features (by name) as a preview."""
    g = df.where(F.col("function").isNotNull()).groupBy(file, "function").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("brc_fea_id")).alias("f")).where("n > 1")
    return g.select(file, "function", "n", F.array_join(F.slice("f", 1, 3), ",").alias("preview"))


def function_counts(df: DataFrame, by: list[str], *, functions: list[str] | None = None, more_than: int = 0, drop_null: bool = True) -> DataFrame:
    """Counts per combination, sorted by count; ``drop_null`` leaves out combinations with a null."""
    out = df if functions is None else df.where(F.col("function").isin(functions))
    if drop_null:
        out = out.dropna(subset=by)
    return out.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > more_than).orderBy(F.desc("n"), *by)


def cluster_sizes(lookup: DataFrame) -> DataFrame:
    """Distinct hashes per cluster."""
    return lookup.groupBy("cluster_id").agg(F.count_distinct("hash").alias("n"))


def cluster_size_distribution(lookup: DataFrame) -> DataFrame:
    """One row; p90 and p99 cut to whole numbers."""
    p = lambda q: F.floor(F.percentile("n", q)).cast("bigint")
    return cluster_sizes(lookup).agg(
        F.count("*").alias("n_clusters"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), p(0.9).alias("p90"), p(0.99).alias("p99"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("singleton_share")
    )


def component_sizes(pairs: DataFrame, cc: str = "cc_id") -> DataFrame:
    """Pairs per component, largest first, share and running share (4 digits)."""
    n = pairs.where(F.col(cc).isNotNull()).groupBy(F.col(cc).alias("cc_id")).agg(F.count("*").alias("n"))
    order = W.orderBy(F.desc("n"), "cc_id").rowsBetween(W.unboundedPreceding, 0)  # one row per component
    total = F.sum("n").over(W.partitionBy())
    return n.select("cc_id", "n", F.row_number().over(W.orderBy(F.desc("n"), "cc_id")).alias("rank"), F.round(F.col("n") / total, 4).alias("share"), F.round(F.sum("n").over(order) / total, 4).alias("cum_share"))


def component_summary(pairs: DataFrame, cc: str = "cc_id") -> DataFrame:
    """Pairs, components, the largest, its share, and the largest number of balanced folds ``n // largest``."""
    n = pairs.where(F.col(cc).isNotNull()).groupBy(cc).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_components"), F.max("n").alias("largest"), F.floor(F.sum("n") / F.max("n")).cast("bigint").alias("max_balanced_k")).withColumn("largest_share", F.col("largest") / F.col("n_pairs"))


def component_composition(pairs: DataFrame, cc: str = "cc_id") -> DataFrame:
    """Per component and slot, pairs per cluster and their share (%)."""
    long = pairs.select(F.col(cc).alias("cc_id"), F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"cluster_id_{s}").alias("cluster_id")) for s in "ab"])).alias("v")).select("cc_id", "v.*").where("cc_id is not null and cluster_id is not null")
    n = long.groupBy("cc_id", "slot", "cluster_id").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(W.partitionBy("cc_id", "slot")), 2))


def diversity(df: DataFrame, item: str, by: list[str] | None = None) -> DataFrame:
    """Number of items, Gini, effective numbers by Shannon and by Hill of order 2, of the items' counts."""
    by = by or []
    n = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("n"))
    # Gini from counts of equal sizes: ranks of equal counts are consecutive, so the rows to rank are distinct counts only
    f = n.groupBy(*by, "n").agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(W.partitionBy(*by).orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = f.withColumn("below", below).withColumn("rank_sum", F.col("k") * F.col("below") + F.col("k") * (F.col("k") + 1) / 2)
    t = r.groupBy(*by).agg(F.sum("k").alias("n_items"), F.sum(F.col("n") * F.col("k")).alias("total"), F.sum(F.col("n") * F.col("rank_sum")).alias("w"), F.sum(F.col("k") * F.col("n") * F.ln(F.col("n").cast("double"))).alias("nlogn"), F.sum(F.col("k") * F.col("n") * F.col("n")).alias("sq"))
    T = F.col("total")
    return t.select(
        *by, "n_items", "total", (2 * F.col("w") / (F.col("n_items") * T) - (F.col("n_items") + 1) / F.col("n_items")).alias("gini"),
        F.exp(F.ln(T.cast("double")) - F.col("nlogn") / T).alias("shannon_n"), (T.cast("double") * T / F.col("sq")).alias("hill_2"),
    )


def frequency_tiers(df: DataFrame, item: str) -> DataFrame:
    """Items seen once, 2-9, 10-99, 100-999, 1000+ times, and the row share of the top 1, 10 and 100 (ties by value)."""
    n = df.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), item).limit(100).select("n", F.row_number().over(W.orderBy(F.desc("n"), item)).alias("r"))  # 100 rows
    share = lambda k: F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0))
    tops = top.agg(share(1).alias("t1"), share(10).alias("t10"), share(100).alias("t100"))
    between = lambda a, b: F.count_if(F.col("n").between(a, b))
    all_ = n.agg(between(1, 1).alias("n_once"), between(2, 9).alias("n_2_9"), between(10, 99).alias("n_10_99"), between(100, 999).alias("n_100_999"), F.count_if(F.col("n") >= 1000).alias("n_1000"), F.sum("n").alias("total"))
    return all_.join(F.broadcast(tops)).select("n_once", "n_2_9", "n_10_99", "n_100_999", "n_1000", *[(F.col(t) / F.col("total")).alias(f"top_{t[1:]}_share") for t in ("t1", "t10", "t100")])


def cluster_diversity(df: DataFrame, lookup: DataFrame, hash_col: str) -> DataFrame:
    """Diversity over clusters of the rows' copies."""
    return diversity(df.join(lookup.select(F.col("hash").alias(hash_col), "cluster_id"), hash_col), "cluster_id")


def mutations_tolerated(lengths: DataFrame, thresholds: list[float], length: str = "length") -> DataFrame:
    """Per length and threshold ``L - ceil(L * t)``; the product is rounded to 9 digits so that 0.95 * 100 is 95."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    return lengths.where(F.col(length).isNotNull()).select(F.col(length).alias("length")).distinct().select("length", t).withColumn("n_mutations", (F.col("length") - F.ceil(F.round(F.col("length") * F.col("threshold"), 9))).cast("bigint"))


def length_stats(df: DataFrame, by: str, seq: str) -> DataFrame:
    """Exact quantiles of sequence lengths per group."""
    x = df.where(F.col(seq).isNotNull() & F.col(by).isNotNull()).select(by, F.length(seq).alias("n"))
    p = lambda q: F.percentile("n", q)
    return x.groupBy(by).agg(F.count("*").alias("n_seqs"), F.min("n").alias("shortest"), p(0.25).alias("q25"), p(0.5).alias("median"), p(0.75).alias("q75"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


def regime_supply(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ordered pairs of different isolates available in each regime (per group ``by``), all eight rows of a group.

    From marginal counts, without pairing cells: the isolates that agree on a set of known axes are the squared counts of
    that set's values; those that agree on exactly these follow by inclusion and exclusion over the larger sets.
    """
    from ..functions.metadata import AXES
    from ..schema import REGIMES

    by = by or []
    sets = [tuple(a for i, a in enumerate(AXES) if m >> i & 1) for m in range(8)]
    n = cells.groupBy(*by, *[F.col(f"cell.{a}").alias(a) for a in AXES]).agg(F.count("*").alias("n"))
    flat = n.select(*by, "n", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.when(F.lit(not s) | F.concat(*[F.col(a).isNotNull().cast("string") for a in s] or [F.lit("")]).isin("true" * len(s), ""), F.concat_ws("\x1f", *[F.col(a) for a in s])).alias("v")) for m, s in enumerate(sets)
    ])).alias("x")).select(*by, "n", "x.*").where("v is not null")
    known = sum((F.when(F.col(a).isNotNull(), 1 << i).otherwise(0) for i, a in enumerate(AXES)), F.lit(0))
    least = flat.groupBy(*by, "m", "v").agg(F.sum("n").alias("n")).groupBy(*by, "m").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    alone = n.groupBy(*by, known.alias("m")).agg(F.sum("n").alias("q"))  # an isolate with itself agrees on all it knows
    q, own = (lambda m: F.coalesce(F.max(F.when((F.col("m") == m) & ~F.col("own"), F.col("q"))), F.lit(0))), (lambda m: F.coalesce(F.max(F.when((F.col("m") == m) & F.col("own"), F.col("q"))), F.lit(0)))
    both = least.withColumn("own", F.lit(False)).unionByName(alone.withColumn("own", F.lit(True))).groupBy(*by)
    exact = lambda m: sum(((-1) ** bin(t ^ m).count("1") * q(t) for t in range(8) if t & m == m), F.lit(0)) - own(m)
    name = {(): 0, ("host",): 1, ("hn_subtype",): 2, ("year",): 3, ("host", "hn_subtype"): 4, ("host", "year"): 5, ("hn_subtype", "year"): 6, ("host", "hn_subtype", "year"): 7}
    wide = both.agg(*[exact(m).cast("bigint").alias(REGIMES[name[s]]) for m, s in enumerate(sets)])
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(r).alias("n_available")) for r in REGIMES])).alias("x")).select(*by, "x.*")


def crosstab(df: DataFrame, row: str, col: str, cols: list[str]) -> DataFrame:
    """Counts by row and column value with row and column totals ('All'); nulls are 'unknown'."""
    x = df.select(F.coalesce(F.col(row), F.lit("unknown")).alias("row"), F.coalesce(F.col(col), F.lit("unknown")).alias("col"))
    count = [F.count_if(F.col("col") == c).alias(c) for c in cols]
    return x.rollup("row").agg(*count, F.count("*").alias("All")).withColumn("row", F.coalesce("row", F.lit("All")))


def year_matrix(df: DataFrame, category: str, top: int, year: str = "year") -> DataFrame:
    """(year, category, n) for the ``top`` categories, zeros filled in for every year that occurs."""
    known = df.where(F.col(year).isNotNull() & F.col(category).isNotNull()).select(F.col(year).alias("year"), F.col(category).alias("category"))
    best = known.groupBy("category").agg(F.count("*").alias("t")).orderBy(F.desc("t"), "category").limit(top).select("category")
    grid = known.select("year").distinct().crossJoin(F.broadcast(best))  # years times ``top`` rows
    n = known.groupBy("year", "category").agg(F.count("*").alias("n"))
    return grid.join(n, ["year", "category"], "left").select("year", "category", F.coalesce("n", F.lit(0)).alias("n"))


def null_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: rows, and per column how many are null and how many blank."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in cols], *[F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}_blank") for c in cols])


def mean_std(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, sample deviation, least, most and number over folds."""
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("least"), F.max(metric).alias("most"), F.count(metric).alias("n"))


def pooled_matrix(df: DataFrame, row: str, col: str, cols: list[str], metric: str, weight: str) -> DataFrame:
    """Weighted mean of a metric, rows by thresholds."""
    return df.groupBy(row).pivot(col, cols).agg(F.try_divide(F.sum(F.col(metric) * F.col(weight)), F.sum(weight)))


def symmetric_matrix(df: DataFrame, a: str, b: str, value: str, names: list[str]) -> DataFrame:
    """Both directions of an unordered pair table, as a matrix of means."""
    both = df.select(F.col(a).alias("r"), F.col(b).alias("c"), value).unionByName(df.where(F.col(a) != F.col(b)).select(F.col(b).alias("r"), F.col(a).alias("c"), value))
    return both.groupBy("r").pivot("c", names).agg(F.avg(value))


def partner_supply(pairs: DataFrame, observed: DataFrame, seq: str = "prot_hash", dna: str = "ctg_dna_hash") -> DataFrame:
    """Per split, slot and sequence: distinct DNA variants to cover against partners it was never observed with.

    Observed partners inside the split are counted by a join with ``observed`` (hash_a, hash_b), not by enumerating a product.
    """
    out = None
    for s, o in (("a", "b"), ("b", "a")):
        own = pairs.where(F.col(f"{seq}_{s}").isNotNull()).groupBy(F.col("split_name").alias("split"), F.col(f"{seq}_{s}").alias("seq_hash")).agg(F.count_distinct(f"{dna}_{s}").alias("demand"))
        pool = pairs.where(F.col(f"{seq}_{o}").isNotNull()).select(F.col("split_name").alias("split"), F.col(f"{seq}_{o}").alias("partner")).distinct()
        size = pool.groupBy("split").agg(F.count("*").alias("pool"))
        seen = observed.select(F.explode(F.array(F.struct(F.col("hash_a").alias("x"), F.col("hash_b").alias("y")), F.struct(F.col("hash_b").alias("x"), F.col("hash_a").alias("y")))).alias("v")).select(F.col("v.x").alias("seq_hash"), F.col("v.y").alias("partner"))
        blocked = own.select("split", "seq_hash").join(seen, "seq_hash").join(pool, ["split", "partner"], "left_semi").groupBy("split", "seq_hash").agg(F.count("*").alias("blocked"))
        part = own.join(F.broadcast(size), "split").join(blocked, ["split", "seq_hash"], "left").select("split", F.lit(s).alias("slot"), "seq_hash", "demand", (F.col("pool") - F.coalesce("blocked", F.lit(0))).alias("supply"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("feasible", F.col("supply") >= F.col("demand"))


def stage_flow(stages: dict[str, DataFrame], seq: str = "prot_seq") -> DataFrame:
    """Per pipeline stage rows, distinct isolates and functions, mean and median sequence length."""
    out = None
    for name, df in stages.items():
        part = df.select(F.lit(name).alias("stage"), "assembly_id", "function", F.length(seq).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("stage").agg(F.count("*").alias("n_rows"), F.count_distinct("assembly_id").alias("n_isolates"), F.count_distinct("function").alias("n_functions"), F.avg("n").alias("mean_length"), F.percentile("n", 0.5).alias("median_length"))


def truncation(df: DataFrame, seq: str, limit: int, by: str) -> DataFrame:
    """Per group, sequences longer than a model takes, their share and the residues lost."""
    n = F.length(seq)
    return df.where(F.col(seq).isNotNull()).groupBy(by).agg(F.count("*").alias("n_seqs"), F.count_if(n > limit).alias("n_truncated"), (F.count_if(n > limit) / F.count("*")).alias("truncated_share"), F.sum(F.greatest(n - limit, F.lit(0))).alias("residues_lost"))


def regime_counts(pairs: DataFrame) -> DataFrame:
    """Pairs by regime from their stored ``same_*`` flags; unknown counts as different."""
    from ..schema import REGIMES

    f = lambda a: F.coalesce(F.col(f"same_{a}"), F.lit(False)).cast("int")
    code = f("host") * 4 + f("hn_subtype") * 2 + f("year")
    names = [REGIMES[i] for i in (0, 3, 2, 6, 1, 5, 4, 7)]
    return pairs.groupBy(F.element_at(F.array(*[F.lit(n) for n in names]), code + 1).alias("regime")).agg(F.count("*").alias("n"))


def digest(df: DataFrame, by: list[str], key: str = "pair_key") -> DataFrame:
    """Per group the number of keys and the SHA-256 over them in code point order, one per line.

    For audits of bounded result tables: the group's keys meet in one row.
    """
    return df.where(F.col(key).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("sha256"))


def occupied_cells(pairs: DataFrame) -> DataFrame:
    """Pairs per (cluster_a, cluster_b)."""
    return pairs.where("cluster_id_a is not null and cluster_id_b is not null").groupBy("cluster_id_a", "cluster_id_b").agg(F.count("*").alias("n_pairs"))
