"""Validated look-ups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checks import all_matched, unique_key
from ..functions.keys import pair_key


def lookup(df: DataFrame, table: DataFrame, keys: list[str], *, how: str = "left", validate: bool = True, complete: bool = False) -> DataFrame:
    """Many-to-one join; with ``validate`` a repeated key of ``table`` raises, with ``complete`` an unmatched row does.

    Columns that both sides have besides the keys keep the left value.
    """
    extra = [c for c in table.columns if c not in keys and c not in df.columns]
    right = table.select(*keys, *extra)
    if validate:
        unique_key(right, *keys)
    if complete:
        all_matched(df, right, *keys)
    return df.join(right, keys, how)


def attach_hash(df: DataFrame, table: DataFrame, keys: list[str], hash_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``hash_col``, unmatched rows)."""
    right = unique_key(table.select(*keys, hash_col), *keys)
    return df.join(right, keys), df.join(right, keys, "left_anti")


def attach_both_sides(pairs: DataFrame, table: DataFrame, key: str, values: list[str], *, how: str = "left") -> DataFrame:
    """One table looked up on ``<key>_a`` and ``<key>_b``; the values come out suffixed. The key must be unique."""
    for s in "ab":
        side = table.select(F.col(key).alias(f"{key}_{s}"), *[F.col(v).alias(f"{v}_{s}") for v in values])
        pairs = pairs.join(side, f"{key}_{s}", how)
    return pairs


def attach_cluster_ids(pairs: DataFrame, clusters: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    """``cluster_id_a`` and ``cluster_id_b``; rows without a cluster stay, so that misses can be counted."""
    return attach_both_sides(pairs, clusters.select(F.col("hash").alias(hash_col), "cluster_id"), hash_col, ["cluster_id"])


def co_isolate_pairs(df: DataFrame, left: str, right: str, cols: list[str], key: str = "assembly_id") -> DataFrame:
    """Rows of function ``left`` with those of function ``right`` of the same isolate, columns suffixed."""
    side = lambda f, s: df.where((F.col("function") == f) & F.col(key).isNotNull()).select(key, *[F.col(c).alias(f"{c}_{s}") for c in cols])
    return side(left, "a").join(side(right, "b"), key)


def cluster_violations(hits: DataFrame, clusters: DataFrame) -> DataFrame:
    """Unordered hits whose ends are in different clusters."""
    c = clusters.select("hash", "cluster_id")
    q = hits.join(c.withColumnsRenamed({"hash": "query", "cluster_id": "cluster_q"}), "query").join(c.withColumnsRenamed({"hash": "target", "cluster_id": "cluster_t"}), "target")
    return q.where("cluster_q <> cluster_t").select(F.least("query", "target").alias("query"), F.greatest("query", "target").alias("target")).distinct()


def split_transition(before: DataFrame, after: DataFrame, key: str = "pair_key") -> DataFrame:
    """How many keys went from which split to which."""
    return before.select(key, F.col("split").alias("before")).join(after.select(key, F.col("split").alias("after")), key).groupBy("before", "after").agg(F.count("*").alias("n"))


def membership_wide(lookup_table: DataFrame, thresholds: list[str]) -> DataFrame:
    """One row per hash, a cluster column per threshold."""
    return lookup_table.groupBy("hash").pivot("threshold", thresholds).agg(F.min("cluster_id"))


def without_observed(candidates: DataFrame, observed: DataFrame, key: str = "pair_key") -> DataFrame:
    """Candidates whose key wasn't observed."""
    return candidates.join(observed.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def with_pair_key(pairs: DataFrame, hash_col: str = "prot_hash") -> DataFrame:
    return pairs.withColumn("pair_key", pair_key(f"{hash_col}_a", f"{hash_col}_b"))


def isolate_pool(df: DataFrame, left: str, right: str, atoms: DataFrame, key: str = "assembly_id") -> DataFrame:
    """J11/N-15: isolates with both functions whose two sequences are mapped to one atom; unmapped and straddling ones go.

    ``atoms`` is (hash, atom_id).
    """
    pairs = co_isolate_pairs(df, left, right, ["prot_hash"], key)
    both = attach_both_sides(pairs, atoms.withColumnRenamed("hash", "prot_hash"), "prot_hash", ["atom_id"], how="inner")
    return both.where("atom_id_a = atom_id_b").select(key, "prot_hash_a", "prot_hash_b", F.col("atom_id_a").alias("atom_id")).distinct()


def ensure_hash(pairs: DataFrame, table: DataFrame, key: str, hash_col: str) -> DataFrame:
    """DD10: ``<hash_col>_a`` and ``_b`` looked up by ``<key>_a`` and ``_b`` unless both are there with at least one value; empty placeholders are replaced."""
    names = [f"{hash_col}_{s}" for s in "ab"]
    if all(n in pairs.columns for n in names):
        if not pairs.where(F.col(names[0]).isNotNull()).isEmpty() and not pairs.where(F.col(names[1]).isNotNull()).isEmpty():
            return pairs
    return attach_both_sides(pairs.drop(*names), unique_key(table.select(key, hash_col), key), key, [hash_col])


def probe_contigs(features: DataFrame, contigs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features with their contig's columns, one row with the numbers found and missing); a repeated contig is an error."""
    joined = lookup(features, contigs.withColumn("_hit", F.lit(True)), keys)
    return joined.drop("_hit"), joined.agg(F.count("_hit").alias("n_found"), (F.count("*") - F.count("_hit")).alias("n_missing"))


def kmer_bridge(keys: DataFrame, index: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """(key, codes, counts) of the distinct keys that the index knows; of several rows of a key the smallest counts."""
    one = index.join(keys.where(F.col(key).isNotNull()).select(key).distinct(), key).groupBy(key).agg(F.min("row_id").alias("row_id"))
    return one.join(matrix, "row_id").drop("row_id")


def representatives(df: DataFrame, hash_col: str, cols: list[str], order: list[str]) -> DataFrame:
    """One row per hash, the first by ``order``."""
    from .dedup import keep_first

    return keep_first(df.where(F.col(hash_col).isNotNull()), [hash_col], [F.col(o) for o in order]).select(hash_col, *cols)
