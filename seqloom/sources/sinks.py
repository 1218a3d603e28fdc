"""Writers: compressed parquet with the checks that must hold before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import DataCheckError
from ..functions.keys import clustering_sequence, sequence_hash
from ..operators.aggregates import split_overlap
from .readers import read_table


def write_splits(pairs: DataFrame, path: str, *, families: list[str], split: str = "split", guard: list[str] | None = None) -> DataFrame:
    """K1: pairs partitioned by split plus the overlap audit, which is returned.

    A value of a ``guard`` family in two splits is an error and nothing is written.
    """
    audit = split_overlap(pairs, families, split)
    if guard:
        bad = audit.where(F.col("family").isin(guard) & (F.col("split") != F.col("other")) & (F.col("n_overlap") > 0)).limit(3).collect()
        if bad:
            raise DataCheckError(f"splits overlap: {[(r['family'], r['split'], r['other'], r['n_overlap']) for r in bad]}")
    pairs.write.mode("overwrite").option("compression", "zstd").partitionBy(split).parquet(f"{path}/pairs")
    audit.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/overlap")
    return pairs.sparkSession.read.parquet(f"{path}/overlap")


def write_folds(pairs: DataFrame, path: str) -> None:
    """K2: one folder per fold and split."""
    pairs.write.mode("overwrite").option("compression", "zstd").partitionBy("fold", "split").parquet(path)


def fasta_lines(df: DataFrame, seq: str, hash_col: str, alphabet: str = "aa") -> DataFrame:
    """K3: (value) two-line records of distinct sequences; a hash that isn't the sequence's own is an error."""
    stale = df.where(F.col(hash_col).isNotNull() & F.col(seq).isNotNull() & (sequence_hash(seq) != F.col(hash_col))).select(hash_col).limit(3).collect()
    if stale:
        raise DataCheckError(f"stale hashes: {[r[0] for r in stale]}")
    one = df.where(F.col(seq).isNotNull()).groupBy(sequence_hash(seq).alias("h")).agg(F.min(seq).alias("s"))
    return one.select(F.concat(F.lit(">"), "h", F.lit("\n"), clustering_sequence("s", alphabet)).alias("value"))


def write_fasta(df: DataFrame, path: str, seq: str, hash_col: str, alphabet: str = "aa") -> None:
    fasta_lines(df, seq, hash_col, alphabet).write.mode("overwrite").text(path)


def combined_lookup(spark: SparkSession, paths: list[str]) -> DataFrame:
    """K4: union of the functions' lookups."""
    return spark.read.parquet(*paths)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K5: new rows replace old ones of their key; others stay; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_csv(spark: SparkSession, stem: str, new: DataFrame, keys: list[str]) -> DataFrame:
    """K5 on a CSV file; the old rows are read fully before they are replaced."""
    from ..scratch import materialize

    strings = new.select(*[F.col(c).cast("string").alias(c) for c in new.columns])
    try:
        strings = upsert(read_table(spark, stem), strings, keys)
    except FileNotFoundError:
        pass
    out = materialize(strings)
    out.write.mode("overwrite").csv(f"{stem}.csv", header=True)
    return out


def write_by_reason(tagged: DataFrame, path: str) -> None:
    """K7: kept rows and rejects, partitioned by the first rule they broke."""
    tagged.withColumn("reject_reason", F.coalesce("reject_reason", F.lit("kept"))).write.mode("overwrite").option("compression", "zstd").partitionBy("reject_reason").parquet(path)


def write_kmers(index: DataFrame, matrix: DataFrame, path: str) -> None:
    """The k-mer index and its sparse rows."""
    index.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    matrix.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/matrix")


def write_components(pairs: DataFrame, path: str) -> DataFrame:
    """K6: pairs with their component, its nodes, its structure and its sizes as four tables; gives the sizes back. ``pairs`` has ``cc_id`` and cluster ids."""
    from ..operators import graph
    from ..operators.aggregates import component_sizes
    from ..scratch import materialize

    edges = materialize(graph.pair_bigraph(pairs))
    tables = {"pairs": pairs, "nodes": graph.components(edges), "structure": graph.component_structure(edges), "sizes": component_sizes(pairs)}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    return pairs.sparkSession.read.parquet(f"{path}/sizes")


def append_vectors(store: DataFrame, new: DataFrame, key: str = "cache_key") -> DataFrame:
    """K8: the rows of ``new`` whose key isn't stored yet, each key once."""
    fresh = new.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(c, F.coalesce("row_idx", F.lit(0))).alias(c) for c in new.columns if c != key])
    return fresh.join(store.select(key).distinct(), key, "left_anti").select(*new.columns)
