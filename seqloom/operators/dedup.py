"""Keep-first dedup with explicit total orders, and segment assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, pairs_within, skew_join


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per ``keys`` by ``order`` (which must be total); null keys are a value."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def gcf_first(file: str = "file"):
    return F.when(F.col(file).startswith("GCF_"), 0).otherwise(1)


def assembly_duplicates(df: DataFrame, seq: str, strategy: str = "keep_first", key: str = "assembly_id") -> DataFrame:
    """DD1: adds ``dup_type`` (null, 'same_file', 'different_files') and ``kept``.

    Rows of one isolate with the same sequence are duplicates: from different files the GCF_ file wins, from one file the
    first (or last) by (file, feature). Null sequences or isolates are no duplicates of each other.
    """
    known = F.col(seq).isNotNull() & F.col(key).isNotNull()
    w = W.partitionBy(seq, key)
    order = [gcf_first(), F.col("file"), F.col("brc_fea_id")]
    last = [gcf_first(), F.col("file"), F.desc("brc_fea_id")]
    files = F.size(F.collect_set("file").over(w))
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_f", files)
    pick = F.when((F.col("_f") > 1) | F.lit(strategy == "keep_first"), F.row_number().over(w.orderBy(*order))).otherwise(F.row_number().over(w.orderBy(*last)))
    return (
        out.withColumn("dup_type", F.when(known & (F.col("_n") > 1), F.when(F.col("_f") > 1, "different_files").otherwise("same_file")))
        .withColumn("kept", ~known | (pick == 1))
        .drop("_n", "_f")
    )


def single_file(df: DataFrame, key: str = "assembly_id", seq: str = "prot_seq") -> DataFrame:
    """DD2: one file per isolate, GCF_ first, then by name; left-over duplicates keep the first by feature."""
    chosen = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(gcf_first().alias("g"), F.col("file").alias("f"))).alias("m")).select(key, F.col("m.f").alias("file"))
    return keep_first(df.join(chosen, [key, "file"], "left_semi"), [key, seq], [F.col("brc_fea_id"), F.col("function")])


def genome_duplicates(df: DataFrame, seq: str = "ctg_dna_seq", key: str = "assembly_id") -> DataFrame:
    """DD3: one row per (sequence, isolate), the first by GCF_ file, file and contig; rows without a sequence or isolate stay."""
    known = F.col(seq).isNotNull() & F.col(key).isNotNull()
    return keep_first(df.where(known), [seq, key], [gcf_first(), F.col("file"), F.col("genbank_ctg_id")]).unionByName(df.where(~known))


def protein_duplicates(df: DataFrame, most: int, seq: str = "prot_seq", key: str = "assembly_id") -> DataFrame:
    """DD4: ``assembly_duplicates`` resolved; an isolate that still has more than ``most`` rows of one function is an error."""
    from ..checks import DataCheckError
    from .aggregates import counts_over

    out = assembly_duplicates(df, seq, key=key).where("kept").drop("kept", "dup_type")
    bad = counts_over(out.where(F.col(key).isNotNull() & F.col("function").isNotNull()), [key, "function"], most).limit(3).collect()
    if bad:
        raise DataCheckError(f"too many rows of a function: {[tuple(r) for r in bad]}")
    return out


def one_per_function(df: DataFrame, functions: list[str], key: str = "assembly_id") -> DataFrame:
    """DD6: one row per (isolate, function), of isolates that have all ``functions``."""
    one = keep_first(df.where(F.col("function").isin(functions) & F.col(key).isNotNull()), [key, "function"], [F.col("file"), F.col("brc_fea_id"), F.col("prot_hash")])
    whole = one.groupBy(key).agg(F.count_distinct("function").alias("n")).where(F.col("n") == len(set(functions))).select(key)
    return one.join(whole, key, "left_semi")


def unique_sequences_from_pairs(pairs: DataFrame, col: str) -> DataFrame:
    """DD7: distinct non-null values of ``<col>_a`` and ``<col>_b``."""
    return pairs.select(F.explode(F.array(f"{col}_a", f"{col}_b")).alias(col)).where(F.col(col).isNotNull()).distinct()


def assign_segments(df: DataFrame, core: DataFrame, aux: DataFrame) -> DataFrame:
    """J7/DD8: ``canonical_segment`` by (replicon_type, function): the core map, where it has none the aux map.

    Both maps are small parameter tables (function, replicon_type, canonical_segment); the smallest segment counts.
    """
    one = lambda m, n: m.groupBy("function", "replicon_type").agg(F.min("canonical_segment").alias(n))
    out = df.drop("canonical_segment").join(one(core, "_core"), ["function", "replicon_type"], "left").join(one(aux, "_aux"), ["function", "replicon_type"], "left")
    return out.withColumn("canonical_segment", F.coalesce("_core", "_aux")).drop("_core", "_aux")


def replicon_segments(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Segment by replicon from a literal map; unknown ones are null."""
    m = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    return df.withColumn("canonical_segment", F.try_element_at(m, F.col("replicon_type")))


def duplicate_statistics(df: DataFrame, seq: str, key: str = "assembly_id") -> DataFrame:
    """DD5/A17 per duplicated sequence: occurrences, isolates, functions, files."""
    return (
        df.where(F.col(seq).isNotNull()).groupBy(F.col(seq).alias("seq"))
        .agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_isolates"), F.count_distinct("function").alias("n_functions"), F.count_distinct("file").alias("n_files"))
        .where("n_rows > 1")
    )


def contradictory_pairs(df: DataFrame, seq_hash: str, key: str = "assembly_id") -> DataFrame:
    """Duplicated sequences' pairs that share an isolate while each also has one without the other.

    Only sequences in two or more isolates can take part; their common isolates come from blocked pairs per isolate
    and a count, never from materialised sets.
    """
    one = df.where(F.col(seq_hash).isNotNull() & F.col(key).isNotNull()).select(F.col(seq_hash).alias("h"), F.col(key).alias("k")).distinct()
    n = one.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    common = pairs_within(skew_join(one, n.select("h"), "h"), "k", "h").groupBy("a", "b").agg(F.count("*").alias("n_common"))
    side = lambda s: n.select(F.col("h").alias(s), F.col("n").alias(f"n{s}"))
    both = skew_join(skew_join(materialize(common), side("a"), "a"), side("b"), "b").withColumnsRenamed({"a": "seq_a", "b": "seq_b"})
    return both.where("na > n_common and nb > n_common").select("seq_a", "seq_b", "n_common", (F.col("na") - F.col("n_common")).alias("only_a"), (F.col("nb") - F.col("n_common")).alias("only_b"))


def duplicate_cases(df: DataFrame, seq_hash: str, key: str = "assembly_id") -> DataFrame:
    """Duplicate groups by kind: 'case_1' several records in one assembly, 'case_2' one record each in several, 'other'."""
    g = df.where(F.col(seq_hash).isNotNull()).groupBy(F.col(seq_hash).alias("seq_hash")).agg(F.count_distinct(key).alias("n_assemblies"), F.count("*").alias("n_records")).where("n_records > 1")
    return g.withColumn("dup_case", F.when(F.col("n_assemblies") == 1, "case_1").when(F.col("n_assemblies") == F.col("n_records"), "case_2").otherwise("other"))
