"""Readers: identifiers stay strings, schemas are declared, 'NA' is a value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..checks import unique_key
from ..functions.keys import assembly_parts, order_key, sequence_hash
from ..schema import ALPHABETS, GENOME_SCHEMA


def read_genomes(spark: SparkSession, path: str, *, max_files: int | None = None, seed: int | None = None) -> DataFrame:
    """One row per nested genome document, with ``file`` and the parts of its name.

    ``max_files`` keeps the first files by name, with ``seed`` those first in seeded hash order.
    """
    df = spark.read.schema(GENOME_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.gto").json(path)
    df = df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("_n", assembly_parts("file")).select("*", "_n.*").drop("_n")
    if max_files is not None:
        names = df.select("file").distinct().orderBy(*([order_key(seed, "file")] if seed is not None else []), "file").limit(max_files)
        df = df.join(names, "file", "left_semi")
    return df


def protein_rows(genomes: DataFrame) -> DataFrame:
    """One row per feature; unknown contigs are 'Unassigned', a missing family is null, no protein has length 0."""
    g = genomes.withColumn("_m", F.map_from_entries(F.transform(F.coalesce("contigs", F.from_json(F.lit("[]"), genomes.schema["contigs"].dataType)), lambda c: F.struct(c["id"], F.coalesce(c["replicon_type"], F.lit("Unassigned"))))))
    f = g.select("file", "assembly_prefix", "assembly_id", "ncbi_taxonomy_id", "genetic_code", "scientific_name", F.col("quality.genome_quality").alias("quality"), "_m", F.explode("features").alias("f"))
    ctg = F.get(F.get(F.col("f.location"), F.lit(0)), F.lit(0))
    return f.select(
        "file", "assembly_prefix", "assembly_id", "ncbi_taxonomy_id", "genetic_code", "scientific_name", "quality", F.col("f.id").alias("brc_fea_id"), F.col("f.type").alias("type"), F.col("f.function").alias("function"), F.col("f.protein_translation").alias("prot_seq"),
        F.col("f.location").alias("location"), F.col("f.feature_quality").alias("feature_quality"), F.coalesce(F.length("f.protein_translation"), F.lit(0)).alias("length"), ctg.alias("genbank_ctg_id"),
        F.coalesce(F.try_element_at("_m", ctg), F.lit("Unassigned")).alias("replicon_type"), F.get(F.get(F.col("f.family_assignments"), F.lit(0)), F.lit(1)).alias("family"),
    )


def contig_rows(genomes: DataFrame) -> DataFrame:
    """One row per contig."""
    c = genomes.select("assembly_id", "file", F.col("quality.genome_quality").alias("quality"), F.explode("contigs").alias("c"))
    return c.select("assembly_id", "file", "quality", F.col("c.id").alias("genbank_ctg_id"), F.coalesce("c.replicon_type", F.lit("Unassigned")).alias("replicon_type"), F.col("c.contig_quality").alias("contig_quality"), F.col("c.dna").alias("ctg_dna_seq"))


def _tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(path, sep="\t", header=False, nullValue="")


def read_isolate_key(spark: SparkSession, path: str, n_segments: int = 8) -> DataFrame:
    """Headerless, all strings, ``seg_1`` to ``seg_n``."""
    return _tsv(spark, path, ["hash_id", "virus_name", "hn_subtype", *[f"seg_{i}" for i in range(1, n_segments + 1)]])


def read_first_segment_meta(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return _tsv(spark, path, ["hash_id", "virus_name", "hn_subtype", "first_seg_id", "host_common_name", "lab_host", "passage"])


def read_table(spark: SparkSession, stem: str, schema: str | None = None) -> DataFrame:
    """``stem``.parquet, else ``stem``.csv (all strings unless a schema is given), else an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda p: (lambda q: q.getFileSystem(conf).exists(q))(jvm.org.apache.hadoop.fs.Path(p))
    if there(f"{stem}.parquet"):
        return spark.read.parquet(f"{stem}.parquet")
    if there(f"{stem}.csv"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.csv(f"{stem}.csv", header=True, nullValue="")
    raise FileNotFoundError(stem)


def isolate_metadata(raw: DataFrame) -> DataFrame:
    """Key renamed, years whole numbers or null, 'nan' and blanks null."""
    clean = lambda c: F.nullif(F.nullif(F.trim(F.col(c).cast("string")), F.lit("nan")), F.lit(""))
    cols = [clean(c).alias(c) for c in raw.columns if c not in ("hash_id", "year")]
    return raw.select(F.col("hash_id").alias("assembly_id"), *cols, F.col("year").cast("string").try_cast("double").cast("int").alias("year"))


def read_sequences(df: DataFrame, alphabet: str) -> DataFrame:
    """Pruned (hash, seq, function, assembly_id); the hash is computed where the column is missing or null."""
    a = ALPHABETS[alphabet]
    h = F.coalesce(F.col(a.hash_col), sequence_hash(a.seq_col)) if a.hash_col in df.columns else sequence_hash(a.seq_col)
    return df.where(F.col(a.seq_col).isNotNull()).select(h.alias("hash"), F.col(a.seq_col).alias("seq"), "function", "assembly_id")


def cluster_lookup(df: DataFrame) -> DataFrame:
    """Exactly one known hash column, renamed ``hash``, unique."""
    names = [c for c in df.columns if c in {"hash", *(a.hash_col for a in ALPHABETS.values())}]
    if len(names) != 1:
        raise ValueError(f"a cluster lookup needs one hash column, not {names}")
    return unique_key(df.withColumnRenamed(names[0], "hash"), "hash")


def cluster_map(membership: DataFrame, function: str, threshold: str) -> DataFrame:
    """(hash, cluster_id) of one function at one threshold from the wide membership table."""
    return membership.where((F.col("function") == function) & F.col(threshold).isNotNull()).select("hash", F.col(threshold).alias("cluster_id")).distinct()


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Similarity hits; ids stay strings."""
    return spark.read.schema("query string, target string, fident double, qcov double, tcov double").csv(path, sep="\t")


def clusters_from_pairs(df: DataFrame, prefix: str) -> DataFrame:
    """(representative, member, ord) to (hash, cluster_rep, cluster_id), numbered by the representative's first appearance; members must be unique."""
    unique_key(df, "member")
    first = df.groupBy("rep").agg(F.min("ord").alias("f"))
    ids = first.withColumn("cluster_id", F.concat(F.lit(f"{prefix}_"), F.row_number().over(W.orderBy("f", "rep")) - 1))  # one row per cluster
    return df.join(ids.select("rep", "cluster_id"), "rep").select(F.col("member").alias("hash"), F.col("rep").alias("cluster_rep"), "cluster_id")


def read_fasta_names(spark: SparkSession, path: str) -> DataFrame:
    """Header lines without '>'."""
    return spark.read.text(path).where(F.col("value").startswith(">")).select(F.trim(F.expr("substring(value, 2)")).alias("hash"))


def read_kmers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, matrix) as ``sinks.write_kmers`` stored them."""
    return spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/matrix")


def vectors_by_id(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Vectors of the keys that have one; of repeats the smallest row_idx."""
    one = store.groupBy(*on).agg(F.min_by("emb", "row_idx").alias("emb"))
    return keys.join(one, on)


def read_pairs_csv(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """The named columns as strings, only the empty field null."""
    return spark.read.csv(path, header=True, nullValue="").select(*cols)
