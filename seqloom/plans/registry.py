"""Queries with their SQL, collected by a decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``f(t)``, where ``t(name)`` is a table, under its name."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return wrap


def own_folder(spark: SparkSession) -> str:
    """A new folder beside the scratch tables, for round trips through files."""
    import uuid

    from ..scratch import scratch_dir

    return f"{scratch_dir(spark)}/seqloom-files-{uuid.uuid4().hex}"


class Tables:
    """Tables of one folder by name, and views that several queries share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def meta(self) -> DataFrame:
        """One row per isolate; of repeated rows the smallest non-null value of each column."""
        g = self("flu_genomes_metadata_parsed").groupBy(F.col("hash_id").alias("assembly_id")).agg(F.min("hn_subtype").alias("hn_subtype"), F.min("year").alias("year"), F.min("geo_location_raw").alias("geo_location_clean"))
        f = self("flu_first_seg_meta").groupBy(F.col("hash_id").alias("assembly_id")).agg(F.min("host_common_name").alias("host"), F.min("passage").alias("passage"))
        return g.join(f, "assembly_id", "left")

    def flagged(self) -> DataFrame:
        from ..functions.metadata import axis_flags

        return axis_flags(self("segment_pairs"), self.meta())

    def predictions(self) -> DataFrame:
        """Scored rows with heavy ties, from the line items: (label, pred_prob, pred_label, axes of both sides)."""
        li = self("lineitem")
        p = F.col("l_discount") * 10
        return li.select(
            "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("label"), p.alias("pred_prob"), (p > 0.5).cast("int").alias("pred_label"), "l_linestatus", "l_returnflag"
        )

    def clusters(self) -> DataFrame:
        """(hash, cluster_id): a tunable grouping of protein hashes."""
        return self("protein_final").where("prot_hash is not null").select(F.col("prot_hash").alias("hash")).distinct().withColumn("cluster_id", F.concat(F.lit("C_"), F.substring("hash", 1, 2)))

    def clustered(self) -> DataFrame:
        from ..operators.joins import attach_cluster_ids

        return attach_cluster_ids(self("segment_pairs"), self.clusters())


#: Shared SQL views with the same content.
META = """meta AS (SELECT g.assembly_id, f.host, g.hn_subtype, g.year, g.geo_location_clean, f.passage
FROM (SELECT hash_id AS assembly_id, min(hn_subtype) AS hn_subtype, min(year) AS year, min(geo_location_raw) AS geo_location_clean FROM flu_genomes_metadata_parsed GROUP BY 1) g
LEFT JOIN (SELECT hash_id AS assembly_id, min(host_common_name) AS host, min(passage) AS passage FROM flu_first_seg_meta GROUP BY 1) f USING (assembly_id))"""
FLAGGED = META + """, flagged AS (SELECT s.*, a.host AS host_a, b.host AS host_b, a.hn_subtype AS hn_subtype_a, b.hn_subtype AS hn_subtype_b, a.year AS year_a, b.year AS year_b,
a.host = b.host AS same_host, a.hn_subtype = b.hn_subtype AS same_hn_subtype, a.year = b.year AS same_year
FROM segment_pairs s LEFT JOIN meta a ON s.assembly_id_a = a.assembly_id LEFT JOIN meta b ON s.assembly_id_b = b.assembly_id)"""
PREDICTIONS = "predictions AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_returnflag = 'R')::INT AS label, l_discount * 10 AS pred_prob, (l_discount * 10 > 0.5)::INT AS pred_label, l_linestatus, l_returnflag FROM lineitem)"
CLUSTERS = "clusters AS (SELECT DISTINCT prot_hash AS hash, 'C_' || substr(prot_hash, 1, 2) AS cluster_id FROM protein_final WHERE prot_hash IS NOT NULL)"
CLUSTERED = CLUSTERS + ", clustered AS (SELECT s.*, a.cluster_id AS cluster_id_a, b.cluster_id AS cluster_id_b FROM segment_pairs s LEFT JOIN clusters a ON s.prot_hash_a = a.hash LEFT JOIN clusters b ON s.prot_hash_b = b.hash)"
