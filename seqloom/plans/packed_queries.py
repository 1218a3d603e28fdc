"""Queries on fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.packed import accession_grammar, strain_grammar, unpack


def _both(spark: SparkSession, d: str, least: int) -> DataFrame:
    key = spark.read.parquet(f"{d}/flu_genomes_key.parquet")
    # a field that holds neither a quote nor a bracket nor a delimiter other than '/' holds one value, unless a strain's
    # start comes somewhere behind a '/'
    simple = r"(?s)\A(?!.*/.*(?:A/|Influenza A virus))[^;|,\t\n\r&+\"'\[{(<]*\z"
    names = unpack(key, "hash_id", "virus_name", strain_grammar, simple=simple if least > 1 else None, least_items=least)
    return names.unionByName(unpack(key, "hash_id", "seg_1", accession_grammar, simple=r"^[A-Za-z0-9.]+$", least_items=least))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of every virus_name or seg_1 that holds two or more."""
    return _both(spark, d, 2).select("hash_id", "field_name", "item_pos", "item_value").distinct()


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every virus_name and seg_1 with its kind and error flag."""
    return _both(spark, d, 1).distinct()


def queries():
    return {"p1_found": p1_found, "p1_values": p1_values}
