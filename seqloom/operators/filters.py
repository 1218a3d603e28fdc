"""Filters that keep what the rule doesn't name: a null is no reason to drop a row unless a rule says so."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import h_part, is_full_subtype, n_part

#: Axes of a metadata filter and of a holdout (fixed values); only years have an order.
FILTER_AXES = ("hn_subtype", "host", "year", "geo_location_clean", "passage")
ORDERED_AXES = ("year",)


def tag_rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reject_reason``, the first of the ordered ``rules`` a row breaks (null: kept).

    A rule is a condition that is true for rows to drop; null counts as false. One pass over the rows, and
    ``where reject_reason is null`` still pushes down.
    """
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(rules.items())):
        reason = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def protein_rules() -> dict[str, Column]:
    """unassigned segment, not a CDS, poor quality of genome or feature, unassigned replicon."""
    return {
        "unassigned_segment": F.col("canonical_segment").isNull(),
        "not_cds": ~F.col("type").eqNullSafe("CDS"),
        "poor_quality": F.col("quality").eqNullSafe("Poor") | F.col("feature_quality").eqNullSafe("Poor"),
        "unassigned_replicon": F.col("replicon_type").eqNullSafe("Unassigned"),
    }


def genome_rules() -> dict[str, Column]:
    """unassigned segment, poor quality of genome or contig, unassigned replicon, no sequence."""
    return {
        "unassigned_segment": F.col("canonical_segment").isNull(),
        "poor_quality": F.col("quality").eqNullSafe("Poor") | F.col("contig_quality").eqNullSafe("Poor"),
        "unassigned_replicon": F.col("replicon_type").eqNullSafe("Unassigned"),
        "missing_sequence": F.col("ctg_dna_seq").isNull(),
    }


def basic_rules() -> dict[str, Column]:
    """the second family's rules: unassigned segment, poor genome, unassigned replicon, no protein."""
    return {
        "unassigned_segment": F.col("canonical_segment").isNull(),
        "poor_quality": F.col("quality").eqNullSafe("Poor"),
        "unassigned_replicon": F.col("replicon_type").eqNullSafe("Unassigned"),
        "missing_sequence": F.col("prot_seq").isNull(),
    }


def keep(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break no rule."""
    return tag_rejects(df, rules).where("reject_reason is null").drop("reject_reason")


def reject_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(reject_reason, n) with 'kept' for the rest."""
    return tag_rejects(df, rules).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reject_reason")).agg(F.count("*").alias("n"))


def narrow(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """set membership; reaches the parquet scan."""
    return df.where(F.col(col).isin(values))


def per_isolate(df: DataFrame, axes: list[str], key: str = "assembly_id") -> DataFrame:
    """One row per isolate with the smallest non-null value of each axis (the defined 'first')."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(a).alias(a) for a in axes])


def validate_spec(spec: Mapping[str, object]) -> None:
    """F8: only known axes; ranges on ordered axes only, with two ends; a value and a range of one axis exclude each other; no empty lists."""
    for name, value in spec.items():
        axis = name.removesuffix("_range")
        if axis not in FILTER_AXES:
            raise ValueError(f"unknown axis {name}")
        if name.endswith("_range"):
            if axis not in ORDERED_AXES:
                raise ValueError(f"{axis} has no order")
            if axis in spec:
                raise ValueError(f"{axis} and {name} exclude each other")
            if not isinstance(value, (list, tuple)) or len(value) != 2 or value[0] > value[1]:
                raise ValueError(f"{name} needs two ends in order")
        elif isinstance(value, (list, tuple, set)) and not value:
            raise ValueError(f"{name} is an empty list")


def spec_condition(spec: Mapping[str, object]) -> Column:
    """a scalar means equality, a list membership, a range both ends included; null never matches; an empty spec is true."""
    validate_spec(spec)
    parts = []
    for name, value in spec.items():
        c = F.col(name.removesuffix("_range"))
        parts.append(c.between(*value) if name.endswith("_range") else c.isin(sorted(value)) if isinstance(value, (list, tuple, set)) else c == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def matching_isolates(df: DataFrame, spec: Mapping[str, object], key: str = "assembly_id") -> DataFrame:
    """isolates whose one value per axis fulfils the spec."""
    axes = sorted({n.removesuffix("_range") for n in spec})
    ids = per_isolate(df, axes, key) if axes else df.where(F.col(key).isNotNull()).select(key).distinct()
    return ids.where(spec_condition(spec)).select(key)


def filter_by_metadata(df: DataFrame, spec: Mapping[str, object], key: str = "assembly_id") -> DataFrame:
    """decides per isolate and keeps all rows of those that pass."""
    return df if not spec else df.join(matching_isolates(df, spec, key), key, "left_semi")


def drop_ambiguous_subtype(df: DataFrame, key: str = "assembly_id", col: str = "hn_subtype") -> tuple[DataFrame, DataFrame]:
    """(kept rows, tally of what was dropped per value): isolates without a full HxNy subtype go."""
    one = per_isolate(df, [col], key)
    good = one.where(is_full_subtype(col)).select(key)
    tally = one.where(~is_full_subtype(col)).groupBy(F.coalesce(F.col(col), F.lit("<null>")).alias("value")).agg(F.count("*").alias("n_isolates"))
    return df.join(good, key, "left_semi"), tally


def cluster_attach_drops(attached: DataFrame) -> DataFrame:
    """counts of pairs without a cluster on side a, on side b, on both, and with both."""
    a, b = F.col("cluster_id_a").isNull(), F.col("cluster_id_b").isNull()
    return attached.agg(F.count_if(a & ~b).alias("missing_a"), F.count_if(~a & b).alias("missing_b"), F.count_if(a & b).alias("missing_both"), F.count_if(~a & ~b).alias("kept"))


def within_cross(axis: str) -> tuple[Column, Column]:
    """(both sides known and equal, both known and different); 'unknown' and null are in neither."""
    known = lambda s: F.coalesce(F.col(f"{axis}_{s}").cast("string") != "unknown", F.lit(False))
    both = known("a") & known("b")
    return both & (F.col(f"{axis}_a") == F.col(f"{axis}_b")), both & (F.col(f"{axis}_a") != F.col(f"{axis}_b"))


def uncertain(prob: str = "pred_prob", width: float = 0.1) -> Column:
    """F11."""
    return F.abs(F.col(prob) - 0.5) < width


def errors(df: DataFrame, kind: str, label: str = "label", pred: str = "pred_label") -> DataFrame:
    """'fp' or 'fn' rows."""
    return df.where((F.col(label) == (0 if kind == "fp" else 1)) & (F.col(pred) == (1 if kind == "fp" else 0)))


def multi_subtype_sequences(df: DataFrame, seq_hash: str, subtype: str, part: str = "h") -> DataFrame:
    """sequences seen with more than one H (or N) part, with the sorted parts."""
    p = (h_part if part == "h" else n_part)(subtype)
    return (
        df.select(F.col(seq_hash).alias("seq_hash"), p.alias("p")).where("seq_hash is not null and p is not null")
        .groupBy("seq_hash").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("parts"), F.count_distinct("p").alias("n_parts"), F.count("*").alias("n_rows"))
        .where("n_parts > 1")
    )
