"""Column contracts shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pair table, in order (fixed values): every name with a slot suffix stands for both slots.
_PAIR = "pair_key assembly_id_a assembly_id_b brc_a brc_b ctg_a ctg_b prot_seq_a prot_seq_b ctg_dna_seq_a ctg_dna_seq_b seg_a seg_b func_a func_b prot_hash_a prot_hash_b ctg_dna_hash_a ctg_dna_hash_b cds_dna_hash_a cds_dna_hash_b"
PAIR_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _PAIR.split()]
    + [T.StructField("label", T.IntegerType()), T.StructField("neg_regime", T.StringType()), T.StructField("metadata_match_count", T.IntegerType())]
)

#: Nested genome document: identifiers stay strings.
GENOME_SCHEMA = """ncbi_taxonomy_id BIGINT, genetic_code INT, scientific_name STRING, quality STRUCT<genome_quality: STRING>,
contigs ARRAY<STRUCT<id: STRING, replicon_type: STRING, contig_quality: STRING, dna: STRING>>,
features ARRAY<STRUCT<id: STRING, type: STRING, `function`: STRING, protein_translation: STRING, location: ARRAY<ARRAY<STRING>>, feature_quality: STRING, family_assignments: ARRAY<ARRAY<STRING>>>>"""


@dataclass(frozen=True)
class Alphabet:
    """Names that belong to one kind of sequence."""

    name: str
    seq_col: str
    hash_col: str
    occurrence_col: str
    table: str


ALPHABETS = {
    a.name: a
    for a in (
        Alphabet("aa", "prot_seq", "prot_hash", "brc_fea_id", "protein_final"),
        Alphabet("nt_cds", "cds_dna_seq", "cds_dna_hash", "brc_fea_id", "cds_dna_final"),
        Alphabet("nt_ctg", "ctg_dna_seq", "ctg_dna_hash", "genbank_ctg_id", "ctg_dna_final"),
    )
}

#: Metadata axes and the names of the eight combinations of matching ones (fixed values).
AXES = ("host", "hn_subtype", "year")
REGIMES = ("none_match", "host_only", "subtype_only", "year_only", "host_subtype_only", "host_year_only", "subtype_year_only", "host_subtype_year")
#: From the hardest to the easiest (fixed values).
REGIME_CHAIN = ("host_subtype_year", "subtype_year_only", "host_year_only", "host_subtype_only", "year_only", "subtype_only", "host_only", "none_match")
#: Inclusive year bins (fixed values); None is open.
YEAR_BINS = ((None, 2015, "<=2015"), (2016, 2020, "2016-2020"), (2021, None, "2021+"))


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
