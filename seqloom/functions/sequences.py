"""Sequence functions (column expressions only, no Python in the row path)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import Name, _c

#: Complement pairs; letters not named stay (fixed values).
_COMPLEMENT_FROM, _COMPLEMENT_TO = "ATGCatgcRYKMBVDHUu", "TACGtacgYRMKVBHDAa"
#: Bases behind each ambiguity code (fixed values).
_IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
#: Standard genetic code, codons in TCAG order (fixed value).
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS_BASES = "NRYWSKMBDHV"


def reverse_complement(dna: Name) -> Column:
    """P6."""
    return F.reverse(F.translate(_c(dna), _COMPLEMENT_FROM, _COMPLEMENT_TO))


def parse_location(loc: Name) -> Column:
    """Text form of a nested list to an array of (ctg, start, strand, length); null if it isn't one.

    Null, empty lists, entries without four fields, starts below 1 and lengths of 0 or less give null.
    """
    raw = F.from_json(F.translate(_c(loc), "'()", '"[]'), "array<array<string>>")
    spans = F.transform(raw, lambda e: F.struct(F.get(e, F.lit(0)).alias("ctg"), F.get(e, F.lit(1)).try_cast("int").alias("start"), F.get(e, F.lit(2)).alias("strand"), F.get(e, F.lit(3)).try_cast("int").alias("length")))
    fine = (F.size(raw) > 0) & F.forall(raw, lambda e: F.size(e) == 4) & F.forall(spans, lambda s: F.coalesce((s["start"] >= 1) & (s["length"] > 0), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), spans)


def extract_cds(contig: Name, spans: Name) -> Column:
    """Exons in the order given, from one strand; reverse complement for '-'. Mixed strands and spans off the contig give null."""
    dna, x = _c(contig), _c(spans)
    one = F.size(F.array_distinct(F.transform(x, lambda s: s["strand"]))) == 1
    inside = F.forall(x, lambda s: s["start"] - 1 + s["length"] <= F.length(dna))
    cds = F.aggregate(x, F.lit(""), lambda acc, s: F.concat(acc, F.substring(dna, s["start"], s["length"])))
    return F.when(F.coalesce(one & inside, F.lit(False)), F.when(F.get(x, F.lit(0))["strand"] == "-", reverse_complement(cds)).otherwise(cds))


def cds_problem(contig: Name, spans: Name) -> Column:
    """Why ``extract_cds`` gives null: 'bad_location', 'no_contig', 'mixed_strands', 'off_contig' or null."""
    dna, x = _c(contig), _c(spans)
    return (
        F.when(x.isNull(), "bad_location")
        .when(dna.isNull(), "no_contig")
        .when(F.size(F.array_distinct(F.transform(x, lambda s: s["strand"]))) != 1, "mixed_strands")
        .when(~F.forall(x, lambda s: s["start"] - 1 + s["length"] <= F.length(dna)), "off_contig")
    )


def _codon_map() -> dict[str, str]:
    """All codons over the ambiguity codes whose expansions agree on one residue."""
    plain = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), _CODE))
    out = {}
    for codon in product(_IUPAC, repeat=3):
        got = {plain[a + b + c] for a in _IUPAC[codon[0]] for b in _IUPAC[codon[1]] for c in _IUPAC[codon[2]]}
        if len(got) == 1:
            out["".join(codon)] = got.pop()
    return out


def translate_dna(dna: Name) -> Column:
    """Residues by table 1; a codon whose readings disagree is X; a length that isn't a multiple of 3 gives null."""
    s = F.upper(_c(dna))
    table = F.from_json(F.lit("{" + ",".join(f'"{k}":"{v}"' for k, v in _codon_map().items()) + "}"), "map<string,string>")
    codons = F.transform(F.sequence(F.lit(0), F.greatest((F.length(s) / 3).cast("int") - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(table, F.substring(s, i * 3 + 1, F.lit(3))), F.lit("X")))
    return F.when(F.length(s) == 0, F.lit("")).when(F.length(s) % 3 == 0, F.array_join(codons, ""))


def cds_matches(prot: Name, cds: Name) -> Column:
    """P10: the translation equals the protein but for trailing stops; X on either side matches anything. Null if either is missing."""
    strip = lambda s: F.regexp_replace(s, r"\*+$", "")
    a, b = strip(translate_dna(cds)), strip(_c(prot))
    same = F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | (x == "X") | (y == "X")), lambda v: v)
    return F.when(a.isNotNull() & b.isNotNull(), (F.length(a) == F.length(b)) & same)


def dna_quality(dna: Name) -> Column:
    """(ambig_count, ambig_frac, length, gc_content); zeros for null and empty."""
    s = F.upper(F.coalesce(_c(dna), F.lit("")))
    n = F.length(s)
    count = lambda letters: F.length(F.regexp_replace(s, f"[^{letters}]", ""))
    share = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return F.struct(count(AMBIGUOUS_BASES).alias("ambig_count"), share(count(AMBIGUOUS_BASES)).alias("ambig_frac"), n.alias("length"), share(count("GC")).alias("gc_content"))


def protein_ambiguities(seq: Name) -> Column:
    """What isn't a standard residue, with 1-based positions; a stop at the very end isn't counted. Null gives empties."""
    s = F.upper(F.trim(F.coalesce(_c(seq), F.lit(""))))
    letters = F.filter(F.transform(F.split(s, ""), lambda x, i: F.struct(x.alias("r"), (i + 1).alias("p"))), lambda v: v["r"] != "")
    odd = F.filter(letters, lambda v: ~v["r"].isin(*STANDARD_RESIDUES))
    residues = F.filter(odd, lambda v: v["r"] != "*")
    inner = F.transform(F.filter(letters, lambda v: (v["r"] == "*") & (v["p"] < F.length(s))), lambda v: v["p"])
    stops = F.when(F.contains(s, F.lit("*")), inner).otherwise(F.array().cast("array<int>"))
    names = F.array_distinct(F.transform(residues, lambda v: v["r"]))
    where = F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(residues, lambda v: v["r"] == n), lambda v: v["p"])))
    return F.struct(
        ((F.size(names) > 0) | (F.size(stops) > 0)).alias("has_ambiguities"),
        names.alias("ambiguous_residues"),
        where.alias("ambiguity_positions"),
        F.length(F.translate(s, STANDARD_RESIDUES + "*", "")).alias("ambiguity_count"),
        s.endswith("*").alias("has_terminal_stop"),
        (F.size(stops) > 0).alias("has_internal_stop"),
        stops.alias("internal_stop_positions"),
    )


def summarize_ambiguities(df: DataFrame, seq: str) -> DataFrame:
    """One row of corpus totals; an empty table gives zeros and null percentages."""
    one = protein_ambiguities(seq)  # fields are taken one by one, so that the maps of positions are never built
    a = df.select(*[one[f].alias(f) for f in ("has_ambiguities", "ambiguity_count", "has_terminal_stop", "has_internal_stop")])
    pct = lambda c: F.round(F.try_divide(F.count_if(c) * 100, F.count("*")), 4)
    return a.agg(
        F.count("*").alias("total_seqs"),
        F.count_if("has_ambiguities").alias("seqs_with_ambiguities"),
        pct("has_ambiguities").alias("percent_seqs_with_ambiguities"),
        F.coalesce(F.sum("ambiguity_count"), F.lit(0)).alias("total_ambiguities"),
        F.count_if("has_terminal_stop").alias("terminal_stops"),
        F.count_if("has_internal_stop").alias("internal_stops"),
    )


def residue_counts(df: DataFrame, seq: str) -> DataFrame:
    """In how many sequences each ambiguous residue occurs."""
    return df.select(F.explode(protein_ambiguities(seq)["ambiguous_residues"]).alias("residue")).groupBy("residue").agg(F.count("*").alias("n_seqs"))


def model_ready(seq: Name, *, max_internal_stops: float = 0.1, max_x: float = 0.1, impute: str = "G", strip_terminal_stop: bool = True) -> Column:
    """(ready_seq, problem, x_count_ratio): the sequence as a model takes it, or why it can't be used.

    In order: empty; too many internal stops; stops become X; too many X; X imputed by 'G' or, with 'remove', refused;
    anything that still isn't a standard residue. Ratios are to the length without a terminal stop, to 4 digits.
    """
    s = F.upper(F.trim(F.coalesce(_c(seq), F.lit(""))))
    body = F.when(s.endswith("*"), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)
    n = F.length(body)
    stops = n - F.length(F.replace(body, F.lit("*"), F.lit("")))
    x = F.replace(body, F.lit("*"), F.lit("X"))
    x_count = n - F.length(F.replace(x, F.lit("X"), F.lit("")))
    ratio = lambda v: F.round(F.try_divide(v, n), 4)
    filled = F.replace(x, F.lit("X"), F.lit("G")) if impute == "G" else x
    tail = F.when(s.endswith("*") & F.lit(not strip_terminal_stop), F.lit("*")).otherwise(F.lit(""))
    problem = F.when(n <= 0, "empty").when(ratio(stops) > max_internal_stops, "internal_stops").when(ratio(x_count) > max_x, "too_many_x")
    if impute == "remove":
        problem = problem.when(x_count > 0, "has_x")
    problem = problem.when(filled.rlike(f"[^{STANDARD_RESIDUES}]"), "non_standard")
    return F.struct(F.when(problem.isNull(), F.concat(filled, tail)).alias("ready_seq"), problem.alias("problem"), F.coalesce(ratio(x_count), F.lit(0.0)).alias("x_count_ratio"))


def kmers(seq: Name, k: int, letters: str = "ACGT") -> Column:
    """V-1/V-2: all windows of ``k`` letters that are in the alphabet throughout, upper case; empty for shorter sequences and null."""
    s = F.upper(F.coalesce(_c(seq), F.lit("")))
    windows = F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.filter(windows, lambda w: w.rlike(f"^[{letters}]{{{k}}}$"))


def _kmer_codes(text: str, k: int, code: np.ndarray) -> np.ndarray:
    """The number of every window of ``k`` letters of the alphabet, in order; windows with another letter are left out."""
    c = code[np.frombuffer(text.upper().encode("latin-1", "replace"), np.uint8)]
    n = len(c) - k + 1
    if n < 1:
        return np.zeros(0, np.int64)
    base, out, ok = int(code.max()) + 1, np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        x = c[i : i + n]
        out = out * base + x
        ok &= x >= 0
    return out[ok]


def kmer_rows(df: DataFrame, key: str, seq: str, k: int, letters: str = "ACGT") -> DataFrame:
    """V-2 per row: (key, codes, counts), the numbers (base len(letters)) of its k-mers in rising order and how often each occurs.

    One Arrow batch at a time, a vectorised pass per sequence; nothing is shuffled. Null sequences have empty arrays.
    """
    code = np.full(256, -1, np.int64)
    code[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    kt = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(_kmer_codes(t or "", k, code), return_counts=True) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(c) for c, _ in got)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]).astype(np.int64))) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=[key, "codes", "counts"])

    return df.select(key, F.col(seq).alias("_seq")).mapInArrow(run, f"`{key}` {kt}, codes array<bigint>, counts array<bigint>")


def kmer_name(code: Name, k: int, letters: str = "ACGT") -> Column:
    """V-1: the k-mer behind a number."""
    c, n = _c(code), len(letters)
    return F.concat(*[F.element_at(F.array(*[F.lit(x) for x in letters]), (F.floor(c / n**i) % n + 1).cast("int")) for i in reversed(range(k))])


def kmer_counts(df: DataFrame, key: str, seq: str, k: int, letters: str = "ACGT") -> DataFrame:
    """V-2 in long form: (key, kmer, n); rows of one key are counted together."""
    one = kmer_rows(df, key, seq, k, letters).select(key, F.explode(F.arrays_zip("codes", "counts")).alias("z"))
    return one.groupBy(key, F.col("z.codes").alias("code")).agg(F.sum("z.counts").alias("n")).select(key, kmer_name("code", k, letters).alias("kmer"), "n")


def kmer_features(df: DataFrame, key: str, seq: str, k: int, *, letters: str = "ACGT", norm: str = "none") -> DataFrame:
    """V-3: one sparse row per sequence, ``features map<index, value>`` with index = the k-mer as a number of base len(letters).

    ``norm`` is none, l1 or l2; a key without k-mers has an empty map. Rows of one key are counted together, null keys
    are left out. Counts are made per row in Arrow batches, those of a key's rows are added up.
    """
    size = {"none": F.lit(1.0), "l1": F.sum("n").cast("double"), "l2": F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double"))}[norm]
    one = kmer_rows(df, key, seq, k, letters).select(key, F.explode(F.arrays_zip("codes", "counts")).alias("z"))
    g = one.groupBy(key, F.col("z.codes").alias("i")).agg(F.sum("z.counts").alias("n")).groupBy(key).agg(F.collect_list(F.struct("i", "n")).alias("l"), size.alias("size"))
    vec = g.select(key, F.map_from_entries(F.transform("l", lambda e: F.struct(e["i"], e["n"] / F.col("size")))).alias("features"))
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(vec, key, "left").withColumn("features", F.coalesce("features", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<double>"))))


def clean_dna(df: DataFrame, seq: str, max_ambig_frac: float) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): rows whose share of ambiguous bases is at most ``max_ambig_frac``, and the others with ``ambig_frac``. Null and empty sequences have share 0."""
    frac = dna_quality(seq)["ambig_frac"]
    return df.where(frac <= max_ambig_frac), df.where(frac > max_ambig_frac).withColumn("ambig_frac", frac)


def encode_codes(seq: Name, length: int, pad: int) -> Column:
    """The code points of the first ``length`` letters, filled up with ``pad``; two sides padded differently never match in padding. Null is all padding."""
    s = F.coalesce(_c(seq), F.lit(""))
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= F.length(s), F.ascii(F.substring(s, i, F.lit(1)))).otherwise(F.lit(pad)))


def kmer_store(df: DataFrame, key: str, seq: str, k: int, alphabet: str = "nt", letters: str | None = None) -> tuple[DataFrame, DataFrame]:
    """V-4: (index, matrix): ``index`` maps every ``key`` to a ``row_id``, ``matrix`` has (row_id, codes, counts) once per row.

    Proteins share a row by the md5 of their trimmed upper-case sequence, nucleotides have a row per occurrence. Null sequences have none.
    """
    src = df.where(F.col(seq).isNotNull())
    row = F.md5(F.upper(F.trim(seq))) if alphabet == "aa" else F.md5(F.concat_ws("|", F.col(key).cast("string"), F.md5(seq)))
    named = src.select(F.col(key), row.alias("row_id"), F.upper(F.trim(seq)).alias("seq"))
    one = named.groupBy("row_id").agg(F.min("seq").alias("seq"))
    return named.select(key, "row_id").distinct(), kmer_rows(one, "row_id", "seq", k, letters or (STANDARD_RESIDUES if alphabet == "aa" else "ACGT"))
