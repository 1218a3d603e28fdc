"""Queries on keys, sequences and metadata functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import metadata as M
from ..functions import sequences as S
from ..sources.readers import read_sequences
from .registry import FLAGGED, META, query

_GENES = "TCAG"
_PLAIN = ", ".join(f"'{''.join(c)}': '{r}'" for c, r in zip(product(_GENES, repeat=3), S._CODE))
_LONG = "SELECT s.pair_row_id, v.* FROM segment_pairs s, (VALUES ('a'), ('b')) x(side), LATERAL (SELECT side, CASE side WHEN 'a' THEN s.brc_a ELSE s.brc_b END AS brc, CASE side WHEN 'a' THEN s.ctg_dna_seq_a ELSE s.ctg_dna_seq_b END AS dna, CASE side WHEN 'a' THEN s.prot_seq_a ELSE s.prot_seq_b END AS prot) v"
_SPAN = r"""spans AS (SELECT brc_fea_id AS brc, min(location) AS location, regexp_extract(min(location), '''(\d+)'', ''([+-])'', ''(\d+)''', ['start', 'strand', 'length']) AS l FROM protein_final WHERE location IS NOT NULL GROUP BY 1)"""


def _contigs(t):
    """Contig and location of every pair side."""
    s = t("segment_pairs")
    sides = s.select("pair_row_id", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"brc_{x}").alias("brc"), F.col(f"ctg_dna_seq_{x}").alias("dna"), F.col(f"prot_seq_{x}").alias("prot")) for x in "ab"])).alias("v")).select("pair_row_id", "v.*")
    loc = t("protein_final").where("location is not null").groupBy(F.col("brc_fea_id").alias("brc")).agg(F.min("location").alias("location"))
    return sides.join(loc, "brc", "left").withColumn("spans", S.parse_location("location"))


_CDS_SQL = f"""WITH {_SPAN}, sides AS ({_LONG}), cds AS (SELECT d.pair_row_id, d.side, d.dna, d.prot, p.l,
CASE WHEN p.l.start::INT - 1 + p.l.length::INT <= length(d.dna) THEN CASE p.l.strand WHEN '-' THEN reverse(translate(substr(d.dna, p.l.start::INT, p.l.length::INT), 'ATGCatgcRYKMBVDHUu', 'TACGtacgYRMKVBHDAa')) ELSE substr(d.dna, p.l.start::INT, p.l.length::INT) END END AS cds
FROM sides d LEFT JOIN spans p USING (brc))"""


@query("SELECT pair_row_id, CASE WHEN prot_hash_a IS NOT NULL AND prot_hash_b IS NOT NULL THEN least(prot_hash_a, prot_hash_b) || '__' || greatest(prot_hash_a, prot_hash_b) END AS key, CASE WHEN prot_hash_a IS NOT NULL AND prot_hash_b IS NOT NULL THEN pair_key = least(prot_hash_a, prot_hash_b) || '__' || greatest(prot_hash_a, prot_hash_b) END AS is_canonical FROM segment_pairs")
def pair_keys(t):
    k = K.pair_key("prot_hash_a", "prot_hash_b")
    return t("segment_pairs").select("pair_row_id", k.alias("key"), (F.col("pair_key") == k).alias("is_canonical"))


@query("SELECT count(*) AS n_rows, count_if(md5(prot_seq) = prot_hash) AS n_equal, count_if(md5(prot_seq) <> prot_hash) AS n_stale, count(DISTINCT md5(prot_seq)) AS n_hashes FROM protein_final")
def sequence_hashes(t):
    h = K.sequence_hash("prot_seq")
    return t("protein_final").agg(F.count("*").alias("n_rows"), F.count_if(h == F.col("prot_hash")).alias("n_equal"), F.count_if(h != F.col("prot_hash")).alias("n_stale"), F.count_distinct(h).alias("n_hashes"))


@query("SELECT coalesce(prot_hash, md5(prot_seq)) AS hash, regexp_replace(prot_seq, '\\*+$', '') AS seq, function, assembly_id FROM protein_final WHERE prot_seq IS NOT NULL")
def sequence_frame(t):
    return read_sequences(t("protein_final"), "aa").withColumn("seq", K.clustering_sequence("seq"))


@query("SELECT file, nullif(regexp_extract(file, '(GCA|GCF)_(\\d+\\.\\d+)', 1), '') AS assembly_prefix, coalesce(nullif(regexp_extract(file, '(GCA|GCF)_(\\d+\\.\\d+)', 2), ''), nullif(regexp_extract(file, '^(\\w+)\\.gto', 1), '')) AS assembly_id FROM (SELECT DISTINCT file FROM protein_final)")
def assembly_names(t):
    return t("protein_final").select("file").distinct().select("file", K.assembly_parts("file").alias("p")).select("file", "p.*")


@query("SELECT pair_row_id, reverse(translate(ctg_dna_seq_a, 'ATGCatgcRYKMBVDHUu', 'TACGtacgYRMKVBHDAa')) AS rc_a, reverse(translate(ctg_dna_seq_b, 'ATGCatgcRYKMBVDHUu', 'TACGtacgYRMKVBHDAa')) AS rc_b FROM segment_pairs")
def reverse_complements(t):
    return t("segment_pairs").select("pair_row_id", *[S.reverse_complement(f"ctg_dna_seq_{x}").alias(f"rc_{x}") for x in "ab"])


@query(f"WITH {_SPAN} SELECT brc, l.start::INT AS start, l.strand AS strand, l.length::INT AS length FROM spans")
def locations(t):
    loc = t("protein_final").where("location is not null").groupBy(F.col("brc_fea_id").alias("brc")).agg(F.min("location").alias("location"))
    return loc.select("brc", F.explode(S.parse_location("location")).alias("s")).select("brc", "s.start", "s.strand", "s.length")


@query(_CDS_SQL + " SELECT pair_row_id, side, cds, md5(cds) AS cds_hash FROM cds")
def coding_sequences(t):
    return _contigs(t).select("pair_row_id", "side", S.extract_cds("dna", "spans").alias("cds")).withColumn("cds_hash", K.sequence_hash("cds"))


_AA = "CASE WHEN length(cds) % 3 = 0 THEN list_aggregate(list_transform(range(0, (length(cds) // 3)::BIGINT), lambda i: coalesce(MAP {" + _PLAIN + "}[substr(upper(cds), (i * 3 + 1)::BIGINT, 3)], 'X')), 'string_agg', '') END"


@query(_CDS_SQL + f" SELECT pair_row_id, side, {_AA} AS protein, regexp_replace({_AA}, '\\*+$', '') = regexp_replace(prot, '\\*+$', '') AS matches FROM cds")
def translations(t):
    c = _contigs(t).withColumn("cds", S.extract_cds("dna", "spans"))
    return c.select("pair_row_id", "side", S.translate_dna("cds").alias("protein"), S.cds_matches("prot", "cds").alias("matches"))


@query(_CDS_SQL + " SELECT CASE WHEN l IS NULL THEN 'bad_location' WHEN dna IS NULL THEN 'no_contig' WHEN cds IS NULL THEN 'off_contig' ELSE 'fine' END AS outcome, count(*) AS n FROM cds GROUP BY 1")
def cds_outcomes(t):
    return _contigs(t).groupBy(F.coalesce(S.cds_problem("dna", "spans"), F.lit("fine")).alias("outcome")).agg(F.count("*").alias("n"))


_DNA = "upper(coalesce(dna, ''))"


@query(f"""SELECT pair_row_id, length(regexp_replace({_DNA}, '[^NRYWSKMBDHV]', '', 'g')) AS ambig_count, CASE WHEN length({_DNA}) > 0 THEN length(regexp_replace({_DNA}, '[^NRYWSKMBDHV]', '', 'g')) / length({_DNA}) ELSE 0.0 END AS ambig_frac,
length({_DNA}) AS length, CASE WHEN length({_DNA}) > 0 THEN length(regexp_replace({_DNA}, '[^GC]', '', 'g')) / length({_DNA}) ELSE 0.0 END AS gc_content FROM (SELECT pair_row_id, ctg_dna_seq_a AS dna FROM segment_pairs UNION ALL SELECT pair_row_id, ctg_dna_seq_b FROM segment_pairs)""")
def dna_qualities(t):
    return _dnas(t).select("pair_row_id", S.dna_quality("dna").alias("q")).select("pair_row_id", "q.*")


_ODD = "list_filter(list_transform(range(1, length(s) + 1), lambda i: {'r': substr(s, i::BIGINT, 1), 'p': i::INT}), lambda v: NOT contains('ACDEFGHIKLMNPQRSTVWY', v.r))"


@query(f"""WITH x AS (SELECT doc_id, upper(replace(trim(coalesce(text, ''), ' '), 'ß', 'SS')) AS s FROM documents), o AS (SELECT doc_id, s, {_ODD} AS odd FROM x)
SELECT doc_id, length(list_filter(odd, lambda v: v.r <> '*')) AS ambiguity_count, ends_with(s, '*') AS has_terminal_stop, length(list_filter(odd, lambda v: v.r = '*' AND v.p < length(s))) AS n_internal_stops FROM o""")
def residue_ambiguities(t):
    """Whole documents as sequences: every letter that isn't a residue counts."""
    a = S.protein_ambiguities("text")  # fields are taken one by one, so that the maps of positions are never built
    return t("documents").select("doc_id", a["ambiguity_count"].alias("ambiguity_count"), a["has_terminal_stop"].alias("has_terminal_stop"), F.size(a["internal_stop_positions"]).alias("n_internal_stops"))


@query("""WITH x AS (SELECT upper(replace(trim(coalesce(text, ''), ' '), 'ß', 'SS')) AS s FROM documents), y AS (SELECT s, regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY*]', '', 'g') AS odd, length(replace(s[:length(s) - 1], '*', '')) < length(s) - 1 AS inner_stop FROM x)
SELECT count(*) AS total_seqs, count_if(length(odd) > 0 OR inner_stop) AS seqs_with_ambiguities, round(count_if(length(odd) > 0 OR inner_stop) * 100 / count(*), 4) AS percent_seqs_with_ambiguities, sum(length(odd))::BIGINT AS total_ambiguities, count_if(ends_with(s, '*')) AS terminal_stops, count_if(length(s) > 0 AND inner_stop) AS internal_stops FROM y""")
def ambiguity_summary(t):
    return S.summarize_ambiguities(t("documents"), "text")


@query("""WITH p AS (SELECT brc_fea_id, file, row_number() OVER () AS i, CASE brc_fea_id[-1:] WHEN '1' THEN prot_seq || '*' WHEN '2' THEN replace(prot_seq, 'A', '*') WHEN '3' THEN replace(prot_seq, 'C', 'X') WHEN '4' THEN replace(prot_seq, 'W', 'B') WHEN '5' THEN replace(prot_seq, 'MA', 'M*') ELSE prot_seq END AS q FROM protein_final),
a AS (SELECT *, upper(trim(coalesce(q, ''), ' ')) AS s FROM p), b AS (SELECT *, CASE WHEN ends_with(s, '*') THEN s[:length(s) - 1] ELSE s END AS body FROM a),
c AS (SELECT *, length(body) AS n, length(body) - length(replace(body, '*', '')) AS st, replace(body, '*', 'X') AS x FROM b), d AS (SELECT *, round(st / nullif(n, 0), 4) AS rs, round((n - length(replace(x, 'X', ''))) / nullif(n, 0), 4) AS rx, replace(x, 'X', 'G') AS filled FROM c),
e AS (SELECT *, CASE WHEN n <= 0 THEN 'empty' WHEN rs > 0.1 THEN 'internal_stops' WHEN rx > 0.1 THEN 'too_many_x' WHEN regexp_matches(filled, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'non_standard' END AS problem FROM d) SELECT brc_fea_id, file, CASE WHEN problem IS NULL THEN filled END AS ready_seq, problem, coalesce(rx, 0.0) AS x_count_ratio FROM e""")
def model_sequences(t):
    """P15 on proteins that get stops, X and odd letters by the last digit of their feature."""
    end, q = F.substring("brc_fea_id", -1, 1), F.col("prot_seq")
    r = lambda a, b: F.replace(q, F.lit(a), F.lit(b))
    dirty = F.when(end == "1", F.concat(q, F.lit("*"))).when(end == "2", r("A", "*")).when(end == "3", r("C", "X")).when(end == "4", r("W", "B")).when(end == "5", r("MA", "M*")).otherwise(q)
    return t("protein_final").select("brc_fea_id", "file", S.model_ready(dirty).alias("m")).select("brc_fea_id", "file", "m.*")


_DNAS = "SELECT pair_row_id, ctg_dna_seq_a AS dna FROM segment_pairs UNION ALL SELECT pair_row_id, ctg_dna_seq_b FROM segment_pairs"
_K = f"SELECT pair_row_id, unnest(list_filter(list_transform(range(1, length(dna) - 2), lambda i: upper(substr(dna, i::BIGINT, 4))), lambda w: regexp_full_match(w, '[ACGT]{{4}}'))) AS kmer FROM ({_DNAS})"


def _dnas(t):
    """Contigs of both sides of every pair."""
    s = t("segment_pairs")
    return s.select("pair_row_id", F.explode(F.array("ctg_dna_seq_a", "ctg_dna_seq_b")).alias("dna"))


@query(f"WITH k AS ({_K}) SELECT kmer, count(*) AS n, count(DISTINCT pair_row_id) AS n_rows FROM k GROUP BY 1")
def kmer_totals(t):
    return S.kmer_counts(_dnas(t), "pair_row_id", "dna", 4).groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"))


@query(f"WITH k AS ({_K}), n AS (SELECT pair_row_id, kmer, count(*) AS n FROM k GROUP BY ALL) SELECT pair_row_id, list_sum(list_transform(range(0, 4), lambda j: (strpos('ACGT', substr(kmer, (j + 1)::BIGINT, 1)) - 1) * (4 ** (3 - j))))::BIGINT AS code, n / sqrt(sum(n * n) OVER (PARTITION BY pair_row_id)) AS value FROM n")
def kmer_vectors(t):
    f = S.kmer_features(_dnas(t), "pair_row_id", "dna", 4, norm="l2")
    return f.select("pair_row_id", F.explode("features").alias("code", "value"))


@query("SELECT hn_subtype, count(*) AS n, nullif(regexp_extract(hn_subtype, '^(H\\d+)', 1), '') AS h, nullif(regexp_extract(hn_subtype, '^(?:H\\d+)?(N\\d+)$', 1), '') AS n_part, CASE WHEN regexp_full_match(hn_subtype, 'H\\d+N\\d+') THEN hn_subtype ELSE 'unknown' END AS canonical FROM flu_genomes_key GROUP BY hn_subtype")
def subtype_parts(t):
    g = t("flu_genomes_key").groupBy("hn_subtype").agg(F.count("*").alias("n"))
    return g.select("hn_subtype", "n", K.h_part("hn_subtype").alias("h"), K.n_part("hn_subtype").alias("n_part"), K.canonical_subtype("hn_subtype").alias("canonical"))


@query("SELECT fident, 't' || lpad(CAST(round_even(fident * 100, 0) AS INT)::VARCHAR, 3, '0') AS label, CAST(round_even(fident * 100, 0) AS INT) / 100 AS back FROM (SELECT DISTINCT fident FROM cluster_pair_edges WHERE fident IS NOT NULL)")
def threshold_labels(t):
    d = t("cluster_pair_edges").select("fident").where("fident is not null").distinct().withColumn("label", K.threshold_label("fident"))
    return d.withColumn("back", K.threshold_value("label"))


_BIN = "CASE WHEN year <= 2015 THEN '<=2015' WHEN year BETWEEN 2016 AND 2020 THEN '2016-2020' WHEN year >= 2021 THEN '2021+' END"


@query(f"WITH {META} SELECT host, hn_subtype, {_BIN} AS year, count(*) AS n FROM meta GROUP BY ALL")
def metadata_cells(t):
    return M.isolate_cells(t.meta()).groupBy("cell").agg(F.count("*").alias("n")).select("cell.*", "n")


_MATCH = "coalesce(a.host = b.host, false)::INT, coalesce(a.hn_subtype = b.hn_subtype, false)::INT, coalesce(a.y = b.y, false)::INT"
_REGIME = "['none_match','year_only','subtype_only','subtype_year_only','host_only','host_year_only','host_subtype_only','host_subtype_year'][1 + 4 * coalesce(a.host = b.host, false)::INT + 2 * coalesce(a.hn_subtype = b.hn_subtype, false)::INT + coalesce(a.y = b.y, false)::INT]"


@query(f"""WITH {META}, c AS (SELECT assembly_id, host, hn_subtype, {_BIN} AS y FROM meta)
SELECT s.pair_row_id, {_REGIME} AS regime, coalesce(a.host = b.host, false)::INT + coalesce(a.hn_subtype = b.hn_subtype, false)::INT + coalesce(a.y = b.y, false)::INT AS match_count,
CASE WHEN label = 1 THEN 'positive' ELSE coalesce(neg_regime, {_REGIME}) END AS neg_regime FROM segment_pairs s JOIN c a ON s.assembly_id_a = a.assembly_id JOIN c b ON s.assembly_id_b = b.assembly_id""")
def pair_regimes(t):
    c = M.isolate_cells(t.meta())
    s = t("segment_pairs")
    for x in "ab":
        s = s.join(c.select(F.col("assembly_id").alias(f"assembly_id_{x}"), F.col("cell").alias(f"c{x}")), f"assembly_id_{x}")
    s = s.withColumn("regime", M.regime("ca", "cb"))
    return s.select("pair_row_id", "regime", M.match_count("ca", "cb").alias("match_count"), M.stored_or_derived_regime("label", "neg_regime", "regime").alias("neg_regime"))


@query(f"WITH {FLAGGED} SELECT pair_row_id, host_a, host_b, same_host, hn_subtype_a, hn_subtype_b, same_hn_subtype, year_a, year_b, same_year FROM flagged")
def axis_flags(t):
    return t.flagged().select("pair_row_id", *[c for a in ("host", "hn_subtype", "year") for c in (f"{a}_a", f"{a}_b", f"same_{a}")])


@query()
def parsed_names(t):
    return M.parse_names(t("flu_genomes_key"), "hash_id", "virus_name")


_TITLE = "list_aggregate(list_transform(range(1, length(h) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(h, (i - 1)::BIGINT, 1), '\\p{L}') THEN upper(substr(h, i::BIGINT, 1)) ELSE substr(h, i::BIGINT, 1) END), 'string_agg', '')"


@query(f"WITH d AS (SELECT DISTINCT host_common_name, trim(host_common_name, ' ') AS h FROM flu_first_seg_meta) SELECT host_common_name, CASE WHEN h = '' OR lower(h) = 'null' THEN NULL WHEN lower(h) = 'human' THEN 'Human' WHEN h = lower(h) THEN {_TITLE} ELSE h END AS host FROM d")
def clean_hosts(t):
    h = t("flu_first_seg_meta").select("host_common_name").distinct()
    return h.select("host_common_name", M.clean_host("host_common_name").alias("host"))


@query(r"""WITH g AS (SELECT trim(regexp_replace(lower(term), '[\s[:punct:]]+', ' ', 'g')) AS k, min(term) AS city FROM canonical_terms WHERE field_name = 'geo_location_raw' GROUP BY 1),
v AS (SELECT DISTINCT geo_location_raw AS v, trim(regexp_replace(lower(geo_location_raw), '[\s[:punct:]]+', ' ', 'g')) AS k, trim(regexp_replace(lower(split_part(geo_location_raw, ',', 1)), '[\s[:punct:]]+', ' ', 'g')) AS h FROM flu_genomes_metadata_parsed),
f AS (SELECT v.v, CASE WHEN coalesce(v.k, '') = '' THEN 'blank' WHEN NOT regexp_matches(v.k, '\p{L}') THEN 'no_letters' WHEN coalesce(a.city, b.city) IS NULL THEN 'unknown' END AS reject_reason, coalesce(a.city, b.city) AS city FROM v LEFT JOIN g a ON a.k = v.k LEFT JOIN g b ON b.k = v.h)
SELECT m.hash_id, f.city AS place, f.reject_reason FROM flu_genomes_metadata_parsed m LEFT JOIN f ON m.geo_location_raw IS NOT DISTINCT FROM f.v""")
def standard_locations(t):
    g = t("canonical_terms").where("field_name = 'geo_location_raw'").select(F.col("term").alias("alias"), F.col("term").alias("city"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("country"))
    return M.standardize_location(t("flu_genomes_metadata_parsed"), "geo_location_raw", g).select("hash_id", M.select_location("auto").alias("place"), "reject_reason")


@query("WITH top AS (SELECT function FROM protein_final WHERE function IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, function LIMIT 3) SELECT CASE WHEN function IS NULL OR function IN (FROM top) THEN function ELSE 'other' END AS function, count(*) AS n FROM protein_final GROUP BY 1")
def top_functions(t):
    return M.top_n_or_other(t("protein_final"), "function", 3).groupBy("function").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT source AS category, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT category, n, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, category) AS rank FROM n)
SELECT CASE WHEN share >= 0.05 AND rank <= 4 THEN category ELSE 'Others' END AS category, sum(n)::BIGINT AS n, sum(share) AS share FROM r GROUP BY 1""")
def source_categories(t):
    return M.categories_with_others(t("documents"), "source", min_share=0.05, cap=4)


@query("WITH x AS (SELECT doc_id, upper(replace(trim(coalesce(text, ''), ' '), 'ß', 'SS')) AS s FROM documents), r AS (SELECT DISTINCT doc_id, unnest(string_split(s, '')) AS residue FROM x) SELECT residue, count(*) AS n_seqs FROM r WHERE residue <> '' AND NOT contains('ACDEFGHIKLMNPQRSTVWY*', residue) GROUP BY 1")
def residue_counts(t):
    return S.residue_counts(t("documents"), "text")


@query(f"WITH q AS (SELECT pair_row_id, length(regexp_replace({_DNA}, '[^NRYWSKMBDHV]', '', 'g')) / nullif(length({_DNA}), 0) AS f FROM ({_DNAS})) SELECT count_if(coalesce(f, 0) <= 0.001) AS n_kept, count_if(f > 0.001) AS n_rejected, max(f) AS worst FROM q")
def cleaned_contigs(t):
    kept, rejects = S.clean_dna(_dnas(t), "dna", 0.001)
    n = kept.agg(F.count("*").alias("n_kept"))
    worst = _dnas(t).agg(F.max(S.dna_quality("dna")["ambig_frac"]).alias("worst"))
    return n.join(F.broadcast(rejects.agg(F.count("*").alias("n_rejected")))).join(F.broadcast(worst))


@query("SELECT pair_row_id, list_transform(range(1, 21), lambda i: CASE WHEN i <= length(prot_seq_a) THEN ascii(substr(prot_seq_a, i::BIGINT, 1)) ELSE 0 END) AS codes, (SELECT count(*) FROM range(1, 21) r(i) WHERE i <= length(prot_seq_a) AND i <= length(prot_seq_b) AND substr(prot_seq_a, i, 1) = substr(prot_seq_b, i, 1)) AS n_same FROM segment_pairs")
def encoded_proteins(t):
    a, b = S.encode_codes("prot_seq_a", 20, 0), S.encode_codes("prot_seq_b", 20, 1)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)).cast("bigint")
    return t("segment_pairs").select("pair_row_id", a.alias("codes"), same.alias("n_same"))


@query("WITH p AS (SELECT DISTINCT brc_fea_id, upper(trim(prot_seq, ' ')) AS s FROM protein_final WHERE prot_seq IS NOT NULL AND brc_fea_id IS NOT NULL), k AS (SELECT brc_fea_id, s, length(s) - 2 AS n, md5(s) AS h FROM p) SELECT min(h) AS first_row, count(DISTINCT h) AS n_rows, count(DISTINCT brc_fea_id || h) AS n_keys, (SELECT sum(n)::BIGINT FROM (SELECT DISTINCT h, n FROM k)) AS n_kmers FROM k")
def kmer_store(t):
    """V-4, S15, J17: the protein k-mer store, written, read back and looked up."""
    from ..operators.joins import kmer_bridge
    from ..sources.readers import read_kmers
    from ..sources.sinks import write_kmers
    from .registry import own_folder

    p, path = t("protein_final").where("brc_fea_id is not null"), own_folder(t.spark)
    write_kmers(*S.kmer_store(p, "brc_fea_id", "prot_seq", 3, "aa"), path)
    index, matrix = read_kmers(t.spark, path)
    total = matrix.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n_kmers"), F.min("row_id").alias("first_row"))
    found = kmer_bridge(p, index, matrix, "brc_fea_id").agg(F.count("*").alias("n_found"))
    out = index.agg(F.count_distinct("row_id").alias("n_rows"), F.count("*").alias("n_keys")).join(F.broadcast(total)).join(F.broadcast(found))
    return out.select("first_row", "n_rows", "n_keys", "n_kmers")
