"""Queries of the corpus operators over the tables of TESTDATA.md, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .canonical import canonical_rows
from .components import connected_components
from .cooccurrence import cooccurrence
from .group_splits import assign_splits, normalized_path, record_components
from .leakage import cross_split_pairs, overlap_report
from .mixing import mix_sources
from .nearest import nearest_vectors, similar_pairs
from .packing import fill_containers, fill_report
from .spans import documents_sharing, shared_share
from .tokens import with_token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Protein pairs in at least 5 isolates together and at least 4 times as often as by chance."""
    pairs = cooccurrence(_table(spark, d, "protein_final"), "assembly_id", "prot_hash", min_count=5, min_lift=4.0)
    return pairs.select(F.col("item_a").alias("prot_hash_a"), F.col("item_b").alias("prot_hash_b"))


def p2_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """All protein pairs that occur together in 5 isolates or more, with their association scores."""
    return cooccurrence(_table(spark, d, "protein_final"), "assembly_id", "prot_hash", min_count=5)


def _record_groups(spark: SparkSession, d: str) -> DataFrame:
    members = _table(spark, d, "cc_members").withColumn("_file", normalized_path("cluster_id_path"))
    inside = lambda c: F.when(F.col("_file").isNotNull() & F.col(c).isNotNull(), F.concat_ws("\x1f", "_file", F.col(c).cast("string")))
    return record_components(members, "record_id", [F.col("assembly_id"), inside("cluster_id"), inside("cc_id")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The groups of the records as they were assigned to splits."""
    return p3_splits(spark, d).select("record_id", "first_record_id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record; records of one group share it."""
    from ..scratch import materialize, skew_join

    groups = materialize(_record_groups(spark, d))
    splits = assign_splits(groups, "first_record_id", _table(spark, d, "split_targets")).select(F.col("component").alias("first_record_id"), "split_name")
    return skew_join(groups, splits, "first_record_id").select("record_id", "first_record_id", "split_name")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per split: groups that are in another one too, and whether its rows are within the largest group of its target."""
    from ..scratch import materialize

    rows = materialize(p3_splits(spark, d))
    groups = rows.groupBy("first_record_id").agg(F.count("*").alias("n"), F.min("split_name").alias("lo"), F.max("split_name").alias("hi"))
    bound = groups.agg(F.max("n").alias("largest"), F.sum("n").alias("total"), F.count_if(F.col("lo") != F.col("hi")).alias("n_torn_groups"))
    got = rows.groupBy("split_name").agg(F.count("*").alias("n"))
    out = _table(spark, d, "split_targets").join(got, "split_name", "left").join(F.broadcast(bound))  # one row
    return out.select("split_name", "n_torn_groups", (F.abs(F.coalesce("n", F.lit(0)) - F.col("target_share") * F.col("total")) <= F.col("largest")).alias("near_target"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for field, table in (("geo_location_raw", "flu_genomes_metadata_parsed"), ("host_common_name", "flu_first_seg_meta"), ("passage", "flu_first_seg_meta")):
        part = _table(spark, d, table).select(F.col("hash_id").alias("key"), F.lit(field).alias("field"), F.col(field).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return canonical_rows(rows, _table(spark, d, "canonical_terms")).select(F.col("key").alias("hash_id"), F.col("field").alias("field_name"), "term_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(_table(spark, d, "master_esm2_embeddings"), "brc_fea_id", "emb", k=5, least_similarity=0.9)
    return pairs.select(F.col("a").alias("brc_fea_id_a"), F.col("b").alias("brc_fea_id_b"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar features of every row whose row_idx is divisible by 50, against all rows, with relaxed pruning."""
    vectors = _table(spark, d, "master_esm2_embeddings")
    asks = vectors.where("row_idx % 50 = 0").select("brc_fea_id")
    return nearest_vectors(vectors, "brc_fea_id", "emb", k=10, factor=0.8, queries=asks).select(F.col("query").alias("brc_fea_id"), F.col("neighbour").alias("neighbour_id"), "similarity", "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_table(spark, d, "cluster_pair_edges"), "cluster_id_a", "cluster_id_b").withColumnRenamed("vertex", "cluster_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = cross_split_pairs(_table(spark, d, "segment_pairs"))
    return found.select(F.least("train_row", "held_row").alias("pair_row_id_a"), F.greatest("train_row", "held_row").alias("pair_row_id_b")).distinct()


def p7_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Held-out rows with an overlap in training, per split and source."""
    return overlap_report(_table(spark, d, "segment_pairs"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a window of every container kind."""
    sized = with_token_counts(_table(spark, d, "documents"), "text", ["doc_id"])
    return fill_containers(_sized(sized), "doc_id", "n_tokens", _table(spark, d, "token_containers")).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Windows, used and unused tokens per container kind."""
    return fill_report(p8_containers(spark, d), _table(spark, d, "token_containers"))


def _sized(df: DataFrame) -> DataFrame:
    from ..scratch import materialize

    return materialize(df)  # tokenized once, however often it is read


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: documents placed, windows above the capacity, texts split without need, and texts whose pieces don't add up."""
    sized = _sized(with_token_counts(_table(spark, d, "documents"), "text", ["doc_id"]))
    kinds = _table(spark, d, "token_containers")
    got = _sized(fill_containers(sized, "doc_id", "n_tokens", kinds))
    cap = F.broadcast(kinds)  # a small fixed table
    windows = got.groupBy("container_kind", "window_id").agg(F.sum("piece_size").alias("used")).join(cap, "container_kind")
    over = windows.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_over"))
    items = got.groupBy("container_kind", F.col("item_id").alias("doc_id")).agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("placed"), F.max(F.col("piece_start") + F.col("piece_size")).alias("end"))
    items = items.join(sized, "doc_id").join(cap, "container_kind").groupBy("container_kind").agg(
        F.count("*").alias("n_documents"),
        F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens"))).alias("n_split_in_vain"),
        F.count_if((F.col("placed") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens"))).alias("n_lost"),
    )
    return items.join(over, "container_kind").select("container_kind", "n_documents", "n_over", "n_split_in_vain", "n_lost")


#: How the sources of the test tables come about (a parameter of the mix: the top level of its tree).
DOMAINS = {"instrument": ("run_log", "fasta_dump"), "curation": ("curation_ticket", "cluster_audit", "reviewer_memo")}


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = _sized(with_token_counts(_table(spark, d, "documents"), "text", ["doc_id", "source", "lang"]))
    domain = F.lit("observation")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), name).otherwise(domain)
    return mix_sources(sized.withColumn("domain", domain), "doc_id", "n_tokens", _table(spark, d, "mix_targets"), ("domain", "lang", "source"), total="held")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every use of a document in the mix, with its epoch."""
    return _mix(spark, d)[0].withColumnRenamed("size", "n_tokens")


def p9_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mix(spark, d)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source that is targeted and present: documents used too often, uses that repeat an epoch, and documents of another source."""
    docs = _table(spark, d, "documents").select("doc_id", F.col("source").alias("of"))
    targets = F.broadcast(_table(spark, d, "mix_targets"))  # a small fixed table
    used = p9_mix(spark, d).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("epochs"))
    return used.join(docs, "doc_id").join(targets, "source").groupBy("source").agg(
        F.count_if(F.col("n") > F.col("max_repeats")).alias("n_over"), F.count_if(F.col("n") != F.col("epochs")).alias("n_double"), F.count_if(F.col("of") != F.col("source")).alias("n_foreign")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return documents_sharing(_table(spark, d, "documents"), "doc_id", "text", least=200)


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in another one."""
    return shared_share(_table(spark, d, "documents"), "doc_id", "text", least=200)


def queries() -> dict[str, Query]:
    every = (p2_found, p2_cooccurrence, p3_found, p3_splits, p3_shares, p4_found, p5_found, p5_nearest, p6_found, p7_found, p7_overlap, p8_containers, p8_fill, p8_checks, p9_mix, p9_mix_report, p9_checks, p10_found, p10_shared)
    return {f.__name__: f for f in every}


_BASKETS = """
WITH base AS (SELECT DISTINCT assembly_id AS k, prot_hash AS i FROM protein_final WHERE assembly_id IS NOT NULL AND prot_hash IS NOT NULL),
m AS (SELECT i, count(*) AS n FROM base GROUP BY i), t AS (SELECT count(DISTINCT k) AS n FROM base),
p AS (SELECT x.i AS a, y.i AS b, count(*) AS n_ab FROM base x JOIN base y ON x.k = y.k AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5)
"""
_NEAR = """t AS (SELECT DISTINCT q FROM s WHERE split_name = 'train' AND q <> ''), h AS (SELECT DISTINCT q FROM s WHERE split_name IN ('val', 'test') AND q <> ''),
near AS (SELECT t.q AS tq, h.q AS hq FROM t JOIN h ON abs(length(t.q) - length(h.q)) <= 0.05 * greatest(length(t.q), length(h.q)) WHERE t.q = h.q OR levenshtein(t.q, h.q) <= 0.05 * greatest(length(t.q), length(h.q)))"""
_SIDES = "SELECT 'a' AS s, pair_row_id AS id, split_name, prot_hash_a AS p, ctg_dna_hash_a AS c, prot_seq_a AS q FROM segment_pairs UNION ALL SELECT 'b', pair_row_id, split_name, prot_hash_b, ctg_dna_hash_b, prot_seq_b FROM segment_pairs"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _BASKETS + "SELECT a AS prot_hash_a, b AS prot_hash_b FROM p JOIN m ma ON ma.i = a JOIN m mb ON mb.i = b, t WHERE n_ab * t.n >= 4 * ma.n * mb.n",
        "p2_cooccurrence": _BASKETS
        + """SELECT a AS item_a, b AS item_b, n_ab, ma.n AS n_a, mb.n AS n_b, t.n AS n, n_ab::DOUBLE * t.n / (ma.n::DOUBLE * mb.n) AS lift,
        ln(n_ab::DOUBLE * t.n / (ma.n::DOUBLE * mb.n)) AS pmi, n_ab / (ma.n + mb.n - n_ab) AS jaccard FROM p JOIN m ma ON ma.i = a JOIN m mb ON mb.i = b, t""",
        "p3_found": r"""
WITH RECURSIVE r AS (SELECT record_id, assembly_id, cluster_id, cc_id,
    regexp_replace(regexp_replace(regexp_replace(trim(cluster_id_path), '(^|/)(\./)+', '\1', 'g'), '/+', '/', 'g'), '[^/]+/\.\./', '', 'g') AS f FROM cc_members),
k AS (SELECT record_id, 'a' || assembly_id AS key FROM r UNION ALL SELECT record_id, 'b' || f || '|' || cluster_id FROM r UNION ALL SELECT record_id, 'c' || f || '|' || cc_id FROM r),
e AS (SELECT DISTINCT x.record_id AS u, y.record_id AS v FROM k x JOIN k y ON x.key = y.key),
reach AS (SELECT record_id AS u, record_id AS v FROM r UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)
SELECT u AS record_id, min(v) AS first_record_id FROM reach GROUP BY u""",
        "p5_found": """
WITH v AS (SELECT brc_fea_id AS id, any_value(emb)::DOUBLE[] AS e FROM master_esm2_embeddings WHERE emb IS NOT NULL AND brc_fea_id IS NOT NULL AND list_max(list_transform(emb, lambda x: abs(x))) > 0 GROUP BY 1),
s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM s)
SELECT DISTINCT least(x, y) AS brc_fea_id_a, greatest(x, y) AS brc_fea_id_b FROM t WHERE r <= 5 AND c >= 0.9""",
        "p6_found": """
WITH RECURSIVE e AS (SELECT cluster_id_a AS u, cluster_id_b AS v FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL UNION SELECT cluster_id_b, cluster_id_a FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL AND cluster_id_b IS NOT NULL),
n AS (SELECT cluster_id_a AS u FROM cluster_pair_edges WHERE cluster_id_a IS NOT NULL UNION SELECT cluster_id_b FROM cluster_pair_edges WHERE cluster_id_b IS NOT NULL),
reach AS (SELECT u, u AS v FROM n UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)
SELECT u AS cluster_id, min(v) AS group_id FROM reach GROUP BY u""",
        "p7_found": f"""
WITH s AS ({_SIDES}), t AS (SELECT DISTINCT q FROM s WHERE split_name = 'train' AND q <> ''), h AS (SELECT DISTINCT q FROM s WHERE split_name IN ('val', 'test') AND q <> ''),
near AS (SELECT t.q AS tq, h.q AS hq FROM t JOIN h ON abs(length(t.q) - length(h.q)) <= 0.05 * greatest(length(t.q), length(h.q)) WHERE t.q = h.q OR levenshtein(t.q, h.q) <= 0.05 * greatest(length(t.q), length(h.q))),
m AS (SELECT x.id AS tr, x.s AS ts, y.id AS hd, y.s AS hs FROM s x JOIN s y ON x.p = y.p WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test')
UNION SELECT x.id, x.s, y.id, y.s FROM s x JOIN s y ON x.c = y.c WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test')
UNION SELECT x.id, x.s, y.id, y.s FROM s x JOIN near ON x.q = near.tq JOIN s y ON y.q = near.hq WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test'))
SELECT DISTINCT least(x.tr, x.hd) AS pair_row_id_a, greatest(x.tr, x.hd) AS pair_row_id_b FROM m x JOIN m y ON x.tr = y.tr AND x.hd = y.hd AND x.ts < y.ts AND x.hs <> y.hs""",
        "p7_overlap": f"""
WITH s AS ({_SIDES}), {_NEAR},
m AS (SELECT x.id AS tr, x.s AS ts, y.id AS hd, y.s AS hs, true AS e FROM s x JOIN s y ON x.p = y.p WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test')
UNION SELECT x.id, x.s, y.id, y.s, true FROM s x JOIN s y ON x.c = y.c WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test')
UNION SELECT x.id, x.s, y.id, y.s, false FROM s x JOIN near ON x.q = near.tq JOIN s y ON y.q = near.hq WHERE x.split_name = 'train' AND y.split_name IN ('val', 'test')),
f AS (SELECT x.tr, x.hd, max((x.e AND y.e)::INT) AS e FROM m x JOIN m y ON x.tr = y.tr AND x.hd = y.hd AND x.ts < y.ts AND x.hs <> y.hs GROUP BY 1, 2),
g AS (SELECT hd, max(e) AS e, count(*) AS n FROM f GROUP BY 1)
SELECT split_name, source, count(*) AS n_rows, count(n) AS n_overlapping, count_if(coalesce(e, 0) = 1) AS n_exact, coalesce(sum(n), 0)::BIGINT AS n_train_rows, count(n) / count(*) AS overlapping_share
FROM segment_pairs LEFT JOIN g ON pair_row_id = hd WHERE split_name IN ('val', 'test') GROUP BY 1, 2""",
        "p10_found": """
WITH w AS (SELECT DISTINCT doc_id, substr(text, i::BIGINT, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM w x JOIN w y ON x.g = y.g AND x.doc_id < y.doc_id""",
        "p3_shares": "SELECT split_name, 0::BIGINT AS n_torn_groups, true AS near_target FROM split_targets",
        "p5_nearest": """
WITH v AS (SELECT brc_fea_id AS id, min(emb)::DOUBLE[] AS e FROM master_esm2_embeddings WHERE emb IS NOT NULL AND brc_fea_id IS NOT NULL AND list_max(list_transform(emb, lambda x: abs(x))) > 0 GROUP BY 1),
a AS (SELECT DISTINCT id, e FROM v JOIN master_esm2_embeddings m ON m.brc_fea_id = id WHERE m.row_idx % 50 = 0),
s AS (SELECT a.id AS x, v.id AS y, list_cosine_similarity(a.e, v.e) AS c FROM a JOIN v ON a.id <> v.id)
SELECT x AS brc_fea_id, y AS neighbour_id, c AS similarity, (row_number() OVER (PARTITION BY x ORDER BY c DESC, y))::INT AS rank FROM s QUALIFY rank <= 10""",
        "p8_checks": "SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_documents, 0::BIGINT AS n_over, 0::BIGINT AS n_split_in_vain, 0::BIGINT AS n_lost FROM token_containers WHERE capacity_tokens > 0",
        "p9_checks": "SELECT source, 0::BIGINT AS n_over, 0::BIGINT AS n_double, 0::BIGINT AS n_foreign FROM mix_targets SEMI JOIN documents USING (source)",
        "p10_shared": """
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (SELECT doc_id, i, substr(text, i::BIGINT, 200) AS g FROM (SELECT doc_id, text, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
r AS (SELECT g FROM w GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w SEMI JOIN r ON w.g = r.g),
st AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM hit GROUP BY doc_id, run),
mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM st),
mg AS (SELECT doc_id, s, e, sum(new) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS m FROM mk),
one AS (SELECT doc_id, m, max(e) - min(s) AS n FROM mg GROUP BY 1, 2), c AS (SELECT doc_id, count(*) AS k, sum(n) AS c, max(n) AS big FROM one GROUP BY 1),
cp AS (SELECT text, count(*) - 1 AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT d.doc_id, d.n AS n_chars, coalesce(c.c, 0)::BIGINT AS shared_chars, CASE WHEN d.n > 0 THEN coalesce(c.c, 0) / d.n ELSE 0.0 END AS shared_share, coalesce(c.k, 0) AS n_spans, coalesce(c.big, 0) AS longest_span, coalesce(cp.copies, 0) AS copies
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN cp ON cp.text = d.text""",
    }
