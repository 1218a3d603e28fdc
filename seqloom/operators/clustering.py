"""Sequence clustering and all-vs-all search: candidates from shared k-mers, verified by edit distance, then representatives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, pairs_within, rows_of, skew_join
from . import graph as G


def sketch(seqs: DataFrame, k: int, m: int) -> DataFrame:
    """(hash, n, kmer): the ``m`` least hashes of the k-mers of each sequence (all of them for short ones), and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, out = b.column(0).to_pylist(), [], []
            for text in b.column(1).to_pylist():
                c = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
                h = np.zeros(max(0, len(c) - k + 1), np.uint64)
                for i in range(k if len(h) else 0):
                    h = h * np.uint64(1_000_003) + c[i : i + len(h)]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(np.unique(h ^ (h >> np.uint64(32)))[:m].view(np.int64))
                sizes.append(len(c))
            rep = [len(o) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, dtype=object), rep), pa.string()), pa.array(np.repeat(sizes, rep), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out]))], names=["hash", "n", "kmer"])

    return seqs.select("hash", "seq").where("hash is not null and seq is not null").mapInArrow(run, "hash string, n int, kmer bigint")


def verified(pairs: DataFrame, seqs: DataFrame, least_identity: float, least_coverage: float) -> DataFrame:
    """(query, target, fident, qcov, tcov) of the ``pairs`` (query, target) with enough identity and coverage on both sides.

    Identity is 1 - edits / longer length, computed by the built-in bounded edit distance; a coverage is the shorter
    length by the side's own. ``seqs`` has every hash once.
    """
    text = lambda c, n: seqs.select(F.col("hash").alias(c), F.col("seq").alias(n))
    both = skew_join(skew_join(pairs, text("query", "q"), "query", at_most=rows_of(pairs)), text("target", "t"), "target", at_most=rows_of(pairs))
    a, b = F.length("q"), F.length("t")
    long, short = F.greatest(a, b), F.least(a, b)
    near = both.where((short >= least_coverage * long) & (short >= least_identity * long))
    longest = seqs.agg(F.max(F.length("seq"))).first()[0] or 0
    # no pair may differ by more edits than the longest sequence allows; beyond that the bounded distance gives up early (-1)
    d = F.when(F.col("q") == F.col("t"), F.lit(0)).otherwise(F.levenshtein("q", "t", int((1 - least_identity) * longest + 1e-9)))
    out = near.withColumn("d", d).where((F.col("d") >= 0) & ((1 - F.col("d") / long) >= least_identity - 1e-12))
    return out.select("query", "target", (1 - F.col("d") / long).alias("fident"), (short / a).alias("qcov"), (short / b).alias("tcov"))


def shared_lengths(longest: int, least_identity: float) -> np.ndarray:
    """For every length n up to ``longest``, letters that any two texts are sure to have in common in one piece if the longer one has n or more and they are hits; 0 where hits are equal texts only.

    As many edits as the identity allows cut the longer text into one piece more, and those together lack at most a letter per edit.
    """
    n = np.arange(longest + 1)
    edits = np.floor((1 - least_identity) * n + 1e-9).astype(np.int64)
    piece = -((edits - n) // (edits + 1))
    piece[edits == 0] = longest + 1
    least = np.minimum.accumulate(piece[::-1])[::-1]
    return np.where(edits > 0, least, 0)


def pieces(seqs: DataFrame, longest: int, least_identity: float, least_coverage: float, k: int, m: int) -> DataFrame:
    """(kmer, id): hashes of which any two texts of ``seqs`` (id, seq) that are hits have one in common; a row each once.

    A common piece of f letters holds the least of the k-mer hashes of each of its windows, so each text gives the least hash
    of every f letters, at f of its own length and of those that its longer partners may have; texts that allow no
    edit give one hash of the whole. Where f is under ``k``, texts give the ``m`` least hashes of their k-mers.
    """
    f = shared_lengths(longest, least_identity)
    f[(f > 0) & (f < k)] = 1
    share = max(least_identity, least_coverage, 1e-9)
    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(ids: np.ndarray, texts: list[str], n: np.ndarray) -> pa.RecordBatch:
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row, left = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n) - np.arange(len(code))
        most = np.minimum(longest, np.floor(n / share + 1e-9).astype(np.int64))
        levels = [set(f[x : y + 1].tolist()) if x else set() for x, y in zip(n, most)]
        rows, kmers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level in sorted(set().union(*levels)):
            here = np.array([level in x for x in levels])
            width = 1 if level < k else min(level, max(2, level // 8))  # k-mers in a window
            size = k if level < k else level - width + 1
            if level:
                h = np.full(max(0, len(code) - size + 1), level, np.uint64)
                for i in range(size):
                    h = h * np.uint64(1_000_003) + code[i : i + len(h)]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                h = np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1) if len(h) >= width else h[:0]
                at = np.flatnonzero(here[row[: len(h)]] & (left[: len(h)] >= size + width - 1))
                r, h = row[at], h[at]
            else:
                r = np.flatnonzero(here)
                h = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()) for i in r], np.uint64)
            o = np.lexsort((h, r))
            r, h = r[o], h[o]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            r, h = r[new], h[new]
            if 0 < level < k:
                least = np.arange(len(r)) - np.searchsorted(r, r) < m
                r, h = r[least], h[least]
            rows.append(r)
            kmers.append(h.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kmers)), pa.array(ids[np.concatenate(rows)])], names=["kmer", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            n = np.array([len(x) for x in texts], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000, prepend=0)).tolist()  # about a million letters at once
            for x, y in zip([0, *cuts], [*cuts, len(n)]):
                if x < y:
                    yield of(ids[x:y], texts[x:y], n[x:y])

    return seqs.select("id", "seq").mapInArrow(run, "kmer bigint, id bigint")


def search(seqs: DataFrame, *, least_identity: float = 0.95, least_coverage: float = 0.8, k: int = 6, m: int = 40) -> DataFrame:
    """All hits (query, target, fident, qcov, tcov), query < target, of sequences.

    Complete where the identity leaves two hits a common piece of ``k`` letters at least (``shared_lengths``; at 0.95 always);
    shorter pieces make no candidates, and there two sequences must share one of their ``m`` least k-mers.
    Distinct sequences only. K-mers of one sequence are dropped before any are paired; pairs of a k-mer that many sequences
    have come from chunk blocks, never from one task.
    """
    one = materialize(seqs.where("hash is not null and seq is not null").groupBy("hash").agg(F.min("seq").alias("seq")).withColumn("id", F.monotonically_increasing_id()))
    longest = one.agg(F.max(F.length("seq"))).first()[0] or 0
    keys = materialize(pieces(one, longest, least_identity, least_coverage, k, m))
    many = materialize(keys.groupBy("kmer").agg(F.count("*").alias("n")).where("n > 1"))
    hot = [r[0] for r in many.where(F.col("n") > 200_000).orderBy(F.desc("n"), "kmer").limit(10_000).collect()]
    keys = materialize(skew_join(keys, many.select("kmer"), "kmer", hot=hot))
    pairs = materialize(pairs_within(keys, "kmer", "id").select(F.col("a").alias("query"), F.col("b").alias("target")).distinct())
    hits = materialize(verified(pairs, one.select(F.col("id").alias("hash"), "seq"), least_identity, least_coverage))
    name = lambda c, n: one.select(F.col("id").alias(c), F.col("hash").alias(n))
    named = skew_join(skew_join(hits, name("query", "a"), "query"), name("target", "b"), "target", at_most=rows_of(hits))
    first = F.col("a") < F.col("b")
    return named.select(F.least("a", "b").alias("query"), F.greatest("a", "b").alias("target"), "fident", F.when(first, F.col("qcov")).otherwise(F.col("tcov")).alias("qcov"), F.when(first, F.col("tcov")).otherwise(F.col("qcov")).alias("tcov"))


def linear_links(seqs: DataFrame, *, least_identity: float = 0.95, least_coverage: float = 0.8, k: int = 6, m: int = 20) -> DataFrame:
    """C1 (linear): hits of every sequence with the longest one (ties to the smaller hash) of each of its ``m`` least k-mers: as many candidates as k-mers."""
    one = materialize(seqs.where("hash is not null and seq is not null").groupBy("hash").agg(F.min("seq").alias("seq")))
    keys = materialize(sketch(one, k, m))
    centre = keys.groupBy("kmer").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("hash")))["hash"].alias("target"))
    pairs = materialize(skew_join(keys.select("kmer", F.col("hash").alias("query")), centre, "kmer", at_most=rows_of(keys)).where("query <> target").select("query", "target").distinct())
    return verified(pairs, one, least_identity, least_coverage)


def greedy_representatives(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """C1 (greedy): (hash, rep): going from the longest sequence (ties to the smaller hash), one without a representative
    among its links becomes one itself; any other joins the first of those it is linked to.

    The sequential order is kept by rounds: a node that comes before all its undecided neighbours is decided.
    ``nodes`` is (hash, n), ``links`` (query, target).
    """
    rank = lambda n, h: F.struct((-F.col(n)).alias("neg"), F.col(h).alias("hash"))
    size = materialize(nodes.groupBy("hash").agg(F.max("n").alias("n")))
    both = links.select(F.explode(F.array(F.struct(F.col("query").alias("x"), F.col("target").alias("y")), F.struct(F.col("target").alias("x"), F.col("query").alias("y")))).alias("e")).select("e.x", "e.y").where("x <> y").distinct()
    both = skew_join(materialize(both), size.select(F.col("hash").alias("y"), F.col("n").alias("ny")), "y")
    edges = materialize(both.select(F.col("x").alias("hash"), rank("ny", "y").alias("o")))
    open_, reps, n_open = size, None, rows_of(size)
    while n_open:
        live = edges.join(open_.select(F.col("hash").alias("_y")), F.col("o.hash") == F.col("_y"), "left_semi").groupBy("hash").agg(F.min("o").alias("first"))
        new = materialize(open_.join(live, "hash", "left").where(F.col("first").isNull() | (rank("n", "hash") < F.col("first"))).select("hash"))
        reps = new if reps is None else reps.unionByName(new)
        taken = edges.join(new.select(F.col("hash").alias("_y")), F.col("o.hash") == F.col("_y"), "left_semi").select("hash").distinct()
        open_ = materialize(open_.join(new, "hash", "left_anti").join(taken, "hash", "left_anti"))
        n_open = rows_of(open_)
    if reps is None:
        return size.select("hash", F.col("hash").alias("rep"))
    reps = materialize(reps)
    own = edges.join(reps.select(F.col("hash").alias("_y")), F.col("o.hash") == F.col("_y"), "left_semi").groupBy("hash").agg(F.min("o")["hash"].alias("rep"))
    return reps.select("hash", F.col("hash").alias("rep")).unionByName(own.join(reps, "hash", "left_anti").select("hash", "rep"))


def cluster_sequences(seqs: DataFrame, *, prefix: str = "C", method: str = "greedy", links: str = "linear", least_identity: float = 0.95, least_coverage: float = 0.8) -> DataFrame:
    """(hash, cluster_rep, cluster_id) of distinct sequences; method 'greedy' or 'connected', links 'linear' or 'all'.

    Clusters are numbered by size, ties by their smallest hash. Null sequences have no cluster; with 'connected' the
    representative is the smallest hash.
    """
    found = materialize((linear_links if links == "linear" else search)(seqs, least_identity=least_identity, least_coverage=least_coverage))
    nodes = materialize(seqs.where("hash is not null and seq is not null").groupBy("hash").agg(F.max(F.length("seq")).alias("n")))
    if method == "connected":
        rep = G.components(found, "query", "target", nodes.select("hash")).select(F.col("node").alias("hash"), F.col("root").alias("rep"))
    else:
        rep = greedy_representatives(nodes, found)
    rep = materialize(rep)
    ranks = G.ranked_components(rep.withColumnRenamed("rep", "root"), rep.groupBy("rep").agg(F.count("*").alias("size"), F.min("hash").alias("least")).select(F.col("rep").alias("root"), "size"))
    return skew_join(rep, ranks.select(F.col("root").alias("rep"), "cc_id"), "rep").select("hash", F.col("rep").alias("cluster_rep"), F.concat(F.lit(f"{prefix}_"), "cc_id").alias("cluster_id"))


def cluster_functions(records: DataFrame, functions: list[str], thresholds: list[float], **options) -> DataFrame:
    """(function, threshold, hash, cluster_rep, cluster_id) for each function present and each threshold; absent functions are left out."""
    from ..functions.keys import threshold_label

    there = present_functions(records, functions)
    out = None
    for f in there:
        seqs = materialize(records.where(F.col("function") == f).select("hash", "seq"))
        for t in thresholds:
            part = cluster_sequences(seqs, prefix=f"{f}", least_identity=t, **options).select(F.lit(f).alias("function"), threshold_label(F.lit(t)).alias("threshold"), "hash", "cluster_rep", "cluster_id")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return records.sparkSession.createDataFrame([], "function string, threshold string, hash string, cluster_rep string, cluster_id string")
    return out


def present_functions(records: DataFrame, functions: list[str]) -> list[str]:
    """Of the requested functions those that occur, in the order requested (at most as many rows as were asked for)."""
    there = {r[0] for r in records.where(F.col("function").isin(functions)).select("function").distinct().collect()}
    return [f for f in functions if f in there]


