"""Long exact spans shared between records (De Bruijn compaction over content-defined tokens)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, pairs_within, rows_of, skew_join, spread_join

GRAM = 8  # code points whose hash decides where a token may begin
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class _Hasher:
    """Prefix sums of a polynomial hash modulo 2**64 over mixed code points: any substring's hash in constant time."""

    def __init__(self, codes: np.ndarray, base: np.uint64) -> None:
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        self.pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(codes.astype(np.uint64) + base) * _powers(base, len(codes))[:-1])])
        self.inv = _powers(inv, len(codes))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.pre[end] - self.pre[start]) * self.inv[start] + (end - start).astype(np.uint64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(codes: np.ndarray, window: int) -> np.ndarray:
    """Positions where tokens begin: in every ``window`` neighbouring positions the one with the least gram hash, the last of equal ones."""
    n = len(codes) - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(1_000_003) + codes[i : i + n]
    # the position in the low bits makes the last of equal values the least, and the minimum tells its place
    low = np.uint64((1 << 32) - 1)
    h = (_mix(h) & ~low) | (low - np.arange(n, dtype=np.uint64))
    best = _slide_min(h, window)
    return (low - (best[np.concatenate([[True], best[1:] != best[:-1]])] & low)).astype(np.int64)


def token_windows(codes: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the run of tokens from every anchor that is certain to agree in all spans of ``least`` code points around it.

    A span of ``least`` code points holds windows of anchors that both records agree on from its first to its last
    one, at least ``reach`` code points apart. The run from an anchor goes to the furthest anchor within ``reach``.
    """
    a = anchors(codes, window)
    reach = least - GRAM + 2 - 2 * window
    last = np.searchsorted(a, a + reach, side="right") - 1
    keep = a + reach <= (a[-1] + window if len(a) else 0)  # shorter tails can't be within a long enough span
    keep &= last > np.arange(len(a))
    return a[keep], a[last[keep]] + GRAM


def _edges(least: int, window: int):
    """Token k-mers of every text: (part, key, did, i, s, e, sure).

    A key that two texts of one batch have is known to be repeated: its rows are ``sure`` and are spread by text, so that
    a hot key never meets in one place. Two witnesses (i = -1) of the batch go where the key's other rows are gathered.
    """
    schema = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("did", pa.int64()), ("i", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for did, text in zip(b.column("did").to_pylist(), b.column("text").to_pylist()):
                c = _codes(text)
                s, e = token_windows(c, least, window)
                if len(s):
                    key = _Hasher(c, _B1)(s, e).view(np.int64)
                    for o, x in zip(out, (key, np.full(len(s), did), np.arange(len(s), dtype=np.int32), s.astype(np.int32), e.astype(np.int32))):
                        o.append(x)
            if not out[0]:
                continue
            key, did, i, s, e = (np.concatenate(o) for o in out)
            order = np.lexsort((did, key))
            first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            start = np.flatnonzero(first)
            low, high = did[order[start]], did[order[np.concatenate([start[1:], [len(key)]]) - 1]]
            twice = low != high
            sure = np.zeros(len(key), bool)
            sure[order] = twice[np.cumsum(first) - 1]
            known = key[order[start[twice]]]
            none = np.full(2 * len(known), -1, np.int32)
            cols = [np.where(sure, did, key), key, did, i, s, e, sure]
            more = [np.tile(known, 2), np.tile(known, 2), np.concatenate([low[twice], high[twice]]), none, none, none, np.zeros(len(none), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y])) for x, y in zip(cols, more)], schema=schema)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, did), those whose key has two or more did. Rows of a key's first did are held back, others stream through.

    Rows that are ``sure`` already pass; witnesses (i = -1) only tell the others.
    """
    held: list[pa.RecordBatch] = []
    last_key = last_did = None
    open_ = False  # the last key is known to have two did
    real = lambda r: r.filter(pc.greater_equal(r.column("i"), 0)).drop_columns(["part", "sure"])
    for b in batches:
        sure = b.filter(b.column("sure"))
        if sure.num_rows:
            yield real(sure)
        b = b.filter(pc.invert(b.column("sure")))
        if not b.num_rows:
            continue
        key, did = b.column("key").to_numpy(), b.column("did").to_numpy()
        new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
        group = np.cumsum(new)  # 0: goes on from the batch before
        change = np.concatenate([[not new[0] and did[0] != last_did], (did[1:] != did[:-1]) & ~new[1:]])
        multi = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(multi, group, change)
        if not new[0]:
            multi[0] |= open_
        if held and multi[0]:
            yield from (real(h) for h in held)
        if new[0] or multi[0] or group[-1] > 0:
            held = []
        keep = multi[group]
        if keep.any():
            yield real(b.filter(pa.array(keep)))
        open_ = bool(multi[group[-1]])
        if not open_:
            tail = np.flatnonzero(group == group[-1])[0]
            held.append(b.slice(tail))
        last_key, last_did = key[-1], did[-1]


def _boundary_keys(least: int, window: int):
    """Rows of (unitig, x, y, two hashes) for every way to widen an occurrence by x code points to the left and y to the right."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for did, text, occ in zip(pdf["did"], pdf["text"], pdf["occ"]):
                c = _codes(text)
                h1, h2, n = _Hasher(c, _B1), _Hasher(c, _B2), len(c)
                for o in occ:
                    s, e = o["s"], o["e"]
                    lack = max(0, least - (e - s))
                    x = np.arange(0, min(max(lack, window), s) + 1)
                    y = np.maximum(0, lack - x)
                    y2 = np.arange(1, max(lack, 3 * window) + 1)  # the last sure edge ends at most a tail and two gaps before the end
                    x2 = np.maximum(0, lack - y2)
                    x, y = np.concatenate([x, x2]), np.concatenate([y, y2])
                    ok = (x <= s) & (y <= n - e)
                    x, y = x[ok], y[ok]
                    xy = np.unique(x * 100_000 + y)
                    x, y = xy // 100_000, xy % 100_000
                    if len(x):
                        out.append((np.full(len(x), o["u"]), x, y, h1(s - x, e + y).view(np.int64), h2(s - x, e + y).view(np.int64), np.full(len(x), did), s - x, e + y))
            if out:
                cols = [np.concatenate(z) for z in zip(*out)]
                yield pd.DataFrame(dict(zip(("u", "x", "y", "h1", "h2", "did", "s", "e"), cols)))

    return run


def shared_spans(docs: DataFrame, doc_id: str, text: str, *, least: int = 200, window: int = 32) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``spans`` (span, did, s, e) and ``texts`` (doc_id, did, n_chars).

    ``did`` names a distinct text (copies have one). A ``span`` is a stretch of at least ``least`` code points that
    stands verbatim in two or more distinct texts, at code points s to e (from 0, e not included) of each of its rows.

    Texts are cut into content-defined tokens (at most ``window`` code points apart, cut by what stands there and not by
    position). Runs of tokens that any sufficiently long span must hold are the edges of a De Bruijn graph; an
    edge seen in one text only is dropped (an edge that two texts of one batch have stays where it is, so that hot edges
    are never gathered). Edge f follows e on an unbranched path if e always goes on with f and f
    always comes from e; such paths are compacted into one unitig by joins on the edge table, so that a long shared
    passage is one row per text however many edges it has. Every occurrence of a unitig is then checked at its source
    coordinates: it is widened there, in each way that makes ``least`` code points, and only texts that agree on the
    widened stretch (two independent 64-bit hashes of the characters) are a span. No pair of texts is ever enumerated.

    Null texts and texts shorter than ``least`` share nothing. Whole texts are read, case and white space count.
    """
    if least - GRAM + 2 - 2 * window < GRAM:
        raise ValueError("window is too large for least")
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("did", F.xxhash64("text"))
    texts = src.where("text is not null").select("doc_id", "did", F.char_length("text").alias("n_chars"))
    long = src.where(F.char_length("text") >= least).select("did", "text")
    edges = long.mapInArrow(_edges(least, window), "part bigint, key bigint, did bigint, i int, s int, e int, sure boolean")
    # copies of a text give the same edges
    rep = materialize(edges.repartition("part").sortWithinPartitions("key", "did", "i").mapInArrow(_repeated, "key bigint, did bigint, i int, s int, e int").distinct())

    text_order = W.partitionBy("did").orderBy("i")
    beside = lambda f, step, name: F.when(f("i").over(text_order) == F.col("i") + step, f("key").over(text_order)).alias(name)
    walk = materialize(rep.select("*", beside(F.lead, 1, "nxt"), beside(F.lag, -1, "prv")))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c))
    nodes = materialize(walk.groupBy("key").agg(only("nxt").alias("only_nxt"), only("prv").alias("only_prv"), F.count("*").alias("n")))
    # f goes on from e where both agree that they have no other neighbour
    heads = nodes.where("only_prv is not null").select("key", "only_prv")
    back = nodes.where("only_nxt is not null").select(F.col("key").alias("only_prv"), F.col("only_nxt").alias("back"))
    inner = skew_join(heads, back, "only_prv", at_most=rows_of(nodes)).where("back = key").select("key", F.lit(True).alias("inner"))
    flagged = skew_join(walk, inner, "key", "left", hot=_hot_keys(nodes, "key")).select("did", "i", "s", "e", "key", F.coalesce("inner", F.lit(False)).alias("inner"))
    # within a text the unitigs are the stretches from one path head to the next; a head names its unitig
    run = F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(text_order.rowsBetween(W.unboundedPreceding, 0))
    unitigs = flagged.withColumn("run", run).groupBy("did", "run").agg(F.min(F.struct("i", "key", "s")).alias("m"), F.max("e").alias("e"))
    occ = materialize(unitigs.groupBy("did").agg(F.array_sort(F.collect_list(F.struct(F.col("m.key").alias("u"), F.col("m.s").alias("s"), "e"))).alias("occ")))
    wide = long.join(occ.select("did"), "did", "left_semi").dropDuplicates(["did"]).join(occ, "did").mapInPandas(_boundary_keys(least, window), "u bigint, x int, y int, h1 bigint, h2 bigint, did bigint, s int, e int")
    wide = materialize(wide.select(F.xxhash64("u", "x", "y", "h1", "h2").alias("span"), F.xxhash64("h2", "h1", "y", "x", "u").alias("check"), "did", "s", "e"))
    # of the ways to widen, those with the same texts tell the same; a span is named by two hashes, of which one is joined on
    groups = materialize(wide.groupBy("span", "check").agg(F.min("did").alias("d0"), F.max("did").alias("d1"), F.count("*").alias("n")).where("d0 <> d1").select("span", "check", "n"))
    keep = groups.select("span", F.col("check").alias("sure"))
    spans = skew_join(wide, keep, "span", hot=_hot_keys(groups, "span")).where("check = sure").select("span", "did", "s", "e")
    return spans, texts


def _hot_keys(counts: DataFrame, key: str, rows: int = 200_000) -> list:
    """Of (key, n) the keys with more than ``rows`` rows: at most as many as the table has rows / ``rows``, the 10,000 largest."""
    return [r[0] for r in counts.where(F.col("n") > rows).orderBy(F.desc("n"), key).limit(10_000).select(key).collect()]


def documents_sharing(docs: DataFrame, doc_id: str, text: str, *, least: int = 200, window: int = 32) -> DataFrame:
    """Rows ``(doc_id_a, doc_id_b)``, a < b: documents that share a verbatim stretch of at least ``least`` code points.

    Copies of one text share it with each other and whatever it shares with others. The result has one row per pair
    by definition; the pairs of texts come from their common spans, those of documents from the texts' copies.
    """
    spans, texts = shared_spans(docs, doc_id, text, least=least, window=window)
    of = materialize(texts.where(F.col("n_chars") >= least).select("did", "doc_id").distinct())
    member = materialize(spans.select("span", "did").distinct())
    # spans of the very same texts give the same pairs: one of them is enough
    sets = member.withColumn("h", F.xxhash64("did")).withColumn("g", F.xxhash64("did", F.lit(1)))
    sets = sets.groupBy("span").agg(F.count("*").alias("n"), F.bit_xor("h").alias("a"), F.bit_xor("g").alias("b"), F.min("did").alias("c"))
    kept = sets.groupBy("n", "a", "b", "c").agg(F.min("span").alias("span")).select("span")
    few = materialize(skew_join(member, kept, "span"))
    pair = materialize(pairs_within(few, "span", "did").select(F.col("a").alias("did"), F.col("b").alias("other")).distinct())
    n = rows_of(of)
    across = spread_join(spread_join(pair, of.withColumnRenamed("doc_id", "p"), "did", at_most=n), of.withColumnsRenamed({"did": "other", "doc_id": "q"}), "other", at_most=n).select("p", "q")
    same = pairs_within(of, "did", "doc_id").select(F.col("a").alias("p"), F.col("b").alias("q"))
    return across.unionByName(same).where("p <> q").select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b")).distinct()


def shared_share(docs: DataFrame, doc_id: str, text: str, *, least: int = 200, window: int = 32) -> DataFrame:
    """Per document: ``doc_id, n_chars, shared_chars, shared_share, n_spans, longest_span, copies``.

    ``shared_chars`` counts the code points inside stretches of at least ``least`` that also stand in another document
    (all of them for a copy of a long enough text), overlapping stretches merged; ``n_spans`` counts the merged ones.
    Null texts have null ``n_chars`` and zeros.
    """
    spans, texts = shared_spans(docs, doc_id, text, least=least, window=window)
    # a stretch that begins behind the end of all before it opens a new merged one
    order = W.partitionBy("did").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select("did", "s", "e").distinct().withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    merged = marked.withColumn("m", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("did", "m").agg((F.max("e") - F.min("s")).alias("n"))
    cover = merged.groupBy("did").agg(F.count("*").cast("int").alias("k"), F.sum("n").alias("c"), F.max("n").alias("big"))
    texts = materialize(texts)
    copies = texts.groupBy("did").agg((F.count("*") - 1).alias("copies"))
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    full = (F.col("copies") > 0) & (F.col("n_chars") >= least)
    zero = lambda c: F.coalesce(c, F.lit(0))
    named = materialize(ids.join(texts.distinct(), "doc_id", "left"))
    return (
        skew_join(skew_join(named, copies, "did", "left"), cover, "did", "left", at_most=rows_of(named))
        .select(
            "doc_id",
            "n_chars",
            F.when(full, F.col("n_chars")).otherwise(zero(F.col("c"))).cast("bigint").alias("shared_chars"),
            F.when(F.col("n_chars") > 0, F.when(full, F.lit(1.0)).otherwise(zero(F.col("c")) / F.col("n_chars"))).otherwise(F.lit(0.0)).alias("shared_share"),
            F.when(full, F.lit(1)).otherwise(zero(F.col("k"))).alias("n_spans"),
            F.when(full, F.col("n_chars")).otherwise(zero(F.col("big"))).alias("longest_span"),
            zero(F.col("copies")).alias("copies"),
        )
    )
