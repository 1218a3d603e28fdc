"""Same or near-same records across splits: a compressed full-text index of the evaluation side, searched backwards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, rows_of, skew_join, spread_join


class FMIndex:
    """Burrows-Wheeler index over texts, each followed by a separator: rank bit vectors per letter and the suffix array."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        letters = np.unique(joined)
        self.code = np.full(256, -1, np.int16)
        self.code[letters] = np.arange(len(letters))
        self.text = self.code[joined].astype(np.uint8)
        n, sigma = len(self.text), len(letters)
        self.sa = self._suffixes(self.text, sigma)
        bwt = self.text[self.sa - 1]
        self.words = (n >> 6) + 1
        bits = np.zeros((sigma, self.words * 64), bool)
        bits[bwt, np.arange(n)] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        counts = np.bitwise_count(self.bits).reshape(sigma, self.words).astype(np.int32)
        self.before = (np.cumsum(counts, axis=1) - counts).astype(np.int32).ravel()
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=sigma))])[:-1]

    @staticmethod
    def _suffixes(text: np.ndarray, sigma: int) -> np.ndarray:
        """Suffix array by prefix doubling, the first round on as many letters as fit into 60 bits."""
        n, bits = len(text), max(1, int(sigma).bit_length())
        width = max(1, 60 // bits)
        key = np.zeros(n, np.uint64)
        for i in range(width):
            key <<= np.uint64(bits)
            key[: max(0, n - i)] |= text[i:].astype(np.uint64) + np.uint64(1)
        while True:
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
            if rank[order[-1]] == n - 1 or width >= n:
                return order
            key = (rank + 1).astype(np.uint64) << np.uint64(31)
            key[: n - width] |= (rank[width:] + 1).astype(np.uint64)
            width *= 2

    def _rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = c * self.words + (i >> 6)
        return self.before[w] + np.bitwise_count(self.bits[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def search(self, query: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``depth`` letters up to and with each of ``ends``: those found, with their intervals [lo, hi)."""
        lo, hi, at = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64), ends.astype(np.int64)
        for step in range(depth):
            c = query[at - step].astype(np.int64)
            ok = c >= 0
            if not ok.all():
                lo, hi, at, c = lo[ok], hi[ok], at[ok], c[ok]
            lo, hi = self.first[c] + self._rank(c, lo), self.first[c] + self._rank(c, hi)
            live = lo < hi
            lo, hi, at = lo[live], hi[live], at[live]
            if not len(at):
                break
        return at, lo, hi


def within_edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Edit distance of row pairs of two padded code matrices, or limit + 1 where it is larger (banded, all pairs at once)."""
    p, big = len(la), 1 << 12
    if not p:
        return np.zeros(0, np.int64)
    k = int(limit.max())
    offs = np.arange(-k, k + 1)
    d = np.where(offs[None] >= 0, offs[None], big).repeat(p, 0).astype(np.int16)  # row 0: j = offs
    result = np.where(la == 0, lb, big)
    pad = np.full((p, b.shape[1] + 2 * k + 2), 255, np.int16)
    pad[:, k + 1 : k + 1 + b.shape[1]] = b
    for i in range(1, int(la.max()) + 1):
        j = i + offs
        same = pad[:, j[0] + k : j[0] + k + len(offs)] == a[:, i - 1][:, None] if j[0] + k + len(offs) <= pad.shape[1] else None
        if same is None:
            same = np.zeros((p, len(offs)), bool)
            width = pad.shape[1] - (j[0] + k)
            if width > 0:
                same[:, :width] = pad[:, j[0] + k :] == a[:, i - 1][:, None]
        new = d + ~same
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)
        new[:, j < 0] = big
        if (j == 0).any():
            new[:, j == 0] = i
        new = np.minimum.accumulate(new - offs.astype(np.int16), axis=1) + offs.astype(np.int16)
        new[:, j < 0] = big
        d = np.minimum(new, big).astype(np.int16)
        done = np.flatnonzero(la == i)
        if len(done):
            at = lb[done] - i + k
            ok = (at >= 0) & (at < len(offs))
            result[done[ok]] = d[done[ok], at[ok]]
    return np.minimum(result, limit + 1)


def most_edits(length, share: float):
    """Edits allowed between a text of ``length`` and one that may be longer: at most ``share`` of the longer."""
    return np.floor(length * share / (1 - share) + 1e-9).astype(int)


def least_block(length, share: float):
    """Letters of the longest untouched block that a text of ``length`` must have in common with any near-equal text."""
    d = most_edits(length, share)
    return -(-(length - d) // (d + 1))


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(n.max(initial=0))), 254, np.uint8)
    out[np.arange(out.shape[1])[None] < n[:, None]] = np.frombuffer(b"".join(texts), np.uint8)
    return out, n


class HeldIndex:
    """Held texts behind one full-text index, built once and searched by any number of batches of training texts."""

    def __init__(self, held: list[bytes], share: float, stride: int = 3) -> None:
        self.fm, self.share, self.stride = FMIndex(held), share, stride
        self.text, self.size = _padded(held)
        self.depth = max(2, int(least_block(self.size, share).min()) - stride + 1)

    def matches(self, train: list[bytes]) -> pd.DataFrame:
        """All (t, h, edits, matched, spans) with edit distance of at most ``share`` of the longer.

        ``train`` is streamed through backward search at every ``stride``-th end, deep enough that no
        common block of the guaranteed length slips through. All places of the found interval are located, widened to
        maximal matches along their diagonals and merged into spans per pair before the edit distance is computed.
        """
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("t", "h", "edits", "matched", "spans")})
        if not train:
            return empty
        fm, hm, hn, share, stride, depth = self.fm, self.text, self.size, self.share, self.stride, self.depth
        parts = []
        per = max(1, int(4_000_000 // max(1, np.mean([len(t) for t in train]))))
        for s0 in range(0, len(train), per):
            tm, tn = _padded(train[s0 : s0 + per])
            letters = np.frombuffer(b"\0".join(train[s0 : s0 + per]) + b"\0", np.uint8)
            joined = np.where(letters == 0, -1, fm.code[letters])
            starts = np.cumsum([0, *(tn + 1)])[:-1]
            owner = np.repeat(np.arange(len(tn)), tn + 1)
            offset = np.arange(len(joined)) - starts[owner]
            ends = np.flatnonzero((offset >= depth - 1) & (offset < tn[owner]) & ((offset - depth + 1) % stride == 0))
            for e0 in range(0, len(ends), 2_000_000):
                at, lo, hi = fm.search(joined, ends[e0 : e0 + 2_000_000], depth)
                if not len(at):
                    continue
                n = hi - lo
                cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 3_000_000), side="left")
                for a, b in zip(cuts, [*cuts[1:], len(n)]):
                    if b <= a:
                        continue
                    m = n[a:b]
                    where = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                    place = fm.sa[where]
                    h = np.searchsorted(fm.starts, place, side="right") - 1
                    t = np.repeat(owner[at[a:b]], m)
                    diag = (place - fm.starts[h]) - (np.repeat(offset[at[a:b]], m) - depth + 1)
                    most = np.floor(np.maximum(hn[h], tn[t]) * share + 1e-9)
                    near = (np.abs(hn[h] - tn[t]) <= most) & (np.abs(diag) <= most)
                    code = np.unique((t[near] << 44) | (h[near] << 20) | (diag[near] + (1 << 19)))
                    parts.append(_spans(code, tm, tn, hm, hn, depth, s0))
        if not parts:
            return empty
        spans = pd.concat(parts).groupby(["t", "h", "diag"], sort=False).first().reset_index()
        pairs = spans.groupby(["t", "h"], sort=False).agg(matched=("matched", "sum"), spans=("spans", "sum"), miss=("miss", "min")).reset_index()
        t, h = pairs["t"].to_numpy(), pairs["h"].to_numpy()
        tl = np.array([len(x) for x in train])
        limit = np.floor(np.maximum(tl[t], hn[h]) * share + 1e-9).astype(int)
        edits = np.where(pairs["miss"] <= limit, pairs["miss"], limit + 1).astype(np.int64)
        # a gapless alignment only bounds the distance from above, which is all that the test needs; the rest is aligned
        open_ = np.flatnonzero(edits > limit)
        for s in range(0, len(open_), 20_000):
            o = open_[s : s + 20_000]
            am, an = _padded([train[i] for i in t[o]])
            edits[o] = within_edits(am, an, hm[h[o]], hn[h[o]], limit[o])
        ok = edits <= limit
        return pd.DataFrame({"t": t[ok], "h": h[ok], "edits": edits[ok], "matched": pairs["matched"].to_numpy()[ok], "spans": pairs["spans"].to_numpy()[ok]})


def near_matches(train: list[bytes], held: list[bytes], share: float, stride: int = 3) -> pd.DataFrame:
    """``HeldIndex.matches`` for lists; the index is of ``held``."""
    return HeldIndex(held if held else [b"\1"], share, stride).matches(train if held else [])


def _spans(code: np.ndarray, tm, tn, hm, hn, depth: int, s0: int) -> pd.DataFrame:
    """Maximal matches of at least ``depth`` along each (t, h, diagonal): their total length and number, and the mismatches of a gapless alignment."""
    out = []
    for s in range(0, len(code), 50_000):
        c = code[s : s + 50_000]
        t, h, diag = c >> 44, (c >> 20) & ((1 << 24) - 1), (c & ((1 << 20) - 1)) - (1 << 19)
        pos = np.arange(tm.shape[1])[None] + diag[:, None]
        inside = (pos >= 0) & (pos < hn[h][:, None]) & (np.arange(tm.shape[1])[None] < tn[t][:, None])
        same = inside & (np.take_along_axis(hm[h], np.clip(pos, 0, hm.shape[1] - 1), 1) == tm[t])
        edge = np.zeros((len(c), 1), bool)
        step = np.diff(np.concatenate([edge, same, edge], 1).astype(np.int8), axis=1)
        r0, b = np.nonzero(step == 1)
        e = np.nonzero(step == -1)[1]
        length = np.where(e - b >= depth, e - b, 0)
        matched = np.bincount(r0, length, minlength=len(c)).astype(np.int64)
        spans = np.bincount(r0, length > 0, minlength=len(c)).astype(np.int64)
        miss = np.where((diag == 0) & (tn[t] == hn[h]), tn[t] - same.sum(1), 1 << 20)
        out.append(pd.DataFrame({"t": t + s0, "h": h, "diag": diag, "matched": matched, "spans": spans, "miss": miss}))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("t", "h", "diag", "matched", "spans", "miss")})


def minimizers(text: bytes, block: int) -> np.ndarray:
    """Hashes of letter runs such that any stretch of ``block`` letters that two texts have in common gives both one of them."""
    k = block // 2 + 1
    w = block - k + 1
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(b) - k + 1
    if n < w:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(1_000_003) + b[i : i + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    best, done = h, 1
    while done < w:
        step = min(done, w - done)
        best = np.minimum(best[: len(best) - step], best[step:])
        done += step
    return np.unique(best).view(np.int64)


def _route(train: DataFrame, held: DataFrame, blocks: dict[int, int], sizes: dict[int, int], shard_chars: int) -> tuple[DataFrame, DataFrame]:
    """``shard`` for texts of bands with several shards: (band, key, n, text, shard) of both sides.

    Held texts with a common widespread minimizer are kept together (a family larger than a shard is cut by hash, small
    ones share a shard), and a training text goes only to the shards that hold one of its minimizers: texts that are
    nearly equal share one for certain.
    """

    def minis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [minimizers(t.encode(), blocks[b]) for b, t in zip(pdf["band"], pdf["text"])]
            m = [len(g) for g in got]
            yield pd.DataFrame({"band": np.repeat(pdf["band"].to_numpy(), m), "key": np.repeat(pdf["key"].to_numpy(), m), "n": np.repeat(pdf["n"].to_numpy(), m), "m": np.concatenate([*got, np.zeros(0, np.int64)])})

    def of(df: DataFrame) -> DataFrame:
        kind = df.schema["key"].dataType.simpleString()
        return df.select("band", "key", "n", "text").mapInPandas(minis, f"band int, key {kind}, n int, m bigint").withColumn("mk", F.xxhash64("band", "m")).drop("m")

    hm = materialize(of(held))
    spread = hm.groupBy("mk").agg(F.count("*").alias("c"))
    family = skew_join(hm, spread, "mk").groupBy("band", "key", "n").agg(F.max(F.struct("c", "mk"))["mk"].alias("fam"))
    family = materialize(family)
    cuts = family.groupBy("fam").agg(F.ceil(F.sum("n") / shard_chars).alias("cuts"))
    small = F.element_at(F.create_map(*[F.lit(x) for b, n in sizes.items() for x in (b, n)]), F.col("band"))
    shard = F.when(F.col("cuts") == 1, F.pmod("fam", small)).otherwise(F.xxhash64("fam", F.pmod(F.xxhash64("key"), F.col("cuts"))))
    placed = materialize(skew_join(family, cuts, "fam").select("band", "key", shard.cast("bigint").alias("shard")))
    table = hm.join(placed, ["band", "key"]).select("mk", "shard").distinct().groupBy("mk").agg(F.collect_list("shard").alias("shards"))
    sent = skew_join(materialize(of(train)), table, "mk").select("band", "key", F.explode("shards").alias("shard")).distinct()
    return train.join(sent, ["band", "key"]), held.join(placed, ["band", "key"])


def near_texts(train: DataFrame, held: DataFrame, *, share: float = 0.05, shard_chars: int = 6_000_000, chunk_chars: int = 60_000_000, band: float = 1.2) -> DataFrame:
    """Rows ``(train_key, held_key, edits, matched, spans)`` of distinct texts with edit distance at most ``share`` of the longer.

    Both inputs have ``key`` and ``text`` (key once each). Texts are put into bands by length; a training text goes to
    the bands that near-equal texts can be in. A band's held texts are cut into shards of about ``shard_chars`` letters,
    and where there are several, similar texts share one and training texts go only to those that can hold a near-equal
    one (``_route``). Every shard is indexed once, its training texts stream through the index in batches; a shard with
    very many of them is served by several tasks (of up to ``chunk_chars`` letters), each with an index of its own.
    Nulls and empty texts take no part; texts too short to be nearly equal without being equal are joined as they
    are. Equal texts come out with 0 edits. ``edits`` is an upper bound where gapless alignment already is close enough.
    """
    short = int(math.ceil((1 - share) / share))
    spark = train.sparkSession
    tk, hk = train.schema["key"].dataType.simpleString(), held.schema["key"].dataType.simpleString()
    level = lambda n: F.floor(F.log(n.cast("double")) / math.log(band)).cast("int")
    prep = lambda df: df.where(F.length("text") > 0).withColumn("n", F.octet_length("text"))
    train, held = prep(train), prep(held)
    tiny = lambda df, name: df.where(F.col("n") < short).select("text", F.col("key").alias(name), "n")
    equal = tiny(train, "train_key").join(tiny(held, "held_key").drop("n"), "text").select("train_key", "held_key", F.lit(0).cast("bigint").alias("edits"), F.col("n").cast("bigint").alias("matched"), F.lit(1).cast("bigint").alias("spans"))
    held = held.where(F.col("n") >= short).withColumn("band", level(F.col("n")))
    train = train.where(F.col("n") >= short * (1 - share) - 1e-9)
    spread = F.sequence(level(F.greatest(F.ceil(F.col("n") * (1 - share)) - 1, F.lit(1))), level(F.floor(F.col("n") / (1 - share)) + 1))
    train = train.withColumn("band", F.explode(spread))
    # one row per band, of which there are as many as powers of ``band`` up to the longest text
    bands = {r[0]: r[1:] for r in held.groupBy("band").agg(F.sum("n"), F.min("n"), F.max("n")).collect()}
    if not bands:
        return equal
    train = train.where(F.col("band").isin(list(bands)))
    many = {b: math.ceil(s / shard_chars) for b, (s, _, _) in bands.items() if s > shard_chars}
    one = ~F.col("band").isin(list(many)) if many else F.lit(True)
    t, h = (df.where(one).select("band", "key", "n", "text", F.lit(0).cast("bigint").alias("shard")) for df in (train, held))
    if many:
        blocks = {b: int(least_block(np.arange(bands[b][1], bands[b][2] + 1), share).min()) for b in many}
        rt, rh = _route(*(df.where(F.col("band").isin(list(many))) for df in (train, held)), blocks, many, shard_chars)
        t, h = t.unionByName(rt.select(*t.columns)), h.unionByName(rh.select(*h.columns))
    t, h = (materialize(df.withColumn("job", F.xxhash64("band", "shard"))) for df in (t, h))
    jobs = t.groupBy("job").agg(F.sum("n").alias("tn")).join(h.groupBy("job").agg(F.sum("n").alias("hn")), "job")
    slots = spark.sparkContext.defaultParallelism
    work = t.agg(F.sum("n")).first()[0] or 0
    # a task's batch of training letters isn't smaller than the index it needs, so that building indexes never dominates
    jobs = materialize(jobs.select("job", F.ceil(F.col("tn") / F.least(F.lit(chunk_chars), F.greatest(F.lit(work // (3 * slots)), F.col("hn"), F.lit(500_000)))).cast("int").alias("salts")))
    n_tasks = jobs.agg(F.sum("salts")).first()[0]
    if not n_tasks:
        return equal
    kt = tk if tk == hk else "string"  # one column without nulls, which would turn whole numbers into floats
    hs = h.join(jobs, "job").select("job", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("key").cast(kt).alias("key"), "text")
    ts = skew_join(t, jobs, "job").select("job", F.pmod(F.xxhash64("key", F.lit(3)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("key").cast(kt).alias("key"), "text")
    rows = hs.unionByName(ts).repartition(int(min(50_000, 2 * n_tasks)), "job", "salt").sortWithinPartitions("job", "salt", "kind", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names, texts, index = None, [], [], None
        for pdf in batches:
            place = list(zip(pdf["job"], pdf["salt"], pdf["kind"]))
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = pdf.iloc[a:b]
                if place[a][:2] != now:
                    now, names, texts, index = place[a][:2], [], [], None
                if place[a][2] == 0:
                    names.extend(part["key"])
                    texts.extend(x.encode() for x in part["text"])
                    continue
                if not texts:
                    continue
                index = index or HeldIndex(texts, share)
                m = index.matches([x.encode() for x in part["text"]])
                yield pd.DataFrame({"train_key": part["key"].to_numpy()[m["t"]], "held_key": np.array(names)[m["h"]], "edits": m["edits"], "matched": m["matched"], "spans": m["spans"]})

    found = rows.mapInPandas(run, f"train_key {kt}, held_key {kt}, edits bigint, matched bigint, spans bigint")
    return found.withColumns({"train_key": F.col("train_key").cast(tk), "held_key": F.col("held_key").cast(hk)}).unionByName(equal)


def _sides(df: DataFrame) -> Column:
    side = lambda s: F.struct(F.col(f"prot_hash_{s}").alias("p"), F.col(f"ctg_dna_hash_{s}").alias("c"), F.when(F.length(f"prot_seq_{s}") > 0, F.xxhash64(f"prot_seq_{s}")).alias("s"))
    return F.struct(side("a").alias("a"), side("b").alias("b"))


def _class_pairs(pairs: DataFrame, train: str, held: tuple[str, ...], share: float) -> tuple[DataFrame, DataFrame]:
    """``side`` (pair_row_id, part 't' or 'h', cls) and ``met`` (t, h, exact): classes of rows with the same two sides, and those that meet."""
    rows = pairs.where(F.col("split_name").isin(train, *held)).select("pair_row_id", F.when(F.col("split_name") == train, F.lit("t")).otherwise(F.lit("h")).alias("part"), _sides(pairs).alias("x"), "prot_seq_a", "prot_seq_b")
    rows = rows.withColumn("cls", F.xxhash64("x.a.p", "x.a.c", "x.a.s", "x.b.p", "x.b.c", "x.b.s", F.concat_ws("\x1f", *[F.col(f"x.{a}.{b}").isNull().cast("string") for a in "ab" for b in "pcs"])))
    side = materialize(rows.select("pair_row_id", "part", "x", "cls"))
    seqs = (
        rows.select("part", F.explode(F.array(*[F.struct(F.col(f"x.{s}.s").alias("key"), F.col(f"prot_seq_{s}").alias("text")) for s in "ab"])).alias("v"))
        .where("v.key is not null")
        .groupBy("part", F.col("v.key").alias("key"))
        .agg(F.min("v.text").alias("text"))
    )
    seqs = materialize(seqs)
    near = near_texts(seqs.where("part = 't'").drop("part"), seqs.where("part = 'h'").drop("part"), share=share).where("train_key <> held_key").select("train_key", "held_key")
    near = materialize(near)  # equal sequences need no search: they have one key
    cls = materialize(side.groupBy("part", "cls").agg(F.first("x").alias("x")))

    named = lambda k, s: F.when(F.col(f"x.{s}.{k}").isNotNull(), F.xxhash64(F.lit(k), F.col(f"x.{s}.{k}")))
    own = lambda s: F.filter(F.array(*[F.struct(named(k, s).alias("k"), F.lit(k != "s").alias("e")) for k in "pcs"]), lambda v: v["k"].isNotNull())
    t = cls.where("part = 't'").select(F.col("cls").alias("t"), F.explode(own("a")).alias("l"), own("b").alias("kb")).select("t", F.col("l.k").alias("l"), F.explode("kb").alias("r")).select("t", F.xxhash64("l", "r.k").alias("lr"))
    h = cls.where("part = 'h'").select(F.col("cls").alias("h"), own("a").alias("ka"), own("b").alias("kb"), F.col("x.a.s").alias("sa"), F.col("x.b.s").alias("sb"))
    both = lambda df: df.select("h", F.explode(F.array(F.xxhash64("l.k", "r.k"), F.xxhash64("r.k", "l.k"))).alias("lr"), (F.col("l.e") & F.col("r.e")).alias("exact"))
    keys = both(h.select("h", F.explode("ka").alias("l"), "kb").select("h", "l", F.explode("kb").alias("r")))
    # one side by name, the other nearly equal: as many keys as that side has near-equals
    for s, o in (("a", "b"), ("b", "a")):
        close = spread_join(h.select("h", f"k{o}", F.col(f"s{s}").alias("held_key")), near, "held_key")
        keys = keys.unionByName(both(close.select("h", F.struct(F.xxhash64(F.lit("s"), F.col("train_key")).alias("k"), F.lit(False).alias("e")).alias("l"), F.explode(f"k{o}").alias("r"))))
    named_met = spread_join(keys.distinct(), materialize(t), "lr").groupBy("t", "h").agg(F.max("exact").alias("exact"))

    # both sides nearly equal: candidates come from the side that offers fewer, the other side is looked up in the near matches
    ends = lambda part: cls.where(F.col("part") == part).select("cls", F.col("x.a.s").alias("sa"), F.col("x.b.s").alias("sb")).where("sa is not null and sb is not null")
    turned = ends("t").select("sa", "sb").unionByName(ends("t").select(F.col("sb").alias("sa"), F.col("sa").alias("sb"))).distinct()
    turned = materialize(turned.select(F.col("sa").alias("t1"), F.col("sb").alias("t2")))
    offer = skew_join(near, turned.groupBy(F.col("t1").alias("train_key")).agg(F.count("*").alias("d")), "train_key", at_most=rows_of(near)).groupBy("held_key").agg(F.sum("d").alias("w"))
    offer = materialize(offer)
    asks = materialize(ends("h").select("sa", "sb").distinct())
    n_asks = rows_of(asks)
    for s in "ab":
        asks = skew_join(asks, offer.select(F.col("held_key").alias(f"s{s}"), F.col("w").alias(f"w{s}")), f"s{s}", at_most=n_asks)
    first = F.col("wa") <= F.col("wb")
    asks = materialize(asks.select("sa", "sb", F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("held_key"), F.when(first, F.col("sb")).otherwise(F.col("sa")).alias("other"), first.alias("first")))
    tried = spread_join(spread_join(asks, near, "held_key").withColumnRenamed("train_key", "t1"), turned, "t1")
    tried = tried.select("sa", "sb", F.xxhash64("other", "t2").alias("q"), F.when(F.col("first"), F.col("t1")).otherwise(F.col("t2")).alias("ta"), F.when(F.col("first"), F.col("t2")).otherwise(F.col("t1")).alias("tb"))
    good = skew_join(materialize(tried), near.select(F.xxhash64("held_key", "train_key").alias("q")), "q").select(F.xxhash64("sa", "sb").alias("hs"), F.xxhash64("ta", "tb").alias("ts")).distinct()
    of_h = ends("h").select(F.xxhash64("sa", "sb").alias("hs"), F.col("cls").alias("h"))
    of_t = ends("t").select(F.explode(F.array_distinct(F.array(F.xxhash64("sa", "sb"), F.xxhash64("sb", "sa")))).alias("ts"), F.col("cls").alias("t"))
    near_met = spread_join(spread_join(materialize(good), of_h, "hs", at_most=rows_of(cls)), of_t, "ts", at_most=2 * rows_of(cls)).select("t", "h", F.lit(False).alias("exact"))
    met = materialize(named_met.unionByName(near_met).groupBy("t", "h").agg(F.max("exact").alias("exact")))
    return side, met


def cross_split_pairs(pairs: DataFrame, *, train: str = "train", held: tuple[str, ...] = ("val", "test"), share: float = 0.05) -> DataFrame:
    """Rows ``(train_row, held_row, exact)``: a training row and a held-out row whose two sides equal or nearly equal each other, in either order.

    Sides are equal if ``prot_hash`` or ``ctg_dna_hash`` agree (null agrees with nothing) and nearly equal if the edit
    distance of ``prot_seq`` is at most ``share`` of the longer. ``exact`` tells pairs whose both sides agree by hash.

    Rows with the same two sides are one class. Distinct sequences are matched by ``near_texts``. Keys that a side goes by
    (hashes, own sequence) make, with the other side's, a composite key; with one side nearly equal there are as many
    as it has near-equals. Where both sides are only nearly equal, candidates come from the side that offers fewer
    training pairs and are looked up by the other: the product of two sets of near-equals is never built. A hot
    sequence alone joins nothing. Class pairs are expanded to rows at the end, hot classes in chunks.
    """
    side, met = _class_pairs(pairs, train, held, share)
    n = rows_of(side)
    of = lambda p, c, n: side.where(F.col("part") == p).select(F.col("cls").alias(c), F.col("pair_row_id").alias(n))
    return spread_join(spread_join(met, of("t", "t", "train_row"), "t", at_most=n), of("h", "h", "held_row"), "h", at_most=n).select("train_row", "held_row", "exact")


def overlap_report(pairs: DataFrame, *, train: str = "train", held: tuple[str, ...] = ("val", "test"), share: float = 0.05) -> DataFrame:
    """Per ``split_name`` and ``source`` of the held-out rows: ``n_rows``, ``n_overlapping``, ``n_exact``, ``n_train_rows`` and the overlapping share.

    Training rows are counted by the sizes of their classes; no pair of rows is made.
    """
    side, met = _class_pairs(pairs, train, held, share)
    size = side.where("part = 't'").groupBy(F.col("cls").alias("t")).agg(F.count("*").alias("k"))
    found = met.join(size, "t").groupBy(F.col("h").alias("cls")).agg(F.max("exact").alias("exact"), F.sum("k").alias("n"))
    rows = pairs.where(F.col("split_name").isin(*held)).select("pair_row_id", "split_name", "source")
    rows = rows.join(side.where("part = 'h'").select("pair_row_id", "cls"), "pair_row_id")
    return (
        skew_join(materialize(rows), found, "cls", "left")
        .groupBy("split_name", "source")
        .agg(F.count("*").alias("n_rows"), F.count("n").alias("n_overlapping"), F.count_if(F.coalesce("exact", F.lit(False))).alias("n_exact"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_train_rows"))
        .withColumn("overlapping_share", F.col("n_overlapping") / F.col("n_rows"))
    )
