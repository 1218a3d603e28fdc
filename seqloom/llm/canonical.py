"""Free-entered values to a canonical list: token repair by edit distance, then soft TF-IDF over complete entries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import materialize, skew_join

MAX_EDITS = 2
ABBREVIATED = 0.75  # similarity of an abbreviation; a repaired token that scores less counts as one
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def tokens_of(text: str) -> list[str]:
    """Runs of letters and runs of digits, without marks and case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return _TOKEN.findall(plain)


def edit_limit(length: int) -> int:
    """Edits tolerated in a vocabulary token of ``length``: none below 3 letters, one below 5, else two."""
    return 0 if length < 3 else 1 if length < 5 else MAX_EDITS


def deletions(token: str, edits: int) -> set[str]:
    """``token`` and all that is left of it after up to ``edits`` deletions: tokens within that distance share one."""
    out, last = {token}, {token}
    for _ in range(edits):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t)) if len(t) > 1}
        out |= last
    return out


def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours."""
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            now.append(v)
        prev2, prev = prev, now
    return prev[-1]


def _abbreviates(short: str, full: str) -> bool:
    it = iter(full)
    return len(short) <= 4 and len(short) < len(full) and short[0] == full[0] and all(c in it for c in short)


def token_similarity(token: str, term: str) -> float:
    """1 for equal tokens, less for a repaired one, 0.75 for an abbreviation, 0 for none. Numbers are equal or nothing."""
    if token == term:
        return 1.0
    if token.isdigit() or term.isdigit():
        return 0.0
    best = 0.0
    if abs(len(token) - len(term)) <= MAX_EDITS:
        d = edit_distance(token, term)
        if d <= edit_limit(len(term)):
            best = 1 - d / (len(term) + 1) - (0.02 if token[0] != term[0] else 0.0)
    return max(best, ABBREVIATED) if _abbreviates(token, term) else best


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds tokens, the digits in order of size and the letters run together."""
    for pdf in batches:
        t = [tokens_of(v) for v in pdf["value"]]
        yield pdf.assign(tokens=t, digits=[" ".join(sorted(x for x in v if x.isdigit())) for v in t], whole=["".join(x for x in v if not x.isdigit()) for v in t])


def _grams(limit):
    """Adds a row per deletion key of every token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(g=[[] if t.isdigit() else sorted(deletions(t, limit(len(t)))) for t in pdf["token"]]).explode("g").dropna(subset=["g"])

    return run


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(sim=[token_similarity(a, b) for a, b in zip(pdf["token"], pdf["term"])])


def _repairs(tokens: DataFrame, vocabulary: DataFrame, *, short: bool) -> DataFrame:
    """(field, token, term, sim) of all tokens that are, repair to or abbreviate a vocabulary term of their field."""
    equal = tokens.join(vocabulary.withColumnRenamed("token", "term"), (tokens["field"] == vocabulary["field"]) & (tokens["token"] == F.col("term"))).select(tokens["field"], "token", "term")
    a = tokens.mapInPandas(_grams(lambda n: MAX_EDITS), "field string, token string, g string")
    b = vocabulary.mapInPandas(_grams(edit_limit), "field string, token string, g string").withColumnRenamed("token", "term")
    pairs = equal.unionByName(a.join(b, ["field", "g"]).select("field", "token", "term"))
    if short:
        f = lambda df, c: df.withColumn("f", F.substring(c, 1, 1))
        v = f(vocabulary.withColumnRenamed("token", "term"), "term")
        # an abbreviation has its first two letters in the term: the second anywhere behind the first
        later = F.array_append(F.filter(F.array_distinct(F.split(F.substring("term", 2, 10_000), "")), lambda c: c != ""), F.lit(""))
        v = v.withColumn("g", F.explode(later))
        s = f(tokens.where((F.char_length("token") <= 4) & ~F.col("token").rlike(r"^\d")), "token").withColumn("g", F.substring("token", 2, 1))
        pairs = pairs.unionByName(s.join(v, ["field", "f", "g"]).where(F.char_length("term") > F.char_length("token")).select("field", "token", "term"))
    # a swap of neighbours is two of the edits counted here, so nothing that repairs is beyond twice the limit
    fit = (F.levenshtein("token", "term", 2 * MAX_EDITS) >= 0) | ((F.char_length("token") <= 4) & F.lit(short))
    return pairs.where(fit).distinct().mapInPandas(_score, "field string, token string, term string, sim double").where("sim > 0")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Soft TF-IDF of a value and an entry whose tokens all found one of the value's own; else null."""
    for pdf in batches:
        out = []
        for links, weights, n_value in zip(pdf["links"], pdf["weights"], pdf["n_value"]):
            used, dot, norm_v, sure = set(), 0.0, 0.0, False
            for k, w in enumerate(weights):
                best = max(((x["sim"], -x["pos"]) for x in links if x["k"] == k and x["pos"] not in used), default=None)
                if best is None:
                    break
                used.add(-best[1])
                sure |= best[0] > ABBREVIATED
                dot += w * w * best[0]
                norm_v += w * w
            else:
                mean = sum(w * w for w in weights)
                # tokens of the value that the entry doesn't have are qualifiers and weigh little
                norm_v += (n_value - len(used)) * 0.02 * mean
                out.append(dot / (mean**0.5 * norm_v**0.5) if sure else None)
                continue
            out.append(None)
        yield pdf.assign(score=pd.Series(out, dtype="float64")).drop(columns=["links", "weights", "n_value"])


def map_to_canonical(values: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(field, value, term_id, matched_name, score)`` for the distinct non-blank values of ``values (field, value)``.

    ``terms`` has ``term_id, field_name, term, also_known_as``. A value means an entry if every token of the entry's
    term or of one of its other names is found among the value's own: equal, within the edit limit of its length, or
    abbreviated to up to four letters from the same start, but one token at least must be more than abbreviated: letters
    alone name nothing. Order, case, marks, punctuation and further tokens don't
    matter; numbers must be equal, and where a name holds numbers the value may hold no others. Names written without
    gaps are repaired as a whole. ``term_id`` is 0 where nothing fits.

    Distinct tokens, not rows, meet the vocabulary, by an equi-join on shared deletion keys. The repaired tokens
    are combined per value and entry by soft TF-IDF; of several entries the best score wins, then the one with more
    tokens, then the smaller id. Null and blank values are left out, an empty list maps all to 0.
    """
    named = terms.where("term_id is not null and field_name is not null").select(
        "term_id", F.col("field_name").alias("field"), F.explode(F.array_union(F.array("term"), F.coalesce("also_known_as", F.array().cast("array<string>")))).alias("value")
    )
    cols = "tokens array<string>, digits string, whole string"
    names = named.where(r"value rlike '\\S'").distinct().mapInPandas(_split, f"term_id bigint, field string, value string, {cols}").where("size(tokens) > 0")
    names = materialize(names.withColumn("name_id", F.xxhash64("field", "term_id", "value")))
    longest = names.agg(F.max(F.char_length("whole")), F.max(F.size("tokens"))).first()
    base = materialize(values.where(r"field is not null and value rlike '\\S'").select("field", "value").distinct().mapInPandas(_split, f"field string, value string, {cols}").withColumn("value_id", F.xxhash64("field", "value")))
    most = (longest[0] or 0) + MAX_EDITS  # a longer token is further than MAX_EDITS from every name

    n_names = names.groupBy("field").agg(F.count("*").alias("n"))
    ntok = names.select("field", "name_id", F.posexplode("tokens").alias("k", "term"))
    idf = ntok.groupBy("field", "term").agg(F.count_distinct("name_id").alias("df")).join(n_names, "field").select("field", "term", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    ntok = materialize(ntok.join(idf, ["field", "term"]))
    weights = ntok.groupBy("name_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("weights"))

    vtok = base.select("field", "value_id", F.posexplode("tokens").alias("pos", "token")).where(F.char_length("token") <= most)
    vtok = materialize(vtok)
    repairs = materialize(_repairs(vtok.select("field", "token").distinct(), ntok.select("field", F.col("term").alias("token")).distinct(), short=True))
    # a token that repairs to nothing gives no row; what is left is joined per value and entry
    hit = skew_join(vtok.withColumn("tk", F.concat_ws("\x1f", "field", "token")), repairs.groupBy(F.concat_ws("\x1f", "field", "token").alias("tk")).agg(F.collect_list(F.struct("term", "sim")).alias("r")), "tk")
    hit = hit.select("field", "value_id", "pos", F.explode("r").alias("r")).select("field", "value_id", "pos", F.col("r.term").alias("term"), F.col("r.sim").alias("sim"))
    cand = hit.join(ntok.select("field", "term", "name_id", "k"), ["field", "term"]).groupBy("value_id", "name_id").agg(F.collect_list(F.struct("k", "pos", "sim")).alias("links"), F.count_distinct("k").alias("nk"))
    cand = cand.join(weights, "name_id").where(F.col("nk") == F.size("weights"))
    meta_v = base.select("value_id", F.col("digits").alias("dv"), F.size("tokens").alias("n_value"))
    meta_n = names.select("name_id", "term_id", F.col("value").alias("matched_name"), F.col("digits").alias("dn"), F.size("tokens").alias("n_name"))
    same_numbers = (F.col("dn") == "") | (F.col("dn") == F.col("dv"))
    by_token = (
        cand.join(meta_v, "value_id")
        .join(meta_n, "name_id")
        .where(same_numbers)
        .select("value_id", "term_id", "matched_name", "n_name", "links", "weights", "n_value")
        .mapInPandas(_combine, "value_id bigint, term_id bigint, matched_name string, n_name int, score double")
        .where("score is not null")
    )

    least = 5
    whole_v = base.where(F.char_length("whole").between(least - MAX_EDITS, most)).select("field", "value_id", F.col("whole").alias("token"), F.col("digits").alias("dv"))
    whole_n = names.where(F.char_length("whole") >= least).select("field", "name_id", F.col("whole").alias("term"))
    whole = _repairs(whole_v.select("field", "token").distinct(), whole_n.select("field", F.col("term").alias("token")).distinct(), short=False).where("sim > 0.75 or char_length(term) <= 8")
    by_whole = (
        whole_v.join(whole, ["field", "token"]).join(whole_n, ["field", "term"]).join(meta_n, "name_id").where(same_numbers).select("value_id", "term_id", "matched_name", "n_name", (F.col("sim") - 0.02).alias("score"))
    )
    rank = W.partitionBy("value_id").orderBy(F.desc(F.round("score", 9)), F.desc("n_name"), "term_id", "matched_name")
    best = by_token.unionByName(by_whole).withColumn("r", F.row_number().over(rank)).where("r = 1")
    return base.join(best.select("value_id", "term_id", "matched_name", "score"), "value_id", "left").select("field", "value", F.coalesce("term_id", F.lit(0)).cast("bigint").alias("term_id"), "matched_name", "score")


def canonical_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows ``(key, field, value, term_id)`` for ``rows (key, field, value)``: entries of values that aren't literally a term of their field.

    Distinct values are mapped and joined back; a value in a third of all rows is joined apart from the others.
    """
    literal = terms.select(F.col("field_name").alias("field"), F.col("term").alias("value")).where("value is not null").distinct()
    rows = materialize(rows.where(r"field is not null and value rlike '\\S'").select("key", "field", "value"))
    mapped = map_to_canonical(rows.join(literal, ["field", "value"], "left_anti"), terms)
    k = F.concat_ws("\x1f", "field", "value").alias("vk")
    return skew_join(rows.select("*", k), materialize(mapped.select(k, "term_id")), "vk").select("key", "field", "value", "term_id")
