"""Metadata cells, regimes, name parsing and place names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import AXES, REGIMES, YEAR_BINS
from .keys import Name, _c


def bin_year(year: Name, bins=YEAR_BINS) -> Column:
    """Label of the first inclusive bin; null for null and for years outside all."""
    y, out = _c(year), None
    for lo, hi, label in bins:
        cond = y.isNotNull()
        if lo is not None:
            cond &= y >= lo
        if hi is not None:
            cond &= y <= hi
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if out is not None else F.lit(None).cast("string")


def isolate_cells(meta: DataFrame, *, bins=YEAR_BINS, year_match: str = "bin") -> DataFrame:
    """(assembly_id, cell) with cell = (host, hn_subtype, year); years binned or, with 'exact', as they are."""
    year = bin_year("year", bins) if year_match == "bin" else F.col("year").cast("string")
    return meta.select(F.col("assembly_id").cast("string").alias("assembly_id"), F.struct(F.col("host"), F.col("hn_subtype"), year.alias("year")).alias("cell"))


def axis_match(a: Column, b: Column) -> Column:
    """Both known and equal; never null."""
    return F.coalesce(a == b, F.lit(False))


def regime(a: Name, b: Name) -> Column:
    """Name of the combination of axes on which two cells agree; null agrees with nothing."""
    a, b = _c(a), _c(b)
    host, sub, year = (axis_match(a[x], b[x]) for x in AXES)
    named = {(0, 0, 0): REGIMES[0], (1, 0, 0): REGIMES[1], (0, 1, 0): REGIMES[2], (0, 0, 1): REGIMES[3], (1, 1, 0): REGIMES[4], (1, 0, 1): REGIMES[5], (0, 1, 1): REGIMES[6], (1, 1, 1): REGIMES[7]}
    code = host.cast("int") * 4 + sub.cast("int") * 2 + year.cast("int")
    names = [None] * 8
    for (h, s, y), n in named.items():
        names[4 * h + 2 * s + y] = n
    return F.element_at(F.array(*[F.lit(n) for n in names]), code + 1)


def match_count(a: Name, b: Name) -> Column:
    """On how many axes two cells agree."""
    a, b = _c(a), _c(b)
    return sum((axis_match(a[x], b[x]).cast("int") for x in AXES), F.lit(0))


def axis_flags(pairs: DataFrame, meta: DataFrame, axes=AXES, key: str = "assembly_id") -> DataFrame:
    """P20: adds ``<axis>_a``, ``<axis>_b`` and nullable ``same_<axis>``, looked up by isolate.

    ``meta`` may have several rows per isolate: each axis takes its smallest non-null value. Names that the pairs
    already have are replaced.
    """
    one = meta.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(a).alias(a) for a in axes])
    out = pairs.drop(*[f"{a}_{s}" for a in axes for s in "ab"], *[f"same_{a}" for a in axes])
    for s in "ab":
        out = out.join(one.select(F.col(key).alias(f"{key}_{s}"), *[F.col(a).alias(f"{a}_{s}") for a in axes]), f"{key}_{s}", "left")
    return out.select("*", *[(F.col(f"{a}_a") == F.col(f"{a}_b")).alias(f"same_{a}") for a in axes])


def stored_or_derived_regime(label: Name, stored: Name, derived: Name) -> Column:
    """P28: 'positive' for label 1, else the stored regime and, where there is none, the derived one."""
    return F.when(_c(label) == 1, F.lit("positive")).otherwise(F.coalesce(_c(stored), _c(derived)))


def title_case(text: Name) -> Column:
    """Upper case after every non-letter, hyphens included; the rest lower."""
    return F.array_join(F.transform(F.split(F.lower(_c(text)), r"(?<=[^\p{L}])|(?=[^\p{L}])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def clean_host(host: Name) -> Column:
    """Trimmed; blank and 'null' are null; human in any case is 'Human'; all-lower names get title case."""
    h = F.trim(_c(host))
    return F.when((h == "") | (F.lower(h) == "null"), None).when(F.lower(h) == "human", "Human").when(h == F.lower(h), title_case(h)).otherwise(h)


def top_n_or_other(df: DataFrame, col: str, n: int, other: str = "other") -> DataFrame:
    """Values outside the ``n`` most frequent (ties by value) become ``other``; null stays null."""
    top = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(n).select(col, F.lit(True).alias("_top"))
    return df.join(F.broadcast(top), col, "left").withColumn(col, F.when(F.col(col).isNull() | F.col("_top"), F.col(col)).otherwise(F.lit(other))).drop("_top")


def categories_with_others(df: DataFrame, col: str, *, min_share: float = 0.01, cap: int = 10, other: str = "Others") -> DataFrame:
    """(category, n, share) of values with at least ``min_share`` of the rows, at most ``cap`` of them, the rest as one."""
    from pyspark.sql import Window as W

    n = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("category")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(F.desc("n"), "category"))  # one row per distinct value
    named = n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy())).withColumn("rank", rank)
    keep = (F.col("share") >= min_share) & (F.col("rank") <= cap)
    return named.groupBy(F.when(keep, F.col("category")).otherwise(F.lit(other)).alias("category")).agg(F.sum("n").alias("n"), F.sum("share").alias("share"))


#: Words that mark a part of a strain name as a host (a parameter; these are the defaults).
HOST_WORDS = ("chicken", "duck", "goose", "swine", "turkey", "quail", "gull", "teal", "mallard", "tern", "pigeon", "horse", "equine", "dog", "canine", "cat", "feline", "seal", "mink", "cattle", "bat", "camel", "owl", "swan", "falcon", "pheasant", "ferret", "swallow", "sandpiper", "guineafowl", "ostrich", "pochard", "water", "environment")


def parse_name(name: str | None, host_words=HOST_WORDS) -> tuple[str | None, str | None, int | None, str | None]:
    """(host, location, year, strain) of 'A/[host/]location/strain/year', with or without a prefix or a subtype.

    The year is the right-most four-digit part from 1900 to 2030, the strain the part before it. The first part is a host
    if it has one of ``host_words`` or starts in lower case with several words; otherwise the name has none.
    """
    import re

    if not name or "A/" not in name:
        return None, None, None, None
    m = re.search(r"\(A/(.*)\)", name)
    core = m.group(1) if m else name.split("A/", 1)[1]
    parts = [p.strip() for p in re.sub(r"\([^()]*\)?\s*$", "", core).split("/") if p.strip()]
    at = next((i for i in range(len(parts) - 1, -1, -1) if re.fullmatch(r"\d{4}", parts[i]) and 1900 <= int(parts[i]) <= 2030), None)
    year = int(parts[at]) if at is not None else None
    strain = parts[at - 1] if at else None
    lead = parts[: max(0, at - 1)] if at is not None else parts
    host = None
    if lead:
        words = re.split(r"[\s\-_]+", lead[0].lower())
        if any(w in host_words for w in words) or (" " in lead[0] and lead[0][:1].islower()):
            host, lead = lead[0], lead[1:]
    location = lead[0] if lead and lead[0].lower() not in ("environment", "unknown", "na", "n/a", "none", "human") else None
    return host, location, year, strain


def parse_names(df: DataFrame, key: str, name: str, host_words=HOST_WORDS) -> DataFrame:
    """P21 on a table: (key, host, location, year, strain), each distinct name parsed once and joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(n, *parse_name(n, host_words)) for n in pdf["n"]]
            out = pd.DataFrame(got, columns=["n", "host", "location", "year", "strain"])
            yield out.assign(year=out["year"].astype("Int32"))

    names = df.select(F.col(name).alias("n")).where("n is not null").distinct().mapInPandas(run, "n string, host string, location string, year int, strain string")
    return df.select(F.col(key), F.col(name).alias("n")).join(names, "n", "left").select(key, "host", "location", "year", "strain")


def standardize_location(df: DataFrame, col: str, gazetteer: DataFrame) -> DataFrame:
    """Adds ``clean, city, state, country, reject_reason`` from a gazetteer (alias, city, state, country; a parameter table).

    Values are compared without case, marks of punctuation and repeated blanks; a value may be one alias or 'alias, more'.
    Blank values, values without a letter and unknown ones are rejected with the reason. Distinct values meet the
    gazetteer, of which the smallest row per alias counts.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Punct}]+", " "))
    g = gazetteer.select(norm(F.col("alias")).alias("_k"), "city", "state", "country").groupBy("_k").agg(F.min(F.struct("city", "state", "country")).alias("g"))
    values = df.select(F.col(col).alias("_v")).distinct().select("_v", norm(F.col("_v")).alias("_k"), norm(F.split("_v", ",")[0]).alias("_h"))
    head = g.select(F.col("_k").alias("_h"), F.col("g").alias("g2"))
    found = values.join(g, "_k", "left").join(head, "_h", "left").select("_v", "_k", F.coalesce("g", "g2").alias("g"))
    reason = F.when(F.coalesce(F.col("_k"), F.lit("")) == "", "blank").when(~F.col("_k").rlike(r"\p{L}"), "no_letters").when(F.col("g").isNull(), "unknown")
    found = found.select("_v", "g.*", reason.alias("reject_reason"))
    out = df.join(found, F.col(col).eqNullSafe(F.col("_v")), "left").drop("_v")
    return out.withColumn("clean", F.when(F.col("reject_reason").isNull(), F.concat_ws(", ", "city", "state", "country")))


def select_location(mode: str) -> Column:
    """Which part of a standardised place to use: canonical, city, state, country, or auto (the finest one known)."""
    auto = F.coalesce("city", "state", "country")
    return {"canonical": F.col("clean"), "city": F.col("city"), "state": F.col("state"), "country": F.col("country"), "auto": auto}[mode]
