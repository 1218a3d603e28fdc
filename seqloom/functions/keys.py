"""Keys, hashes, labels and subtype parts (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_key(a: Name, b: Name) -> Column:
    """Both hashes in code point order, joined by '__'; null if either is null."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("__", F.least(a, b), F.greatest(a, b)))


def sequence_hash(seq: Name) -> Column:
    """md5 of the sequence as it stands."""
    return F.md5(_c(seq))


def clustering_sequence(seq: Name, alphabet: str = "aa") -> Column:
    """P5: aa without its trailing stops; an aa with a stop inside raises when read. Other alphabets pass through."""
    s = _c(seq)
    if alphabet != "aa":
        return s
    out = F.regexp_replace(s, r"\*+$", "")
    return F.when(F.contains(out, F.lit("*")), F.raise_error(F.lit("internal stop in a sequence to cluster"))).otherwise(out)


def threshold_label(t: Name) -> Column:
    """0.95 -> 't095'."""
    return F.concat(F.lit("t"), F.lpad(F.bround(_c(t) * 100).cast("int").cast("string"), 3, "0"))


def threshold_value(label: Name) -> Column:
    """P29 back: 't095' -> 0.95; anything else is null."""
    return F.when(_c(label).rlike(r"^t\d{3}$"), F.substring(_c(label), 2, 3).cast("int") / 100)


def h_part(subtype: Name) -> Column:
    """P30: 'H3N2' -> 'H3'; null where there is none."""
    return F.nullif(F.regexp_extract(_c(subtype), r"^(H\d+)", 1), F.lit(""))


def n_part(subtype: Name) -> Column:
    return F.nullif(F.regexp_extract(_c(subtype), r"^(?:H\d+)?(N\d+)$", 1), F.lit(""))


def is_full_subtype(subtype: Name) -> Column:
    """Both parts are given; null fails."""
    return F.coalesce(_c(subtype).rlike(r"^H\d+N\d+$"), F.lit(False))


def canonical_subtype(subtype: Name) -> Column:
    """Anything but HxNy is 'unknown'."""
    return F.when(is_full_subtype(subtype), _c(subtype)).otherwise(F.lit("unknown"))


def seed_number(seed: int, name: str) -> int:
    """A process's own seed, from the first 8 hex digits of an md5."""
    import hashlib

    return int(hashlib.md5(f"{seed}_{name}".encode()).hexdigest()[:8], 16)


def order_key(seed: int, *keys: Name) -> Column:
    """The deterministic order that replaces every seeded shuffle: md5 of the seed and a stable key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_c(k).cast("string"), F.lit("")) for k in keys]))


def assembly_parts(name: Name) -> Column:
    """(prefix, id) of 'GCA_000001.2...' or (null, stem) of a plain '<stem>.gto' without a dot inside; else both null."""
    n = _c(name)
    part = lambda p, g: F.nullif(F.regexp_extract(n, p, g), F.lit(""))
    gc = r"(GCA|GCF)_(\d+\.\d+)"
    return F.struct(part(gc, 1).alias("assembly_prefix"), F.coalesce(part(gc, 2), part(r"^(\w+)\.gto", 1)).alias("assembly_id"))
