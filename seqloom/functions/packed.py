"""Several values packed in one field: a parsing expression grammar with ordered alternatives and backtracking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A rule takes (text, position) and gives (value, next position) or None; it never looks behind its own position.
Rule = Callable[[str, int], "tuple | None"]


def term(pattern: str) -> Rule:
    """A terminal given as a regular expression."""
    rx = re.compile(pattern)

    def rule(s: str, p: int):
        m = rx.match(s, p)
        return (m.group(), m.end()) if m else None

    return rule


def seq(*rules: Rule) -> Rule:
    """All of ``rules`` one after the other, or nothing: the position goes back on failure."""

    def rule(s: str, p: int):
        got = []
        for r in rules:
            x = r(s, p)
            if x is None:
                return None
            got.append(x[0])
            p = x[1]
        return got, p

    return rule


def choice(*rules: Rule) -> Rule:
    """The first of ``rules`` that matches (ordered choice)."""

    def rule(s: str, p: int):
        for r in rules:
            x = r(s, p)
            if x is not None:
                return x
        return None

    return rule


def ahead(r: Rule) -> Rule:
    """Matches where ``r`` does, without consuming anything."""
    return lambda s, p: None if r(s, p) is None else ("", p)


def act(r: Rule, f: Callable) -> Rule:
    """``r`` with its value changed."""

    def rule(s: str, p: int):
        x = r(s, p)
        return None if x is None else (f(x[0]), x[1])

    return rule


def inside(a: str, b: str) -> Rule:
    """Everything up to the bracket ``b`` that closes the one before; brackets within must pair, and the first can't be ``a`` again."""

    def rule(s: str, p: int):
        if s[p:].lstrip()[:1] == a:
            return None
        depth, q = 0, p
        while q < len(s):
            if s[q] == a:
                depth += 1
            elif s[q] == b:
                if not depth:
                    return s[p:q], q
                depth -= 1
            q += 1
        return None

    return rule


class PackedGrammar:
    """field <- bracketed / list ; bracketed <- open list close end ; list <- (delimiters / item)* end ; item <- quoted / bare.

    Brackets are those around the whole field; a bracketed part of it belongs to its value.

    ``start`` is the pattern a bare value begins with, ``bare`` (optional) the pattern of a complete bare value.
    ``delimiters`` separate values only where the rest of the field goes on with a value, an opening quote, a further
    delimiter or its end; anywhere else they belong to the value (``loose``: spaces alone may separate too).

    A quoted value ends at a quote that is followed by a delimiter or the end; a doubled quote stands for one. Where
    no such quote follows, the alternative fails, the parser goes back and reads the quote as part of a bare value
    (flag ``bad_quote``).
    """

    def __init__(self, start: str, delimiters: str, *, bare: str | None = None, loose: bool = False) -> None:
        sp = r"[\s ]*"
        delim = rf"(?:{sp}(?:{delimiters}))+{sp}|{sp}\Z" + (r"|[\s ]+" if loose else "")
        opens = rf"[\[({{]*['\"]?{start}"
        self.gap = term(rf"(?:{sp}(?:{delimiters}))+{sp}" + (rf"|[\s ]+" if loose else ""))
        after = term(delim)
        stop = seq(after, choice(term(r"\Z"), ahead(term(opens)), ahead(term(r"['\"]"))))
        quoted = [
            act(seq(term(q), term(rf"(?:[^{q}]|{q}{q})*"), term(q), ahead(after)), lambda x, q=q: (x[1].replace(q + q, q).strip(), "quoted"))
            for q in ('"', "'")
        ]
        end = seq(stop)

        def bare_rule(s: str, p: int):
            q = p + 1
            while q < len(s) and end(s, q) is None:
                q += 1
            return (s[p:q].strip(), "bare"), q

        alternatives = [*quoted]
        if bare:
            alternatives.append(act(seq(term(bare), ahead(after)), lambda x: (x[0].strip(), "bare")))
        self.item = choice(*alternatives, bare_rule)
        bracketed = [act(seq(term(rf"\s*{re.escape(a)}"), inside(a, b), term(rf"{re.escape(b)}\s*\Z")), lambda x: (x[1], "bracketed")) for a, b in ("[]", "{}", "()", "<>")]
        self.field = choice(*bracketed, lambda s, p: ((s[p:], None), len(s)))

    def parse(self, text: str) -> list[tuple[int, str, str, str | None]]:
        """(position from 1, value, kind, error or None) of every value of the field; blank pieces are no values."""
        s, kind0 = self.field(text, 0)[0]
        out, p = [], 0
        while p < len(s):
            g = self.gap(s, p)
            if g is not None and g[1] > p:
                p = g[1]
                continue
            ws = re.compile(r"[\s ]+").match(s, p)
            if ws:
                p = ws.end()
                continue
            (value, kind), q = self.item(s, p)
            error = "bad_quote" if kind == "bare" and value[:1] in "'\"" else None
            if error:
                value = value.strip(value[:1] + " \t")
            if value:
                out.append((len(out) + 1, value, kind0 or kind, error))
            p = max(q, p + 1)
        return out


def strain_grammar() -> PackedGrammar:
    """Strain names start with 'A/' or 'Influenza A virus'; they may hold any delimiter themselves."""
    return PackedGrammar(r"(?:A/|Influenza A virus)", r";|\||,|\t|\n|\r|//|/|&|\+")


def accession_grammar() -> PackedGrammar:
    """Accessions have letters, digits and a dot only, so any delimiter or space ends them."""
    return PackedGrammar(r"[A-Za-z0-9.]", r";|\||,|\t|\n|\r|/|&|\+", bare=r"[A-Za-z0-9.]+", loose=True)


def unpack(df: DataFrame, key: str, field: str, grammar: Callable[[], PackedGrammar], *, simple: str | None = None, least_items: int = 1) -> DataFrame:
    """Rows ``(key, field_name, item_pos, item_value, item_kind, item_error)``: every value of a packed field.

    ``simple`` is a pattern of fields that hold a single value for certain; those don't go to the parser. Each
    distinct (key, field) is parsed once. Null and blank fields give no rows, nor do fields that hold fewer than
    ``least_items`` values.
    """
    rows = df.select(F.col(key).alias("k"), F.col(field).alias("v")).where(F.length(F.trim("v")) > 0)
    kind = rows.schema["k"].dataType.simpleString()
    if simple:
        plain = rows.where(F.col("v").rlike(simple))
        rows = rows.where(~F.col("v").rlike(simple))
    rows = rows.distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = grammar()
        for pdf in batches:
            got = [(k, *x) for k, v in zip(pdf["k"], pdf["v"]) for items in [g.parse(v)] if len(items) >= least_items for x in items]
            yield pd.DataFrame(got, columns=["k", "item_pos", "item_value", "item_kind", "item_error"])

    out = rows.mapInPandas(run, f"k {kind}, item_pos int, item_value string, item_kind string, item_error string")
    if simple and least_items <= 1:
        out = out.unionByName(plain.distinct().select("k", F.lit(1).alias("item_pos"), F.trim("v").alias("item_value"), F.lit("bare").alias("item_kind"), F.lit(None).cast("string").alias("item_error")))
    return out.select(F.col("k").alias(key), F.lit(field).alias("field_name"), "item_pos", "item_value", "item_kind", "item_error")
