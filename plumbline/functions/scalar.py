"""Scalar functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WIDE = "０１２３４５６７８９．"
_PLAIN = "0123456789."


def norm_text(text: str | None, unicode: bool = True) -> str:
    """What norm gives for a text on the driver, such as a rule's keyword."""
    text = text or ""
    return unicodedata.normalize("NFKC", text).replace(" ", "").replace("　", "").lower() if unicode else text.replace(" ", "").lower()


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else norm_text(s))


def norm(text: Column, unicode: bool = True) -> Column:
    """Compatibility-normalised, without spaces, lower case; null is ''. unicode=False stays in the JVM and is for ASCII text.

    Spark has no such normalisation built in; only texts that are not ASCII go to Python.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))
    if not unicode:
        return plain
    ascii_only = F.coalesce(text, F.lit("")).rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, plain).otherwise(_nfkc(F.when(~ascii_only, text)))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to even. To two digits a double such as 2.675 rounds as written, not as stored in binary."""
    return F.bround(x, digits)


def yen(x: Column) -> Column:
    """A rounded amount as a whole number."""
    return F.bround(x, 0).cast("long")


def digits(text: Column) -> Column:
    """Full-width digits and points as ASCII ones, which casts and classes of Java's patterns need."""
    return F.translate(text, _WIDE, _PLAIN)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def truthy(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*[truthy(c.cast("string")) for c in columns])


def first_number(*columns: Column, strict: bool = False) -> Column:
    """The first that is neither null nor '', as a number: bad ones are null, or an error if strict."""
    found = F.trim(digits(first_text(*columns)))
    return found.cast("double") if strict else found.try_cast("double")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def caliber(spec: Column) -> Column:
    patterns = (r"(?iU)DN\s*(\d{1,3})", r"(?iU)(\d{1,3})\s*mm", r"(?iU)(\d{1,3})\s*A\b")
    return F.coalesce(F.concat(F.lit("DN"), F.coalesce(*[found(spec, p) for p in patterns])), F.lit("口径不明"))


def pipe_material(spec: Column) -> Column:
    """The first word of a spec, unless it is a calibre or a number; '' then, and for a blank spec."""
    head = F.coalesce(found(spec, r"(?U)^\s*(\S+)"), F.lit(""))
    return F.when(head.rlike(r"(?iU)^(DN|\d)"), F.lit("")).otherwise(head)


def number_text(x: Column) -> Column:
    """12.0 as '12', 28.5 as '28.5'."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def yen_text(x: Column) -> Column:
    return F.concat(F.lit("¥"), F.format_number(x, 0))


def hits(text: Column, words: Column) -> Column:
    """How many of the words, blank ones aside, are in the text."""
    return F.size(F.filter(words, lambda w: (w != "") & F.contains(text, w)))


def spec_match(a: Column, b: Column) -> Column:
    """Normalised specs agree, or the shorter has three characters and is in the longer."""
    inside = (F.contains(a, b) | F.contains(b, a)) & (F.least(F.length(a), F.length(b)) >= 3)
    return (a != "") & (b != "") & ((a == b) | inside)


def close_to_larger(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return (top == 0) | (F.abs(a - b) / F.when(top == 0, 1.0).otherwise(top) <= tolerance)


def close_to_truth(value: Column, truth: Column, tolerance: float = 0.05) -> Column:
    return (value == truth) | ((truth != 0) & (F.abs(value - truth) <= tolerance * F.abs(truth)))


def bbox_from_array(xs: Column) -> Column:
    return F.when(F.size(xs) >= 4, F.struct(*[F.get(xs, i).cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]))


def regex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
