"""Rows from text: table lines, legends, symbol codes and JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bbox_from_array, digits, found, regex_escape
from ..rules import LEGEND_STOP, SYMBOL_STOP

# Units, codes, calibres and legend lines as they are written on drawings.
_QUANTITY = r"(?sU)^(.*?)(\d+(?:\.\d+)?)\s*(台|個|箇所|本|枚|式|m2|m²|ｍ2|m|ｍ)(?![0-9A-Za-z])"
_MODEL = r"([A-Za-z]{1,6}[-‐ー]?\d[\dA-Za-z\-]{0,8})"
_SIZE = r"(?U)(?:DN|呼び径|φ|Φ)?\s*(\d{2,4})\s*A\b"
_LEGEND = r"(?U)^\s*([A-Za-z][A-Za-z0-9]{1,5})[\s:：|｜・,、]+(.+\S)\s*$"
_CODE = r"(?U)\b([A-Z]{1,4}[0-9]{1,2}[-_]?[A-Z0-9]{0,4})\b"
_EDGE = " 　:：|・,、"
_CJK = "[぀-ヿ一-鿿]"


def strip_fence(text: Column) -> Column:
    """The inside of the first fenced block, or the text."""
    return F.coalesce(found(text, r"(?s)```(?:json)?\s*(.+?)\s*```"), text)


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"^[{_EDGE}]+|[{_EDGE}]+$", ""))


def _lines(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return pages.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line"))


def table_lines(pages: DataFrame, text: str, keep: list[str], confidence: float = 0.9) -> DataFrame:
    """Items of the lines that have a quantity with a unit: name, spec (model code, else calibre), quantity, unit."""
    df = _lines(pages, text, keep).withColumn("_l", _clean(F.col("line"))).filter((F.length("_l") >= 2) & F.col("_l").rlike(_QUANTITY))
    df = df.withColumn("name", _clean(F.regexp_extract("_l", _QUANTITY, 1))).filter("name != ''")
    unit = F.regexp_extract("_l", _QUANTITY, 3)
    return df.select(
        *keep,
        "line_no",
        "name",
        F.coalesce(found(F.col("name"), _MODEL), F.concat(found(F.col("name"), _SIZE), F.lit("A"))).alias("spec"),
        digits(F.regexp_extract("_l", _QUANTITY, 2)).cast("double").alias("quantity"),
        F.when(unit.isin("m²", "ｍ2"), "m2").when(unit == "ｍ", "m").otherwise(unit).alias("unit"),
        F.lit(confidence).alias("confidence"),
    )


def legend_entries(pages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """code, name, line_no: the first definition of each code on a page."""
    df = _lines(pages, text, keep).filter(F.col("line").rlike(_LEGEND))
    df = df.select(*keep, "line_no", F.regexp_extract("line", _LEGEND, 1).alias("code"), F.regexp_replace(F.regexp_extract("line", _LEGEND, 2), f"^[{_EDGE}｜]+|[{_EDGE}｜]+$", "").alias("name"))
    df = df.filter(~F.upper("code").isin(*LEGEND_STOP) & ~F.col("code").rlike(r"(?iU)^DN\d+$") & F.col("name").rlike(_CJK))
    return df.groupBy(*keep, "code").agg(F.min_by("name", "line_no").alias("name"), F.min("line_no").alias("line_no"))


def symbol_count(text: Column, code: Column) -> Column:
    """How often a code, with a running number or without, stands in a text, less one for its definition; 0 at least."""
    pattern = F.concat(F.lit("(?U)(?<![A-Za-z0-9])(?:"), regex_escape(code), F.lit(r")(?:[-‐]?\d{1,3})?(?![A-Za-z0-9])"))
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), pattern) - 1, F.lit(0))


def legend_items(pages: DataFrame, text: str, keep: list[str], confidence: float = 0.7) -> DataFrame:
    """Items counted by their legend's codes. keep has to identify a page."""
    entries = legend_entries(pages, text, keep)
    df = entries.join(pages.select(*keep, text), keep).withColumn("quantity", symbol_count(F.col(text), F.col("code")).cast("double")).filter("quantity > 0")
    return df.select(*keep, "line_no", "name", F.col("code").alias("spec"), "quantity", F.lit("個").alias("unit"), F.lit(confidence).alias("confidence"), F.lit("legend_count").alias("source"))


def symbol_codes(text: Column) -> Column:
    """Distinct codes of a text in order."""
    codes = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CODE), F.lit(1)))
    return F.array_sort(F.filter(codes, lambda c: ~c.isin(*SYMBOL_STOP) & (F.length(c) >= 2)))


def uncovered_codes(codes: DataFrame, items: DataFrame, scope: list[str]) -> DataFrame:
    """Codes (column code) that no item of the scope has as its spec; both normalised by the caller as column k."""
    return codes.join(items.select(*scope, "k").distinct(), [*scope, "k"], "left_anti")


def json_items(replies: DataFrame, raw: str, keep: list[str], page: Column, drop_bbox: bool = False) -> DataFrame:
    """Items of a JSON array in a reply; pos is a row's place in it.

    A reply that is no JSON array (a truncated one too) gives nothing. Elements that are no objects, bad numbers, pages
    below 1 and explicit nulls for page, name or unit drop the row. Missing keys: page as given, name and unit '',
    quantity 0, confidence 1 - and so does a confidence of 0.
    """
    text = strip_fence(F.col(raw))
    cells = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>"))
    df = replies.withColumn("_default", page.cast("double")).select(*keep, "_default", F.posexplode(cells).alias("pos", "_cell")).filter(F.ltrim("_cell").startswith("{"))
    df = df.withColumn("_m", F.from_json("_cell", "map<string,string>")).filter("_m is not null")

    def get(key: str) -> Column:
        return F.try_element_at(F.col("_m"), F.lit(key))

    def has(key: str) -> Column:
        return F.map_contains_key("_m", F.lit(key))

    def number(key: str, empty: float) -> Column:
        given = F.nullif(get(key), F.lit(""))
        value = F.trim(digits(given)).try_cast("double")
        return F.when(given.isNull() | (value == 0), F.lit(empty)).otherwise(value)

    where = F.when(has("page"), F.trim(get("page")).try_cast("double")).otherwise(F.col("_default"))
    box = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>") if drop_bbox else bbox_from_array(F.from_json(get("bbox"), "array<double>"))
    out = df.select(
        *keep,
        "pos",
        where.alias("_page"),
        F.when(has("name"), get("name")).otherwise(F.lit("")).alias("name"),
        get("spec").alias("spec"),
        number("quantity", 0.0).alias("quantity"),
        F.when(has("unit"), get("unit")).otherwise(F.lit("")).alias("unit"),
        get("location").alias("location"),
        box.alias("bbox"),
        number("confidence", 1.0).alias("confidence"),
    )
    out = out.filter("_page >= 1 and _page = floor(_page) and name is not null and unit is not null and quantity is not null and confidence is not null")
    return out.select(*keep, "pos", F.col("_page").cast("int").alias("page"), *out.columns[len(keep) + 2 :])


def text_layer(documents: DataFrame, text: str, keys: list[str], min_chars: int = 50) -> DataFrame:
    """By document, stripped characters over its pages, and whether they make a text layer."""
    out = documents.groupBy(*keys).agg(F.sum(F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)^\s+|\s+$", ""))).alias("n_chars"))
    return out.withColumn("has_text", F.col("n_chars") >= min_chars)
