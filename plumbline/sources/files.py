"""Readers: rows as text under the columns that a file has, for the operators to interpret."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..functions.scalar import truthy

#: Columns that a JSON source may have, by kind; each is read as text.
COLUMNS = {
    "rooms": ("name", "室名", "width_m", "width", "幅", "depth_m", "depth", "奥行", "height_m", "height", "天井高", "ceiling_height_m", "floor_area_m2", "floor_area", "床面積", "wall_area_m2", "wall_area", "壁面積", "openings_m2", "openings", "開口", "exterior_wall_len_m", "exterior_wall_len", "外壁長", "surfaces", "material", "材種", "thickness_mm", "厚み"),
    "risers": ("name", "系統", "系統名", "floors", "階数", "貫通階数", "floor_height_m", "floor_height", "階高", "count", "本数", "spec", "仕様", "口径", "material", "材種", "branch_per_floor_m", "branch_per_floor", "横引き", "fittings_per_floor", "継手数", "valves_per_floor", "弁数", "location", "場所"),
    "measures": ("kind", "name", "location", "場所", "spec", "仕様", "confidence", "length_m", "length", "延長", "width_mm", "width", "幅", "height_mm", "height", "高さ", "dia_mm", "dia", "口径", "径", "count", "quantity", "数量", "unit"),
    "items": ("name", "spec", "location", "quantity", "unit", "category"),
}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An array of objects, or an object with that array under `kind`; with ord, the row's place in its file."""
    text = spark.read.text(path, wholetext=True)
    body = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", f"$.{kind}"))
    cells = text.select(F.posexplode(F.from_json(body, "array<map<string,string>>")).alias("ord", "_m"))
    # An array of surfaces comes as JSON text: ["a","b"] reads like a list with separators once its marks are gone.
    value = {c: F.try_element_at("_m", F.lit(c)) for c in COLUMNS[kind]}
    if "surfaces" in value:
        value["surfaces"] = F.regexp_replace(value["surfaces"], r'[\[\]"]', "")
    return cells.select(F.col("ord").cast("long"), *[v.alias(c) for c, v in value.items()])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte order mark is dropped. ord orders rows, with gaps."""
    df = spark.read.csv(path, header=True, multiLine=True)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).withColumn("ord", F.monotonically_increasing_id())


def load_session(spark: SparkSession, path: str, row: StructType | str = schema.ITEM) -> DataFrame:
    """Rows that sinks.dump_session wrote, with the columns and types of `row`."""
    return spark.read.schema(row).json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The corrections log; empty if there is none. Blank lines are skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema.CORRECTION)
    return spark.read.schema(schema.CORRECTION).json(path)


def scan_documents(spark: SparkSession, path: str, render: Callable[[bytes], Iterator[dict]], page_schema: str = "page int, width double, height double, text string") -> DataFrame:
    """Pages of binary documents. render (a PDF library, which is not part of this package) yields a document's pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p, **page} for p, content in zip(batch["path"], batch["content"], strict=True) for page in render(content)]
            if rows:
                yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {page_schema}")


#: The page that stands for a document that cannot be opened.
EMPTY_PAGE = {"page": 1, "width": 1654.0, "height": 1169.0, "text": ""}


def ask(pages: DataFrame, complete: Callable[[str], str], prompt: str, keep: list[str]) -> DataFrame:
    """reply: what a language model says to each page's prompt column. The client is the caller's; tests pass a constant."""
    types = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keep].assign(reply=[complete(p) for p in batch[prompt]])

    return pages.select(*keep, prompt).mapInPandas(run, ", ".join([*[f"`{k}` {types[k]}" for k in keep], "reply string"]))


#: Characters of a page's text, codes and items that a question holds at most: of a whole page, of a tile, of a check.
WHOLE, TILE, CHECK = (8000, 60, 0), (2000, 60, 0), (2000, 40, 60)
_NONE = "(なし)"


def _codes(codes: Column, most: int, label: str) -> Column:
    listed = F.concat_ws(", ", F.slice(codes, 1, most))
    return F.when(listed != "", F.concat(F.lit(f"\n\n## {label}\n"), listed)).otherwise(F.lit(""))


def _layer(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(F.nullif(text, F.lit("")), F.lit(_NONE)), 1, most)


def page_prompt(page: Column, text: Column, codes: Column) -> Column:
    """What is asked about a whole page: its number, its text layer and the codes in it, each up to a limit."""
    return F.concat(F.lit("## ページ "), page.cast("string"), F.lit("\n項目を JSON 配列で。\nテキスト層: "), _layer(text, WHOLE[0]), _codes(codes, WHOLE[1], "記号コード"))


def tile_prompt(page: Column, row: Column, col: Column, grid: int, text: Column, codes: Column) -> Column:
    """What is asked about a tile (rows and columns from 0); the text layer is the page's."""
    place = F.concat(F.lit(f" タイル {grid}x{grid} ("), (row + 1).cast("string"), F.lit(", "), (col + 1).cast("string"), F.lit(")"))
    return F.concat(F.lit("## ページ "), page.cast("string"), place, F.lit("\n項目を JSON 配列で。\nテキスト層: "), _layer(text, TILE[0]), _codes(codes, TILE[1], "記号コード"))


def check_prompt(page: Column, text: Column, codes: Column, found: Column) -> Column:
    """What is asked in a second pass: the items there are (found: array of name, spec, location), the codes that none of
    their specs is, and the page's text layer."""
    said = F.transform(F.slice(found, 1, CHECK[2]), lambda i: F.concat(F.lit("  - "), i["name"], F.lit(" / spec="), F.coalesce(truthy(i["spec"]), F.lit("-")), F.lit(" / loc="), F.coalesce(truthy(i["location"]), F.lit("-"))))
    have = F.transform(found, lambda i: F.lower(F.replace(F.coalesce(i["spec"], F.lit("")), F.lit(" "), F.lit(""))))
    missing = F.filter(codes, lambda c: ~F.array_contains(have, F.lower(c)))  # codes are ASCII, so specs that equal one are too
    listed = F.coalesce(truthy(F.concat_ws("\n", said)), F.lit(f"  {_NONE}"))
    return F.concat(F.lit("## ページ "), page.cast("string"), F.lit(" 追加漏れ確認\n抽出済み:\n"), listed, _codes(missing, CHECK[1], "未抽出の記号コード"), F.lit("\n載っていない項目を JSON 配列で。\nテキスト層: "), _layer(text, CHECK[0]))


def local_text(path: str) -> str | None:
    return Path(path).read_text(encoding="utf-8") if Path(path).exists() else None
