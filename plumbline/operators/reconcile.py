"""Correcting what was read off a drawing by the table in its text layer."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COLUMNS = ["ord", "name", "spec", "quantity", "unit", "location", "confidence", "source"]


@lru_cache(1 << 16)
def _plain(text: object) -> str:
    return unicodedata.normalize("NFKC", text).replace(" ", "").replace("　", "").lower() if isinstance(text, str) else ""


def _alike(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    return bool(short) and (a == b or (len(short) >= 3 and short in long))


class _Page:
    """A page's rows with what they are looked up by. Rows that the table adds or changes are seen by its later rows."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows: list[dict] = []
        self.specs: list[str] = []
        self.names: list[str] = []
        for r in rows:
            self.add(r)

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.specs.append(_plain(row["spec"]))
        self.names.append(_plain(row["name"]))

    def place(self, spec: str, name: str) -> int | None:
        if spec:
            for i, own in enumerate(self.specs):
                if _alike(own, spec):
                    return i
        for i, own in enumerate(self.names if name else ()):
            if own and (own == name or (len(own) >= 3 and own in name)):
                return i
        return None

    def take(self, row: dict) -> None:
        spec, name = _plain(row["spec"]), _plain(row["name"])
        at = self.place(spec, name)
        if at is None:
            top = max((r["ord"] for r in self.rows), default=-1)
            self.add({**row, "ord": top + 1, "source": "text_table"})
            return
        own = self.rows[at]
        own.update(quantity=row["quantity"], confidence=max(own["confidence"], 0.95), source="reconciled")
        if row["spec"] and not (isinstance(own["spec"], str) and own["spec"].strip()):
            own["spec"], self.specs[at] = row["spec"], spec


def reconcile(items: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Items with the table's quantities, by page (keys), in order of ord; unmatched table rows are added.

    The order of a page's rows decides, so a page is handled as a whole; pages are small. Pages stream through each task
    in order of their keys. Both sides have keys and _COLUMNS; quantities and confidences are not null.
    """
    columns = [*keys, *_COLUMNS]
    both = items.select(*columns, F.lit(0).alias("_side")).unionByName(table.select(*columns, F.lit(1).alias("_side")))
    schema = both.select(*columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, out, types = None, None, [], None

        def done() -> None:
            if page is not None:
                out.extend({**dict(zip(keys, key, strict=True)), **r} for r in page.rows)

        for batch in batches:
            types = types or pa.schema([batch.schema.field(c) for c in columns])
            for row in batch.to_pylist():
                k, side = tuple(row.pop(c) for c in keys), row.pop("_side")
                if k != key:
                    done()
                    key, page = k, _Page([])
                    if len(out) > 20_000:
                        yield pa.RecordBatch.from_pylist(out, types)
                        out.clear()
                page.take(row) if side else page.add(row)
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    return both.repartition(*keys).sortWithinPartitions(*keys, "_side", "ord").mapInArrow(run, schema)
