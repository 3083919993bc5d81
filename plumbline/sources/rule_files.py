"""Rule tables from YAML files. They are configuration, read on the driver."""

from __future__ import annotations

from collections.abc import Iterable

import yaml
from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.validate import require_valid
from .files import local_text


def _load(path: str) -> dict:
    return yaml.safe_load(local_text(path) or "") or {}


def _text(value: object) -> str | None:
    """Trimmed text, or null for nothing."""
    out = "" if value is None else str(value).strip()
    return out or None


def _dicts(rows: object) -> Iterable[dict]:
    return [r for r in rows or [] if isinstance(r, dict)] if isinstance(rows, list) else []


def dictionary(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """entries: canonical, category, unit, aliases. A row that is no mapping or lacks a key is an error (V13)."""
    rows = []
    for i, e in enumerate(_load(path).get("entries") or []):
        if not isinstance(e, dict) or not {"canonical", "category", "unit"} <= set(e):
            raise ValueError(f"entry {i}: a mapping with canonical, category and unit is needed")
        rows.append((i, *[None if e[k] is None else str(e[k]) for k in ("canonical", "category", "unit")], [str(a) for a in e.get("aliases") or []]))
    out = spark.createDataFrame(rows, schema.DICTIONARY)
    return require_valid(out) if strict else out


def prices(spark: SparkSession, path: str) -> DataFrame:
    """prices; rows without unit_price are skipped, the material ratio defaults to 0.5 and is held between 0 and 1."""
    rows = []
    for r in _dicts(_load(path).get("prices")):
        if r.get("unit_price") is None:
            continue
        try:
            ratio = float(r.get("material_ratio", 0.5))
        except (TypeError, ValueError):
            ratio = 0.5
        rows.append((len(rows), float(r["unit_price"]), str(r.get("unit") or ""), min(1.0, max(0.0, ratio)), *[_text(r.get(k)) for k in ("spec", "category", "name", "vendor_id")], str(r.get("notes") or "")))
    return spark.createDataFrame(rows, schema.PRICE)


def lives_and_plans(spark: SparkSession, path: str, default_years: int = 20) -> tuple[DataFrame, DataFrame, int]:
    data = _load(path)
    default = int(data.get("default_years", default_years))
    lives = [(i, [str(k) for k in r.get("keywords") or []], int(r.get("years", default)), str(r.get("label") or "")) for i, r in enumerate(_dicts(data.get("pipe_service_life")))]
    plans = [(i, str(p.get("name") or ""), int(p.get("interval_months", 12)), int(p.get("monthly_fee", 0)), str(p.get("scope") or "")) for i, p in enumerate(_dicts(data.get("plans")))]
    return spark.createDataFrame(lives, schema.LIFE), spark.createDataFrame(plans, schema.PLAN), default


def jobs(spark: SparkSession, path: str) -> DataFrame:
    data = _load(path)

    def row(i: int, j: dict) -> tuple:
        return i, str(j.get("name") or ""), [str(k) for k in j.get("keywords") or []], int(j.get("price_min", 0)), int(j.get("price_max", 0)), str(j.get("work") or ""), int(j.get("warranty_months", 0))

    back = [row(-1, data["fallback"])] if isinstance(data.get("fallback"), dict) else []
    return spark.createDataFrame(back + [row(i, j) for i, j in enumerate(_dicts(data.get("jobs")))], schema.JOB)


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    """Empty if the file is missing."""
    data = _load(path)
    found = [(-1, data["default"])] if isinstance(data.get("default"), dict) else []
    found += list(enumerate(_dicts(data.get("municipalities"))))
    rows = [(i, str(m.get("name") or ""), [str(a) for a in m.get("aliases") or []], *[str(m.get(k) or "") for k in ("form_name", "authority", "submit")], [str(d) for d in m.get("documents") or []], str(m.get("notes") or "")) for i, m in found]
    return spark.createDataFrame(rows, schema.MUNICIPALITY)


PROJECT_KEYS = ("project_name", "address", "owner", "contractor_name", "contractor_number", "chief_engineer", "municipality", "work_type")


def project(path: str) -> dict[str, str]:
    """What an application says of its project: the known keys only; the work type defaults to 新設."""
    data = _load(path)
    return {k: str(data.get(k) or ("新設" if k == "work_type" else "")) for k in PROJECT_KEYS}
