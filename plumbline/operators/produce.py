"""Items from measured dimensions: site measures, rooms and risers. Zero counts as not given, as in the published rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_number, first_text, half_even, truthy
from ..rules import KIND_UNITS

SURFACES = ("壁", "天井", "床")


def _given(x: Column) -> Column:
    return F.coalesce(x != 0, F.lit(False))


def _pick(df: DataFrame, *names: str) -> list[Column]:
    """Of alternative columns, those that df has."""
    return [F.col(f"`{n}`").cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")]


def duct_area(rectangular: Column, width: Column, height: Column, diameter: Column, length: Column) -> Column:
    """Developed area in m2: both sides twice, or the circumference, by the length; 0 where it cannot be told."""
    rect = half_even((width + height) * 2.0 / 1000.0 * length, 2)
    round_ = half_even(F.lit(3.141592653589793) * (diameter / 1000.0) * length, 2)
    ok = F.coalesce(length > 0, F.lit(False))
    return F.when(ok & rectangular & _given(width) & _given(height), rect).when(ok & ~rectangular & _given(diameter), round_).otherwise(0.0)


def _g(x: Column) -> Column:
    """A number as %g writes it, for lengths of up to six digits."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")
    return short


def measure_items(measures: DataFrame, keep: list[str]) -> DataFrame:
    """One item for each measure: a duct by area, a pipe by length, anything else by count."""
    kind, name = (F.trim(F.coalesce(first_text(*_pick(measures, c)), F.lit(""))) for c in ("kind", "name"))
    length, width, height, dia, count, conf = (
        first_number(*_pick(measures, *names))
        for names in (("length_m", "length", "延長"), ("width_mm", "width", "幅"), ("height_mm", "height", "高さ"), ("dia_mm", "dia", "口径", "径"), ("count", "quantity", "数量"), ("confidence",))
    )
    spec, unit = first_text(*_pick(measures, "spec", "仕様")), first_text(*_pick(measures, "unit"))
    df = measures.select(*keep, kind.alias("kind"), name.alias("_name"), F.trim(F.coalesce(first_text(*_pick(measures, "location", "場所")), F.lit(""))).alias("location"), spec.alias("_spec"), unit.alias("_unit"), length.alias("_l"), width.alias("_w"), height.alias("_h"), dia.alias("_d"), count.alias("_n"), F.coalesce(conf, F.lit(0.9)).alias("confidence"))
    l, w, h, d, n = (F.col(c) for c in ("_l", "_w", "_h", "_d", "_n"))
    no_kind, k = F.col("kind") == "", F.col("kind")
    duct = k.isin("角ダクト", "丸ダクト") | (no_kind & _given(l) & (_given(w) | _given(d)) & n.isNull())
    pipe = (k == "配管") | (no_kind & _given(l) & (_given(d) | F.col("_spec").isNotNull()) & ~(_given(w) | _given(h)) & n.isNull())
    rect = (k == "角ダクト") | (_given(w) & _given(h))
    size = F.when(rect & _given(w) & _given(h), F.concat(w.cast("long").cast("string"), F.lit("×"), h.cast("long").cast("string"))).when(_given(d), F.concat(F.lit("φ"), d.cast("long").cast("string")))
    duct_spec = F.concat(F.coalesce(F.concat(size, F.lit(" ")), F.lit("")), F.lit("L"), _g(F.coalesce(l, F.lit(0.0))), F.lit("m"))
    by_kind = F.lit("個")
    for a, b in KIND_UNITS.items():
        by_kind = F.when(k == a, b).otherwise(by_kind)
    return df.select(
        *keep,
        F.when(duct, F.coalesce(truthy(F.col("_name")), F.lit("ダクト"))).when(pipe, F.coalesce(truthy(F.col("_name")), F.lit("冷温水配管"))).otherwise(F.coalesce(truthy(F.col("_name")), F.lit("項目"))).alias("name"),
        F.when(duct, F.coalesce("_spec", duct_spec)).when(pipe, F.coalesce(F.col("_spec"), F.when(_given(d), F.concat(d.cast("long").cast("string"), F.lit("A"))))).otherwise(F.col("_spec")).alias("spec"),
        F.when(duct, duct_area(rect, w, h, d, l)).when(pipe, F.coalesce(l, F.lit(0.0))).otherwise(F.coalesce(n, F.lit(0.0))).alias("quantity"),
        F.when(duct, "m2").when(pipe, "m").otherwise(F.coalesce(F.col("_unit"), by_kind)).alias("unit"),
        "location",
        "confidence",
    )


def read_rooms(raw: DataFrame, keep: list[str]) -> DataFrame:
    """Rooms from rows of text under any of their column names; a bad number is an error."""

    def number(*names: str) -> Column:
        return first_number(*_pick(raw, *names), strict=True)

    given = first_text(*_pick(raw, "surfaces"))
    parts = F.filter(F.transform(F.split(given, "[;|,、]"), lambda s: F.trim(s)), lambda s: s != "")
    thick = first_number(*_pick(raw, "thickness_mm", "厚み"), strict=True)
    return raw.select(
        *keep,
        F.coalesce(first_text(*_pick(raw, "name", "室名")), F.lit("室")).alias("name"),
        number("width_m", "width", "幅").alias("width_m"),
        number("depth_m", "depth", "奥行").alias("depth_m"),
        number("height_m", "height", "天井高", "ceiling_height_m").alias("height_m"),
        number("floor_area_m2", "floor_area", "床面積").alias("floor_area_m2"),
        number("wall_area_m2", "wall_area", "壁面積").alias("wall_area_m2"),
        F.coalesce(number("openings_m2", "openings", "開口"), F.lit(0.0)).alias("openings_m2"),
        number("exterior_wall_len_m", "exterior_wall_len", "外壁長").alias("exterior_wall_len_m"),
        F.coalesce(parts, F.array(*[F.lit(s) for s in SURFACES])).alias("surfaces"),
        F.coalesce(first_text(*_pick(raw, "material", "材種")), F.lit("断熱材(グラスウール)")).alias("material"),
        thick.cast("int").alias("thickness_mm"),
    )


def room_items(rooms: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each requested surface with an area over 0. Walls: measured, else by outer length, else by perimeter (confidence 0.6)."""
    both = _given(F.col("width_m")) & _given(F.col("depth_m"))
    floor = F.coalesce(F.col("floor_area_m2"), F.when(both, F.col("width_m") * F.col("depth_m")), F.lit(0.0))
    around = F.coalesce(F.col("exterior_wall_len_m"), F.when(both, (F.col("width_m") + F.col("depth_m")) * 2.0))
    built = F.when(_given(around) & _given(F.col("height_m")), F.greatest(F.lit(0.0), around * F.col("height_m") - F.coalesce("openings_m2", F.lit(0.0))))
    wall = F.coalesce(F.col("wall_area_m2"), built, F.lit(0.0))
    approx = F.col("wall_area_m2").isNull() & F.col("exterior_wall_len_m").isNull()
    area = [F.struct(F.lit(i).alias("i"), F.lit(s).alias("surface"), half_even(wall if s == "壁" else floor, 2).alias("area"), F.when(F.lit(s == "壁") & approx, 0.6).otherwise(0.95).alias("confidence")) for i, s in enumerate(SURFACES)]
    wanted = F.filter(F.array(*area), lambda a: F.array_contains("surfaces", a["surface"]) & (a["area"] > 0))
    df = rooms.withColumn("_a", F.explode(wanted))
    return df.select(*keep, F.col("_a.i").alias("pos"), F.col("material").alias("name"), F.when(_given(F.col("thickness_mm")), F.concat(F.lit("t"), F.col("thickness_mm").cast("string"))).alias("spec"), F.col("_a.area").alias("quantity"), F.lit("m2").alias("unit"), F.concat("name", F.lit(" "), "_a.surface").alias("location"), F.col("_a.confidence").alias("confidence"))


def read_risers(raw: DataFrame, keep: list[str]) -> DataFrame:
    def number(*names: str) -> Column:
        return first_number(*_pick(raw, *names))

    def text(*names: str) -> Column:
        return first_text(*_pick(raw, *names))

    floors, count = number("floors", "階数", "貫通階数"), number("count", "本数")
    return raw.select(
        *keep,
        F.coalesce(text("name", "系統", "系統名"), F.lit("立管")).alias("name"),
        F.when(_given(floors), floors.cast("int")).alias("floors"),
        number("floor_height_m", "floor_height", "階高").alias("floor_height_m"),
        F.when(_given(count), count.cast("int")).otherwise(1).alias("count"),
        text("spec", "仕様", "口径").alias("spec"),
        F.coalesce(text("material", "材種"), F.lit("配管")).alias("material"),
        F.coalesce(number("branch_per_floor_m", "branch_per_floor", "横引き"), F.lit(0.0)).alias("branch_per_floor_m"),
        F.coalesce(number("fittings_per_floor", "継手数"), F.lit(2.0)).alias("fittings_per_floor"),
        F.coalesce(number("valves_per_floor", "弁数"), F.lit(0.0)).alias("valves_per_floor"),
        text("location", "場所").alias("location"),
    )


def riser_items(risers: DataFrame, keep: list[str]) -> DataFrame:
    """Up to four rows a riser: its pipe, branches, fittings and valves, where over 0; none without floors and height."""
    ok = F.coalesce((F.col("floors") > 0) & (F.col("floor_height_m") > 0), F.lit(False))
    span = F.col("floors") * F.greatest(F.lit(1), F.col("count"))
    where = F.coalesce(truthy(F.col("location")), F.col("name"))

    def part(i: int, name: Column, quantity: Column, unit: str, suffix: str, confidence: float) -> Column:
        return F.struct(F.lit(i).alias("pos"), name.alias("name"), F.when(ok, quantity).otherwise(0.0).alias("quantity"), F.lit(unit).alias("unit"), F.concat(where, F.lit(suffix)).alias("location"), F.lit(confidence).alias("confidence"))

    parts = F.array(
        part(0, F.col("material"), half_even(F.col("floor_height_m") * span, 2), "m", " 立管", 0.8),
        part(1, F.col("material"), half_even(F.col("branch_per_floor_m") * span, 2), "m", " 横引き", 0.75),
        part(2, F.lit("継手"), half_even(F.col("fittings_per_floor") * span), "個", "", 0.7),
        part(3, F.lit("仕切弁"), half_even(F.col("valves_per_floor") * span), "個", "", 0.75),
    )
    df = risers.withColumn("_p", F.explode(F.filter(parts, lambda p: p["quantity"] > 0)))
    return df.select(*keep, "_p.pos", "_p.name", "spec", "_p.quantity", "_p.unit", "_p.location", "_p.confidence")
