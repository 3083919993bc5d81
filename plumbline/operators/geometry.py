"""Places on a page: tiles, boxes and their labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS_PER_INCH = 72.0
LABEL_HEIGHT, LABEL_WIDTH, LABEL_GAP = 12.0, 180.0, 2.0
# Colours of markers by category (red, green, blue), その他 for all others.
COLOURS = {
    "内装仕上げ": (0.95, 0.30, 0.30),
    "床": (0.30, 0.55, 0.95),
    "設備": (0.30, 0.80, 0.45),
    "建具": (0.95, 0.70, 0.20),
    "外装": (0.65, 0.35, 0.85),
    "その他": (0.55, 0.55, 0.55),
}


def tiles(pages: DataFrame, grid: int, width: Column, height: Column, keep: list[str]) -> DataFrame:
    """grid x grid tiles of each page, with their rectangle."""
    n = F.sequence(F.lit(0), F.lit(grid - 1))
    df = pages.select(*keep, (width / F.lit(float(grid))).alias("_w"), (height / F.lit(float(grid))).alias("_h"), F.explode(n).alias("row")).withColumn("col", F.explode(n))
    return df.select(*keep, "row", "col", (F.col("col") * F.col("_w")).alias("x0"), (F.col("row") * F.col("_h")).alias("y0"), ((F.col("col") + 1) * F.col("_w")).alias("x1"), ((F.col("row") + 1) * F.col("_h")).alias("y1"))


def to_points(box: Column, dpi: float) -> Column:
    """A box in pixels as one in points."""
    scale = F.lit(POINTS_PER_INCH / dpi)
    return F.struct(*[(box[c] * scale).alias(c) for c in ("x0", "y0", "x1", "y1")])


def label_box(box: Column) -> Column:
    """Where a box's label goes: above it, and inside the page at its top."""
    return F.struct(
        box["x0"].alias("x0"),
        F.greatest(box["y0"] - (LABEL_HEIGHT + LABEL_GAP), F.lit(0.0)).alias("y0"),
        (box["x0"] + LABEL_WIDTH).alias("x1"),
        F.greatest(box["y0"] - LABEL_GAP, F.lit(LABEL_HEIGHT)).alias("y1"),
    )


def colour(category: Column) -> Column:
    """A marker's colour, struct<r, g, b>."""

    def rgb(name: str) -> Column:
        return F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", COLOURS[name], strict=True)])

    out = rgb("その他")
    for name in COLOURS:
        out = F.when(category == name, rgb(name)).otherwise(out)
    return out


def markers(items: DataFrame, pages: DataFrame, keys: list[str], dpi: float) -> DataFrame:
    """Items with a box, on the pages that there are: box and label in points, and the colour of the item's category (if items have one)."""
    df = items.filter(F.col("bbox").isNotNull()).join(pages.select(*keys).distinct(), keys, "left_semi")
    category = F.col("category") if "category" in items.columns else F.lit(None).cast("string")
    return df.withColumn("box", to_points(F.col("bbox"), dpi)).withColumns({"label": label_box(F.col("box")), "colour": colour(category)})


def render_within(render: Callable[[float], bytes], dpi: float, limit: int = 4_500_000) -> tuple[bytes, float]:
    """A picture and its resolution: rendered anew at lower ones until it fits or can go no lower."""
    while True:
        picture = render(dpi)
        lower = shrink_dpi(dpi, len(picture), limit)
        if lower == dpi:
            return picture, dpi
        dpi = lower


def shrink_dpi(dpi: float, size: int, limit: int = 4_500_000, factor: float = 0.75, floor: float = 72.0) -> float:
    """The next resolution to try for a picture of `size` bytes; the same one if it fits or can go no lower."""
    return dpi if size <= limit or dpi <= floor else max(floor, dpi * factor)
