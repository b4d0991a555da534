"""Rectangles: (left, top, right, bottom), fractions of a page unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOISE = ("header", "footer", "page_number")


def pixel_rect(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """The pixels that a region touches: outer edges, within the image."""
    low = lambda x, most: F.least(F.greatest(F.floor(x * most), F.lit(0)), most)
    high = lambda x, most: F.least(F.greatest(F.ceil(x * most), F.lit(0)), most)
    return F.struct(low(left, width).alias("left"), low(top, height).alias("top"), high(right, width).alias("right"), high(bottom, height).alias("bottom"))


def clipped(x: Column) -> Column:
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 6)


def overlapping(selection: DataFrame, blocks: DataFrame, cells: int = 16) -> DataFrame:
    """(selection_id, block_id, noise): strict overlaps on the same page. Both have (page, left, top, right, bottom).

    Rectangles are dealt to the cells of a grid they touch, so the join is by page and cell and only tests neighbours;
    a pair is taken in the cell of its common upper left corner.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) * cells).cast("int"), F.floor(F.col(b) * cells).cast("int"))
        rows = df.where("left < right AND top < bottom").withColumn("cx", F.explode_outer(span("left", "right"))).withColumn("cy", F.explode_outer(span("top", "bottom")))
        return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in ("left", "top", "right", "bottom")], "page", "cx", "cy", *[c for c in df.columns if c.endswith("_id") or c == "type"])

    met = dealt(selection, "s").join(dealt(blocks, "b"), ["page", "cx", "cy"])
    met = met.where("s_left < b_right AND b_left < s_right AND s_top < b_bottom AND b_top < s_bottom")
    corner = (F.col("cx") == F.floor(F.greatest("s_left", "b_left") * cells)) & (F.col("cy") == F.floor(F.greatest("s_top", "b_top") * cells))
    return met.where(corner).select("selection_id", "block_id", F.col("type").isin(*NOISE).alias("noise"))


def union_box(rects: DataFrame, keys: list[str]) -> DataFrame:
    return rects.where("left < right AND top < bottom").groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
