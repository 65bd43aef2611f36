"""Proportional crop boxes as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shares of the image's width and height by region: (width, height, top).
REGIONS = {
    "name": (0.755, 0.0585, 0.0535),
    "type": (0.725, 0.075, 0.555),
    "art": (0.8557, 0.4455, 0.1122),
    "flavor": (0.8557, 0.2927, 0.6127),
}
LEFT = 0.0535
MIN_WIDTH = 360
MIN_HEIGHT = 500


def large_enough(width: Column, height: Column) -> Column:
    return (width >= MIN_WIDTH) & (height >= MIN_HEIGHT)


def crop_box(width: Column, height: Column, region: Column) -> Column:
    """struct<width, height, left, top> in pixels; null for an unknown region."""
    out = F.lit(None).cast("struct<width:int,height:int,left:int,top:int>")
    at = lambda size, share: F.round(size * F.lit(share)).cast("int")
    for name, (w, h, top) in REGIONS.items():
        box = F.struct(at(width, w).alias("width"), at(height, h).alias("height"), at(width, LEFT).alias("left"), at(height, top).alias("top"))
        out = F.when(region == name, box).otherwise(out)
    return out
