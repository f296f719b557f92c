"""Arithmetic on boxes (x0, y0, x1, y1) and bounded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def centre(bbox: Column) -> Column:
    return F.struct(((bbox[0] + bbox[2]) / 2).alias("x"), ((bbox[1] + bbox[3]) / 2).alias("y"))


def scaled(bbox: Column, from_width: Column, to_width: Column) -> Column:
    return F.transform(bbox, lambda v: v * to_width / from_width)


def half_up(x: Column) -> Column:
    """Rounds halves upwards, below zero too."""
    return F.floor(x + 0.5)


def pixels(low: Column, high: Column, dpi: int = 300) -> Column:
    return half_up((high - low) * dpi / 72)


def preview(bbox: Column) -> Column:
    return F.struct(F.greatest(F.lit(320), half_up((bbox[2] - bbox[0]) * 2.5)).alias("width"), F.greatest(F.lit(120), half_up((bbox[3] - bbox[1]) * 2.5)).alias("height"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_up(part * 100 / whole)).otherwise(F.lit(0)).cast("long")
