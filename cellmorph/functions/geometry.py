"""Boxes and points as column expressions."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(value, low, high) -> Column:
    return F.least(F.greatest(value, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def yolo_to_xyxy(df: DataFrame, width: int, height: int) -> DataFrame:
    """Normalised cx, cy, w, h to whole pixels: truncated toward zero, clamped into the image."""
    corner = lambda c, s, sign, size: clamp(((F.col(c) + sign * F.col(s) / 2) * size).cast("int"), 0, size - 1)
    return df.withColumns({"xmin": corner("cx", "w", -1, width), "ymin": corner("cy", "h", -1, height), "xmax": corner("cx", "w", 1, width), "ymax": corner("cy", "h", 1, height)})


def xyxy_to_yolo(df: DataFrame, width: int, height: int) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    return df.withColumns({"cx": (d("xmin") + d("xmax")) / 2 / width, "cy": (d("ymin") + d("ymax")) / 2 / height, "w": (d("xmax") - d("xmin")) / width, "h": (d("ymax") - d("ymin")) / height})


def coco_to_yolo(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """COCO corner boxes x, y, bw, bh to normalised centre boxes of class 0."""
    d = lambda c: F.col(c).cast("double")
    return df.withColumns({"cls": F.lit(0), "cx": (d("x") + d("bw") / 2) / d(width), "cy": (d("y") + d("bh") / 2) / d(height), "w": d("bw") / d(width), "h": d("bh") / d(height)})


def scale_boxes(df: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """Boxes scaled about their centres, clipped to the image, truncated."""
    d = lambda c: F.col(c).cast("double")

    def side(low, high, sign, size):
        return clamp((d(low) + d(high)) / 2 + sign * (d(high) - d(low)) * scale / 2, 0.0, float(size - 1)).cast("int")

    return df.withColumns({"sx1": side("xmin", "xmax", -1, width), "sy1": side("ymin", "ymax", -1, height), "sx2": side("xmin", "xmax", 1, width), "sy2": side("ymin", "ymax", 1, height)})


def pad_boxes(df: DataFrame, share: float, width: int, height: int) -> DataFrame:
    """Boxes widened by a share of their own size on each side, clamped to the image."""
    d = lambda c: F.col(c).cast("double")

    def side(low, high, at, sign, size):
        return clamp(d(at) + sign * (d(high) - d(low)) * share, 0.0, float(size)).cast("int")

    return df.withColumns(
        {"px1": side("xmin", "xmax", "xmin", -1, width), "py1": side("ymin", "ymax", "ymin", -1, height), "px2": side("xmin", "xmax", "xmax", 1, width), "py2": side("ymin", "ymax", "ymax", 1, height)}
    )


def crop_plan(df: DataFrame, pad: int, width: int, height: int, side: int, downsample: float = 1.0) -> DataFrame:
    """Crops x, y, w, h of annotations padded and cut to the slide, the downsample that fits `side`, output size.

    Crops outside the slide, or of a pixel or less, are dropped."""
    x, y = F.floor("xmin").cast("int") - pad, F.floor("ymin").cast("int") - pad
    w, h = F.ceil(F.col("xmax") - F.col("xmin")).cast("int") + 2 * pad, F.ceil(F.col("ymax") - F.col("ymin")).cast("int") + 2 * pad
    out = df.withColumns({"crop_x": F.greatest(x, F.lit(0)), "crop_y": F.greatest(y, F.lit(0)), "crop_w": w + F.least(x, F.lit(0)), "crop_h": h + F.least(y, F.lit(0))})
    out = out.where((F.col("crop_x") < width) & (F.col("crop_y") < height))
    out = out.withColumns({"crop_w": F.least("crop_w", width - F.col("crop_x")), "crop_h": F.least("crop_h", height - F.col("crop_y"))}).where("crop_w > 1 and crop_h > 1")
    longest = F.greatest("crop_w", "crop_h").cast("double")
    out = out.withColumn("ds", F.when(longest / downsample > side, F.ceil(longest / side).cast("double")).otherwise(downsample))
    return out.withColumns({"out_w": F.floor(F.col("crop_w") / F.col("ds") + 0.5).cast("int"), "out_h": F.floor(F.col("crop_h") / F.col("ds") + 0.5).cast("int")})


def tetrahedron_xyz(df: DataFrame, parts: list[str]) -> DataFrame:
    """Points x, y, z of four-part compositions in a regular tetrahedron; rows are scaled to sum 1."""
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    p = [F.col(c) / total for c in parts]
    return df.withColumns({"tx": p[1] + (p[2] + p[3]) / 2, "ty": p[2] * (math.sqrt(3) / 2) + p[3] * (math.sqrt(3) / 6), "tz": p[3] * math.sqrt(2 / 3)})
