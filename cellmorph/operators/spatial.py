"""Tiles, regions and patches (G6-G11, G13). Spatial joins meet on grid cells, not on inequalities alone."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_grid(scans: DataFrame, step: int = 512) -> DataFrame:
    """(…, x, y): whole tiles of scans with width and height."""
    return scans.where((F.col("width") >= step) & (F.col("height") >= step)).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - step, F.lit(step))).alias("x")
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - step, F.lit(step))).alias("y"))


def in_polygon(x, y, polygon: str) -> Column:
    """Even-odd test against an array<struct<x, y>> column."""
    n = F.size(polygon)
    edge = lambda i: (F.col(polygon)[i.cast("int")], F.col(polygon)[F.pmod(i + 1, n).cast("int")])

    def crosses(i):
        a, b = edge(i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    hits = F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses))
    return (n > 2) & (F.pmod(hits, F.lit(2)) == 1)


def _cells(low, high, size: int) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def points_in_regions(points: DataFrame, regions: DataFrame, size: int = 1024, polygon: str | None = None) -> DataFrame:
    """Points (x, y) with each region (x0, y0, x1, y1, optionally a polygon) that contains them.

    Regions are laid out on a grid, points look up their one cell: an equality join."""
    r = regions.select("*", F.explode(_cells(F.col("x0"), F.col("x1"), size)).alias("_gx")).select("*", F.explode(_cells(F.col("y0"), F.col("y1"), size)).alias("_gy"))
    p = points.withColumns({"_gx": F.floor(F.col("x") / size).cast("int"), "_gy": F.floor(F.col("y") / size).cast("int")})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    found = p.join(r, ["_gx", "_gy"]).where(inside).drop("_gx", "_gy")
    return found.where(in_polygon(F.col("x"), F.col("y"), polygon)) if polygon else found


def label_tiles(tiles: DataFrame, regions: DataFrame, step: int = 512, polygon: str | None = None) -> DataFrame:
    """tiles with `tissue`: gray if their centre lies in a region, else white."""
    centres = tiles.select(F.col("x").alias("tx"), F.col("y").alias("ty"), (F.col("x") + step // 2).alias("x"), (F.col("y") + step // 2).alias("y"))
    gray = points_in_regions(centres, regions, polygon=polygon).select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct().withColumn("_g", F.lit(1))
    return tiles.join(gray, ["x", "y"], "left").withColumn("tissue", F.when(F.col("_g").isNotNull(), "gray").otherwise("white")).drop("_g")


def tiles_inside(tiles: DataFrame, regions: DataFrame, step: int = 512, polygon: str | None = None) -> DataFrame:
    """Tiles whose four corners each lie in some region."""
    corners = F.explode(F.array(*(F.struct(F.lit(2 * i + j).alias("corner"), (F.col("x") + i * step).alias("x"), (F.col("y") + j * step).alias("y")) for i in (0, 1) for j in (0, 1))))
    points = tiles.select(F.col("x").alias("tx"), F.col("y").alias("ty"), corners.alias("c")).select("tx", "ty", "c.*")
    whole = points_in_regions(points, regions, polygon=polygon).groupBy("tx", "ty").agg(F.count_distinct("corner").alias("n")).where("n = 4")
    return tiles.join(whole.select(F.col("tx").alias("x"), F.col("ty").alias("y")), ["x", "y"], "left_semi")


def patches_for(boxes: DataFrame, seed: int, width: int, height: int, key: str = "cell_id", size: int = 512) -> DataFrame:
    """(px, py) of distinct patches that each contain a box, drawn by a hash; centred where a box is larger."""

    def origin(low, high, whole, salt):
        lo, hi = F.greatest(F.lit(0), F.ceil(high - size).cast("long")), F.least(F.lit(whole - size), F.floor(low).cast("long"))
        drawn = lo + F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.greatest(hi - lo + 1, F.lit(1)))
        centred = F.least(F.greatest(F.floor((low + high) / 2).cast("long") - size // 2, F.lit(0)), F.lit(whole - size))
        return F.when(hi >= lo, drawn).otherwise(centred).cast("long")

    return boxes.select(origin(F.col("xmin"), F.col("xmax"), width, 1).alias("px"), origin(F.col("ymin"), F.col("ymax"), height, 2).alias("py")).distinct()


def clip_to_patch(patches: DataFrame, boxes: DataFrame, size: int = 512, image: Sequence[str] = ()) -> DataFrame:
    """Boxes cut to each patch (px, py) they meet, relative to it, and normalised; a side of a pixel or less is dropped.

    Both sides are laid out on a grid of the patch size; a pair is kept in the first cell that it shares."""
    p = patches.select("*", F.explode(_cells(F.col("px"), F.col("px") + size, size)).alias("_gx")).select("*", F.explode(_cells(F.col("py"), F.col("py") + size, size)).alias("_gy"))
    b = boxes.select("*", F.explode(_cells(F.col("xmin"), F.col("xmax"), size)).alias("_gx")).select("*", F.explode(_cells(F.col("ymin"), F.col("ymax"), size)).alias("_gy"))
    first = (F.col("_gx") == F.floor(F.greatest("px", "xmin") / size)) & (F.col("_gy") == F.floor(F.greatest("py", "ymin") / size))
    meets = (F.col("xmax") > F.col("px")) & (F.col("xmin") < F.col("px") + size) & (F.col("ymax") > F.col("py")) & (F.col("ymin") < F.col("py") + size)
    joined = p.join(b, [*image, "_gx", "_gy"]).where(first & meets).drop("_gx", "_gy")
    cut = joined.withColumns(
        {"cx1": F.greatest("xmin", "px") - F.col("px"), "cy1": F.greatest("ymin", "py") - F.col("py"), "cx2": F.least(F.col("xmax"), F.col("px") + size) - F.col("px"), "cy2": F.least(F.col("ymax"), F.col("py") + size) - F.col("py")}
    ).where("cx2 - cx1 > 1 and cy2 - cy1 > 1")
    d = lambda c: F.col(c).cast("double")
    return cut.withColumns({"cx": (d("cx1") + d("cx2")) / 2 / size, "cy": (d("cy1") + d("cy2")) / 2 / size, "w": (d("cx2") - d("cx1")) / size, "h": (d("cy2") - d("cy1")) / size})


def bodies_in_wholes(bodies: DataFrame, wholes: DataFrame) -> DataFrame:
    """Cell bodies with the whole cells whose box holds their centre."""
    centres = bodies.withColumns({"x": (F.col("xmin") + F.col("xmax")) / 2.0, "y": (F.col("ymin") + F.col("ymax")) / 2.0}).drop("xmin", "ymin", "xmax", "ymax")
    regions = wholes.select(F.col("whole_id"), F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"))
    return points_in_regions(centres, regions).drop("x0", "y0", "x1", "y1")


def mask_bbox(pixels: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """x, y, w, h of each key's pixels; zeros for keys without any."""
    boxes = pixels.groupBy(*key).agg(F.min("x").alias("bx"), F.min("y").alias("by"), (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"))
    return keys.join(boxes, list(key), "left").fillna(0, ["bx", "by", "bw", "bh"])
