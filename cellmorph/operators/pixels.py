"""Masks as pixel tables (key, y, x): areas, skeletons, shapes, overlaps.

A cell's mask has at most a tile's pixels, so what needs neighbour order runs per mask in a grouped task; masks of a whole
slide are labelled by tiles (`slide_components`); everything else is joins and aggregates over pixels, whatever their number.
"""

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from ..tables import min_labels, stored, whole_groups

#: Pixels of tiles that one task labels.
TASK_PIXELS = 4_000_000
#: A tile's side.
TILE = 512
OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def _key(px: DataFrame) -> list[str]:
    return [c for c in px.columns if c not in ("y", "x")]


def _dealt(px: DataFrame) -> DataFrame:
    """px as a join's side that is shuffled, never broadcast: pixels come from few bytes (runs, outlines, parameters), which Spark's
    estimate goes by, and a broadcast holds all of them in the driver."""
    return px.hint("merge")


def mask_area(px: DataFrame, name: str = "area") -> DataFrame:
    return px.groupBy(*_key(px)).agg(F.count("*").alias(name))


def _less(px: DataFrame, other: DataFrame) -> DataFrame:
    """The pixels of px that other has not: both meet in one aggregation, where masks that are dealt by key stay as they are."""
    both = px.withColumn("_other", F.lit(0)).unionByName(other.select(*px.columns, F.lit(1).alias("_other")))
    return both.groupBy(*px.columns).agg(F.max("_other").alias("_other")).where("_other = 0").drop("_other")


def branch_mask(whole: DataFrame, soma: DataFrame) -> DataFrame:
    return _less(whole, soma)


def process_skeleton(skeleton: DataFrame, soma: DataFrame) -> DataFrame:
    return _less(skeleton, soma)


def shifted(px: DataFrame, offsets=OFFSETS) -> DataFrame:
    """Every pixel at each of its neighbours' places, repeats included."""
    moves = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets)))
    return px.select(*_key(px), moves.alias("p")).select(*_key(px), "p.*")


def neighbours(px: DataFrame, conn: int = 8) -> DataFrame:
    """(key, y, x, ny, nx): each pixel with its set neighbours, found on the bitmap of its tile.

    Pixels on a tile's rim also go to the tiles that they touch, so that a mask may span any number of tiles. Pixels move once, or
    not at all if they are dealt by key; their neighbours never do."""
    key, kinds = _key(px), dict(px.dtypes)
    dy, dx = np.array(OFFSETS if conn == 8 else masks.CROSS).T
    reach = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (0, -1, 1))), lambda d: F.floor((F.col(c) + d) / TILE).cast("long")))
    inside = lambda c: F.pmod(F.col(c), F.lit(TILE)).between(1, TILE - 2)
    own = F.struct(*(F.floor(F.col(c) / TILE).cast("long").alias(t) for c, t in (("y", "_ty"), ("x", "_tx"))))
    # Few pixels lie on a rim: the others have one tile.
    all_tiles = F.flatten(F.transform(reach("y"), lambda a: F.transform(reach("x"), lambda b: F.struct(a.alias("_ty"), b.alias("_tx")))))
    tiles = px.dropna(subset=px.columns).select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    tiles = tiles.withColumn("_at", own).withColumn("_t", F.explode(F.when(inside("y") & inside("x"), F.array("_at")).otherwise(all_tiles)))
    tiles = tiles.select(*key, "_t._ty", "_t._tx", "y", "x", (F.col("_t") == F.col("_at")).cast("int").alias("_own"))

    def near(y, x, own):
        frame, at = _places(y, x)
        on, mine = frame.image(at), np.flatnonzero(own)
        place = (y[mine] - frame.top) * frame.width + (x[mine] - frame.left)
        i, k = np.nonzero(on[place[:, None] + (dy * frame.width + dx)])
        y, x = y[mine[i]], x[mine[i]]
        return {"y": y, "x": x, "ny": y + dy[k], "nx": x + dx[k]}

    found = _per_mask(tiles, near, "y long, x long, ny long, nx long", ["_own"])
    return found.select(*px.columns, "ny", "nx").withColumns({c: F.col(c).cast(kinds[c[-1]]) for c in ("y", "x", "ny", "nx")})


def neighbour_count(px: DataFrame) -> DataFrame:
    """(key, y, x, n): how many of the eight neighbours are set. Counts meet at places, in one shuffle."""
    votes = shifted(px).groupBy(*px.columns).agg(F.count("*").alias("n"))
    return px.join(_dealt(votes), px.columns, "left").fillna(0, ["n"])


def _tips(skeleton: DataFrame) -> DataFrame:
    return neighbour_count(skeleton).where("n = 1").drop("n")


def end_nodes(skeleton: DataFrame, soma: DataFrame) -> DataFrame:
    """Free tips: one neighbour and no soma pixel around."""
    return _tips(skeleton).join(_dealt(shifted(soma).distinct()), skeleton.columns, "left_anti")


def start_nodes(skeleton: DataFrame, soma: DataFrame) -> DataFrame:
    """Tips next to the soma."""
    return _tips(skeleton).join(_dealt(shifted(soma).distinct()), skeleton.columns, "left_semi")


def _per_mask(px: DataFrame, fn: Callable, schema: str, extra: Sequence[str] = (), parts: int = 0) -> DataFrame:
    """fn: arrays of a mask's y, x and extra columns to columns, which follow the key's.

    Masks are dealt and sorted by key and then read as batches that are cut where the key changes: a call of Python per mask
    costs a numpy call and no group of its own. A mask that a batch's end cuts goes on in the next one. Masks that are dealt by
    key already stay where they are: the window asks for masks that are whole and sorted, for which Spark shuffles only if they
    are not, where `repartition` always would. `parts`, if given, are as many, whatever their bytes (pixels pack well, so that
    parts of some megabytes hold millions)."""
    kinds = dict(px.dtypes)
    rest = ["y", "x", *extra]
    key = [c for c in px.columns if c not in rest]
    names = [c.split()[0] for c in schema.split(", ")]

    def measured(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(starts):
            return
        columns = [table[c].to_numpy().astype(np.float64 if kinds[c] == "double" else np.int64) for c in rest]
        found = [fn(*(c[a:b] for c in columns)) for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True)]
        keys = table.select(key).take(np.repeat(starts, [len(f[names[0]]) for f in found]))
        yield from pa.table({k: keys[k] for k in key} | {c: pa.array(np.concatenate([f[c] for f in found])) for c in names}).to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, key):
            yield from measured(table, starts)

    dealt = px.select(*key, *rest)
    if parts:
        dealt = dealt.repartition(parts, *key).sortWithinPartitions(*key)
    else:
        dealt = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*key)))
    return dealt.mapInArrow(task, ", ".join([*(f"{k} {kinds[k]}" for k in key), schema]))


def _places(y: np.ndarray, x: np.ndarray) -> tuple[masks.Frame, np.ndarray]:
    frame = masks.Frame(y, x)
    return frame, frame.places(y, x)


def _coordinates(frame: masks.Frame, at: np.ndarray) -> dict[str, np.ndarray]:
    return dict(zip("yx", frame.coordinates(at), strict=True))


def skeletonize(px: DataFrame) -> DataFrame:
    def thin(y, x):
        frame, at = _places(y, x)
        return _coordinates(frame, masks.thinned(frame, at))

    return _per_mask(px, thin, "y long, x long")


def components(px: DataFrame, conn: int = 8) -> DataFrame:
    """(key, y, x, component), numbered from 1 by first pixel. For masks of any size see `slide_components`."""

    def label(y, x):
        frame, at = _places(y, x)
        return _coordinates(frame, at) | {"component": masks.labels(frame, at, conn) + 1}

    return _per_mask(px, label, "y long, x long, component long")


def slide_components(px: DataFrame, conn: int = 8, tile: int = 512) -> DataFrame:
    """(key, y, x, cy, cx): the component of each pixel, named by its first pixel, for masks that span any number of tiles.

    Each tile is labelled in a task of its own and stored as runs of a row. Pixels of a tile's rim then meet their neighbours in
    other tiles by equality; the pairs of labels that touch (not pixels) are joined to components by rounds of minima. Runs meet
    their component's name and become pixels last. Repeated pixels count once."""
    key = _key(px)
    ty, tx = (F.floor(F.col(c) / tile).cast("long") for c in ("y", "x"))

    def label(y, x):
        frame, at = _places(y, x)
        start, end, root = masks.run_roots(frame, at, conn)
        return dict(zip(("y", "x", "ly", "lx"), (*frame.coordinates(start), *frame.coordinates(start[root])), strict=True)) | {"n": end - start}

    parts = max(px.sparkSession.sparkContext.defaultParallelism, px.count() // TASK_PIXELS + 1)
    tiles = px.select(*key, ty.alias("_ty"), tx.alias("_tx"), "y", "x")
    local = stored(_per_mask(tiles, label, "y long, x long, ly long, lx long, n long", parts=parts).drop("_ty", "_tx"), "tiles")
    vertex = lambda y, x: F.struct(*key, F.col(y).alias("y"), F.col(x).alias("x"))
    end = F.col("x") + F.col("n") - 1
    across, ends = F.pmod("y", F.lit(tile)).isin(0, tile - 1), F.array_distinct(F.array("x", end))
    places = F.when(across, F.sequence("x", end)).otherwise(F.filter(ends, lambda x: F.pmod(x, F.lit(tile)).isin(0, tile - 1)))
    rim = local.select(*key, "y", F.explode(places).alias("x"), vertex("ly", "lx").alias("a"))
    # Half of the directions find every pair once.
    offsets = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if conn == 8 else [])]
    moves = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets)))
    near = rim.select(*key, "a", moves.alias("p")).select(*key, "a", "p.*")
    edges = near.join(rim.withColumnRenamed("a", "b"), [*key, "y", "x"]).select("a", "b").where("a <> b").distinct()
    names = min_labels(edges)
    found = local.withColumn("id", vertex("ly", "lx")).join(names, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return found.select(*key, "y", F.explode(F.sequence("x", end)).alias("x"), F.col("label.y").alias("cy"), F.col("label.x").alias("cx"))


def component_count(px: DataFrame, conn: int = 8) -> DataFrame:
    return _per_mask(px, lambda y, x: {"n_components": [masks.component_count(*_places(y, x), conn)]}, "n_components long")


def largest_component(px: DataFrame, conn: int = 4) -> DataFrame:
    """The pixels of each mask's largest component, the first one on ties."""

    def largest(y, x):
        frame, at = _places(y, x)
        part = masks.labels(frame, at, conn)
        return _coordinates(frame, at[part == np.bincount(part).argmax()])

    return _per_mask(px, largest, "y long, x long")


def clean_masks(px: DataFrame, least: int = 2, conn: int = 4, dry_run: bool = False) -> DataFrame:
    """Masks of at least `least` components cut to the largest; unchanged in a dry run."""
    if dry_run:
        return px

    def clean(y, x):
        frame, at = _places(y, x)
        part = masks.labels(frame, at, conn)
        return _coordinates(frame, at if part.max() + 1 < least else at[part == np.bincount(part).argmax()])

    return _per_mask(px, clean, "y long, x long")


def junctions(skeleton: DataFrame) -> DataFrame:
    """(key, num_junctions): clusters of pixels with three or more neighbours; masks without one have no row."""
    return _per_mask(skeleton, lambda y, x: {"num_junctions": [masks.junction_clusters(*_places(y, x))]}, "num_junctions long").where("num_junctions > 0")


def perimeter(px: DataFrame, name: str = "perimeter") -> DataFrame:
    return _per_mask(px, lambda y, x: {name: [masks.border_length(*_places(y, x))]}, f"{name} double")


def convex_hull(px: DataFrame) -> DataFrame:
    return _per_mask(px, lambda y, x: dict(zip(("hull_area", "hull_perimeter"), ([v] for v in masks.convex_hull(*_places(y, x))), strict=True)), "hull_area double, hull_perimeter double")


def betti(px: DataFrame) -> DataFrame:
    return _per_mask(px, lambda y, x: dict(zip(("b0", "b1"), ([v] for v in masks.betti_numbers(*_places(y, x))), strict=True)), "b0 long, b1 long")


def betti_diff(a: DataFrame, b: DataFrame, w0: float = 1.0, w1: float = 0.5) -> DataFrame:
    x, y = betti(a), betti(b).withColumnsRenamed({"b0": "c0", "b1": "c1"})
    both = x.join(y, _key(a), "full").fillna(0, ["b0", "b1", "c0", "c1"])
    return both.select(*_key(a), (w0 * F.abs(F.col("b0") - F.col("c0")) + w1 * F.abs(F.col("b1") - F.col("c1"))).alias("betti_loss"))


def fill_holes(px: DataFrame, height: int, width: int) -> DataFrame:
    return _per_mask(px, lambda y, x: dict(zip("yx", masks.filled_places(y, x, height, width), strict=True)), "y long, x long")


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def shape_ratios(df: DataFrame) -> DataFrame:
    """Ratios of areas, perimeters, hulls and nodes; 0 where the divisor is 0."""
    c, pi4 = F.col, 4 * math.pi
    return df.withColumns(
        {
            "end_to_start_ratio": _ratio(c("num_end_nodes"), c("num_start_nodes")),
            "total_nodes": c("num_end_nodes") + c("num_start_nodes"),
            "soma_circularity": _ratio(pi4 * c("soma_area"), c("soma_perimeter") * c("soma_perimeter")),
            "cell_solidity": _ratio(c("cell_area"), c("cell_convex_hull_area")),
            "cell_convexity": _ratio(c("cell_convex_hull_perimeter"), c("cell_perimeter")),
            "cell_circularity": _ratio(pi4 * c("cell_area"), c("cell_perimeter") * c("cell_perimeter")),
            "cell_convex_circularity": _ratio(pi4 * c("cell_convex_hull_area"), c("cell_convex_hull_perimeter") * c("cell_convex_hull_perimeter")),
        }
    )


def sholl(skeleton: DataFrame, soma: DataFrame) -> DataFrame:
    """Rings of skeleton pixels around the soma's centroid (else the skeleton's): radii, peak, sum."""
    key = _key(skeleton)
    mid = lambda px, s: px.groupBy(*key).agg(F.avg("y").alias(f"cy{s}"), F.avg("x").alias(f"cx{s}"))
    centre = mid(skeleton, "k").join(_dealt(mid(soma, "s")), key, "left").select(*key, F.coalesce("cys", "cyk").alias("cy"), F.coalesce("cxs", "cxk").alias("cx"))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    rings = skeleton.join(_dealt(centre), key).withColumn("d", F.sqrt(dy * dy + dx * dx)).withColumn("r", F.floor(F.col("d") + 0.5).cast("long"))
    # Radii run from 1 to the largest distance, rounded up.
    last = F.ceil(F.max("d").over(Window.partitionBy(*key)))
    hits = rings.withColumn("last", last).where((F.col("r") >= 1) & (F.col("r") <= F.col("last"))).groupBy(*key, "r").agg(F.count("*").alias("n"))
    out = hits.groupBy(*key).agg(
        F.min("r").alias("sholl_min_radius"), F.max_by("r", F.struct("n", -F.col("r"))).alias("sholl_peak_radius"), F.max("r").alias("sholl_max_radius"), F.max("n").alias("sholl_peak"), F.sum("n").alias("sholl_sum")
    )
    return centre.select(*key).join(_dealt(out), key, "left").fillna(0)


WHOLE, SOMA, SKELETON, CONNECTED = 1, 2, 4, 8
#: Counts, lengths and rings of a cell, in the order of the kernel's columns.
_FAMILIES = {
    "skeleton_length": "long", "num_junctions": "long", "num_components": "long", "num_end_nodes": "long", "num_start_nodes": "long", "soma_area": "long", "soma_perimeter": "double", "cell_area": "long", "cell_perimeter": "double",
    "cell_convex_hull_area": "double", "cell_convex_hull_perimeter": "double", "branch_area": "long", "branch_perimeter": "double", "sholl_min_radius": "long", "sholl_peak_radius": "long", "sholl_max_radius": "long", "sholl_peak": "long", "sholl_sum": "long",
}


def _measure(y: np.ndarray, x: np.ndarray, mask: np.ndarray) -> dict[str, list]:
    """All measures of one cell from its masks' pixels in one frame; each bitmap and its neighbour codes are made once."""
    frame = masks.Frame(y, x)
    whole, soma, skeleton, connected = (frame.places(y[mask == m], x[mask == m]) for m in (WHOLE, SOMA, SKELETON, CONNECTED))
    if not len(skeleton):
        skeleton = masks.thinned(frame, connected if len(connected) else whole)
    body = frame.image(soma)
    process, branch = skeleton[body[skeleton] == 0], whole[body[whole] == 0]
    degree, near_body = masks.COUNT[frame.codes(frame.image(process), process)], frame.codes(body, process) > 0
    py, px_ = frame.coordinates(process)
    cy, cx = frame.coordinates(soma if len(soma) else process)
    values = [
        len(process), masks.component_count(frame, process[degree >= 3]), masks.component_count(frame, process), int(((degree == 1) & ~near_body).sum()), int(((degree == 1) & near_body).sum()),
        len(soma), masks.border_length(frame, soma), len(whole), masks.border_length(frame, whole), *masks.convex_hull(frame, whole), len(branch), masks.border_length(frame, branch),
        *masks.sholl_rings(py, px_, float(cy.mean()) if len(cy) else 0.0, float(cx.mean()) if len(cx) else 0.0),
    ]
    return {name: [v] for name, v in zip(_FAMILIES, values, strict=True)}


def morphology(det: DataFrame, whole: DataFrame, soma: DataFrame, skeleton: DataFrame | None = None, connected: DataFrame | None = None) -> DataFrame:
    """All features of each detected cell and its box; empty masks give zeros.

    One grouped task measures a cell on the bitmap of its bounding box, so masks are shuffled once, tagged by what they are.
    The skeleton is `skeleton`, or thinned in the task from `connected` or else `whole`."""
    key = _key(whole)
    given = [(m, px) for m, px in ((WHOLE, whole), (SOMA, soma), (SKELETON, skeleton), (CONNECTED, connected)) if px is not None]
    tagged = reduce(DataFrame.unionByName, (px.select(*key, F.col("y").cast("int"), F.col("x").cast("int"), F.lit(m).cast("tinyint").alias("mask")) for m, px in given))
    found = _per_mask(tagged, _measure, ", ".join(f"{c} {t}" for c, t in _FAMILIES.items()), ["mask"])
    return shape_ratios(det.join(_dealt(found), key, "left").fillna(0, list(_FAMILIES)))


def _pixel_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, y, x, p, t): values of two masks where either has a pixel; a mask without values counts 1."""
    value = lambda px, name: px.withColumn(name, F.col("value").cast("double")).drop("value") if "value" in px.columns else px.withColumn(name, F.lit(1.0))
    return _met({"p": value(a, "p"), "t": value(b, "t")}, [c for c in a.columns if c != "value"])


def _met(masks_: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, a column per mask): values of masks (keys, value under the mask's name) where any has a pixel, else 0; one aggregation."""
    rows = (px.select(*keys, *((F.col(n) if n == name else F.lit(None)).cast("double").alias(n) for n in masks_)) for name, px in masks_.items())
    return reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(*(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in masks_))


def binary_metrics(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    """dice, iou, precision, recall of predicted a against target b per key."""
    key = [c for c in a.columns if c not in ("y", "x", "value")]
    p, t = F.col("p"), F.col("t")
    s = _pixel_join(a, b).groupBy(*key).agg(F.sum(p * t).alias("tp"), F.sum(p * (1 - t)).alias("fp"), F.sum((1 - p) * t).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*key, ((2 * tp + eps) / (2 * tp + fp + fn + eps)).alias("dice"), ((tp + eps) / (tp + fp + fn + eps)).alias("iou"), ((tp + eps) / (tp + fp + eps)).alias("precision"), ((tp + eps) / (tp + fn + eps)).alias("recall"))


def dice_iou(a: DataFrame, b: DataFrame, eps: float = 1e-6) -> DataFrame:
    return binary_metrics(a, b, eps).drop("precision", "recall")


def evaluate_regions(pred: DataFrame, whole: DataFrame, soma: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(key, region, dice, iou, precision, recall, pixels): overall, soma (recall in all four), branches (outside the soma)."""
    key = [c for c in pred.columns if c not in ("y", "x", "value")]
    value = lambda px, name: px.withColumn(name, F.col("value").cast("double") if "value" in px.columns else F.lit(1.0))
    px = _met({"p": value(pred, "p"), "t": value(whole, "t"), "s": value(soma, "s")}, [*key, "y", "x"]).withColumn("p", (F.col("p") > 0.5).cast("double"))
    p, t, s = F.col("p"), F.col("t"), F.col("s")
    bt, bp = t * (1 - s), p * (1 - s)
    sums = px.groupBy(*key).agg(*(F.sum(v).alias(n) for n, v in {"pt": p * t, "ps": p, "ts": t, "ss": s, "sp": p * s, "bts": bt, "bps": bp, "bpt": F.when(bp > 0.5, 1.0).otherwise(0.0) * bt, "bpr": bp * bt, "bpb": F.when(bp > 0.5, 1.0).otherwise(0.0)}.items()))
    c = F.col

    def region(name, dice, iou, precision, recall, n):
        return F.struct(F.lit(name).alias("region"), dice.alias("dice"), iou.alias("iou"), precision.alias("precision"), recall.alias("recall"), n.cast("long").alias("pixels"))

    overall = region("overall", (2 * c("pt") + eps) / (c("ps") + c("ts") + eps), (c("pt") + eps) / (c("ps") + c("ts") - c("pt") + eps), (c("pt") + eps) / (c("ps") + eps), (c("pt") + eps) / (c("ts") + eps), c("ts"))
    recall = c("sp") / c("ss")
    body = F.when(c("ss") > 0, region("soma", recall, recall, recall, recall, c("ss")))
    arms = F.when(c("bts") > 0, region("branches", (2 * c("bpt") + eps) / (c("bpb") + c("bts") + eps), (c("bpt") + eps) / (c("bpb") + c("bts") - c("bpt") + eps), (c("bpr") + eps) / (c("bps") + eps), (c("bpr") + eps) / (c("bts") + eps), c("bts")))
    return sums.select(*key, F.explode(F.filter(F.array(overall, body, arms), lambda r: r.isNotNull())).alias("r")).select(*key, "r.*")


def morphology_similarity(pred: DataFrame, target: DataFrame, weights: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, score) of two feature tables; 0 where either cell is empty or absent."""
    side = lambda df, name: df.select(*key, (F.col("cell_area") > 0).alias(f"_{name}"), *(F.col(f).cast("double").alias(f"_{name}{k}") for k, f in enumerate(features)))
    both = side(pred, "p").join(side(target, "t"), list(key), "full")
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"_p{k}").alias("p"), F.col(f"_t{k}").alias("t")) for k, f in enumerate(features))))
    rows = both.select(*key, (F.col("_p") & F.col("_t")).alias("_full"), each).join(F.broadcast(weights), "feature", "left")
    part = F.coalesce("weight", F.lit(0.0)) * (1 - F.abs(F.col("p") - F.col("t")) / (F.abs("p") + F.abs("t") + 1e-8))
    kept = lambda v: F.sum(F.when(F.col("_full"), v))
    sums = rows.groupBy(*key).agg(kept(part).alias("_part"), kept(F.coalesce("weight", F.lit(0.0))).alias("_weight"))
    return sums.select(*key, F.coalesce(F.when(F.col("_weight") > 0, F.col("_part") / F.col("_weight")), F.lit(0.0)).alias("score"))


def rle_encode(px: DataFrame, height: int, width: int) -> DataFrame:
    """(key, counts): runs down the columns, zeros first."""
    key = _key(px)
    w = Window.partitionBy(*key).orderBy("pos")
    pos = px.withColumn("pos", (F.col("x") * height + F.col("y")).cast("long"))
    runs = pos.withColumn("island", F.col("pos") - F.row_number().over(w)).groupBy(*key, "island").agg(F.min("pos").alias("a"), F.count("*").alias("n"))
    gaps = runs.withColumn("zeros", F.col("a") - F.coalesce(F.lag(F.col("a") + F.col("n")).over(Window.partitionBy(*key).orderBy("a")), F.lit(0)))
    lists = gaps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("a", "zeros", "n"))).alias("r"))
    body = F.flatten(F.transform("r", lambda r: F.array(r["zeros"], r["n"])))
    last = F.lit(height * width) - F.element_at("r", -1)["a"] - F.element_at("r", -1)["n"]
    return lists.select(*key, F.when(last > 0, F.concat(body, F.array(last))).otherwise(body).alias("counts"))


def expanded(batch: pa.RecordBatch, height: int) -> pa.Table:
    """Rows (key, counts) as rows (key, y, x) of the set pixels."""
    places = [masks.set_places(np.asarray(c.values.to_numpy(zero_copy_only=False), np.int64)) if c.is_valid else np.zeros(0, np.int64) for c in batch.column("counts")]
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    keys = batch.drop_columns(["counts"]).take(pa.array(np.repeat(np.arange(len(places)), [len(p) for p in places])))
    return pa.table(dict(zip(keys.schema.names, keys.columns, strict=True)) | {"y": pa.array(at % height), "x": pa.array(at // height)})


def rle_decode(runs: DataFrame, height: int) -> DataFrame:
    """(key, y, x) of the set runs (W8). A row is expanded by itself, in one pass over its runs."""
    kinds = {c: t for c, t in runs.dtypes if c != "counts"}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):  # few masks' pixels at once
                yield from expanded(batch.slice(i, 256), height).to_batches()

    return runs.select(*kinds, "counts").mapInArrow(task, ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), "y long, x long"]))


def otsu_mask(gray: DataFrame, annotation: DataFrame) -> DataFrame:
    """(key, y, x) of the pixels in the annotation that are as dark as the threshold, after a 3x3 opening.

    gray: (key, y, x, gray, and optionally hue 0-179, saturation 0-1) of whole tiles; outside the annotation, or without a gray, a pixel
    counts as 255. The threshold maximises the between-class variance of the 256-bin histogram (`otsu_threshold`). Gray and
    annotation of a key meet on its bitmap in one pass, so that pixels move once, or not at all if they are dealt by key."""
    key, kinds = _key(annotation), dict(annotation.dtypes)
    kind = "double" if dict(gray.dtypes)["gray"] in ("float", "double") or dict(gray.dtypes)["gray"].startswith("decimal") else "long"
    blue = F.expr("hue between 90 and 140 and saturation >= 0.1") if "hue" in gray.columns else F.lit(False)
    side = lambda px, g, mark: px.dropna(subset=[*key, "y", "x"]).select(*key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), g.cast(kind).alias("_g"), mark.alias("_mark"))
    rows = side(gray, F.coalesce("gray", F.lit(255)), F.when(blue, _BLUE).otherwise(_GRAY)).unionByName(side(annotation, F.lit(255), F.lit(_MARKED)))

    def opened(y, x, g, mark):
        frame = masks.Frame(y, x)
        place = (y - frame.top) * frame.width + (x - frame.left)
        wanted, given = np.unique(place[mark == _MARKED]), mark != _MARKED
        if not len(wanted) or not given.any():
            return _coordinates(frame, place[:0])
        at = place[given]
        g = np.where(frame.image(wanted)[at] > 0, g[given], 255)
        dark = np.unique(at[g <= _otsu(g)])
        core = dark[frame.codes(frame.image(dark), dark) == 255]
        on = frame.image(core)
        for step in frame.ring:
            on[core + step] = 1
        on[place[mark == _BLUE]] = 0
        return _coordinates(frame, wanted[on[wanted] > 0])

    found = _per_mask(rows, opened, "y long, x long", ["_g", "_mark"])
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in ("y", "x")})


#: What a pixel's row is in `otsu_mask`.
_GRAY, _MARKED, _BLUE = 0, 1, 2


def _otsu(g: np.ndarray) -> float:
    """The threshold of `otsu_threshold` of one mask's values, by the same steps."""
    values, n = np.unique(g, return_counts=True)
    w0, s0 = np.cumsum(n), np.cumsum(n * values)
    w1 = w0[-1] - w0
    gap = s0 / w0 - (s0[-1] - s0) / np.maximum(w1, 1)
    return values[np.where(w1 > 0, 1.0 * w0 * w1 * gap * gap, 0.0).argmax()]


def otsu_threshold(values: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, threshold) of (key, g): the smallest gray of largest between-class variance."""
    hist = values.groupBy(*key, "g").agg(F.count("*").alias("n"))
    upto, whole = Window.partitionBy(*key).orderBy("g"), Window.partitionBy(*key)
    h = hist.select(*key, "g", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("g")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("g")).over(whole).alias("s"))
    w1, d = F.col("w") - F.col("w0"), F.lit(1.0)
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    between = F.coalesce(d * F.col("w0") * w1 * gap * gap, F.lit(0.0))
    return h.withColumn("b", between).groupBy(*key).agg(F.max_by("g", F.struct("b", -F.col("g"))).alias("threshold"))


def rasterize(polygons: DataFrame, polygon: str = "polygon") -> DataFrame:
    """(key, y, x) of the pixel centres inside each key's polygons (array<struct<x, y>>), edges included on the low side.

    Scanlines: an edge gives its crossing of each row it passes, a row's crossings in order bound its spans, and spans become
    pixels. Work grows with the outline and the pixels set, not with the box times the edges. Several rings of a key count
    together, so that a ring inside another cuts a hole."""
    key = [c for c in polygons.columns if c != polygon]
    ring, row = F.col(polygon), lambda v: F.ceil(v - 0.5).cast("long")
    edge = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    edges = polygons.where(F.size(ring) > 2).select(*key, F.inline(edge))
    first, last = row(F.least("ay", "by")), row(F.greatest("ay", "by")) - 1
    passed = edges.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("y"))
    crossing = (F.col("bx") - F.col("ax")) * (F.col("y") + 0.5 - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    rows = passed.groupBy(*key, "y").agg(F.sort_array(F.collect_list(crossing)).alias("c"))  # as many as edges cross a row
    spans = F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(2)), lambda i: F.struct(row(F.element_at("c", i)).alias("a"), (row(F.element_at("c", i + 1)) - 1).alias("b")))
    return rows.select(*key, "y", F.inline(spans)).where("b >= a").select(*key, "y", F.explode(F.sequence("a", "b")).alias("x"))


def grow(prob: DataFrame, threshold: float = 0.5, grow_threshold: float = 0.17, rounds: int = 15) -> DataFrame:
    """(key, y, x): positives grown through pixels above a lower threshold, a step a round, never removed.

    Per mask, as every round needs the last one's pixels."""

    def spread(y, x, p):
        frame = masks.Frame(y, x)
        places = lambda keep: frame.places(y[keep], x[keep])
        return _coordinates(frame, masks.grown(frame, places(p > threshold), places(p > grow_threshold), rounds))

    return _per_mask(prob.withColumn("p", F.col("p").cast("double")), spread, "y long, x long", ["p"])


def confident_crops(prob: DataFrame, threshold: float = 0.5, cut: float = 0.5) -> DataFrame:
    """Pixels of crops whose mean probability reaches the threshold, labelled at the cut."""
    key = [c for c in prob.columns if c not in ("y", "x", "p")]
    sure = prob.groupBy(*key).agg(F.avg("p").alias("m")).where(F.col("m") >= threshold).select(*key)
    return prob.join(_dealt(sure), key, "left_semi").withColumn("label", (F.col("p") >= cut).cast("int"))
