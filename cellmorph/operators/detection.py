"""Detection evaluation (D1-D4), by class where the boxes have one."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored, whole_groups

#: Ranges of confidence that are counted first, so that no task holds a whole precision-recall curve.
RANGES = 1000
#: Pairs of boxes that are looked at together.
PAIRS = 1 << 16
#: Strips of the tallest box's height, and of all boxes at most.
STRIPS, MOST_STRIPS = 4, 1000
BOX = ["xmin", "ymin", "xmax", "ymax"]
#: The overlaps that a mean average precision is the mean over.
OVERLAPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def box_iou(pred: DataFrame, truth: DataFrame, image: Sequence[str], least: float = 0.0) -> DataFrame:
    """(image, pred_id, true_id, conf, iou) of boxes of one image that overlap more than `least`.

    With a class among the columns `image`, only boxes of one class meet. Boxes of both kinds are dealt and sorted by image, each
    row shuffled once; in a task a box meets only those that begin near it (`_meetings`), so that work follows the pairs that
    overlap and not all pairs of an image. Boxes without a corner overlap none. Only where pairs that don't overlap are wanted
    too (`least` below 0) is it a join."""
    if least < 0:
        return _every_pair(pred, truth, image, least)
    kinds, ids = dict(pred.dtypes) | {"true_id": dict(truth.dtypes)["true_id"]}, ["pred_id", "true_id", "conf"]
    side = lambda df, own, real: df.dropna(subset=[*image, *BOX]).select(*image, *((F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c) for c in ids), *(F.col(c).cast("double").alias(c) for c in BOX), F.lit(real).alias("_true"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, image):
            real, group = table["_true"].to_numpy(), np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
            corners = np.stack([table[c].to_numpy() for c in BOX], 1)
            own, other = np.flatnonzero(~real), np.flatnonzero(real)
            table = table.combine_chunks()
            for i, j, iou in _meetings(corners[own], group[own], corners[other], group[other], least):
                # A row for each box p, so that its names are sent once; pairs of a box follow each other.
                at = np.flatnonzero(np.diff(i, prepend=-1))
                true = table["true_id"].take(other[j]).combine_chunks()
                hits = pa.ListArray.from_arrays(pa.array([*at, len(i)], pa.int32()), pa.StructArray.from_arrays([true, pa.array(iou)], ["true_id", "iou"]))
                made = table.select([*image, "pred_id", "conf"]).take(own[i[at]]).append_column("hits", hits)
                yield from made.to_batches()

    dealt = side(pred, ("pred_id", "conf"), False).unionByName(side(truth, ("true_id",), True)).repartition(*image).sortWithinPartitions(*image)
    found = dealt.mapInArrow(meet, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*image, "pred_id", "conf"]), f"hits array<struct<true_id: {kinds['true_id']}, iou: double>>"]))
    return found.select(*image, "pred_id", "conf", F.inline("hits")).select(*image, *ids, "iou")


def _every_pair(pred: DataFrame, truth: DataFrame, image: Sequence[str], least: float) -> DataFrame:
    p = pred.select(*image, "pred_id", "conf", *(F.col(c).alias(f"p_{c}") for c in BOX))
    t = truth.select(*image, "true_id", *(F.col(c).alias(f"t_{c}") for c in BOX))
    both = p.join(t, list(image))
    side = lambda a: F.greatest(F.least(f"p_{a}max", f"t_{a}max") - F.greatest(f"p_{a}min", f"t_{a}min"), F.lit(0)).cast("double")
    size = lambda s: (F.col(f"{s}_xmax") - F.col(f"{s}_xmin")) * (F.col(f"{s}_ymax") - F.col(f"{s}_ymin"))
    inter = side("x") * side("y")
    union = size("p") + size("t") - inter
    return both.withColumn("iou", F.when(union > 0, inter / union).otherwise(0.0)).where(F.col("iou") > least).select(*image, "pred_id", "true_id", "conf", "iou")


def _ious(p: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The overlaps of boxes i of p and j of t, both a row for each of BOX."""
    low_x, low_y, high_x, high_y = p[:, i]
    x0, y0, x1, y1 = t[:, j]
    size = (high_x - low_x) * (high_y - low_y) + (x1 - x0) * (y1 - y0)
    inter = np.maximum(np.minimum(high_x, x1) - np.maximum(low_x, x0), 0) * np.maximum(np.minimum(high_y, y1) - np.maximum(low_y, y0), 0)
    union = size - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _meetings(p: np.ndarray, gp: np.ndarray, t: np.ndarray, gt: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, iou) of boxes p and t (xmin, ymin, xmax, ymax; a row each) of the same image (gp, gt) that overlap more than `least` >= 0.

    Of two such boxes neither begins further before the other than 1 - `least` of its own side, and the sides' ratio is `least` at
    worst. Boxes t are sorted by image, strip of their ymin and xmin; a box p looks at a stretch of each strip that it can reach.
    PAIRS or one box's share of a strip are looked at together, whatever the image holds."""
    if not len(p) or not len(t):
        return
    y0, x0 = t[:, 1].min(), t[:, 0].min()
    tall, wide = (t[:, 3] - t[:, 1]).max(), (t[:, 2] - t[:, 0]).max()
    if tall <= 0 or wide <= 0:
        return
    height = max(tall / STRIPS, np.ptp(t[:, 1]) / MOST_STRIPS)
    strips, span = int(np.ptp(t[:, 1]) / height) + 1, np.ptp(t[:, 0]) + 1.0
    strip = np.minimum(((t[:, 1] - y0) / height).astype(np.int64), strips - 1)
    key = (gt * strips + strip) * span + (t[:, 0] - x0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    slack = 1e-15 * (max(gp.max(), gt.max()) + 1) * strips * span + 1e-9 * (1 + span + np.abs(p).max())

    def reach(lo: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        own = p[:, lo + 2] - p[:, lo]
        before = np.minimum(own / least, most) if least > 0 else np.full(len(p), most)
        return p[:, lo] - (1 - least) * before - slack, p[:, lo] + (1 - least) * own + slack

    (low_y, high_y), (low_x, high_x) = reach(1, tall), reach(0, wide)
    first = np.clip(np.floor((low_y - y0) / height), 0, strips).astype(np.int64)
    last = np.clip(np.floor((high_y - y0) / height), -1, strips - 1).astype(np.int64)
    seen = np.where((low_x - x0 <= span) & (high_x - x0 >= 0), np.maximum(last - first + 1, 0), 0)
    (wide_p, wide_t), looks, b = (np.ascontiguousarray(x.T) for x in (p, t)), np.cumsum(seen), 0
    while b < len(p):
        a, b = b, max(b + 1, int(np.searchsorted(looks, (looks[b - 1] if b else 0) + PAIRS, "right")))
        m = seen[a:b]
        box = np.repeat(np.arange(a, a + len(m)), m)
        cell = gp[box] * strips + first[box] + np.arange(len(box)) - np.repeat(np.cumsum(m) - m, m)
        low = np.searchsorted(key, cell * span + np.clip(low_x[box] - x0, 0, span), "left")
        n = np.maximum(np.searchsorted(key, cell * span + np.clip(high_x[box] - x0, 0, span - 0.5), "right") - low, 0)
        ends, at = np.cumsum(n), 0
        while at < len(box):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            i = np.repeat(box[at:to], n[at:to])
            j = order[np.arange(len(i)) + np.repeat(low[at:to] - (np.cumsum(n[at:to]) - n[at:to]), n[at:to])]
            at = to
            iou = _ious(wide_p, wide_t, i, j)
            keep = (iou > least) & (gp[i] == gt[j])
            if keep.any():
                yield i[keep], j[keep], iou[keep]


def _ids(column: pa.ChunkedArray, own: np.ndarray) -> np.ndarray:
    """A column of which only the rows `own` count."""
    if pa.types.is_integer(column.type) and column.null_count == len(own) - own.sum():
        return pc.fill_null(column, 0).to_numpy()
    return np.array([*column.to_pylist(), None], object)[:-1]


def _numbered(ids: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones in order, null first."""
    if ids.dtype != object:
        return np.unique(ids, return_inverse=True)[1]
    place = {v: i for i, v in enumerate(sorted(set(ids), key=lambda v: (False,) if v is None else (True, v)))}
    return np.array([place[v] for v in ids], np.int64)


def _overlaps(p: np.ndarray, t: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, iou) of boxes p and t (xmin, ymin, xmax, ymax; a row each) that overlap by `least` or more.

    Such boxes share at least that part of the wider one's width, so that a box meets only those that begin near it."""
    order = np.argsort(t[:, 0], kind="stable")
    t, wide = t[order], p[:, 2] - p[:, 0]
    if least > 0:
        slack = 1e-9 * (1 + np.abs(p[:, 0]) + np.abs(wide))
        low = np.searchsorted(t[:, 0], p[:, 0] - wide * (1 - least) / least - slack, "left")
        n = np.maximum(np.searchsorted(t[:, 0], p[:, 0] + wide * (1 - least) + slack, "right") - low, 0)
    else:
        low, n = np.zeros(len(p), np.int64), np.full(len(p), len(t))
    size_p, size_t = wide * (p[:, 3] - p[:, 1]), (t[:, 2] - t[:, 0]) * (t[:, 3] - t[:, 1])
    found, ends, a = [], np.cumsum(n), 0
    while a < len(p):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(a, b), n[a:b])
        j = np.arange(len(i)) + np.repeat(low[a:b] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b])
        side = lambda lo, hi, i=i, j=j: np.maximum(np.minimum(p[i, hi], t[j, hi]) - np.maximum(p[i, lo], t[j, lo]), 0)
        inter = side(0, 2) * side(1, 3)
        union = size_p[i] + size_t[j] - inter
        iou = np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)
        keep = iou > least - 1e-12
        found.append((i[keep], order[j[keep]], iou[keep]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def match_boxes(pred: DataFrame, truth: DataFrame, image: Sequence[str], thresholds: Sequence[float] = OVERLAPS) -> DataFrame:
    """(image, pred_id, conf, threshold, tp): boxes by falling confidence take the free true box of best overlap.

    Boxes of both kinds are dealt and sorted by image, each row shuffled once; a task walks an image's overlaps once: a bit for
    each threshold tells which of them a box still is free at. The result is stored, a row per box, as every curve reads it
    several times."""
    limits = np.sort(np.array(thresholds, float))
    kinds, box = dict(pred.dtypes), ["xmin", "ymin", "xmax", "ymax"]
    corners = [F.col(c).cast("double").alias(c) for c in box]
    given = pred.select(*image, "pred_id", F.lit(None).cast(dict(truth.dtypes)["true_id"]).alias("true_id"), "conf", *corners, F.lit(False).alias("_true"))
    real = truth.dropna(subset=list(image)).select(*image, F.lit(None).cast(kinds["pred_id"]).alias("pred_id"), "true_id", F.lit(None).cast(kinds["conf"]).alias("conf"), *corners, F.lit(True).alias("_true"))

    def hits(p: np.ndarray, t: np.ndarray, conf: np.ndarray, pid: np.ndarray, tid: np.ndarray) -> np.ndarray:
        i, j, iou = _overlaps(p, t, limits[0])
        order = np.lexsort((tid[j], -iou, pid[i], -conf[i]))
        reached = (1 << np.searchsorted(limits, iou[order], "right")) - 1
        taken_p, taken_t = [0] * (int(pid.max()) + 1), [0] * (int(tid.max()) + 1)
        for x, y, may in zip(pid[i[order]].tolist(), tid[j[order]].tolist(), reached.tolist(), strict=True):
            free = may & ~taken_p[x] & ~taken_t[y]
            taken_p[x] |= free
            taken_t[y] |= free
        return np.array(taken_p, np.int64)[pid]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, image):
            real = table["_true"].to_numpy()
            corners = np.stack([table[c].to_numpy() for c in box], 1)
            conf = pc.fill_null(table["conf"].cast(pa.float64()), np.inf).to_numpy()  # null ones come first
            pid, tid, found = _ids(table["pred_id"], ~real), _ids(table["true_id"], real), np.zeros(table.num_rows, np.int64)
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                own, other = np.flatnonzero(~real[a:b]) + a, np.flatnonzero(real[a:b]) + a
                if len(own) and len(other):
                    found[own] = hits(corners[own], corners[other], conf[own], _numbered(pid[own]), _numbered(tid[other]))
            unnamed = pc.is_null(table["pred_id"]).to_numpy()
            made = table.select([*image, "pred_id", "conf"]).append_column("_hits", pa.array(np.where(unnamed, 0, found)))
            yield from made.filter(pa.array(~real)).to_batches()

    dealt = given.unionByName(real).repartition(*image).sortWithinPartitions(*image)
    found = stored(dealt.mapInArrow(walk, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*image, "pred_id", "conf"]), "_hits long"])), "matches")
    each = F.inline(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.shiftright("_hits", k).bitwiseAND(1).cast("int").alias("tp")) for k, t in enumerate(limits))))
    return found.select(*image, "pred_id", "conf", each)


def average_precision(matches: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, ap): area under the monotone precision-recall curve of each class (columns `by`).

    Boxes of one confidence enter together. The curve is exact: boxes are counted per range of confidence first, then
    within each range. Classes of `truth` without any box have 0, boxes of classes without a true one don't count."""
    keys = [*by, "threshold"]
    steps = matches.groupBy(*keys, "conf").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")).withColumn("r", F.floor(F.col("conf") * RANGES))
    ranges = steps.groupBy(*keys, "r").agg(F.sum("tp").alias("tps"), F.sum("n").alias("ns"))
    above = Window.partitionBy(*keys).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "r", F.coalesce(F.sum("tps").over(above), F.lit(0)).alias("tp0"), F.coalesce(F.sum("ns").over(above), F.lit(0)).alias("n0"))
    down = Window.partitionBy(*keys, "r").orderBy(F.desc("conf"))
    precision = (F.col("tp0") + F.sum("tp").over(down)) / (F.col("n0") + F.sum("n").over(down))
    curve = steps.join(ranges, [*keys, "r"]).select(*keys, "r", "conf", "tp", precision.alias("precision"))
    # The best precision at this confidence or any lower one: within the range, and in those below.
    below = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    best = curve.groupBy(*keys, "r").agg(F.max("precision").alias("m")).select(*keys, "r", F.max("m").over(below).alias("later"))
    own = Window.partitionBy(*keys, "r").orderBy("conf")
    curve = curve.select(*keys, "r", "tp", F.max("precision").over(own).alias("own")).join(best, [*keys, "r"])
    area = curve.groupBy(*keys).agg(F.sum(F.greatest("own", F.coalesce("later", F.lit(0.0))) * F.col("tp")).alias("area"))
    return _of_classes(truth, matches, by).join(area, keys, "left").select(*keys, (F.coalesce("area", F.lit(0.0)) / F.col("n_true")).alias("ap"))


def _of_classes(truth: DataFrame, matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_true, threshold): true boxes of each class, for each threshold that the matches have."""
    counts = truth.groupBy(*by).agg(F.count("*").alias("n_true")).where("n_true > 0")
    thresholds = matches.select("threshold").distinct().agg(F.collect_set("threshold").alias("ts"))
    return counts.join(F.broadcast(thresholds), F.lit(True)).select(*by, "n_true", F.explode("ts").alias("threshold"))


def mean_average_precision(matches: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, ap50, ap50_95) of each class, and their means over classes in a row whose class is null."""
    ap = average_precision(matches, truth, by)
    found = ap.groupBy(*by).agg(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    if not by:
        return found
    whole = found.agg(F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95"))
    return found.unionByName(whole.select(*(F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in by), "ap50", "ap50_95"))


def precision_recall_at(matches: DataFrame, truth: DataFrame, conf: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, threshold, precision, recall) of the boxes above a confidence; precision is null where there are none."""
    s = matches.where(F.col("conf") > conf).groupBy(*by, "threshold").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    every = _of_classes(truth, matches, by).join(s, [*by, "threshold"], "left")
    return every.select(*by, "threshold", (F.col("tp") / F.col("n")).alias("precision"), (F.coalesce("tp", F.lit(0)) / F.col("n_true")).alias("recall"))
