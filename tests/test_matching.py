"""Boxes are matched in one pass over an image."""

import numpy as np

from cellmorph.operators import detection


def test_boxes_meet_only_those_that_begin_near_them(monkeypatch):
    monkeypatch.setattr(detection, "PAIRS", 50)
    rng = np.random.default_rng(3)
    box = lambda n: np.concatenate([a := rng.integers(0, 60, (n, 2)), a + rng.integers(0, 30, (n, 2))], 1).astype(float)
    p, t = box(200), box(150)
    for least in (0.5, 0.1, 0.0):
        side = lambda lo, hi: np.maximum(np.minimum(p[:, None, hi], t[None, :, hi]) - np.maximum(p[:, None, lo], t[None, :, lo]), 0)
        inter = side(0, 2) * side(1, 3)
        size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        union = size(p)[:, None] + size(t)[None] - inter
        iou = np.where(union > 0, inter / np.where(union > 0, union, 1), 0)
        i, j, found = detection._overlaps(p, t, least)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(iou > least - 1e-12)), strict=True)) and len(i) == len(set(zip(i.tolist(), j.tolist(), strict=True)))
        assert np.array_equal(found, iou[i, j])


def test_matching_of_named_boxes_without_a_join(spark):
    box = "image string, {}_id string, conf double, xmin int, ymin int, xmax int, ymax int"
    pred = spark.createDataFrame([("i", "b", 0.9, 0, 0, 10, 10), ("i", "a", 0.9, 0, 0, 10, 10), ("i", "c", None, 0, 0, 10, 9), ("i", None, 0.1, 40, 0, 50, 9), (None, "n", 0.5, 0, 0, 10, 10), ("z", "y", 0.5, 0, 0, 10, 10)], box.format("pred"))
    true = spark.createDataFrame([("i", "t", 1.0, 0, 0, 10, 10), ("i", "u", 1.0, 0, 0, 10, 10), (None, "v", 1.0, 0, 0, 10, 10)], box.format("true"))
    m = detection.match_boxes(pred, true, ["image"], [0.5])
    assert {(r["image"], r["pred_id"]): r["tp"] for r in m.collect()} == {("i", "a"): 1, ("i", "b"): 0, ("i", "c"): 1, ("i", None): 0, (None, "n"): 0, ("z", "y"): 0}
    assert "Join" not in m._jdf.queryExecution().executedPlan().toString()


def test_overlaps_without_all_pairs(spark, monkeypatch):
    """Against all pairs of an image: boxes of very different sizes, empty ones, negative places, missing corners and names; few candidates."""
    monkeypatch.setattr(detection, "PAIRS", 100)
    rng = np.random.default_rng(11)

    def boxes(n, whole):
        a, size = rng.uniform(-50, 300, (n, 2)), rng.choice([0, 3, 20, 30, 400], (n, 2), p=[0.05, 0.2, 0.4, 0.3, 0.05]) * rng.uniform(0.5, 1.5, (n, 2))
        b = np.concatenate([a, a + size], 1)
        return np.floor(b) if whole else b

    for whole, kind in ((True, "long"), (False, "double")):
        p, t = boxes(300, whole), boxes(200, whole)
        gp, gt = rng.integers(0, 3, 300), rng.integers(1, 4, 200)
        schema = "image string, {}_id long" + (", conf double" if whole else ", conf float") + "".join(f", {c} {kind}" for c in detection.BOX)
        row = lambda g, i, b: (f"i{g}", i, 0.5, *(int(x) if whole else float(x) for x in b))
        none = [(None, 900, 0.5, *[type(row(0, 0, p[0])[3])(x) for x in (0, 0, 9, 9)]), ("i1", 901, 0.5, None, *[type(row(0, 0, p[0])[3])(x) for x in (0, 9, 9)])]
        pred = spark.createDataFrame([row(g, i, b) for i, (g, b) in enumerate(zip(gp, p, strict=True))] + none, schema.format("pred"))
        true = spark.createDataFrame([row(g, i, b) for i, (g, b) in enumerate(zip(gt, t, strict=True))] + none, schema.format("true"))
        side = lambda lo, hi: np.maximum(np.minimum(p[:, None, hi], t[None, :, hi]) - np.maximum(p[:, None, lo], t[None, :, lo]), 0)  # noqa: E731, B023
        size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        inter = side(0, 2) * side(1, 3)
        union = size(p)[:, None] + size(t)[None] - inter
        iou = np.where(union > 0, inter / np.where(union > 0, union, 1), 0)
        for least in (0.0, 0.2, 0.7):
            made = detection.box_iou(pred, true, ["image"], least)
            assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
            assert made.columns == ["image", "pred_id", "true_id", "conf", "iou"]
            want = {(f"i{gp[i]}", i, j, 0.5, iou[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero((iou > least) & (gp[:, None] == gt[None]))), strict=True)}
            got = [tuple(r) for r in made.collect()]
            assert (want or least > 0.5) and set(got) == want and len(got) == len(want)
        assert detection.box_iou(pred.limit(0), true, ["image"]).count() == 0
    looked = []
    monkeypatch.setattr(detection, "_ious", lambda p, t, i, j, real=detection._ious: looked.append(len(i)) or real(p, t, i, j))
    n = 3000
    small = np.concatenate([a := rng.uniform(0, 480, (n, 2)), a + rng.uniform(17, 66, (n, 1))], 1)
    assert list(detection._meetings(small, np.zeros(n, int), small, np.zeros(n, int), 0.2)) and sum(looked) < 0.08 * n * n
