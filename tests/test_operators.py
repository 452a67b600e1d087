"""Operators on small tables with nulls, ties and empties; methods against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmorph.operators import aggregates, detection, filters, joins, ml, pixels, ranking, sampling, stats


def test_two_groups_needs_both(spark):
    df = spark.createDataFrame([("AD",), ("AD",)], "g string")
    with pytest.raises(ValueError):
        filters.two_groups(df, "g", "AD", "100+")


def test_expert_labels_need_their_columns(spark):
    df = spark.createDataFrame([(1,)], "cell_id int")
    with pytest.raises(ValueError):
        joins.join_expert_labels(df, df, ["scan_name"], ["cell_id"])


def test_overlap_is_an_error(spark):
    a = spark.createDataFrame([("x",), ("y",)], "f string")
    with pytest.raises(ValueError):
        ranking.with_additional(a, a.limit(1), "f")
    with pytest.raises(ValueError):
        ranking.with_additional(a, spark.createDataFrame([("z",), ("z",)], "f string"), "f")


def test_scan_level_takes_first_value_that_is_there(spark):
    df = spark.createDataFrame([("s", 1, None, 2.0), ("s", 2, "b", None), ("s", 3, "a", 4.0), (None, 4, "z", 9.0)], "scan_name string, cell_id int, sex string, f double")
    assert aggregates.scan_level(df, ["f"], ["sex"]).collect() == [("s", 3.0, "b")]


def test_splits_cover_and_do_not_overlap(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    sizes = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    assert sizes(sampling.split3(df, ["k"])) == {"train": 72, "val": 10, "test": 21}
    folds = sampling.kfold(df, ["k"], 5)
    assert folds.count() == 515
    assert {r["count"] for r in folds.where("split = 'test'").groupBy("k").count().collect()} == {1}
    with pytest.raises(ValueError):
        sampling.split3(df, ["k"], (0.5, 0.1, 0.2))
    assert sampling.sample_k(df, 500, ["k"]).count() == 103
    again = sampling.split3(df.repartition(7), ["k"]).collect()
    assert sorted(again) == sorted(sampling.split3(df, ["k"]).collect())


def test_contrast_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", "AD" if i % 2 else "100+", "FM"[i % 3 == 0], float(60 + i), float(rng.normal() + (i % 2))) for i in range(30)]
    df = spark.createDataFrame(rows, "scan_name string, g string, sex string, age double, f double").withColumn("flat", F.lit(None).cast("double"))
    got = {r["feature"]: r for r in stats.group_contrast(df, ["f"], ["age", "sex"], "AD", "100+", "g").collect()}["f"]
    x = np.array([[1, r[1] == "AD", r[3], r[2] == "M"] for r in rows], float)
    y = np.array([r[4] for r in rows])
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(rss[0] / (30 - 4) * np.linalg.inv(x.T @ x)[1, 1])
    assert got["coef"] == pytest.approx(beta[1]) and got["se"] == pytest.approx(se) and got["n"] == 30
    assert 0 < got["p_value"] < 1 and got["q_value"] == pytest.approx(got["p_value"])


def test_permanova_equals_distances(spark):
    rng = np.random.default_rng(2)
    pts, g = rng.normal(size=(20, 2)), ["a", "b"] * 10
    df = spark.createDataFrame([(f"s{i:02d}", g[i], *map(float, p)) for i, p in enumerate(pts)], "scan_name string, g string, u double, v double")
    got = stats.permanova(df, ["u", "v"], 19, "g").first()
    z = (pts - pts.mean(0)) / pts.std(0, ddof=1)
    d2 = ((z[:, None] - z[None]) ** 2).sum(-1)
    sst = d2.sum() / 2 / 20
    ssw = sum(d2[np.ix_(i, i)].sum() / 2 / 10 for i in ([k for k in range(20) if g[k] == x] for x in "ab"))
    assert got["pseudo_f"] == pytest.approx((sst - ssw) / (ssw / 18)) and got["r2"] == pytest.approx(1 - ssw / sst)
    assert 0 < got["p_value"] <= 1


def test_representatives(spark):
    df = spark.createDataFrame([(f"s{i}", float(i), float(i * 2 + 1), float((i * 7) % 5)) for i in range(10)], "scan_name string, a double, b double, c double")
    kept, dropped = stats.representatives(df, ["a", "b", "c"])
    assert kept == ["a", "c"] and dropped == ["b"]


def test_matching_is_one_to_one(spark):
    box = "image string, {}id int, conf double, xmin int, ymin int, xmax int, ymax int"
    pred = spark.createDataFrame([("i", 1, 0.9, 0, 0, 10, 10), ("i", 2, 0.8, 1, 0, 11, 10), ("i", 3, 0.7, 50, 50, 60, 60)], box.format("pred_"))
    true = spark.createDataFrame([("i", 1, 1.0, 0, 0, 10, 10)], box.format("true_"))
    m = detection.match_boxes(pred, true, ["image"], [0.5])
    assert {r["pred_id"]: r["tp"] for r in m.collect()} == {1: 1, 2: 0, 3: 0}
    assert detection.average_precision(m, true).first()["ap"] == pytest.approx(1.0)
    at = detection.precision_recall_at(m, true, 0.75).first()
    assert (at["precision"], at["recall"]) == (0.5, 1.0)


def _greedy(pred, true, t):
    """{pred_id} that match at overlap t: boxes (image, cls, id, conf, xmin, ymin, xmax, ymax) by falling confidence."""
    hits, used = set(), set()
    pairs = []
    for p in pred:
        for g in true:
            if p[:2] == g[:2]:
                w, h = min(p[6], g[6]) - max(p[4], g[4]), min(p[7], g[7]) - max(p[5], g[5])
                inter = max(w, 0) * max(h, 0)
                iou = inter / ((p[6] - p[4]) * (p[7] - p[5]) + (g[6] - g[4]) * (g[7] - g[5]) - inter)
                if iou >= t:
                    pairs.append((-p[3], p[2], -iou, g[2]))
    for _, p, _, g in sorted(pairs):
        if p not in hits and g not in used:
            hits.add(p)
            used.add(g)
    return hits


def test_average_precision_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(detection, "RANGES", 7)
    rng = np.random.default_rng(5)

    def box(i, p):
        x, y, w, h = (int(v) for v in (*rng.integers(0, 12, 2), *rng.integers(4, 9, 2)))
        return (f"i{i % 4}", int(rng.integers(2)), i, round(float(rng.random()), 2) if p else 1.0, x, y, x + w, y + h)

    true, pred = [box(i, False) for i in range(40)], [box(i, True) for i in range(90)]
    schema = "image string, cls int, {}_id int, conf double, xmin int, ymin int, xmax int, ymax int"
    p, g = spark.createDataFrame(pred, schema.format("pred")), spark.createDataFrame(true, schema.format("true")).drop("conf")
    m = detection.match_boxes(p, g, ["image", "cls"], detection.OVERLAPS)
    got = {(r["cls"], r["threshold"]): r["ap"] for r in detection.average_precision(m, g, ["cls"]).collect()}
    want = {}
    for c in (0, 1):
        n = sum(x[1] == c for x in true)
        for t in detection.OVERLAPS:
            own = [x for x in pred if x[1] == c]
            hits = _greedy(own, true, t)
            confs = sorted({x[3] for x in own}, reverse=True)
            curve = [(sum(x[2] in hits for x in own if x[3] >= k), sum(x[3] >= k for x in own)) for k in confs]
            best = [max(tp / all_ for tp, all_ in curve[i:]) for i in range(len(curve))]
            want[c, t] = sum(b * (curve[i][0] - (curve[i - 1][0] if i else 0)) / n for i, b in enumerate(best))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    means = {r["cls"]: (r["ap50"], r["ap50_95"]) for r in detection.mean_average_precision(m, g, ["cls"]).collect()}
    for c in (0, 1):
        assert means[c] == (pytest.approx(want[c, 0.5]), pytest.approx(np.mean([want[c, t] for t in detection.OVERLAPS])))
    assert means[None][1] == pytest.approx((means[0][1] + means[1][1]) / 2)
    none = detection.precision_recall_at(m, g, 2.0, ["cls"]).collect()
    assert len(none) == 20 and {(r["precision"], r["recall"]) for r in none} == {(None, 0.0)}


def test_farthest_points(spark):
    df = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 1, 2, 10))], "k long, v array<double>")
    picks = ml.diverse_select(df, "k", "v", 3).orderBy("rank").collect()
    assert [p["k"] for p in picks] == [3, 0, 2]
    assert ml.active_select(df.where("k < 3"), df.where("k = 3"), "k", "v", 2).orderBy("rank").first()["k"] == 0


def test_known_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    v, w = rng.normal(size=(80, 3)), rng.normal(size=(50, 3))
    pool, known = (spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(m)], "k long, v array<double>") for m in (v, w))
    d, want = np.sqrt(((v[:, None] - w) ** 2).sum(2)).min(1), []
    for _ in range(4):
        want.append(int(d.argmax()))
        d = np.minimum(d, np.sqrt(((v - v[want[-1]]) ** 2).sum(1)))
    for block, every in ((4096, 16), (7, 2)):
        monkeypatch.setattr(ml, "KNOWN_BLOCK", block)
        monkeypatch.setattr(ml, "STORE_EVERY", every)
        assert [r["k"] for r in ml.active_select(pool, known, "k", "v", 4).orderBy("rank").collect()] == want


def test_continuity_counts_keys_with_both(spark):
    rows = [(i, [float(i), float(i * i % 7)]) for i in range(30)]
    high = spark.createDataFrame(rows, "k long, v array<double>")
    low = spark.createDataFrame([(i, None if i % 3 == 0 else v) for i, v in rows], "k long, v array<double>")
    r = ml.continuity(high, low, "k", "v", 3, 100).first()
    assert r["n"] == 20 and r["value"] == pytest.approx(1.0)


def test_morphology_of_empty_and_plus(spark):
    plus = [("p", 2, x) for x in range(5)] + [("p", y, 2) for y in range(5) if y != 2]
    schema = "cell string, y long, x long"
    det = spark.createDataFrame([("p",), ("none",)], "cell string")
    whole = spark.createDataFrame(plus, schema)
    soma = spark.createDataFrame([("p", 2, 2)], schema)
    rows = {r["cell"]: r for r in pixels.morphology(det, whole, soma, whole).collect()}
    assert rows["none"]["cell_area"] == 0 and rows["none"]["cell_solidity"] == 0
    p = rows["p"]
    assert (p["cell_area"], p["soma_area"], p["branch_area"], p["skeleton_length"]) == (9, 1, 8, 8)
    assert (p["num_components"], p["num_end_nodes"], p["sholl_max_radius"], p["sholl_peak"]) == (1, 4, 2, 4)


def test_grow_and_fill(spark):
    prob = spark.createDataFrame([("a", 0, x, 0.9 if x == 0 else 0.3 if x < 4 else 0.1) for x in range(6)], "k string, y long, x long, p double")
    assert pixels.grow(prob).count() == 4 and pixels.grow(prob, rounds=1).count() == 2
    assert pixels.grow(prob.limit(0)).count() == 0


def test_otsu_keeps_the_dark(spark):
    gray = spark.createDataFrame([("a", y, x, 10 if 1 <= y <= 4 and 1 <= x <= 4 else 200) for y in range(8) for x in range(8)], "k string, y long, x long, gray int")
    assert pixels.otsu_mask(gray, gray.select("k", "y", "x")).count() == 16


def test_splits_move_few_rows(spark):
    """Only rows of hash prefixes in which a split ends are ranked; copies of a row are counted one by one."""
    from cellmorph.operators import sampling as smp

    df = spark.range(3000).select(F.col("id").alias("k")).union(spark.range(1).select(F.lit(7).cast("long").alias("k")).crossJoin(spark.range(1000)).select("k"))
    for ends in ([0], [1], [1999, 2000], [4000], [700, 700, 3500]):
        found = {r["reached"]: r["n"] for r in smp.reached(df, ["k"], 0, [F.lit(e) for e in ends]).groupBy("reached").agg(F.count("*").alias("n")).collect()}
        assert [found.get(i, 0) for i in range(len(ends) + 1)] == [b - a for a, b in zip([0, *ends], [*ends, 4000], strict=True)]
    plan = smp.reached(df, ["k"], 0, [F.lit(5)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number") == 1


def test_learning_curve_ranks_a_row_once_a_seed(spark):
    from cellmorph.operators import sampling as smp

    plan = smp.learning_curve_plan(spark.range(100).select(F.col("id").alias("k")), ["k"])
    made = {(r["portion"], r["split_seed"]): r["n"] for r in plan.groupBy("portion", "split_seed").agg(F.count_distinct("k").alias("n")).collect()}
    assert made == {(p / 10, s): 10 * p for p in range(1, 11) for s in range(1 if p == 10 else 5)}
