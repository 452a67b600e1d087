"""Mask kernels against plain loops over pixels, the one-pass features against the operators joined, slides against one piece."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmorph.functions import masks
from cellmorph.operators import pixels
from cellmorph.tables import min_labels

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


def blob(seed, size, share):
    rng = np.random.default_rng(seed)
    return sorted({(int(y), int(x)) for y, x in zip(*np.nonzero(rng.random((size, size)) < share), strict=True)})


MASKS = [blob(i, 3 + 3 * i, 0.1 + 0.08 * i) for i in range(10)] + [[(y, x) for y in range(9) for x in range(9) if (y - 4) ** 2 + (x - 4) ** 2 <= 16], [(0, 0)], [(5, 5), (5, 7)]]
MASKS = [m for m in MASKS if m]


def flood(mask, conn):
    left, out, n = set(mask), {}, 0
    for start in sorted(left):
        if start in out:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            y, x = todo.pop()
            for dy, dx in AROUND:
                p = y + dy, x + dx
                if (conn == 8 or not dy * dx) and p in left and p not in out:
                    out[p] = n
                    todo.append(p)
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_equal_flood(conn):
    for m in MASKS:
        assert masks.label(m, conn) == flood(m, conn)


def test_labels_of_a_spiral_and_a_comb():
    spiral, y, x, d = {(0, 0)}, 0, 0, 0
    for length in range(2, 60, 2):
        for _ in range(2):
            dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][d % 4]
            for _ in range(length):
                y, x = y + dy, x + dx
                spiral.add((y, x))
            d += 1
    comb = [(y, x) for y in range(40) for x in range(80) if x % 2 == 0 or y == 39]
    assert set(masks.label(spiral, 4).values()) == {1} and set(masks.label(comb, 4).values()) == {1}


def border_loop(mask):
    """Outer border by walking around each component's set of pixels."""
    total = 0.0
    parts = flood(mask, 8)
    for k in set(parts.values()):
        own = {p for p, j in parts.items() if j == k}
        start = min(own)
        at, back, length, first = start, 0, 0.0, None
        while True:
            step = next(((back + i) % 8 for i in range(1, 9) if (at[0] + masks.RING[(back + i) % 8][0], at[1] + masks.RING[(back + i) % 8][1]) in own), None)
            if step is None or (at, step) == first:
                break
            first = first or (at, step)
            length += math.sqrt(2) if step % 2 else 1
            at, back = (at[0] + masks.RING[step][0], at[1] + masks.RING[step][1]), (step + 4) % 8
        total += length
    return total


def thin_loop(mask):
    on = set(mask)
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = len(on)
        for one in (True, False):
            drop = []
            for y, x in on:
                n = [(y + dy, x + dx) in on for dy, dx in ring]
                turns = sum(not n[i] and n[(i + 1) % 8] for i in range(8))
                a, b = ((0, 2, 4), (2, 4, 6)) if one else ((0, 2, 6), (0, 4, 6))
                if 2 <= sum(n) <= 6 and turns == 1 and not all(n[i] for i in a) and not all(n[i] for i in b):
                    drop.append((y, x))
            on -= set(drop)
        if len(on) == before:
            return sorted(on)


def test_borders_thinning_holes_hulls():
    for m in MASKS:
        assert masks.perimeter(m) == pytest.approx(border_loop(m))
        assert sorted(masks.thin(m)) == thin_loop(m)
        parts = flood(m, 4)
        holes = 0
        for k in set(parts.values()):
            own = {p for p, j in parts.items() if j == k}
            y0, x0, y1, x1 = min(p[0] for p in own) - 1, min(p[1] for p in own) - 1, max(p[0] for p in own) + 1, max(p[1] for p in own) + 1
            holes += max(flood([(y, x) for y in range(y0, y1 + 1) for x in range(x0, x1 + 1) if (y, x) not in own], 4).values()) - 1
        assert masks.betti(m) == (max(parts.values()), holes)
        area, length = masks.hull(m)
        pts, edges = np.array(m, float), []
        for p in pts:  # edges from p: all points on one side, and none beyond the end
            step = pts - p
            cross = step[:, 0][:, None] * step[:, 1] - step[:, 1][:, None] * step[:, 0]
            size = np.hypot(*step.T)
            ends = np.flatnonzero((size > 0) & (cross >= 0).all(1))
            for q in ends:
                line = cross[q] == 0
                along = step[line] @ step[q]
                if along.max() <= step[q] @ step[q] and along.min() >= 0:
                    edges.append((p, pts[q]))
        assert length == pytest.approx(sum(np.hypot(*(q - p)) for p, q in edges))
        assert area == pytest.approx(abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in edges)) / 2)
        size = max(max(p) for p in m) + 2
        off = flood([(y, x) for y in range(size) for x in range(size) if (y, x) not in set(m)], 4)
        want = [(y, x) for y in range(size) for x in range(size) if (0, 0) in set(m) or off.get((y, x)) != off[0, 0]]
        assert masks.filled(m, size, size) == want


def table(spark, found, schema="cell long, y long, x long"):
    return spark.createDataFrame([(k, y, x) for k, m in found.items() for y, x in m], schema).repartition(3)


def test_one_pass_equals_joined_operators(spark):
    whole = dict(enumerate(MASKS))
    soma = {k: [p for p in m if (p[0] - 4) ** 2 + (p[1] - 4) ** 2 <= 6] for k, m in whole.items()}
    det = spark.createDataFrame([(k,) for k in [*whole, 99]], "cell long")
    w, s = table(spark, whole), table(spark, soma)
    got = pixels.morphology(det, w, s)
    skeleton = pixels.skeletonize(w)
    process, branch = pixels.process_skeleton(skeleton, s), pixels.branch_mask(w, s)
    area, hull = pixels.mask_area, pixels.convex_hull(w).withColumnsRenamed({"hull_area": "cell_convex_hull_area", "hull_perimeter": "cell_convex_hull_perimeter"})
    want = det
    parts = [
        area(process, "skeleton_length"), pixels.junctions(process), pixels.component_count(process).withColumnRenamed("n_components", "num_components"), area(pixels.end_nodes(process, s), "num_end_nodes"), area(pixels.start_nodes(process, s), "num_start_nodes"),
        area(s, "soma_area"), pixels.perimeter(s, "soma_perimeter"), area(w, "cell_area"), pixels.perimeter(w, "cell_perimeter"), hull, area(branch, "branch_area"), pixels.perimeter(branch, "branch_perimeter"), pixels.sholl(process, s),
    ]
    for p in parts:
        want = want.join(p, "cell", "left")
    want = pixels.shape_ratios(want.fillna(0))
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ({r["cell"]: r.asDict() for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k]), k
    given = pixels.morphology(det, w, s, skeleton)
    linked = pixels.morphology(det, table(spark, {k: m[: len(m) // 2] for k, m in whole.items()}), s, connected=w)
    features = ["skeleton_length", "num_junctions", "num_end_nodes", "sholl_sum"]
    for other in (given, linked):
        assert sorted(map(tuple, other.select("cell", *features).collect())) == sorted(map(tuple, got.select("cell", *features).collect()))
    assert pixels.morphology(det, w.limit(0), s.limit(0)).agg({"cell_area": "sum"}).first()[0] == 0


def test_masks_that_batches_cut(spark):
    w = table(spark, dict(enumerate(MASKS)) | {None: [(0, 0), (0, 1)]}).withColumn("side", F.when(F.col("cell") % 2 == 0, "even"))
    whole = sorted(map(str, pixels.component_count(w).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in (1, 7, 64):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            assert sorted(map(str, pixels.component_count(w).collect())) == whole
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(whole) == len(MASKS) + 1


def test_one_grouped_python_stage(spark):
    w = table(spark, dict(enumerate(MASKS)))
    plan = pixels.morphology(w.select("cell").distinct(), w, w.where("y < 3"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "BroadcastNestedLoop" not in plan


def test_a_tile_sized_mask(spark):
    disc = [(y, x) for y in range(512) for x in range(512) if (y - 255) ** 2 + (x - 255) ** 2 <= 250**2 and not (y % 64 == 0 and x % 64 == 0)]
    w = table(spark, {1: disc})
    r = pixels.morphology(w.select("cell").distinct(), w, w.where("y < 0")).first()
    holes = sum((y - 255) ** 2 + (x - 255) ** 2 <= 250**2 for y in range(0, 512, 64) for x in range(0, 512, 64))
    assert r["cell_area"] == len(disc) and r["num_components"] >= 1 and r["skeleton_length"] > 250
    assert pixels.betti(w).first()[1:] == (1, holes)
    assert r["cell_perimeter"] == pytest.approx(border_loop(disc))


@pytest.mark.parametrize("conn", [4, 8])
def test_slide_components_equal_one_piece(spark, conn):
    rng = np.random.default_rng(conn)
    dots = sorted({(int(y), int(x)) for y, x in rng.integers(-40, 90, (7000, 2))})
    snake = [(y, x) for y in range(0, 80, 2) for x in range(100, 180)] + [(y, 179 if y % 4 == 1 else 100) for y in range(1, 79, 2)]
    found = {1: dots, 2: snake, 3: [(15, 15), (16, 16), (15, 16 + 1)], 4: [(7, 7)]}
    got = pixels.slide_components(table(spark, found), conn, 16).collect()
    assert len(got) == sum(map(len, found.values()))
    for k, m in found.items():
        parts = flood(m, conn)
        first = {}
        for p, j in sorted(parts.items()):
            first.setdefault(j, p)
        assert {(r["y"], r["x"]): (r["cy"], r["cx"]) for r in got if r["cell"] == k} == {p: first[j] for p, j in parts.items()}


def test_min_labels_of_a_path_a_star_and_none(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, 101 + i) for i in range(50)] + [(100, 99), (99, 98)]
    got = {r["id"]: r["label"] for r in min_labels(spark.createDataFrame(path + star + [(200, 200)], "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 98 for i in range(98, 151)}
    assert min_labels(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cleaning(spark):
    two = [(0, 0), (0, 1), (5, 5)]
    px = table(spark, {1: two, 2: [(3, 3)]})
    assert sorted(map(tuple, pixels.clean_masks(px).collect())) == [(1, 0, 0), (1, 0, 1), (2, 3, 3)]
    assert pixels.clean_masks(px, dry_run=True).count() == 4
    assert sorted(map(tuple, pixels.largest_component(table(spark, {1: [(0, 0), (9, 9)]})).collect())) == [(1, 0, 0)]
