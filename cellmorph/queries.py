"""Registered queries of the operators over the driver's tables, with DuckDB SQL for the same rows."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, dealt, with_views
from .functions import geometry as geo
from .functions import text as tx
from .operators import aggregates as agg
from .operators import detection as det
from .operators import filters as flt
from .operators import joins as jn
from .operators import ml
from .operators import order as od
from .operators import pixels as px
from .operators import ranking as rk
from .operators import sampling as smp
from .operators import spatial as sp
from .operators import stats as st
from .plans import cohort, hooks
from .sources import coco
from .sources import files as src
from .streaming import ingest
from .tables import discard, new_path, shared_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CELL = ["scan_name", "image_name", "cell_id"]
BOX = ["xmin", "ymin", "xmax", "ymax"]
FEATURES = ["skeleton_length", "cell_area", "cell_solidity", "cell_circularity"]


def query(name: str, fn: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = with_views(" ".join(sql.split()))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def _shared(t: Tables) -> str:
    """The folder that executors share."""
    return shared_dir(t.spark)


def labelled(t: Tables) -> DataFrame:
    """Cells with their scan's covariates."""
    return t.fx_cells.join(t.fx_scans, "scan_name")


def scan_table(t: Tables) -> DataFrame:
    return agg.scan_level(t.fx_cells, FEATURES).join(t.fx_scans, "scan_name")


SCAN_SQL = "scan_t AS (SELECT scan_name, avg(skeleton_length) skeleton_length, avg(cell_area) cell_area, avg(cell_solidity) cell_solidity, avg(cell_circularity) cell_circularity FROM fx_cells GROUP BY scan_name), s AS (SELECT * FROM scan_t JOIN fx_scans USING (scan_name))"
CELL_SQL = "scan_name, image_name, cell_id"

# --- filters
query("p1_drop_border", lambda t: flt.drop_border(t.fx_cells).select(*CELL, *BOX), f"SELECT {CELL_SQL}, xmin, ymin, xmax, ymax FROM fx_cells WHERE xmin > 1 AND ymin > 1 AND xmax < 511 AND ymax < 511")
query("p2_drop_outliers", lambda t: flt.drop_outliers(t.fx_cells, "cell_area").select("cell_id", "cell_area"), "SELECT cell_id, cell_area FROM fx_cells, (SELECT quantile_cont(cell_area, 0.002) a, quantile_cont(cell_area, 0.998) b FROM fx_cells) WHERE cell_area BETWEEN a AND b")
query("p3_complete_cases", lambda t: flt.complete_cases(t.fx_cells, FEATURES).select("cell_id", *FEATURES), "SELECT cell_id, skeleton_length, cell_area, cell_solidity, cell_circularity FROM fx_cells WHERE skeleton_length IS NOT NULL AND cell_area IS NOT NULL AND cell_solidity IS NOT NULL AND cell_circularity IS NOT NULL")
query("p4_above", lambda t: flt.above(t.fx_cells).select("cell_id", "conf"), "SELECT cell_id, conf FROM fx_cells WHERE conf > 0.5")
query("p5_band_review", lambda t: flt.band_review(t.fx_cells, 0.45, 0.55).select(*CELL, "conf"), f"SELECT {CELL_SQL}, conf FROM (SELECT *, max(CASE WHEN conf > 0.45 AND conf < 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_name, image_name) k FROM fx_cells) WHERE k = 1 AND conf > 0.45")
query("p6_diagnosis_group", lambda t: t.customer.select("c_custkey", flt.diagnosis_group("c_mktsegment", "hou", ["BUILDING"]).alias("diagnosis_group")), "SELECT c_custkey, CASE WHEN lower(c_mktsegment) LIKE '%hou%' OR c_mktsegment = 'BUILDING' THEN 'AD' ELSE '100+' END AS diagnosis_group FROM customer")
query("p7_two_groups", lambda t: flt.two_groups(t.fx_scans, "diagnosis_group", "AD", "100+").select("scan_name", "diagnosis_group"), "SELECT scan_name, diagnosis_group FROM fx_scans WHERE diagnosis_group IN ('AD', '100+')")
query("p8_annotated", lambda t: flt.annotated(t.fx_expert, "cluster_annotation", ["microglia_to_annotate_cluster"]), "SELECT * FROM fx_expert WHERE cluster_annotation IS NOT NULL AND cluster_annotation <> 'microglia_to_annotate_cluster'")
query("p9_exclude", lambda t: flt.exclude(t.fx_metrics, "variant", ["none"]), "SELECT * FROM fx_metrics WHERE variant <> 'none' OR variant IS NULL")
query("p10_valid_box", lambda t: flt.valid_box(t.fx_cells, 30).select("cell_id", *BOX), "SELECT cell_id, xmin, ymin, xmax, ymax FROM fx_cells WHERE xmax - xmin > 30 AND ymax - ymin > 30")
query("p11_with_cell_id", lambda t: flt.with_cell_id(t.fx_cells).select("cell_id", "global_cell_id"), "SELECT cell_id, concat(image_name, '_cell_', cast(cell_id AS varchar)) AS global_cell_id FROM fx_cells")
query(
    "p12_mask_quality",
    lambda t: longs(flt.mask_quality(t.fx_regions, t.nation.select((F.col("n_nationkey") % 7).cast("bigint").alias("pos"), "n_name", F.col("n_nationkey").alias("priority")).withColumnRenamed("n_name", "grade"), ["region_id"]).select("region_id", "pos", "mask_quality"), "pos"),
    "WITH g AS (SELECT n_nationkey % 7 AS pos, arg_max(n_name, n_nationkey) AS grade FROM nation GROUP BY 1), i AS (SELECT region_id, row_number() OVER (ORDER BY region_id) - 1 AS pos FROM fx_regions) SELECT region_id, i.pos AS pos, coalesce(grade, 'good') AS mask_quality FROM i LEFT JOIN g ON i.pos = g.pos",
)
query("p13_typed_columns", lambda t: flt.typed_columns(t.fx_scans, ["sex", "age_at_death", "thal_stage", "braak_stage"]), "SELECT 'sex' AS \"column\", CASE WHEN count(try_cast(sex AS double)) >= 2 THEN 'numeric' ELSE 'categorical' END AS kind FROM fx_scans UNION ALL SELECT 'age_at_death', CASE WHEN count(age_at_death) >= 2 THEN 'numeric' ELSE 'categorical' END FROM fx_scans UNION ALL SELECT 'thal_stage', CASE WHEN count(try_cast(thal_stage AS double)) >= 2 THEN 'numeric' ELSE 'categorical' END FROM fx_scans UNION ALL SELECT 'braak_stage', CASE WHEN count(braak_stage) >= 2 THEN 'numeric' ELSE 'categorical' END FROM fx_scans")
query("p14_unusable", lambda t: flt.unusable(t.fx_cells.select("cell_area", F.lit(3).alias("three"), F.lit(None).cast("double").alias("none")), ["cell_area", "three", "none"]), "SELECT 'three' AS feature, 'constant' AS reason FROM (SELECT count(*) n FROM fx_cells) UNION ALL SELECT 'none', 'all missing'")
query(
    "p16_normalise_composition",
    lambda t: r6(flt.normalise_composition(agg.cluster_props(t.fx_cells, "cluster", range(4)), [f"hard_cluster_{k}" for k in range(4)], 0.01).drop("n_cells"), *(f"hard_cluster_{k}" for k in range(4))),
    "WITH p AS (SELECT scan_name, " + ", ".join(f"least(greatest(count(*) FILTER (cluster = {k}) / cast(count(*) AS double), 0.01), 1) c{k}" for k in range(4)) + " FROM fx_cells WHERE cluster IS NOT NULL GROUP BY scan_name) SELECT scan_name, " + ", ".join(f"round(c{k} / (c0 + c1 + c2 + c3), 6) AS hard_cluster_{k}" for k in range(4)) + " FROM p",
)
query(
    "p17_tetrahedron_xyz",
    lambda t: r6(geo.tetrahedron_xyz(agg.cluster_props(t.fx_cells, "cluster", range(4), "c"), [f"c{k}" for k in range(4)]).select("scan_name", "tx", "ty", "tz"), "tx", "ty", "tz"),
    "WITH p AS (SELECT scan_name, " + ", ".join(f"count(*) FILTER (cluster = {k}) / cast(count(*) AS double) c{k}" for k in range(4)) + " FROM fx_cells GROUP BY scan_name) SELECT scan_name, round(c1 + (c2 + c3) / 2, 6) AS tx, round(c2 * sqrt(3) / 2 + c3 * sqrt(3) / 6, 6) AS ty, round(c3 * sqrt(2.0 / 3), 6) AS tz FROM p",
)

# --- boxes
YOLO_SQL = "y AS (SELECT cell_id, (xmin + xmax) / 2.0 / 512 AS cx, (ymin + ymax) / 2.0 / 512 AS cy, cast(xmax - xmin AS double) / 512 AS w, cast(ymax - ymin AS double) / 512 AS h FROM fx_cells)"
query("g1_yolo_to_xyxy", lambda t: geo.yolo_to_xyxy(geo.xyxy_to_yolo(t.fx_cells, 512, 512), 640, 480).select("cell_id", *BOX), f"WITH {YOLO_SQL} SELECT cell_id, cast(least(greatest(trunc((cx - w / 2) * 640), 0), 639) AS integer) AS xmin, cast(least(greatest(trunc((cy - h / 2) * 480), 0), 479) AS integer) AS ymin, cast(least(greatest(trunc((cx + w / 2) * 640), 0), 639) AS integer) AS xmax, cast(least(greatest(trunc((cy + h / 2) * 480), 0), 479) AS integer) AS ymax FROM y")
query("g2_xyxy_to_yolo", lambda t: r6(geo.xyxy_to_yolo(t.fx_cells, 512, 512).select("cell_id", "cx", "cy", "w", "h"), "cx", "cy", "w", "h"), f"WITH {YOLO_SQL} SELECT cell_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM y")
query(
    "g3_coco_to_yolo",
    lambda t: r6(geo.coco_to_yolo(t.fx_cells.select("cell_id", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("bw"), (F.col("ymax") - F.col("ymin")).alias("bh"), F.lit(512).alias("width"), F.lit(512).alias("height"))).select("cell_id", "cls", "cx", "cy", "w", "h"), "cx", "cy", "w", "h"),
    f"WITH {YOLO_SQL} SELECT cell_id, 0 AS cls, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM y",
)
_SIDE = lambda a, s, f, n: f"cast(trunc(least(greatest(({a}min + {a}max) / 2.0 {s} cast({a}max - {a}min AS double) * {f} / 2, 0), {n})) AS integer)"
query("g4_scale_boxes", lambda t: geo.scale_boxes(t.fx_cells, 2.0, 512, 512).select("cell_id", "sx1", "sy1", "sx2", "sy2"), f"SELECT cell_id, {_SIDE('x', '-', 2.0, 511)} AS sx1, {_SIDE('y', '-', 2.0, 511)} AS sy1, {_SIDE('x', '+', 2.0, 511)} AS sx2, {_SIDE('y', '+', 2.0, 511)} AS sy2 FROM fx_cells")
_PAD = lambda a, end, s: f"cast(trunc(least(greatest(cast({a}{end} AS double) {s} cast({a}max - {a}min AS double) * 0.2, 0), 512)) AS integer)"
query("g5_pad_boxes", lambda t: geo.pad_boxes(t.fx_cells, 0.2, 512, 512).select("cell_id", "px1", "py1", "px2", "py2"), f"SELECT cell_id, {_PAD('x', 'min', '-')} AS px1, {_PAD('y', 'min', '-')} AS py1, {_PAD('x', 'max', '+')} AS px2, {_PAD('y', 'max', '+')} AS py2 FROM fx_cells")
def grid(t: Tables) -> DataFrame:
    """Tiles of each scan, whose size is that of its outermost tiles."""
    place = tx.parse_tile(F.concat("image_name", F.lit("_gray_matter.jpg")))
    sizes = t.fx_cells.select("scan_name", place.alias("p")).groupBy("scan_name").agg((F.max("p.x") + 512).alias("width"), (F.max("p.y") + 512).alias("height"))
    return longs(sp.tile_grid(sizes).select("scan_name", "x", "y"), "x", "y")


GRID_SQL = "sizes AS (SELECT scan_name, max(cast(regexp_extract(image_name, 'x([0-9]+)', 1) AS bigint)) AS w, max(cast(regexp_extract(image_name, 'y([0-9]+)', 1) AS bigint)) AS h FROM fx_cells GROUP BY 1), tiles AS (SELECT scan_name, x, y FROM (SELECT scan_name, h, unnest(range(0, w + 1, 512)) AS x FROM sizes) CROSS JOIN LATERAL (SELECT unnest(range(0, h + 1, 512)) AS y) q)"
query("g6_tile_grid", grid, f"WITH {GRID_SQL} SELECT scan_name, x, y FROM tiles")
query("g7_label_tiles", lambda t: sp.label_tiles(grid(t), t.fx_regions).select("scan_name", "x", "y", "tissue"), f"WITH {GRID_SQL} SELECT scan_name, x, y, CASE WHEN EXISTS (SELECT 1 FROM fx_regions WHERE x + 256 BETWEEN x0 AND x1 AND y + 256 BETWEEN y0 AND y1) THEN 'gray' ELSE 'white' END AS tissue FROM tiles")
_IN = lambda dx, dy: f"EXISTS (SELECT 1 FROM fx_regions WHERE x + {dx} BETWEEN x0 AND x1 AND y + {dy} BETWEEN y0 AND y1)"
query("g8_tiles_inside", lambda t: sp.tiles_inside(grid(t), t.fx_regions).select("scan_name", "x", "y"), f"WITH {GRID_SQL} SELECT scan_name, x, y FROM tiles WHERE {_IN(0, 0)} AND {_IN(512, 0)} AND {_IN(0, 512)} AND {_IN(512, 512)}")
query("g9_patches_for", lambda t: sp.patches_for(t.fx_cells, 1, 2048, 2048))
PATCH = lambda t: t.nation.select(F.col("n_nationkey").alias("patch"), (F.col("n_nationkey") * 17).alias("px"), (F.col("n_nationkey") * 11).alias("py"))
query(
    "g10_clip_to_patch",
    lambda t: r6(sp.clip_to_patch(PATCH(t), t.fx_cells.select("cell_id", *BOX), 128).select("patch", "cell_id", "cx", "cy", "w", "h"), "cx", "cy", "w", "h"),
    "WITH j AS (SELECT n_nationkey AS patch, cell_id, greatest(xmin, n_nationkey * 17) - n_nationkey * 17 a, greatest(ymin, n_nationkey * 11) - n_nationkey * 11 b, least(xmax, n_nationkey * 17 + 128) - n_nationkey * 17 c, least(ymax, n_nationkey * 11 + 128) - n_nationkey * 11 d FROM nation, fx_cells WHERE xmax > n_nationkey * 17 AND xmin < n_nationkey * 17 + 128 AND ymax > n_nationkey * 11 AND ymin < n_nationkey * 11 + 128) SELECT patch, cell_id, round((a + c) / 2.0 / 128, 6) AS cx, round((b + d) / 2.0 / 128, 6) AS cy, round((c - a) / 128.0, 6) AS w, round((d - b) / 128.0, 6) AS h FROM j WHERE c - a > 1 AND d - b > 1",
)
query(
    "g11_bodies_in_wholes",
    lambda t: sp.bodies_in_wholes(t.fx_cells.select(F.col("cell_id").alias("body_id"), *BOX), t.fx_regions.select(F.col("region_id").alias("whole_id"), (F.col("x0") / 10).alias("xmin"), (F.col("y0") / 10).alias("ymin"), (F.col("x0") / 10 + 40).alias("xmax"), (F.col("y0") / 10 + 40).alias("ymax"))).select("body_id", "whole_id"),
    "SELECT c.cell_id AS body_id, r.region_id AS whole_id FROM fx_cells c JOIN fx_regions r ON (xmin + xmax) / 2.0 BETWEEN x0 / 10.0 AND x0 / 10.0 + 40 AND (ymin + ymax) / 2.0 BETWEEN y0 / 10.0 AND y0 / 10.0 + 40",
)
query(
    "g12_crop_plan",
    lambda t: geo.crop_plan(t.fx_cells, 20, 512, 512, 64).select("cell_id", *(F.col(c).cast("integer").alias(c) for c in ("crop_x", "crop_y", "crop_w", "crop_h", "out_w", "out_h")), "ds"),
    "WITH a AS (SELECT cell_id, xmin - 20 x, ymin - 20 y, xmax - xmin + 40 w, ymax - ymin + 40 h FROM fx_cells), b AS (SELECT cell_id, greatest(x, 0) x, greatest(y, 0) y, w + least(x, 0) w, h + least(y, 0) h FROM a), c AS (SELECT cell_id, x, y, least(w, 512 - x) w, least(h, 512 - y) h FROM b WHERE x < 512 AND y < 512), d AS (SELECT *, CASE WHEN greatest(w, h) > 64 THEN ceil(greatest(w, h) / 64.0) ELSE 1.0 END ds FROM c WHERE w > 1 AND h > 1) SELECT cell_id, cast(x AS integer) AS crop_x, cast(y AS integer) AS crop_y, cast(w AS integer) AS crop_w, cast(h AS integer) AS crop_h, cast(floor(w / cast(ds AS double) + 0.5) AS integer) AS out_w, cast(floor(h / cast(ds AS double) + 0.5) AS integer) AS out_h, cast(ds AS double) AS ds FROM d",
)
ids = lambda t: t.part.select(F.col("p_partkey").alias("cell_id"))
query("g13_mask_bbox", lambda t: longs(sp.mask_bbox(t.fx_pixels, ids(t), ["cell_id"]), "bx", "by", "bw", "bh"), "SELECT p_partkey AS cell_id, coalesce(min(x), 0) AS bx, coalesce(min(y), 0) AS \"by\", coalesce(max(x) - min(x) + 1, 0) AS bw, coalesce(max(y) - min(y) + 1, 0) AS bh FROM part LEFT JOIN fx_pixels ON p_partkey = cell_id GROUP BY 1")

# --- joins
EXPERT_SQL = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_name, cell_id ORDER BY label_order) r FROM fx_expert) WHERE r = 1)"
query("j1_join_expert_labels", lambda t: jn.join_expert_labels(t.fx_cells, t.fx_expert, ["scan_name", "cell_id"], ["label_order"]).select("scan_name", "cell_id", "cluster_annotation"), f"WITH {EXPERT_SQL} SELECT c.scan_name AS scan_name, c.cell_id AS cell_id, e.cluster_annotation AS cluster_annotation FROM fx_cells c LEFT JOIN e ON c.scan_name = e.scan_name AND c.cell_id = e.cell_id")
query(
    "j2_join_covariates",
    lambda t: jn.join_covariates(t.fx_cells.select("scan_name", "cell_id"), t.fx_scans.select(F.substring("scan_name", 6, 2).alias("NBB"), "sex", "age_at_death"), [f"{i:02d}" for i in range(0, 48, 2)], ["age_at_death"]).select("cell_id", "NBB", "sex", "age_at_death"),
    "SELECT cell_id, CASE WHEN scan_no % 2 = 0 THEN lpad(cast(scan_no AS varchar), 2, '0') END AS \"NBB\", CASE WHEN scan_no % 2 = 0 THEN sex END AS sex, CASE WHEN scan_no % 2 = 0 THEN age_at_death END AS age_at_death FROM fx_cells JOIN fx_scans USING (scan_name)",
)
query("j3_attach_scan_scores", lambda t: jn.attach_scan_scores(t.fx_cells.select("scan_name", "cell_id", F.lit("old").alias("sex")), t.fx_scans, ["sex", "cerad_score"]).select("cell_id", "sex", "cerad_score"), "SELECT cell_id, sex, cerad_score FROM fx_cells LEFT JOIN fx_scans USING (scan_name)")
query(
    "j4_join_summary_props",
    lambda t: r6(longs(jn.join_summary_props(agg.scan_level(t.fx_cells, ["cell_area"]).withColumn("n_cells", F.lit(None).cast("bigint")), agg.cluster_props(t.fx_cells, "cluster", range(4), "c")), "n_cells"), "cell_area", "c0", "c1", "c2", "c3"),
    "SELECT scan_name, round(avg(cell_area), 6) AS cell_area, count(*) AS n_cells, " + ", ".join(f"round(count(*) FILTER (cluster = {k}) / cast(count(*) AS double), 6) AS c{k}" for k in range(4)) + " FROM fx_cells GROUP BY scan_name",
)
inventory = lambda t: t.fx_cells.select(F.concat_ws("/", "scan_name", "image_name", F.col("cell_id").cast("string")).alias("image_path"), "cell_id", "cluster")
query("j5_join_soma", lambda t: jn.join_soma(inventory(t), inventory(t).where("cluster = 1").withColumn("soma_mask_path", F.concat("image_path", F.lit(".png")))).select("cell_id", "soma_mask_path"), "SELECT cell_id, CASE WHEN cluster = 1 THEN concat(scan_name, '/', image_name, '/', cast(cell_id AS varchar), '.png') END AS soma_mask_path FROM fx_cells")
query("j6_join_quality", lambda t: jn.join_quality(inventory(t), inventory(t).where("cluster < 2").withColumn("mask_quality", F.when(F.col("cluster") == 0, "good").otherwise("bad"))).select("cell_id", "mask_quality"), "SELECT cell_id, CASE WHEN cluster = 0 THEN 'good' ELSE 'bad' END AS mask_quality FROM fx_cells WHERE cluster < 2")
query(
    "j7_pair_masks",
    lambda t: jn.pair_masks(t.orders.select(F.col("o_custkey").alias("scan"), F.when(F.col("o_orderkey") % 3 < 2, "MG_whole").otherwise("MG_cell_body").alias("class"), F.floor(F.col("o_orderkey") / 3).alias("file"), F.col("o_orderkey").alias("mask_path")).where("mask_path % 3 <> 1").withColumn("scan", F.col("file") % 48)).select("mask_path", "soma_mask_path"),
    "SELECT w.o_orderkey AS mask_path, s.o_orderkey AS soma_mask_path FROM orders w LEFT JOIN orders s ON s.o_orderkey = w.o_orderkey + 2 WHERE w.o_orderkey % 3 = 0",
)
chosen = lambda t: t.fx_cells.where("cell_area > 90000")
query("j8_cells_of_selected_images", lambda t: jn.cells_of_selected_images(t.fx_cells, chosen(t)).select(*CELL), f"SELECT {CELL_SQL} FROM fx_cells WHERE (scan_name, image_name) IN (SELECT (scan_name, image_name) FROM fx_cells WHERE cell_area > 90000)")
query("j9_selected_cells", lambda t: jn.selected_cells(flt.with_cell_id(t.fx_cells), flt.with_cell_id(chosen(t))).select("cell_id"), "SELECT cell_id FROM fx_cells WHERE (scan_name, concat(image_name, '_cell_', cast(cell_id AS varchar))) IN (SELECT (scan_name, concat(image_name, '_cell_', cast(cell_id AS varchar))) FROM fx_cells WHERE cell_area > 90000)")
query("j10_flag_selected", lambda t: jn.flag_selected(t.fx_cells, chosen(t)).select("cell_id", "selected"), "SELECT cell_id, CASE WHEN cell_area > 90000 THEN 1 ELSE 0 END AS selected FROM fx_cells WHERE (scan_name, image_name) IN (SELECT (scan_name, image_name) FROM fx_cells WHERE cell_area > 90000)")
query("j11_rest_of", lambda t: jn.rest_of(t.fx_cells, chosen(t), CELL).select(*CELL), f"SELECT {CELL_SQL} FROM fx_cells WHERE (scan_name, image_name, cell_id) NOT IN (SELECT (scan_name, image_name, cell_id) FROM fx_cells WHERE cell_area > 90000)")
query("j12_attach_image_label", lambda t: jn.attach_image_label(t.fx_cells.select("cell_id", F.col("image_name").alias("stem")), t.fx_cells.groupBy(F.col("image_name").alias("stem")).agg(F.count("*").alias("n"), F.max("cluster").cast("string").alias("label")).where("n > 20").drop("n")).select("cell_id", "label"), "SELECT cell_id, l.label AS label FROM fx_cells c JOIN (SELECT image_name, cast(max(cluster) AS varchar) label FROM fx_cells GROUP BY 1 HAVING count(*) > 20) l ON c.image_name = l.image_name")
query("j13_overlap", lambda t: jn.overlap(t.fx_cells.where("cluster = 1"), t.fx_cells.where("cluster = 2"), "image_name"), "SELECT DISTINCT image_name FROM fx_cells WHERE cluster = 1 AND image_name IN (SELECT image_name FROM fx_cells WHERE cluster = 2)")
query("j14_neighbours", lambda t: px.neighbours(t.fx_soma).select("cell_id", "y", "x", "ny", "nx"), "WITH s AS MATERIALIZED (SELECT * FROM fx_soma), n AS (SELECT cell_id, y, x, y + dy AS ny, x + dx AS nx FROM s, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE dy <> 0 OR dx <> 0) SELECT n.cell_id AS cell_id, n.y AS y, n.x AS x, ny, nx FROM n JOIN s ON n.cell_id = s.cell_id AND ny = s.y AND nx = s.x")
query("j15_pairwise_distance", lambda t: r6(jn.pairwise_distance(t.embeddings, "vec_id", "embedding", 100), "distance"), "WITH e AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL ORDER BY md5(concat_ws('|', cast(vec_id AS varchar), '0')), vec_id LIMIT 100) SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (cast(z[1] AS double) - z[2]) * (cast(z[1] AS double) - z[2])))), 6) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id")

# --- aggregates
query("a1_scans_per_group", lambda t: agg.scans_per_group(t.fx_scans), "SELECT diagnosis_group, count(DISTINCT scan_name) AS n_scans FROM fx_scans GROUP BY 1")
query("a2_scan_level", lambda t: r6(agg.scan_level(labelled(t), FEATURES, ["sex", "thal_stage"]), *FEATURES), "SELECT scan_name, round(avg(skeleton_length), 6) AS skeleton_length, round(avg(cell_area), 6) AS cell_area, round(avg(cell_solidity), 6) AS cell_solidity, round(avg(cell_circularity), 6) AS cell_circularity, max(sex) AS sex, max(thal_stage) AS thal_stage FROM fx_cells JOIN fx_scans USING (scan_name) GROUP BY scan_name")
query("a3_inconsistent", lambda t: longs(agg.inconsistent(labelled(t), ["sex", "cluster"]), "n_values"), "SELECT scan_name, 'cluster' AS \"column\", count(DISTINCT cluster) AS n_values FROM fx_cells GROUP BY 1 HAVING count(DISTINCT cluster) > 1")
query("a4_drop_small_scans", lambda t: agg.drop_small_scans(t.fx_cells)[0].groupBy("scan_name").agg(F.count("*").alias("n_cells")), "WITH n AS (SELECT scan_name, count(*) n_cells FROM fx_cells GROUP BY 1) SELECT scan_name, n_cells FROM n WHERE n_cells >= (SELECT quantile_cont(n_cells, 0.1) FROM n)")
query("a4_scan_threshold", lambda t: r6(longs(agg.drop_small_scans(t.fx_cells)[2], "removed"), "threshold"), "WITH n AS (SELECT scan_name, count(*) n_cells FROM fx_cells GROUP BY 1), q AS (SELECT quantile_cont(n_cells, 0.1) t FROM n) SELECT round(max(t), 6) AS threshold, count(*) FILTER (n_cells < t) AS removed FROM n, q")
query("p15_cluster_columns", lambda t: (lambda d: r6(d.select("scan_name", F.array(*flt.cluster_columns(d, "hard_cluster_")).alias("parts")).select("scan_name", *(F.col("parts")[k].alias(f"p{k}") for k in range(4))), "p0", "p1", "p2", "p3"))(agg.cluster_props(t.fx_cells, "cluster", range(4)).select("scan_name", *(f"hard_cluster_{k}" for k in (3, 1, 0, 2)))), "SELECT scan_name, " + ", ".join(f"round(count(*) FILTER (cluster = {k}) / cast(count(*) AS double), 6) AS p{k}" for k in range(4)) + " FROM fx_cells WHERE cluster IS NOT NULL GROUP BY scan_name")
query("a5_cluster_props", lambda t: r6(agg.cluster_props(t.fx_cells, "cluster", range(4)), *(f"hard_cluster_{k}" for k in range(4))), "SELECT scan_name, " + ", ".join(f"round(count(*) FILTER (cluster = {k}) / cast(count(*) AS double), 6) AS hard_cluster_{k}" for k in range(4)) + ", count(*) AS n_cells FROM fx_cells WHERE cluster IS NOT NULL GROUP BY scan_name")
query("a5_composition_long", lambda t: r6(agg.composition_long(t.fx_cells, "cluster"), "p"), "SELECT scan_name, cluster, round(count(*) / cast(sum(count(*)) OVER (PARTITION BY scan_name) AS double), 6) AS p, cast(sum(count(*)) OVER (PARTITION BY scan_name) AS bigint) AS n_cells FROM fx_cells GROUP BY 1, 2")
query("a6_contingency", lambda t: agg.contingency(t.fx_cells.join(t.fx_expert, ["scan_name", "cell_id"]), "cluster_annotation", "cluster", range(4)), "SELECT cluster_annotation, " + ", ".join(f"count(*) FILTER (cluster = {k}) AS cluster_{k}" for k in range(4)) + " FROM fx_cells JOIN fx_expert USING (scan_name, cell_id) GROUP BY 1")
query("a7_crosstab_norm", lambda t: r6(agg.crosstab_norm(labelled(t), "diagnosis_group", "cluster"), "share"), "SELECT diagnosis_group, cluster, round(count(*) / cast(sum(count(*)) OVER (PARTITION BY diagnosis_group) AS double), 6) AS share FROM fx_cells JOIN fx_scans USING (scan_name) GROUP BY 1, 2")
query(
    "a8_nmi",
    lambda t: longs(r6(agg.nmi(t.fx_cells.join(t.fx_expert, ["scan_name", "cell_id"]).withColumn("size_class", F.floor(F.col("cell_area") / 20000)), ["cluster", "size_class"], "cluster_annotation"), "nmi"), "n_overlap", "n_clusters", "n_labels"),
    "WITH d AS (SELECT 'cluster' AS method, cast(cluster AS varchar) c, cluster_annotation l FROM fx_cells JOIN fx_expert USING (scan_name, cell_id) UNION ALL SELECT 'size_class', cast(floor(cell_area / 20000) AS varchar), cluster_annotation FROM fx_cells JOIN fx_expert USING (scan_name, cell_id)), j AS (SELECT method, c, l, count(*) n FROM d GROUP BY 1, 2, 3), k AS (SELECT *, cast(sum(n) OVER (PARTITION BY method) AS double) t, cast(sum(n) OVER (PARTITION BY method, c) AS double) nc, cast(sum(n) OVER (PARTITION BY method, l) AS double) nl FROM j) SELECT method, round(2 * sum(n / t * ln(n * t / (nc * nl))) / (sum(-n / t * ln(nc / t)) + sum(-n / t * ln(nl / t))), 6) AS nmi, cast(sum(n) AS bigint) AS n_overlap, count(DISTINCT c) AS n_clusters, count(DISTINCT l) AS n_labels FROM k GROUP BY method",
)
query("a9_fold_summary", lambda t: r6(agg.fold_summary(t.fx_metrics.groupBy("variant", "fold").agg(F.avg("metric").alias("m")), "m", ["variant"]), "mean", "std"), "SELECT variant, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT variant, fold, avg(metric) m FROM fx_metrics GROUP BY 1, 2) GROUP BY 1")
query("a10_split_summary", lambda t: r6(agg.split_summary(t.fx_metrics, "metric", ["variant", "fold"]), "mean", "std"), "SELECT variant, fold, round(avg(metric), 6) AS mean, round(coalesce(stddev_samp(metric), 0), 6) AS std, count(*) AS n_splits FROM fx_metrics GROUP BY 1, 2")
query("a11_region_summary", lambda t: r6(agg.region_summary(t.fx_metrics, "metric", ["variant"]), "mean", "std"), "SELECT variant, region, round(avg(metric), 6) AS mean, round(stddev_pop(metric), 6) AS std, count(*) AS n FROM fx_metrics WHERE metric IS NOT NULL GROUP BY 1, 2")
query("a12_fold_region_summary", lambda t: r6(agg.fold_region_summary(t.fx_metrics.where("not (region = 'soma' and fold = 2 and variant = 'none')"), "metric", 5), "mean", "std"), "SELECT variant, region, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, count(*) AS n_folds FROM (SELECT variant, region, fold, avg(metric) m FROM fx_metrics WHERE NOT (region = 'soma' AND fold = 2 AND variant = 'none') GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 5 OR region = 'overall'")
query("a13_compare_variants", lambda t: r6(agg.compare_variants(t.fx_metrics, "metric", "none"), "mean", "difference"), "WITH m AS (SELECT variant, region, avg(metric) m FROM fx_metrics GROUP BY 1, 2) SELECT variant, region, round(m, 6) AS mean, round(m - max(CASE WHEN variant = 'none' THEN m END) OVER (PARTITION BY region), 6) AS difference FROM m")
WEIGHTS = lambda t: t.region.where("r_regionkey < 2").select(F.element_at(F.array(*map(F.lit, FEATURES)), (F.col("r_regionkey") + 1).cast("int")).alias("feature"), (F.col("r_regionkey") + 1).cast("double").alias("weight"))
moved = lambda t: t.fx_cells.withColumns({"cell_area": F.col("cell_area") * 1.1, "skeleton_length": F.col("skeleton_length") + 2})
scores = lambda t: agg.morphology_score(moved(t), t.fx_cells, WEIGHTS(t), ["skeleton_length", "cell_area", "cell_circularity"], CELL)
SCORE_SQL = "v AS (SELECT scan_name, image_name, cell_id, 'skeleton_length' AS feature, skeleton_length + 2 AS p, skeleton_length AS t, 1.0 AS w FROM fx_cells UNION ALL SELECT scan_name, image_name, cell_id, 'cell_area', cell_area * 1.1, cell_area, 2.0 FROM fx_cells UNION ALL SELECT scan_name, image_name, cell_id, 'cell_circularity', cell_circularity, cell_circularity, 0.0 FROM fx_cells), e AS (SELECT *, abs(p - t) / (abs(p) + abs(t) + 1e-8) AS error FROM v)"
query("a14_feature_summary", lambda t: r6(agg.feature_summary(scores(t)), "error", "performance", "weight", "contribution", "weight_share", "total_score"), f"WITH {SCORE_SQL}, f AS (SELECT feature, avg(error) error, avg(1 - error) performance, avg(w) weight, avg(w * (1 - error)) contribution FROM e GROUP BY 1) SELECT feature, round(error, 6) AS error, round(performance, 6) AS performance, round(cast(weight AS double), 6) AS weight, round(contribution, 6) AS contribution, round(weight / sum(weight) OVER (), 6) AS weight_share, round(sum(contribution) OVER () / sum(weight) OVER (), 6) AS total_score FROM f")
query("e7_morphology_score", lambda t: r6(scores(t).groupBy(*CELL).agg(F.max("score").alias("score")), "score"), f"WITH {SCORE_SQL} SELECT {CELL_SQL}, round(sum(w * (1 - error)) / sum(w), 6) AS score FROM e GROUP BY 1, 2, 3")
query("a15_image_labels", lambda t: agg.image_labels(t.fx_cells.select("image_name", F.concat(F.lit("class_"), F.col("cluster").cast("string")).alias("class_name"))), "SELECT image_name, array_to_string(list_sort(list(DISTINCT concat('class_', cast(cluster AS varchar)))), '|') AS label, count(DISTINCT cluster) > 1 AS ambiguous FROM fx_cells GROUP BY 1")
query("a16_box_summary", lambda t: r6(agg.box_summary(t.fx_cells, "cell_area", ["cluster"]), "low", "q1", "median", "q3", "high"), "WITH q AS (SELECT cluster, quantile_cont(cell_area, 0.25) a, quantile_cont(cell_area, 0.5) m, quantile_cont(cell_area, 0.75) b FROM fx_cells GROUP BY 1) SELECT cluster, round(min(cell_area) FILTER (cell_area BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 6) AS low, round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, round(max(cell_area) FILTER (cell_area BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)), 6) AS high, count(*) AS n FROM fx_cells JOIN q USING (cluster) GROUP BY cluster, a, m, b")
query("a17_centroids", lambda t: r6(agg.centroids(t.fx_cells, "cluster", FEATURES), *FEATURES), "SELECT cluster, round(avg(skeleton_length), 6) AS skeleton_length, round(avg(cell_area), 6) AS cell_area, round(avg(cell_solidity), 6) AS cell_solidity, round(avg(cell_circularity), 6) AS cell_circularity FROM fx_cells GROUP BY 1")
query("a18_duplicates", lambda t: agg.duplicates(t.fx_cells, ["scan_name", "image_name"]), "SELECT scan_name, image_name, count(*) AS n FROM fx_cells GROUP BY 1, 2 HAVING count(*) > 1")
query("a19_cleaning_stats", lambda t: longs(agg.cleaning_stats(t.part.select("p_partkey", (F.col("p_size") % 4).alias("n_components"))), "removed"), "SELECT count(*) AS total, count(*) FILTER (p_size % 4 = 1) AS single, count(*) FILTER (p_size % 4 > 1) AS multi, count(*) FILTER (p_size % 4 = 0) AS empty, cast(coalesce(sum(p_size % 4 - 1) FILTER (p_size % 4 > 1), 0) AS bigint) AS removed FROM part")
query("a20_counts", lambda t: r6(agg.counts(t.fx_cells), "mean_per_image"), "SELECT cast(sum(n) AS bigint) AS n_boxes, count(*) AS n_images, round(avg(n), 6) AS mean_per_image, max(n) AS max_per_image FROM (SELECT count(*) n FROM fx_cells GROUP BY scan_name, image_name)")
query("a21_loocv_summary", lambda t: r6(agg.loocv_summary(t.fx_metrics.withColumnRenamed("fold", "run"), "metric", ["variant", "region"], 50.0, t.fx_metrics.groupBy("region").agg(F.avg("metric").alias("base"))).drop("base"), "mean", "std", "min", "max", "share_above", "shift"), "WITH b AS (SELECT region, avg(metric) base FROM fx_metrics GROUP BY 1) SELECT variant, region, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS std, round(min(metric), 6) AS min, round(max(metric), 6) AS max, round(avg(CASE WHEN metric > 50 THEN 1.0 ELSE 0.0 END), 6) AS share_above, count(DISTINCT fold) AS n_runs, round(avg(metric) - max(base), 6) AS shift FROM fx_metrics JOIN b USING (region) GROUP BY 1, 2")
query("a22_testset_scores", lambda t: r6(agg.testset_scores(t.fx_metrics.withColumnRenamed("metric", "dice"), ["dice"]), "dice"), "SELECT variant, round(avg(metric), 6) AS dice, count(*) AS n_cells FROM fx_metrics GROUP BY 1")

# --- windows, order, sets
query("w1_central_cells", lambda t: r6(rk.central_cells(t.fx_cells, "cluster", ["skeleton_length", "cell_area"], 5, "cell_id").select("cluster", "cell_id", "rank", "distance"), "distance"), "WITH m AS (SELECT cluster, avg(skeleton_length) a, avg(cell_area) b FROM fx_cells GROUP BY 1), d AS (SELECT cluster, cell_id, sqrt((skeleton_length - a) * (skeleton_length - a) + (cell_area - b) * (cell_area - b)) distance FROM fx_cells JOIN m USING (cluster)), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, cell_id) AS rank FROM d) SELECT cluster, cell_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= 5")
query("w2_label_examples", lambda t: rk.label_examples(t.fx_expert, "cluster_annotation", 4, ["label_order", "cell_id"]).select("cluster_annotation", "cell_id", "rank", "total"), "SELECT cluster_annotation, cell_id, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY cluster_annotation ORDER BY label_order, cell_id) AS rank, count(*) OVER (PARTITION BY cluster_annotation) AS total FROM fx_expert) WHERE rank <= 4")
query("w3_keep_first", lambda t: rk.keep_first(t.fx_expert, ["scan_name", "cell_id"], ["label_order"]), f"WITH {EXPERT_SQL} SELECT scan_name, cell_id, cluster_annotation, label_order FROM e")
query("w4_number_cells", lambda t: rk.number_cells(t.fx_cells, ["scan_name", "image_name"], ["cell_id"]).select(*CELL, "number"), f"SELECT {CELL_SQL}, row_number() OVER (PARTITION BY scan_name, image_name ORDER BY cell_id) - 1 AS number FROM fx_cells")
query("w5_avg_rank", lambda t: od.with_avg_rank(t.fx_cells, "skeleton_length", ["scan_name"], "r").select("cell_id", "r"), "SELECT cell_id, cast(rank() OVER (PARTITION BY scan_name ORDER BY skeleton_length) + (count(*) OVER (PARTITION BY scan_name, skeleton_length) - 1) / 2.0 AS double) AS r FROM fx_cells")
query("w6_fdr_bh", lambda t: r6(od.fdr_bh(t.part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 17 > 0, (F.col("p_partkey") * 7919 % 10007).cast("double") / 10007).alias("p")), "p", ["p_brand"]).select("p_partkey", "q_value"), "q_value"), "WITH d AS (SELECT p_partkey, p_brand, cast(p_partkey * 7919 % 10007 AS double) / 10007 AS p FROM part WHERE p_partkey % 17 > 0), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) k, count(*) OVER (PARTITION BY p_brand) m FROM d) SELECT p_partkey, round(least(1, min(p * m / k) OVER (PARTITION BY p_brand ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM r UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 17 = 0")
query("w7_rle_encode", lambda t: px.rle_encode(t.fx_pixels, 64, 64).select("cell_id", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("runs")), "WITH p AS (SELECT cell_id, x * 64 + y AS pos FROM fx_pixels), i AS (SELECT cell_id, pos - row_number() OVER (PARTITION BY cell_id ORDER BY pos) AS g, pos FROM p), r AS (SELECT cell_id, min(pos) a, count(*) n FROM i GROUP BY cell_id, g), z AS (SELECT cell_id, a, n, a - coalesce(lag(a + n) OVER (PARTITION BY cell_id ORDER BY a), 0) z FROM r), s AS (SELECT cell_id, string_agg(concat(z, ',', n), ',' ORDER BY a) s, 4096 - max(a + n) AS last FROM z GROUP BY 1) SELECT cell_id, CASE WHEN last > 0 THEN concat(s, ',', last) ELSE s END AS runs FROM s")
query("w8_rle_decode", lambda t: longs(px.rle_decode(px.rle_encode(t.fx_pixels, 64, 64), 64), "y", "x"), "SELECT cell_id, y, x FROM fx_pixels")
query("w9_with_rank", lambda t: od.with_rank(t.part, [F.desc("p_retailprice"), "p_partkey"]).select("p_partkey", "rank"), "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
query("o1_order_results", lambda t: rk.order_results(t.fx_scans, ("braak_stage", "asc"), ("scan_name", "asc")).select("scan_name", "braak_stage"), "SELECT scan_name, braak_stage FROM fx_scans ORDER BY braak_stage NULLS LAST, scan_name")
query("o2_top_n", lambda t: rk.top_n(t.fx_cells, [F.desc("cell_area"), "cell_id"], 10).select("cell_id", "cell_area"), "SELECT cell_id, cell_area FROM fx_cells ORDER BY cell_area DESC, cell_id LIMIT 10")
query("o3_argmax_row", lambda t: rk.argmax_row(t.fx_cells, "skeleton_length", "cell_id").select("cell_id", "skeleton_length"), "SELECT cell_id, skeleton_length FROM fx_cells ORDER BY skeleton_length DESC, cell_id LIMIT 1")
query("u1_stack", lambda t: rk.stack(t.fx_cells.where("cluster = 0").select("cell_id", "conf"), t.fx_cells.where("cluster = 1").select("cell_id", "cell_area")), "SELECT cell_id, CASE WHEN cluster = 0 THEN conf END AS conf, CASE WHEN cluster = 1 THEN cell_area END AS cell_area FROM fx_cells WHERE cluster < 2")
query("u2_with_additional", lambda t: rk.with_additional(t.orders.where("o_orderkey % 3 = 0").select("o_orderkey"), t.orders.where("o_orderkey % 3 = 1").select("o_orderkey"), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 < 2")
query("u3_key_diff", lambda t: rk.key_diff(t.fx_cells, t.fx_expert, ["scan_name", "cell_id"]), "SELECT DISTINCT scan_name, cell_id FROM fx_cells EXCEPT SELECT scan_name, cell_id FROM fx_expert")
query("u3_key_intersect", lambda t: rk.key_intersect(t.fx_cells, t.fx_expert, ["scan_name", "cell_id"]), "SELECT scan_name, cell_id FROM fx_cells INTERSECT SELECT scan_name, cell_id FROM fx_expert")
query("u4_distinct_keys", lambda t: rk.distinct_keys(t.fx_cells, ["scan_name", "image_name"]), "SELECT DISTINCT scan_name, image_name FROM fx_cells")

# --- names and scores
PATH = lambda: F.concat(F.lit("/data/images/"), F.col("o_orderstatus"), F.lit("/images/"), F.col("file_name"))
names = lambda t: t.fx_ann_names.join(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
NAMES_SQL = "n AS (SELECT o_orderkey, file_name, o_orderpriority, concat('/data/images/', o_orderstatus, '/images/', file_name) AS path FROM fx_ann_names JOIN orders USING (o_orderkey))"
query("x1_stem", lambda t: names(t).select("o_orderkey", tx.stem(PATH()).alias("stem")), "SELECT o_orderkey, regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM fx_ann_names")
ann = lambda t: t.fx_ann_names.select("o_orderkey", tx.parse_flat_name("file_name", ["MG_whole", "MG_cell_body", "whole"]).alias("f")).select("o_orderkey", "f.*")
ANN_SQL = "f AS (SELECT o_orderkey, regexp_extract(file_name, '^(.+?)_MG_whole_(ann-.*)$', 1) AS scan, regexp_extract(file_name, '^(.+?)_MG_whole_(ann-.*)$', 2) AS ann_name FROM fx_ann_names WHERE file_name LIKE '%\\_MG\\_whole\\_ann-%' ESCAPE '\\')"
query("x2_parse_ann_name", lambda t: ann(t).where("ann_name is not null").select("o_orderkey", tx.parse_ann_name("ann_name").alias("p")).select("o_orderkey", "p.*"), f"WITH {ANN_SQL} SELECT o_orderkey, cast(regexp_extract(ann_name, 'ann-(\\d+)', 1) AS bigint) AS ann_id, cast(regexp_extract(ann_name, '__x-(\\d+)', 1) AS integer) AS x, cast(regexp_extract(ann_name, '_y-(\\d+)', 1) AS integer) AS y, cast(regexp_extract(ann_name, '_w-(\\d+)', 1) AS integer) AS w, cast(regexp_extract(ann_name, '_h-(\\d+)', 1) AS integer) AS h, cast(regexp_extract(ann_name, '__ds-(\\d+)', 1) AS integer) AS ds FROM f")
query("x3_ann_name", lambda t: t.fx_cells.select("cell_id", tx.ann_name("cell_id", "xmin", "ymin", F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1)).alias("name")), "SELECT cell_id, concat('ann-', cell_id, '__x-', xmin, '_y-', ymin, '_w-', xmax - xmin, '_h-', ymax - ymin, '__ds-1.png') AS name FROM fx_cells")
query("x4_parse_flat_name", lambda t: ann(t), f"WITH {ANN_SQL} SELECT o_orderkey, f.scan AS scan, CASE WHEN f.scan IS NOT NULL THEN 'MG_whole' END AS class, f.ann_name AS ann_name FROM fx_ann_names LEFT JOIN f USING (o_orderkey)")
query("x5_strip_suffix", lambda t: names(t).select("o_orderkey", tx.strip_suffix("file_name", ["__ds-1.png", ".tif"]).alias("tile")), "SELECT o_orderkey, CASE WHEN file_name LIKE '%\\_\\_ds-1.png' ESCAPE '\\' THEN left(file_name, length(file_name) - 10) END AS tile FROM fx_ann_names")
query("x6_extract_donor", lambda t: t.fx_ann_names.select("o_orderkey", tx.extract_donor("file_name", ["2016-01", "2016-012", "2016-04", "a.b"]).alias("donor")), "SELECT o_orderkey, nullif(regexp_extract(file_name, '2016-012|2016-01|2016-04|a\\.b'), '') AS donor FROM fx_ann_names")
query("x7_max_number", lambda t: t.fx_scans.select("scan_name", tx.max_number("thal_stage").alias("stage")), "SELECT scan_name, list_max(list_transform(regexp_extract_all(thal_stage, '\\d+(?:\\.\\d+)?'), lambda x: cast(x AS double))) AS stage FROM fx_scans")
query("x8_safe_stem", lambda t: names(t).select("o_orderkey", tx.safe_stem(F.concat("file_name", F.lit(".rf.abc")), 60).alias("stem")), "SELECT o_orderkey, CASE WHEN length(file_name) > 60 THEN md5(file_name) ELSE file_name END AS stem FROM fx_ann_names")
query("x9_safe_token", lambda t: t.orders.select("o_orderkey", tx.safe_token(F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" /a.b ")))).alias("token")), "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN regexp_replace(regexp_replace(trim(concat('  ', o_orderpriority, ' /a.b ')), '\\s+', '_', 'g'), '[^A-Za-z0-9_-]', '_', 'g') ELSE 'Unclassified' END AS token FROM orders")
query("x10_label_path", lambda t: names(t).select("o_orderkey", tx.label_path(PATH()).alias("path")), f"WITH {NAMES_SQL} SELECT o_orderkey, regexp_replace(replace(replace(path, '/data/images/', '/data/labels/'), 'zz', 'zz'), '\\.[^./]*$', '.txt') AS path FROM n")
query("x11_parse_tile", lambda t: t.fx_cells.select("cell_id", tx.parse_tile(F.concat("image_name", F.lit("_gray_matter.jpg"))).alias("p")).select("cell_id", "p.*"), "SELECT cell_id, cast(regexp_extract(image_name, 'x(\\d+)', 1) AS integer) AS x, cast(regexp_extract(image_name, 'y(\\d+)', 1) AS integer) AS y, 'gray' AS tissue FROM fx_cells")
query("x11_scan_name", lambda t: t.orders.select("o_orderkey", tx.scan_name(F.concat(F.lit("/s/"), "o_orderpriority", F.lit(" b.svs"))).alias("scan_name")), "SELECT o_orderkey, replace(concat(o_orderpriority, ' b'), ' ', '_') AS scan_name FROM orders")
_ABC = "a AS (SELECT *, list_max(list_transform(regexp_extract_all(thal_stage, '\\d+(?:\\.\\d+)?'), lambda x: cast(x AS double))) t FROM fx_scans), b AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN t <= 0 THEN 'A0' WHEN t <= 2 THEN 'A1' WHEN t <= 3 THEN 'A2' ELSE 'A3' END a_score, CASE WHEN braak_stage IS NULL THEN NULL WHEN braak_stage <= 0 THEN 'B0' WHEN braak_stage <= 2 THEN 'B1' WHEN braak_stage <= 4 THEN 'B2' ELSE 'B3' END b_score, concat('C', cerad_score) c_score FROM a), c AS (SELECT *, CASE WHEN a_score IS NULL OR b_score IS NULL OR c_score IS NULL THEN NULL WHEN a_score = 'A0' THEN CASE WHEN c_score = 'C0' THEN 'Not' END WHEN b_score IN ('B0', 'B1') THEN 'Low' WHEN a_score = 'A1' AND c_score IN ('C0', 'C1') THEN 'Low' WHEN a_score = 'A3' AND b_score = 'B3' AND c_score IN ('C2', 'C3') THEN 'High' ELSE 'Intermediate' END AS intensity FROM b)"
query("e1_scores", lambda t: cohort.pathology(t.fx_scans).select("scan_name", "a_score", "b_score", "c_score"), f"WITH {_ABC} SELECT scan_name, a_score, b_score, c_score FROM c")
query("e2_ad_intensity", lambda t: cohort.pathology(t.fx_scans).select("scan_name", "intensity"), f"WITH {_ABC} SELECT scan_name, intensity FROM c")
query("e3_abc_string", lambda t: cohort.pathology(t.fx_scans).select("scan_name", "abc"), f"WITH {_ABC} SELECT scan_name, concat(coalesce(a_score, 'NA'), ', ', coalesce(b_score, 'NA'), ', ', coalesce(c_score, 'NA')) AS abc FROM c")
query("e4_pathology_group", lambda t: cohort.pathology(t.fx_scans).select("scan_name", "pathology_group"), f"WITH {_ABC} SELECT scan_name, CASE WHEN diagnosis_group <> '100+' THEN diagnosis_group WHEN intensity IN ('High', 'Intermediate') THEN '100+_with_pathology' ELSE '100+_without_pathology' END AS pathology_group FROM c")
query("e5_ordinal", lambda t: cohort.pathology(t.fx_scans).select("scan_name", tx.ordinal("intensity", {"Not": 0, "Low": 1, "Intermediate": 2, "High": 3}).alias("level")), f"WITH {_ABC} SELECT scan_name, CASE intensity WHEN 'Not' THEN 0 WHEN 'Low' THEN 1 WHEN 'Intermediate' THEN 2 WHEN 'High' THEN 3 END AS level FROM c")
query("e6_stars", lambda t: t.fx_cells.select("cell_id", tx.stars("conf").alias("stars")), "SELECT cell_id, CASE WHEN conf < 0.001 THEN '***' WHEN conf < 0.01 THEN '**' WHEN conf < 0.05 THEN '*' ELSE '' END AS stars FROM fx_cells")

# --- samples and splits
KEYS = ["scan_name", "cell_id"]
_H = lambda keys, seed: "md5(concat_ws('|', " + ", ".join(f"cast({k} AS varchar)" for k in keys) + f", '{seed}'))"
_R = lambda keys, seed, part="", frm="fx_cells": f"r AS (SELECT *, row_number() OVER ({part} ORDER BY {_H(keys, seed)}, {', '.join(keys)}) - 1 AS rank, count(*) OVER ({part}) AS n FROM {frm})"
query("r1_sample_k", lambda t: smp.sample_k(t.fx_cells, 100, KEYS, 7).select(*KEYS), f"WITH {_R(KEYS, 7)} SELECT scan_name, cell_id FROM r WHERE rank < 100")
query("r2_split3", lambda t: smp.split3(t.fx_cells, KEYS).select(*KEYS, "split"), f"WITH {_R(KEYS, 0)} SELECT scan_name, cell_id, CASE WHEN rank < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
query("r3_split_70_15_15", lambda t: smp.split_70_15_15(t.fx_cells, KEYS).select(*KEYS, "split"), f"WITH {_R(KEYS, 0)} SELECT scan_name, cell_id, CASE WHEN rank < ceil(ceil(n * 0.3::DOUBLE) * 0.5) THEN 'test' WHEN rank < ceil(n * 0.3::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
query("r4_kfold", lambda t: longs(smp.kfold(t.fx_cells.select("cell_id"), ["cell_id"]).select("cell_id", "fold", "split"), "fold"), f"WITH h AS MATERIALIZED (SELECT cell_id, {_H(['cell_id'], 0)} AS h FROM fx_cells), r AS MATERIALIZED (SELECT cell_id, (row_number() OVER (ORDER BY h, cell_id) - 1) % 5 AS own FROM h), e AS MATERIALIZED (SELECT cell_id, own, fold, {_H(['cell_id', 'fold'], 0)} AS h FROM r, range(5) f(fold)), q AS (SELECT cell_id, fold, row_number() OVER (PARTITION BY fold ORDER BY h, cell_id) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM e WHERE own <> fold) SELECT cell_id, fold, CASE WHEN k < ceil(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM q UNION ALL SELECT cell_id, fold, 'test' FROM e WHERE own = fold")
query("r5_repeated_splits", lambda t: longs(smp.repeated_splits(t.fx_cells, ["cell_id"]).select("cell_id", "fold", "split"), "fold"), f"WITH e AS (SELECT cell_id, fold FROM fx_cells, range(5) f(fold)), {_R(['cell_id', 'fold'], 0, 'PARTITION BY fold', 'e')} SELECT cell_id, fold, CASE WHEN rank < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r")
query("r6_split2", lambda t: smp.split2(t.fx_cells, KEYS).select(*KEYS, "split"), f"WITH {_R(KEYS, 0)} SELECT scan_name, cell_id, CASE WHEN rank < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r")
query("r7_labelled_fraction", lambda t: smp.labelled_fraction(t.fx_cells, KEYS, 0.25).select(*KEYS, "labelled"), f"WITH {_R(KEYS, 0)} SELECT scan_name, cell_id, rank < greatest(1, round_even(n * 0.25::DOUBLE, 0)) AS labelled FROM r")
query("r8_learning_curve_plan", lambda t: longs(smp.learning_curve_plan(t.fx_cells, ["cell_id"]), "split_seed"), f"WITH p AS (SELECT i / 10.0::DOUBLE AS portion, k AS split_seed FROM range(1, 11) a(i), range(5) b(k) WHERE i < 10 OR k = 0), e AS (SELECT cell_id, portion, split_seed FROM fx_cells, p), {_R(['cell_id', 'split_seed'], 0, 'PARTITION BY portion, split_seed', 'e')} SELECT cell_id, portion, cast(split_seed AS bigint) AS split_seed FROM r WHERE rank < greatest(1, floor(n * portion))")
IMAGE = ["scan_name", "image_name"]
query("r9_random_review", lambda t: smp.random_review(t.fx_cells, 50, IMAGE), f"SELECT scan_name, image_name FROM (SELECT DISTINCT scan_name, image_name FROM fx_cells WHERE conf > 0.5) ORDER BY {_H(IMAGE, 0)}, scan_name, image_name LIMIT 50")
query("r10_inspect_sample", lambda t: smp.inspect_sample(t.fx_cells, 20, IMAGE), f"WITH s AS (SELECT scan_name, image_name FROM (SELECT DISTINCT scan_name, image_name FROM fx_cells) ORDER BY {_H(IMAGE, 0)}, scan_name, image_name LIMIT 20) SELECT scan_name, image_name, count(*) AS n_boxes FROM fx_cells JOIN s USING (scan_name, image_name) GROUP BY 1, 2")

# --- files
def _combined(t: Tables) -> DataFrame:
    """Cells written through combine_results and read back, with the row it returns."""
    path = f"{_shared(t)}/combined-{uuid.uuid4().hex}"
    said = src.combine_results(t.fx_cells, path)
    back = t.spark.read.parquet(path).groupBy("scan_name").agg(F.count("*").alias("n_cells"), F.count_distinct("cell_id").alias("n_ids"))
    return back.join(F.broadcast(said.select("n_rows", "n_scans")), F.lit(True))


query("s2_combine_results", _combined, "SELECT scan_name, count(*) AS n_cells, count(DISTINCT cell_id) AS n_ids, (SELECT count(*) FROM fx_cells) AS n_rows, (SELECT count(DISTINCT scan_name) FROM fx_cells) AS n_scans FROM fx_cells GROUP BY 1")
def _cells_read(t: Tables) -> DataFrame:
    """Cells landed as result files, an older form with `scan_folder` among them, read by read_cells."""
    path = f"{_shared(t)}/results-{uuid.uuid4().hex}"
    cells = t.fx_cells.select("cell_solidity", "image_name", "scan_name", "cell_id")
    cells.where("cell_id % 2 = 0").repartition("scan_name").write.option("header", True).csv(f"{path}/a")
    cells.where("cell_id % 2 = 1").select("cell_id", "scan_name", "cell_solidity").withColumnRenamed("scan_name", "scan_folder").write.option("header", True).csv(f"{path}/b")
    read = src.read_cells(t.spark, path, keep=("cell_id",))
    return read.groupBy("scan_name").agg(F.count("*").alias("n_cells"), F.count("image_name").alias("n_images"), F.round(F.sum("cell_solidity"), 3).alias("solidity"))


def _weights_read(t: Tables) -> DataFrame:
    """Mean of each feature, landed as a weights file."""
    path = f"{_shared(t)}/weights-{uuid.uuid4().hex}"
    means = t.fx_cells.agg(*(F.avg(c).alias(c) for c in FEATURES)).unpivot([], FEATURES, "feature", "weight")
    means.write.option("header", True).csv(path)
    return r6(src.read_weights(t.spark, path), "weight")


def _masks_written(t: Tables) -> DataFrame:
    """Masks written by write_masks, read back and decoded."""
    path = f"{_shared(t)}/masks-{uuid.uuid4().hex}"
    src.write_masks(t.fx_pixels.withColumn("scan", F.concat(F.lit("s"), F.col("cell_id") % 4)).withColumn("class", F.concat(F.lit("c"), F.col("cell_id") % 3)), path, 64, 64)
    runs = t.spark.read.parquet(path).where("value = 255").select("scan", "class", "cell_id", "counts")
    return px.rle_decode(runs, 64).groupBy("scan", "class", "cell_id").agg(F.count("*").alias("area"), F.sum("y").cast("bigint").alias("y"), F.sum("x").cast("bigint").alias("x"))


def _coco(t: Tables) -> DataFrame:
    """Cells as annotated crops in a COCO table; the class is that of the cell's cluster."""
    name = tx.ann_name("cell_id", "xmin", "ymin", F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1))
    kinds = F.array(*map(F.lit, coco.CLASSES))
    cells = t.fx_cells.where("cluster IS NOT NULL").select(F.col("scan_name").alias("scan"), F.element_at(kinds, F.col("cluster").cast("int") + 1).alias("class"), name.alias("file"), *BOX).dropDuplicates(["scan", "class", "file"])  # a folder holds a file once
    masks = cells.select("scan", "class", "file", F.array(F.lit(0)).alias("counts"), F.lit(1.0).alias("area"), F.array(*(F.col(c).cast("double") for c in BOX)).alias("bbox"))
    # Both tables read the box in one order, so that Spark makes and shuffles the cells once for both.
    corner = lambda k: F.element_at(F.array(*BOX), k)
    return coco.to_coco(cells.select("scan", "class", "file", (corner(3) - corner(1)).alias("width"), (corner(4) - corner(2)).alias("height")), masks)


_COCO_SQL = "WITH c AS (SELECT DISTINCT scan_name AS scan, list_extract(['MG_whole', 'MG_cell_body', 'Cluster', 'Unclassified', 'Dirt', 'microglia'], cast(cluster AS int) + 1) AS class, concat('ann-', cell_id, '__x-', xmin, '_y-', ymin, '_w-', xmax - xmin, '_h-', ymax - ymin, '__ds-1.png') AS file FROM fx_cells WHERE cluster IS NOT NULL), n AS (SELECT scan, class, file, row_number() OVER (ORDER BY scan, class, file) AS id FROM c)"
query("s1_read_cells", _cells_read, "SELECT scan_name, count(*) AS n_cells, count(CASE WHEN cell_id % 2 = 0 THEN image_name END) AS n_images, round(sum(cell_solidity), 3) AS solidity FROM fx_cells GROUP BY 1")
query("s6_to_coco", lambda t: longs(_coco(t).select("image.id", "image.file_name", "annotation.category_id"), "id", "category_id"), f"{_COCO_SQL}, k AS (SELECT class, row_number() OVER (ORDER BY f) AS category_id FROM (SELECT class, min(concat(scan, chr(1), class)) AS f FROM n GROUP BY 1)) SELECT id, concat(scan, '_', class, '_', file) AS file_name, category_id FROM n JOIN k USING (class)")


def _coco_index(t: Tables) -> DataFrame:
    """The COCO table written by write_coco, read back and flattened; place and class come from the file name only."""
    path = f"{_shared(t)}/coco-{uuid.uuid4().hex}"
    rows = _coco(t)
    coco.write_coco(rows, path)
    discard(rows)
    schema = t.spark.createDataFrame([], coco.SCHEMA.strip()).schema
    images = t.spark.read.schema(schema["images"].dataType.elementType).json(f"{path}/images")
    images = images.withColumns({c: F.lit(None).cast(images.schema[c].dataType) for c in ("original_scan", "original_class", "original_coords", "downsample")})
    annotations = t.spark.read.schema("id long, image_id long, category_id int").json(f"{path}/annotations")
    return longs(coco.coco_to_index(images, annotations), "x", "y", "w", "h", "ds", "image_id", "annotation_id")


query("s7_coco_to_index", _coco_index, f"{_COCO_SQL} SELECT scan, class, file, cast(regexp_extract(file, '_*x-([0-9]+)', 1) AS bigint) AS x, cast(regexp_extract(file, '_y-([0-9]+)', 1) AS bigint) AS y, cast(regexp_extract(file, '_w-([0-9]+)', 1) AS bigint) AS w, cast(regexp_extract(file, '_h-([0-9]+)', 1) AS bigint) AS h, cast(1 AS bigint) AS ds, id AS image_id, id AS annotation_id FROM n")
query("s13_read_weights", _weights_read, "SELECT unnest(['skeleton_length', 'cell_area', 'cell_solidity', 'cell_circularity']) AS feature, round(unnest([avg(skeleton_length), avg(cell_area), avg(cell_solidity), avg(cell_circularity)]), 6) AS weight FROM fx_cells")
query("s16_write_masks", _masks_written, "SELECT concat('s', cell_id % 4) AS scan, concat('c', cell_id % 3) AS class, cell_id, count(*) AS area, cast(sum(y) AS bigint) AS y, cast(sum(x) AS bigint) AS x FROM fx_pixels GROUP BY cell_id")
query("s3_parse_yolo_lines", lambda t: src.parse_yolo_lines(t.fx_yolo_lines).groupBy("image_name").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 6).alias("cx")), "SELECT image_name, count(*) AS n, round(sum(cast(split_part(line, ' ', 2) AS double)), 6) AS cx FROM fx_yolo_lines WHERE line LIKE '% 0.0625 0.125' GROUP BY 1")
query("s4_yolo_lines", lambda t: src.yolo_lines(geo.xyxy_to_yolo(t.fx_cells, 512, 512).withColumn("cls", F.lit(0)).withColumn("image_name", F.concat_ws("/", "scan_name", "image_name"))).select("image_name", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), F.md5("text").alias("digest")), "WITH l AS (SELECT concat(scan_name, '/', image_name) AS image_name, printf('0 %.6f %.6f %.6f %.6f', (xmin + xmax) / 2.0 / 512, (ymin + ymax) / 2.0 / 512, cast(xmax - xmin AS double) / 512, cast(ymax - ymin AS double) / 512) AS line FROM fx_cells) SELECT image_name, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY 1")
query("s11_candidates", lambda t: src.candidates(t.fx_cells.select("cell_id"), 1000, ["cell_id"]), "SELECT cell_id FROM fx_cells ORDER BY cell_id LIMIT 1000")
query("s15_artifacts_by_tile", lambda t: src.artifacts_by_tile(t.orders.select(F.concat(F.lit("out/t"), F.floor(F.col("o_orderkey") / 3).cast("string"), F.element_at(F.array(F.lit("_mask.png"), F.lit("_overlay_mask.png"), F.lit(".csv")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("path")), {"_mask.png": "mask", "_overlay_mask.png": "overlay", ".csv": "table"}), "WITH f AS (SELECT o_orderkey k, concat('t', o_orderkey // 3) AS tile FROM orders) SELECT tile, min(CASE WHEN k % 3 = 0 THEN concat('out/', tile, '_mask.png') END) AS mask, min(CASE WHEN k % 3 = 1 THEN concat('out/', tile, '_overlay_mask.png') END) AS overlay, min(CASE WHEN k % 3 = 2 THEN concat('out/', tile, '.csv') END) AS \"table\" FROM f GROUP BY 1")

# --- statistics
_RANKS = lambda a, b: f"SELECT '{a}' AS a, '{b}' AS b, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM s WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
_CORR = [*FEATURES[:3], "braak_stage"]
query("t1_corr_matrix", lambda t: r6(st.corr_matrix(scan_table(t), _CORR), "r"), f"WITH {SCAN_SQL}, k AS ({' UNION ALL '.join(_RANKS(a, b) for a in _CORR for b in _CORR)}) SELECT a, b, round(coalesce(corr(x, y), 0), 6) AS r, count(*) AS n FROM k GROUP BY 1, 2")
query("t4_group_contrast", lambda t: r6(st.group_contrast(scan_table(t), FEATURES, ["age_at_death", "sex"], "AD", "100+"), "coef", "se", "t_stat", "p_value", "ci_low", "ci_high", "q_value"))
_Z = lambda c: f"(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ())"
_SS = " + ".join(f"(sum({c} * {c}) - sum({c}) * sum({c}) / count(*))" for c in ("u", "v"))
query("t5_permanova", lambda t: r6(st.permanova(scan_table(t), ["cell_area", "skeleton_length"], 99).select("pseudo_f", "r2", "n", "n_groups"), "pseudo_f", "r2"), f"WITH {SCAN_SQL}, z AS (SELECT diagnosis_group g, {_Z('cell_area')} u, {_Z('skeleton_length')} v FROM s), w AS (SELECT g, {_SS} AS ss, count(*) n FROM z GROUP BY 1), t AS (SELECT {_SS} AS sst FROM z) SELECT round(((max(sst) - sum(ss)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 6) AS pseudo_f, round(1 - sum(ss) / max(sst), 6) AS r2, cast(sum(n) AS bigint) AS n, count(*) AS n_groups FROM w, t")
PARTS = [f"hard_cluster_{k}" for k in range(4)]
props = lambda t: agg.cluster_props(t.fx_cells, "cluster", range(4)).join(t.fx_scans.select("scan_name", "diagnosis_group"), "scan_name")
query("t6_dirichlet_groups", lambda t: r6(st.dirichlet_groups(props(t), PARTS), "alpha", "mean", "variance", "concentration", "entropy"))
query("t6_dirichlet_compare", lambda t: r6(st.dirichlet_compare(props(t), PARTS, "AD", "100+", 50), "diff", "boot_mean", "ci_low", "ci_high", "p_direction"))
query("t7_dirichlet_loo", lambda t: agg.loocv_summary(st.dirichlet_loo(props(t), PARTS, "AD", "100+", 10).where("dropped <> ''").withColumnRenamed("dropped", "run"), "diff", ["cluster"], 0.0))
query(
    "t8_kruskal",
    lambda t: r6(st.kruskal(scan_table(t), "cell_area", "cerad_score").select("h", "n", "n_groups"), "h"),
    f"WITH {SCAN_SQL}, r AS (SELECT cerad_score g, rank() OVER (ORDER BY cell_area) + (count(*) OVER (PARTITION BY cell_area) - 1) / 2.0 r, count(*) OVER (PARTITION BY cell_area) t, count(*) OVER () n FROM s WHERE cell_area IS NOT NULL), g AS (SELECT g, cast(sum(r) AS double) s, count(*) m, cast(sum(t * t - 1) AS double) t, max(n) n FROM r GROUP BY 1) SELECT round((12.0 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1)) / (1 - sum(t) / (power(max(n), 3) - max(n))), 6) AS h, max(n) AS n, count(*) AS n_groups FROM g",
)
query("t9_spearman_test", lambda t: r6(st.spearman_test(scan_table(t), [("cell_area", "braak_stage"), ("skeleton_length", "age_at_death")]).select("a", "b", "r", "n"), "r"), f"WITH {SCAN_SQL}, k AS ({_RANKS('cell_area', 'braak_stage')} UNION ALL {_RANKS('skeleton_length', 'age_at_death')}) SELECT a, b, round(corr(x, y), 6) AS r, count(*) AS n FROM k GROUP BY 1, 2")
query("t10_trend", lambda t: r6(st.trend(t.fx_cells, "skeleton_length", "cell_area", ["cluster"]), "slope", "intercept"), "SELECT cluster, round(regr_slope(cell_area, skeleton_length), 6) AS slope, round(regr_intercept(cell_area, skeleton_length), 6) AS intercept, regr_count(cell_area, skeleton_length) AS n FROM fx_cells GROUP BY 1")
query("t11_zscore", lambda t: r6(st.zscore(t.fx_cells.select("cell_id", "cell_area", "cell_solidity"), ["cell_area", "cell_solidity"]), "cell_area", "cell_solidity"), "SELECT cell_id, round((cell_area - avg(cell_area) OVER ()) / stddev_pop(cell_area) OVER (), 6) AS cell_area, round((cell_solidity - avg(cell_solidity) OVER ()) / stddev_pop(cell_solidity) OVER (), 6) AS cell_solidity FROM fx_cells")
query("t12_zscore_apply", lambda t: r6(st.zscore_apply(t.fx_cells.where("cluster = 2").select("cell_id", "cell_area"), st.zscore_stats(t.fx_cells, ["cell_area"], 1), ["cell_area"]), "cell_area"), "SELECT cell_id, round((cell_area - a) / b, 6) AS cell_area FROM fx_cells, (SELECT avg(cell_area) a, stddev_samp(cell_area) b FROM fx_cells) WHERE cluster = 2")

# --- masks
query("k1_mask_area", lambda t: px.mask_area(t.fx_pixels), "SELECT cell_id, count(*) AS area FROM fx_pixels GROUP BY 1")
query("k2_branch_mask", lambda t: px.mask_area(px.branch_mask(t.fx_pixels, t.fx_soma)), "SELECT cell_id, count(*) AS area FROM (SELECT * FROM fx_pixels EXCEPT SELECT * FROM fx_soma) GROUP BY 1")
query("k3_process_skeleton", lambda t: px.process_skeleton(t.fx_pixels, t.fx_soma), "SELECT cell_id, y, x FROM fx_pixels EXCEPT SELECT cell_id, y, x FROM fx_soma")
query("k4_skeletonize", lambda t: px.skeletonize(t.fx_pixels))
ARMS_SQL = "arms AS (SELECT cell_id, y, x FROM fx_pixels EXCEPT SELECT cell_id, y, x FROM fx_soma), near AS (SELECT a.cell_id, a.y, a.x, count(b.x) AS n FROM arms a LEFT JOIN arms b ON a.cell_id = b.cell_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY 1, 2, 3)"
_SOMA_NEAR = "EXISTS (SELECT 1 FROM fx_soma s WHERE s.cell_id = near.cell_id AND abs(s.y - near.y) <= 1 AND abs(s.x - near.x) <= 1 AND NOT (s.x = near.x AND s.y = near.y))"
arms = lambda t: px.process_skeleton(t.fx_pixels, t.fx_soma)
query("k5_neighbour_count", lambda t: px.neighbour_count(arms(t)), f"WITH {ARMS_SQL} SELECT cell_id, y, x, n FROM near")
query("k6_junctions", lambda t: px.junctions(px.skeletonize(t.fx_pixels)))
query("k7_end_nodes", lambda t: px.end_nodes(arms(t), t.fx_soma), f"WITH {ARMS_SQL} SELECT cell_id, y, x FROM near WHERE n = 1 AND NOT {_SOMA_NEAR}")
query("k8_start_nodes", lambda t: px.start_nodes(arms(t), t.fx_soma), f"WITH {ARMS_SQL} SELECT cell_id, y, x FROM near WHERE n = 1 AND {_SOMA_NEAR}")
query("k9_perimeter", lambda t: r6(px.perimeter(t.fx_soma), "perimeter"))
query("k10_convex_hull", lambda t: r6(px.convex_hull(t.fx_pixels), "hull_area", "hull_perimeter"))
query("k12_component_count", lambda t: px.component_count(arms(t)))
query("k13_largest_component", lambda t: px.mask_area(px.largest_component(arms(t))))
query("k14_clean_masks", lambda t: px.mask_area(px.clean_masks(arms(t))))
query(
    "k15_sholl",
    lambda t: longs(px.sholl(arms(t), t.fx_soma), "sholl_min_radius", "sholl_peak_radius", "sholl_max_radius", "sholl_peak", "sholl_sum"),
    f"WITH {ARMS_SQL}, c AS (SELECT cell_id, avg(y) cy, avg(x) cx FROM fx_soma GROUP BY 1), d AS (SELECT cell_id, sqrt((y - cy) * (y - cy) + (x - cx) * (x - cx)) d FROM arms JOIN c USING (cell_id)), h AS (SELECT cell_id, cast(floor(d + 0.5) AS bigint) r, count(*) n FROM d WHERE floor(d + 0.5) >= 1 GROUP BY 1, 2) SELECT cell_id, min(r) AS sholl_min_radius, arg_max(r, n * 1000 - r) AS sholl_peak_radius, max(r) AS sholl_max_radius, max(n) AS sholl_peak, cast(sum(n) AS bigint) AS sholl_sum FROM h GROUP BY 1",
)
query("k16_morphology", lambda t: (lambda d: r6(d, *(c for c, k in d.dtypes if k == "double")))(px.morphology(ids(t), t.fx_pixels, t.fx_soma)))
shifted = lambda t: t.fx_pixels.withColumn("x", F.col("x") + 1)
_TP = "s AS (SELECT coalesce(a.cell_id, b.cell_id) cell_id, count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) tp, count(*) FILTER (b.x IS NULL) fp, count(*) FILTER (a.x IS NULL) fn FROM (SELECT cell_id, y, x + 1 AS x FROM fx_pixels) a FULL JOIN fx_pixels b ON a.cell_id = b.cell_id AND a.y = b.y AND a.x = b.x GROUP BY 1)"
query("k17_dice_iou", lambda t: r6(px.dice_iou(shifted(t), t.fx_pixels), "dice", "iou"), f"WITH {_TP} SELECT cell_id, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou FROM s")
query("k18_binary_metrics", lambda t: r6(px.binary_metrics(shifted(t), t.fx_pixels), "dice", "iou", "precision", "recall"), f"WITH {_TP} SELECT cell_id, round((2 * tp + 1e-6) / (2 * tp + fp + fn + 1e-6), 6) AS dice, round((tp + 1e-6) / (tp + fp + fn + 1e-6), 6) AS iou, round((tp + 1e-6) / (tp + fp + 1e-6), 6) AS precision, round((tp + 1e-6) / (tp + fn + 1e-6), 6) AS recall FROM s")
query("k19_evaluate_regions", lambda t: r6(px.evaluate_regions(shifted(t), t.fx_pixels, t.fx_soma), "dice", "iou", "precision", "recall"))
query("k21_betti", lambda t: px.betti(t.fx_pixels))
query("k21_betti_diff", lambda t: px.betti_diff(t.fx_pixels, arms(t)))
gray = lambda t: t.fx_pixels.withColumn("gray", (F.col("x") * 7 + F.col("y") * 3) % 200)
query(
    "k22_otsu_threshold",
    lambda t: px.otsu_threshold(gray(t).select("cell_id", F.col("gray").alias("g")), ["cell_id"]),
    "WITH h AS (SELECT cell_id, (x * 7 + y * 3) % 200 AS g, count(*) n FROM fx_pixels GROUP BY 1, 2), c AS (SELECT cell_id, g, cast(sum(n) OVER a AS double) w0, cast(sum(n * g) OVER a AS double) s0, cast(sum(n) OVER (PARTITION BY cell_id) AS double) w, cast(sum(n * g) OVER (PARTITION BY cell_id) AS double) s FROM h WINDOW a AS (PARTITION BY cell_id ORDER BY g)), b AS (SELECT cell_id, g, CASE WHEN w > w0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE 0 END b FROM c) SELECT cell_id, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY b DESC, g) k FROM b) WHERE k = 1",
)
query("k22_otsu_mask", lambda t: px.mask_area(px.otsu_mask(gray(t), t.fx_soma)))
query("k23_fill_holes", lambda t: px.mask_area(px.fill_holes(arms(t), 64, 64)))
query("k24_rasterize", lambda t: px.mask_area(px.rasterize(t.fx_regions.select("region_id", F.array(*(F.struct((F.col(a) % 47).alias("x"), (F.col(b) % 37).alias("y")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1")))).alias("polygon")))))
prob = lambda t: t.fx_pixels.withColumn("p", (F.col("x") * 13 + F.col("y") * 29) % 100 / 100.0)
query("k25_grow", lambda t: px.mask_area(px.grow(prob(t))))
query("k26_confident_crops", lambda t: px.confident_crops(prob(t), 0.5).groupBy("cell_id").agg(F.sum("label").alias("n")), "WITH p AS (SELECT cell_id, (x * 13 + y * 29) % 100 / 100.0::DOUBLE AS p FROM fx_pixels) SELECT cell_id, cast(sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS bigint) AS n FROM p GROUP BY 1 HAVING avg(p) >= 0.5")

# --- detection
preds = lambda t: t.fx_cells.select(*IMAGE, F.col("cell_id").alias("pred_id"), "conf", *((F.col(c) + F.col("cell_id") % 4).alias(c) for c in BOX))
truth = lambda t: t.fx_cells.where("cluster < 3").select(*IMAGE, F.col("cell_id").alias("true_id"), *BOX)
query(
    "d1_box_iou",
    lambda t: r6(det.box_iou(preds(t), truth(t), IMAGE, 0.2).select("pred_id", "true_id", "iou"), "iou"),
    "WITH p AS (SELECT scan_name, image_name, cell_id AS pred_id, xmin + cell_id % 4 a, ymin + cell_id % 4 b, xmax + cell_id % 4 c, ymax + cell_id % 4 d FROM fx_cells), j AS (SELECT pred_id, cell_id AS true_id, cast(greatest(least(c, xmax) - greatest(a, xmin), 0) AS double) * greatest(least(d, ymax) - greatest(b, ymin), 0) i, (c - a) * (d - b) + (xmax - xmin) * (ymax - ymin) u FROM p JOIN fx_cells USING (scan_name, image_name) WHERE cluster < 3) SELECT pred_id, true_id, round(i / (u - i), 6) AS iou FROM j WHERE u > i AND i / (u - i) > 0.2",
)
CLASS = ["cls"]
classed = lambda t: (preds(t).withColumn("cls", F.col("pred_id") % 3), truth(t).withColumn("cls", F.col("true_id") % 3))
matches = lambda t: det.match_boxes(*classed(t), [*IMAGE, *CLASS])
query("d2_match_boxes", lambda t: matches(t).groupBy("cls", "threshold").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")))
query("d3_average_precision", lambda t: r6(det.average_precision(matches(t), classed(t)[1], CLASS), "ap"))
query("d3_mean_average_precision", lambda t: r6(det.mean_average_precision(matches(t), classed(t)[1], CLASS), "ap50", "ap50_95"))
query("d4_precision_recall_at", lambda t: r6(det.precision_recall_at(matches(t), classed(t)[1], 0.5, CLASS), "precision", "recall"))

# --- plans
query("q1_composition_by_diagnosis", lambda t: r6(cohort.composition_by_diagnosis(t.fx_cells, t.fx_scans), "p"), "WITH k AS (SELECT * FROM fx_cells WHERE cell_solidity IS NOT NULL), q AS (SELECT quantile_cont(cell_area, 0.002) a, quantile_cont(cell_area, 0.998) b FROM k), c AS (SELECT k.* FROM k, q WHERE cell_area BETWEEN a AND b AND xmin > 1 AND ymin > 1 AND xmax < 511 AND ymax < 511), n AS (SELECT scan_name, count(*) n FROM c GROUP BY 1), m AS (SELECT scan_name FROM n WHERE n >= (SELECT quantile_cont(n, 0.1) FROM n)) SELECT diagnosis_group, scan_name, cluster, round(count(*) / cast(sum(count(*)) OVER (PARTITION BY scan_name) AS double), 6) AS p, cast(sum(count(*)) OVER (PARTITION BY scan_name) AS bigint) AS n_cells FROM c JOIN m USING (scan_name) JOIN fx_scans USING (scan_name) GROUP BY 1, 2, 3")

# --- clustering and selection
whole = lambda t: ml.vectors(t.embeddings.select("vec_id", "label", "embedding"), "embedding")
low = lambda t: t.embeddings.select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
_DIST = "sqrt(list_sum(list_transform(list_zip(a.{0}, b.{0}), lambda z: (cast(z[1] AS double) - z[2]) * (cast(z[1] AS double) - z[2]))))"
_E = "e AS (SELECT vec_id, label, embedding, embedding[1:2] AS low FROM embeddings WHERE embedding IS NOT NULL ORDER BY md5(concat_ws('|', cast(vec_id AS varchar), '0')), vec_id LIMIT 300)"
query("m1_pca", lambda t: ml.pca_of(whole(t))[0].select("vec_id", F.round(F.abs(F.col("pc")[0]), 4).alias("pc0"), F.round(F.abs(F.col("pc")[1]), 4).alias("pc1")))
query("m2_kmeans", lambda t: ml.kmeans(whole(t), 4)[0].groupBy("cluster").agg(F.count("*").alias("n")))


def _fixed_point(t: Tables) -> DataFrame:
    """Of the best of 50 starts: rows, clusters, whether the cost is the rows' squared distance from their clusters' means, and rows nearer to another mean."""
    rows, cost = ml.kmeans(whole(t), 4)
    each = rows.select("vec_id", "cluster", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "x"))
    means = each.groupBy("cluster", "j").agg(F.avg("x").alias("m"))
    far = each.join(F.broadcast(means.withColumnRenamed("cluster", "other")), "j").groupBy("vec_id", "cluster", "other").agg(F.sum((F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))).alias("d"))
    own = far.groupBy("vec_id", "cluster").agg(F.max(F.when(F.col("other") == F.col("cluster"), F.col("d"))).alias("d"), F.min("d").alias("least"))
    return own.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("n_clusters"), (F.abs(F.sum("d") / cost - 1) < 1e-4).alias("cost_holds"), F.count_if(F.col("d") > F.col("least") + 1e-2).alias("misplaced"))


query("m2_kmeans_fixed_point", _fixed_point, "SELECT count(*) AS n, cast(4 AS bigint) AS n_clusters, true AS cost_holds, cast(0 AS bigint) AS misplaced FROM embeddings WHERE embedding IS NOT NULL")
query("m3_best_k", lambda t: r6(ml.best_k(whole(t), "vec_id"), "silhouette"))
query(
    "m4_silhouette",
    lambda t: r6(ml.silhouette(t.embeddings, "vec_id", "embedding", "label", 300), "silhouette"),
    f"WITH {_E}, d AS (SELECT a.vec_id v, a.label la, b.label lb, {_DIST.format('embedding')} d FROM e a, e b WHERE a.vec_id <> b.vec_id), m AS (SELECT v, la, lb, avg(d) d FROM d GROUP BY 1, 2, 3), s AS (SELECT v, max(CASE WHEN la = lb THEN d END) i, min(CASE WHEN la <> lb THEN d END) o FROM m GROUP BY 1) SELECT round(avg(CASE WHEN i IS NULL THEN 0 ELSE (o - i) / greatest(i, o) END), 6) AS silhouette, count(*) AS n FROM s WHERE o IS NOT NULL",
)
query("m5_gmm", lambda t: ml.gmm(whole(t), 3).select("vec_id", F.transform(F.array_sort("membership"), lambda x: F.round(x, 4)).alias("membership")))
query("m6_fuzzy_cmeans", lambda t: ml.fuzzy_cmeans(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 3).select("vec_id", F.transform(F.array_sort("membership"), lambda x: F.round(x, 4)).alias("membership")))
query(
    "m7_soft_metrics",
    lambda t: r6(longs(ml.soft_metrics(agg.cluster_props(t.fx_cells, "cluster", range(4)).select(F.array(*PARTS).alias("membership")), threshold=0.3), "k"), "mean_entropy", "max_entropy", "pct_confident"),
    "WITH p AS (SELECT scan_name, " + ", ".join(f"count(*) FILTER (cluster = {k}) / cast(count(*) AS double) c{k}" for k in range(4)) + " FROM fx_cells GROUP BY scan_name) SELECT cast(4 AS bigint) AS k, round(avg(-(" + " + ".join(f"CASE WHEN c{k} > 0 THEN c{k} * log2(c{k}) ELSE 0 END" for k in range(4)) + ")), 6) AS mean_entropy, 2.0::DOUBLE AS max_entropy, round(100 * avg(CASE WHEN greatest(c0, c1, c2, c3) > 0.3 THEN 1.0 ELSE 0.0 END), 6) AS pct_confident FROM p",
)
_CONT = "WITH {e}, d AS (SELECT a.vec_id a, b.vec_id b, {h} h, {l} l FROM e a, e b WHERE a.vec_id <> b.vec_id), r AS (SELECT row_number() OVER (PARTITION BY a ORDER BY h, b) h, row_number() OVER (PARTITION BY a ORDER BY l, b) l FROM d), n AS (SELECT count(*) n FROM e) SELECT round(1 - (SELECT sum(greatest(l - 10, 0)) FROM r WHERE h <= 10) / (10 * n * (2 * n - 31) / 2.0), 6) AS value, n FROM n"
query("m8_continuity", lambda t: r6(ml.continuity(t.embeddings, low(t), "vec_id", "embedding", 10, 300), "value"), _CONT.format(e=_E, h=_DIST.format("embedding"), l=_DIST.format("low")))
query("m9_trustworthiness", lambda t: r6(ml.trustworthiness(t.embeddings, low(t), "vec_id", "embedding", 10, 300), "value"), _CONT.format(e=_E, h=_DIST.format("low"), l=_DIST.format("embedding")))
query("m10_diverse_select", lambda t: r6(ml.diverse_select(t.embeddings, "vec_id", "embedding", 8), "score"))
query("m11_active_select", lambda t: r6(ml.active_select(t.embeddings.where("label <> 0"), t.embeddings.where("label = 0"), "vec_id", "embedding", 8), "score"))


# --- streams
def _landed(t: Tables) -> tuple[str, str]:
    """Cells as result files in the shared folder, and that folder: what a stream reads."""
    base = f"{_shared(t)}/landed-{uuid.uuid4().hex}"
    rows = flt.with_cell_id(t.fx_cells).select("cell_area", "image_name", "scan_name", "global_cell_id")
    rows.repartition("scan_name").write.option("header", True).csv(f"{base}/in")
    return base, "cell_area DOUBLE, image_name STRING, scan_name STRING, global_cell_id STRING"


def _stream_results(t: Tables) -> DataFrame:
    base, schema = _landed(t)
    for _ in range(2):  # the second run finds nothing new
        ingest.stream_results(ingest.read_stream(t.spark, f"{base}/in", schema), f"{base}/out", f"{base}/check").awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{base}/out").groupBy("scan_name").agg(F.count("*").alias("n_cells"))


def _stream_totals(t: Tables) -> DataFrame:
    base, schema = _landed(t)
    for _ in range(2):
        ingest.stream_scan_totals(ingest.read_stream(t.spark, f"{base}/in", schema, 10), f"{base}/out", f"{base}/check").awaitTermination()
    return r6(ingest.read_scan_totals(t.spark, f"{base}/out"), "mean_area")


query("sm1_stream_results", _stream_results, "SELECT scan_name, count(*) AS n_cells FROM fx_cells GROUP BY 1")
query("sm2_stream_scan_totals", _stream_totals, "SELECT scan_name, count(*) AS n_cells, round(avg(cell_area), 6) AS mean_area FROM fx_cells GROUP BY 1")

# --- folders: driver rows are landed in the form that a reader expects, then read
def _images(t: Tables, path: str, rows: DataFrame) -> DataFrame:
    """Rows (scan, class, …) as one file with an image's ending per scan and class."""
    rows.repartition("scan", "class").write.option("extension", "png").partitionBy("scan", "class").csv(path)
    return rows


def _inventory(t: Tables) -> DataFrame:
    path = new_path(t.spark, "images")
    cells = t.fx_cells.select("cell_id", F.col("scan_name").alias("scan"), F.col("cluster").alias("class"))
    _images(t, f"{path}/images", cells)
    _images(t, f"{path}/masks", cells.where("class < 2"))
    found = src.index_segmentations(t.spark, f"{path}/images")
    masks = src.index_segmentations(t.spark, f"{path}/masks").select("scan", "class", F.col("image_path").alias("mask"))
    rows = found.join(masks, ["scan", "class"], "left")  # file names are Spark's own here: they match by folder
    return rows.groupBy("scan", "class").agg(F.count("*").alias("n_files"), F.count("mask").alias("n_masks"))


_LANDED = "l AS (SELECT concat('scan=', scan_name) AS scan, concat('class=', cluster) AS class FROM fx_cells GROUP BY scan_name, cluster)"
query("s8_index_segmentations", _inventory, f"WITH {_LANDED} SELECT scan, class, cast(1 AS bigint) AS n_files, cast(CASE WHEN class IN ('class=0', 'class=1') THEN 1 ELSE 0 END AS bigint) AS n_masks FROM l")


def _collected(t: Tables) -> DataFrame:
    """Cells of each split in a folder of the split, a file per cluster."""
    path = new_path(t.spark, "splits")
    splits = stored(smp.split3(t.fx_cells, KEYS).select("cell_id", "split", "cluster"), "splits")
    for name in ("train", "val", "test", "other"):
        splits.where(F.col("split") == name).repartition("cluster").write.option("extension", "jpg").partitionBy("cluster").csv(f"{path}/{name}/images")
    return src.collect_images(t.spark, path).groupBy("split").agg(F.count("*").alias("n_images"))


query("s9_collect_images", _collected, f"WITH {_R(KEYS, 0)}, k AS (SELECT DISTINCT CASE WHEN rank < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rank < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split, cluster FROM r) SELECT split, count(*) AS n_images FROM k GROUP BY 1")


def _crops(t: Tables) -> DataFrame:
    path = new_path(t.spark, "crops")
    _images(t, path, t.fx_cells.select("cell_id", F.col("scan_name").alias("scan"), F.col("cluster").alias("class")))
    return src.index_crops(t.spark, path).select(F.regexp_extract("path", "/(scan=[^/]*)/", 1).alias("scan"), F.regexp_extract("path", "/(class=[^/]*)/", 1).alias("class"))


query("s10_index_crops", _crops, f"WITH {_LANDED} SELECT scan, class FROM l")
query("s12_class_names", lambda t: src.class_names(t.spark, [r[0] for r in t.fx_expert.select("cluster_annotation").distinct().orderBy("cluster_annotation").collect()]), "SELECT cast(row_number() OVER (ORDER BY name) - 1 AS integer) AS id, name FROM (SELECT DISTINCT cluster_annotation AS name FROM fx_expert)")


def _curve(t: Tables) -> DataFrame:
    """Metrics as learning-curve documents, one per variant, each with means of its portions and the runs behind them."""
    path = new_path(t.spark, "curve")
    runs = t.fx_metrics.groupBy("variant", "fold", "region").agg(F.avg("metric").alias("score"))
    means = runs.groupBy("variant", "fold").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    parts = means.groupBy("variant").agg(F.collect_list(F.struct("variant", "fold", "score", "n")).alias("averaged")).join(runs.groupBy("variant").agg(F.collect_list(F.struct("variant", "fold", "region", "score")).alias("raw")), "variant")
    parts.select(F.to_json(F.struct("averaged", "raw")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    averaged, raw = src.read_learning_curve(t.spark, path)
    return r6(averaged.join(raw.groupBy("variant", "fold").agg(F.max("score").alias("best")), ["variant", "fold"]).select("variant", "fold", "score", "n", "best"), "score", "best")


query("s14_learning_curve", _curve, "WITH r AS (SELECT variant, fold, region, avg(metric) AS score FROM fx_metrics GROUP BY 1, 2, 3) SELECT variant, fold, round(avg(score), 6) AS score, count(*) AS n, round(max(score), 6) AS best FROM r GROUP BY 1, 2")


def _coco_documents(t: Tables) -> DataFrame:
    """Cells as COCO documents of some thousand annotations of a scan, read back as three tables and joined again."""
    path = new_path(t.spark, "documents")
    cells = t.fx_cells.where("cluster IS NOT NULL")
    parts = cells.count() // (48 * 4000) + 1
    image = F.xxhash64(*IMAGE)
    box = F.array(*(c.cast("double") for c in (F.col("xmin"), F.col("ymin"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))))
    note = F.struct(F.col("cell_id").alias("id"), image.alias("image_id"), F.col("cluster").cast("int").alias("category_id"), F.lit("[]").alias("segmentation"), F.col("cell_area").cast("double").alias("area"), box.alias("bbox"), F.lit(0).alias("iscrowd"))
    picture = F.struct(image.alias("id"), F.concat_ws("/", *IMAGE).alias("file_name"), F.lit(512).alias("width"), F.lit(512).alias("height"))
    category = F.struct(F.col("cluster").cast("int").alias("id"), F.element_at(F.array(*map(F.lit, coco.CLASSES)), F.col("cluster").cast("int") + 1).alias("name"), F.lit("cell").alias("supercategory"))
    groups = cells.groupBy("scan_name", F.pmod(F.xxhash64("image_name"), F.lit(parts))).agg(F.collect_list(note).alias("annotations"), F.collect_set(picture).alias("images"), F.collect_set(category).alias("categories"))
    groups.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    images, annotations, categories = coco.read_coco(t.spark, path)
    rows = annotations.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").join(F.broadcast(categories.select(F.col("id").alias("category_id"), "name").distinct()), "category_id")  # a row per class
    return rows.select(F.col("id").alias("cell_id"), "file_name", "name", F.element_at("bbox", 3).alias("width"))


query("s5_read_coco", _coco_documents, "SELECT cell_id, concat(scan_name, '/', image_name) AS file_name, list_extract(['MG_whole', 'MG_cell_body', 'Cluster', 'Unclassified', 'Dirt', 'microglia'], cast(cluster AS int) + 1) AS name, cast(xmax - xmin AS double) AS width FROM fx_cells WHERE cluster IS NOT NULL")


def _yolo_folders(t: Tables) -> DataFrame:
    """A label dataset written by write_yolo_dataset, a folder per image, and read by read_yolo_labels."""
    path = new_path(t.spark, "yolo")
    boxes = geo.xyxy_to_yolo(t.fx_cells, 512, 512).withColumns({"cls": F.col("cluster"), "image_name": F.col("image_name")})
    manifest = src.write_yolo_dataset(boxes.select("image_name", "cls", "cx", "cy", "w", "h"), path)
    labels = src.read_yolo_labels(t.spark, f"{path}/labels", lambda file: F.regexp_extract(file, "image_name=([^/]*)/", 1))
    found = stored(labels.groupBy("image_name").agg(F.count("*").alias("n"), F.round(F.sum("cx"), 6).alias("cx")), "found")  # lines are parsed once
    images = manifest.select(F.substring("value", 8, 1000).alias("image_name"))
    return found.join(images, "image_name").join(found.agg(F.sum("n").alias("n_lines")), F.lit(True))


query("s4_write_yolo_dataset", _yolo_folders, "SELECT image_name, count(*) AS n, round(sum(cast(printf('%.6f', (xmin + xmax) / 2.0 / 512) AS double)), 6) AS cx, (SELECT count(*) FROM fx_cells) AS n_lines FROM fx_cells GROUP BY 1")
query("s15_topic_counts", lambda t: src.topic_counts(src.artifacts_by_tile(t.orders.select(F.concat(F.lit("out/t"), F.floor(F.col("o_orderkey") / 3).cast("string"), F.element_at(F.array(F.lit("_mask.png"), F.lit(".csv"), F.lit(".none")), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("path")), {"_mask.png": "mask", ".csv": "table"})), "SELECT count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 3 END) AS mask, count(DISTINCT CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey // 3 END) AS \"table\" FROM orders")

# --- feature choice, similarity, user code
_COLS = ["cell_area", "area_twice", "skeleton_length", "minus_length", "cell_solidity", "cell_circularity"]
derived = lambda df: df.withColumns({"area_twice": F.col("cell_area") * 2 + 1, "minus_length": -F.col("skeleton_length")})


def _kept(t: Tables, kept: list[str], dropped: list[str]) -> DataFrame:
    return t.spark.createDataFrame([(c, True) for c in kept] + [(c, False) for c in dropped], "feature string, kept boolean")


# Groups of columns that all correlate: the first in order stays.
_CHOICE = "d AS (SELECT scan_name, {area} AS cell_area, {area} * 2 + 1 AS area_twice, {length} AS skeleton_length, -{length} AS minus_length, {solidity} AS cell_solidity, {circ} AS cell_circularity FROM {frm}), l AS (SELECT scan_name, feature, v FROM d UNPIVOT (v FOR feature IN (cell_area, area_twice, skeleton_length, minus_length, cell_solidity, cell_circularity))), p AS (SELECT a.feature AS fa, b.feature AS fb, a.v AS x, b.v AS y FROM l a JOIN l b USING (scan_name)), k AS (SELECT fa, fb, rank() OVER (PARTITION BY fa, fb ORDER BY x) + (count(*) OVER (PARTITION BY fa, fb, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY fa, fb ORDER BY y) + (count(*) OVER (PARTITION BY fa, fb, y) - 1) / 2.0 AS y FROM p), c AS (SELECT fa, fb, abs(corr(x, y)) AS r FROM k GROUP BY 1, 2), o AS (SELECT unnest(['cell_area', 'area_twice', 'skeleton_length', 'minus_length', 'cell_solidity', 'cell_circularity']) AS feature, unnest(range(6)) AS place) SELECT feature, NOT EXISTS (SELECT 1 FROM c JOIN o q ON q.feature = fb WHERE fa = o.feature AND q.place < o.place AND r >= 0.7) AS kept FROM o"
query("t2_representatives", lambda t: _kept(t, *st.representatives(derived(scan_table(t)), _COLS)), f"WITH {SCAN_SQL}, {_CHOICE.format(area='cell_area', length='skeleton_length', solidity='cell_solidity', circ='cell_circularity', frm='s')}")
query("t3_choose_features", lambda t: _kept(t, *st.choose_features(derived(t.fx_cells).withColumns({"three": F.lit(3), "name": F.lit("x")}), ["three", "name", "absent", *_COLS])), f"WITH {SCAN_SQL}, {_CHOICE.format(area='cell_area', length='skeleton_length', solidity='cell_solidity', circ='cell_circularity', frm='s')}")
query(
    "k20_morphology_similarity",
    lambda t: r6(px.morphology_similarity(moved(t).where("cell_id % 5 > 0"), t.fx_cells, WEIGHTS(t), ["skeleton_length", "cell_area", "cell_circularity"], CELL), "score"),
    f"WITH {SCORE_SQL} SELECT {CELL_SQL}, CASE WHEN cell_id % 5 > 0 THEN round(sum(w * (1 - error)) / sum(w), 6) ELSE 0 END AS score FROM e GROUP BY 1, 2, 3",
)
query("x11_tile_name", lambda t: t.fx_cells.select("cell_id", tx.tile_name(F.col("xmin").cast("int"), F.col("ymin").cast("int"), F.when(F.col("cluster") == 0, "gray").otherwise("white")).alias("name")), "SELECT cell_id, concat('tile_x', xmin, '_y', ymin, CASE WHEN cluster = 0 THEN '_gray' ELSE '_white' END, '_matter.jpg') AS name FROM fx_cells")
query("p14_drop_unusable", lambda t: flt.drop_unusable(t.fx_cells.select("cell_id", "cell_area", F.lit(3).alias("three"), F.lit(None).cast("double").alias("none")), ["cell_area", "three", "none"]), "SELECT cell_id, cell_area FROM fx_cells")
query("p5_confidence_queue", lambda t: cohort.confidence_queue(t.fx_cells).select(*CELL, "conf", "n_boxes"), f"WITH i AS (SELECT DISTINCT scan_name, image_name FROM fx_cells WHERE conf > 0.45 AND conf < 0.55 ORDER BY 1, 2 LIMIT 100) SELECT {CELL_SQL}, conf, count(*) OVER (PARTITION BY scan_name, image_name) AS n_boxes FROM fx_cells SEMI JOIN i USING (scan_name, image_name) WHERE conf > 0.45")
_SQUARE = "list_sum(list_transform(list_zip(cast({0} AS double[]), {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
query(
    "ud4_score_tiles",
    lambda t: r6(hooks.score_tiles(t.embeddings.select("vec_id", "embedding"), hooks.fit_centroids(t.embeddings, "label", "embedding"), ["embedding"], "predicted long, distance double").select("vec_id", "predicted", "distance", F.col("error").isNotNull().alias("failed")), "distance"),
    f"WITH c AS (SELECT label, list(m ORDER BY j) AS m FROM (SELECT label, j, avg(cast(embedding[j] AS double)) AS m FROM embeddings, range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) r(j) WHERE embedding IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2) GROUP BY 1), d AS (SELECT vec_id, arg_min(label, d) AS predicted, min(d) AS distance FROM (SELECT vec_id, label, {_SQUARE.format('embedding', 'm')} AS d FROM (SELECT vec_id, embedding FROM embeddings) e, c) GROUP BY 1) SELECT vec_id, cast(predicted AS bigint) AS predicted, round(distance, 6) AS distance, distance IS NULL AS failed FROM d",
)
query("ud5_expand_runs", lambda t: longs(hooks.expand_runs(px.rle_encode(t.fx_pixels, 64, 64), 64, ["cell_id"]), "y", "x"), "SELECT cell_id, y, x FROM fx_pixels")
query(
    "m9_embedding_f1",
    lambda t: r6(ml.embedding_f1(t.embeddings, low(t), "vec_id", "embedding", 10, 300), "continuity", "trustworthiness", "f1"),
    f"WITH a AS ({_CONT.format(e=_E, h=_DIST.format('embedding'), l=_DIST.format('low'))}), b AS ({_CONT.format(e=_E, h=_DIST.format('low'), l=_DIST.format('embedding'))}), v AS (SELECT (SELECT value FROM a) AS c, (SELECT value FROM b) AS t) SELECT c AS continuity, t AS trustworthiness, round(2 * c * t / (c + t), 6) AS f1 FROM v",
)

# --- a mask of a whole slide: places scattered over many tiles, and bars that cross them
_DOTS = "SELECT cast(1 AS bigint) AS slide, (l_partkey * 7919 + l_linenumber * 104729) % 4096 AS y, (l_suppkey * 15485863 + l_orderkey * 31) % 4096 AS x FROM lineitem"


def slides(t: Tables) -> DataFrame:
    return t.spark.sql(_DOTS.replace("FROM lineitem", "FROM {l}"), l=t.lineitem).distinct().unionByName(t.spark.sql("SELECT cast(2 AS bigint) AS slide, p_partkey * 3 AS y, x FROM {p} LATERAL VIEW explode(sequence(0L, 599L + p_size * 17)) AS x WHERE p_partkey % 7 > 0", p=dealt(t.part, "p_partkey")))


_BARS = "SELECT cast(2 AS bigint) AS slide, p_partkey * 3 AS y, cast(0 AS bigint) AS x, cast(600 + p_size * 17 AS bigint) AS n FROM part WHERE p_partkey % 7 > 0"
query(
    "k12_slide_components",
    lambda t: px.slide_components(slides(t)).groupBy("slide", "cy", "cx").agg(F.count("*").alias("n")),
    f"WITH RECURSIVE d AS MATERIALIZED (SELECT DISTINCT slide, y, x FROM ({_DOTS})), near AS MATERIALIZED (SELECT a.y, a.x, b.y AS ny, b.x AS nx FROM d a, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx), d b WHERE b.y = a.y + dy AND b.x = a.x + dx AND (dy <> 0 OR dx <> 0)), r(y, x, ry, rx) AS (SELECT y, x, y, x FROM d UNION SELECT near.ny, near.nx, ry, rx FROM r JOIN near USING (y, x)), f AS (SELECT y, x, min(ry * 4096 + rx) AS first FROM r GROUP BY 1, 2) SELECT cast(1 AS bigint) AS slide, cast(first // 4096 AS bigint) AS cy, cast(first % 4096 AS bigint) AS cx, count(*) AS n FROM f GROUP BY first UNION ALL {_BARS.replace('AS y', 'AS cy').replace('AS x', 'AS cx')}",
)


# --- SQL of queries above whose rows follow from the fixtures' making: of each part but every eleventh a disc of radius r around (32, 32),
# an upright line of half length v, and for even parts a level one of half length h
def oracle(name: str, sql: str) -> None:
    ORACLE_SQL[name] = with_views(" ".join(sql.split()))


_CROSS = "pp AS (SELECT p_partkey AS cell_id, p_partkey % 2 = 0 AS even, cast(3 + p_size % 6 AS bigint) AS r, cast(8 + p_size % 20 AS bigint) AS v, cast(6 + p_size % 18 AS bigint) AS h FROM part WHERE p_partkey % 11 > 0), q AS (SELECT cell_id, even, r, greatest(v - r, 0) AS lv, CASE WHEN even THEN greatest(h - r, 0) ELSE 0 END AS lh, greatest(v, r) AS tv, CASE WHEN even THEN greatest(h, r) ELSE r END AS th FROM pp)"
# A row's half width; from row to row a border goes straight, or aslant and then along the wider row.
_RINGS = "w AS (SELECT r, y, floor(sqrt(r * r - y * y)) AS w FROM range(3, 9) a(r), range(-8, 9) b(y) WHERE abs(y) <= r), disc AS (SELECT r, cast(sum(2 * w + 1) AS bigint) AS area FROM w GROUP BY 1), ring AS (SELECT a.r, 2 * sum(CASE WHEN a.w = b.w THEN 1 ELSE sqrt(2) + abs(a.w - b.w) - 1 END) AS length FROM w a JOIN w b ON a.r = b.r AND b.y = a.y + 1 GROUP BY 1)"
# Hull edges: pairs with all points on one side and none beyond on their line.
_HULL = "sh AS (SELECT DISTINCT r, tv, th FROM q), pts AS (SELECT r, tv, th, y, cast(k * w AS bigint) AS x FROM sh JOIN w USING (r), (VALUES (-1), (1)) s(k) UNION SELECT r, tv, th, k * tv, 0 FROM sh, (VALUES (-1), (1)) s(k) UNION SELECT r, tv, th, 0, k * th FROM sh, (VALUES (-1), (1)) s(k)), tri AS (SELECT a.r, a.tv, a.th, a.y AS ay, a.x AS ax, b.y AS ey, b.x AS ex, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS low, max(CASE WHEN (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0) THEN 1 ELSE 0 END) AS beyond FROM pts a JOIN pts b USING (r, tv, th) JOIN pts c USING (r, tv, th) WHERE a.x <> b.x OR a.y <> b.y GROUP BY ALL), hull AS (SELECT r, tv, th, abs(sum(ax * ey - ex * ay)) / 2.0 AS hull_area, sum(sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay))) AS hull_length FROM tri WHERE low >= 0 AND beyond = 0 GROUP BY 1, 2, 3)"
oracle("k4_skeletonize", f"WITH {_CROSS} SELECT cell_id, cast(32 + d AS bigint) AS y, cast(32 AS bigint) AS x FROM q, range(-32, 33) t(d) WHERE abs(d) <= tv UNION ALL SELECT cell_id, cast(32 AS bigint) AS y, cast(32 + d AS bigint) AS x FROM q, range(-32, 33) t(d) WHERE even AND abs(d) <= th AND d <> 0")
oracle("k6_junctions", f"WITH {_CROSS} SELECT cell_id, cast(1 AS bigint) AS num_junctions FROM q WHERE even")
oracle("k9_perimeter", f"WITH {_CROSS}, {_RINGS} SELECT cell_id, round(length, 6) AS perimeter FROM q JOIN ring USING (r)")
oracle("k10_convex_hull", f"WITH {_CROSS}, {_RINGS}, {_HULL} SELECT cell_id, round(hull_area, 6) AS hull_area, round(hull_length, 6) AS hull_perimeter FROM q JOIN hull USING (r, tv, th)")
_ARMS_N = "2 * cast(lv > 0 AS bigint) + 2 * cast(lh > 0 AS bigint)"
oracle("k12_component_count", f"WITH {_CROSS} SELECT cell_id, {_ARMS_N} AS n_components FROM q WHERE lv + lh > 0")
for _name in ("k13_largest_component", "k14_clean_masks"):
    oracle(_name, f"WITH {_CROSS} SELECT cell_id, greatest(lv, lh) AS area FROM q WHERE lv + lh > 0")
oracle("k21_betti", f"WITH {_CROSS} SELECT cell_id, cast(1 AS bigint) AS b0, cast(0 AS bigint) AS b1 FROM q")
oracle("k21_betti_diff", f"WITH {_CROSS} SELECT cell_id, cast(abs(1 - ({_ARMS_N})) AS double) AS betti_loss FROM q")
oracle("k23_fill_holes", f"WITH {_CROSS} SELECT cell_id, 2 * lv + 2 * lh AS area FROM q WHERE lv + lh > 0")
_NODES = "2 * cast(lv > 1 AS bigint) + 2 * cast(lh > 1 AS bigint)"
_DIV = lambda a, b: f"round(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END, 6)"
oracle(
    "k16_morphology",
    f"WITH {_CROSS}, {_RINGS}, {_HULL}, m AS (SELECT cell_id, 2 * lv + 2 * lh AS arms, {_ARMS_N} AS n, {_NODES} AS nodes, disc.area AS soma, length AS soma_p, disc.area + 2 * lv + 2 * lh AS cell, length + 4 * lv + 4 * lh AS cell_p, hull_area, hull_length, 4 * greatest(lv - 1, 0) + 4 * greatest(lh - 1, 0) AS branch_p, CASE WHEN lv + lh > 0 THEN r + 1 ELSE 0 END AS near, CASE WHEN lv + lh > 0 THEN r + greatest(lv, lh) ELSE 0 END AS far FROM q JOIN disc USING (r) JOIN ring USING (r) JOIN hull USING (r, tv, th)), "
    "z AS (SELECT p_partkey AS cell_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in "arms n nodes soma soma_p cell cell_p hull_area hull_length branch_p near far".split()) + " FROM part LEFT JOIN m ON p_partkey = cell_id) "
    "SELECT cell_id, arms AS skeleton_length, cast(0 AS bigint) AS num_junctions, n AS num_components, nodes AS num_end_nodes, nodes AS num_start_nodes, soma AS soma_area, round(soma_p, 6) AS soma_perimeter, cell AS cell_area, round(cell_p, 6) AS cell_perimeter, round(hull_area, 6) AS cell_convex_hull_area, round(hull_length, 6) AS cell_convex_hull_perimeter, "
    "arms AS branch_area, cast(branch_p AS double) AS branch_perimeter, near AS sholl_min_radius, near AS sholl_peak_radius, far AS sholl_max_radius, n AS sholl_peak, arms AS sholl_sum, "
    f"{_DIV('nodes', 'nodes')} AS end_to_start_ratio, 2 * nodes AS total_nodes, {_DIV('4 * pi() * soma', '(soma_p * soma_p)')} AS soma_circularity, {_DIV('cell', 'hull_area')} AS cell_solidity, {_DIV('hull_length', 'cell_p')} AS cell_convexity, {_DIV('4 * pi() * cell', '(cell_p * cell_p)')} AS cell_circularity, {_DIV('4 * pi() * hull_area', '(hull_length * hull_length)')} AS cell_convex_circularity FROM z",
)
oracle(
    "k19_evaluate_regions",
    "WITH j AS (SELECT cell_id, y, x, max(p) AS p, max(t) AS t, max(s) AS s FROM (SELECT cell_id, y, x + 1 AS x, 1.0 AS p, 0.0 AS t, 0.0 AS s FROM fx_pixels UNION ALL SELECT cell_id, y, x, 0, 1, 0 FROM fx_pixels UNION ALL SELECT cell_id, y, x, 0, 0, 1 FROM fx_soma) GROUP BY 1, 2, 3), "
    "m AS (SELECT cell_id, cast(sum(p * t) AS double) AS pt, cast(sum(p) AS double) AS ps, cast(sum(t) AS double) AS ts, cast(sum(s) AS double) AS ss, cast(sum(p * s) AS double) AS sp, cast(sum(t * (1 - s)) AS double) AS bt, cast(sum(p * (1 - s)) AS double) AS bp, cast(sum(p * (1 - s) * t * (1 - s)) AS double) AS b FROM j GROUP BY 1) "
    "SELECT cell_id, 'overall' AS region, round((2 * pt + 1e-6) / (ps + ts + 1e-6), 6) AS dice, round((pt + 1e-6) / (ps + ts - pt + 1e-6), 6) AS iou, round((pt + 1e-6) / (ps + 1e-6), 6) AS precision, round((pt + 1e-6) / (ts + 1e-6), 6) AS recall, cast(ts AS bigint) AS pixels FROM m "
    "UNION ALL SELECT cell_id, 'soma', round(sp / ss, 6), round(sp / ss, 6), round(sp / ss, 6), round(sp / ss, 6), cast(ss AS bigint) FROM m WHERE ss > 0 "
    "UNION ALL SELECT cell_id, 'branches', round((2 * b + 1e-6) / (bp + bt + 1e-6), 6), round((b + 1e-6) / (bp + bt - b + 1e-6), 6), round((b + 1e-6) / (bp + 1e-6), 6), round((b + 1e-6) / (bt + 1e-6), 6), cast(bt AS bigint) FROM m WHERE bt > 0",
)
_NEAR = "(VALUES (-1), (0), (1)) dy(a), (VALUES (-1), (0), (1)) dx(b)"
oracle(
    "k22_otsu_mask",
    "WITH g AS MATERIALIZED (SELECT cell_id, p.y, p.x, CASE WHEN s.cell_id IS NULL THEN 255 ELSE (p.x * 7 + p.y * 3) % 200 END AS g FROM fx_pixels p LEFT JOIN fx_soma s USING (cell_id, y, x)), h AS (SELECT cell_id, g, count(*) n FROM g GROUP BY 1, 2), c AS (SELECT cell_id, g, cast(sum(n) OVER a AS double) w0, cast(sum(n * g) OVER a AS double) s0, cast(sum(n) OVER (PARTITION BY cell_id) AS double) w, cast(sum(n * g) OVER (PARTITION BY cell_id) AS double) s FROM h WINDOW a AS (PARTITION BY cell_id ORDER BY g)), "
    "b AS (SELECT cell_id, g, CASE WHEN w > w0 THEN w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)) ELSE 0 END b FROM c), t AS (SELECT cell_id, g AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY b DESC, g) k FROM b) WHERE k = 1), dark AS (SELECT cell_id, y, x FROM g JOIN t USING (cell_id) WHERE g <= threshold), "
    f"eroded AS (SELECT cell_id, y + a AS y, x + b AS x FROM dark, {_NEAR} GROUP BY 1, 2, 3 HAVING count(*) = 9), opened AS (SELECT DISTINCT cell_id, y + a AS y, x + b AS x FROM eroded, {_NEAR}) SELECT cell_id, count(*) AS area FROM opened SEMI JOIN fx_soma USING (cell_id, y, x) GROUP BY 1",
)
_HIT = lambda ax, ay, bx, by: f"CASE WHEN ({ay} > j + 0.5) <> ({by} > j + 0.5) AND i + 0.5 < ({bx} - {ax}) * (j + 0.5 - {ay}) / cast(nullif({by} - {ay}, 0) AS double) + {ax} THEN 1 ELSE 0 END"
oracle("k24_rasterize", f"WITH c AS (SELECT region_id, x0 % 47 AS ax, y0 % 37 AS ay, x1 % 47 AS bx, y0 % 37 AS bb, x1 % 47 AS cx, y1 % 37 AS cc FROM fx_regions) SELECT region_id, count(*) AS area FROM c, range(47) s(i), range(37) t(j) WHERE ({_HIT('ax', 'ay', 'bx', 'bb')} + {_HIT('bx', 'bb', 'cx', 'cc')} + {_HIT('cx', 'cc', 'ax', 'ay')}) % 2 = 1 GROUP BY 1")
# Fifteen rounds reach all that is connected here.
oracle("k25_grow", f"WITH RECURSIVE p AS MATERIALIZED (SELECT cell_id, y, x, (x * 13 + y * 29) % 100 / 100.0::DOUBLE AS p FROM fx_pixels), r(cell_id, y, x) AS (SELECT cell_id, y, x FROM p WHERE p > 0.5 UNION SELECT n.cell_id, n.y, n.x FROM (SELECT cell_id, y + a AS y, x + b AS x FROM r, {_NEAR}) n JOIN p ON n.cell_id = p.cell_id AND n.y = p.y AND n.x = p.x WHERE p > 0.17) SELECT cell_id, count(*) AS area FROM r GROUP BY 1")

# Pairs of an image and class in order; a row of the recursion is a group's state after its next pair.
_WALK = (
    "p AS (SELECT scan_name, image_name, cell_id AS pred_id, cell_id % 3 AS cls, conf, xmin + cell_id % 4 AS a, ymin + cell_id % 4 AS b, xmax + cell_id % 4 AS c, ymax + cell_id % 4 AS d FROM fx_cells), g AS (SELECT scan_name, image_name, cell_id AS true_id, cell_id % 3 AS cls, xmin, ymin, xmax, ymax FROM fx_cells WHERE cluster < 3), "
    "o AS (SELECT scan_name, image_name, cls, pred_id, true_id, conf, cast(greatest(least(c, xmax) - greatest(a, xmin), 0) AS double) * greatest(least(d, ymax) - greatest(b, ymin), 0) AS i, (c - a) * (d - b) + (xmax - xmin) * (ymax - ymin) AS u FROM p JOIN g USING (scan_name, image_name, cls)), "
    "pairs AS MATERIALIZED (SELECT scan_name, image_name, cls, pred_id, true_id, i / (u - i) AS iou, row_number() OVER (PARTITION BY scan_name, image_name, cls ORDER BY conf DESC, pred_id, i / (u - i) DESC, true_id) AS k FROM o WHERE u > i AND i / (u - i) > 0.5 - 1e-12), th AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS t FROM range(10) s(i)), "
    "r AS (SELECT scan_name, image_name, cls, t, cast(0 AS bigint) AS k, cast([] AS bigint[]) AS up, cast([] AS bigint[]) AS ut FROM (SELECT DISTINCT scan_name, image_name, cls FROM pairs), th UNION ALL SELECT r.scan_name, r.image_name, r.cls, t, q.k, CASE WHEN iou >= t AND NOT list_contains(up, pred_id) AND NOT list_contains(ut, true_id) THEN list_append(up, pred_id) ELSE up END, CASE WHEN iou >= t AND NOT list_contains(up, pred_id) AND NOT list_contains(ut, true_id) THEN list_append(ut, true_id) ELSE ut END FROM r JOIN pairs q ON r.scan_name = q.scan_name AND r.image_name = q.image_name AND r.cls = q.cls AND q.k = r.k + 1), "
    "hits AS (SELECT scan_name, image_name, cls, t, unnest(arg_max(up, k)) AS pred_id FROM r GROUP BY 1, 2, 3, 4), e AS MATERIALIZED (SELECT p.cls, th.t, p.pred_id, p.conf, CASE WHEN h.pred_id IS NULL THEN 0 ELSE 1 END AS tp FROM p CROSS JOIN th LEFT JOIN hits h ON h.scan_name = p.scan_name AND h.image_name = p.image_name AND h.cls = p.cls AND h.pred_id = p.pred_id AND h.t = th.t), n AS (SELECT cls, count(*) AS n FROM g GROUP BY 1)"
)
_AP = (
    f"{_WALK}, s AS (SELECT cls, t, conf, sum(tp) AS tp, count(*) AS c FROM e GROUP BY 1, 2, 3), c AS (SELECT *, cast(sum(tp) OVER d AS double) / sum(c) OVER d AS precision FROM s WINDOW d AS (PARTITION BY cls, t ORDER BY conf DESC)), b AS (SELECT *, max(precision) OVER (PARTITION BY cls, t ORDER BY conf) AS best FROM c), "
    "ap AS (SELECT n.cls, th.t, coalesce(sum(best * tp), 0) / n.n AS ap FROM n CROSS JOIN th LEFT JOIN b ON b.cls = n.cls AND b.t = th.t GROUP BY 1, 2, n.n)"
)
oracle("d2_match_boxes", f"WITH RECURSIVE {_WALK} SELECT cls, t AS threshold, cast(sum(tp) AS bigint) AS tp, count(*) AS n FROM e GROUP BY 1, 2")
oracle("d3_average_precision", f"WITH RECURSIVE {_AP} SELECT cls, t AS threshold, round(ap, 6) AS ap FROM ap")
oracle("d3_mean_average_precision", f"WITH RECURSIVE {_AP}, f AS (SELECT cls, max(CASE WHEN t = 0.5 THEN ap END) AS a, avg(ap) AS m FROM ap GROUP BY 1) SELECT cls, round(a, 6) AS ap50, round(m, 6) AS ap50_95 FROM f UNION ALL SELECT NULL, round(avg(a), 6), round(avg(m), 6) FROM f")
oracle("d4_precision_recall_at", f"WITH RECURSIVE {_WALK}, s AS (SELECT cls, t, cast(sum(tp) AS double) AS tp, count(*) AS c FROM e WHERE conf > 0.5 GROUP BY 1, 2) SELECT n.cls, th.t AS threshold, round(tp / c, 6) AS precision, round(coalesce(tp, 0) / n.n, 6) AS recall FROM n CROSS JOIN th LEFT JOIN s ON s.cls = n.cls AND s.t = th.t")

_FAR = "sqrt(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _picks(first: str, n: int) -> str:
    """CTEs of farthest points in turn: d1 (vec_id, v, d), picks p1 to pn."""
    out = [first]
    for k in range(1, n + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT vec_id, v, d FROM d{k} ORDER BY d DESC, vec_id LIMIT 1)")
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT e.vec_id, e.v, {'least(e.d, ' if k > 1 or 'known' in first else '('}{_FAR.format('e.v', 'p.v')}) AS d FROM d{k} e, p{k} p WHERE e.vec_id <> p.vec_id)")
    return f"{', '.join(out[:-1])} " + " UNION ALL ".join(f"SELECT vec_id, {k} AS rank, round(d, 6) AS score FROM p{k}" for k in range(1, n + 1))


_VEC = "e AS MATERIALIZED (SELECT vec_id, label, cast(embedding AS double[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
oracle("m10_diverse_select", f"WITH {_VEC}, m AS (SELECT list(a ORDER BY j) AS c FROM (SELECT j, avg(v[j]) AS a FROM e, range(1, (SELECT max(len(v)) + 1 FROM e)) r(j) GROUP BY 1)), " + _picks(f"d1 AS MATERIALIZED (SELECT vec_id, v, {_FAR.format('v', 'c')} AS d FROM e, m)", 8))
oracle("m11_active_select", f"WITH {_VEC}, " + _picks(f"known AS (SELECT v AS w FROM e WHERE label = 0), d1 AS MATERIALIZED (SELECT vec_id, v, min({_FAR.format('v', 'w')}) AS d FROM e, known WHERE label <> 0 GROUP BY 1, 2)", 8))

# --- results that SQL can't give, by what holds of them
query("m1_pca_axes", lambda t: ml.pca_of(whole(t))[0].agg(F.count("*").alias("n"), (F.abs(F.corr(F.col("pc")[0], F.col("pc")[1])) < 1e-6).alias("apart"), (F.var_pop(F.col("pc")[0]) >= F.var_pop(F.col("pc")[1])).alias("in_order")), "SELECT count(*) AS n, true AS apart, true AS in_order FROM embeddings WHERE embedding IS NOT NULL")
_shares = lambda df: df.agg(F.count("*").alias("n"), F.count_if((F.abs(F.aggregate("membership", F.lit(0.0), lambda s, p: s + p) - 1) < 1e-6) & (F.array_min("membership") >= 0) & (F.size("membership") == 3)).alias("n_shares"))
query("m5_gmm_shares", lambda t: _shares(ml.gmm(whole(t), 3)), "SELECT count(*) AS n, count(*) AS n_shares FROM embeddings WHERE embedding IS NOT NULL")
query("m6_fuzzy_shares", lambda t: _shares(ml.fuzzy_cmeans(t.embeddings.select("vec_id", "embedding"), "vec_id", "embedding", 3)), "SELECT count(*) AS n, count(*) AS n_shares FROM embeddings WHERE embedding IS NOT NULL")


def _covered(t: Tables) -> DataFrame:
    """Boxes, and those that no patch holds: a patch's cells of 512 meet the cell of a box's corner."""
    patches = sp.patches_for(t.fx_cells, 1, 2048, 2048).select("px", "py", F.explode(F.sequence(F.floor(F.col("px") / 512), F.floor((F.col("px") + 512) / 512))).alias("gx"), F.sequence(F.floor(F.col("py") / 512), F.floor((F.col("py") + 512) / 512)).alias("gys")).select("px", "py", "gx", F.explode("gys").alias("gy"))
    boxes = t.fx_cells.select(*BOX).distinct().withColumns({"gx": F.floor(F.col("xmin") / 512), "gy": F.floor(F.col("ymin") / 512)})
    inside = (boxes["gx"] == patches["gx"]) & (boxes["gy"] == patches["gy"]) & (F.col("px") <= F.col("xmin")) & (F.col("py") <= F.col("ymin")) & (F.col("xmax") <= F.col("px") + 512) & (F.col("ymax") <= F.col("py") + 512)
    return boxes.agg(F.count("*").alias("n_boxes")).join(boxes.join(patches, inside, "left_anti").agg(F.count("*").alias("uncovered")), F.lit(True))


query("g9_patches_cover", _covered, "SELECT count(*) AS n_boxes, cast(0 AS bigint) AS uncovered FROM (SELECT DISTINCT xmin, ymin, xmax, ymax FROM fx_cells)")

_FIT = ["coef", "se", "t_stat", "ci_low", "ci_high"]
query(
    "t4_contrast_estimates",
    lambda t: r6(st.group_contrast(scan_table(t), FEATURES, ["age_at_death", "sex"], "AD", "100+"), *_FIT).select("feature", *_FIT, "n"),
    # The group's coefficient is the slope of residuals on residuals, both after age and sex.
    f"WITH {SCAN_SQL}, l AS (SELECT feature, y, CASE WHEN diagnosis_group = 'AD' THEN 1.0::DOUBLE ELSE 0 END AS g, cast(age_at_death AS double) AS a, CASE WHEN sex = 'M' THEN 1.0::DOUBLE ELSE 0 END AS x FROM (SELECT scan_name, diagnosis_group, age_at_death, sex, cast(skeleton_length AS double) AS skeleton_length, cast(cell_area AS double) AS cell_area, cast(cell_solidity AS double) AS cell_solidity, cast(cell_circularity AS double) AS cell_circularity FROM s) UNPIVOT (y FOR feature IN (skeleton_length, cell_area, cell_solidity, cell_circularity)) WHERE age_at_death IS NOT NULL AND sex IS NOT NULL), "
    "c AS (SELECT feature, y - avg(y) OVER w AS y, g - avg(g) OVER w AS g, a - avg(a) OVER w AS a, x - avg(x) OVER w AS x FROM l WINDOW w AS (PARTITION BY feature)), m AS (SELECT feature, sum(a * a) AS aa, sum(x * x) AS xx, sum(a * x) AS ax, sum(g * a) AS ga, sum(g * x) AS gx, sum(y * a) AS ya, sum(y * x) AS yx FROM c GROUP BY 1), "
    "r AS (SELECT feature, g - (ga * xx - gx * ax) / (aa * xx - ax * ax) * a - (gx * aa - ga * ax) / (aa * xx - ax * ax) * x AS g, y - (ya * xx - yx * ax) / (aa * xx - ax * ax) * a - (yx * aa - ya * ax) / (aa * xx - ax * ax) * x AS y FROM c JOIN m USING (feature)), "
    "b AS (SELECT feature, sum(g * y) / sum(g * g) AS coef, sqrt((sum(y * y) - sum(g * y) * sum(g * y) / sum(g * g)) / (count(*) - 4) / sum(g * g)) AS se, count(*) AS n FROM r GROUP BY 1) SELECT feature, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 6) AS t_stat, round(coef - 1.96 * se, 6) AS ci_low, round(coef + 1.96 * se, 6) AS ci_high, n FROM b",
)
# At the maximum the fitted means of the logs are those of the rows; here that the parts' means and variances follow from alpha.
query(
    "t6_dirichlet_moments",
    lambda t: st.dirichlet_groups(props(t), PARTS).select("diagnosis_group", "cluster", "n", (F.abs(F.col("mean") - F.col("alpha") / F.col("concentration")) < 1e-9).alias("mean_holds"), (F.abs(F.col("variance") - F.col("mean") * (1 - F.col("mean")) / (F.col("concentration") + 1)) < 1e-9).alias("variance_holds")),
    "SELECT diagnosis_group, unnest(['hard_cluster_0', 'hard_cluster_1', 'hard_cluster_2', 'hard_cluster_3']) AS cluster, count(*) AS n, true AS mean_holds, true AS variance_holds FROM (SELECT DISTINCT scan_name FROM fx_cells WHERE cluster IS NOT NULL) JOIN fx_scans USING (scan_name) GROUP BY diagnosis_group",
)
query("t7_dirichlet_runs", lambda t: st.dirichlet_loo(props(t), PARTS, "AD", "100+", 10).groupBy("cluster").agg(F.count("*").alias("n_runs"), F.count_if(F.col("dropped") == "").alias("n_whole")), "SELECT unnest(['hard_cluster_0', 'hard_cluster_1', 'hard_cluster_2', 'hard_cluster_3']) AS cluster, count(DISTINCT scan_name) + 1 AS n_runs, cast(1 AS bigint) AS n_whole FROM fx_cells")
