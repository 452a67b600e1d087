"""The driver's tables in the roles of cell-morphology inputs: SQL that Spark and DuckDB run alike."""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_CELL_ID = "(l.l_linenumber + 10 * l.l_partkey + 100000000 * l.l_suppkey) * 100 + cast(l.l_quantity AS bigint)"
_SCAN = "concat('scan_', lpad(cast(o.o_custkey % 48 AS string), 2, '0'))"
# Of every part but each eleventh: the places of a 17x17 square around (32, 32), and lines of 55 through it.
_DISC = "SELECT p.p_partkey AS cell_id, 24 + y.v AS y, 24 + x.v AS x FROM part p, range(17) AS y(v), range(17) AS x(v) WHERE p.p_partkey % 11 > 0 AND (x.v - 8) * (x.v - 8) + (y.v - 8) * (y.v - 8) <= (3 + p.p_size % 6) * (3 + p.p_size % 6)"
_LINE = "FROM part p, range(55) AS s(v) WHERE p.p_partkey % 11 > 0 AND abs(s.v - 27) > 3 + p.p_size % 6 AND abs(s.v - 27) <="

VIEWS = {
    # one row per cell (role: cell results)
    "fx_cells": f"""
SELECT {_SCAN} AS scan_name, o.o_custkey % 48 AS scan_no,
       concat('tile_x', cast(512 * (l.l_orderkey % 40) AS string), '_y', cast(512 * (cast(floor(l.l_orderkey / 40.0) AS bigint) % 40) AS string)) AS image_name,
       {_CELL_ID} AS cell_id, l.l_linenumber % 4 AS cluster,
       (l.l_partkey * 37) % 480 AS xmin, (l.l_suppkey * 53) % 480 AS ymin,
       least(511, (l.l_partkey * 37) % 480 + 16 + cast(l.l_quantity AS bigint)) AS xmax,
       least(511, (l.l_suppkey * 53) % 480 + 16 + cast(l.l_quantity AS bigint)) AS ymax,
       cast((l.l_suppkey * 7 + l.l_partkey * 13) % 1000 AS double) / 1000 AS conf,
       l.l_quantity AS skeleton_length, l.l_extendedprice AS cell_area,
       CASE WHEN l.l_partkey % 101 = 0 THEN NULL ELSE l.l_discount END AS cell_solidity, l.l_tax AS cell_circularity
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    # one row per scan (role: cohort covariates)
    "fx_scans": """
SELECT DISTINCT concat('scan_', lpad(cast(c_custkey % 48 AS string), 2, '0')) AS scan_name,
       CASE WHEN (c_custkey % 48) % 2 = 0 THEN 'AD' ELSE '100+' END AS diagnosis_group,
       CASE WHEN (c_custkey % 48) % 3 = 0 THEN 'F' ELSE 'M' END AS sex, 60 + (c_custkey % 48) % 41 AS age_at_death,
       CASE WHEN (c_custkey % 48) % 11 = 0 THEN NULL WHEN (c_custkey % 48) % 5 = 0 THEN '4/5' ELSE cast((c_custkey % 48) % 6 AS string) END AS thal_stage,
       CASE WHEN (c_custkey % 48) % 13 = 0 THEN NULL ELSE (c_custkey % 48) % 7 END AS braak_stage, (c_custkey % 48) % 4 AS cerad_score
FROM customer""",
    # expert labels, with an ignore label; every fifth key occurs twice (first = lowest label_order)
    "fx_expert": f"""
SELECT {_SCAN} AS scan_name, {_CELL_ID} AS cell_id,
       CASE WHEN l.l_partkey % 60 = 0 THEN 'microglia_to_annotate_cluster' WHEN l.l_returnflag = 'A' THEN 'amoeboid' WHEN l.l_returnflag = 'N' THEN 'ramified' ELSE 'intermediate' END AS cluster_annotation,
       l.l_orderkey AS label_order
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 20 = 0
UNION ALL
SELECT {_SCAN} AS scan_name, {_CELL_ID} AS cell_id, 'second_opinion' AS cluster_annotation, l.l_orderkey + 1000000 AS label_order
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 100 = 0""",
    # whole-cell masks (disc plus arms on a 64x64 grid) of the parts, and soma masks (the disc only)
    "fx_pixels": f"""
{_DISC} UNION ALL SELECT p.p_partkey AS cell_id, 5 + s.v AS y, cast(32 AS bigint) AS x {_LINE} 8 + p.p_size % 20
UNION ALL SELECT p.p_partkey AS cell_id, cast(32 AS bigint) AS y, 5 + s.v AS x {_LINE} 6 + p.p_size % 18 AND p.p_partkey % 2 = 0""",
    "fx_soma": _DISC,
    # label text, some malformed
    "fx_yolo_lines": """
SELECT concat('img_', cast(l_orderkey % 500 AS string)) AS image_name,
       CASE WHEN l_partkey % 17 = 0 THEN '0 0.5 0.5' WHEN l_partkey % 19 = 0 THEN '0 a 0.5 0.1 0.1'
            ELSE concat('0 ', cast(cast((l_partkey * 37) % 480 AS double) / 512 AS string), ' ', cast(cast((l_suppkey * 53) % 480 AS double) / 512 AS string), ' 0.0625 0.125') END AS line
FROM lineitem""",
    # rectangles as tissue regions
    "fx_regions": "SELECT n_nationkey AS region_id, n_nationkey * 613 AS x0, n_nationkey * 389 AS y0, n_nationkey * 613 + 2600 AS x1, n_nationkey * 389 + 3100 AS y1 FROM nation",
    # file names to parse, some not matching
    "fx_ann_names": """
SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN concat('notes_', cast(o_orderkey AS string), '.png')
            ELSE concat('2016-0', cast(o_custkey % 48 AS string), '_Iba1_MG_whole_ann-', cast(o_orderkey AS string), '__x-', cast(o_custkey * 3 AS string), '_y-', cast(o_orderkey * 2 AS string), '_w-64_h-80__ds-1.png') END AS file_name
FROM orders""",
    # fold / variant / region metric rows
    "fx_metrics": """
SELECT event_id % 5 AS fold, CASE WHEN event_type = 'click' THEN 'none' WHEN event_type = 'view' THEN 'adaptive' ELSE 'probability' END AS variant,
       CASE WHEN user_id % 3 = 0 THEN 'soma' WHEN user_id % 3 = 1 THEN 'branches' ELSE 'overall' END AS region, event_id AS cell_id, value AS metric
FROM events""",
}


#: Rows that a task makes many of: a small file of parts is one split, but some hundred pixels a part are not.
DEALT = 4000


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in parts of some thousand rows by a hash of key, whatever its size in bytes: for rows that are about to be multiplied."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // DEALT + 1), key)


class Tables:
    """The tables of a folder and the views above, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        frames = {t: self.__getattr__(t) for t in TABLES if re.search(rf"\b{t}\b", VIEWS[name])}
        sql = VIEWS[name]
        for t in frames:
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        # A range beside a table is a generator in Spark: rows are made in place of a join.
        if ", range(" in sql and "part" in frames:
            frames["part"] = dealt(frames["part"], "p_partkey")
        sql = re.sub(r", range\((\d+)\) AS (\w+)\(v\)", lambda m: f" LATERAL VIEW explode(sequence(0L, {int(m[1]) - 1}L)) {m[2]} AS v", sql)
        return self.spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put before it."""
    used = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if re.search(rf"\b{v}\b", sql))
    if not used:
        return sql
    start = re.match(r"WITH( RECURSIVE)? ", sql)
    return f"{start[0]}{used}, {sql[start.end() :]}" if start else f"WITH {used} {sql}"
