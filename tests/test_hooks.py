"""User models with failing rows, the run-length table function, restarted streams, one evaluation of combined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmorph.operators import pixels, stats
from cellmorph.plans import hooks
from cellmorph.sources import files
from cellmorph.streaming import ingest


class Halves:
    """Doubles x; refuses some rows, and gives too few results for others."""

    def predict(self, columns):
        x = columns["x"]
        if (x == 7).any():
            raise ZeroDivisionError("seven")
        return {"twice": 2 * x[: len(x) - 1] if (x == 9).any() else 2 * x}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_failing_rows_cost_no_job(spark, rows):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(12)], "k int, x double").repartition(2)
    got = {r["k"]: (r["twice"], r["error"]) for r in hooks.score_tiles(df, Halves(), ["x"], "twice double", rows).collect()}
    assert {k: v for k, (v, e) in got.items() if e is None} == {k: 2.0 * k for k in range(12) if k not in (3, 7, 9)}
    assert got[7] == (None, "ZeroDivisionError: seven") and "no value" in got[3][1] and "number of results" in got[9][1]
    assert hooks.score_tiles(df.limit(0), Halves(), ["x"], "twice double").collect() == []


def test_centroids(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 0.0]), (1, [9.0, 9.0]), (None, [5.0, 5.0]), (1, None)], "label long, v array<double>")
    model = hooks.fit_centroids(df, "label", "v")
    assert model.means.tolist() == [[1, 0], [9, 9]]
    ragged = spark.createDataFrame([(1, [1.0, 1.0]), (2, [8.0]), (3, [8.0, 9.0])], "k int, v array<double>")
    got = {r["k"]: (r["predicted"], r["error"] is None) for r in hooks.score_tiles(ragged, model, ["v"], "predicted long").collect()}
    assert got == {1: (0, True), 2: (None, False), 3: (1, True)}


def test_runs_by_table_function_and_sql(spark):
    runs = spark.createDataFrame([("a", [0, 2, 3, 1]), ("b", [5]), ("c", []), ("d", None), ("e", [1, 1, 0, 2])], "k string, counts array<long>")
    want = sorted([("a", 0, 0), ("a", 1, 0), ("a", 1, 1), ("e", 1, 0), ("e", 2, 0), ("e", 3, 0)])
    assert sorted(map(tuple, pixels.rle_decode(runs, 4).collect())) == want
    assert sorted(map(tuple, hooks.expand_runs(runs, 4).collect())) == want == sorted(map(tuple, hooks.expand_runs(runs, 4, ["k"]).collect()))
    hooks.register_expand_runs(spark, "k string, y long, x long", 4)
    runs.createOrReplaceTempView("runs_of_masks")
    assert sorted(map(tuple, spark.sql("SELECT * FROM expand_runs(TABLE(runs_of_masks) PARTITION BY k)").collect())) == want


def test_totals_survive_a_restart(spark, tmp_path):
    schema = "cell_area DOUBLE, image_name STRING, scan_name STRING, global_cell_id STRING"
    rows = lambda n, scan: spark.createDataFrame([(float(i), "i", scan, f"{scan}{i}") for i in range(n)], schema)
    run = lambda: ingest.stream_scan_totals(ingest.read_stream(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows(10, "a").coalesce(1).write.option("header", True).mode("append").csv(f"{tmp_path}/in")
    run()
    rows(4, "a").union(rows(3, "b")).coalesce(1).write.option("header", True).mode("append").csv(f"{tmp_path}/in")
    run()
    run()
    got = {r["scan_name"]: (r["n_cells"], r["mean_area"]) for r in ingest.read_scan_totals(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (14, (45 + 6) / 14), "b": (3, 1.0)}


def test_combined_results_evaluate_their_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "scan_name string, cell_id int").withColumn("source_file", F.lit("f")).mapInArrow(count, "scan_name string, cell_id int, source_file string")
    assert tuple(files.combine_results(df, f"{tmp_path}/out").first()) == (3, 2, 1) and seen.value == 3
    with pytest.raises(ValueError):
        files.combine_results(df.limit(0), f"{tmp_path}/none")


def test_chains_equal_greedy_linkage():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        d = rng.random((n, n))
        d = d + d.T
        cut = float(rng.random() * 1.5)
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            gap, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if gap > cut:
                break
            groups[i] += groups.pop(j)
        found = stats.average_linkage(d, cut)
        assert sorted(sorted(i for i in range(n) if found[i] == g) for g in set(found)) == sorted(map(sorted, groups))
        assert list(dict.fromkeys(found)) == list(range(max(found) + 1))
