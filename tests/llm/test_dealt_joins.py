"""A fingerprint is 33 rows of the index, a bucket's member up to 529: Spark's estimate takes each for one row, so no join may broadcast them."""

import pytest
from pyspark.sql import functions as F

from cellmorph.llm import common, simhash


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is stored, by tag."""
    seen = []

    def stored(df, tag, real=common.stored):
        seen.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, tag)

    for module in (common, simhash):
        monkeypatch.setattr(module, "stored", stored)
    return seen


def test_index_is_never_broadcast(spark, plans, tmp_path):
    spark.range(200).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "prints"))
    simhash.hamming_links(spark.read.parquet(str(tmp_path / "prints")))
    assert {"buckets", "links"} <= {tag for tag, _ in plans}
    assert not [tag for tag, plan in plans if "Broadcast" in plan]


def test_components_meet_without_a_broadcast(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7} seven eight") for i in range(30)], "doc_id long, text string")
    found = simhash.hamming_components(docs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 30


def test_groups_meet_without_a_broadcast(spark, plans):
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7} seven eight") for i in range(30)], "doc_id long, text string")
    simhash.near_groups(docs)
    # The names of texts to read again are counted before they are sent whole (`_few`); components shrink in rounds of their own.
    assert not [tag for tag, plan in plans if "Broadcast" in plan and tag not in ("shingles", "edges", "mixed")]
