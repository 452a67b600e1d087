"""Models learn from every document they may learn from, however the rows are dealt."""

import numpy as np
from pyspark.sql import functions as F

from cellmorph.llm import toxicity


def _labelled(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("vile word "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("kind day "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    return docs, docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))


def test_toxicity_learns_from_all_labels(spark):
    docs, labels = _labelled(spark, 14_000)
    learned = docs.where(toxicity.crc_mod("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT).count()
    model = toxicity.fit(docs, labels)
    assert learned > 10_000 and model["documents"] == learned
    s = toxicity.Scorer(model)
    assert s.score("vile word 5") > toxicity.THRESHOLD > s.score("kind day 6")


def test_toxicity_model_does_not_hang_on_partitions(spark):
    docs, labels = _labelled(spark, 4_500)
    one, other = toxicity.fit(docs.repartition(1), labels), toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert all(np.array_equal(one[x], other[x]) for x in ("tables", "out", "tongue", "cuts"))
