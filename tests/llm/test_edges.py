"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns in every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellmorph.llm import chat, html_text, language, media, packing, pieces, pii, search, simhash, toxicity

LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    (1, "Hello there, general words of the day.", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0), (None, "Hello there, general words of the day.", "en", "a", 3), (4, "   \n\t ", "de", "b", 5),
    (1, "Hello there, general words of the day.", "en", "a", 1), (5, "12345 !!! 678", "fr", "b", 9), (6, "der die das und nicht mit", "de", "c", 2), (7, "\x00\x01 \U0001f642 é ́ �", None, None, 7), (8, LONG, "en", "a", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "start length part ids fp row uid digest segments n key held_out score predicted group label sequence_id offset media payload toxic".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASH)}).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "pack": packing.pack,
        "simhash": simhash.hamming_components,
        "pii": lambda d: pii.spans(d, pii.fit(d)),
        "language": lambda d: language.predict(d, language.train(d)),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)),
        "media": lambda d: media.media_columns(media.encode_containers(d)),
        "pieces": pieces.encode,
    }


NAMES = ["pack", "simhash", "pii", "language", "toxicity", "media", "pieces"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_every_document(spark, docs, labels, name):
    found = operators(labels)[name](docs)
    rows = found.collect()
    ids = sorted(str(r["doc_id"]) for r in rows if name != "pack" or r["start"] == 0)
    assert ids == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    found = operators(labels)[name](docs.limit(0))
    assert found.collect() == [] and "doc_id" in found.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns(spark, docs, labels, name, stage, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = stage(spark, docs, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert found.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert found.count() > 0


def test_language_stage_drops_what_has_no_letter(spark, docs, tmp_path):
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()}
    assert kept == {1, None, 6, 7, 8}


def test_dedup_stage_keeps_one_of_each_group(spark, docs):
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == [1, 2, 5, 6, 7, 8]  # 2, 3 and 4 have no words; null and 1 are copies


def test_pii_stage_redacts(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org or +1 (743) 555-3824 now", 5), (2, None, 4)], "doc_id long, text string, n_chars long")
    rows = pii.redact(docs, pii.train([])).orderBy("doc_id").collect()
    assert rows[0]["text"] == "mail [EMAIL] or [PHONE] now" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[1]["text"] is None and rows[1]["n_chars"] == 4


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0]), (5, [1.0, 2.0]), (6, [1.0, 2.0]), (100, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    got = sorted(map(tuple, search.top_k(df, 3).collect()))
    assert got == [(0, 1, 5, 327680), (0, 2, 6, 327680), (0, 3, 4, 65536), (100, 1, 0, 0), (100, 2, 4, 0), (100, 3, 5, 0)]
    assert search.top_k(df.limit(0)).collect() == []


def test_search_with_one_row(spark):
    assert search.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).collect() == []


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (1, None, ""), (None, "u", "<p>"), (2, "u", "<p>a<p>b"), (3, "u", "no tags at all")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract(df).collect()) == [("1", "", 0), ("1", "", 0), ("2", "a\n\nb", 4), ("3", "no tags at all", 14), ("None", "", 0)]
    assert html_text.extract(df.limit(0)).collect() == []


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, 0, None, None), (None, 1, "assistant", "x"), (1, None, "user", "y"), (1, 0, "user", "z"), (1, 0, "user", "z")], "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))
    rows = chat.messages(df)
    calls, results = chat.turns_as_calls(rows)
    found = chat.format_chat(df, calls, results, chat.schema_table(spark)).collect()
    assert sum(r["kind"] == "message" for r in found) == 5
    empty = chat.messages(df.limit(0))
    calls, results = chat.turns_as_calls(empty)
    assert chat.format_chat(df.limit(0), calls, results, chat.schema_table(spark)).collect() == []
