"""Token counts against the libraries, and what the cache spares."""

import functools

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cellmorph.llm import token_counts
from cellmorph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(i, t) for i, t in enumerate(["", None, " ", "a", "<|endoftext|> as text", "x<|endoftext|>y", "é漢😀\n\n  z", "\x00\x01", "Word word", "word  word ", "lorem ipsum " * 100_000, "</s> <s> <unk> ▁"])] + [(3, "a"), (None, "a"), (None, None), (99, "Word word")]


@functools.cache
def library(path):
    """Counts of one text by the libraries themselves."""
    if path.endswith(".json"):
        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    p = SentencePieceProcessor(model_file=path)
    return lambda x: len(p.encode(x))


def expected(path, rows):
    count = library(path)
    return sorted(((i, len((t or "").encode()), count(t or "")) for i, t in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS n_tokens", "3 AS copies").repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("path", [BPE, PIECES, public_tokenizers.path("word_bpe_49k.json")])
def test_counts_are_the_library_s(spark, tmp_path, path):
    assert got(token_counts.count_tokens(frame(spark, ROWS), path, f"{tmp_path}/cache")) == expected(path, ROWS)


@pytest.fixture(scope="module")
def count():
    return token_counts.counter(BPE, token_counts.tokenizer_version(BPE))


@given(found=hs.lists(hs.text(alphabet=hs.sampled_from("abZé漢😀 .,!'\n\t<|endoftext|>0"), max_size=80), max_size=8))
@settings(max_examples=200, deadline=None)
def test_any_text_counts_as_by_the_library(count, found):
    assert sorted(map(str, zip(range(len(found)), (len(x.encode()) for x in found), count(found)))) == sorted(map(str, expected(BPE, list(enumerate(found)))))


def batches(spark, cache):
    """Digests that each batch of the cache added."""
    return sorted(r["count"] for r in spark.read.parquet(str(cache)).groupBy("tokenizer", "batch").count().collect())


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = tmp_path / "cache"
    run = lambda rows, path=BPE: got(token_counts.count_tokens(frame(spark, rows), path, str(cache)))
    assert run([]) == [] and not cache.exists()
    distinct = {t or "" for _, t in ROWS}
    for _ in range(2):  # the second run finds all of them
        assert run(ROWS) == expected(BPE, ROWS)
        assert batches(spark, cache) == [len(distinct)]
    more = [*ROWS, (200, "new text"), (201, "new text"), (202, "a")]
    assert run(more) == expected(BPE, more)
    assert batches(spark, cache) == [1, len(distinct)]
    assert run(ROWS, PIECES) == expected(PIECES, ROWS)
    assert batches(spark, cache) == [1, len(distinct), len(distinct)]


def test_joined_misses_and_hot_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 2)
    rows = ROWS + [(1000 + i, "a copy of one text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)]
    for _ in range(2):
        assert got(token_counts.count_tokens(frame(spark, rows), BPE, f"{tmp_path}/cache")) == expected(BPE, rows)


def test_a_digest_of_two_batches_counts_once(spark, tmp_path):
    version = token_counts.tokenizer_version(BPE)
    assert got(token_counts.count_tokens(frame(spark, ROWS), BPE, f"{tmp_path}/cache")) == expected(BPE, ROWS)
    rows = token_counts.cached(spark, f"{tmp_path}/cache", version)
    rows.write.parquet(f"{tmp_path}/cache/tokenizer={version}/batch=again")
    assert got(token_counts.count_tokens(frame(spark, ROWS), BPE, f"{tmp_path}/cache")) == expected(BPE, ROWS)


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        token_counts.counter(BPE, "another")


def test_query_against_the_library(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = [(i, n, k, k > 1024) for i, n, k in expected(BPE, rows)]
    assert got(QUERIES["op11_token_counts"](spark, SF)) == sorted(want, key=str)
