"""The field against enumeration, planted repetitions, small batches, and the query against the patterns."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from cellmorph.llm import pii
from cellmorph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    holds = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [[m.span() for m in re.finditer(p, text) if ok(m)] for p, ok in zip(PATTERNS, holds, strict=True)]


def enumerated(model, unary, edges, observed):
    n, labels = unary.shape
    total = np.zeros((n, labels))
    for pick in itertools.product(range(labels), repeat=n):
        if any(o >= 0 and pick[i] != o for i, o in enumerate(observed)):
            continue
        s = sum((0.0 if observed[i] >= 0 else unary[i, k]) for i, k in enumerate(pick)) + sum(model["pair"][k, pick[i], pick[j]] for i, j, k in edges)
        for i, k in enumerate(pick):
            total[i, k] += np.exp(s)
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("edges,close", [([(0, 1, 0), (1, 2, 1), (1, 3, 0)], 1e-4), ([(0, 1, 0), (1, 2, 0), (0, 2, 1)], 0.05), ([(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (0, 2, 1)], 0.05), ([], 1e-9)])
def test_messages_equal_enumeration(edges, close):
    rng = np.random.default_rng(4)
    half = rng.normal(0, 0.3, (2, 3, 3))  # messages are exact on trees, and near on weak loops
    model = {"pair": half + half.transpose(0, 2, 1)}
    for observed in ([-1] * 4, [2, -1, -1, -1]):
        unary = rng.normal(0, 1, (4, 3))
        got = pii.marginals(model, unary, np.array(edges, np.int64).reshape(-1, 3), np.array(observed))
        assert np.abs(got - enumerated(model, unary, edges, observed)).max() < close


@pytest.fixture(scope="module")
def model():
    return pii.train([t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchall()])


def test_repetitions_are_added(model):
    """Other ways to write a span of the same text, planted in documents; what repeats nothing stays."""
    rng = random.Random(3)
    texts = [t for (t,) in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null and length(text) between 500 and 3000 order by doc_id limit 40").fetchall()]
    added = 0
    for text in texts:
        area, number, lone = rng.randrange(200, 999), f"{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}", rng.randrange(10**9, 10**10)
        half = text.index(" ", len(text) // 2)
        planted = f"{text[:half]} +1 ({area}) {number} {text[half:]} call ({area}) {number} or {lone}"
        ((was, now),) = pii.find(model, [planted])
        more = [planted[a:b] for a, b in now[3] if (a, b) not in was[3]]
        assert set(more) <= {f"({area}) {number}"} and all(set(b) <= set(s) for b, s in zip(was, now, strict=True))
        added += len(more)
    assert added >= 36


@pytest.mark.parametrize("text", ["call 743 555 3824 now", "", "x@y", "1234567", "a@b.org", "7435553824 " * 3000])
def test_batches_of_one_row(spark, model, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(pii.spans(docs, model).collect()) == 1 and len(pii.redact(docs, model).collect()) == 1
    assert pii.spans(docs, pii.fit(docs)).count() == 1


def test_query_equals_the_patterns(spark):
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    rows = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, SF).collect()}
    assert set(rows) == set(texts)
    for d, text in texts.items():
        want = base(text)
        listed = [f"{kind}:{a}:{b}" for kind, spans in zip(pii.KINDS, want, strict=True) for a, b in spans]
        r = rows[d]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == list(map(len, want))
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        found = [s.split(":") for s in r["spans"].split(",") if s]
        assert set(listed) <= set(map(":".join, found)) and found == sorted(found, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))


def test_clashing_columns(spark, model):
    docs = spark.createDataFrame([(1, "mail a@b.org")], "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS n_ip", "3 AS h", "4 AS x", "'5' AS n_chars")
    assert pii.spans(docs, pii.fit(docs)).first()["spans"] == "email:5:12"
    assert tuple(pii.redact(docs, model).first()) == (1, "mail [EMAIL]", 1, 2, 3, 4, "5")
