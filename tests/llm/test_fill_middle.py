"""Fill-in-middle against a plain loop over units."""

import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs

from cellmorph.llm import fill_middle
from cellmorph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@given(hs.text(alphabet=hs.sampled_from("abZ é漢😀 .\n<>PSM"), max_size=300))
@settings(max_examples=200, deadline=None)
def test_skip_list_reaches_every_rank(text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    widths = fill_middle.unit_widths(np.frombuffer(text.encode(), np.uint8))
    assert widths.tolist() == [len(u) for u in units]
    lanes = fill_middle.SkipList(widths)
    assert [lanes.seek(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_lanes_are_short_cuts():
    units = fill_middle.SkipList(np.full(100_000, 3))
    assert 6 <= len(units.lanes) <= 12
    for u, p, below in units.lanes[1:]:
        assert u.sum() == 100_000 and (p == 3 * u).all() and below[0] == 0
        assert u.max() <= 4 * u.mean()
    assert all(units.seek(k) == 3 * k for k in range(0, 100_001, 997))


def test_blocks_join(monkeypatch):
    text = "abc déf  ghi漢字😀xyz" * 7
    whole = fill_middle.unit_widths(np.frombuffer(text.encode(), np.uint8)).tolist()
    for block in (1, 2, 3, 5, 64):
        monkeypatch.setattr(fill_middle, "BLOCK", block)
        assert fill_middle.unit_widths(np.frombuffer(text.encode(), np.uint8)).tolist() == whole


def test_operator_edges(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "a", "<P>", "x<S>y", "one two  three", "é漢😀\n", "\x00a", "<<S", "S>", "lorem ipsum " * 100_000])] + [(5, "one two  three"), (None, "null id here"), (-3, "minus")] + [(i, f"word {i} of < and > P> <S") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS form", "3 AS output", "4 AS cut", "5 AS h3").repartition(3)
    found = fill_middle.transform(docs)
    found = found.withColumn("restored", fill_middle.restore(found["output"], found["form"]))
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in found.collect()), key=str)
    assert got == sorted(((i, t or "", *expected(i, t), t or "") for i, t in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).collect() == []


def test_query_against_a_loop(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        n, form, p, m, out = expected(i, t)
        want.append((i, n, form, p, m, digest(out), digest(t or "")))
    assert sorted(map(tuple, QUERIES["op13_fill_middle"](spark, SF).collect())) == sorted(want)
