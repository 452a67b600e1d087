"""Filter audit against DuckDB SQL and against removing documents one by one."""

import itertools
import re

import pytest

from cellmorph.llm import filter_audit
from cellmorph.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, same

SF = "/root/testdata/sf0.001"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    caps = len(re.findall("[A-Z]", text))
    return {f for f, x in zip("ABCD", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * caps > 10 * len(text), re.search(r"[#$%&*|]", text)), strict=True) if x}


def expected(rows, labels):
    """Every order applied to the documents of each part."""
    judged = []
    for i, t, lang in rows:
        t = t or ""
        bad = fails(t)
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            bad = bad | {"E"}
        good, toxic = (any(k == i and i is not None and row[c] == 1 for k, *row in labels) for c in (0, 1))
        judged.append((lang or "", bad, good, toxic))
    out = []
    for part in {p for p, *_ in judged}:
        docs = [d[1:] for d in judged if d[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for k, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[0]], [d for d in left if f not in d[0]]
                total[f] += len(gone)
                steps.append((f, (part, order, k, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone))))
        out += [(*row, total[f]) for f, row in steps]
    return sorted(out)


def test_changes_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(n)))


def test_swapped_diagrams_equal_built_ones():
    masks = {m: (m * 7 % 11, m % 3, m % 2) for m in range(32) if m % 5}
    diagram = filter_audit.Diagram(masks)
    for level in filter_audit.changes(5):
        diagram.swap(level)
        assert diagram.path() == filter_audit.Diagram(masks, "".join(diagram.order)).path()
    assert len(diagram.nodes) < 120 * 31  # equal nodes are shared


def test_equal_nodes_are_one():
    assert len(filter_audit.Diagram(dict.fromkeys(range(32), (1, 0, 0))).nodes) == 6


TEXTS = ["", None, " \t\n", "A b", "word " * 150, "#" + "x " * 3, " ".join(f"w{i}" for i in range(120)), "LOUD VOICE", "é漢 \xa0 nbsp\x85is word", "lorem ipsum " * 100_000, "\x0b\x0c\r a", "\x00"]


def test_operator_against_a_loop(spark):
    rows = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, TEXTS[4], ("en", "de")[i % 2]) for i in range(9)] + [(100, TEXTS[4], "en"), (100, TEXTS[4], "fr"), (None, TEXTS[4], "en"), (None, "", "de"), (None, None, None), (7, "another text", "en"), (4, TEXTS[4], "de")]
    labels = [(i, (1, 0, None)[i % 3], (0, 1)[i % 2]) for i in range(0, 110, 3)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS part", "2 AS digest", "3 AS n", "4 AS good").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS k")
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == expected(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).collect() == []
    assert {r["good_lost"] + r["toxic_lost"] for r in filter_audit.audit(docs, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("sf", [SF])
def test_same_as_sql(spark, sf):
    assert same(QUERIES["op12_filter_audit"](spark, sf), connect(sf), ORACLE_SQL["op12_filter_audit"]) == ""
