"""Filter interaction audit: what every order of five filters keeps and removes, read off count-weighted decision diagrams.

Spark reduces the documents to one row per part and failure mask. Each part's masks become a decision diagram: a node of
level k splits its documents by the k-th filter, leaves hold counts, and equal nodes are one. Swapping two adjacent levels
rebuilds only those levels; the orders are visited so that each is one swap from the last. The path along passing branches
from the root gives an order's steps: at each node the failing branch holds what the filter removes.

Defined results: a null text is empty, a null lang is the part ''. A document without doc_id never fails E and lets none
fail. Repeated rows of a doc_id are counted each; none of them is smaller than another. Several label rows of a doc_id
count as one with any of their marks. An empty table gives no rows. A very long text is judged whole. Columns other than
doc_id, text and lang are ignored, whatever their names.
"""

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

FILTERS = "ABCDE"
#: A: fewer words. B: percent of distinct words. C: percent of capital letters. D: any of the marks.
WORDS, DISTINCT, UPPER, MARKS = 100, 80, 10, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("n", "good", "toxic")


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails, A the lowest. split() parts bytes at just the six white space characters of the definition."""
    words, points = raw.split(), len(raw) if raw.isascii() else len(raw.decode())
    a = len(words) < WORDS
    b = 100 * len(set(words)) < DISTINCT * len(words)
    c = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > UPPER * points
    d = len(raw.translate(None, MARKS)) < len(raw)
    return a | b << 1 | c << 2 | d << 3


def _judge(batches):
    for batch in slices(batches):
        masks, digests = [], []
        for t in batch.column("text"):
            raw = t.as_buffer().to_pybytes()
            masks.append(failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest): the failures of A to D, and what tells equal texts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text("lang").alias("part"), text("text").alias("text")).mapInArrow(_judge, "doc_id long, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, at most 32 masks a part.

    Copies of a text share the failures of A to D, so they meet as counts: a group of copies of any size is a row per part before its smallest doc_id is sought."""
    once = judged(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("k")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without an id are dealt by their digest and find no label.
    marked = once.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.hex("digest"))).join(marks, "k", "left").fillna(0, ["good", "toxic"])
    has_id = F.col("doc_id").isNotNull()
    weight = {"n": F.col("n"), "good": F.col("good") * F.col("n"), "toxic": F.col("toxic") * F.col("n")}
    groups = marked.groupBy("digest", "part", "mask").agg(
        *(F.sum(F.when(has_id, v)).alias(c) for c, v in weight.items()), F.min(F.when(has_id, F.struct("doc_id", *(v.alias(c) for c, v in weight.items())))).alias("first"), F.sum(F.when(~has_id, F.col("n"))).alias("without_id")
    )
    is_first = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("is_first", F.coalesce(is_first, F.lit(False)))
    head = lambda c: F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0)
    row = lambda mask, values: F.struct(mask.cast("int").alias("mask"), *(F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in zip(COUNTS, values, strict=True)))
    own, copy, none = row(F.col("mask"), [head(c) for c in COUNTS]), row(F.col("mask") + COPY, [F.col(c) - head(c) for c in COUNTS]), row(F.col("mask"), [F.col("without_id"), F.lit(0), F.lit(0)])
    return groups.select("part", F.inline(F.array(own, copy, none))).where("n > 0").groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def changes(n: int) -> Iterator[int]:
    """Places to swap with the next so that all n! orders occur, each one swap from the last: the last element travels through the orders of the others."""
    inner, back = changes(n - 1) if n > 1 else iter(()), True
    while n > 1:
        yield from range(n - 2, -1, -1) if back else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + back  # with the traveller in front the others lie a place further
        back = not back


class Diagram:
    """A decision diagram over the filters of `order`. A node is (counts, passing, failing); a leaf has no branches."""

    def __init__(self, masks: dict[int, tuple[int, ...]], order: str = FILTERS):
        self.order, self.nodes, self.known = list(order), [], {}
        zero = (0,) * len(COUNTS)
        bits = [1 << FILTERS.index(f) for f in order]

        def build(level: int, mask: int) -> int:
            return self._leaf(masks.get(mask, zero)) if level == len(bits) else self._node(build(level + 1, mask), build(level + 1, mask | bits[level]))

        self.root = build(0, 0)

    def _put(self, node: tuple) -> int:
        if node not in self.known:
            self.known[node] = len(self.nodes)
            self.nodes.append(node)
        return self.known[node]

    def _leaf(self, counts: tuple[int, ...]) -> int:
        return self._put((counts, None, None))

    def _node(self, passing: int, failing: int) -> int:
        return self._put((tuple(map(sum, zip(self.nodes[passing][0], self.nodes[failing][0], strict=True))), passing, failing))

    def swap(self, level: int) -> None:
        """Exchanges the filters of a level and the next."""
        made: dict[tuple[int, int], int] = {}

        def down(node: int, depth: int) -> int:
            if (node, depth) not in made:
                _, passing, failing = self.nodes[node]
                if depth < level:
                    made[node, depth] = self._node(down(passing, depth + 1), down(failing, depth + 1))
                else:  # the branches' branches change places
                    (_, pp, pf), (_, fp, ff) = self.nodes[passing], self.nodes[failing]
                    made[node, depth] = self._node(self._node(pp, fp), self._node(pf, ff))
            return made[node, depth]

        self.root = down(self.root, 0)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) of each step of the order."""
        out, node = [], self.root
        for f in self.order:
            _, passing, failing = self.nodes[node]
            out.append((f, self.nodes[passing][0], self.nodes[failing][0]))
            node = passing
        return out


def order_steps(masks: dict[int, tuple[int, ...]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    diagram = Diagram(masks)
    paths = {"".join(diagram.order): diagram.path()}
    for level in changes(len(FILTERS)):
        diagram.swap(level)
        paths["".join(diagram.order)] = diagram.path()
    # The first filter of an order meets all that fail it, the last one only what fails no other.
    fails = {p[0][0]: p[0][2][0] for p in paths.values()}
    unique = {p[-1][0]: p[-1][2][0] for p in paths.values()}
    total = {f: sum(gone[0] for p in paths.values() for g, _, gone in p if g == f) for f in FILTERS}
    return [(order, k, kept[0], gone[0], fails[f] - gone[0], unique[f], gone[1], gone[2], total[f]) for order, path in paths.items() for k, (f, kept, gone) in enumerate(path, 1)]


_OUT = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    masks = {int(m): tuple(map(int, c)) for m, *c in pdf[["mask", *COUNTS]].itertuples(index=False)}
    out = pd.DataFrame(order_steps(masks), columns=_OUT)
    out.insert(0, "part", key[0])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step; a part's diagrams are built from its 32 masks at most."""
    return mask_counts(docs, labels).groupBy("part").applyInPandas(_steps, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS bits FROM range(5) a(i), range(5) b(i), range(5) c(i), range(5) d(i), range(5) e(i) WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(bits, lambda b: 'ABCDE'[b + 1]), '') AS filter_order, k AS step, cast(1 << bits[k] AS integer) AS bit,
    cast(coalesce(list_sum(list_transform(bits[1:k - 1], lambda b: 1 << b)), 0) AS integer) AS before FROM o, range(1, 6) t(k)),
x AS (SELECT part, filter_order, step, bit, cast(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS bigint) AS kept,
    cast(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS bigint) AS removed,
    cast(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS bigint) AS redundant,
    cast(coalesce(sum(n) FILTER (mask = bit), 0) AS bigint) AS unique_fails,
    cast(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS bigint) AS good_lost,
    cast(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS bigint) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, cast(step AS integer) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM x
"""
