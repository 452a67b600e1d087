"""Personal data by fixed rules and a skip-chain conditional random field.

The rules find the base spans. The field then labels the other candidates of a document: runs of 7 to 25 digits
parted by at most two of space, point, hyphen and parentheses, and words of up to 64 characters, an @ and up to 255
more. Each node has log-linear potentials over its shape and its neighbouring words; chain
edges link candidates that follow each other closely, skip edges link each candidate to the next one
anywhere in the document whose normal form repeats or resembles it. Base spans are observed; sum-product
messages pass over the loopy graph, so that a candidate takes the label that its repetitions have.
Candidates whose marginal reaches MARGINAL are added if they have a skip edge (what a span is by itself is
the rules' business), under kinds that their characters allow; base spans stay.

The potentials are trained on a bounded sample, at most SAMPLE documents (by a hash of doc_id) with candidates:
multinomial logistic unaries, smoothed log odds of label pairs for edges. Base spans are labelled; the labels of all
other candidates are hidden, so they are estimated in turns with the potentials (expectation maximisation).

Defined results: a null text is an empty one, with no spans; a null or repeated doc_id is kept as its own
row; an empty table gives no rows; a text of any length is searched as a whole; of kinds with equal marginals the
first listed counts; other columns are ignored (`redact` keeps them), whatever their names. Offsets are code points,
ends exclusive.
"""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE, MARGINAL, ROUNDS = 4000, 0.9, 30
FEATURES, STEPS, RATE, DECAY = 512, 200, 0.5, 1e-3
#: Turns of estimating hidden labels; how sure they are nothing before the first; what an edge's pairs count in advance.
TURNS, NOTHING, SAME, ANY = 3, 0.9, 10.0, 1.0
#: Candidates that lie at most so many characters apart are chained.
NEAR = 40

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[^\s@,;<>()\"]{1,64}@[^\s@,;<>()\"]{1,255}|(?<![\w.])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?!\w)")
_SHAPE = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        last = match.end() if match else at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS: leftmost, non-overlapping within a kind, failing matches dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards, phones = [], []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            cards.append(m.span())
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= sum(map(len, _SHAPE.findall(m[0]))) <= 15:
            phones.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return [_emails(text), ips, cards, phones]


def nodes(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(start, end, label) by start: base spans, and candidates (label -1) that touch none of them."""
    found = [(a, b, k + 1) for k, spans in enumerate(base) for a, b in spans]
    taken = sorted((a, b) for a, b, _ in found)
    k = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            found.append((a, b, -1))
    return sorted(found)


def _bucket(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode()) % FEATURES


def node_features(text: str, a: int, b: int) -> list[int]:
    """Hashed shape and context of a span; the card checksum is part of the shape."""
    span = text[a:b]
    digits = "".join(_SHAPE.findall(span))
    shape = re.sub(r"[^\W\d_]+", "a", _SHAPE.sub(lambda m: "9" if len(m[0]) > 4 else str(len(m[0])), span))[:24]
    before = text[max(0, a - 30) : a].split()
    after = text[b : b + 30].split()
    return [
        _bucket("bias"), _bucket("shape", shape), _bucket("n", min(len(digits), 20), "@" in span, "." in span),
        _bucket("luhn", 13 <= len(digits) <= 19 and luhn(digits), len(digits) >= 13),
        _bucket("before", before[-1].lower() if before else ""), _bucket("after", after[0].lower() if after else ""),
    ]


def normal_forms(text: str, a: int, b: int) -> list[str]:
    """What repeated or similar spans share: the span in lower case, its last ten digits, its last seven."""
    span = text[a:b].lower()
    digits = "".join(_SHAPE.findall(span))
    forms = [span.strip(".,;:()")]
    if "@" not in span:
        forms += [f"10:{digits[-10:]}"] * (len(digits) >= 10) + [f"7:{digits[-7:]}"] * (len(digits) >= 7)
    return forms


def graph(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Edges (i, j, kind): kind 0 chains close neighbours, 1 skips to the next repeated or similar node."""
    edges = [(i, i + 1, 0) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= NEAR]
    last: dict[str, int] = {}
    linked = set()
    for i, (a, b, _) in enumerate(found):
        for form in normal_forms(text, a, b):
            j = last.get(form)
            if j is not None and (j, i) not in linked:
                linked.add((j, i))
                edges.append((j, i, 1))
            last[form] = i
    return edges


def observed(text: str) -> tuple[list, list, list, list]:
    """(features, labels or -1, scores of impossible labels, edges) of a text's nodes."""
    base = base_spans(text)
    found = nodes(text, base)
    possible = [[0.0] + [0.0 if k >= 0 or _plausible(text[a:b], kind) else -30.0 for kind in range(len(KINDS))] for a, b, k in found]
    return [node_features(text, a, b) for a, b, _ in found], [k for _, _, k in found], possible, graph(text, found)


def joined(parts: list[tuple[list, list, list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The graphs of many texts as one, in arrays."""
    x, y, possible, edges = [], [], [], []
    for px, py, pp, pe in parts:
        edges += [(len(x) + i, len(x) + j, kind) for i, j, kind in pe]
        x += px
        y += py
        possible += pp
    return np.array(x, np.int64).reshape(len(x), 6 if not x else -1), np.array(y, np.int64), np.array(possible, float).reshape(len(x), len(KINDS) + 1), np.array(edges, np.int64).reshape(-1, 3)


def _unaries(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Logistic weights (FEATURES, labels) that fit the label shares q."""
    w, size = np.zeros((FEATURES, q.shape[1])), np.full((FEATURES, q.shape[1]), 1e-8)
    for _ in range(STEPS):
        z = w[x].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.zeros_like(w)
        np.add.at(g, x, ((p - q) / len(x))[:, None, :])
        g += DECAY * w / len(x)
        size += g * g
        w -= RATE * g / np.sqrt(size)
    return w


def train(samples: list[str]) -> dict:
    """Potentials from texts."""
    return learn([observed(t) for t in samples])


def learn(parts: list[tuple[list, list, list, list]]) -> dict:
    """Potentials from the nodes and edges of texts (see `observed`)."""
    n = len(KINDS) + 1
    x, y, possible, edges = joined(parts)
    hidden = y < 0
    q = np.eye(n)[np.maximum(y, 0)]
    free = np.exp(possible) * (np.arange(n) > 0)
    some = hidden & (free.sum(1) > 0.5)
    q[some] = NOTHING * q[some] + (1 - NOTHING) * free[some] / free[some].sum(1, keepdims=True)
    model: dict = {"unary": np.zeros((FEATURES, n)), "pair": np.zeros((2, n, n))}
    for _ in range(TURNS if hidden.any() else 1):
        # What is known of edges in advance: repeated spans are of one kind (1), neighbours of any (0).
        pairs = np.full((2, n, n), ANY)
        pairs[1] += SAME * np.eye(n)
        for kind in (0, 1):
            a, b = q[edges[edges[:, 2] == kind, 0]], q[edges[edges[:, 2] == kind, 1]]
            pairs[kind] += a.T @ b + b.T @ a
        joint = pairs / pairs.sum((1, 2), keepdims=True)
        odds = np.log(joint / (joint.sum(2)[:, :, None] * joint.sum(1)[:, None, :]))
        model = {"unary": _unaries(x, q) if len(x) else model["unary"], "pair": np.clip(odds, -6, 6)}
        if hidden.any():
            q = marginals(model, model["unary"][x].sum(1) + possible, edges, y)
    return model


def marginals(model: dict, unary: np.ndarray, edges: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """Loopy sum-product: label probabilities of all nodes of a batch of documents at once."""
    unary = np.where(observed[:, None] >= 0, np.where(np.arange(unary.shape[1]) == observed[:, None], 0.0, -30.0), unary)
    belief = unary.copy()
    if len(edges):
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = model["pair"][np.concatenate([edges[:, 2]] * 2)]
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(a), unary.shape[1]))
        for _ in range(ROUNDS):
            given = (belief[a] - message[back])[:, :, None] + pair
            top = given.max(1, keepdims=True)
            new = np.log(np.exp(given - top).sum(1)) + top[:, 0]
            last, message = message, 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
            belief = unary.copy()
            np.add.at(belief, b, message)
            if np.abs(message - last).max() < 1e-6:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _plausible(span: str, kind: int) -> bool:
    """Whether a span can be what its label says."""
    digits = sum(map(len, _SHAPE.findall(span)))
    return ("@" in span, bool(_IP.fullmatch(span)), "@" not in span and 13 <= digits <= 19, "@" not in span and 7 <= digits <= 15)[kind]


def find(model: dict, batch: list[str]) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """Per text: base spans of each kind, and all spans of each kind with those the field adds."""
    out, parts, where = [], [], []
    for d, text in enumerate(batch):
        base = base_spans(text)
        out.append((base, [list(s) for s in base]))
        found = nodes(text, base)
        if any(k < 0 for _, _, k in found):
            parts.append(observed(text))
            where += [(d, a, b) for a, b, _ in found]
    if parts:
        x, y, possible, edges = joined(parts)
        p = marginals(model, model["unary"][x].sum(1) + possible, edges, y)
        skipped = np.zeros(len(x), bool)
        skipped[edges[edges[:, 2] == 1, :2]] = True
        for i in np.flatnonzero((p[:, 1:].max(1) >= MARGINAL) & (y < 0) & skipped):
            d, a, b = where[i]
            out[d][1][int(p[i, 1:].argmax())].append((a, b))
    return [(base, [sorted(s) for s in spans]) for base, spans in out]


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


def redacted(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with each stretch of overlapping spans replaced by its first one's kind, as in [EMAIL]."""
    merged: list[list] = []
    for a, b, kind in sorted((a, b, kind) for kind, found in zip(KINDS, spans, strict=True) for a, b in found):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    at, out = 0, []
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _graphs(batches):
    """Each text's nodes and edges: what training needs of it."""
    for batch in slices(batches):
        found = [observed(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(_GRAPH)]
        yield pa.RecordBatch.from_arrays([batch.column("h"), *columns], ["h", "x", "y", "possible", "edges"])


_GRAPH = [pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.int32()))]


def fit(docs: DataFrame) -> dict:
    """The model from SAMPLE documents with candidates at most, by a hash of doc_id. Their graphs are gathered, no texts."""
    rows = texts(docs).where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"@|[0-9].{0,2}[0-9].{0,2}[0-9].{0,2}[0-9].{0,2}[0-9].{0,2}[0-9].{0,2}[0-9]"))
    n = docs.count()
    share = min(1.0, 5 * SAMPLE / max(1, n))  # of the few candidates' documents, first by hash, then by number
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    chosen = chosen.select(F.xxhash64("doc_id", F.lit(1)).alias("h"), "text").orderBy("h", "text").limit(SAMPLE)
    found = chosen.mapInArrow(_graphs, "h long, x array<array<int>>, y array<int>, possible array<array<double>>, edges array<array<int>>").collect()
    return learn([(r["x"], r["y"], r["possible"], r["edges"]) for r in sorted(found)])


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        kept("pii", dict)
        for batch in slices(batches):
            found = find(shared.value, batch.column("text").to_pylist())
            counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([listed(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs).mapInArrow(task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs with spans replaced in text; n_chars, where it is a whole number, counts the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def task(batches):
        kept("pii", dict)
        for batch in slices(batches):
            old = batch.column("text").to_pylist()
            found = find(shared.value, [t or "" for t in old])
            new = [None if t is None else redacted(t, s) for t, (_, s) in zip(old, found, strict=True)]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, batch.column("text").type)
            if "n_chars" in names and pa.types.is_integer(batch.column("n_chars").type):
                counts = [n if t is None else len(t) for t, n in zip(new, batch.column("n_chars").to_pylist(), strict=True)]
                columns[names.index("n_chars")] = pa.array(counts, batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(task, docs.schema)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans(docs, fit(docs))
