"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its own hash and its prefixes' (so that inflected and compound
forms of a stem are alike). Filters of one, two and three words slide over a text, each keeps its largest
response, and a logistic layer adds them up. Products of embedding and filter are kept per word, so that
scoring is adding rows.
The logit is shifted by a threshold of the text's language, which is recognised from its words.

It learns from every labelled document outside the held-out fold; a fifth of them (by a hash of the text) only calibrates. They are
dealt by doc_id and packed into chunks once. A pass takes every chunk from the same parameters through its own documents, and Spark adds
up how far each moved them (as whole numbers: the same in any order); the driver holds only parameters and a histogram of logits.

Defined results: a null or empty text gets the score of no words; a null doc_id is scored, not held out
and not learned from; repeated labels of a document count once (the largest); without any toxic or any
clean label every score is the share of toxic labels (0 without labels); an empty table gives no rows; a text of any
length is scored as a whole; of languages that fit a text equally the first by name sets the threshold; a score equal
to THRESHOLD is toxic; other columns are ignored (`accepted` keeps them), whatever their names.
"""

import re
import uuid
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, kept, slices, stored, texts

FOLDS, HELD_OUT = 4, 2
#: Documents and tokens of a chunk: no limit to how many chunks there are.
SHARD, TOKENS = 3000, 1 << 21
BUCKETS, SIZE, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 6
EPOCHS, BATCH, REFRESH, RATE, DECAY = 8, 32, 16, 0.05, 1e-4
#: Passes over all labelled documents: EPOCHS while there are few, FEWEST from ENOUGH / FEWEST documents on.
FEWEST, ENOUGH = 3, 30_000
DENSE = -(-(sum(WIDTHS) * SIZE * FILTERS + len(WIDTHS) * FILTERS + 1) // SIZE) * SIZE
#: Moves and losses are added as whole numbers of 1 / SCALE; logits are counted in bins of 1 / FINE.
SCALE, FINE, BINS, LOGITS = 1 << 32, 256, 80 * 256, BUCKETS + DENSE // SIZE
THRESHOLD = 0.3
#: Toxic documents of a language that its own threshold takes; below, the common one holds.
CALIBRATE = 15
_WORD = re.compile(r"[^\W_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Words whose rows a process keeps; a full store is emptied.
CACHE = 150_000


def features(word: str) -> list[int]:
    """Buckets of a word and its proper prefixes, 0 for those it is too short for."""
    found = [1 + zlib.crc32(word.encode()) % (BUCKETS - 1)]
    return found + [1 + zlib.crc32(f"{word[:n]}*".encode()) % (BUCKETS - 1) if n < len(word) else 0 for n in PREFIXES]


class Numbers(dict):
    """Words numbered from 1 as they come; 0 stands before and after a text."""

    def __init__(self):
        self.features = array("i", [0] * (1 + len(PREFIXES)))

    def __missing__(self, word: str) -> int:
        self.features.extend(features(word))
        found = self[word] = len(self) + 1
        return found

    def tokens(self, text: str) -> np.ndarray:
        ids = list(map(self.__getitem__, _WORD.findall(text.lower())))
        return np.array([0, *ids, 0, 0], np.int32)


def packed(rows):
    """Chunks of (text, toxic, lang) rows, SHARD documents or TOKENS tokens at most (one longer text is a chunk): words numbered within the chunk, places for the features of each."""
    numbers, ids, toxic, fold, langs, size = Numbers(), [], [], [], [], 0
    for t, y, lang in rows:
        ids.append(numbers.tokens(t))
        toxic.append(y)
        fold.append(zlib.crc32(t.encode()) % 5 == 0)
        langs.append(lang)
        size += len(ids[-1])
        if len(ids) == SHARD or size >= TOKENS:
            yield _chunk(numbers, ids, toxic, fold, langs)
            numbers, ids, toxic, fold, langs, size = Numbers(), [], [], [], [], 0
    if ids:
        yield _chunk(numbers, ids, toxic, fold, langs)


def _chunk(numbers, ids, toxic, fold, langs) -> dict:
    return {"features": np.frombuffer(numbers.features, np.int32), "ids": np.concatenate(ids), "ends": np.cumsum([len(x) for x in ids], dtype=np.int64), "toxic": np.array(toxic, np.int8), "fold": np.array(fold, np.int8), "langs": langs}


_TYPES = {"features": np.int32, "ids": np.int32, "ends": np.int64, "toxic": np.int8, "fold": np.int8}


def _opened(chunk: dict):
    """(features of words, token arrays of documents, toxic, calibrates) of a chunk."""
    return chunk["features"].reshape(-1, 1 + len(PREFIXES)), np.split(chunk["ids"], chunk["ends"][:-1]), chunk["toxic"].astype(float), chunk["fold"].astype(bool)


def _merged(parts, width: int):
    """(places, n and values of each) added up: whole numbers, so the same in any order."""
    places, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in parts)]), return_inverse=True)
    rows = np.zeros((len(places), 1 + width), np.int64)
    if len(places):
        np.add.at(rows, at, np.concatenate([v for _, v in parts]))
    return places, rows


def _count(languages, chunk: dict):
    """By bucket: documents that hold it by fold and label, then tokens by language; at the end the documents by fold and label."""
    of_word, docs, y, fold = _opened(chunk)
    seen, sizes = np.zeros((4 + len(languages), BUCKETS), np.int64), np.zeros(4, np.int64)
    of_lang = {x: k for k, x in enumerate(languages)}
    spoken = np.repeat([of_lang.get(x, -1) for x in chunk["langs"]], [len(d) for d in docs])
    for d, label, held in zip(docs, y, fold, strict=True):
        kind = 2 * int(held) + int(label)
        seen[kind, np.unique(of_word[np.unique(d)])] += 1
        sizes[kind] += 1
    for k in range(len(languages)):
        words = np.bincount(chunk["ids"][spoken == k], minlength=len(of_word))
        np.add.at(seen[4 + k], of_word, words[:, None])
    found = np.concatenate([seen.ravel(), sizes])
    places = np.flatnonzero(found)
    return places, found[places, None]


def _views(dense: np.ndarray):
    """Filters (width, size, filters), output weights and bias (one value) in the vector that holds them."""
    found, at = [], 0
    for w in WIDTHS:
        found.append(dense[at : at + w * SIZE * FILTERS].reshape(w, SIZE, FILTERS))
        at += w * SIZE * FILTERS
    return [*found, dense[at : at + len(WIDTHS) * FILTERS], dense[at + len(WIDTHS) * FILTERS : at + len(WIDTHS) * FILTERS + 1]]


def _forward(x: np.ndarray, joint: np.ndarray):
    """(largest responses, not below zero, and their places) by filter of word vectors x, which end with two zero ones; rows of joint are all filters' offsets."""
    r, n, at, own = joint @ x.T, len(x) - 2, 0, []
    for w in WIDTHS:
        part = r[at : at + FILTERS, :n]
        for o in range(1, w):
            part = part + r[at + o * FILTERS : at + (o + 1) * FILTERS, o : o + n]
        own.append(part)
        at += w * FILTERS
    own = np.concatenate(own)
    where = own.argmax(1)
    return np.maximum(own[_EACH, where], 0), where


_EACH = np.arange(len(WIDTHS) * FILTERS)
#: Of the rows of joint: their filter and offset.
_FILTER = np.array([j * FILTERS + f for j, w in enumerate(WIDTHS) for _ in range(w) for f in range(FILTERS)])
_OFFSET = np.array([o for w in WIDTHS for o in range(w) for _ in range(FILTERS)])


def _joint(filters) -> np.ndarray:
    return np.concatenate([w[o].T for w in filters for o in range(len(w))]).astype(np.float32)


def _pass(state: dict, k: int, learn: bool, chunk: dict):
    """What a chunk adds to pass k: a histogram of logits, by recognised language, of the documents that calibrate; then, if it learns, how
    far its own documents move the parameters from those the pass began with."""
    of_word, docs, y, fold = _opened(chunk)
    held, own = (fold, ~fold) if state["folds"] else (np.ones(len(y), bool), np.ones(len(y), bool))
    emb, emb_steps, dense, dense_steps = (state[x].copy() for x in ("emb", "emb_steps", "dense", "dense_steps"))
    *filters, out, bias = _views(dense)
    *filter_steps, out_steps, bias_steps = _views(dense_steps)

    def of_words():
        return sum(emb[of_word[:, j]] for j in range(of_word.shape[1]))

    vectors, joint = of_words(), _joint(filters)
    tongue = sum(state["tongue"][of_word[:, j]] for j in range(of_word.shape[1]))
    parts = []
    if held.any():
        z = np.array([_forward(vectors[docs[i]], joint)[0] @ out + bias[0] for i in np.flatnonzero(held)])
        spoken = np.array([tongue[docs[i]].sum(0).argmax() for i in np.flatnonzero(held)])
        loss = np.logaddexp(0, z) - y[held] * z
        values = np.zeros((len(z), 1 + 2 * SIZE), np.int64)
        values[:, 0], values[:, 1], values[:, 2] = 1, y[held], np.rint(loss * SCALE)
        parts.append((LOGITS + spoken * BINS + np.clip(np.floor(z * FINE) + BINS // 2, 0, BINS - 1).astype(np.int64), values))
    if not learn:
        return _merged(parts, 2 * SIZE)
    order = np.flatnonzero(own)
    np.random.default_rng((zlib.crc32(chunk["ids"].tobytes()), k)).shuffle(order)
    for i in range(0, len(order), BATCH):
        if i // BATCH % REFRESH == 0:
            vectors = of_words()
        joint = _joint(filters)
        g_out, g_bias, g_joint = np.zeros_like(out), 0.0, np.zeros(joint.shape)
        touched, pushed = [], []
        for d, label in ((docs[j], y[j]) for j in order[i : i + BATCH]):
            x = vectors[d]
            pooled, where = _forward(x, joint)
            p = 1 / (1 + np.exp(-(pooled @ out + bias[0])))
            g = (p - label) * (min(state["weight"], 4) if label else 1)
            g_out += g * pooled
            g_bias += g
            back, at = (g * out * (pooled > 0))[_FILTER, None], where[_FILTER] + _OFFSET
            g_joint += x[at] * back
            touched.append(d[at])
            pushed.append(joint * back)
        g_filters = [g.reshape(w, FILTERS, SIZE).swapaxes(1, 2) for w, g in zip(WIDTHS, np.split(g_joint, np.cumsum(WIDTHS)[:-1] * FILTERS), strict=True)]
        for p, g, s in zip((*filters, out), (*g_filters, g_out), (*filter_steps, out_steps), strict=True):
            g = g / BATCH + DECAY * p
            s += g * g
            p -= RATE * g / np.sqrt(s)
        bias_steps += (g_bias / BATCH) ** 2
        bias -= RATE * g_bias / BATCH / np.sqrt(bias_steps)
        buckets = of_word[np.concatenate(touched)]
        some, place = np.unique(buckets, return_inverse=True)
        g = np.zeros((len(some), SIZE))
        np.add.at(g, place.reshape(buckets.shape), np.concatenate(pushed)[:, None, :] / BATCH)
        g[some == 0] = 0
        emb_steps[some] += g * g
        emb[some] -= RATE * g / np.sqrt(emb_steps[some])
    moved = np.flatnonzero((emb_steps != state["emb_steps"]).any(1))
    parts.append((moved, _fixed(emb[moved] - state["emb"][moved], emb_steps[moved] - state["emb_steps"][moved])))
    if len(order):
        parts.append((BUCKETS + np.arange(DENSE // SIZE), _fixed((dense - state["dense"]).reshape(-1, SIZE), (dense_steps - state["dense_steps"]).reshape(-1, SIZE))))
    return _merged(parts, 2 * SIZE)


def _fixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One (for n), a and b as whole numbers of 1 / SCALE."""
    return np.concatenate([np.ones((len(a), 1), np.int64), np.rint(np.concatenate([a, b], axis=1).astype(float) * SCALE).astype(np.int64)], axis=1)


def train(rows, seed: int = 7) -> dict:
    """A model from (text, toxic, lang) rows held here, in one pass after another over their chunks."""
    chunks = list(packed(rows))
    languages = {x for c in chunks for x in c["langs"] if x is not None}
    return _trained(lambda job, width: _merged([job(c) for c in chunks], width), sorted(languages), seed)


def _trained(added, languages: list[str], seed: int = 7) -> dict:
    """A model. added(job, width) gives the places at which job finds something in any chunk, and the sums over all chunks there.

    Each pass starts every chunk from the same parameters; a parameter then moves by the mean over the chunks that moved it."""
    places, rows = added(partial(_count, languages), 0)
    counts = np.zeros((4 + len(languages)) * BUCKETS + 4)
    counts[places] = rows[:, 0]
    seen, sizes = counts[:-4].reshape(-1, BUCKETS), counts[-4:].reshape(2, 2)
    n = sizes.sum()
    if not 0 < sizes[:, 1].sum() < n:
        return {"id": uuid.uuid4().hex, "share": float(sizes[:, 1].sum() / n) if n else 0.0, "documents": int(n)}
    folds = bool(0 < sizes[0, 1] < sizes[0].sum() and sizes[1].sum())
    seen_y, (n0, n1) = (seen[:2], sizes[0]) if folds else (seen[:2] + seen[2:4], sizes.sum(0))
    odds = np.log((seen_y[1] + 0.5) / (n1 + 1)) - np.log((seen_y[0] + 0.5) / (n0 + 1))
    df = seen_y.sum(0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    emb[:, 0] = np.clip(odds * df / (df + 8), -1, 3)
    emb[0] = 0
    dense = np.zeros(DENSE)
    *filters, out, bias = _views(dense)
    for w in filters:
        w[:] = rng.normal(0, 0.1, w.shape)
        w[:, 0, :2] += 1.0 / len(w)
    out[:], bias[:] = 0.3, -1.0
    tongue = seen[4:].T + 1 if languages else np.ones((BUCKETS, 1))
    tongue = np.log(tongue / tongue.sum(0))
    tongue = (tongue - tongue.mean(1, keepdims=True)).astype(np.float32)
    tongue[0] = 0
    state = {"emb": emb, "emb_steps": np.full(emb.shape, 1e-2), "dense": dense, "dense_steps": np.full(DENSE, 1e-2), "tongue": tongue, "folds": folds, "weight": n0 / n1}
    passes, best = max(FEWEST, min(EPOCHS, int(ENOUGH // n))), (np.inf,)
    for k in range(passes + 1):
        places, rows = added(partial(_pass, state, k, k < passes), 2 * SIZE)
        logits = places >= LOGITS
        loss = rows[logits, 2].sum() / SCALE / rows[logits, 0].sum()
        if k and not loss >= best[0]:
            best = (loss, state, places[logits] - LOGITS, rows[logits, :2])
        step = rows[~logits, 1:] / SCALE / rows[~logits, :1]
        of_emb = places[~logits] < BUCKETS
        state = state | {x: state[x].copy() for x in ("emb", "emb_steps", "dense", "dense_steps")}
        state["emb"][places[~logits][of_emb]] += step[of_emb, :SIZE].astype(np.float32)
        state["emb_steps"][places[~logits][of_emb]] += step[of_emb, SIZE:]
        if (~of_emb).any():
            state["dense"] += step[~of_emb, :SIZE].ravel()
            state["dense_steps"] += step[~of_emb, SIZE:].ravel()
    _, state, places, rows = best
    found = np.zeros((tongue.shape[1], BINS, 2))
    found[places // BINS, places % BINS] = rows
    common = _threshold(found.sum(0))
    cuts = [_threshold(x) if x[:, 1].sum() >= CALIBRATE and (x[:, 0] > x[:, 1]).any() else common for x in found]
    *filters, out, bias = _views(state["dense"])
    tables = np.concatenate([state["emb"] @ w[o] for w in filters for o in range(len(w))], axis=1)
    return {"id": uuid.uuid4().hex, "tables": np.asarray(tables, np.float32), "out": out.copy(), "bias": float(bias[0]), "tongue": tongue, "cuts": np.array(cuts), "documents": int(n)}


def _threshold(found: np.ndarray) -> float:
    """The logit above which calling texts toxic gives the best F1, from (texts, toxic ones) by bin of 1 / FINE: half way from the lowest bin taken to the next one with a text."""
    bins = np.flatnonzero(found[:, 0])[::-1]
    hits = np.cumsum(found[bins, 1])
    k = int((2 * hits / (np.cumsum(found[bins, 0]) + hits[-1])).argmax())
    nxt = bins[k + 1] + 1 if k + 1 < len(bins) else bins[k] - FINE
    return float((bins[k] + nxt) / 2 - BINS // 2) / FINE


class Scorer:
    """Scores with a model; keeps the rows (filter products, language log odds) of words it has met."""

    def __init__(self, model: dict):
        self.model, self.seen = model, {"": 0}  # row 0 stands before and after a text
        if "share" not in model:
            self.products = np.zeros((CACHE + 1, model["tables"].shape[1]), np.float32)
            self.tongue = np.zeros((CACHE + 1, model["tongue"].shape[1]), np.float32)

    def learn(self, words: set[str]) -> None:
        """Gives rows to words: sums over their features' buckets."""
        first = len(self.seen)
        buckets = np.array([features(w) for w in words])
        for i in range(0, len(buckets), 2048):
            at = slice(first + i, first + min(i + 2048, len(buckets)))
            self.products[at] = self.model["tables"][buckets[i : i + 2048]].sum(1)
            self.tongue[at] = self.model["tongue"][buckets[i : i + 2048]].sum(1)
        self.seen.update(zip(words, range(first, first + len(buckets)), strict=True))

    def score(self, text: str, step: int = 1 << 13) -> float:
        m = self.model
        if "share" in m:
            return m["share"]
        words = ["", *_WORD.findall(text.lower()), "", ""]
        pooled, tongue = np.zeros(len(m["out"])), np.zeros(self.tongue.shape[1])
        for i in range(0, len(words) - 2, step):  # windows overlap by two words, which end the last filter
            part = words[i : i + step + 2]
            if unseen := set(part).difference(self.seen):
                if len(self.seen) + len(unseen) > CACHE:
                    self.seen = {"": 0}
                    unseen = set(part) - {""}
                self.learn(unseen)
            d = list(map(self.seen.__getitem__, part))
            tongue += self.tongue[d[:step]].sum(0)
            t, at = self.products[d], 0
            for j, w in enumerate(WIDTHS):
                n = len(t) - w + 1
                r = t[:n, at : at + FILTERS]
                for o in range(1, w):
                    r = r + t[o : o + n, at + o * FILTERS : at + (o + 1) * FILTERS]
                pooled[j * FILTERS : (j + 1) * FILTERS] = np.maximum(pooled[j * FILTERS : (j + 1) * FILTERS], r.max(0))
                at += w * FILTERS
        z = pooled @ m["out"] + m["bias"] - m["cuts"][int(tongue.argmax())]
        return float(1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -40, 40))))


def scorer(model) -> Scorer:
    """The process's scorer of a broadcast model: tasks that follow each other share what it has met."""
    return kept(("toxicity", model.value["id"]), lambda: Scorer(model.value))


def _pack(batches):
    def rows():
        for batch in slices(batches):
            yield from zip(*(batch.column(x).to_pylist() for x in ("text", "toxic", "lang")), strict=True)

    for c in packed(rows()):
        yield pa.RecordBatch.from_arrays([*(pa.array([c[x].tobytes()], pa.binary()) for x in _TYPES), pa.array([c["langs"]], pa.list_(pa.string()))], [*_TYPES, "langs"])


def _added(chunks: DataFrame, job, width: int):
    """The sums of what job finds in the chunks: tasks add up their own, Spark those of the tasks."""
    names = ["n", *(f"v{i}" for i in range(width))]
    shared = chunks.sparkSession.sparkContext.broadcast(job)

    def task(batches):
        found = _merged([], width)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = {x: np.frombuffer(batch.column(x)[row].as_buffer(), kind) for x, kind in _TYPES.items()}
                found = _merged([found, shared.value(chunk | {"langs": batch.column("langs")[row].as_py()})], width)
        places, rows = found
        for i in range(0, len(places), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(places[i : i + 20_000]), *(pa.array(v) for v in rows[i : i + 20_000].T.copy())], ["place", *names])

    found = chunks.mapInArrow(task, "place long, " + ", ".join(f"{x} long" for x in names)).groupBy("place").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    shared.unpersist()
    places = found.column("place").to_numpy()
    order = np.argsort(places)
    return places[order], np.stack([found.column(x).to_numpy()[order] for x in names], axis=1).reshape(len(places), 1 + width)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model learned from labels (doc_id, toxic) of documents outside the held-out fold: all of them, in every pass."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    parts = known.count() // SHARD + 1
    rows = docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    both = rows.repartition(parts, "doc_id").join(known.repartition(parts, "doc_id"), "doc_id").select(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id", "text", "toxic", "lang")
    chunks = stored(both.sortWithinPartitions("h", "doc_id", "text").select("text", "toxic", "lang").mapInArrow(_pack, ", ".join(f"{x} binary" for x in _TYPES) + ", langs array<string>"), "toxicity")
    languages = [r[0] for r in chunks.select(F.explode("langs").alias("lang")).where("lang is not null").distinct().collect()]
    model = _trained(lambda job, width: _added(chunks, job, width), sorted(languages))
    discard(chunks)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every whole text; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = scorer(shared)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.score(t) for t in batch.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(task, "doc_id long, score double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns unchanged, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = scorer(shared)
        for batch in slices(batches):
            yield batch.filter(pa.array([own.score(t or "") < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
