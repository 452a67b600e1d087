"""Language identification, words first: a known word scores by its log frequency in each language, an unseen
word by the longest known character n-gram at each of its places, from four characters down to one.

The counts come from a bounded sample: at most DOCS_PER_LANGUAGE documents of each language (chosen by a
hash of doc_id). Their words and n-grams are known if they occur SEEN times in all; one that occurs less is unseen.

Defined results: a null text, or one without a letter, is `und` with score 0; without any learned language
every text is; a null doc_id is scored, not held out, and not learned from; an empty table gives no rows; a text of
any length is scored as a whole; of languages with equal scores the first by name is predicted; other columns are
ignored (`accepted` keeps them), whatever their names.
"""

import re
import uuid
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, kept, slices, texts

FOLDS = 5
DOCS_PER_LANGUAGE = 4000
SEEN = 2
LONGEST = 4
#: Words whose n-gram scores a process keeps; a full store is emptied.
CACHE, STEP = 100_000, 20_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def _count(batches):
    words = defaultdict(Counter)
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words[lang].update(_WORD.findall(text.lower()))
    rows = []
    for lang, counts in words.items():
        rows += [(lang, 0, w, n) for w, n in counts.items()]
        grams = Counter()
        for w, n in counts.items():
            w = f"^{w}$"
            for size in range(1, LONGEST + 1):
                for i in range(len(w) - size + 1):
                    grams[w[i : i + size]] += n
        rows += [(lang, len(g), g, n) for g, n in grams.items()]
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 20_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "size", "token", "n"])


def sample(docs: DataFrame, kind: str, limit: int) -> DataFrame:
    """About `limit` rows of each value of column `kind` at most, by a hash of doc_id; all where there are fewer."""
    sizes = {r[0]: r[1] for r in docs.groupBy(kind).count().collect()}
    if not sizes or max(sizes.values()) <= limit:
        return docs
    part = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, limit / n))) for k, n in sizes.items()))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part[F.col(kind)] * 1_000_003)


def train(docs: DataFrame) -> dict:
    """The model learned from docs (doc_id, text, lang): languages, known tokens, their log frequencies."""
    rows = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = sample(rows, "lang", DOCS_PER_LANGUAGE).select("lang", "text").mapInArrow(_count, "lang string, size int, token string, n long")
    counts = counts.groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("size", "token").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("of")).where(F.col("all") >= SEEN)
    found = counts.select(F.explode("of").alias("of"), "size", "token").select("of.lang", "size", "token", "of.n").toArrow()
    return fit(zip(*(found.column(c).to_pylist() for c in ("lang", "size", "token", "n")), strict=True))


def fit(found) -> dict:
    """Log frequencies, add-one smoothed, of (lang, size, token, n) rows; size 0 is a word."""
    place: dict = {}  # of (size, token) in the table
    of_lang: dict = {}
    cells = [(place.setdefault((size, token), len(place)), of_lang.setdefault(lang, len(of_lang)), n) for lang, size, token, n in found]
    languages = sorted(of_lang)
    to = np.array([languages.index(x) for x in of_lang], np.int64)
    table = np.zeros((len(place), len(languages)))
    if cells:
        rows, columns, n = np.array(cells, np.int64).T
        np.add.at(table, (rows, to[columns]), n)
    sizes = np.fromiter((size for size, _ in place), np.int64, len(place))
    totals = np.ones((LONGEST + 1, len(languages)))
    np.add.at(totals, sizes, table + 1)
    scores = np.log((table + 1) / totals[sizes])
    vectors = np.concatenate([np.zeros((1, len(languages))), scores - scores.mean(1, keepdims=True)]) if cells else np.zeros((1, 0))
    words = {token: k + 1 for (size, token), k in place.items() if not size}
    grams = {token: k + 1 for (size, token), k in place.items() if size}
    return {"id": uuid.uuid4().hex, "languages": languages, "words": words, "grams": grams, "vectors": vectors.astype(np.float32)}


class Scorer:
    """Predicts with a model; keeps the vectors of unseen words it has met."""

    def __init__(self, model: dict):
        self.languages, self.grams, self.words = model["languages"], model["grams"], model["words"]
        self.base = len(model["vectors"])
        self.vectors = np.concatenate([model["vectors"], np.zeros((CACHE, len(self.languages)), np.float32)])
        self.rows = dict(self.words)  # of known words and of unseen ones met so far

    def learn(self, words: set[str]) -> None:
        """Gives rows to unseen words: the mean over a word's places of the longest known n-gram's vector."""
        if len(self.rows) - len(self.words) + len(words) > CACHE:
            self.rows = dict(self.words)
        get, flat, starts = self.grams.get, [], []
        for word in words:
            w = f"^{word}$"
            starts.append(len(flat))
            for i in range(len(w)):
                for j in range(min(i + LONGEST, len(w)), i, -1):
                    if (g := get(w[i:j])) is not None:
                        flat.append(g)
                        break
            if len(flat) == starts[-1]:
                flat.append(0)  # a vector of zeros: nothing of the word is known
        first = self.base + len(self.rows) - len(self.words)
        sizes = np.diff([*starts, len(flat)])
        self.vectors[first : first + len(starts)] = np.add.reduceat(self.vectors[flat], starts, axis=0) / sizes[:, None]
        self.rows.update(zip(words, range(first, first + len(starts)), strict=True))

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower())) if text else None
        if not counts or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.languages))
        words, numbers = list(counts), np.fromiter(counts.values(), float, len(counts))
        for i in range(0, len(words), STEP):  # a step's unseen words fit the store
            part = words[i : i + STEP]
            if unseen := set(part).difference(self.rows):
                self.learn(unseen)
                if not unseen.union(part) <= self.rows.keys():  # the store was emptied of older words of this step
                    self.learn(set(part).difference(self.rows))
            total += numbers[i : i + STEP] @ self.vectors[list(map(self.rows.__getitem__, part))]
        total /= np.sqrt(numbers.sum())
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def scorer(model) -> Scorer:
    """The process's scorer of a broadcast model: tasks that follow each other share what it has met."""
    return kept(("language", model.value["id"]), lambda: Scorer(model.value))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = scorer(shared)
        for batch in slices(batches):
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(task, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns unchanged, whose text has a language: not `und`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        own = scorer(shared)
        for batch in slices(batches):
            keep = [own.predict(t)[0] != UNKNOWN for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(crc_mod("doc_id", FOLDS) != 0))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
