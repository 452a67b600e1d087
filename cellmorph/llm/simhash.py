"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments, so that two close fingerprints have a segment that differs by at
most one bit. Each segment is indexed once for each of its bits with that bit left out; two segments that
differ by one bit (or none) then share an index key, and an equality join brings their documents together.

Two operators share this: `hamming_components` links 64-bit fingerprints at two or fewer differing bits and
is exact; `near_groups` finds documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.8. Its first candidates are those of the same index over fingerprints of five-word shingles. Two sets
of that similarity often differ in more than two bits, so a second pass takes pairs that share one of the
rarest shingles of both (a prefix filter, which loses no pair). The similarity of whole sets verifies both.

Defined results: a null text is an empty one; documents without words have fingerprint zero and link like
any other; repeated rows are copies; a null doc_id is a document that can't name a component; an empty
table gives no rows; texts are read whole, whatever their length; other columns never reach the index,
whatever their names (and stay in the rows `keep_one` keeps).
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dealt, discard, kept, min_labels, slices, stored, texts

SEED = 42
#: Buckets of up to this many fingerprints are joined pair by pair, larger ones by two-wildcard keys.
SMALL_BUCKET = 64
SHINGLE, SIMILARITY = 5, 0.8
#: Keys (24 bytes a row) that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000
#: near_groups: so many shingles at most, those of most texts, are indexed last. Any order of shingles finds the same pairs;
#: this one keeps buckets small, and the rest of a text after a common shingle too short for most pairs.
FREQUENT = 1_000_000
#: Classes that a task remembers, so that copies that follow each other are indexed once; a full store is emptied.
SEEN = 1_000_000


def words(text: str) -> list[bytes]:
    """Runs of anything but space and \\x09-\\x0D, with A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split()


def shingles(tokens: list[bytes], k: int) -> list[bytes]:
    """Every k consecutive words joined by spaces; all words where there are fewer; none without words."""
    if len(tokens) < k:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(k)), strict=False)))


def majority(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Which bits are set in over half of the rows of hashes, shaped (rows, bytes), least significant first."""
    total = np.zeros(hashes.shape[1] * 8, np.int64)
    for i in range(0, len(hashes), step):
        total += np.unpackbits(hashes[i : i + step], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total * 2 > len(hashes)


def _print_of(found: list[bytes]) -> int:
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in found], "<u8")
    return int(np.packbits(majority(hashes.view(np.uint8).reshape(-1, 8)), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprint(text: str, k: int = 3) -> int:
    """The 64-bit SimHash of all shingles, repeats included, as a signed long."""
    return _print_of(shingles(words(text), k))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long) of every whole text."""

    def task(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t, k) for t in batch.column("text").to_pylist()], pa.int64())], ["doc_id", "fp"])

    return texts(docs).mapInArrow(task, "doc_id long, fp long")


_LOW = 0xFFFFFFFF


def _high(fp="fp"):
    return F.shiftrightunsigned(fp, 32)


def _low(fp="fp"):
    return F.col(fp).bitwiseAND(F.lit(_LOW))


def _without(value, *bits: int):
    return value.bitwiseAND(F.lit(_LOW & ~sum(1 << b for b in set(bits))))


def _tagged(tag: int, value):
    return value.bitwiseOR(F.lit(tag << 32))


def _masks(n: int):
    """An array of all 32-bit masks with n bits (1 or 2)."""
    return F.array(*[F.lit(1 << i if n == 1 else 1 << i | 1 << j).cast("long") for i in range(32) for j in range(1 if n == 1 else i)])


def hamming_links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to join all that differ in at most two bits.

    Of the two 32-bit halves either the high one differs by at most one bit, found under one of its 32
    one-wildcard keys, or the low one is equal, found under its own key: 33 index rows a fingerprint. A
    small bucket is joined with itself and verified. In a large bucket each fingerprint gets keys with two
    bits left out in all; the members of such a key differ by two bits at most, so the smallest stands for
    all and no pairs are made.
    """
    distinct = stored(distinct, "distinct")
    keys = [_tagged(i, _without(_high(), i)) for i in range(32)] + [_tagged(32, _low())]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(index.join(dealt(sizes), "key"), "buckets")
    small = members.where(F.col("n") <= SMALL_BUCKET)
    left, right = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = left.join(dealt(right), (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    tag = F.shiftright("key", 32)
    one, two = _masks(1), _masks(2)
    masks = F.when(tag == 32, two).when(tag == 0, F.concat(one, two)).otherwise(one)
    # Of the half that is not in the key; the masks' bits are left out of it.
    half = F.when(tag == 32, _high()).otherwise(_low())
    hot = members.where(F.col("n") > SMALL_BUCKET).select("key", "fp", half.alias("half"), F.explode(masks).alias("mask"))
    # Two bits left out here allow no difference there: the whole half there is part of such a key.
    exact = F.when((tag == 0) & (F.bit_count("mask") == 2), _high()).otherwise(F.lit(-1))
    hot = hot.select("key", "fp", "mask", F.col("half").bitwiseAND(F.bitwise_not("mask")).alias("rest"), exact.alias("high"))
    stars = hot.groupBy("key", "mask", "rest", "high").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = hot.join(dealt(stars), ["key", "mask", "rest", "high"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    links = stored(pairs.union(linked).distinct(), "links")
    discard(distinct, members)
    return links


def hamming_components(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links of <= 2 bits."""
    prints = stored(fingerprints(docs, k), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = hamming_links(distinct.select("fp"))
    labels = min_labels(links)
    of_print = distinct.join(dealt(labels), F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    of_print = stored(of_print, "labels")
    discard(links)
    least = of_print.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(dealt(of_print.join(dealt(least), "label").select("fp", "component_id")), "fp")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = hamming_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _uid(tokens: list[bytes]) -> int:
    """64 bits of a text's words as a signed long: any two of 30 million texts share one by chance once in 40,000 runs."""
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) - (1 << 63)


def _hashes(tokens: list[bytes]) -> np.ndarray:
    """The set of a text's shingles, as ascending 64-bit hashes."""
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(tokens, SHINGLE)), np.uint64))


def _profile(batches):
    """The uid of each text's words and the fingerprint of its shingles."""
    kept("simhash", dict)
    for batch in slices(batches):
        uids, prints = [], []
        for text in batch.column("text").to_pylist():
            tokens = words(text)
            uids.append(_uid(tokens))
            prints.append(_print_of(shingles(tokens, SHINGLE)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(uids, pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "copy", "uid", "fp"])


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of shingles' hashes, under which they are counted."""
    return hashes.astype(np.uint32).view(np.int32)


def _counted(batches):
    """The shingles of each text; of texts that a task has met, once."""
    seen: set[int] = set()
    for batch in slices(batches):
        found = [np.zeros(0, np.int32)]
        for text in batch.column("text").to_pylist():
            tokens = words(text)
            if _is_new(_uid(tokens), seen):
                found.append(_short(_hashes(tokens)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["key"])


def _is_new(uid: int, seen: set[int]) -> bool:
    if uid in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(uid)
    return True


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys (`_short`) of shingles that more than two texts hold, of all texts, and their counts: those with the
    largest counts, FREQUENT at most."""
    counts = identified(docs).select("text").mapInArrow(_counted, "key int").groupBy("key").agg(F.count("*").cast("int").alias("n"))
    counts = stored(counts.where("n > 2"), "frequent")
    least, total = 2**31 - 1, 0
    for n, keys in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if (total := total + keys) > FREQUENT:
            break
        least = n
    found = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def least_common(n: int) -> int:
    """The fewest shingles that a set of n shares with one it is similar to."""
    return int(np.ceil(SIMILARITY * n - 1e-9))


def _prefixes(frequent: tuple[np.ndarray, np.ndarray]):
    """A task that gives the index rows (key, uid, n, at) of each text: of its n shingles in a global order (frequent ones
    last), so many that what is left can't hold all that two similar sets share. Similar sets have one of these in common."""
    keys, counts = frequent

    def task(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            found, uids, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                if not _is_new(uid := _uid(tokens), seen):
                    continue
                own = _hashes(tokens)
                if len(own) and len(keys):
                    short = _short(own)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    own = own[np.argsort(np.where(keys[at] == short, counts[at], 0), kind="stable")]
                found.append(own[: len(own) - least_common(len(own)) + 1 if len(own) else 0].view(np.int64).copy())
                uids.append(uid)
                sizes.append(len(own))
            rows = [len(x) for x in found]
            at = np.concatenate([np.arange(r, dtype=np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
            key = np.concatenate(found) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array(uids, np.int64), rows)), pa.array(np.repeat(np.array(sizes, np.int32), rows)), pa.array(at)], ["key", "uid", "n", "at"])

    return task


def _shingle_sets(batches):
    """32 bits of each shingle's hash: two texts of 500 shingles share one by chance once in 17,000 pairs."""
    for batch in slices(batches):
        sets = [np.unique(np.fromiter(map(xxhash.xxh32_intdigest, shingles(words(t), SHINGLE)), np.uint32)).view(np.int32) for t in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["uid", "hashes"])


def _can(n, at, m, to):
    """Whether sets of n and m shingles can be similar whose first common one, in the global order, has the places `at` and
    `to`: by their sizes, and by how many each has after these places. A similar pair passes in the bucket of its first
    common shingle, so testing this in every bucket loses none."""
    common = 1 + F.least(n - at - 1, m - to - 1)
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m) - 1e-6) & (common * (1 + SIMILARITY) >= SIMILARITY * (n + m) - 1e-6)


def identified(docs: DataFrame) -> DataFrame:
    """(row struct, doc_id, copy, text): copy tells texts of one doc_id apart, so rows equal in both are repeats."""
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), text.alias("text"))


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidates): those of the pairs (a, b) of classes whose shingle sets have the similarity, and the distinct
    pairs that were compared; only their texts are read."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ids = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    chosen = classes.join(dealt(ids), "uid").select("uid", "doc_id", "copy")
    sets = stored(_texts_of(chosen, docs).mapInArrow(_shingle_sets, "uid long, hashes array<int>"), "shingles")
    joined = pairs.join(dealt(sets.select(F.col("uid").alias("a"), F.col("hashes").alias("x"))), "a").join(dealt(sets.select(F.col("uid").alias("b"), F.col("hashes").alias("y"))), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = stored(joined.where(common >= SIMILARITY * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    discard(sets)
    return links, pairs


def _few(keys: DataFrame) -> DataFrame:
    """keys (stored) to be sent to every executor if there are BROADCAST_ROWS at most; else they are joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _texts_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, text) of chosen (uid, doc_id, copy); repeats of a row give the same text, so the first one does."""
    keys = _few(stored(chosen.select("uid", F.col("doc_id").alias("d"), F.col("copy").alias("c")), "chosen"))
    return identified(docs).join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))).select("uid", "text").dropDuplicates(["uid"])


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, uid, group) for every row of docs: group is the uid of one class of its near duplicates.

    Rows with the same words are one class from the start. Classes with fingerprints two bits apart are compared first.
    Then classes meet in the buckets of the shingle index: all of a bucket are compared with its middle, the member with
    the fewest rarer shingles, and last every pair of a bucket that is still in different components and passes the
    index's bounds, so no link between groups is lost. In a group of near copies the middle is what they are copies of,
    which links them all at once, and the bounds exclude those too far from it; few pairs are left."""
    profiles = stored(identified(docs).select("doc_id", "copy", "text").mapInArrow(_profile, "doc_id long, copy long, uid long, fp long"), "profiles")
    classes = stored(profiles.groupBy("uid").agg(F.min(F.struct("doc_id", "copy", "fp")).alias("c")).select("uid", "c.*"), "classes")
    links, tested = _similar(_signature_pairs(classes), classes, docs)
    index = identified(docs).select("text").mapInArrow(_prefixes(_frequent(docs)), "key long, uid long, n int, at int")
    # One shuffle for all rows of the index; most keys have one class and end here. Repeats of a class follow each other.
    bucket = Window.partitionBy("key").orderBy("at", "uid")
    buckets = index.select("*", F.first(F.struct("at", "uid", "n")).over(bucket).alias("middle"), F.lag("uid").over(bucket).alias("last"))
    buckets = buckets.where((F.col("uid") != F.col("middle.uid")) & (F.col("uid") != F.col("last")))
    buckets = stored(buckets.select("key", "uid", "n", "at", "middle", (F.col("last") == F.col("middle.uid")).alias("second")), "buckets")
    first = buckets.where(_can(F.col("n"), F.col("at"), F.col("middle.n"), F.col("middle.at")))
    more, compared = _similar(_untested(first.select(F.col("uid").alias("a"), F.col("middle.uid").alias("b")), tested), classes, docs)
    links, tested = stored(links.union(more), "links"), tested.union(compared)
    labels = stored(min_labels(links), "labels")
    # What is left: all pairs of a bucket that are in different components and were not compared.
    rest = buckets.select("key", "uid", "n", "at").union(buckets.where("second").select("key", "middle.uid", "middle.n", "middle.at"))
    rest = _labelled(rest, labels)
    mixed = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rest = stored(rest.join(mixed, "key"), "mixed")
    p, q = (rest.select("key", F.col("uid").alias(u), F.struct("n", "at", "label").alias(c)) for u, c in (("a", "p"), ("b", "q")))
    apart = (F.col("a") < F.col("b")) & (F.col("p.label") != F.col("q.label")) & _can(F.col("p.n"), F.col("p.at"), F.col("q.n"), F.col("q.at"))
    more, compared = _similar(_untested(p.join(dealt(q), "key").where(apart).select("a", "b"), tested), classes, docs)
    if not more.isEmpty():
        links, old = stored(links.union(more), "links"), labels
        labels = stored(min_labels(links), "labels")
        discard(old)
    discard(buckets, rest, compared)
    of_class = stored(classes.select("uid").join(dealt(labels), F.col("uid") == F.col("id"), "left").select("uid", F.coalesce("label", "uid").alias("group")), "classes")
    out = stored(profiles.join(dealt(of_class), "uid").select("doc_id", "copy", "uid", "group"), "groups")
    discard(classes, labels, links, profiles, of_class)
    return out


def _signature_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (uid, fp) by the deletion-variant index: those of one fingerprint meet its smallest, and the
    smallest of two fingerprints at two or fewer bits meet each other."""
    heads = stored(classes.groupBy("fp").agg(F.min("uid").alias("head")), "heads")
    near = hamming_links(heads.select("fp"))
    near = near.join(dealt(heads.select(F.col("fp").alias("a"), F.col("head").alias("x"))), "a").join(dealt(heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))), "b").select("x", "y")
    same = classes.join(dealt(heads), "fp").where("uid <> head").select("uid", "head")
    return same.union(near).toDF("a", "b")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(dealt(labels.select(F.col("id").alias("uid"), "label")), "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(dealt(tested), ["a", "b"], "left_anti")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: that with the smallest doc_id (nulls last).

    The rows themselves are filtered where they are; only if rows repeat do those kept go through a shuffle."""
    groups = near_groups(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "copy")
    kept = groups.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("doc_id"), F.col("k.copy").alias("copy"))
    rows = groups.groupBy("doc_id", "copy").agg(F.count("*").alias("m")).alias("r")
    kept = kept.withColumn("kept", F.lit(1)).alias("k")
    marked = stored(rows.join(dealt(kept), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.copy") == F.col("k.copy")), "left").select(F.col("r.doc_id").alias("d"), F.col("r.copy").alias("c"), "m", "kept"), "kept")
    repeats = marked.where("m > 1 and kept = 1").limit(1).count()
    dropped = _few(stored(marked.where("kept is null").select("d", "c"), "dropped"))
    rows = identified(docs).join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left_anti")
    discard(groups, marked)
    return (rows.dropDuplicates(["doc_id", "copy"]) if repeats else rows).select("row.*")
