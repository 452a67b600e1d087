"""Concatenate and cut: documents become pieces of fixed token windows.

Pass 1 tokenises each document once, stores its ids, and notes its start within its own partition.
Prefix sums over the partitions' totals (one row each) turn that into a global offset. Pass 2 cuts at
the multiples of the window, so that a document crossing a cut yields boundary records: pieces whose
neighbours in the same document lie in the adjacent sequences. No document is moved by a shuffle.

Defined results: a null text is an empty one, so that a document is at least its end id; a null or
repeated doc_id is packed as its own document; an empty table gives no rows; other columns are ignored, whatever
their names; a text of any length is encoded as a whole and may fill many windows. Every sequence is full but the last, whose tail is the only padding.
"""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices, stored, texts

WINDOW = 2048
END_ID = 1
_END = END_ID.to_bytes(2, "little")
#: Partitions for which the offsets (16 bytes each) are sent to every executor; beyond, they are joined.
BROADCAST_PARTITIONS = 1_000_000

#: Stretches of text whose ids a process keeps, and the characters of one at most; a full store is emptied.
CACHE, LONGEST = 800_000, 64
#: Characters of the texts, and stretches, that are encoded at once.
SLICE, BLOCK = 1 << 20, 300
#: A space after a character that is no white space begins a token, whatever surrounds it, and so does one of these marks
#: after a letter: texts can be cut there.
_STRETCH = re.compile(r"\s*+(?:[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?])|\S+(?:(?! )\s+\S*)*)|\s+")
#: The vocabulary's special token parts the stretches of a block.
_BETWEEN = "<|endoftext|>"

class Encoder:
    """Ids (16-bit, little-endian) of texts by the public vocabulary's .json file; encodes each repeated stretch once."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.between = self.tokenizer.token_to_id(_BETWEEN)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= SLICE:
                out += self._encode(part)
                part, size = [], 0
        return out + self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [_STRETCH.findall(t) for t in texts]
        known = self.known
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = set().union(*cut)
        known |= self._ids(list(new))
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return out

    def _ids(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of each, many in one call."""
        special = [x for x in stretches if _BETWEEN in x]
        plain = [x for x in stretches if _BETWEEN not in x] if special else stretches
        found = [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch_fast(special, add_special_tokens=False)]
        out = dict(zip(special, found, strict=True))
        for i in range(0, len(plain), BLOCK):
            block = plain[i : i + BLOCK]
            ids = np.array(self.tokenizer.encode_batch_fast([_BETWEEN.join(block)], add_special_tokens=False)[0].ids, "<u2")
            raw, at = ids.tobytes(), 0
            for x, end in zip(block, [*(2 * np.flatnonzero(ids == self.between)).tolist(), len(raw)], strict=True):
                out[x] = raw[at:end]
                at = end + 2
        return out


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The process's encoder of a vocabulary."""
    return kept(("packing", name), lambda: Encoder(name))


def _tokenise(batches):
    encode, part, start = encoder(), TaskContext.get().partitionId(), 0
    for batch in slices(batches):
        ids, starts = [x + _END for x in encode(batch.column("text").to_pylist())], []
        for x in ids:
            starts.append(start)
            start += len(x) // 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())], ["part", "start", "doc_id", "ids"]
        )


def tokens(docs: DataFrame) -> DataFrame:
    """(part, start, doc_id, ids): 16-bit little-endian ids with the end id; start counts from the partition's first id."""
    return texts(docs).mapInArrow(_tokenise, "part int, start long, doc_id long, ids binary")


def global_offsets(tokenised: DataFrame) -> DataFrame:
    """(part, base): ids in all earlier partitions. One row per partition, so one task holds them."""
    totals = tokenised.groupBy("part").agg(F.max(F.col("start") + F.length("ids") / 2).cast("long").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def _cut(window):
    def cut(batches):
        for batch in slices(batches):
            rows = []
            for doc, first, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                at, n = 0, len(ids)
                while at < n:
                    place = first + at
                    size = min(n - at, window - place % window)
                    piece = ids[at : at + size].tobytes()
                    rows.append((doc, at, size, zlib.crc32(piece), n, place // window, place % window, piece))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _KINDS, strict=True)], _NAMES
            )

    return cut


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
_KINDS = [pa.int64()] * 7 + [pa.binary()]


def pack(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per piece with its ids (uint32, little-endian) and place: sequence_id, offset."""
    tokenised = stored(tokens(docs), "tokens")
    offsets = stored(global_offsets(tokenised), "offsets")
    if offsets.count() <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = tokenised.join(offsets, "part").select("doc_id", (F.col("base") + F.col("start")).alias("first"), "ids")
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def boundaries(pieces: DataFrame) -> DataFrame:
    """The boundary records: pieces of documents that a cut divides."""
    return pieces.where("length < doc_tokens")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>, n_tokens): the windows themselves; at most `window` pieces meet in a group.

    Each is padded to the window, unless its length is a power of two already.
    """

    def decode(batches):
        for batch in slices(batches):
            rows = []
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).tolist()
                n = len(ids)
                rows.append((key, ids if n & (n - 1) == 0 else ids + [pad_id] * (window - n), n))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.list_(pa.int32()), pa.int64()), strict=True)], ["sequence_id", "ids", "n_tokens"])

    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.mapInArrow(decode, "sequence_id long, ids array<int>, n_tokens long")


def op1_pack(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
