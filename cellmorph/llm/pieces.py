"""SentencePiece (merge type, byte fallback) encoding by backtracking, and decoding.

A text is cut where no merge can reach across (before a space mark, around a line feed, between a letter and a punctuation mark). In a chunk an
Aho-Corasick automaton finds the longest vocabulary entry at each place; a walk takes it, steps back to
the next shorter prefix whenever the entry is incompatible with the one before it, and marks places that
lead nowhere in a bit field. Two entries are compatible if merging their joint characters again gives just
these two. The walk's only full path is the one the merge order would give. A chunk's ids are decoded once, and both
are kept while the chunk repeats.

Defined results: a null or empty text is the end id alone; unknown characters are byte ids; a null or
repeated doc_id is kept as its own row; an empty table gives no rows; a text of any length is encoded as a whole; of
merges with equal scores the leftmost is first; other columns are ignored, whatever their names.
"""

import hashlib
import heapq
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, slices, texts

MODEL = "piece_bpe_32k.model"
END_ID = 2
SPACE = "▁"
#: Entries of each per-process cache; a full cache is emptied, which changes speed alone.
CACHE = 400_000

def codec(path: str | None = None) -> "Codec":
    path = path or public_tokenizers.path(MODEL)
    return kept(("pieces", path), lambda: Codec(path))


class Codec:
    """The vocabulary of a model file with its own encoder and decoder; the library only reads the file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.plain = {self.pieces[i]: i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = {i: model.get_score(i) for i in self.plain.values()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in range(n) if model.is_control(i)}
        self.unknown, self.mark = model.unk_id(), model.piece_to_id(SPACE)
        self.known = {p for p in self.plain if len(p) == 1}
        self.length = {i: len(p) for p, i in self.plain.items()}
        self.pairs: dict = {}
        self.chunks: dict = {}
        # Entries that merging can't build never occur.
        live = {p: i for p, i in self.plain.items() if self.merged(p) == [i]}
        self.automaton = ahocorasick.Automaton()
        for p, i in live.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.shorter = {i: next((live[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in live), None) for p, i in live.items()}
        inner = {p for p in live if SPACE in p[1:] and p.strip(SPACE)}
        if inner or any("\n" in p for p in live):
            raise ValueError("entries reach across a space mark or line feed: chunks can't be cut there")
        # Letters after which no entry goes on with a punctuation mark.
        odd = "".join(sorted({re.escape(p[m.start()]) for p in live for m in _ACROSS.finditer(p)}))
        self.cut = re.compile(rf"{SPACE}*+[^\W\d_{odd}]++(?={_MARKS})|{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def merged(self, text: str) -> list[int]:
        """The merge procedure itself, for one or two entries: best score first, leftmost on ties."""
        parts, after = list(text), list(range(1, len(text))) + [-1]
        before = list(range(-1, len(text) - 1))
        heap: list = []

        def offer(a: int):
            if a >= 0 and (b := after[a]) >= 0 and (i := self.plain.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, parts[a], parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = after[a]
            if b < 0 or parts[a] != left or parts[b] != right:
                continue
            parts[a], parts[b], after[a] = left + right, "", after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a])
            offer(a)
        out, a = [], 0
        while a >= 0:
            out.append(self.plain.get(parts[a]))
            a = after[a]
        return out

    def compatible(self, left: int, right: int) -> bool:
        key = left << 16 | right
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= 2 * CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return found

    def walk(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        longest = [None] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end + 1 - size] = i  # ends ascend, so the longest is written last
        out, at, failed = [], 0, bytearray(n + 1)
        token = longest[0]
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + self.length[token]
                if not failed[end] and (last is None or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            else:
                failed[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def chunk(self, text: str) -> tuple[str, int, str]:
        """(decimal ids joined by spaces, their number, the text they decode to) of a chunk."""
        if all(map(self.known.__contains__, text)):
            ids = self.walk(text)
        else:
            ids, run = [], []
            for c in text:
                if c in self.known:
                    run.append(c)
                    continue
                if run:
                    ids += self.walk("".join(run))
                    run = []
                ids += [self.bytes[b] for b in c.encode()]
            if run:
                ids += self.walk("".join(run))
        return " ".join(map(str, ids)), len(ids), self.decode([self.mark, *ids])

    def encode_parts(self, text: str) -> list[tuple[str, int, str]]:
        if not text:
            return []
        get, out = self.chunks.get, []
        for c in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            if (x := get(c)) is None:
                x = self.chunk(c)
                if len(c) <= 64:
                    if len(self.chunks) >= CACHE:
                        self.chunks.clear()
                    self.chunks[c] = x
            out.append(x)
        return out

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [int(i) for ids, _, _ in self.encode_parts(text) for i in ids.split()] + [END_ID]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: space marks are spaces, the first one goes, byte ids are UTF-8 with U+FFFD for broken ones."""
        out, raw = [], bytearray()
        first = True
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw, first = bytearray(), False
            if i in self.hidden:  # as the end id
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i]
            if first and i != self.unknown:
                piece = piece[1:] if piece.startswith(SPACE) else piece
            first = False
            out.append(piece.replace(SPACE, " ") if i != self.unknown else piece)
        if raw:
            out.append(_utf8(raw))
        return "".join(out)


_MARKS = r"[.,;:!?|$%&*#()\"'-]"
_ACROSS = re.compile(rf"[^\W\d_]{_MARKS}")


def _utf8(raw: bytes) -> str:
    """Whole characters where they are; one U+FFFD for each byte that is part of none."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + size]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def encode(docs: DataFrame, with_ids: bool = True, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]) per document."""

    def task(batches):
        c = codec(path)
        for batch in slices(batches):
            n, ids_hash, text_hash, ids_out, text_out = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                parts = c.encode_parts(text)
                ids = " ".join([*(x[0] for x in parts), str(END_ID)])
                decoded = "".join([x[2] for x in parts])[1:]  # the first space mark goes, as in decode()
                n.append(sum([x[1] for x in parts]) + 1)
                ids_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids_out.append([int(i) for i in ids.split()])
                    text_out.append(decoded)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return texts(docs).mapInArrow(task, kind + (", ids array<int>, decoded string" if with_ids else ""))


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
