"""ISO media containers: payloads stored as 8-bit samples of one track, read back through the sample tables.

`write_container` lays out ftyp, moov and mdat; `read_container` walks the nested boxes (32- and 64-bit
sizes), decodes stts, stss, stsc, stsz and stco/co64 and returns codec, duration and the byte range of
every sample and keyframe without looking into a sample.

Defined results: a null text is an empty payload, padded to one sample; a null or repeated doc_id is kept
as its own row; an empty table gives no rows; a text of any length is stored whole (64-bit sizes beyond 4 GB); other
columns are ignored, whatever their names; a container that breaks the format raises ValueError.
"""

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts

SAMPLE = 576
TIMESCALE = 8000
#: Every so many samples one is a keyframe; a chunk holds CHUNK samples.
KEYFRAMES, CHUNK = 16, 8
CODEC = b"raw "
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, unit: int = SAMPLE) -> bytes:
    return data + b"\xff" * (-len(data) % unit if data else unit)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _numbers(values) -> bytes:
    return struct.pack(f">{len(values)}I", *values)


def write_container(payload: bytes) -> bytes:
    """A file with one track whose samples are the payload's SAMPLE-byte units."""
    n = len(payload) // SAMPLE
    duration = n * SAMPLE
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK, 1)] if chunks else []) + ([(chunks + 1, rest, 1)] if rest else [])
    n_chunks = chunks + bool(rest)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    keys = range(1, n + 1, KEYFRAMES)

    def moov(first: int) -> bytes:
        wide = first + len(payload) > 0xFFFFFFFF
        offsets = [first + k * CHUNK * SAMPLE for k in range(n_chunks)]
        entry = _box(CODEC, b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
        table = _box(
            b"stbl", _full(b"stsd", _numbers([1]), entry), _full(b"stts", _numbers([1, n, SAMPLE])), _full(b"stss", _numbers([len(keys), *keys])),
            _full(b"stsc", _numbers([len(runs)]), *(_numbers(r) for r in runs)), _full(b"stsz", _numbers([SAMPLE, n])),
            _full(b"co64", _numbers([n_chunks]), struct.pack(f">{n_chunks}Q", *offsets)) if wide else _full(b"stco", _numbers([n_chunks, *offsets])),
        )
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", _numbers([1]), _full(b"url ", flags=1))), table)
        mdia = _box(b"mdia", _full(b"mdhd", _numbers([0, 0, TIMESCALE, duration]), struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"samples\0"), minf)
        tkhd = _full(b"tkhd", _numbers([0, 0, 1, 0, duration]), b"\0" * 8, struct.pack(">4H", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, flags=3)
        mvhd = _full(b"mvhd", _numbers([0, 0, TIMESCALE, duration, 0x10000]), struct.pack(">H", 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, _numbers([2]))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(head) + _box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, body start, body end) of every box, parents before children."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError("a box header is cut off")
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"the size of box {kind!r} doesn't fit its parent")
        yield (*path, kind), start + head, start + size
        if kind in _CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: int, per: int, code: str = "I") -> list[tuple]:
    (n,) = struct.unpack_from(">I", data, at + 4)
    flat = struct.unpack_from(f">{n * per}{code}", data, at + 8)
    return [flat[i : i + per] for i in range(0, len(flat), per)]


def read_container(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, samples [(offset, size)], keyframes [(offset, size)]."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"boxes": {}})
        elif b"trak" in path and kind not in _CONTAINERS:
            tracks[-1]["boxes"][kind] = at, end
    for track in tracks:
        boxes = track.pop("boxes")
        at = boxes[b"mdhd"][0]
        track["timescale"], track["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        at = boxes[b"stsd"][0]
        track["codec"] = data[at + 12 : at + 16].decode("latin-1")
        at = boxes[b"stsz"][0]
        same, n = struct.unpack_from(">II", data, at + 4)
        sizes = [same] * n if same else list(struct.unpack_from(f">{n}I", data, at + 12))
        chunks = [x for (x,) in (_table(data, boxes[b"co64"][0], 1, "Q") if b"co64" in boxes else _table(data, boxes[b"stco"][0], 1))]
        runs = _table(data, boxes[b"stsc"][0], 3)
        samples, k = [], 0
        for i, (first, per, _) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunks)
            for c in range(first - 1, last):
                place = chunks[c]
                for _ in range(per):
                    samples.append((place, sizes[k]))
                    place += sizes[k]
                    k += 1
        if k != n or any(place + size > len(data) for place, size in samples):
            raise ValueError("the sample tables don't fit the file")
        if sum(count * step for count, step in _table(data, boxes[b"stts"][0], 2)) != track["duration"]:
            raise ValueError("the time table doesn't add up to the duration")
        keys = [x - 1 for (x,) in _table(data, boxes[b"stss"][0], 1)] if b"stss" in boxes else range(n)
        track["samples"], track["keyframes"] = samples, [samples[i] for i in keys]
    return tracks


def payload_of(data: bytes, track: dict) -> bytes:
    return b"".join(data[at : at + size] for at, size in track["samples"])


def encode_containers(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's container."""

    def task(batches):
        for batch in slices(batches):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_container(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    return texts(docs).mapInArrow(task, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """The media column replaced by its facts: codec, timescale, duration, keyframes, payload and file digests."""

    def task(batches):
        for batch in slices(batches):
            rows = []
            for data in batch.column("media").to_pylist():
                (track,) = read_container(data)
                payload = payload_of(data, track)
                keys = [{"offset": a, "length": b} for a, b in track["keyframes"]]
                feature = f"{track['codec'].strip()}/{track['timescale']}/{track['duration']}/{len(track['samples'])}:" + ",".join(f"{a}+{b}" for a, b in track["keyframes"])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, track["codec"].strip(), track["timescale"], track["duration"], keys))
            kept = [batch.column("doc_id"), batch.column("n_bytes")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_KINDS), _KINDS, strict=True)], ["doc_id", "n_bytes", *_NAMES])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        task, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, timescale long, duration long, keyframes array<struct<offset:long,length:long>>"
    )


_NAMES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "keyframes"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]


def op8_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(encode_containers(spark.read.parquet(f"{sf_dir}/documents.parquet")))
