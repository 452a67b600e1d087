"""op8_media's digests and lengths against the payload made by hand."""

import hashlib
import zlib

import duckdb

from cellmorph.llm import media
from cellmorph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_digests_of_every_document(spark):
    want = {}
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        box = media.write_container(payload)
        want[i] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(box), hashlib.sha256(box).hexdigest())
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) for r in QUERIES["op8_media"](spark, SF).collect()}
    assert got == want
