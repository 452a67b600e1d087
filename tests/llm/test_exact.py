"""Operators against brute force, the public libraries and exact round trips."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as hs

from cellmorph.llm import chat, common, language, media, packing, pieces, pii, search, simhash, toxicity
from cellmorph.llm.html_text import main_text
from cellmorph.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), 256).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for d, text in texts.items():
        pieces_ = sorted(by_doc[d], key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in pieces_), "<u4").tolist()
        assert ids == [*t.encode(text, add_special_tokens=False).ids, 1]
        assert list(itertools.accumulate((r["length"] for r in pieces_), initial=0))[:-1] == [r["start"] for r in pieces_]
        assert all(r["doc_tokens"] == len(ids) for r in pieces_)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, seq in by_seq.items():
        seq = sorted(seq, key=lambda r: r["offset"])
        assert list(itertools.accumulate((r["length"] for r in seq), initial=0))[:-1] == [r["offset"] for r in seq]
        assert sum(r["length"] for r in seq) == 256 or s == max(by_seq)
    whole = packing.sequences(spark.createDataFrame(rows, packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), 256).schema), 256)
    assert {len(r["ids"]) for r in whole.where("n_tokens = 256").collect()} == {256}


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=500, deadline=None)
@given(hs.one_of(hs.text(max_size=40), hs.lists(hs.sampled_from([*"ab1 .,'\n\t\r\x0b\x1c\x85\xa0\u2003\u3000é中🙂", "  ", "the", "'s", " <|endoftext|>", "<|endof"]), max_size=20).map("".join)))
def test_stretches_give_the_ids_of_the_whole(byte_bpe, text):
    for s in (text, f"{text}<|endoftext|>{text}"):
        assert np.frombuffer(packing.encoder()([s])[0], "<u2").tolist() == byte_bpe.encode(s, add_special_tokens=False).ids


def test_encoder_store_may_overflow(byte_bpe, texts, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 60)
    encode, some = packing.Encoder("byte_bpe_50k"), list(texts.values())
    for i in range(0, len(some), 20):
        assert [np.frombuffer(x, "<u2").tolist() for x in encode(some[i : i + 20])] == [byte_bpe.encode(t, add_special_tokens=False).ids for t in some[i : i + 20]]


def test_pack_query_fills_windows(spark, byte_bpe, texts):
    rows = QUERIES["op1_pack"](spark, SF).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, text in texts.items():
        ids, at = np.array([*byte_bpe.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s, seq in by_seq.items():
        seq = sorted(seq, key=lambda r: r["offset"])
        assert [r["offset"] for r in seq] == list(itertools.accumulate((r["length"] for r in seq), initial=0))[:-1]
        assert sum(r["length"] for r in seq) == 2048 or s == max(by_seq)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("small", [64, 1])
def test_simhash_equals_all_pairs(spark, small, monkeypatch):
    """Both ways through the index: pairs of small buckets, two-wildcard keys of large ones."""
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    rng = random.Random(5)
    prints = {rng.getrandbits(64)}
    for _ in range(400):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(np.array(sorted(prints), np.uint64).view(np.int64).tolist())
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    labels = {r["id"]: r["label"] for r in common.min_labels(links).collect()}
    want = components(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    assert {p: labels.get(p, p) for p in prints} == want


def test_fingerprint_by_hand():
    words = [w for w in re.split("[\x20\x09-\x0d]+", "One two\x0bTHREE four\n É".translate({i: i + 32 for i in range(65, 91)})) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(3)]
    bits = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint("One two\x0bTHREE four\n É") & (1 << 64) - 1 == bits
    assert simhash.fingerprint(" \n") == 0
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("A  b") & (1 << 64) - 1 == one


def test_op3_on_documents(spark, texts):
    got = {r["doc_id"]: r for r in QUERIES["op3_simhash"](spark, SF).collect()}
    prints = {d: simhash.fingerprint(t) & (1 << 64) - 1 for d, t in texts.items()}
    want = components(sorted(texts), [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if bin(prints[a] ^ prints[b]).count("1") <= 2])
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{prints[d]:016x}", want[d]) for d in texts}


def test_near_groups_against_all_pairs(spark):
    docs = duckdb.sql("select doc_id, coalesce(text, '') from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    sets = {d: set(simhash.shingles(simhash.words(t), 5)) for d, t in docs}
    at = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            at[x].append(d)
    counts = collections.Counter(p for v in at.values() for p in itertools.combinations(sorted(v), 2))
    links = [(a, b) for (a, b), n in counts.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    want = components(sorted(sets), links)
    got = {r["doc_id"]: r["group"] for r in simhash.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)
    assert len({(got[d], want[d]) for d in got}) == len(set(got.values())) == len(set(want.values()))  # nothing else is joined


def test_labels_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(500, 500), (300, 200), (200, 250)]
    got = {r["id"]: r["label"] for r in common.min_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


@settings(max_examples=500, deadline=None)
@given(hs.lists(hs.sampled_from([*"0123456789@.+- ()ab%_\n", "٣", "255", "1.2.3.4", "+1 (743) 555-3824", "4316522678525456", "x@y.zz"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    holds = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    assert pii.base_spans(text) == [[m.span() for m in re.finditer(p, text) if ok(m)] for p, ok in zip(PATTERNS, holds, strict=True)]


def test_field_follows_repetitions(texts):
    model = pii.train([t for t in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchnumpy()["text"]])
    text = "Call +1 (743) 555-3824 or (743) 555-3824, but order 1234567890 stays."
    (base, spans), (_, none) = pii.find(model, [text, "Order (743) 555-3824 and 1234567890."])
    assert [text[a:b] for a, b in spans[3]] == ["+1 (743) 555-3824", "(743) 555-3824"] and base[3] == spans[3][:1]
    assert none == [[], [], [], []]
    for base, spans in pii.find(model, list(texts.values())):
        assert all(set(b) <= set(s) for b, s in zip(base, spans, strict=True))


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@" * 1000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "a.b" * 100_000):
        pii.find({"unary": np.zeros((pii.FEATURES, 5)), "pair": np.zeros((2, 5, 5))}, [text])


def test_language_held_out(spark):
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in lang}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backs_off():
    counts = [("en", 0, "the", 9), ("de", 0, "der", 9), *(("en", len(g), g, 5) for g in ("th", "ing$", "n", "t")), *(("de", len(g), g, 5) for g in ("ung$", "n", "d"))]
    s = language.Scorer(language.fit(counts))
    assert s.predict("walking")[0] == "en" and s.predict("Handlung")[0] == "de"
    assert s.predict("123 !") == ("und", 0.0) and s.predict(None) == ("und", 0.0)
    assert s.predict("中文")[0] in ("de", "en")


def test_scorer_store_may_overflow(monkeypatch):
    monkeypatch.setattr(language, "CACHE", 50)
    monkeypatch.setattr(language, "STEP", 20)
    model = language.fit([("en", 1, c, i + 1) for i, c in enumerate("abcdefgh")] + [("de", 1, c, 9 - i) for i, c in enumerate("abcdefgh")])
    text = " ".join("".join(p) for p in itertools.product("abcdefgh", repeat=3))
    small = language.Scorer(model).predict(text)
    monkeypatch.setattr(language, "CACHE", 10_000)
    monkeypatch.setattr(language, "STEP", 10_000)
    large = language.Scorer(model).predict(text)
    assert small[0] == large[0] and small[1] == pytest.approx(large[1])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"select doc_id, max(toxic) from '{sf}/labels.parquet' group by 1").fetchall())
    rows = [r for r in QUERIES["op7_toxicity"](spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    bad = [r["score"] for r in rows if toxic.get(r["doc_id"]) == 1]
    good = [r["score"] for r in rows if toxic.get(r["doc_id"]) == 0]
    auc = np.mean([(b > np.array(good)).mean() for b in bad])
    assert auc > 0.93 and np.mean(np.array(good) >= 0.3) < 0.03 and np.mean(np.array(bad) >= 0.3) > 0.7


def test_toxicity_windows_do_not_matter():
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(["good", "day", "tree", "awful"] if i % 2 else ["good", "day", "tree", "river"], k=30)), i % 2, "en") for i in range(80)]
    s = toxicity.Scorer(toxicity.train(rows))
    text = " ".join(t for t, _, _ in rows)
    assert s.score(text, 7) == pytest.approx(s.score(text))
    assert s.score("an awful day") > s.score("a good day by the river")


@settings(max_examples=100, deadline=None)
@given(hs.binary(max_size=40_000))
def test_container_round_trip(data):
    payload = media.pad(data)
    stored = media.write_container(payload)
    (track,) = media.read_container(stored)
    assert media.payload_of(stored, track) == payload and len(payload) % 576 == 0 and payload[: len(data)] == data
    assert track["duration"] == len(payload) and track["codec"] == "raw " and track["keyframes"] == track["samples"][::16]


def test_container_large_boxes_and_broken_ones():
    wide = b"\0\0\0\1free" + (24).to_bytes(8, "big") + b"x" * 8
    assert [p[-1] for p, _, _ in media.walk(wide + b"\0\0\0\0mdatrest")] == [b"free", b"mdat"]
    for broken in (b"\0\0\0\xffmdat", b"\0\0\0\4mdat", b"\0\0"):
        with pytest.raises(ValueError):
            list(media.walk(broken))


def test_media_query(spark, texts):
    rows = QUERIES["op8_media"](spark, SF).collect()
    assert len(rows) == len(texts) and len({(texts[r["doc_id"]], r["media_sha256"], r["feature"]) for r in rows}) == len(set(texts.values()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


def test_pieces_of_documents(library, texts):
    c = pieces.codec()
    for t in texts.values():
        ids = library.encode(t)
        assert c.encode(t) == [*ids, 2] and c.decode(ids) == library.decode(ids)


@settings(max_examples=500, deadline=None)
@given(hs.one_of(hs.text(max_size=30), hs.lists(hs.sampled_from([*"abcdehinorst., '-\n\t▁é中_²", "  ", "the", "🙂", "ing.", "\x00"]), max_size=15).map("".join)))
def test_pieces_of_any_text(library, text):
    c = pieces.codec()
    ids = library.encode(text)
    assert c.encode(text) == [*ids, 2] and c.decode(ids) == library.decode(ids)
    assert "".join(x[2] for x in c.encode_parts(text))[1:] == library.decode(ids)


def test_pieces_query_equals_the_library(spark, library, texts):
    rows = QUERIES["op9_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]]), 2]
        decoded = library.decode(ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_pieces_are_decoded_from_ids(monkeypatch):
    c = pieces.Codec(public_tokenizers.path(pieces.MODEL))
    monkeypatch.setattr(c, "walk", lambda text: [c.plain["x"]] * len(text))
    assert c.encode_parts("ab")[0][2] == "xxx"  # other ids, other text


def test_top_k_sql(spark):
    assert same(QUERIES["op6_top_k"](spark, SF), connect(SF), ORACLE_SQL["op6_top_k"]) == ""


def test_top_k_many_shards(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 40)
    monkeypatch.setattr(search, "LEAF", 4)
    assert same(QUERIES["op6_top_k"](spark, SF), connect(SF), ORACLE_SQL["op6_top_k"]) == ""


def test_tree_prunes_nothing_it_needs():
    rng = np.random.default_rng(3)
    points = rng.integers(-300, 300, (500, 6))
    points[100:300] = points[0]
    tree = search.Tree(np.arange(500), points)
    queries = np.vstack([points[:40], rng.integers(-10**6, 10**6, (5, 6))])
    got = tree.search(np.arange(45), queries, np.full(45, -np.inf), 5)
    for i, q in enumerate(queries):
        want = sorted((-(points[j] @ q), j) for j in range(500) if j != i)[:5]
        assert got[i] == [(-s, j) for s, j in want]


def test_main_text_of_pages():
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        text = main_text(page)
        for block in text.split("\n\n"):
            assert block == " ".join(block.split()) and block
        assert "track(" not in text and "margin:0" not in text and "©" not in text


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div><div class="sidebar"><p>Side text that is quite long.</p></div>
{open}<h1>Title &amp; more</h1><p>One <a href=x>link</a> text.<br>More<p>Two&nbsp;b<form><p>Mail me</form><script>if(a<b){{"</p>"}}</script><div class="ad">Buy</div><p>End.</p>{close}
<section class="comments"><p>I disagree.</p></section><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize("frame", [("<article>", "</article>"), ("<div>", "</div>"), ("<main><article>", "</article></main>")])
def test_main_text_by_hand(frame):
    assert main_text(PAGE.format(open=frame[0], close=frame[1])) == "Title & more\n\nOne link text. More\n\nTwo b\n\nEnd."


def test_main_text_of_long_and_broken_pages():
    assert main_text("<p>" + "<b>x" * 50_000).startswith("xxx")
    assert main_text("a " + "<" * 10_000).startswith("a <")
    assert main_text("<!-- never closed") == ""


def call(i, name="reply", after=(), **arguments):
    return {"id": i, "name": name, "arguments": json.dumps(arguments), "after": list(after)}


def test_tool_calls(spark):
    said = {"tool_calls": [call("b", after=["a", "gone"], chars=1, prompt="x"), call("a", chars=2, prompt="é\n\"q\""), call("c", "nope"), call("d", chars="no", prompt="x"), call("e", after=["f"], chars=1, prompt=""), call("f", after=["e"], chars=1, prompt=""), call("g", prompt="x"), call("h", chars=1, prompt="x", odd=1)]}
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps(said)), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})), (2, 1, "assistant", "{not json")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = chat.messages(table)
    found = chat.format_chat(table, chat.parse_calls(messages), chat.parse_results(messages), chat.schema_table(spark)).collect()
    calls = {r["call_id"]: r for r in found if r["kind"] == "call"}
    assert {k: r["level"] for k, r in calls.items()} == {"a": 0, "b": 1, "c": 0, "d": 0, "e": -1, "f": -1, "g": 0, "h": 0}
    assert {k: r["status"] for k, r in calls.items()} == {"a": "ok", "b": "no result", "c": "unknown tool nope", "d": "bad type of chars", "e": "no result", "f": "no result", "g": "missing chars", "h": "unexpected odd"}
    assert calls["a"]["message"] == '{"arguments":{"chars":2,"prompt":"é\\n\\"q\\""},"id":"a","name":"reply","type":"call"}'
    results = {r["call_id"]: r for r in found if r["kind"] == "result"}
    assert results["a"]["message"] == '{"content":"ok","id":"a","type":"result"}' and results["zz"]["status"] == "no call"
    assert sum(r["kind"] == "message" for r in found) == 5
    later = spark.createDataFrame([(1, 0, "a", "reply", "{}", ["b"]), (1, 2, "b", "reply", "{}", []), (1, 4, "c", "reply", "{}", ["b", "d"]), (1, 4, "d", "reply", "{}", [])], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    assert {r["call_id"]: r["level"] for r in chat.levels(later).collect()} == {"a": -1, "b": 0, "c": 1, "d": 0}
    for r in found:
        parsed = json.loads(r["message"])
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["message"]


def test_op2_against_a_loop(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    by = {(c, t): (role, text) for c, t, role, text in rows}
    want = collections.Counter()
    for (c, t), (role, text) in by.items():
        want[c, None, t, "message", None, "ok", json.dumps({"content": text, "role": role, "type": "message"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] += 1

    def level(c, t):
        return 1 + level(c, t - 2) if by.get((c, t - 2), ("",))[0] == "user" else 0

    for (c, t), (role, text) in by.items():
        answered = by.get((c, t + 1), ("",))[0] == "assistant"
        if role == "user":
            args = {"chars": len(text), "lines": text.count("\n") + 1, "prompt": text}
            want[c, level(c, t), t, "call", f"turn:{t}", "ok" if answered else "no result", json.dumps({"arguments": args, "id": f"turn:{t}", "name": "reply", "type": "call"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] += 1
        if role == "assistant":
            called = by.get((c, t - 1), ("",))[0] == "user"
            want[c, level(c, t - 1) if called else None, t, "result", f"turn:{t - 1}", "ok" if called else "no call", json.dumps({"content": text, "id": f"turn:{t - 1}", "type": "result"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] += 1
    got = collections.Counter(tuple(r) for r in QUERIES["op2_chat"](spark, SF).collect())
    assert got == want


def test_pipeline_keeps_clean_and_drops_copies(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r["doc_id"] for r in rows}
    lang = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    assert kept <= set(lang) and len(kept) > 0.7 * len(lang)
    assert len({lang[d] for d in kept}) == len(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "pii", "packing"]
