"""Near duplicates against all pairs, by kind of edit and by length."""

import random

import pytest

from cellmorph.llm import simhash


def linked(texts):
    sets = [set(simhash.shingles(simhash.words(t), 5)) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}


def groups(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["group"] for r in simhash.near_groups(docs).collect()}


def partition(n, links):
    of = list(range(n))
    for a, b in links:
        of = [of[a] if x == of[b] else x for x in of]
    return of


def same(got, want):
    pairs = {(got[i], want[i]) for i in range(len(want))}
    return len(pairs) == len(set(want)) == len({g for g, _ in pairs})


EDITS = {"appended": (300, 65), "long appended": (1000, 220), "little appended": (300, 25), "short": (9, 1), "twelve": (12, 1)}


@pytest.mark.parametrize("frequent", [simhash.FREQUENT, 0])
def test_near_groups_loses_no_kind_of_edit(spark, frequent, monkeypatch):
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for n, more in EDITS.values():
        for _ in range(15):
            base = draw(n)
            texts += [" ".join(base), " ".join(base + draw(more))]
    for _ in range(15):
        base = draw(25)
        texts += [" ".join(base), " ".join(base[:-1] + ["changed"])]
    links = linked(texts)
    assert len(links) == 15 * (len(EDITS) + 1)
    assert same(groups(spark, texts), partition(len(texts), links))


def test_near_groups_compares_all_of_a_bucket(spark, monkeypatch):
    """Forty groups of two that share a passage: in its buckets the pairs are similar only to each other."""
    monkeypatch.setattr(simhash, "FREQUENT", 0)
    # The passage's shingles come first in every text's order, so that groups meet there and nowhere else.
    real, passage = simhash._hashes, " ".join(f"p{i}" for i in range(40))
    shared = set(real(simhash.words(passage)).tolist())
    monkeypatch.setattr(simhash, "_hashes", lambda tokens: simhash.np.sort(simhash.np.array([x & 0xFFFF if x in shared else x | 1 << 63 for x in real(tokens).tolist()], simhash.np.uint64)))
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(100))
        texts += [f"{passage} {base}", f"{passage} {base} end of it"]
    links = linked(texts)
    assert len(links) == 40
    assert same(groups(spark, texts), partition(len(texts), links))


def test_near_groups_compares_few_of_a_family(spark, monkeypatch):
    """Copies with edits that keep them apart share the rest of their text, which is counted over all texts and indexed last:
    families that no sample shows bring no pairs of all their members."""
    monkeypatch.setattr(simhash, "SAMPLE_DOCS", 10, raising=False)  # of a form that counted in a sample
    compared, real = [], simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda pairs, *rest: compared.append((found := real(pairs, *rest))[1].count()) or found)
    rng = random.Random(5)
    draw = lambda n: [f"w{rng.randrange(30000)}" for _ in range(n)]
    texts = []
    for _ in range(10):
        base = draw(200)
        for _ in range(30):
            own = list(base)
            for at in range(9, 200, 20):
                own[at] = draw(1)[0]
            texts.append(" ".join(own))
    texts += [f"{t} end" for t in texts[:20]]
    links = linked(texts)
    assert len(links) == 20
    assert same(groups(spark, texts), partition(len(texts), links))
    assert sum(compared) < 500
