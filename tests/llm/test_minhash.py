"""The near-duplicate stage against brute-force Jaccard similarity on planted near copies."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from platen.llm import minhash, simhash
from platen.llm.common import utf8

WORDS = [f"w{i}" for i in range(3000)]


def planted(seed=5, bases=30, copies=4):
    """Texts of 60 to 300 words, each with copies in which some words are others."""
    rng = random.Random(seed)
    out = ["", " \n", "one", "One ", "two words", "four words are here"]
    for _ in range(bases):
        base = rng.choices(WORDS, k=rng.randint(60, 300))
        out.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    return out


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(texts):
    """Pairs of similarity 0.8 or more, and the least member of each text's component."""
    sets = [grams(t) for t in texts]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = list(range(len(sets)))
    for i, j in pairs:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    return pairs, label


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    pairs, label = brute(texts)
    assert len(pairs) > 60
    got = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert got == set(label)


@pytest.mark.parametrize("hot", [2, 64])
def test_large_keys_find_the_same_components(spark, hot):
    texts = planted(6, 3, 40)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    root = {r.node: r.root for r in minhash.groups(rows, hot=hot).collect()}
    got = [root.get(i, i) for i in range(len(texts))]
    _, label = brute(texts)
    assert len(set(zip(got, label))) == len(set(got)) == len(set(label))


def test_shingles_and_similarity_by_brute_force():
    texts = planted(7, 6, 3)
    hashes, edges = minhash.shingles(*utf8(pa.array(texts)), 5)
    sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = grams(a), grams(b)
            assert minhash.similarity(sets[i], sets[j]) == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_stage_finds_near_prints_by_its_trees(spark, monkeypatch):
    """Without any MinHash key the trees alone bring together what lies within their radius."""
    texts = planted(8)
    bands = minhash.bands
    monkeypatch.setattr(minhash, "bands", lambda t, shingle: bands(t, shingle).where("false"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    pairs, _ = brute(texts)
    prints = [simhash.fingerprint_of(t.lower().encode().split(), 5) for t in texts]
    near = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= simhash.WIDE]
    assert len(near) > 30 and any((prints[i] ^ prints[j]).bit_count() > simhash.RADIUS for i, j in near)
    kept = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    assert not any(i in kept and j in kept for i, j in near)
    # And what they bring together is still compared: none of these is like another.
    alone = set(range(len(texts))) - {i for p in pairs for i in p}
    assert alone <= kept
