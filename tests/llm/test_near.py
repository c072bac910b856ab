"""Groups of near duplicates against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkmart.llm import near, simhash
from sparkmart.llm.common import buffers

from .helpers import SCHEMA, awkward, empty, frame, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(UP))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def closure(sets):
    label = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    return label


def changed(rng, text, n):
    text = list(text)
    for at in rng.sample(range(len(text)), n):
        text[at] = f"c{rng.getrandbits(30)}"
    return text


def grouped(spark, texts):
    rows = [(k, " ".join(w), "en", "s", 0) for k, w in enumerate(texts)]
    return {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_no_pair_at_080_to_085_is_missed(spark):
    rng = random.Random(4)
    texts, pairs = [], []
    while len(pairs) < 400:
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([60, 100, 250]))]
        copy = changed(rng, base, {60: 1, 100: 2, 250: 5}[len(base)])
        if 0.8 <= similarity(shingles(" ".join(base)), shingles(" ".join(copy))) <= 0.85:
            pairs.append((len(texts), len(texts) + 1))
            texts += [base, copy]
    got = grouped(spark, texts)
    assert sum(got[a] == got[b] == a for a, b in pairs) / len(pairs) == 1  # recall


@pytest.mark.parametrize("block", [1024, 8])
def test_equals_brute_force(spark, monkeypatch, block):
    """One large group of near copies, a passage that many texts share, and similarities on both sides of 0.8."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "SAMPLE", 2)
    rng = random.Random(7)
    fresh = lambda n: [f"v{rng.randrange(50_000)}" for _ in range(n)]
    base = fresh(100)
    texts = [changed(rng, base, rng.randint(0, 3)) for _ in range(60)]
    for k in range(40):
        one = fresh(100)
        texts += [one, changed(rng, one, 1 + k % 4)]
    texts += [fresh(3), fresh(4), fresh(5), fresh(1)]
    assert grouped(spark, texts) == dict(enumerate(closure([shingles(" ".join(w)) for w in texts])))


def test_sketches_of_any_length_never_differ_in_more_bits_than_sets(spark):
    """Sets of up to 5,000 shingles, of one length and of others; long sets that have little in common are told apart."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 6000).astype(np.uint64)
    sets = [base[:0], base[:1], base[:300], base[:512], base[10:513], base[:1000], base[30:1060], base[:4090], base[:5000], base[900:6000], base[4090:]]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    got = near.sketches(np.concatenate(sets), edge).to_pylist()
    assert [64 * len(x) for x in got] == [512, 512, 512, 512, 512, 1024, 2048, 4096, 8192, 8192, 2048]
    whole = [set(x.tolist()) for x in sets]
    rows = [(a, b, got[a], got[b]) for a in range(len(sets)) for b in range(len(sets))]
    df = spark.createDataFrame(rows, "a int, b int, x array<long>, y array<long>").select("a", "b", near.apart(F.col("x"), F.col("y")).alias("apart"))
    for r in df.collect():
        assert r["apart"] <= len(whole[r["a"]] ^ whole[r["b"]]), r
        assert r["a"] != r["b"] or r["apart"] == 0
        if {r["a"], r["b"]} == {7, 10}:  # nothing in common
            assert 9 * r["apart"] > len(sets[7]) + len(sets[10])


def test_awkward_texts(spark):
    rows = [r for r in awkward() if r[0] is not None][:-3]
    got = {r["id"]: r["component_id"] for r in near.groups(frame(spark, rows)).withColumnRenamed("least", "component_id").collect()}
    want = closure([shingles(r[1]) for r in rows])
    assert got == {r[0]: rows[want[k]][0] for k, r in enumerate(rows)}
    assert near.groups(empty(spark)).collect() == []


def test_links_of_simhash_come_first_and_are_decided(spark, monkeypatch):
    monkeypatch.setattr(near, "ROUNDS", ())  # without the exact way: SimHash's links alone
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(400)] for _ in range(4)]
    texts += [changed(rng, t, n) for t in texts for n in (1, 1, 2, 2, 3)]
    texts += ["a b c a b c a b c".split(), "a b c a b c a b c a b c x".split()]
    words_of, texts = texts, [" ".join(t) for t in texts]
    fp = [int(simhash.exact_fingerprints(*buffers(pa.array([t])), 3)[0, 0]) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= 3]
    alike = [p for p in pairs if similarity(shingles(texts[p[0]]), shingles(texts[p[1]])) >= 0.8]
    got = grouped(spark, words_of)
    same = {(i, j) for j in range(len(texts)) for i in range(j) if got[i] == got[j]}
    assert alike and same and all(similarity(shingles(texts[i]), shingles(texts[j])) >= 0.8 for i, j in same)
    assert set(alike) <= same
