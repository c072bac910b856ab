import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sparkmart.llm import simhash
from sparkmart.llm.common import Scratch
from sparkmart.llm.components import star_edges

from .helpers import SCHEMA, awkward, empty, frame, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = words((text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(values, ids, most):
    """The least id that each can reach by steps of at most `most` bits."""
    label = list(range(len(values)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= most:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(values)):
        groups.setdefault(root(k), []).append(ids[k])
    return [min((i for i in groups[root(k)] if i is not None), default=None) for k in range(len(values))]


def test_equals_brute_force(spark):
    rows = awkward()
    got = simhash.groups_of(frame(spark)).collect()
    assert len(got) == len(rows)
    fps = [fingerprint(r[1]) for r in rows]
    with_id = [k for k, r in enumerate(rows) if r[0] is not None]
    want = dict(zip(with_id, closure([fps[k] for k in with_id], [rows[k][0] for k in with_id], 3)))
    expected = sorted((rows[k][0], f"{fps[k]:016x}", want[k]) for k in with_id)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None) == expected


def test_empty_table(spark):
    assert simhash.groups_of(empty(spark)).collect() == []
    assert simhash.near_duplicates(empty(spark)).collect() == []


def random_fingerprints(rng, n):
    """Clusters with steps of 1 to 5 bits, among random values."""
    out = []
    while len(out) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            out.append(centre)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                centre ^= 1 << b
    return list(dict.fromkeys(out))[:n]


def test_links_are_whole_with_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    values = random_fingerprints(random.Random(3), 500)
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(values)], "id long, fp binary").repartition(4)
    got = simhash.components(df, 3, 8, range(4, 6), Scratch(spark)).collect()
    assert {r["node"]: r["component_id"] for r in got} == dict(enumerate(closure(values, list(range(len(values))), 3)))


def test_plans_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    bits = rng.random((2000, 64)) < rng.random(64)
    joint = bits.T.astype(np.int64) @ bits
    for most in (3, 7):
        groups, thresholds = simhash.plan(len(bits), joint, most, range(2, 8))
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in thresholds) == most + 1


def correlated(rng, n):
    """Fingerprints whose bits come in runs that mostly agree, each with a rate of its own."""
    base = rng.random((n, 16)) < rng.random(16)
    bits = np.repeat(base, 4, axis=1) ^ (rng.random((n, 64)) < 0.05)
    return bits.astype(np.int64)


def test_estimates_are_near_the_counts():
    rng = np.random.default_rng(2)
    bits = correlated(rng, 3000)
    joint = bits.T @ bits
    for m in simhash.PARTS:
        for group in simhash.grouped_bits(len(bits), joint, m):
            part = bits[:, group].astype(np.float32)
            apart = np.rint(part.sum(1)[:, None] + part.sum(1)[None, :] - 2 * part @ part.T).astype(int)
            count = np.bincount(apart[np.triu_indices(len(bits), 1)], minlength=4)[:4].cumsum()
            guess = simhash.spread(len(bits), joint, group).cumsum() * len(bits) * (len(bits) - 1) / 2
            p = np.diag(joint)[group] / len(bits)
            alone = np.prod(1 - 2 * p * (1 - p)) * len(bits) ** 2 / 2
            print(m, len(group), "pairs that differ in 0, 1, 2, 3 bits at most:", count, "estimated:", guess.round(), "bit by bit:", round(alone))
            assert (guess > count / 3 - 20).all() and (guess < count * 3 + 20).all()
            assert count[0] > 5 * alone  # what takes bits as independent is far too low


def test_many_fingerprints_get_wider_keys():
    rng = np.random.default_rng(1)
    bits = (rng.random((2000, 64)) < 0.5).astype(np.int64)
    joint = bits.T @ bits
    sizes = []
    for n in (10**5, 10**7, 10**9, 10**11):
        groups, thresholds = simhash.plan(n, joint * (n // 2000), 3, simhash.PARTS)
        assert sum(t + 1 for t in thresholds) == 4
        sizes.append(max(len(g) for g, t in zip(groups, thresholds) if t >= 0))
    assert sizes == sorted(sizes) and sizes[0] <= 16 and sizes[-1] == 32


@pytest.mark.parametrize("m", simhash.PARTS)
def test_every_number_of_partitions_gives_the_same(spark, m):
    values = random_fingerprints(random.Random(m), 150)
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(values)], "id long, fp binary")
    got = simhash.components(df, 3, 8, m, Scratch(spark)).collect()
    assert {r["node"]: r["component_id"] for r in got} == dict(enumerate(closure(values, list(range(len(values))), 3)))


def test_thresholds_above_zero_miss_nothing(spark):
    values = random_fingerprints(random.Random(5), 200)
    df = spark.createDataFrame([(k, bytearray(v.to_bytes(8, "big"))) for k, v in enumerate(values)], "id long, fp binary")
    got = simhash.components(df, 3, 8, 2, Scratch(spark)).collect()  # two partitions: radii add up to two
    assert {r["node"]: r["component_id"] for r in got} == dict(enumerate(closure(values, list(range(len(values))), 3)))


def test_near_copies_share_a_group_and_others_do_not(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(400)] for _ in range(30)]
    rows = []
    for k, w in enumerate(base):
        rows.append((k, " ".join(w), "en", "s", 0))
        near = list(w)
        for at in rng.sample(range(400), 4):  # of 396 shingles at most 20 change
            near[at] = "changed"
        rows.append((100 + k, " ".join(near), "en", "s", 0))
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i % 100 for i in got} and len(got) == 60


def test_components_of_a_long_path(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r["u"]: r["v"] for r in star_edges(df, Scratch(spark)).collect()}
    assert got == {k: 0 for k in range(1, 300)} | {1001: 1000}
