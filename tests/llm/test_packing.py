import random
from collections import defaultdict

import numpy as np
import pytest

from sparkmart.llm import packing

from .helpers import awkward, empty, frame, words


@pytest.mark.parametrize("seed", range(20))
def test_every_choice_is_the_best_fit(seed):
    rng = random.Random(seed)
    n, cap = rng.randint(1, 300), rng.choice([10, 50, 100])
    sizes = np.array([rng.randint(0, cap * 2 if rng.random() < 0.1 else cap // 2) for _ in range(n)], np.int64)
    source = np.array([f"s{0 if rng.random() < 0.3 else rng.randint(0, 90)}" for _ in range(n)])
    group = np.array([rng.choice([1, rng.randint(2, 50), rng.randint(50, 10**6)]) for _ in range(n)], np.int64)
    bins = []
    for k, _, _, size, name, at in packing.pack(list(range(n)), sizes, source, group, cap):
        fits = [cap - used for used, s, g in bins if cap - used >= size and source[k] not in s and group[k] not in g]
        if name == len(bins):
            assert not fits
            bins.append([0, set(), set()])
        else:
            assert cap - bins[name][0] == min(fits)
        used, s, g = bins[name]
        assert at == used and source[k] not in s and group[k] not in g
        bins[name][0] += size
        s.add(source[k])
        g.add(group[k])
    assert sum(b[0] for b in bins) == sizes.sum()


def test_all_words_are_packed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rows = awkward()
    got = packing.packed(frame(spark), capacity=500).collect()
    by, bins = defaultdict(int), defaultdict(list)
    for r in got:
        by[r["doc_id"]] += r["n_units"]
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append((r["bin_offset"], r["n_units"], r["bin_units"]))
    want = defaultdict(int)
    for r in rows:
        want[r[0]] += len(words(r[1]))
    assert dict(by) == dict(want)
    for parts in bins.values():
        at = 0
        for offset, n, total in sorted(parts):
            assert offset == at
            at += n
        assert at == total <= 500
    assert sum(r["bin_id"] is None for r in got) == sum(not words(r[1]) for r in rows)


def test_sources_and_copies_conflict(spark):
    rows = [(k, "same words here", "en", f"s{k}", 0) for k in range(10)] + [(100 + k, f"other {k}", "en", "one", 0) for k in range(10)]
    got = packing.packed(frame(spark, rows)).collect()
    for half in (range(10), range(100, 110)):
        assert len({r["bin_id"] for r in got if r["doc_id"] in half}) == 10
    assert len({r["bin_id"] for r in got}) == 10


def test_empty_table(spark):
    assert packing.packed(empty(spark)).collect() == []


def test_a_hot_source_never_shares_a_bin(spark):
    """The whole query's path over two shards: a third of the rows are of one source, and some texts are copies."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 60))), "en", "hot" if k % 3 == 0 else f"s{k % 70}", 0) for k in range(9000)]
    rows += [(9000 + k, rows[k][1], "en", f"c{k}", 0) for k in range(300)]
    by = {r[0]: r for r in rows}
    bins = defaultdict(list)
    for r in packing.packed(frame(spark, rows, extra=False), capacity=100).collect():
        bins[r["bin_id"]].append(r)
    assert len({b >> 32 for b in bins}) == 2
    for parts in bins.values():
        sources, texts = [by[p["doc_id"]][3] for p in parts], [by[p["doc_id"]][1] for p in parts]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
        assert sum(p["n_units"] for p in parts) == parts[0]["bin_units"] <= 100
    assert len(bins) >= 3000
    assert sum(p["n_units"] for parts in bins.values() for p in parts) == sum(len(words(r[1])) for r in rows)
