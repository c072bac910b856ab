import hashlib
from collections import Counter

import pytest

from sparkmart.llm import substring

from .helpers import SCHEMA, awkward, empty, frame, words


def brute(rows, window=13):
    least = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 2000])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    got = substring.dedup(frame(spark), digest=True).collect()
    assert Counter(map(tuple, got)) == Counter(brute(awkward()))


def test_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "BUCKET", 500)
    assert Counter(map(tuple, substring.dedup(frame(spark), digest=True).collect())) == Counter(brute(awkward()))


def test_texts_keep_all_columns_and_other_white_space(spark):
    df = frame(spark)
    got = substring.dedup(df)
    assert got.schema == df.schema
    kept = {(r[0], r[1], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in got.select("doc_id", "lang", "text").collect()}
    assert {(k[0], k[2]) for k in kept} == {(r[0], r[3]) for r in brute(awkward())}
    before = Counter((r["doc_id"], r["text"]) for r in df.collect())
    clean = {r[0] for r in brute(awkward()) if not r[2]}
    assert all(before[(r["doc_id"], r["text"])] for r in got.collect() if r["doc_id"] in clean - {None})


def test_empty_table(spark):
    assert substring.dedup(empty(spark), digest=True).collect() == []
    assert substring.dedup(empty(spark)).collect() == []


def test_cover_holds_every_difference():
    assert {(b - a) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_short_windows_are_refused(spark):
    with pytest.raises(ValueError):
        substring.dedup(empty(spark), window=12)


def test_a_passage_in_a_third_of_all_rows(spark):
    shared = " ".join(f"s{k}" for k in range(51))
    rows = [(k, f"own{k} {shared} end{k}" if k % 3 == 0 else f"alone{k} " * 20, "en", "s", 0) for k in range(300)]
    got = substring.dedup(spark.createDataFrame(rows, SCHEMA).repartition(8), digest=True).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert sum(r["n_removed"] for r in got if r["doc_id"] % 3 == 0) == 51 * 99
