import random

import numpy as np
import pytest

from sparkmart.llm import topk


def rows(seed=1, n=400, dim=6):
    rng = random.Random(seed)
    out = [(k, [float(np.float32(rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]))) for _ in range(dim)]) for k in range(n)]
    out += [(n + k, list(out[0][1])) for k in range(50)]  # ties
    out += [(900, None), (1000, [1.0, None]), (1100, [float("nan"), 1.0]), (1200, [float("inf"), 1.0]), (1300, []), (1400, [0.5, -0.5]), (None, [1.0] * dim), (5, list(out[9][1]))]
    return out


def brute(data, every, k=10):
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, w in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(128, 8192, 512), (4, 16, 3)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, v in zip(("BLOCK", "SHARD", "QUERIES"), sizes):
        monkeypatch.setattr(topk, name, v)
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>").selectExpr("*", "'x' as id", "'x' as w", "'x' as score").repartition(3)
    got = topk.search(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == brute(rows(), 100)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = topk.search(df, df.where("vec_id = 0")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 1024 * 2048), (0, 2, 2, -1024 * 1024)]
    one = df.where("vec_id = 0")
    assert topk.search(one, one).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df).collect() == []


def test_large_numbers_are_exact_or_an_error(spark):
    data = [(0, [15625.0, 123456.0]), (1, [999_983.1, 1.0]), (2, [3e14, 7e5]), (3, [3e14, 7e5 + 0.5]), (4, [-3e14, 2.0]), (100, [1e5, -7.7])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, df.where("vec_id = 0")).collect()
    small = [(i, [x / 4096 for x in v]) for i, v in data]
    df = spark.createDataFrame(small, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 100 = 0")).collect()
    assert sorted(map(tuple, got)) == brute(small, 100)
    assert max(abs(r["score"]) for r in got) > 1 << 55
    with pytest.raises(Exception, match="64 bits"):
        topk.search(*(spark.createDataFrame([(0, [1.0]), (1, [1e17])], "vec_id long, embedding array<double>"),) * 2).collect()


def test_the_first_pass_spares_shards(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(3)
    q, w = np.floor(rng.normal(0, 50, (3, 4))).astype(np.int64), np.floor(rng.normal(0, 50, (400, 4))).astype(np.int64)
    row, _, score, done = topk.searched(q, np.arange(1000, 1003), w, np.arange(400), 5)
    kth = np.array([score[row == r].min() for r in range(3)])
    again = topk.searched(q, np.arange(1000, 1003), w, np.arange(400), 5, kth)
    assert again[3] <= done and sorted(zip(*again[:3])) == sorted(zip(row, _, score))
    weak = w // 4
    assert topk.searched(q, np.arange(1000, 1003), weak, np.arange(400), 5, kth)[3] < topk.searched(q, np.arange(1000, 1003), weak, np.arange(400), 5)[3]
    assert topk.searched(q, np.arange(1000, 1003), w, np.arange(400), 5, first=True)[3] == 3
    assert topk.searched(q, np.arange(1000, 1003), w, np.arange(400), 5, kth + 10**6)[3] == 0


def test_bounds_prune_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(0)
    w = np.floor(rng.normal(0, 50, (400, 4)))
    w[:16] += 5000
    _, found, score, done = topk.searched(w[:3], np.arange(3), w, np.arange(400), 5)
    assert done < 3 * 50
    assert set(found) <= set(range(16))


def test_copies_of_query_blocks_are_not_broadcast(spark):
    df = spark.createDataFrame(rows(), "vec_id long, embedding array<float>")
    plan = topk.search(df, df.where("vec_id % 100 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [group" in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize(("most", "size"), [(127, 1), (-128, 1), (128, 2), (-(1 << 31), 4), (1 << 31, 8)])
def test_weights_take_the_fewest_bytes(most, size):
    got = topk.narrow(np.array([[0, most]], np.int64))
    assert (got.itemsize, got.tolist()) == (size, [[0, most]])
