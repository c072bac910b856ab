"""Exact top-k search by inner product over quantised vectors, with block-at-a-time pruning.

A component is a term and its integer weight the term's impact. Documents are cut, in order of their
ids, into blocks of `BLOCK` rows; a block keeps a forward index (its weight matrix), and the largest and
smallest weight of each term. A query's bound for a block is the sum of its weights times the block's
maxima (minima, where the weight is negative). Per query, blocks are scored in order of their bounds,
more at a time as they go on, until a bound falls below the k-th score so far; a bound equal to it is still scored, for ties. A first pass
scores only the best block of each shard, which gives each query a k-th score over all shards; the second pass
begins with it, so a shard without a block above it costs bounds alone.

Scores are exact or an error: sums that double precision can't hold exactly are made of whole numbers of any
size, and a component or a score beyond 64 bits raises. Bounds are then made a little larger than their sums.

`SHARD` rows of neighbouring ids make a shard, and queries come in blocks of `QUERIES`: every pair of a
query block and a shard is a row of its own, so a task holds one shard and one query block, and gives k
rows a query. That is the stated query set against all rows, in blocks. Query blocks are copied once for each group of
shards; the copies are dealt out by a merge join and never broadcast, as Spark's estimate of their size doesn't
know of the copying. Weights are kept in the fewest bytes that hold a block's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, swept

BLOCK, SHARD, QUERIES = 128, 8192, 512


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, w): floor(scale * x) of each component, an error where 64 bits don't hold it. Rows with a null id, a null vector, or a component that is null or not finite take no part; an empty vector's scores are 0."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad)

    def whole(v):
        y = F.floor(v.cast("double") * scale)
        return F.when(F.abs(v.cast("double") * scale) < 2.0**63, y.cast("long")).otherwise(F.raise_error(F.lit("a component doesn't fit in 64 bits")).cast("long"))

    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("w"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists as a matrix of whole numbers, zeros past a list's end."""
    edge = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(edge)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    flat = column.values.to_numpy()[edge[0] : edge[-1]]
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - (edge[:-1] - edge[0])[row]] = flat
    return out


def narrow(w: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes, low byte first."""
    low, high = int(w.min(initial=0)), int(w.max(initial=0))
    size = next(b for b in (1, 2, 4, 8) if -(1 << 8 * b - 1) <= low and high < 1 << 8 * b - 1)
    return w.astype(f"<i{size}")


def blobs(rows: DataFrame, per: int, kind: str) -> DataFrame:
    """(no, n, width, bytes, ids, weights): `per` rows each, in the order in which they come; bytes: of a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        no = 0

        def flush():
            nonlocal ids, held, no
            width = max(m.shape[1] for m in held)
            w = narrow(np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in held]))
            one = np.concatenate(ids)
            no += 1
            ids, held = [], []
            return pa.record_batch({"n": pa.array([len(one)], pa.int32()), "width": pa.array([width], pa.int32()), "bytes": pa.array([w.itemsize], pa.int32()), "ids": pa.array([one.astype("<i8").tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                room = per - sum(map(len, ids))
                part = batch.slice(at, room)
                at += part.num_rows
                ids.append(part.column("id").to_numpy())
                held.append(matrix(part.column("w")))
                if sum(map(len, ids)) == per:
                    yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(run, "n int, width int, bytes int, ids binary, w binary").withColumn(kind, F.monotonically_increasing_id())


def exact(q: np.ndarray, w: np.ndarray) -> bool:
    """Whether double precision holds every sum of products of these rows, and every part of it."""
    most = [int(np.abs(m.astype(np.float64)).max(initial=0)) for m in (q, w)]
    return most[0] * most[1] * max(1, q.shape[1]) < 1 << 53


def searched(q: np.ndarray, q_ids: np.ndarray, w: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, first: bool = False):
    """For each query its k best rows of a shard: (query row, id, score) arrays, and how many blocks were scored.

    least: scores below which a query wants no row. With `first`, each query's best block alone is scored.
    """
    cut = np.arange(0, len(ids), BLOCK)
    if exact(q, w):
        q, w, slack = q.astype(np.float64), w.astype(np.float64), 0.0
        product = lambda rows, at: q[rows] @ w[at].T
    else:
        # whole numbers of any size; bounds are in double precision, and larger by more than their rounding
        wide_q, wide_w, slack = q.astype(object), w.astype(object), 1e-9
        q, w = q.astype(np.float64), w.astype(np.float64)

        def product(rows, at):
            out = wide_q[rows] @ wide_w[at].T if wide_q.shape[1] else np.zeros((len(rows), at.stop - at.start), object)
            if len(out) and max(abs(out.min()), abs(out.max())) >= 1 << 63:
                raise OverflowError("a score doesn't fit in 64 bits")
            return out

    high, low = np.maximum.reduceat(w, cut, axis=0), np.minimum.reduceat(w, cut, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    if slack:
        bound = bound + slack * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) + 1
    order = np.argsort(-bound, axis=1, kind="stable")
    ranked = np.take_along_axis(bound, order, axis=1)
    n, none = len(q), np.iinfo(np.int64).max
    low_end = np.full(n, np.iinfo(np.int64).min) if least is None else least
    score, found, held = np.zeros((n, k), object if slack else np.float64), np.full((n, k), none), np.zeros((n, k), bool)
    live, done = np.arange(n), 0
    step, until, end = 0, 1, 1 if first else len(cut)
    while step < end:
        # blocks of the next steps, four times as many as came before, so that a block meets many queries at once
        floor = np.where(held[live, k - 1], np.maximum(score[live, k - 1].astype(np.float64), low_end[live]), low_end[live])
        wanted = ranked[live, step:until] >= (floor * (1 - np.sign(floor) * slack))[:, None]
        live, wanted = live[wanted[:, 0]], wanted[wanted[:, 0]]
        if not len(live):
            break
        of, ahead = np.nonzero(wanted)
        of, block = live[of], order[live[of], step + ahead]
        for b in np.unique(block):
            rows = of[block == b]
            at = slice(int(cut[b]), int(min(cut[b] + BLOCK, len(ids))))
            s = product(rows, at)
            done += len(rows)
            mine = (s >= low_end[rows][:, None]) & (~held[rows, k - 1, None] | (s >= score[rows, k - 1, None])) & (q_ids[rows][:, None] != ids[at][None, :])
            go = mine.any(axis=1)  # most blocks have nothing for most queries
            if not go.any():
                continue
            rows, s, mine = rows[go], s[go], mine[go]
            both, ok = np.concatenate([score[rows], s], axis=1), np.concatenate([held[rows], mine], axis=1)
            who = np.where(ok, np.concatenate([found[rows], np.broadcast_to(ids[at], s.shape)], axis=1), none)
            top = best(both, who, ok, k)
            score[rows], found[rows], held[rows] = (np.take_along_axis(x, top, axis=1) for x in (both, who, ok))
        step, until = until, min(end, 5 * until)
    row, rank = np.nonzero(held)
    return row, found[row, rank], score[row, rank].astype(np.int64), done


def best(score: np.ndarray, who: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k highest scores that are ok (then others), ties to smaller ids."""
    if score.dtype == object:
        return np.array([sorted(range(len(s)), key=lambda j: (not o[j], -s[j], w[j]))[:k] for s, w, o in zip(score, who, ok)]).reshape(len(score), -1)
    return np.lexsort((who, -score, ~ok), axis=1)[:, :k]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with rows of another id, ties to smaller ids.

    Of vectors of different length the shorter one has zeros at the end. A row is known by its id, so a row that repeats the
    query's id is taken for the query; of query rows that repeat an id the least vector counts; repeated candidates
    each count. Fewer candidates: all of them; none: no row.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = quantised(vectors, id_col, vec_col)
    shards = scratch.write(blobs(rows.repartitionByRange("id").sortWithinPartitions("id"), SHARD, "shard"), "shards")
    asked = quantised(queries, id_col, vec_col).groupBy("id").agg(F.min("w").alias("w"))
    asked = scratch.write(blobs(asked.repartitionByRange("id").sortWithinPartitions("id"), QUERIES, "asked"), "asked")
    # shards are dealt into groups, and each query block goes to every group; together the copies hold no more than about twice the shards' rows
    context, n_shards, n_asked = vectors.sparkSession.sparkContext, shards.count(), max(1, asked.count())
    copies = max(2 * context.defaultParallelism, 2 * n_shards * SHARD // (n_asked * QUERIES))
    groups = max(1, min(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_shards, copies))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    dealt = shards.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int"))

    def scored(asked: DataFrame, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    w = np.frombuffer(x["w"], f"<i{x['bytes']}").astype(np.int64).reshape(x["n"], x["width"])
                    q = np.frombuffer(x["q_w"], f"<i{x['q_bytes']}").astype(np.int64).reshape(x["q_n"], x["q_width"])
                    width = max(w.shape[1], q.shape[1])
                    w, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (w, q))
                    ids, q_ids = np.frombuffer(x["ids"], "<i8"), np.frombuffer(x["q_ids"], "<i8")
                    least = dict(zip(x["q_least"]["id"], x["q_least"]["least"])) if x["q_least"] else {}
                    low = np.array([least.get(i, np.iinfo(np.int64).min) for i in q_ids.tolist()], np.int64)
                    row, vec, score, _ = searched(q, q_ids, w, ids, k, low, first)
                    yield pa.record_batch({"asked": pa.array(np.full(len(row), x["asked"]), pa.int64()), "query_id": pa.array(q_ids[row]), "vec_id": pa.array(vec), "score": pa.array(score)})

        columns = ["n", "width", "bytes", "ids", "w", "q_n", "q_width", "q_bytes", "q_ids", "q_w", "q_least", "asked"]
        copied = asked.select(group, "asked", *(F.col(x).alias(f"q_{x}") for x in ("n", "width", "bytes", "ids", "w", "least")))
        pairs = dealt.hint("merge").join(copied, "group").select(*columns)
        found = pairs.mapInArrow(run, "asked long, query_id long, vec_id long, score long")
        ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", ranked).where(F.col("rank") <= k)

    none = F.lit(None).cast("struct<id: array<long>, least: array<long>>")
    kth = scored(asked.withColumn("least", none), True).where(F.col("rank") == k).groupBy("asked")
    kth = kth.agg(F.collect_list(F.struct("query_id", "score")).alias("x")).select("asked", F.struct(F.col("x.query_id").alias("id"), F.col("x.score").alias("least")).alias("least"))
    asked = scratch.write(asked.join(kth, "asked", "left"), "seeded")
    swept(vectors.sparkSession)
    return scored(asked, False).select("query_id", "rank", "vec_id", "score")
