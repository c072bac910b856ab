"""SimHash fingerprints, and the groups that links between near fingerprints make.

Candidates come by the generalised pigeonhole: if two fingerprints differ in at most t bits, and
thresholds t_i of disjoint partitions of the bits add up to t - m + 1 for m partitions (-1 leaves a
partition out), then in some partition they differ in at most t_i bits. Correlated bits go into the
same partition; two to five partitions are weighed, with thresholds by dynamic programming on candidate
counts that are estimated from joint bit statistics of all fingerprints: a partition's bits are taken as a tree in which each
bit depends on the one most correlated with it. Buckets of equal partition values are sorted runs; every pair
in a bucket is compared, and a bucket gives a forest of its links, never pairs. A bucket with more
than `BLOCK` members is dealt out as pairs of its blocks, so a task holds two blocks at most.

Equal fingerprints are one vertex (so copies cost nothing); components come from `star_edges`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .common import LOWER, U64, Scratch, buffers, chunks, joined, mix, words
from .components import star_edges

BLOCK = 1024
#: Numbers of partitions that are weighed: keys of 32 bits and radii for many fingerprints, of 12 to 16 for few.
PARTS = range(2, 6)


def sign_bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes, a value of the bits set in over half of them."""
    n = np.diff(first)
    out = np.zeros(len(n), U64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    lanes = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(U64)
    # bytes add up in lanes of eight, 255 rows at most
    size = n[some]
    pieces = -(-size // 255)
    start = np.repeat(first[:-1][some], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.add.reduceat(lanes, start, axis=0).view(np.uint8)
    sums = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * sums > size[:, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def exact_fingerprints(buf: np.ndarray, offs: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """64 bits from the XXH64 of each run of `width` words, lower-cased in A-Z and joined by a space."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, offs)
    data, to = joined(buf, starts, ends)
    n = np.diff(first)
    shingles = np.where(n > 0, np.maximum(1, n - width + 1), 0)
    edge = np.concatenate([[0], np.cumsum(shingles)])
    a = np.arange(edge[-1]) - np.repeat(edge[:-1], shingles) + np.repeat(first[:-1], shingles)
    b = np.minimum(a + width, np.repeat(first[1:], shingles))
    data, digest = data.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[x:y], seed) for x, y in zip(to[a].tolist(), (to[b] - 1).tolist())), U64, len(a))
    return sign_bits(h, edge)[:, None]


def packed(fp: np.ndarray) -> pa.Array:
    """Fingerprints as binary, the high byte first."""
    size = 8 * fp.shape[1]
    data = pa.py_buffer(np.ascontiguousarray(fp, dtype=">u8").tobytes())
    edge = pa.py_buffer(np.arange(0, size * (len(fp) + 1), size, dtype=np.int32)[: len(fp) + 1])
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, edge, data])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): binary of 8 bytes, the high byte first. No words, or null: all bits zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                fp = exact_fingerprints(*buffers(part.column(text_col)), width)
                yield pa.record_batch({"id": part.column(id_col).cast(pa.int64()), "fp": packed(fp)})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "id long, fp binary")


def lanes_of(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(U64).reshape(-1, size // 8)


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")


def joint_counts(nodes: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each two bits are both set: sums over all of them."""
    n_bits = 8 * size

    def run(batches):
        total, n = np.zeros((n_bits, n_bits), np.int64), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = bits_of(lanes_of(batch.column("fp").slice(k, 4096), size)).astype(np.float32)
                total += np.rint(b.T @ b).astype(np.int64)
                n += len(b)
        if n:
            yield pa.record_batch({"cell": pa.array([*np.arange(n_bits * n_bits), -1], pa.int32()), "n": pa.array([*total.ravel(), n], pa.int64())})

    got = nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = got["cell"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(n_bits * n_bits, np.int64)
    out[cell[cell >= 0]] = n[cell >= 0]
    return int(n[cell < 0].sum()), out.reshape(n_bits, n_bits)


def grouped_bits(n: int, joint: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits: each begins with the least bit left and takes, one by one, the bit most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(dev, dev))
    left, out = list(range(len(p))), []
    for k in range(m):
        size = len(left) // (m - k)
        group = [left.pop(0)]
        while len(group) < size:
            best = int(np.argmax(near[np.ix_(group, left)].sum(0)))
            group.append(left.pop(best))
        out.append(sorted(group))
    return out


def spread(n: int, joint: np.ndarray, group: list[int], most: int = 3) -> np.ndarray:
    """Of two fingerprints, how likely they differ in 0, 1, ... `most` bits of the group.

    The bits are taken as a tree of largest correlations: each bit depends on its parent as their joint counts say. A pair
    of fingerprints is such a tree too, of pairs of bits, so its differing bits are added up from the leaves.
    """
    n = max(n, 1)
    p = np.diag(joint) / n
    cov = np.abs(joint / n - np.outer(p, p)) / np.sqrt(np.outer(p * (1 - p), p * (1 - p)) + 1e-12)
    parent, order, near = {group[0]: None}, [group[0]], {b: group[0] for b in group[1:]}
    while near:
        b = max(near, key=lambda x: cov[x, near[x]])
        parent[b] = near.pop(b)
        order.append(b)
        for x in near:
            if cov[x, b] > cov[x, near[x]]:
                near[x] = b
    differ = np.array([0, 1, 1, 0])  # the four values of a pair of bits: 00, 01, 10, 11
    below = {b: np.eye(1, most + 1).repeat(4, 0) for b in group}  # by the pair's value, how likely 0, 1, ... bits below differ

    def shifted(b):
        return np.stack([np.concatenate([np.zeros(d), below[b][s, : most + 1 - d]]) for s, d in enumerate(differ)])

    for b in reversed(order[1:]):
        a = parent[b]
        both = joint[a, b] / n
        table = np.maximum(np.array([[1 - p[a] - p[b] + both, p[b] - both], [p[a] - both, both]]), 0)
        table = table / np.maximum(table.sum(1, keepdims=True), 1e-300)
        got = np.kron(table, table) @ shifted(b)
        below[a] = np.stack([np.convolve(x, y)[: most + 1] for x, y in zip(below[a], got)])
    root = np.array([1 - p[group[0]], p[group[0]]])
    return np.kron(root, root) @ shifted(group[0])


def plan(n: int, joint: np.ndarray, most: int, parts: range, pair_cost: float = 0.01) -> tuple[list[list[int]], list[int]]:
    """The partitions and thresholds with the least estimated cost: entries to deal out, and pairs to compare."""
    best = None
    for m in parts:
        groups = grouped_bits(n, joint, m)
        costs = []
        for g in groups:
            c = np.cumsum(spread(n, joint, g, min(3, len(g))))
            probes = np.cumsum([comb(len(g), t) for t in range(min(3, len(g)) + 1)])
            costs.append([0.0] + [probes[t] * n + (t > 0) * n + pair_cost * c[t] * n * n * (1 + t) / 2 for t in range(len(probes))])
        # least cost of the first i partitions with thresholds that use up s of most + 1
        table = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (v, path) in table.items():
                for use, x in enumerate(cost):
                    if s + use <= most + 1 and (s + use not in step or v + x < step[s + use][0]):
                        step[s + use] = (v + x, [*path, use - 1])
            table = step
        if most + 1 in table and (best is None or table[most + 1][0] < best[0]):
            best = (table[most + 1][0], groups, table[most + 1][1])
    if best is None:
        raise ValueError("these partitions can't hold the threshold")
    return best[1], best[2]


def entries(nodes: DataFrame, size: int, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, node, fp): the value of each partition, and for a threshold above 0 the values within it."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                fp = lanes_of(part.column("fp"), size)
                bits = bits_of(fp)
                for i, (group, t) in enumerate(zip(groups, thresholds)):
                    for r in range(t + 1):
                        for flip in combinations(range(len(group)), r):
                            b = bits[:, group].copy()
                            b[:, list(flip)] ^= 1
                            packed = np.packbits(b, axis=1, bitorder="little")
                            wide = np.zeros((len(b), 8 * -(-packed.shape[1] // 8)), np.uint8)
                            wide[:, : packed.shape[1]] = packed
                            key = np.full(len(b), i + 1, U64)
                            for lane in wide.view(U64).T:
                                key = mix(key ^ lane)
                            yield pa.record_batch({"key": pa.array(key.view(np.int64)), "node": part.column("node"), "fp": part.column("fp")})

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member that each of n can reach by these links."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        go = x != y
        a, b, x, y = a[go], b[go], x[go], y[go]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def linked(rows: DataFrame, size: int, most: int) -> DataFrame:
    """Edges (u, v) of a forest of each bucket; rows: (key, part, node, fp), equal keys and parts together."""

    def solve(key, part, node, fp):
        order = np.lexsort((node, part, key))
        key, part, node, fp = key[order], part[order], node[order], fp[order]
        label, at, s = np.arange(len(key)), np.arange(len(key)), 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        while True:
            at = at[at + s < len(key)]
            at = at[(key[at] == key[at + s]) & (part[at] == part[at + s])]
            if not len(at):
                break
            near = np.bitwise_count(fp[at] ^ fp[at + s]).sum(1) <= most
            go = at[near]
            go = go[label[go] != label[go + s]]
            held.append((go, go + s))
            n_held += len(go)
            if n_held > 1 << 16:
                label = merged(label, held)
                held, n_held = [], 0
            s += 1
        label = merged(label, held)
        go = np.flatnonzero(node[label] != node)
        return pa.record_batch({"u": pa.array(node[go]), "v": pa.array(node[label[go]])})

    def merged(label, held):
        if not held:
            return label
        a, b = (np.concatenate([label[x[k]] for x in held]) for k in (0, 1))
        return forest(a, b, len(label))[label]

    def run(batches):
        # rows come sorted; what is held back is the last bucket, which has two blocks at most
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = (batch.column("key").to_numpy(), batch.column("part").to_numpy(), batch.column("node").to_numpy(), lanes_of(batch.column("fp"), size))
            if rest is not None:
                got = tuple(np.concatenate(x) for x in zip(rest, got))
            key, part = got[:2]
            last = int(np.argmax((key == key[-1]) & (part == part[-1])))
            if last:
                yield solve(*(x[:last] for x in got))
            rest = tuple(x[last:] for x in got)
        if rest is not None:
            yield solve(*rest)

    return rows.mapInArrow(run, "u long, v long")


def blocks(e: DataFrame) -> DataFrame:
    """Entries with a part: 0, or for buckets over BLOCK every pair of blocks that has the entry's own block."""
    hot = e.groupBy("key").count().where(f"count > {BLOCK}").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pair = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.greatest(j, own) * F.col("n") + F.least(j, own)))
    return e.join(hot, "key", "left").select("key", F.explode(pair).alias("part"), "node", "fp")


def links(nodes: DataFrame, most: int, size: int, groups: int | range) -> DataFrame:
    """Edges (u, v) that join every pair of fingerprints within `most` bits, v the smaller; nodes: (fp, node), a row for each fingerprint."""
    real = nodes.where("node is not null")
    n, joint = joint_counts(real, size)
    parts, thresholds = plan(n, joint, most, groups if isinstance(groups, range) else range(groups, groups + 1))
    e = blocks(entries(real, size, parts, thresholds))
    return linked(e.repartition("key", "part").sortWithinPartitions("key", "part"), size, most)


def components(fps: DataFrame, most: int, size: int, groups: int | range, scratch: Scratch) -> DataFrame:
    """(fp, node, component_id) for every distinct fingerprint; node: its smallest id. fps: (id, fp).

    Every pair within `most` bits is found. Fingerprints whose ids are all null make no links.
    """
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    stars = star_edges(links(nodes, most, size, groups), scratch)
    return nodes.join(stars.withColumnRenamed("u", "node").withColumnRenamed("v", "root"), "node", "left").select("fp", "node", F.coalesce("root", "node").alias("component_id"))


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex of 64 bits), component_id: links at 3 or fewer differing bits, none missed.

    Three-word shingles. Null ids: component_id is the smallest id with the same or a linked fingerprint,
    null if there is none. Rows that repeat an id each come back.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(fingerprints(docs, id_col, text_col), "fps")
    found = components(fps, 3, 8, PARTS, scratch)
    return fps.join(found, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of groups of texts whose five-word shingles have a similarity of 0.8 or more, by `near.groups`."""
    return near.groups(docs, id_col, text_col).select("id", F.col("least").alias("component_id"))
