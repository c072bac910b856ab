"""Conflict-constrained best-fit packing of documents into bins of a fixed number of units.

Documents longer than a bin are cut into pieces; whole-bin pieces are bins of their own. A shard's pieces go
longest first (ties by id) into the bin with the smallest room that fits, among those that are compatible: a
bin may hold no two pieces of one source, and none of one group of duplicates. Bins are kept in order of
their room, each with a bitmap of its sources and one of its duplicate groups; from the first bin that
fits, the search goes on to the next larger room until a compatible one is found, to the last bin. If
there is none a bin is opened.

Documents are dealt out to shards of about `SHARD` rows by a hash of their id (and text digest), so a source or a group that
holds a third of all rows holds a third of every shard, and no task holds more than a shard. Bins don't
span shards. Only ids, lengths, hosts and digests are dealt out, not texts.

Null or empty texts have no units and get no bin (bin null). A null source conflicts with null sources.
Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, buffers, chunks, span_hashes, words

CAPACITY, SHARD = 4096, 8192
SCHEMA = "doc_id long, piece int, first_unit long, n_units long, bin_id long, bin_offset long, bin_units long"
#: Bins that a step of the successor search looks at together.
STEP = 128


class Bins:
    """Open bins in order of their room, with bitmaps of sources and duplicate groups in 64-bit lanes."""

    def __init__(self, capacity: int, sources: int, groups: int):
        self.capacity, self.n = capacity, 0
        self.room = np.zeros(1024, np.int64)
        self.name = np.zeros(1024, np.int64)
        self.bits = np.zeros((1024, -(-sources // 64) + -(-groups // 64)), np.uint64)
        self.lane = -(-sources // 64)
        self.opened = 0

    def place(self, size: int, source: int, group: int) -> tuple[int, int]:
        """The bin and the offset in it. group: below 0 if nothing else is like it."""
        lane, bit = source // 64, np.uint64(1 << source % 64)
        g_lane, g_bit = self.lane + group // 64, np.uint64(1 << group % 64)
        at = int(np.searchsorted(self.room[: self.n], size))
        while at < self.n:
            end = min(at + STEP, self.n)
            ok = (self.bits[at:end, lane] & bit) == 0
            if group >= 0:
                ok &= (self.bits[at:end, g_lane] & g_bit) == 0
            k = int(ok.argmax())
            if ok[k]:
                return self.fill(at + k, size, lane, bit, group, g_lane, g_bit)
            at = end
        if self.n == len(self.room):
            self.room, self.name = (np.concatenate([x, np.zeros_like(x)]) for x in (self.room, self.name))
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        self.room[self.n], self.name[self.n], self.bits[self.n] = self.capacity, self.opened, 0
        self.opened += 1
        self.n += 1
        return self.fill(self.n - 1, size, lane, bit, group, g_lane, g_bit)

    def fill(self, k, size, lane, bit, group, g_lane, g_bit):
        name, room = int(self.name[k]), int(self.room[k])
        row = self.bits[k].copy()
        row[lane] |= bit
        if group >= 0:
            row[g_lane] |= g_bit
        left = room - size
        to = int(np.searchsorted(self.room[: self.n], left)) if left else -1
        if left:  # rooms in between move up by one
            for x, v in ((self.room, left), (self.name, name), (self.bits, row)):
                x[to + 1 : k + 1] = x[to:k].copy()
                x[to] = v
        else:
            for x in (self.room, self.name, self.bits):
                x[k : self.n - 1] = x[k + 1 : self.n].copy()
            self.n -= 1
        return name, self.capacity - room


def pack(ids: list, sizes: np.ndarray, source: np.ndarray, group: np.ndarray, capacity: int) -> list[tuple]:
    """(row, piece, first unit, units, bin, offset) of the pieces of one shard's documents."""
    groups, which, n = np.unique(group, return_inverse=True, return_counts=True)
    # only groups of two or more, or documents of several pieces, need a bit
    need = np.zeros(len(groups), bool)
    need[which[sizes > capacity]] = True
    need |= n > 1
    bit = np.where(need, np.cumsum(need) - 1, -1)[which]
    sources, source = np.unique(source, return_inverse=True)
    pieces = [(int(min(capacity, s - a)), k, a // capacity, a) for k, s in enumerate(sizes.tolist()) for a in range(0, s, capacity)]
    pieces.sort(key=lambda p: (-p[0], ids[p[1]] is None, ids[p[1]] or 0, p[1], p[2]))
    bins, out = Bins(capacity, max(1, len(sources)), max(1, int(need.sum()))), []
    for size, k, piece, first in pieces:
        out.append((k, piece, first, size, *bins.place(size, int(source[k]), int(bit[k]))))
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, n, group): words of each text, and a digest of its lower-cased words for its duplicate group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                buf, offs = buffers(part.column("text"))
                buf = LOWER[buf]
                starts, ends, first = words(buf, offs)
                h = span_hashes(buf, starts, ends, 0xBE57)
                n = np.diff(first)
                total = np.zeros(len(n), np.uint64)
                some = np.flatnonzero(n)
                if len(some):
                    # a word counts by its place, so that order matters
                    place = np.arange(len(h)) - np.repeat(first[:-1], n)
                    total[some] = np.add.reduceat(h * (2 * place + 1).astype(np.uint64), first[:-1][some])
                yield pa.record_batch([part.column("id").cast(pa.int64()), part.column("source"), pa.array(n), pa.array(total.view(np.int64))], names=["id", "source", "n", "group"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, source string, n long, group long")


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each piece: doc_id, piece, first_unit, n_units, bin_id, bin_offset, bin_units (the bin's total); units are words."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(sized(docs, id_col, text_col, source_col), "sizes")
    shards = 1 + rows.count() // SHARD
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "group"), F.lit(shards)).cast("int"))
    # a given number, as rows are few bytes and would be gathered into few tasks
    dealt = dealt.repartition(min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")

    def run(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        ids, n = got.column("id").to_pylist(), got.column("n").to_numpy()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, int(n[k])))
        ids = [ids[k] for k in order]
        source = np.array([x or "" for x in got.column("source").to_pylist()], object)[order].astype(str)
        sizes = n[order]
        placed = pack(ids, sizes, source, got.column("group").to_numpy()[order], capacity)
        empty = [(k, 0, 0, 0, None, None) for k in np.flatnonzero(sizes == 0).tolist()]
        total: dict = {}
        for p in placed:
            total[p[4]] = total.get(p[4], 0) + p[3]
        cols = [[], [], [], [], [], [], []]
        for k, piece, first, size, name, at in [*placed, *empty]:
            for c, v in zip(cols, (ids[k], piece, first, size, None if name is None else shard << 32 | name, at, total.get(name))):
                c.append(v)
        names = ["doc_id", "piece", "first_unit", "n_units", "bin_id", "bin_offset", "bin_units"]
        return pa.table({n: pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, cols)})

    return dealt.groupBy("shard").applyInArrow(run, SCHEMA)
