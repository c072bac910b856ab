"""Substring dedup: words in a window that also starts in a document with a smaller id go.

Difference-cover anchors: of the hashes of seven words only those at positions whose remainder
modulo 7 is in {0, 1, 3} are dealt out. The differences of these three give every remainder, so two
equal windows of `window` >= 13 words, wherever each begins, have an aligned anchor in common. Only
windows around a shared anchor are extended to their whole length, hashed with 72 bits and more, and
dealt out with the smallest id that holds them.

A chunk of texts sends a hash once, however many of its texts hold it, and gets one bit for each, so
a passage that a third of all documents hold costs one record a chunk, and no pairs are ever made.
Chunks are kept as compressed record batches in a written table, from which every pass computes the
same hashes again. Rows dealt out are never more than hashes, and as few as chunks times buckets.

Null or empty texts have no words. Rows with a null id count as larger than all others and never
remove words of each other; rows that repeat an id don't either. All columns of the input pass
through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, U64, Scratch, buffers, chunks, joined, span_hashes, windows, words

PERIOD, COVER = 7, (0, 1, 3)
NO_ID = np.iinfo(np.int64).max
#: Hashes that a bucket is to hold.
BUCKET = 1_000_000
LOW = U64((1 << 40) - 1)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_next_batch()


class Chunk:
    """The words of some texts and what their windows hash to."""

    def __init__(self, batch: pa.RecordBatch, id_col: str, text_col: str, window: int):
        self.batch, self.window = batch, window
        self.buf, self.offs = buffers(batch.column(text_col))
        self.starts, self.ends, self.first = words(self.buf, self.offs)
        ids = batch.column(id_col)
        self.ids = ids.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.at = np.arange(len(self.starts)) - self.first[:-1][self.doc]
        self.left = count[self.doc] - self.at
        self.long = count[self.doc] >= window
        self.hash = span_hashes(self.buf, self.starts, self.ends, 0x5EED)

    def anchors(self, buckets: int):
        """Positions of anchors, the sorted distinct keys (bucket, 40 bits), each anchor's key, and keys in two texts."""
        h = windows(self.hash, PERIOD)
        r = self.at[: len(h)] % PERIOD
        pos = np.flatnonzero(((r == COVER[0]) | (r == COVER[1]) | (r == COVER[2])) & self.long[: len(h)] & (self.left[: len(h)] >= PERIOD))
        key = keyed(h[pos], buckets)
        order = np.argsort(key, kind="stable")
        new, which = distinct(key[order])
        inverse = np.empty(len(pos), np.int64)
        inverse[order] = which
        doc = self.doc[pos][order]
        lead = np.flatnonzero(new)
        several = (np.minimum.reduceat(doc, lead) != np.maximum.reduceat(doc, lead)) if len(lead) else np.zeros(0, bool)
        return pos, key[order][new], inverse, several

    def candidates(self, buckets: int, shared: np.ndarray, pos: np.ndarray, inverse: np.ndarray, spread: int):
        """Windows that hold a shared anchor: their first words, distinct keys, check hashes, smallest ids and each one's key."""
        n = max(0, len(self.starts) - self.window + 1)
        hit = np.zeros(len(self.starts) + 1, np.int64)
        hit[1:][pos[shared[inverse]]] = 1
        hit = np.cumsum(hit)
        reach = self.window - PERIOD + 1
        at = np.flatnonzero((hit[np.arange(n) + reach] > hit[:n]) & (self.left[:n] >= self.window))
        if len(at):
            g = windows(self.hash, self.window, 0xD6E8FEB86659FD93)[at]
            e = (windows(self.hash, self.window, 0xA0761D6478BD642F)[at] >> U64(32)).astype(np.uint32)
        else:
            g, e = np.zeros(0, U64), np.zeros(0, np.uint32)
        order = np.argsort(g, kind="stable")
        new, which = distinct(g[order])
        inverse = np.empty(len(at), np.int64)
        inverse[order] = which
        lead = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.doc[at]][order], lead) if len(lead) else np.zeros(0, np.int64)
        return at, keyed(g[order][new], spread), e[order][new], least, inverse


def keyed(h: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket, low 40 bits) in one value; buckets are ranges of the high 24 bits, so that sorted hashes stay by bucket."""
    return (((h >> U64(40)) * U64(buckets)) >> U64(24)) << U64(40) | (h & LOW)


def distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new, np.cumsum(new) - 1


def parts(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    bucket = (key >> U64(40)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else []
    for a, b in zip(cut, [*cut[1:], len(key)]):
        yield int(bucket[a]), int(a), int(b)


def five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unfive(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8")


def bits_of(pieces: list[dict], n: int, key: np.ndarray) -> np.ndarray:
    """The bits that came back, by bucket, for the sorted keys of a chunk."""
    out = np.zeros(n, bool)
    by = {p["bucket"]: p["bits"] for p in pieces or []}
    for bucket, a, b in parts(key):
        out[a:b] = np.unpackbits(np.frombuffer(by[bucket], np.uint8), count=b - a)
    return out


def replies(sent: DataFrame, kind: str) -> DataFrame:
    """For each chunk, the bits of its hashes: another chunk has it (anchors), or has it in a smaller document (windows)."""

    def answer(got: pa.Table) -> pa.Table:
        blobs, chunk = got.column("blob").to_pylist(), got.column("chunk")
        if kind == "anchors":
            key = [unfive(x) for x in blobs]
            flat = np.concatenate(key)
            order = np.argsort(flat, kind="stable")
            _, which = distinct(flat[order])
            yes = np.empty(len(flat), bool)
            yes[order] = np.bincount(which)[which] > 1
        else:
            raw = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in blobs]
            size = [len(x) // 17 for x in raw]
            key = [unfive(x[: 5 * n]) for x, n in zip(raw, size)]
            flat = np.concatenate(key)
            check = np.concatenate([np.frombuffer(x, "<u4", n, 5 * n) for x, n in zip(raw, size)])
            least = np.concatenate([np.frombuffer(x, "<i8", n, 9 * n) for x, n in zip(raw, size)])
            order = np.lexsort((check, flat))
            a, b = flat[order], check[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            smallest = np.minimum.reduceat(least[order], np.flatnonzero(new))
            yes = np.empty(len(flat), bool)
            yes[order] = smallest[np.cumsum(new) - 1] < least[order]
        edge = np.cumsum([0, *map(len, key)])
        bits = [np.packbits(yes[a:b]).tobytes() for a, b in zip(edge, edge[1:])]
        return pa.table({"chunk": chunk, "bucket": got.column("bucket"), "bits": pa.array(bits, pa.binary())})

    back = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, bits binary")
    return back.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(kind))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, digest: bool = False) -> DataFrame:
    """The rows with the repeated words cut from the text; with `digest`, one row of counts and a SHA-256 for each instead.

    Cut words go with the white space after them (before them, at the end of a text); a text of which
    nothing is cut stays as it is. With `digest`: id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space).
    """
    if window < 2 * PERIOD - 1:
        raise ValueError(f"a window of {window} words need not hold an anchor")
    scratch = Scratch(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in batches:
            for part in chunks(batch, text_col, 2 * CHUNK):
                _, _, first = words(*buffers(part.column(text_col)))
                yield pa.record_batch({"chunk": pa.array([TaskContext.get().partitionId() << 32 | rows], pa.int64()), "n_words": pa.array([int(first[-1])], pa.int64()), "blob": pa.array([pack(part)], pa.binary())})
                rows += 1

    kept = scratch.write(docs.mapInArrow(cut, "chunk long, n_words long, blob binary"), "chunks")
    n_words = kept.agg(F.sum("n_words")).first()[0] or 0
    buckets = min(1 << 22, 1 + n_words * len(COVER) // PERIOD // BUCKET)
    spread = min(1 << 22, 1 + n_words // 4 // BUCKET)

    def send_anchors(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                key = Chunk(unpack(blob.as_py()), id_col, text_col, window).anchors(buckets)[1]
                if len(key):
                    cuts = list(parts(key))
                    yield pa.record_batch({"bucket": pa.array([x[0] for x in cuts], pa.int32()), "chunk": pa.array([chunk] * len(cuts), pa.int64()), "blob": pa.array([five(key[a:b] & LOW) for _, a, b in cuts], pa.binary())})

    sent = kept.select("chunk", "blob").mapInArrow(send_anchors, "bucket int, chunk long, blob binary")
    anchors = scratch.write(replies(sent, "anchors"), "anchors")

    def found(batch: pa.RecordBatch, k: int):
        c = Chunk(unpack(batch.column("blob")[k].as_py()), id_col, text_col, window)
        pos, key, inverse, several = c.anchors(buckets)
        shared = several | bits_of(batch.column("anchors")[k].as_py(), len(key), key)
        return c, c.candidates(buckets, shared, pos, inverse, spread)

    def send_windows(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, (_, key, check, least, _) = found(batch, k)
                cuts = list(parts(key))
                if not cuts:
                    continue
                blobs = []
                for _, a, b in cuts:
                    raw = five(key[a:b] & LOW) + check[a:b].astype("<u4").tobytes() + least[a:b].astype("<i8").tobytes()
                    blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
                yield pa.record_batch({"bucket": pa.array([x[0] for x in cuts], pa.int32()), "chunk": pa.array([batch.column("chunk")[k].as_py()] * len(cuts), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    with_anchors = kept.select("chunk", "blob").join(anchors, "chunk", "left")
    sent = with_anchors.mapInArrow(send_windows, "bucket int, chunk long, blob binary")
    smaller = scratch.write(replies(sent, "windows"), "windows")

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                c, (at, key, _, least, inverse) = found(batch, k)
                bit = bits_of(batch.column("windows")[k].as_py(), len(key), key)
                gone = at[bit[inverse] | (c.ids[c.doc[at]] > least[inverse])]
                edge = np.zeros(len(c.starts) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                stay = np.cumsum(edge)[: len(c.starts)] == 0
                yield from digests(c, stay) if digest else texts(c, stay, text_col)

    def digests(c: Chunk, stay: np.ndarray):
        out, to = joined(c.buf, c.starts[stay], c.ends[stay])
        first = np.concatenate([[0], np.cumsum(stay)])[c.first]
        data, edge = out.tobytes(), to[first]
        sha = [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        n = np.diff(c.first)
        yield pa.record_batch({id_col: c.batch.column(id_col).cast(pa.int64()), "n_words": pa.array(n), "n_removed": pa.array(n - np.diff(first)), "kept_sha256": pa.array(sha, pa.string())})

    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" if digest else docs.schema
    return with_anchors.join(smaller, "chunk", "left").mapInArrow(finish, schema)


def texts(c: Chunk, stay: np.ndarray, text_col: str) -> Iterator[pa.RecordBatch]:
    """The batch with the words that don't stay cut from its texts."""
    column = c.batch.column(text_col)
    if not stay.all():
        keep = np.ones(len(c.buf) + 1, np.int8)
        last = np.zeros(len(c.starts), bool)
        last[c.first[1:][c.first[1:] > c.first[:-1]] - 1] = True
        go = np.flatnonzero(~stay)
        nxt = np.where(last[go], c.offs[1:][c.doc[go]], c.starts[np.minimum(go + 1, len(c.starts) - 1)])
        edge = np.zeros(len(c.buf) + 1, np.int64)
        np.add.at(edge, c.starts[go], 1)
        np.add.at(edge, nxt, -1)
        keep = np.cumsum(edge)[:-1] == 0
        # white space before a cut that reaches a text's end
        ended = go[last[go]]
        for w in ended:
            a = c.starts[w]
            low = c.offs[c.doc[w]]
            while w > c.first[c.doc[w]] and not stay[w - 1]:
                w -= 1
            a = c.starts[w]
            b = c.ends[w - 1] if w > c.first[c.doc[w]] else low
            keep[b:a] = False
        size = np.concatenate([[0], np.cumsum(keep)])[c.offs]
        fresh = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(c.buf[keep]))])
        changed = np.zeros(len(column), bool)
        changed[c.doc[go]] = True
        column = pa.compute.if_else(pa.array(changed), fresh.cast(column.type), column)
    place = c.batch.schema.get_field_index(text_col)
    yield c.batch.set_column(place, c.batch.schema.field(place), column)
