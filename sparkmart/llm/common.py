"""What several operators share: tables, scratch tables, and words of many texts as numpy arrays."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space between words: `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
#: Bytes of text that are worked on at once; one text may be longer.
CHUNK = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that spark.checkpoint.dir names; they cut lineage and outlive executors.

    A folder of this process's own is set only where that setting is empty and the master is local, as in tests;
    executors elsewhere would not see it, so then this is refused. What is left goes when the driver ends; `drop` takes
    tables away before.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            base = tempfile.mkdtemp(prefix="sparkmart-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/sparkmart-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def swept(spark: SparkSession) -> None:
    """Lets shuffle files of what is done go at once; else they stay until the driver happens to collect its garbage.

    Executors collect theirs too, as a heap that one step has grown else stays as large beside the next step's workers.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') as done").collect()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, end to end, and where each begins (one offset more than texts); null is empty."""
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK):
    """Slices of a batch with about `limit` bytes of text each, and one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at, done = 0, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, end - at)
        at, done = end, int(size[end - 1])


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the index of each text's first word (one more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = offs[:-1] < offs[1:]
    a, b = offs[:-1][some], offs[1:][some] - 1
    first[a] |= inside[a]
    last[b] |= inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a round."""
    n = ends - starts
    h = mix(n.astype(U64) + U64(seed))
    if not len(n):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(n, 8)]))
    live = np.flatnonzero(n > 8)
    done = 8
    while len(live):
        rest = n[live] - done
        h[live] = mix(h[live] ^ (eight[starts[live] + done] & _MASK[np.minimum(rest, 8)]))
        done += 8
        live = live[rest > 8]
    return h


def windows(h: np.ndarray, width: int, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each run of `width` values (of the whole array, texts' borders included)."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, U64)
    for k in range(width):
        out *= U64(by | 1)
        out += h[k : k + n]
    return mix(out)


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins (one offset more than words)."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(starts - to[:-1], size)
    at += np.arange(to[-1])
    out = np.concatenate([buf, np.full(1, 0x20, np.uint8)])[at]
    out[to[1:] - 1] = 0x20
    return out, to
