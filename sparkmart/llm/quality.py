"""Quality rules of documents and of their hosts.

Each text gets counts; from them come its hard rules (`base_failed`) and its soft ones. A host's failures
of any rule are added up (partial sums are dealt out, so a hot host costs one row a task), and its
failure rate is shrunk by a beta prior whose two parameters are fitted to all hosts' rates by
moments: (failures + a) / (documents + a + b). The verdict joins back by host: a document that fails
a hard rule goes; one that fails a soft rule goes if its host's shrunk rate is `SOFT` or more; one that
fails none goes only if that rate is `BLOCKED` or more.

A null text has no words, so it fails. A null host is a host of its own. All columns pass through in
`kept_documents`. No rows: no hosts, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, buffers, chunks, mix, span_hashes, windows, words

#: Signs that count as symbols, and the limits of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
SOFT, BLOCKED = 0.05, 0.95
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def summed(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n_texts = len(offs) - 1
    starts, ends, first = words(buf, offs)
    n = np.diff(first)
    out = {"n_words": n, "n_symbols": summed(_SYMBOL[buf], offs)}
    # code points begin with any byte but 10xxxxxx
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    held = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    out["word_chars"] = held[first[1:]] - held[first[:-1]]
    out["n_dup_lines"] = np.zeros(n_texts, np.int64)
    data = buf.tobytes()
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        lines = data[a:b].split(b"\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            lines = [x for x in lines if x and x.split()]
            out["n_dup_lines"][k] = len(lines) - len(set(lines))
    h = span_hashes(buf, starts, ends, 0xA11)
    run = windows(h, 3)
    text = np.repeat(np.arange(n_texts), n)
    inside = np.flatnonzero(text[: len(run)] == text[2 : 2 + len(run)])
    key = mix(run[inside] ^ mix(text[inside].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = inside[twice]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 3, -1)
    out["n_repeat_words"] = summed(np.cumsum(edge)[:-1] > 0, first) if len(h) else np.zeros(n_texts, np.int64)
    return out


def base_failed(c: dict) -> np.ndarray | Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED * c["n_words"])


def soft_failed(c: dict) -> np.ndarray | Column:
    """More than one symbol for two words, or three repeated lines and more that hold half of the words at ten words a line."""
    return (2 * c["n_symbols"] > c["n_words"]) | ((c["n_dup_lines"] >= 3) & (20 * c["n_dup_lines"] > c["n_words"]))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                c = counts(*buffers(part.column("text")))
                yield pa.record_batch([part.column("id").cast(pa.int64()), part.column("host"), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], names=["id", "host", *COUNTS])

    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, host string, " + ", ".join(f"{k} long" for k in COUNTS))


def columns() -> dict[str, Column]:
    return {k: F.col(k) for k in COUNTS}


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, rate): shrunk failure rates; the prior's moments are weighted by documents."""
    failed = (base_failed(columns()) | soft_failed(columns())).cast("long")
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(failed).alias("f"))
    x = F.col("f") / F.col("n")
    moments = hosts.agg((F.sum("f") / F.sum("n")).alias("m"), F.sum("n").alias("docs"), F.count("*").alias("hosts"), F.sum(F.col("n") * x * x).alias("s")).first()
    a, b = prior(moments["m"], moments["s"], moments["docs"], moments["hosts"])
    return hosts.select("host", ((F.col("f") + a) / (F.col("n") + a + b)).alias("rate"))


def prior(m: float | None, s: float | None, docs: int | None, hosts: int) -> tuple[float, float]:
    """A beta prior with the hosts' mean and variance; its weight is between 1 and 1000 documents."""
    if not docs:
        return 0.5, 0.5
    m = min(max(m, 1e-4), 1 - 1e-4)
    spread = s / docs - m * m
    weight = m * (1 - m) / spread - 1 if spread > 1e-9 and hosts > 1 else 1000.0
    weight = min(max(weight, 1.0), 1000.0)
    return m * weight, (1 - m) * weight


def verdict(rate: Column) -> Column:
    base, soft = base_failed(columns()), soft_failed(columns())
    return ~base & ~(soft & (rate >= SOFT)) & (rate < BLOCKED)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the counts, base_failed, kept: one row for each document."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(measured(docs, id_col, text_col, host_col), "counts")
    rates = scratch.write(host_rates(rows), "hosts")
    both = rows.join(rates.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    return both.select(F.col("id").alias(id_col), *COUNTS, base_failed(columns()).alias("base_failed"), verdict(F.col("rate")).alias("kept"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that stay, with all their columns.

    Hosts' rates are a small table, joined to the rows by host; the texts are counted again rather than dealt out
    by id (Spark broadcasts the rates where their size allows, and otherwise splits large hosts).
    """
    scratch = Scratch(docs.sparkSession)
    rates = scratch.write(host_rates(measured(docs, id_col, text_col, host_col)), "hosts")
    mark = "__rate"
    both = docs.join(rates.select(F.col("host").alias("__host"), F.col("rate").alias(mark)), F.col(host_col).cast("string").eqNullSafe(F.col("__host")), "left").drop("__host")
    place, schema = len(docs.columns), docs.schema
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                c = counts(*buffers(part.column(where)))
                rate = part.column(place).to_numpy(zero_copy_only=False)
                keep = ~base_failed(c) & ~(soft_failed(c) & (rate >= SOFT)) & (rate < BLOCKED)
                yield part.select(range(place)).filter(pa.array(keep))

    return both.mapInArrow(run, schema)
