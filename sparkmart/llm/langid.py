"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the average of the embeddings of all its subwords, byte 2-, 3- and 4-grams with white space as
one sign and A-Z lower-cased, hashed into `BUCKETS`. Embeddings and the output layer are trained together by
stochastic gradient descent in numpy on the driver. The training sample is bounded: of each label about
`PER_LANG` documents, or as many fewer as keep all labels' together at about `SAMPLE`, chosen by a hash of id and text; of
each document the driver gets the counts of its `GRAMS` most frequent subwords, made on the executors from the
whole text (10 kB a document and 160 MB in all at most). A fifth of the sample sets the softmax's temperature
and the least score that isn't rejected.

As averaging and the output layer are linear, prediction adds up one row of embedding times output layer
per subword, in slices of `SLICE` bytes of text and `CELLS` numbers, so neither long texts nor many labels take more memory. A
null text, or one without a letter, is `und` with score 0, and rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, Scratch, buffers, chunks

BUCKETS, DIM, PER_LANG, SAMPLE, GRAMS, CALIBRATION = 1 << 14, 12, 400, 16_000, 2048, 0.2
SLICE, CELLS = 1 << 20, 1 << 21
SHARES = 1 << 40
#: Share of the calibration texts that may be rejected.
REJECT = 0.002
NORMAL = np.where(SPACE, 0x20, LOWER).astype(np.uint8)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def subwords(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and where each text's n-grams begin."""
    b = NORMAL[buf].astype(np.uint32)
    m = max(0, len(b) - n + 1)
    h = np.full(m, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= b[k : k + m]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    size = np.maximum(0, np.diff(offs) - n + 1)
    inside = np.ones(len(b), bool)
    for k in range(1, n):  # n-grams that run over a text's end
        at = offs[1:] - k
        inside[at[at >= offs[:-1]]] = False
    return h[inside[:m]], np.concatenate([[0], np.cumsum(size)])


def sliced(buf: np.ndarray, offs: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The n-grams in slices of about SLICE bytes: the first text of each, the buckets, and where each text's begin."""
    for a in range(0, len(buf), SLICE):
        b = min(a + SLICE, len(buf))
        lo, hi = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
        own = np.clip(offs[lo : hi + 1], a, None)
        own[-1] = min(offs[hi], b + n - 1)  # an n-gram belongs to the slice that it begins in
        yield lo, *subwords(buf[a : own[-1]], own - a, n)


def has_letter(texts: pa.Array, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    if not len(buf):
        return np.zeros(len(texts), bool)
    got = np.concatenate([[0], np.cumsum(LETTER[buf])])
    out = got[offs[1:]] > got[offs[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        total, count = np.zeros((len(offs) - 1, len(self.langs))), np.zeros(len(offs) - 1)
        step = max(1, CELLS // len(self.langs))
        for n in (2, 3, 4):
            for text, h, edge in sliced(buf, offs, n):
                count[text : text + len(edge) - 1] += np.diff(edge)
                for a in range(0, len(h), step):
                    cut = np.clip(edge, a, a + step) - a
                    some = np.flatnonzero(np.diff(cut))
                    total[text + some] += np.add.reduceat(self.table[h[a : a + step]], cut[:-1][some], axis=0)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def frequent(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The GRAMS most frequent buckets of one text, in order, and how often each comes."""
    c = np.zeros(BUCKETS, np.int64)
    for n in (2, 3, 4):
        for _, h, _ in sliced(buf, offs, n):
            c += np.bincount(h, minlength=BUCKETS)
    at = np.sort(np.argsort(-c, kind="stable")[:GRAMS])
    at = at[c[at] > 0]
    return at.astype(np.uint16), np.minimum(c[at], np.iinfo(np.int32).max).astype(np.int32)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """Rows (lang, buckets, counts) of the documents whose hash of id and text is below their label's share of its range.

    The share is the label's part of the sample over its documents, so no label's rows are gathered or sorted, and
    labels with their counts stay a table. Equal rows count once in the sample.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("long").alias("id"), F.pmod(F.xxhash64(id_col, text_col), F.lit(SHARES)).alias("h"), F.col(text_col).alias("text"))
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.write(rows.groupBy("lang").agg(F.count("*").alias("size")), "labels")
    labels = sizes.count()
    each = min(PER_LANG, SAMPLE / max(1, labels))
    shares = scratch.write(sizes.select("lang", (F.least(F.lit(1.0), F.lit(each) / F.col("size")) * SHARES).cast("long").alias("share")), "shares")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                buf, offs = buffers(part.column("text"))
                got = [frequent(buf[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]])) for k in range(part.num_rows)]
                yield pa.record_batch([part.column("id"), part.column("lang"), *(pa.array([x[k].tobytes() for x in got], pa.binary()) for k in (0, 1))], names=["id", "lang", "at", "n"])

    # the most that any label's share can be, so that rows are few before they meet their label
    top = shares.agg(F.max("share")).first()[0] or 0
    picked = rows.where(F.col("h") < top).join(shares, "lang").where("h < share").dropDuplicates(["lang", "id", "h"])
    got = picked.select("id", "lang", "text").mapInArrow(run, "id long, lang string, at binary, n binary").collect()
    return sorted(got, key=lambda r: (r["id"] is None, r["id"] or 0, r["lang"], r["at"], r["n"]))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 12, rate: float = 2.0, seed: int = 7) -> Model | None:
    """A model from the labelled rows given; None if there are none."""
    rows = [r for r in sample(docs, id_col, text_col, lang_col) if len(r["at"])]
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    y = np.array([langs.index(r["lang"]) for r in rows])
    x = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.int32)) for r in rows]
    x = [(a, (n / n.sum()).astype(np.float32)) for a, n in x]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: int(len(x) * CALIBRATION)]
    fit = order[len(held) :]
    if not len(held):
        held = fit
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            a, n = x[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = n @ emb[a]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            emb[a] -= (lr * len(a) ** 0.5) * n[:, None] * back[None, :]
    logits = np.stack([x[i][1] @ emb[x[i][0]] for i in held]) @ out + bias
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    right = softmax(logits / heat).max(1)
    least = min(0.5, float(np.quantile(right, REJECT)))
    return Model(langs, (emb @ out).astype(np.float32), bias.astype(np.float64), heat, least)


def judged(docs: DataFrame, model: Model | None, text_col: str, keep_only: bool = False) -> DataFrame:
    """All columns and __lang, __score, __rejected; with keep_only the rows that aren't rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in chunks(batch, text_col, 1 << 20):
                texts = part.column(text_col)
                buf, offs = buffers(texts)
                known = has_letter(texts, buf, offs) & (m is not None)
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if known.any():
                    p = m.scores(buf, offs)
                    lang[known] = np.array(m.langs, object)[p.argmax(1)][known]
                    score[known] = np.clip(p.max(1), 0, 1)[known]
                rejected = ~known | (score < (m.least if m else 1.0))
                if keep_only:
                    yield part.filter(pa.array(~rejected))
                else:
                    out = dict(zip(part.schema.names, part.columns))
                    yield pa.record_batch([*out.values(), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*out, "__lang", "__score", "__rejected"])

    if keep_only:
        return docs.mapInArrow(run, fields)
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    more = StructType([*fields.fields]).add("__lang", StringType()).add("__score", DoubleType()).add("__rejected", BooleanType())
    return docs.mapInArrow(run, more)


def held_out(id_col: str = "doc_id"):
    """Whether a document must not be learned from: crc32 of its id as text leaves 2 modulo 4; false if the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row; learned from labelled rows that aren't held out.

    Rows with a null id are not learned from. Without any labelled row every text is `und`.
    """
    model = train(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col)
    out = judged(docs.select(id_col, text_col), model, text_col)
    return out.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language isn't rejected, with all their columns."""
    model = train(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)), id_col, text_col, lang_col)
    return judged(docs, model, text_col, keep_only=True)
