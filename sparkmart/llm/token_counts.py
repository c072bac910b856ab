"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content, with a digest of the tokenizer's file. Normalising must not
change counts: null is empty, and for a sentencepiece file its space sign is a space, which that library can't tell apart. Counts that the cache holds are joined by that key; the
distinct texts that it lacks are encoded once each and appended. Equal texts are merged before they are
dealt out, so a text that a third of all rows hold is sent once a task.

No piece of the vocabulary has a space sign after another sign, so no merge reaches over the end of a
word, and a text's count is the sum over its words, each with the spaces before it. A worker keeps the
counts of words, up to `KEEP`. This is checked against the vocabulary; where it doesn't hold, whole texts are encoded.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks

KEEP = 500_000
#: What sentencepiece writes for a space.
SIGN = "▁"
WORD = re.compile(" +[^ ]*")
CACHE = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Counts:
    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.by_word = not any(SIGN in p.lstrip(SIGN) for p in pieces) and model.encode("a  b") != model.encode("a b") and model.encode("\t") != []
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            self.lengths = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            self.by_word = False
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return self.lengths(texts)
        # the library can't tell its space sign from a space
        listed = [Counter(WORD.findall(" " + t.replace(SIGN, " "))) if t else {} for t in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*listed) if w not in known]
        # a text gets a space sign at its beginning, which stands for a word's first space
        known.update(zip(new, self.lengths([w[1:] for w in new])))
        known[" "] = 1  # at a text's end; as a text of its own it would be empty
        return [sum([n * known[w] for w, n in c.items()]) for c in listed]


_LOADED: dict[str, Counts] = {}


def loaded(path: str) -> Counts:
    if path not in _LOADED:
        _LOADED[path] = Counts(path)
    return _LOADED[path]


def cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; empty where nothing was appended yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)


def counted(docs: DataFrame, tokenizer: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; what the cache at `cache_path` lacks is appended to it.

    Without a path the cache is a table of its own in the shared folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cache_path = cache_path or scratch.path("cache")
    version = tokenizer_digest(tokenizer)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    rows = rows.withColumn("text", F.translate("whole", SIGN, " ") if tokenizer.endswith(".model") else F.col("whole")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    stored = cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = loaded(tokenizer)
        for batch in batches:
            for part in chunks(batch, "text"):
                n = c.count(part.column("text").to_pylist())
                yield pa.record_batch([part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row of each text in this task's batches, before they are dealt out
        seen: set = set()
        for batch in batches:
            keys = batch.column("digest").to_pylist()
            fresh = []
            for k in keys:
                fresh.append(k not in seen)
                seen.add(k)
            if len(seen) > KEEP:
                seen = set()
            yield batch.filter(pa.array(fresh))

    first = rows.select("digest", "text").mapInArrow(distinct, "digest string, text string")
    misses = first.join(stored, "digest", "left_anti").dropDuplicates(["digest"])
    misses.select("digest", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    now = cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    # as a table, so that the join deals both sides out by itself and can split a digest that many rows have
    now = scratch.write(now, "counts")
    slim = rows.select(F.col(id_col), "digest", F.octet_length("whole").cast("long").alias("n_bytes"))
    return slim.join(now, "digest", "left").select(F.col(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
