import random
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sparkmart.llm import token_counts

from .helpers import awkward, empty, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_equals_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    signs = ["<s>", "</s>", "<unk>", "<0x0A>", *"aAbBcC éÉñΣσİß▁ \n\t\x0b\x85\xa0  .,!##**日本語👍🏽thetion   \x00"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(8000)] + ["", " ", "  ", "a  ", " a", "▁", "▁▁ a", "a▁ b", "x" * 50_000, " " * 3000]
    counts = token_counts.loaded(PATH)
    assert counts.by_word
    assert counts.count(texts) == [len(x) for x in model.encode(texts)]


def test_rows_and_cache(spark, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows, path = awkward(), f"{tmp_path}/cache"
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 4096) for r in rows for n in [len(model.encode(r[1] or ""))])
    df = frame(spark)
    assert Counter(map(tuple, token_counts.counted(df, PATH, path).collect())) == want
    stored = token_counts.cache(spark, path)
    distinct = len({r[1] or "" for r in rows})
    assert stored.count() == stored.select("digest").distinct().count() == distinct
    # a second time nothing is missing; one new text is one new row
    assert Counter(map(tuple, token_counts.counted(df, PATH, path).collect())) == want
    assert token_counts.cache(spark, path).count() == distinct
    token_counts.counted(frame(spark, [(1, "brand new", "en", "s", 0)] * 3), PATH, path)
    assert token_counts.cache(spark, path).count() == distinct + 1


def test_a_poisoned_cache_shows_that_it_is_read(spark, tmp_path):
    path = f"{tmp_path}/cache"
    docs = frame(spark, [(1, "some words", "en", "s", 0)])
    digest = docs.selectExpr("sha2(cast(text as binary), 256)").first()[0]
    spark.createDataFrame([(digest, token_counts.tokenizer_digest(PATH), 99), (digest, "another tokenizer", 7)], token_counts.CACHE).write.parquet(path)
    assert token_counts.counted(docs, PATH, path).first()["n_tokens"] == 99


def test_texts_that_the_library_cannot_tell_apart_are_one(spark, tmp_path):
    path = f"{tmp_path}/cache"
    docs = frame(spark, [(1, "a▁b c", "en", "s", 0), (2, "a b▁c", "en", "s", 0)])
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in token_counts.counted(docs, PATH, path).collect()) == [(7, 3), (7, 3)]
    assert token_counts.cache(spark, path).count() == 1


def test_the_query_finds_part_of_its_counts_stored(spark, data, monkeypatch):
    asked = []
    monkeypatch.setattr(token_counts, "cache", lambda s, p, f=token_counts.cache: asked.append(f(s, p).count()) or f(s, p))
    from sparkmart.llm import queries

    assert queries.op9_token_counts(spark, data).count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert 0 == asked[0] < asked[2] < asked[3]  # nothing; a fifth; all


def test_other_kind_of_file(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.counted(frame(spark), path).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in awkward())


def test_empty_table(spark):
    assert token_counts.counted(empty(spark), PATH).collect() == []
