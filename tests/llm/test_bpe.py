import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkmart.llm import bpe

from .helpers import awkward, empty, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "aAbBcC éÉñΣσςİıßſKÅẞﬁ́̇ \n\t\x0b\x85\xa0 　\x1c\x1f​123½²٣.,!!##**'s't're''日本語한국😀👍🏽<|>\\"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return b" ".join(b"%d" % i for i in ids), library.decode(ids, skip_special_tokens=False).encode(), len(ids)


def test_equals_the_library(library):
    rng = random.Random(7)
    tokens = ["<|startoftext|>", "<|endoftext|>", *SIGNS]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 2000, "*" * 5000, "<|startoftext|>x<|endoftext|>", " 's", "don't we'll THEY'RE I'D", "x" * 100_000]
    got = bpe.loaded(PATH).encode([t.encode() for t in texts])
    assert [t for t, g in zip(texts, got) if g != expected(library, t)] == []


def test_every_code_point_of_two_planes(library):
    signs = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b1{c}{c}2 '{c}x" for c in signs]
    got = [g[0] for k in range(0, len(texts), 50_000) for g in bpe.loaded(PATH).encode([t.encode() for t in texts[k : k + 50_000]])]
    want = [b" ".join(b"%d" % i for i in e.ids) for k in range(0, len(texts), 50_000) for e in library.encode_batch(texts[k : k + 50_000], add_special_tokens=False)]
    assert [hex(ord(c)) for c, g, w in zip(signs, got, want) if g != w] == []


def test_decode(library):
    t = bpe.loaded(PATH)
    ids = [3306, 1002, 49406, 127, 365]
    assert t.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, library):
    got = bpe.encoded(frame(spark), PATH).collect()
    want = [(r[0], e[2], *(hashlib.sha256(x).hexdigest() for x in e[:2])) for r in awkward() for e in [expected(library, r[1] or "")]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encoded(empty(spark), PATH).collect() == []
    lists = bpe.encoded(frame(spark), PATH, ids=True).where("doc_id = 5").first()
    text = next(r[1] for r in awkward() if r[0] == 5)
    assert lists["ids"] == library.encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    t = bpe.Tokenizer(PATH)
    for text in ("one two three four", "two five", "six one two"):
        assert t.encode([text.encode()]) == [expected(library, text)]
