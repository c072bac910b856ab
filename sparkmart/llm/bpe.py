"""BPE encoding and decoding with a tokenizer file of the word-end kind, in batched numpy merge rounds.

The symbols of many words lie in one flat array. In a round every word's pair of lowest rank is found, by
binary search of all neighbouring pairs in the sorted pair keys, and all its places in that word are merged
from the left; words without a pair that merges drop out. A pair's rank is above the ranks of the pairs that
made its parts, so this equals merging one place at a time by rank.

Words that were encoded before are kept, up to `KEEP` of them, for a worker's life; a text of any
length is only a list of words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

KEEP = 400_000
NONE = np.int32(2**31 - 1)
BLANK = r"[\t-\r \x85\xa0  -     　]"

# Fixed values of the Unicode standard, for tables of Python that are older (unicodedata has version 15.1 or later).
#: Letters and numbers that version 16.0 added.
ADDED = {
    "L": "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0",
    "N": "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA",
}
#: Small letters of those capitals that versions 16.0 and 17.0 added.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEW_CAPITAL = regex.compile("[" + "".join(map(chr, SMALL)) + "]")


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        named = classes()
        self.split = regex.compile(split.replace(r"[^\s", "[^" + BLANK[1:-1]).replace(r"\p{L}", named["L"]).replace(r"\p{N}", named["N"]))
        self.blank = regex.compile(BLANK + "+")
        self.numbers = [b"%d" % i for i in range(len(self.vocab) + len(self.added))]
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.added.items()}
        self.names = [names[i].encode() for i in range(len(names))]
        signs = byte_signs()
        self.first = np.array([self.vocab[signs[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[signs[b] + self.end] for b in range(256)], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        new = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.new = key[order], order.astype(np.int32), new[order].astype(np.int32)
        self.known: dict[bytes, tuple[bytes, bytes, int]] = {}

    def words(self, text: str) -> Iterator[str | int]:
        """Words of the normalised text; ids of added tokens where their strings stand."""
        at = 0
        if self.special is not None and "<|" in text:
            for m in self.special.finditer(text):
                yield from self.plain(text[at : m.start()])
                yield self.added[m[0]]
                at = m.end()
        yield from self.plain(text[at:] if at else text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            # lower case is made sign by sign, without regard to where a sigma stands
            text = self.blank.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
            if NEW_CAPITAL.search(text):
                text = text.translate(SMALL)
        return self.split.findall(text.lower())

    def parted(self, word: str) -> list[str | int]:
        """As `words`; letters with plain signs after them, which most words are, need no pattern."""
        body = word.rstrip(",.:;?!")
        if body.isalpha():
            low = body.lower() if body.isascii() else unicodedata.normalize("NFC", body).replace("Σ", "σ").lower()
            if low.isalpha():
                return [low, word[len(body) :]] if len(body) < len(word) else [low]
        return list(self.words(word))

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's place in the sorted keys, and its rank (NONE: it doesn't merge)."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return at.astype(np.int32), np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, end to end, and where each word's begin."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        at, rank = self.pairs(sym, np.append(sym[1:], 0))
        rank[ends] = NONE
        done_sym, done_word = [], []
        while len(sym):
            lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, lead)
            count = np.diff(np.append(lead, len(sym)))
            over = low == NONE
            if over.any():
                gone = np.repeat(over, count)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                sym, word, at, rank = sym[~gone], word[~gone], at[~gone], rank[~gone]
                count, low = count[~over], low[~over]
            hit = np.flatnonzero(rank == np.repeat(low, count))
            # of places that overlap (as in "aaa") the first, third, ... of a run are merged
            run = np.concatenate([[True], np.diff(hit) != 1])[: len(hit)]
            if not run.all():
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.new[at[hit]]
            rank[hit] = rank[hit + 1]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, at, rank = sym[keep], word[keep], at[keep], rank[keep]
            # only the pairs beside a merged place are new
            hit -= np.arange(len(hit))
            beside = np.concatenate([hit, hit[hit > 0] - 1])
            beside = beside[beside + 1 < len(sym)]
            beside = beside[word[beside] == word[beside + 1]]
            at[beside], rank[beside] = self.pairs(sym[beside], sym[beside + 1])
            final = hit[(hit + 1 >= len(sym)) | (word[hit] != word[np.minimum(hit + 1, len(sym) - 1)])] if len(sym) else hit
            rank[final] = NONE
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def learn(self, new: list[bytes]) -> None:
        """Puts the tokens of words (runs without white space) into `known`."""
        for k in range(0, len(new), 50_000):
            part = new[k : k + 50_000]
            split = [self.parted(w.decode()) for w in part]
            unique = {w: n for n, w in enumerate(dict.fromkeys(w for ws in split for w in ws if isinstance(w, str)))}
            sym, edge = self.merge(list(unique))
            sym, edge = sym.tolist(), edge.tolist()
            numbers, names = self.numbers, self.names
            for raw, ws in zip(part, split):
                if len(ws) == 1 and isinstance(ws[0], str):
                    n = unique[ws[0]]
                    ids = sym[edge[n] : edge[n + 1]]
                else:
                    ids = [i for w in ws for i in ([w] if isinstance(w, int) else sym[edge[unique[w]] : edge[unique[w] + 1]])]
                self.known[raw] = (b" ".join([numbers[i] for i in ids]), b" ".join([names[i] for i in ids]), len(ids))

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes, int]]:
        """For each UTF-8 text its ids as decimals and its decoded text, both joined by spaces, and the number of ids.

        Neither normalisation nor the split into words nor an added token reaches over white space, so runs
        without ASCII white space are encoded once each.
        """
        listed = [t.split() for t in texts]
        if len(self.known) > KEEP:
            self.known.clear()
        known = self.known
        self.learn([w for w in set().union(*listed) if w not in known])
        out = []
        for ws in listed:
            got = [known[w] for w in ws]
            got = [g for g in got if g[2]]  # a word may have no token, such as U+0085
            out.append((b" ".join([g[0] for g in got]), b" ".join([g[1] for g in got]), sum([g[2] for g in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a space between; the file names no other decoder."""
        return b" ".join([self.names[i] for i in ids]).decode()


def classes() -> dict[str, str]:
    """Letters (L) and numbers (N) as ranges of a character class, by the Unicode version that the library splits with."""
    kinds = "".join(c[0] for c in map(unicodedata.category, map(chr, range(0x110000))))
    out = {}
    for kind, more in ADDED.items():
        own = [m.span() for m in regex.finditer(f"{kind}+", kinds)]
        own += [(int(a, 16), int(b or a, 16) + 1) for x in more.split() for a, _, b in [x.partition("-")]]
        out[kind] = "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in own)
    return out


def byte_signs() -> list[str]:
    """The printable sign of each byte: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(0x100 + others.index(b)) for b in range(256)]


_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), or (id, ids array, decoded) with `ids`, for every row. Null text: empty, no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(path)
        for batch in batches:
            for part in chunks(batch, text_col):
                got = t.encode(pc.fill_null(part.column(text_col), "").cast(pa.binary()).to_pylist())
                first = [part.column(id_col).cast(pa.int64())]
                if ids:
                    lists = pa.array([[int(x) for x in g[0].split()] for g in got], pa.list_(pa.int32()))
                    yield pa.record_batch([*first, lists, pa.array([g[1].decode() for g in got], pa.string())], names=[id_col, "ids", "decoded"])
                else:
                    sha = [[hashlib.sha256(g[k]).hexdigest() for g in got] for k in (0, 1)]
                    yield pa.record_batch([*first, pa.array([g[2] for g in got], pa.int64()), *(pa.array(x, pa.string()) for x in sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    more = "ids array<int>, decoded string" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, {more}")
