"""Documents with every awkward case, and plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 997}" for k in range(30_000))


def awkward(seed=1, n=120):
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, ties, repeated rows and repeated ids."""
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "THE", "the", "日本", "x#y", "end.", "naïve", "ZZZ", "q"] + [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 12, 13, 14, 60, 200]))]
        if k % 5 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", " \n "]) for w in words)
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", "b", None]), len(text)))
    rows += [(n + k, rows[k * 7][1], "en", "hot", 0) for k in range(10)]
    rows += [(None, rows[5][1], "en", "b", 0), (None, None, None, None, None), (n + 20, None, "en", "hot", 0), (n + 21, "", "en", "hot", 0), (n + 22, " \n\t", "en", "b", 3), (n + 23, LONG, "en", "b", 0), (n + 24, LONG + " tail", "en", "b", 0)]
    rows += [rows[3], rows[3], (rows[8][0], "another text under a known id", "en", "b", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None, extra=True, schema=SCHEMA):
    df = spark.createDataFrame(awkward() if rows is None else rows, schema)
    if extra:  # columns whose names an operator might use itself
        df = df.selectExpr("*", *(f"'{c}' as `{c}`" for c in ("id", "fp", "key", "bucket", "chunk", "digest", "n_words", "host", "rate", "h", "label", "n")))
    return df.repartition(3)


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def words(text):
    return WORD.findall(text or "")
