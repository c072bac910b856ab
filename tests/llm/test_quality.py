from collections import Counter

from pyspark.sql import functions as F

from sparkmart.llm import quality

from .helpers import SCHEMA, awkward, empty, frame, words


def brute(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    again = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def rows_with_repeats():
    more = [(500 + k, t, "en", "b", 0) for k, t in enumerate(["x y z " * 40, "l m n\nl m n\n l m n\n\n\nl m n", "# $ % a<b> " * 30, "one two three four " * 20 + "#" * 400])]
    return awkward() + more


def test_counts_equal_brute_force(spark):
    rows = rows_with_repeats()
    got = quality.judged(frame(spark, rows)).collect()
    want = Counter((r[0], *brute(r[1])) for r in rows)
    assert Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_kept_documents_are_those_judged_kept(spark):
    df = frame(spark, rows_with_repeats())
    out = quality.kept_documents(df)
    assert out.schema == df.schema
    kept = quality.judged(df).where("kept").select("doc_id")
    assert sorted(r[0] for r in out.select("doc_id").collect() if r[0] is not None) == sorted(r[0] for r in kept.collect() if r[0] is not None)


def test_hosts_decide_on_doubtful_documents(spark):
    good = " ".join(f"word{k}" for k in range(80))
    doubtful = good + " " + "#" * 90
    rows = [(k, good, "en", "clean", 0) for k in range(400)] + [(1000, doubtful, "en", "clean", 0)] + [(2000 + k, doubtful, "en", "spam", 0) for k in range(50)] + [(3000 + k, good, "en", "spam", 0) for k in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1000] and got[0] and not got[2000] and got[3000]


def test_prior():
    assert quality.prior(None, None, None, 0) == (0.5, 0.5)
    a, b = quality.prior(0.2, 100 * 0.2**2, 100, 5)  # no spread between hosts: a strong prior
    assert abs(a - 200) < 1e-9 and abs(b - 800) < 1e-9
    a, b = quality.prior(0.5, 50.0, 100, 2)  # hosts are all good or all bad: a weak one
    assert (a, b) == (0.5, 0.5)


def test_empty_table(spark):
    assert quality.judged(empty(spark)).collect() == [] and quality.kept_documents(empty(spark)).collect() == []


def test_clashing_names(spark):
    df = frame(spark).withColumn("kept", F.lit(1))
    assert quality.judged(df).count() == df.count()
