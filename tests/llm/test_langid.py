import zlib

import numpy as np

from sparkmart.llm import langid
from sparkmart.llm.common import table

from .helpers import SCHEMA, empty, frame


def test_held_out_accuracy(spark, data):
    docs = table(spark, data.replace("0.001", "0.01"), "documents")
    got = langid.predicted(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def test_awkward_rows(spark):
    got = langid.predicted(frame(spark)).collect()
    assert len(got) == frame(spark).count()
    docs = spark.createDataFrame([(1, "hello there my friends", "en", "s", 0), (5, "bonjour mes chers amis", "fr", "s", 0), (9, None, "en", "s", 0), (10, "123 !!", "en", "s", 0), (11, "", None, "s", 0), (12, "日本語", None, "s", 0)], SCHEMA)
    by = {r["doc_id"]: r for r in langid.predicted(docs).collect()}
    for i in (9, 10, 11):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert by[12]["lang_pred"] in ("en", "fr")


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, f"text number {k} abc", "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else "en", "s", 0) for k in range(60)]
    assert {r["lang_pred"] for r in langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect()} == {"en"}


def test_no_labels(spark):
    rows = [(1, "some text", None, "s", 0)]
    assert [r["lang_pred"] for r in langid.predicted(spark.createDataFrame(rows, SCHEMA)).collect()] == ["und"]
    assert langid.predicted(empty(spark)).collect() == [] and langid.kept(empty(spark)).collect() == []


def test_kept_keeps_columns(spark):
    df = frame(spark)
    out = langid.kept(df)
    assert out.schema == df.schema
    assert out.where("text is null").count() == 0


def test_subwords_stay_within_texts():
    buf, offs = np.frombuffer(b"abcdx", np.uint8), np.array([0, 4, 4, 5])
    h, edge = langid.subwords(buf, offs, 3)
    assert edge.tolist() == [0, 2, 2, 2] and len(h) == 2
    assert h.tolist() == langid.subwords(np.frombuffer(b"abcd", np.uint8), np.array([0, 4]), 3)[0].tolist()


def plain_scores(model, text):
    """One text's probabilities by plain loops over its subwords."""
    b = langid.NORMAL[np.frombuffer(text.encode(), np.uint8)].tolist()
    total, count = [0.0] * len(model.langs), 0
    for n in (2, 3, 4):
        for k in range(len(b) - n + 1):
            h = n
            for x in b[k : k + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
            h = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.BUCKETS.bit_length() + 1)
            total, count = [t + float(w) for t, w in zip(total, model.table[h])], count + 1
    z = np.array([(t / max(count, 1) + c) / model.temperature for t, c in zip(total, model.bias)])
    e = np.exp(z - z.max())
    return e / e.sum()


def test_scores_equal_plain_loops(spark, data, monkeypatch):
    docs = table(spark, data, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    texts = ["x", "", "né", "a few plain words", "ß" * 9, *[r["text"] for r in docs.where("length(text) < 400").limit(5).collect()]]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = np.array([plain_scores(model, t) for t in texts])
    for size, cells in ((langid.SLICE, langid.CELLS), (7, 20), (1, 1), (50, 1 << 20)):
        monkeypatch.setattr(langid, "SLICE", size)
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.allclose(model.scores(buf, offs), want, atol=1e-5)


def test_a_long_text_and_many_labels_take_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    model = langid.Model([f"l{k}" for k in range(500)], rng.normal(0, 1, (langid.BUCKETS, 500)).astype(np.float32), np.zeros(500), 1.0, 0.1)
    buf = rng.integers(97, 123, 50 << 20).astype(np.uint8)
    tracemalloc.start()
    langid.Model.scores(model, buf[: 8 << 20], np.array([0, 8 << 20]))
    small = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert small < 150 << 20
    assert len(list(langid.sliced(buf, np.array([0, len(buf)]), 3))) == 50


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rows = [(k, f"text number {k} of many", f"l{k % 30}", "s", 0) for k in range(3000)] + [(1, "text number 1 of many", "l1", "s", 0)] * 50
    got = langid.sample(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang")
    assert 20 < len(got) < 130 and len({r["lang"] for r in got}) > 15
    monkeypatch.setattr(langid, "GRAMS", 5)
    at, n = langid.frequent(np.frombuffer(b"aaaaaaaaaa abc", np.uint8), np.array([0, 14]))
    assert len(at) == len(n) == 5 and n.max() == 9 and (np.diff(at.astype(int)) > 0).all()
