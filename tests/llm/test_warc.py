import gzip
import hashlib

from sparkmart.llm import warc
from sparkmart.llm.common import Scratch

BIG = "<p>é</p>" * 400
ROWS = [
    (1, "http://a.example/", BIG), (2, "http://b.example/x y", BIG), (3, None, BIG), (4, "http://c.example/", "small"), (5, "http://d.example/", "small"), (6, "http://e.example/", None), (7, "", ""),
    (8, "http://f.example/\r\nX: y", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (9, "http://g.example/é", "y" * 3_000_000), (3, "http://again.example/", BIG), (None, "http://null.example/", BIG),
    (None, "http://n1.example/", "n" * 2000), (None, "http://n2.example/", "n" * 2000), (10, "http://h.example/", "z" * 1000), (11, "http://h.example/", "z" * 1000), (12, "h", "z" * 999), (13, "h", "z" * 999),
]
SCHEMA = "page_id long, url string, html string"


def brute():
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        lead = max((j for j, _, x in ROWS if (x or "").encode() == data and j is not None), default=None) if len(data) >= 1000 else None
        copies = sum((x or "").encode() == data for _, _, x in ROWS)
        revisit = lead is not None and lead != i and copies > 1
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=repr)


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'x' as digest", "'x' as lead", "'x' as payload", "'x' as offset").repartition(3)


def test_equals_brute_force(spark):
    assert sorted(map(tuple, warc.round_trip(frame(spark)).collect()), key=repr) == brute()


def test_small_files_and_reads(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 200)
    monkeypatch.setattr(warc, "READ", 300)
    assert sorted(map(tuple, warc.round_trip(frame(spark)).collect()), key=repr) == brute()


def test_index_leads_to_each_record(spark):
    scratch = Scratch(spark)
    folder = scratch.path("warc")
    index = scratch.write(warc.archived(frame(spark), folder), "index")
    system, base = warc.files(folder)
    names = set()
    for r in index.collect():
        with system.open_input_file(f"{base}/{r['file']}") as f:
            fields, http, body = warc.parse(f.read_at(r["length"], r["offset"]))
        assert fields["WARC-Type"] == r["record_type"] and "\r" not in fields["WARC-Target-URI"]
        names.add(fields["WARC-Record-ID"])
        if r["record_type"] == "revisit":
            assert fields["WARC-Refers-To-Target-URI"] in {warc.clean(u) for i, u, _ in ROWS if i == r["refers_to"]}
        assert (hashlib.sha1(body).hexdigest() == r["digest"]) if r["record_type"] == "response" else body == b""
    assert len(names) == len(ROWS)  # repeated and null page ids too
    some = warc.read(index.where("page_id in (4, 9)"), folder, payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in some} == {4: b"small", 9: b"y" * 3_000_000}
    whole = {r["file"] for r in index.collect()}
    with system.open_input_stream(f"{base}/{sorted(whole)[0]}", compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\n")  # members of a file are one stream of records


def test_a_hot_payload_is_split(spark):
    """A third of the pages share a payload; with the entries written first the join deals both sides out by itself."""
    rows = spark.range(3000).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, repeat('hot ', 2000), concat(repeat(cast(xxhash64(id) as string), 400), id)) as html")
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    for k, v in zip(old, ("-1", "-1", "1k", "1.2", "16k")):
        spark.conf.set(k, v)
    try:
        index = warc.archived(rows.repartition(6), Scratch(spark).path("warc"))
        assert index.where("record_type = 'revisit'").count() == 999
        plan = index._jdf.queryExecution().executedPlan()
        index.collect()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ranges():
    assert list(warc.ranges([], [])) == []
    assert list(warc.ranges([0, 10, 20], [10, 10, 10])) == [(0, 3)]
    far = warc.GAP + 11
    assert list(warc.ranges([0, far], [10, 10])) == [(0, 1), (1, 2)]
    assert list(warc.ranges([0, warc.READ], [warc.READ, 5])) == [(0, 1), (1, 2)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
