"""A stream gives the rows that the batch gives."""

from sparkmart.plans import Graph
from sparkmart.sources import from_driver_tables
from sparkmart.streaming import daily_counts, gap_sessions


def streamed(spark, make, data, name, mode):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{data}/events.parquet*")
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_sessions(spark, data):
    batch = gap_sessions(spark.read.parquet(f"{data}/events.parquet"))
    got = streamed(spark, gap_sessions, data, "sessions", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    model = Graph(from_driver_tables(spark, data), spark)["stg_events"]
    from sparkmart.plans.intermediate import gap_sessions as by_window

    # a gap of exactly half an hour ends a session window but not a run; there is none in the data
    assert by_window(model).count() == batch.count()


def test_days(spark, data):
    batch = daily_counts(spark.read.parquet(f"{data}/events.parquet"))
    got = streamed(spark, daily_counts, data, "days", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
