from pyspark.sql import functions as F

from quern import adapters, ingest
from quern.streaming import streams


def test_windows_equal_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    src = str(tmp_path / "in")
    ev.coalesce(1).write.parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    got = streams.run_to_end(streams.window_counts(s), "w1", "append")
    batch = ev.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    top = got.agg(F.max("window_start")).first()[0]
    want = {(r.w.start, r.event_type): r.n for r in batch.collect() if r.w.start <= top}
    have = {(r.window_start.replace(tzinfo=None), r.event_type): r.n for r in got.collect()}
    assert have and {k: v for k, v in want.items() if k in have} == have and len(have) >= len(want) - 10


def test_sessions_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    ev.write.parquet(src)
    out = streams.run_to_end(streams.sessions(spark.readStream.schema(ev.schema).parquet(src)), "w2", "append")
    assert out.count() > 0 and out.where("n < 1").count() == 0


def test_ingest_stream_is_idempotent(spark, sf, tmp_path):
    ev = adapters.log_events(spark, sf).where("source_agent = 'codex'")
    land, out, cp = (str(tmp_path / x) for x in ("land", "out", "cp"))
    ev.select(*adapters.EVENT_COLUMNS).write.parquet(land)
    streams.ingest_stream(spark, land, out, cp).awaitTermination()
    n = ingest.Archive.open(spark, out).events().count()
    assert n == ev.count()
    streams.ingest_stream(spark, land, out, str(tmp_path / "cp2")).awaitTermination()  # the same files again
    assert ingest.Archive.open(spark, out).events().count() == n


def test_watch_scrapes_what_changed(spark, tmp_path):
    import json

    from quern.sources.connector import Connector

    root = tmp_path / "logs"
    root.mkdir()
    say = lambda t: json.dumps({"role": "user", "content": t})
    (root / "a.jsonl").write_text(say("one"))
    c = Connector("w", "1", [f"{root}/*.jsonl"], "jsonl", parser={"role": "role", "content": "content"})
    got = []
    counters = streams.Counters()
    spark.streams.addListener(counters)
    run = lambda: [q.awaitTermination() for q in streams.watch(spark, [c], str(tmp_path / "out"), str(tmp_path / "cp"), done=got.append)]
    run()
    (root / "b.jsonl").write_text(say("two"))
    run()
    run()
    spark.streams.removeListener(counters)
    assert [g["files"] for g in got] == [1, 1] and ingest.Archive.open(spark, f"{tmp_path}/out/archive").events().count() == 2
    assert sum(counters.batches.values()) >= 2


def test_sessions_of_a_table_stay_off_the_driver_and_are_whole(spark, tmp_path):
    """Files in place of a table in the driver's memory; events 30 minutes apart, long ago or late among them."""
    import duckdb

    import __spark_entry__ as entry

    (tmp_path / "events.parquet").mkdir()
    con = duckdb.connect()
    at = ["2024-03-01", "2024-01-01 00:00:00", "2024-01-01 00:30:00", "2024-01-01 00:59:59.999999", "1969-07-20 20:17:00", "2024-01-01"]
    for i, t in enumerate(at):
        con.execute(f"copy (select {i}::bigint as event_id, timestamp '{t}' as ts, 1::bigint as user_id, 'x' as event_type, 1.0::double as value, '' as props) to '{tmp_path}/events.parquet/{i}.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["stream_sessions"](spark, str(tmp_path))
    assert got.inputFiles()
    want = con.execute(f"select user_id, started, until, n from ({entry.oracle_sql()['stream_sessions']})").fetchall()
    assert sorted(map(tuple, got.select("user_id", "started", "until", "n").collect())) == sorted(want) and len(want) == 4


def test_files_hold_the_last_batch(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src = str(tmp_path / "in")
    ev.repartition(3).write.parquet(src)
    was = {k: spark.conf.get(k, None) for k in streams.STATE}
    got = streams.run_to_files(streams.sessions(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src), late=None), "w3")
    whole = streams.run_to_files(streams.sessions(spark.readStream.schema(ev.schema).parquet(src), late=None), "w4")
    assert got.agg(F.sum("n")).first()[0] == ev.count() and got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert {f.split("/")[-2] for f in got.inputFiles()} == {"2"}  # no batch before the last
    assert {k: spark.conf.get(k, None) for k in streams.STATE} == was
