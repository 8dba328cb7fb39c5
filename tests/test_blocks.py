import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import blocks, capacity, relational


def test_blocks_equal_windows(spark):
    rng = random.Random(2)
    rows = [("hot", i * rng.randrange(1, 4) + i * 4, rng.randrange(-5, 6)) for i in range(2000)] + [(f"k{i % 50}", 10_000 + i, i % 7) for i in range(1000)] + [("one", 5, None)]
    df = spark.createDataFrame(list({(a, b): (a, b, c) for a, b, c in rows}.values()), "k string, seq bigint, v bigint")
    w = Window.partitionBy("k").orderBy("seq")
    want = {(r.k, r.seq): (r.p, r.s) for r in df.select("k", "seq", F.lag("v").over(w).alias("p"), F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s")).collect()}
    for size in (1, 64, 100_000):
        a = blocks.lag(df, "k", "seq", ["v"], "p", size)
        b = blocks.running(a, "k", "seq", "v", "s", size, total="all")
        got = {(r.k, r.seq): (r.p.v if r.p else None, r.s) for r in b.collect()}
        assert got == want
    assert blocks.lag(df.limit(0), "k", "seq", ["v"], "p").count() == 0


def test_gap_sessions_and_rolling_equal_brute_force(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(800):
        t += rng.choice([1, 60, 1000, 1900, 90_000])
        rows.append((i % 3, i, t))
    df = spark.createDataFrame(rows, "user bigint, id bigint, sec bigint").withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz"))
    got = {r.id: r.session_no for r in relational.gap_sessions(df, "user", "ts", "id", 1800).collect()}
    for u in range(3):
        n, last = 0, None
        for _, i, s in (r for r in rows if r[0] == u):
            n += last is not None and s - last > 1800
            last = s
            assert got[i] == n
    turns = df.select((F.col("user")).alias("account"), F.col("user").alias("file"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("message_id"), "ts", F.lit("m").alias("model"), F.col("id").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0).alias("cache_read"), F.lit(0).alias("cache_write"))
    roll = {r.seq: r.cost_window for r in capacity.rolling(turns, 3600).collect()}
    for u, i, s in rows:
        if i:
            assert roll[i] == sum(j for v, j, x in rows if v == u and s - 3600 < x <= s)


def test_numbered_and_first_of(spark):
    import random

    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", rng.randrange(1000), i) for i in range(3000)] + [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[i] = k
    got = {r.i: r.n for r in blocks.numbered(df.where("g is not null"), "g", ["v", "i"], "n").collect()}
    assert got == {i: k for i, k in want.items() if i >= 0}
    first = blocks.first_of(df, ["g"], [F.desc("v"), F.asc("i")], 3, salt=4).collect()
    by = {}
    for g, v, i in rows:
        by.setdefault(g, []).append((-v, i))
    assert sorted((r.g or "", r.i) for r in first) == sorted((g or "", i) for g, xs in by.items() for _, i in sorted(xs)[:3])
    assert blocks.numbered(df.limit(0), "g", ["v"], "n").count() == 0 == blocks.first_of(df.limit(0), ["g"], [F.asc("v")], 2).count()


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from quern import session

    class Nothing:
        def isEmpty(self):
            return True

    class Spark:
        class sparkContext:
            master = "spark://somewhere"
            _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()
            getConf = staticmethod(dict)

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Spark())
