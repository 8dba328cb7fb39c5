import pytest
from brute import utc_ms

from quern.operators import timestamps as T

ROWS = [
    ("2024-03-10T02:30:00", "America/New_York"),  # never shown
    ("2024-11-03 01:30:00", "America/New_York"),  # shown twice
    ("2024-11-03 01:30:00 EST", "America/New_York"),
    ("2024-03-31T02:15:00.123", "Europe/Berlin"),
    ("2024-07-01 12:00:00", None),
    ("2024-07-01 12:00:00", "Asia/Kathmandu"),
    ("01.02.2024 03:04:05", "UTC"),
    ("2/29/2024 3:04:05 PM", "UTC"),
    ("2/29/2023 3:04:05 PM", "UTC"),
    ("Apr 2, 2024 12:01:10 AM", "Asia/Tokyo"),
    ("Sun, 03 Nov 2024 00:46:38 -0700", None),
    ("2024-01-14T12:06:18+05:45[Asia/Kathmandu]", None),
    ("20230710T184648Z", None), ("1690060155110590", None), ("1688333826436", None), ("1688629928", None),
    ("2023-07-04T00:06:07.061999999Z", None), ("2023-07-10T18:47:18,851Z", None), ("2024-13-01 00:00:00Z", None),
    ("2024-07-01 24:00:00Z", None), ("2024-07-01", "UTC"), ("2024-07-01T05", "UTC"), ("", "UTC"), (None, "UTC"), ("yesterday", "UTC"), ("2023/07/04 22:48:48 +0545", None), ("1850-07-01 12:00:00 UTC", None), ("9999-12-31T23:59:59.250Z", None), ("0000-12-31T23:59:59Z", None),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, r, z) for i, (r, z) in enumerate(ROWS)], "i int, raw string, zone string").selectExpr("*", "'one' as src")
    got = {r.i: r for r in T.normalise(df, "raw", "zone", "src").collect()}
    for i, (raw, zone) in enumerate(ROWS):
        want = utc_ms(raw, zone)
        have = got[i].utc_micros
        assert (None if have is None else have // 1000) == want, (raw, zone, got[i])
    assert got[0].time_state == got[1].time_state == "skipped_or_repeated"
    assert got[4].time_state == "no_zone"


def test_doubtful_dates_follow_their_source(spark):
    rows = [("us", f"{m}/{d}/2024 10:00:00") for m, d in [(1, 13), (2, 25), (3, 30), (4, 14), (4, 5)] * 40]
    rows += [("eu", f"{d}/{m}/2024 10:00:00") for m, d in [(1, 13), (2, 25), (3, 30), (4, 14), (4, 5)] * 40]
    rows += [("odd", "4/5/2024 10:00:00"), (None, "6/6/2024 10:00:00")]
    df = spark.createDataFrame(rows, "src string, raw string").selectExpr("*", "'UTC' as zone", "1 as n", "2 as __other")
    out = {(r.src, r.raw): r for r in T.normalise(df, "raw", "zone", "src").collect()}
    from datetime import datetime, timezone

    at = lambda m, d: int(datetime(2024, m, d, 10, tzinfo=timezone.utc).timestamp() * 1e6)
    assert out["us", "4/5/2024 10:00:00"].utc_micros == at(4, 5)
    assert out["eu", "5/4/2024 10:00:00"].utc_micros == at(4, 5)
    assert out["us", "4/5/2024 10:00:00"].time_state == "chosen"
    assert out["odd", "4/5/2024 10:00:00"].time_state == "ambiguous" and out["odd", "4/5/2024 10:00:00"].utc_micros is None
    assert out[None, "6/6/2024 10:00:00"].utc_micros == at(6, 6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw string, zone string, src string")
    assert T.normalise(df, "raw", "zone", "src").count() == 0


@pytest.mark.parametrize("fmts,n,best", [([("month_first+day_first", 5), ("month_first", 50)], 2, "month_first"), ([("month_first+day_first", 5), ("day_first", 50)], 2, "day_first")])
def test_mixture(spark, fmts, n, best):
    df = spark.createDataFrame([("s", f, k) for f, k in fmts], "source string, fmts string, n bigint")
    w = {r.fmt: r.weight for r in T.notation_mixture(df).collect()}
    assert max(w, key=w.get) == best and abs(sum(w.values()) - 1) < 1e-6
