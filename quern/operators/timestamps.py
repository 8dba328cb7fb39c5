"""Timestamps of mixed notation as one UTC instant (problem 4).

Every value is parsed under each notation that fits it; a value with one valid
reading is settled by that reading.  Where several readings of a value are
valid and denote different instants (month-first against day-first), an
expectation-maximisation over the notation mixture of each source decides: all
values of the source contribute likelihood under each of their readings, and
the posterior chooses, or leaves the value marked ``ambiguous``.

Wall-clock times are held as microseconds "as if UTC" in a BIGINT, so that
nothing depends on the session's time zone.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import shared_checkpoint, staged

# Offsets in minutes of zone abbreviations that name one offset only.
# Abbreviations that several zones share (IST, CST, BST) are left out on purpose.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "NPT": 345,
}
# Month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,9})\d*)?"
_ZONE = r"\s*(Z|z|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?|)(?:\[[A-Za-z0-9_/+-]+\])?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_MON = "(" + "|".join(MONTHS) + ")[a-z]*"
# Notation families; the groups are year, month, day in some order, then hour, minute, second, fraction, half of the day, zone.
_CANON = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{3}))?()(Z)$"
_YMD = rf"^\s*(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[Tt]|\s+){_TIME}{_HALF}{_ZONE}\s*$"
_COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9})\d*)?()" + _ZONE + r"\s*$"
_DOTS = rf"^\s*(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?(?:[Tt]|\s+){_TIME}{_HALF}{_ZONE}\s*$"
_SLASHES = rf"^\s*(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?(?:[Tt]|\s+){_TIME}{_HALF}{_ZONE}\s*$"
_MDY = rf"^\s*{_MON}\.? (\d{{1,2}}),? (\d{{4}}),?\s+{_TIME}{_HALF}{_ZONE}\s*$"
_DMY = rf"^\s*(?:[A-Z][a-z]{{2,8}},? )?(\d{{1,2}})[ -]{_MON}[ -](\d{{4}}),?\s+{_TIME}{_HALF}{_ZONE}\s*$"
_EPOCH = r"^\s*(\d{10}|\d{13}|\d{16}|\d{19})(?:\.\d+)?\s*$"


def _shape(raw: Column) -> Column:
    """One regex pass: notation|year|month|day|hour|minute|second|fraction|half|zone, null where nothing fits.

    Epochs give notation|digits.  Numeric dates with slashes give month and day
    in the order written; which is which is settled later.
    """

    def take(pattern: str, fmt: str, order: list[int]) -> tuple[Column, Column]:
        return raw.rlike(pattern), F.regexp_replace(raw, pattern, fmt + "".join(f"|${i}" for i in order))

    cases = [
        take(_CANON, "rfc3339", [1, 2, 3, 4, 5, 6, 7, 8, 9]),
        take(_YMD, "year_first", [1, 2, 3, 4, 5, 6, 7, 8, 9]),
        take(_DOTS, "dots", [3, 2, 1, 4, 5, 6, 7, 8, 9]),
        take(_SLASHES, "slashes", [3, 1, 2, 4, 5, 6, 7, 8, 9]),
        take(_MDY, "month_name_first", [3, 1, 2, 4, 5, 6, 7, 8, 9]),
        take(_DMY, "rfc2822", [3, 2, 1, 4, 5, 6, 7, 8, 9]),
        take(_EPOCH, "epoch", [1]),
        take(_COMPACT, "compact", [1, 2, 3, 4, 5, 6, 7, 8, 9]),
    ]
    return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))


def _wall(y: str, mo: str, d: str) -> Column:
    """Microseconds of the wall-clock reading from the staged columns, null if date or time isn't valid."""
    return F.expr(f"""case when {y} between 1 and 9999 and {mo} between 1 and 12 and __h between 0 and 23
        and __mi between 0 and 59 and __s between 0 and 59
        and {d} between 1 and day(last_day(make_date({y}, {mo}, 1)))
        then ((datediff(make_date({y}, {mo}, {d}), date'1970-01-01') * 24L + __h) * 60 + __mi) * 60000000L + __s * 1000000L + __us end""")


def with_readings(df: DataFrame, raw: str) -> DataFrame:
    """Add ``__fmts`` (names of the valid notations, '+' between, null if none), ``__zone``, ``__utc``, ``__w1`` and ``__w2``.

    ``__utc`` is the instant of an epoch; ``__w1`` and ``__w2`` are wall-clock
    readings in the order of ``__fmts``.
    """
    months = "array(" + ",".join(f"'{m}'" for m in MONTHS) + ")"
    zone = F.upper(F.get(F.col("__p"), 9))
    names = reduce(lambda acc, kv: acc.when(F.col("__zone") == kv[0], F.lit(kv[1])), ZONE_MINUTES.items(), F.when(F.lit(False), 0))
    part = lambda i: f"try_cast(get(__p, {i}) as int)"
    cut = staged(df.withColumn("__p", F.split(_shape(F.col(raw)), r"\|")), "__p")
    read = (
        cut
        .withColumns({
            "__k": F.col("__p")[0],
            "__y": F.expr(part(1)),
            "__mo": F.expr(f"coalesce({part(2)}, nullif(cast(array_position({months}, get(__p, 2)) as int), 0))"),
            "__d": F.expr(part(3)),
            "__h": F.expr(f"case upper(get(__p, 8)) when '' then {part(4)} else case when {part(4)} between 1 and 12 then {part(4)} % 12 + if(upper(get(__p, 8)) = 'P', 12, 0) end end"),
            "__mi": F.expr(part(5)),
            "__s": F.expr(part(6)),
            "__us": F.expr("case when get(__p, 7) = '' then 0 else try_cast(rpad(get(__p, 7), 6, '0') as int) end"),
            "__zone": zone,
            "__n": F.expr("case when __p[0] = 'epoch' then try_cast(__p[1] as bigint) end"),
        })
        .withColumns({
            "__first": _wall("__y", "__mo", "__d"),
            "__swapped": F.when(F.col("__k") == "slashes", _wall("__y", "__d", "__mo")),
            "__off": F.expr("case when __zone rlike '^[+-]' then (case when __zone like '-%' then -1 else 1 end) * (cast(substr(__zone, 2, 2) as int) * 60 + coalesce(try_cast(right(substr(__zone, 4), 2) as int), 0)) else null end"),
            "__named": names,
            "__utc": F.expr("case length(__n) when 10 then __n * 1000000L when 13 then __n * 1000L when 16 then __n when 19 then floor(__n / 1000) end").cast("bigint"),
        })
        .withColumns({
            "__off": F.coalesce("__off", "__named"),
            "__w1": F.coalesce("__first", "__swapped"),
            "__w2": F.expr("case when __first != __swapped then __swapped end"),
            "__fmts": F.expr("""case when __utc is not null then concat('epoch_', length(__n))
                when __k = 'slashes' then case when __first = __swapped then 'slashes_either' when __first is not null and __swapped is not null then 'month_first+day_first'
                    when __first is not null then 'month_first' when __swapped is not null then 'day_first' end
                when __first is not null then __k end"""),
        })
        .withColumn("__fmts", F.expr("case when __zone != '' and __off is null then null else __fmts end"))
        .drop("__p", "__k", "__y", "__mo", "__d", "__h", "__mi", "__s", "__us", "__n", "__first", "__swapped", "__named")
    )
    return staged(read, "__fmts", "__zone", "__off", "__utc", "__w1", "__w2")


def wall_to_utc(wall: Column, zone: Column) -> Column:
    """The instant at which the zone's clock showed ``wall``; null if it showed it never or twice, or without a zone.

    The two offsets in force a day before and a day after bound the candidates;
    a candidate counts if the zone's clock shows ``wall`` at it.
    """
    day = 86_400_000_000
    shown = lambda utc: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
    a = wall - (shown(wall - day) - (wall - day))
    b = wall - (shown(wall + day) - (wall + day))
    a_ok, b_ok = shown(a) == wall, shown(b) == wall
    return F.when(zone.isNotNull(), F.when(a == b, F.when(a_ok, a)).when(a_ok & b_ok, None).when(a_ok, a).when(b_ok, b))


def notation_mixture(counts: DataFrame, rounds: int = 200) -> DataFrame:
    """EM of the mixture weights per source.

    ``counts``: source, fmts (the notations under which a value is valid), n.
    One row a source and set of notations, so a group has at most as many rows
    as there are sets of notations, however many values the source has.
    Returns source, fmt, weight.
    """

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [(str(f).split("+"), float(n)) for f, n in zip(pdf["fmts"], pdf["n"])]
        names = sorted({f for fs, _ in sets for f in fs})
        w = {f: 1.0 / len(names) for f in names}
        for _ in range(rounds):
            got = dict.fromkeys(names, 1e-3)  # a weak prior keeps unseen notations possible
            for fs, n in sets:
                total = sum(w[f] for f in fs)
                for f in fs:
                    got[f] += n * w[f] / total
            s = sum(got.values())
            new = {f: x / s for f, x in got.items()}
            moved = max(abs(new[f] - w[f]) for f in names)
            w = new
            if moved < 1e-9:
                break
        return pd.DataFrame({"source": pdf["source"].iloc[0], "fmt": names, "weight": [w[f] for f in names]})

    return counts.groupBy("source").applyInPandas(em, "source string, fmt string, weight double")


def month_first_weights(df: DataFrame, raw: str, source: str) -> DataFrame:
    """source, month_first (posterior that a doubtful value of the source is month first), for sources with doubtful values."""
    src = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    other = df.where(~F.coalesce(F.col(raw).rlike(CANONICAL), F.lit(True))).select(F.col(raw), src)
    sets = with_readings(other, raw).where("__fmts is not null").groupBy("source", F.col("__fmts").alias("fmts")).agg(F.count("*").alias("n"))
    # One row a source and set of notations; written once, read twice.
    sets = shared_checkpoint(sets)
    doubtful = sets.where(F.col("fmts").contains("+")).select("source").distinct()
    weights = notation_mixture(sets.join(doubtful, "source", "left_semi"))
    w = weights.where(F.col("fmt").isin("month_first", "day_first")).groupBy("source").agg(
        F.sum(F.expr("if(fmt = 'month_first', weight, 0)")).alias("m"), F.sum("weight").alias("t"))
    return w.select("source", (F.col("m") / F.col("t")).alias("month_first"))


def normalise(df: DataFrame, raw: str, zone: str, source: str, threshold: float = 0.99, broadcast_sources: int = 100_000) -> DataFrame:
    """Add ``utc_micros`` (BIGINT, null if unresolved) and ``time_state`` to ``df``; rows stay one to one.

    ``raw`` is the text, ``zone`` the name of the machine's time zone (null if
    unknown), ``source`` the column whose values share a mixture of notations
    (nulls form one source).  States: ``settled`` (one reading), ``chosen`` (by
    posterior), ``ambiguous`` (posterior below the threshold), ``no_zone``,
    ``skipped_or_repeated`` (that clock showed the time never or twice),
    ``unreadable`` (null, empty, incomplete and invalid values too).

    The posteriors are one row a source in doubt.  They are counted first: up to
    ``broadcast_sources`` they go to every task, beyond that by a shuffled join.
    """
    weights = month_first_weights(df, raw, source)
    small = weights.limit(broadcast_sources + 1).collect()
    parsed = with_readings(df.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))), raw)
    if not small:
        parsed = parsed.withColumn("__m", F.lit(None).cast("double"))
    else:
        w = weights if len(small) > broadcast_sources else F.broadcast(df.sparkSession.createDataFrame([(x[0], x[1]) for x in small], "source string, month_first double"))
        parsed = parsed.join(w.withColumnsRenamed({"source": "__source", "month_first": "__m"}), "__source", "left")
    chosen = parsed.withColumns({
        "__wall": F.expr(f"case when __fmts is null then null when __w2 is null then __w1 when __m >= {threshold} then __w1 when 1 - __m >= {threshold} then __w2 end"),
    })
    chosen = staged(chosen, "__wall").withColumn("__local", F.when(F.col("__zone") == "", wall_to_utc(F.col("__wall"), F.col(zone))))
    utc = F.expr("case when __utc is not null then __utc when __zone = '' then __local else __wall - __off * 60000000L end")
    state = F.expr(f"""case when __fmts is null then 'unreadable' when __utc is null and __wall is null then 'ambiguous'
        when __utc is null and __zone = '' and `{zone}` is null then 'no_zone'
        when __utc is null and __zone = '' and __local is null then 'skipped_or_repeated'
        when __w2 is not null then 'chosen' else 'settled' end""")
    chosen = staged(chosen, "__local")
    done = chosen.select(*[F.col(f"`{c}`") for c in df.columns], utc.alias("utc_micros"), state.alias("time_state"))
    return staged(done, "utc_micros", "time_state")
