"""Truncation: blank and short texts, limits of any number and size, tokens and marks of any length."""

import random

import pandas as pd

from quern.llm import truncation

SCHEMA = "row_id bigint, collector string, role string, text string"


def _prose(rng: random.Random, least: int) -> str:
    words = "the parser stage writes every snapshot before queue closes and limiter waits until cache drains".split()
    out = ""
    while len(out) < least:
        out += " ".join(rng.choice(words) for _ in range(rng.randrange(5, 11))).capitalize() + ". "
    return out.strip()


def test_blank_and_short_texts_are_no_case(spark):
    rng = random.Random(2)
    rows = [(i, "c", "assistant", _prose(rng, rng.randrange(20, 300))) for i in range(3000)]
    short = [" ", "\n", "\n\n", "\t \n", "  ", " ", "", None, "k", "ok", "yes", "no"]
    rows += [(10_000 + i, "c", "user", short[i % len(short)]) for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    counts, model, figures = truncation.fit(df)
    assert figures["held_out_flagged_intact"] < 0.02
    scored = {r.row_id: r.logit for r in truncation.score(df, counts, model).collect()}
    blank = {10_000 + i for i in range(1200) if not (short[i % len(short)] or "").strip()}
    assert not blank & set(scored) and {10_000 + i for i in range(1200)} - blank <= set(scored)
    assert max(v for k, v in scored.items() if k >= 10_000) < truncation.THRESHOLD
    rates = truncation.rates(df, truncation.score(df, counts, model)).first()
    assert rates.n_rows == 4200 and rates.with_text == 4200 - len(blank)


def test_every_limit_of_a_collector_is_found(spark):
    rng = random.Random(4)
    at = [24, 120, 200, 310, 480, 700]  # six limits, one of them small, most values longer than it
    rows = [(i, "many", "assistant", _prose(rng, rng.randrange(30, 900))) for i in range(4000)]
    for k, n in enumerate(at):
        for j in range(40):
            t = _prose(rng, 1000)[j : j + n]
            rows.append((100_000 + 100 * k + j, "many", "assistant", t[:-1].strip().ljust(n - 1, "x") + "x"))
    rows += [(200_000 + j, "many", "user", "deploy it") for j in range(500)]  # said again and again is no limit
    counts = truncation.count(spark.createDataFrame(rows, SCHEMA))
    assert {a for kind, a, _ in counts.limits["many"] if kind == "chars"} == set(at)


def test_limits_against_the_definition():
    rng = random.Random(6)
    n = {a: rng.randrange(1, 4) for a in rng.sample(range(1, 400), 250)} | {60: 90, 7: 40}
    total, want = sum(n.values()), set()
    for a, x in n.items():
        near = sum(y for b, y in n.items() if b != a and abs(b - a) <= 20) / (20 + min(a - 1, 20))
        if x >= max(5, 5e-4 * total) and x / max(near, 0.3) >= 8:
            want.add(a)

    class Frame:  # the group function without Spark
        def groupBy(self, *_):
            return self

        def applyInPandas(self, f, _):
            return f(pd.DataFrame({"who": "w", "kind": "chars", "at": list(n), "n": [float(x) for x in n.values()]}))

    got = truncation.limits(Frame())
    assert set(got["at"]) == want and {60, 7} <= want


def test_long_tokens_and_marks():
    assert truncation.skeleton("a" * 300 + "_b") == "w_w" and truncation.skeleton("/" + "d/" * 5000 + "x.py") == "P.py"
    assert truncation.skeleton("q" * 1_000_000)[:9] == "q" * 8 + "~"
    assert truncation.skeleton("0a" * 200) == "H" and truncation.skeleton("x" + "7" * 300) == "x9"
    for text, mark in [("So it ends…", "…"), ("So it ends ...", " ..."), ("x [output truncated]", " [output truncated]"), ("x...[cut]", "...[cut]"), ("x (trunc", " (trunc"), ("<snip", "<snip"), ("f(x)", ""), ("f(a, b", ""), ("", ""),
                       ("x [" + "very " * 30 + "long and truncated]", " [" + "very " * 30 + "long and truncated]"), ("(" * 100_000, ""), ("x" * 300_000, "")]:
        assert truncation._mark(text) == mark
