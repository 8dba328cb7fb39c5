from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import enrich, fulltext, relational


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first().x


def test_fingerprints(spark):
    t = "error[E0308]: mismatched types at src/a.rs:42\nConnectionError: refused to 10.0.0.1:8080 at /srv/app/m.py"
    got = one(spark, T.error_fingerprints(F.col("t")), t=t)
    assert got == ["error[E0308]: mismatched types at <PATH>:<LINE>", "ConnectionError: refused to <HOST>:<LINE> at <PATH>"] or got[0].startswith("error[E0308]")
    again = one(spark, T.normalize_error(F.col("t")), t=got[0])
    assert again == got[0]
    assert one(spark, T.error_fingerprints(F.col("t")), t=None) is None and one(spark, T.error_fingerprints(F.col("t")), t="") == []


def test_redaction(spark):
    assert one(spark, T.redact(F.col("t")), t="a@b.io 555-123-4567 4111 1111 1111 1111 123-45-6789") == "[REDACTED:email] [REDACTED:phone] [REDACTED:credit_card] [REDACTED:ssn]"
    assert one(spark, T.redact(F.col("t"), ("email",)), t="a@b.io 555-123-4567") == "[REDACTED:email] 555-123-4567"


def test_redaction_in_any_script(spark, tmp_path):
    import hashlib

    import __spark_entry__ as entry

    rows = [
        (1, "Grüße an bob@corp.io", "de", "Grüße an [REDACTED:email]"), (2, "連絡先user@example.comまで、電話は555-123-4567です", "ja", "連絡先[REDACTED:email]まで、電話は[REDACTED:phone]です"),
        (3, "SSN “123-45-6789” 🙂", "en", "SSN “[REDACTED:ssn]” 🙂"), (4, "карта 4111 1111 1111 1111", "ru", "карта [REDACTED:credit_card]"), (5, "tél. 555\u00a0123\u00a04567", "fr", "tél. [REDACTED:phone]"),
        (6, "nichts für ungut", "de", None), (7, "a@b.io", "en", "[REDACTED:email]"), (8, "", "de", None), (9, None, "de", None),
    ]
    spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    want = {i: hashlib.md5(r.encode()).hexdigest() for i, _, _, r in rows if r}
    assert {r.doc_id: r.digest for r in q["pii_redact"](spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in q["pii_flag"](spark, str(tmp_path)).collect()} == {("de", 1, 3), ("ja", 1, 1), ("en", 2, 2), ("ru", 1, 1), ("fr", 1, 1)}
    assert {r.doc_id: r.snippet for r in q["snippet"](spark, str(tmp_path)).collect()} == {i: t for i, t, _, _ in rows if t is not None}


def test_distance(spark):
    for a, b, want in [("ab", "ba", True), ("abc", "acb", True), ("abcd", "badc", False), ("a", "a", True), ("", "a", True), ("", "", True), ("abc", "abd", True), ("abc", "xyz", False)]:
        assert one(spark, T.osa_within(F.col("a"), F.col("b")), a=a, b=b) is want, (a, b)


def test_snippet_and_bytes(spark):
    assert one(spark, T.snippet(F.col("t"), 7), t="hello wide world") == "hello..."
    assert one(spark, T.snippet(F.col("t"), 0), t="hello") == "..."
    assert one(spark, enrich.byte_prefix(F.col("t"), 4), t="aéé") == "aé" and one(spark, enrich.byte_prefix(F.col("t"), 5), t="aéé") == "aéé"
    assert one(spark, enrich.byte_prefix(F.col("t"), 4), t=None) is None


EV = "session_id string, seq bigint, role string, content string, tool string"


def outcome(spark, *events):
    df = spark.createDataFrame([("s", i, *e) for i, e in enumerate(events)], EV)
    r = enrich.outcome(df).first()
    return r.score, r.outcome


def test_outcome(spark):
    assert outcome(spark, ("user", "please", None)) == (-5, "abandoned")
    assert outcome(spark, ("user", "a", None), ("tool_call", "", "Edit"), ("tool_result", "ok", None)) == (25, "success")
    assert outcome(spark, ("user", "a", None), ("tool_call", "", "Edit"), ("tool_result", "error: x", None)) == (15 - 20 - 15 - 10, "failure")
    assert outcome(spark, ("tool_result", "failed", None), ("tool_result", "ok", None), ("user", "thanks", None)) == (40, "success")
    assert outcome(spark, ("user", "thanks, but still broken", None), ("assistant", "x", None), ("assistant", "y", None)) == (5, "unknown")


def test_rejection_window(spark):
    steps = [("tool_result", "error", None), ("tool_call", "", "Bash"), ("tool_call", "", "Bash"), ("tool_result", "error", None)]
    df = spark.createDataFrame([("a", i, *e) for i, e in enumerate(steps)] + [("b", i, *e) for i, e in enumerate([*steps, ("user", "frameworks", None)])], EV)
    assert [tuple(r) for r in enrich.rejection_windows(df).collect()] == [("a", 0, 4, 2)]


def test_content_cap(spark):
    df = spark.createDataFrame([("s", i, "user", "x" * 100, None) for i in range(100)], EV)
    got = enrich.content(df, cap=1000).first().content
    assert "[...]" in got and len(got) < 1100 and enrich.content(df.limit(0)).count() == 0


def test_pack_never_exceeds(spark):
    rows = [(i, float(i), "s" * (i * 7 % 90), "sum" * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, score double, snippet string, summary string")
    for budget in (0, 1, 17, 60, 400):
        assert sum(r.cost for r in fulltext.pack(df, budget).collect()) <= budget


def test_interval_and_prefix_joins(spark):
    p = spark.sql("select 'k' as k, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,id,0,0,0) as t, id from range(10)")
    s = spark.sql("select 'k' as k, timestamp_ntz'2024-01-02 00:00:00' as a, timestamp_ntz'2024-01-05 00:00:00' as b")
    assert sorted(r.id for r in relational.interval_join(p, s, "k", "t", "a", "b").collect()) == [1, 2, 3, 4]
    m = spark.createDataFrame([("gpt-4-x",), ("zzz",), (None,), ("",)], "m string")
    k = spark.createDataFrame([("gpt", 1), ("gpt-4", 2)], "key string, v int")
    assert {r.m: r.v for r in relational.longest_prefix_join(m, k, "m", "key").collect()} == {"gpt-4-x": 2, "zzz": None, None: None, "": None}


def test_corrections_and_paths(spark):
    assert one(spark, T.corrections(F.col("t")), t="Please don't use npm, use pnpm. Always use cargo") == ["don't use npm, use pnpm", "Always use cargo"]
    assert one(spark, T.corrections(F.col("t")), t="fine") == [] and one(spark, T.file_paths(F.col("t")), t="see `src/a.rs` and /etc/hosts") == ["/etc/hosts", "src/a.rs"]


def test_every_error_pattern_reaches_the_queries(spark, monkeypatch):
    from quern.plans import sessions

    hits = [
        "error[E0308]: mismatched types", "thread 'main' panicked at x", "Traceback (most recent call last):", "KeyError: x", "TypeError: y", "panic: z", "fatal error: q", "HTTP/1.1 503 Unavailable",
        "SQLSTATE[23000]: Integrity constraint violation", "ORA-00942: table or view does not exist", "cannot find module x", "undefined symbol y", "Connection refused by host", "ETIMEDOUT after 3 s",
        "authentication failed for user bob", "authorization failed for bob", "Invalid API key provided", "expired session of bob", "401 Unauthorized for bob", "re-authenticate now", "Error: broken", "Permission denied", "No such file x", "File not found x",
    ]
    rows = [(f"s{i}", i, "tool_result", t) for i, t in enumerate([*hits, "all well", "", None])] + [("u", 99, "user", "ORA-00942: said by a user")]
    ev = spark.createDataFrame(rows, "session_id string, seq bigint, role string, content string").selectExpr("*", "'a' as source_agent", "'p' as project", "timestamp_ntz'2024-01-01 00:00:00' as ts")
    monkeypatch.setattr(sessions, "log_events", lambda *_: ev)
    assert {r.seq for r in sessions.err_fingerprint(spark, "").collect()} == {*range(len(hits)), 99}  # whoever said it


def test_paths_and_distances(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as T

    rows = [("~/a", True), ("./x", True), ("../x", True), ("/usr/x", True), ("/-", False), ("//x", False), ("https://h/a.py", False), ("a.py", True), ("a.unknown", False), ("a\x1b.py", False), ("", False), ("Dockerfile", False), (None, None)]
    got = spark.createDataFrame(rows, "p string, want boolean").select("want", T.path_like(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    rows = [("/a", "/p", "/a"), ("~/x", "/p", "/home/me/x"), ("b/c", "/p/", "/p/b/c"), ("b", None, "b")]
    got = spark.createDataFrame(rows, "p string, project string, want string").select("want", T.resolve_path(F.col("p"), F.col("project"), F.lit("/home/me")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    assert T.task_paths("see lib/x.rs, src/a/b.py and src/a/b.py; models_x.yaml") == ["src/a/b.py", "lib/x.rs", "models_x.yaml"]
    got = spark.createDataFrame([("a/b/c.tar.gz",), (".env",), ("Makefile",), ("/x",)], "p string").select(T.path_parts(F.col("p")).alias("x")).collect()
    assert [tuple(r.x) for r in got] == [("c.tar.gz", "gz", "a/b"), (".env", None, None), ("Makefile", None, None), ("x", None, None)]
    pairs = [("abcd", "badc", 2), ("abcd", "badc", 1), ("kitten", "sitting", 2), ("ca", "abc", 2), ("ab", "ba", 1), (None, "a", 2), ("", "ab", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    got = [df.where(F.col("d") == d).select(T.osa_within(F.col("a"), F.col("b"), d).alias("x")).collect() for d in (2, 1)]
    assert [r.x for r in got[0]] == [True, False, False, None, True] and [r.x for r in got[1]] == [False, True]
