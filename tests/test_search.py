from datetime import datetime, timedelta, timezone

import pytest

from quern import reports
from quern.functions import dates
from quern.index import Index
from quern.operators import search
from quern.sources import connector


def test_parse():
    q = search.parse('+must -not "a Phrase" agent:codex one AND two')
    assert (q.must, q.must_not, q.phrases, q.fields, q.should) == (["must", "one", "two"], ["not"], [["a", "phrase"]], {"agent": "codex"}, [])
    assert search.parse("").should == [] and search.parse('"').should == []


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    ix = Index.create(spark, str(tmp_path_factory.mktemp("index")), buckets=8)
    ix.rebuild(search.documents_as_sessions(spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")))
    return ix


def test_search(spark, sf, index):
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    page, second = search.search(index, search.Search(query="parser timeout"))
    rows = page.collect()
    assert rows and not second and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and page.columns == search.RESULT
    assert search.search(index, search.Search(query="deadlok"))[1]
    assert all("parser" in texts[r.session_id].lower() for r in search.search(index, search.Search(query="+parser agent:codex"))[0].collect())
    assert search.search(index, search.Search(query="+parser -parser agent:codex", fuzzy=False, error="none at all"))[0].count() == 0
    for bad in (search.Search(), search.Search(query=""), search.Search(project="x")):
        with pytest.raises(ValueError):
            search.search(index, bad)
    packed = search.search(index, search.Search(query="parser", token_budget=60))[0].collect()
    assert packed and sum(r.token_count for r in packed) <= 60
    assert search.search(index, search.Search(session=rows[0].session_id))[0].first().session_id == rows[0].session_id
    assert search.search(index, search.Search(session="nobody"))[0].count() == 0
    assert search.search(index, search.Search(like="nobody"))[0].count() == 0
    assert len(search.hint("q" * 200, 3, "x")) <= 120


def test_context_pack(spark, index):
    notes = spark.createDataFrame([("src/cache/queue.rs", "error", f"E{i}", i) for i in range(5)] + [("src/cache/queue.rs", "gotcha", "slow", 1), ("other.rs", "error", "x", 1)], "path string, kind string, note string, n int")
    pack = search.context_pack(index, "fix the parser in src/cache/queue.rs", 2000, ["Use cargo"], notes)
    assert pack["conventions"] == "Use cargo" and pack["file_notes"] == "**src/cache/queue.rs**\n  - slow\n  - Error: E4\n  - Error: E3\n  - Error: E2"
    assert search.fit({"a": "one two three", "b": "x" * 8, "c": "y"}, 5) == {"a": "one two three", "b": "xxxx...", "c": ""}
    assert search.fit({"a": "first line\nsecond line", "b": "", "c": "z"}, 4) == {"a": "first line...", "b": "", "c": ""}
    small = search.context_pack(index, "parser", 5)
    assert sum(-(-len(v) // 4) for v in small.values()) <= 6


def test_pack():
    row = lambda sn, su="": {"snippet": sn, "summary": su, "token_count": 0}
    assert [r["snippet"] for r in search.pack([row("a" * 40), row("b" * 8), row("c" * 400), row("d" * 4)], 13)] == ["a" * 40, "b" * 8, "c..."]
    assert [r["snippet"] for r in search.pack([row("a" * 40), row("b" * 40, "s" * 40), row("d" * 4)], 12)] == ["a" * 40, "d" * 4]
    cut = search.pack([row("word " * 40, "sum")], 10)
    assert len(cut) == 1 and cut[0]["snippet"].endswith("...") and cut[0]["token_count"] <= 10
    assert search.pack([row("x" * 400, "sum")], 1) == [{**row("", "sum"), "token_count": 1}]
    assert search.pack([row("")], 0) == [] and search.pack([row("")], 1)[0]["token_count"] == 0
    assert '"fuzzy_fallback": true' in search.as_json("q", [], 1, True) and "fuzzy" not in search.as_json("q", [], 1, False)


DOC = "doc_id string, session_id string, doc_type string, content string, tags array<string>, extra int"


def test_index_by_session(spark, tmp_path):
    path = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        Index.open(spark, path)
    ix = Index.create(spark, path, buckets=4)
    assert ix.documents().count() == 0 and ix.postings(["a"]).count() == 0 and ix.stats()["docs"] == 0
    doc = lambda i, text, s=None, kind="session": (i, s or i, kind, text, ["t"], 1)
    ix.add(spark.createDataFrame([doc("a", "red fox"), doc("b", "blue fox"), doc("a#1", "code fox", "a", "code_artifact")], DOC))
    assert ix.counts()[0] == 3 and {r.term: r.df for r in ix.vocabulary().collect()} == {"red": 1, "blue": 1, "code": 1, "fox": 3}
    ix.add(spark.createDataFrame([doc("a", "green owl")], DOC))  # replaces the session, its artifact too
    assert {r.doc_id: r.content for r in ix.documents().collect()} == {"a": "green owl", "b": "blue fox"}
    assert {r.term: r.df for r in ix.vocabulary().collect()} == {"green": 1, "owl": 1, "blue": 1, "fox": 1} and ix.counts()[1]["content"] == 2.0
    again = Index.open(spark, path)
    with again.batch():
        again.delete(spark.createDataFrame([("b",)], "session_id string"))
        with again.batch():
            again.add(spark.createDataFrame([doc("c", None), doc("d", "")], DOC))
        assert Index.open(spark, path).counts()[0] == 2  # nothing is committed before the outermost ends
    assert {r.doc_id for r in Index.open(spark, path).documents().collect()} == {"a", "c", "d"}
    with pytest.raises(RuntimeError), again.batch():
        again.delete(spark.createDataFrame([("a",)], "session_id string"))
        raise RuntimeError
    assert ix.counts()[0] == 3
    # two writers from one version: the second fails, and what is valid stays
    one, two = Index.open(spark, path), Index.open(spark, path)
    with pytest.raises(FileExistsError), one.batch():
        one.delete(spark.createDataFrame([("c",)], "session_id string"))
        two.delete(spark.createDataFrame([("d",)], "session_id string"))
    assert {r.doc_id for r in ix.documents().collect()} == {"a", "c"}
    ix.optimize()
    s = ix.stats()
    assert s["segments"] == 1 and s["docs"] == 2 and {r.doc_id for r in ix.documents().collect()} == {"a", "c"} and {r.term for r in ix.vocabulary().collect()} == {"green", "owl"}
    ix.rebuild(spark.createDataFrame([doc("z", "new")], DOC))
    assert {r.doc_id for r in Index.open(spark, path).documents().collect()} == {"z"}
    ix.rebuild(spark.createDataFrame([], DOC))
    assert ix.documents().count() == 0 and search.search(ix, search.Search(query="x"))[0].count() == 0


def test_a_search_reads_its_terms_only(index):
    import re

    plan = index.postings(["parser"], ["content"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*(?:In|EqualTo)\(term", plan)


def test_dates():
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    assert dates.moment("7d", now) == now - timedelta(days=7) and dates.moment("2024-01-02", now) == datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert dates.duration("6mo") == timedelta(days=180) and dates.moment("2024-01-02T03:04:05Z", now).hour == 3
    a, b = dates.quarter("2024-Q4")
    assert a.month == 10 and b == datetime(2024, 12, 31, 23, 59, 59, tzinfo=timezone.utc)
    for bad in ("2024-Q5", "x"):
        with pytest.raises(ValueError):
            dates.quarter(bad)
    with pytest.raises(ValueError):
        dates.duration("3 fortnights")


def test_reports(spark):
    df = spark.createDataFrame([("a|b", 1.5)], "name string, x double")
    assert "a\\|b" in reports.markdown_table(df, "T") and "Nothing" in reports.markdown_table(df.limit(0), "T")
    once = reports.put_block("mine\n", "rule one")
    assert reports.put_block(once, "rule two").count("rule") == 3 and "mine" in once and "rule one" not in reports.put_block(once, "rule two")
    assert reports.insights([], []) == [] and len(reports.insights([{"agent": "a", "total_sessions": 5, "success_rate": 50.0}], [{"month": "1", "sessions": 2}, {"month": "2", "sessions": 3}])) == 3


def test_texts_for_people(spark):
    from datetime import datetime as D

    assert reports.wrapped("aa bb cccccc d", 6) == "aa bb\ncccccc\nd" and reports.wrapped("", 5) == ""
    assert [reports.listed(["a", "b", "c", "d", "e", "f"][:n]) for n in (0, 1, 2, 3, 5, 6)] == ["(none)", "a", "a and b", "a, b, and c", "a, b, c, d, and e", "a, b, c, ... (6 total)"]
    assert [reports.size(n) for n in (5, 2048, 3 * 1024**2, 5 * 1024**3)] == ["5 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    assert reports.duration(D(2024, 1, 1), D(2024, 1, 3, 4, 5)) == "2d 4h 5m" and reports.duration(D(2024, 1, 1), D(2024, 1, 1, 0, 0, 59)) == "<1m"
    assert reports.ago(D(2024, 1, 1), D(2024, 1, 1, 3)) == "3h ago" and reports.ago(D(2024, 1, 1), D(2024, 1, 1)) == "just now"
    assert reports.minutes(None) == "-" and reports.minutes(59.9) == "59m" and reports.minutes(125) == "2h 5m"
    assert reports.bar(50, 100, 4) == "\u2588\u2588\u2591\u2591" and reports.bar(9, 0, 2) == "\u2591\u2591" and reports.bar(900, 100, 2) == "\u2588\u2588" and reports.capitalized("été") == "Été"
    assert reports.reset_time("2024-01-01T00:00:00+02:00").hour == 22 and reports.reset_time("x") is None and reports.reset_time(None) is None
    page = reports.to_html({"T": spark.createDataFrame([("<b>", 1.0)], "name string, x double"), "E": spark.createDataFrame([], "x int")}, "R")
    assert "&lt;b&gt;" in page and "1.00" in page and "Nothing" in page
    events = [{"role": "user", "content": "hi", "ts": D(2024, 1, 1)}, {"role": "tool_call", "content": "<ls>", "tool": "Bash"}, {"role": "odd", "content": None}]
    assert "## Tool (Bash)\n\n````\n<ls>\n````" in reports.session_markdown("s", events) and "&lt;ls&gt;" in reports.session_html("s", events)
    rules = [{"category": "correction", "rule": "a"}, {"category": "context", "rule": "b"}]
    assert reports.rules_text(rules, "inline") == "a; b" and reports.rules_text(rules, "list") == "- a\n- b" and reports.rules_text(rules).startswith("## Corrections\n\n- a\n\n## Context")
    with pytest.raises(ValueError):
        reports.rules_text(rules, "x")
    s = reports.summary_markdown({"session_id": "s", "project": None, "outcome": "success", "turns": 3, "started": D(2024, 1, 1), "ended": D(2024, 1, 1, 1)}, "did it", "[Bash] make")
    assert "- Took: 1h" in s and "[Bash] make" in s and "- Project: -" in s


def test_bundled_connectors():
    from pathlib import Path

    found = [connector.load(p) for p in (Path(connector.__file__).parents[1] / "connectors").glob("*.toml")]
    assert len(found) == 6 and {c.format for c in found} == set(connector.FORMATS)


def test_every_script(spark, sf, tmp_path):
    import re
    from collections import Counter

    import __spark_entry__ as entry

    assert search.parse('+größe "ошибка сети" -错误 naïve').must == ["größe"] and search.parse('"ошибка сети"').phrases == [["ошибка", "сети"]]
    rows = [(1, "Ошибка сети при запуске"), (2, "Die Größe ist falsch"), (3, "修正後は次へ"), (4, "plain words"), (5, None), (6, "x" * 41)]
    df = spark.createDataFrame([(i, t, None, "a", None, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, doc_type string, project string, model string, collected_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    vocab = {r.term for r in entry.queries()["fts_vocabulary"](spark, str(tmp_path)).collect()}
    assert vocab == {"ошибка", "сети", "при", "запуске", "die", "größe", "ist", "falsch", "修正後は次へ", "plain", "words"}
    ix = Index.create(spark, str(tmp_path / "ix"))
    ix.rebuild(search.documents_as_sessions(df))
    ids = lambda q: [r.session_id for r in search.search(ix, search.Search(query=q))[0].collect()]
    assert ids("ошибка") == ["1"] == ids('"Ошибка сети"') and ids("+größe") == ["2"] and ids("修正後は次へ") == ["3"]
    want = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").collect():
        want.update({w for w in re.split(r"[\W_]+", r.text.lower()) if w and len(w.encode()) <= 40})
    assert {r.term: r.df for r in entry.queries()["fts_vocabulary"](spark, sf).collect()} == dict(want)
