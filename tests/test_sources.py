import json
import sqlite3
from pathlib import Path

import pytest

from quern import ingest
from quern.sources import connector, files, small, sqlite


def write(p: Path, text: str) -> str:
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


CONNECTOR = """
[plugin]
name = "cc"
version = "1.0"
[source]
paths = ["{root}/*/*.jsonl"]
exclude = ["{root}/skip/*"]
format = "jsonl"
[source.session_detection]
method = "one-file-per-session"
[parser]
type = "type"
timestamp = "timestamp"
role = "message.role"
content = "message.content"
tool = "message.tool"
file_path = "message.input.file_path"
exclude_types = ["progress"]
[parser.static]
source_agent = "cc"
[parser.project]
method = "field"
field = "cwd"
"""


def line(role, content, t, **more):
    return json.dumps({"type": role, "timestamp": t, "cwd": "/w/x", "message": {"role": role, "content": content, **more}})


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "logs"
    good = [line("user", "please", "2024-01-01T00:00:00Z"), "", line("assistant", "ok", "2024-01-01T00:00:01Z"), line("tool_call", "", 1704067202, tool="Edit", input={"file_path": "a.rs"}), '{"type": "progress"}', '{"trunc']
    write(root / "p" / "s1.jsonl", "\n".join(good))
    write(root / "p" / "s2.jsonl", "")
    write(root / "skip" / "s3.jsonl", line("user", "no", "2024-01-01T00:00:00Z"))
    c = connector.load(write(tmp_path / "c.toml", CONNECTOR.format(root=root)))
    return root, c, tmp_path


def test_jsonl(spark, tree):
    root, c, _ = tree
    paths = connector.discover(c)
    assert [Path(p).name for p in paths] == ["s1.jsonl", "s2.jsonl"]
    ev, counts = files.jsonl(spark, c, paths)
    got = [(r.session_id, r.role, r.content, r.tool, r.path, r.project, str(r.ts)) for r in ev.orderBy("seq").collect()]
    assert got == [("cc/s1", "user", "please", None, None, "/w/x", "2024-01-01 00:00:00"), ("cc/s1", "assistant", "ok", None, None, "/w/x", "2024-01-01 00:00:01"), ("cc/s1", "tool_call", "", "Edit", "a.rs", "/w/x", "2024-01-01 00:00:02")]
    assert [(r.lines, r.blank, r.bad, r.events) for r in counts.collect()] == [(6, 1, 1, 3)]


def test_ingest_twice_is_once_and_appends_are_seen(spark, tree):
    import os

    root, c, tmp = tree
    out = str(tmp / "store")
    assert ingest.ingest(spark, c, out) == {"files": 1, "sessions": 1, "events": 3, "bad": 1}  # the empty file holds nothing and is not listed
    archive = ingest.Archive.open(spark, f"{out}/archive")
    rows = lambda: sorted(map(tuple, archive.events().select("session_id", "seq", "content").collect()))
    before = rows()
    assert ingest.ingest(spark, c, out)["files"] == 0 and rows() == before
    write(root / "q" / "s4.jsonl", line("user", "hi", "2025-01-01T00:00:00Z"))
    with open(root / "p" / "s1.jsonl", "a") as f:
        f.write("\n" + line("user", "thanks", "2024-01-01T00:01:00Z"))
    os.utime(root / "p" / "s1.jsonl", (2e9, 2e9))
    assert ingest.ingest(spark, c, out)["files"] == 2
    after = rows()
    assert len(after) == len(before) + 2 and set(before) <= set(after)
    seen = ingest.Scraped.open(spark, f"{out}/scraped")
    (root / "p" / "s1.jsonl").write_text(line("user", "short", "2024-01-01T00:00:00Z"))
    os.utime(root / "p" / "s1.jsonl", (1e9, 1e9))  # shorter, and older than what was seen
    assert [r.path.rsplit("/", 1)[1] for r in ingest.truncated(ingest.listing(spark, c), seen.rows("files")).collect()] == ["s1.jsonl"]
    assert ingest.ingest_all(spark, [c], out)["files"] == 1 and len(rows()) == 2
    archive.optimize()
    assert len(rows()) == 2 and archive.size()["segments"] == 1
    st = {r.source_agent: r for r in archive.status(seen).collect()}
    assert st["cc"].sessions == 2 and st["cc"].files == 2 and st["cc"].last_scraped is not None
    archive.find_antipatterns()
    assert archive.antipatterns().count() == 0 and len(rows()) == 2
    assert {r.session_id for r in archive.sessions("cc").collect()} == {"cc/s1", "cc/s4"} and archive.sessions("none").count() == 0
    gone = archive.drop_older("2024-06-01 00:00:00")
    assert gone == {"sessions": 1, "bytes": 5} and {r[0] for r in rows()} == {"cc/s4"}
    # what another reader sees is the last commit, and nothing of a batch that failed
    with pytest.raises(RuntimeError), archive.batch():
        archive.delete(archive.sessions())
        raise RuntimeError
    assert {r.session_id for r in ingest.Archive.open(spark, f"file:{out}/archive").events().collect()} == {"cc/s4"}
    with ingest.locked(seen.store), pytest.raises(TimeoutError):
        ingest.ingest(spark, c, out, timeout=0.1)


def test_index_from_archive(spark, tree):
    from quern.index import Index

    root, c, tmp = tree
    ingest.ingest(spark, c, str(tmp / "o"))
    archive, ix = ingest.Archive.open(spark, str(tmp / "o/archive")), Index.create(spark, str(tmp / "ix"), buckets=2)
    ingest.rebuild_index(archive, ix)
    assert [r.session_id for r in ix.documents().collect()] == ["cc/s1"]
    ingest.rebuild_index(archive, ix, "cc")
    assert [r.session_id for r in ix.documents().collect()] == ["cc/s1"] and {r.term for r in ix.postings(["please"]).collect()} == {"please"}


def test_a_file_in_splits_has_its_lines_in_order(spark, tmp_path):
    p = write(tmp_path / "big.jsonl", "\n".join(f"line {i} " + "x" * 50 for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.lines(spark, [p]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.seq: int(r.value.split()[1]) for r in got} == {i + 1: i for i in range(5000)}


def test_fields_of_lines(spark, tmp_path):
    rows = [{"role": "tool_call", "tool": "Edit", "files": ["a.rs", "b.rs"], "u": {"i": 5}}, {"role": "user", "content": "see src/x.py and `lib/y.rs`", "files": "c.rs"}, {"role": "assistant", "content": "in 'q.toml' and /usr/z"}]
    p = write(tmp_path / "repo" / "logs" / "s.jsonl", "\n".join(map(json.dumps, rows)))
    write(tmp_path / "repo" / ".git" / "HEAD", "x")
    write(tmp_path / "meta" / "s.json", '{"info": {"model": "m-1"}}')
    c = connector.Connector("k", "1", [p], "jsonl", parser={"role": "role", "content": "content", "tool": "tool", "file_path": "files", "tokens_in": "u.i", "tokens_out": "u.o", "static": {"source_version": "9"}, "project": {"method": "git_root"}, "model": {"source": "metadata", "path": f"{tmp_path}/meta/{{session_id}}.json", "field": "info.model"}})
    ev, _ = files.jsonl(spark, c, [p])
    got = ev.orderBy("seq").collect()
    assert [r.file_paths for r in got] == [["a.rs", "b.rs"], ["c.rs"], []] and got[0].path == "a.rs" and got[2].path is None
    assert tuple(got[0].tokens) == (5, None) and got[1].tokens is None and {r.source_version for r in got} == {"9"}
    assert {r.project for r in got} == {str(tmp_path / "repo")} and {r.model for r in got} == {"m-1"}
    full = files.backfilled(ev.withColumn("project", files.F.lit(None).cast("string")), files.F.lit("p"), files.F.lit("m")).orderBy("seq").collect()
    assert {r.project for r in full} == {"p"} and full[2].file_paths == ["/usr/z", "q.toml"] and full[1].file_paths == ["c.rs"]


def test_connector_of_a_path():
    a, b = (connector.Connector(n, "1", [p], "jsonl", exclude=["/l/**/skip/*"]) for n, p in (("a", "/l/**/*.jsonl"), ("b", "/l/x?/{u,v}.jsonl")))
    find = lambda p, cs=(a, b): (lambda c: c and c.name)(connector.of_path(p, list(cs)))
    assert find("/l/x1/u.jsonl") == "a" and find("/l/x1/u.jsonl", [b]) == "b" and find("/l/x1/w.jsonl", [b]) is None and find("/l/k/skip/u.jsonl") is None and find("/m/u.jsonl") is None and find("/l/u.jsonl") == "a"
    assert connector.guess("/home/x/.claude/p/s.jsonl") == "claude-code" and connector.guess("/x") is None


def test_connector_errors(tmp_path):
    bad = write(tmp_path / "b.toml", '[plugin]\nname=""\n[source]\npaths=[]\nformat="csv"\n[source.session_detection]\nmethod="x"\n')
    with pytest.raises(ValueError, match="name"):
        connector.load(bad)


def test_markdown_sessions(spark, tmp_path):
    text = "preface\n# aider chat started at 2024-01-01 10:00:00\n\ndropped\n#### do it\nmore\n> tool says\n> again\n\n# aider chat started at 2024-01-02 10:00:00\n#### second\n"
    p = write(tmp_path / "h.md", text)
    c = connector.Connector("aider", "1", [p], "markdown", detection={"method": "delimiter", "delimiter_pattern": r"^# aider chat started at (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"}, parser={"user_prefix": "#### ", "tool_prefix": "> "})
    got = [(r.session_id, r.role, r.content, str(r.ts)) for r in files.markdown(spark, c, [p]).orderBy("session_id", "seq").collect()]
    assert got == [("aider/h-1", "user", "do it\nmore", "2024-01-01 10:00:00"), ("aider/h-1", "tool_result", "tool says", "2024-01-01 10:00:00"), ("aider/h-1", "tool_result", "again", "2024-01-01 10:00:00"), ("aider/h-2", "user", "second", "2024-01-02 10:00:00")]


def test_json_tree(spark, tmp_path):
    write(tmp_path / "session/p/s.json", json.dumps({"id": "s", "messageIds": ["m2", "m1", "lost"]}))
    write(tmp_path / "message/s/m1.json", json.dumps({"id": "m1", "sessionId": "s", "role": "user", "createdAt": "2024-01-01T00:00:00Z", "partIds": ["x"]}))
    write(tmp_path / "message/s/m2.json", json.dumps({"id": "m2", "sessionId": "s", "createdAt": "2024-01-01T00:00:05Z", "partIds": ["y", "z"]}))
    for m, p in (("m1", "x"), ("m2", "y"), ("m2", "z")):
        write(tmp_path / f"part/{m}/{p}.json", json.dumps({"id": p, "messageId": m, "type": "text", "text": f"t{p}"}))
    c = connector.Connector("oc", "1", ["x"], "json-tree")
    got = [(r.role, r.content, r.seq) for r in files.json_tree(spark, c, str(tmp_path)).orderBy("seq").collect()]
    assert got == [("user", "tx", 1), ("assistant", "ty", 2), ("assistant", "tz", 3)]


def test_sqlite(spark, tmp_path):
    db = tmp_path / "k.db"
    con = sqlite3.connect(db)
    con.execute("create table kv(key text, value text)")
    con.executemany("insert into kv values (?, ?)", [("bubble:a:1", json.dumps([{"role": "user", "text": "hi"}, {"role": "ai", "text": "yo"}, {"role": "alien", "text": "x"}, {"role": "user", "text": ""}])), ("bubble:b:1", json.dumps({"role": "user", "text": "one", "createdAt": "2024-01-01T00:00:00Z"})), ("other", "{}"), ("bubble:c:1", "no json")])
    con.commit()
    con.close()
    c = connector.Connector("cur", "1", [str(db)], "sqlite", detection={"method": "key-pattern", "key_pattern": "bubble:([^:]+):"}, parser={"query": "select key, value from kv", "role": "role", "key_filter": "^bubble"})
    got = sorted((r.session_id, r.seq, r.role, r.content) for r in sqlite.events(spark, c, str(db)).collect())
    assert got == [("cur/a", 1, "user", "hi"), ("cur/a", 2, "assistant", "yo"), ("cur/b", 1, "user", "one")]


def test_usage_and_speech(spark, tmp_path):
    row = {"type": "assistant", "timestamp": "2024-01-01T00:00:00Z", "message": {"id": "m", "model": "x", "usage": {"input_tokens": 5}}}
    write(tmp_path / "u/a.jsonl", json.dumps(row) + "\n" + json.dumps({**row, "type": "user"}) + "\nusage {")
    write(tmp_path / "u/subagents/b.jsonl", json.dumps(row))
    got = files.usage_logs(spark, str(tmp_path / "u")).collect()
    assert [(r.message_id, r.input_tokens, r.cache_read) for r in got] == [("m", 5, 0)]
    a = json.dumps({"transcription": [{"offsets": {"from": 0, "to": 1500}, "text": " hi"}]})
    b = json.dumps({"text": "hi", "segments": [{"start": 0.0, "end": 1.5, "text": " hi"}]})
    df = spark.createDataFrame([("a", a), ("b", b), ("c", "{}")], "file string, value string")
    out = {r.file: r.utterances for r in files.speech(df).collect()}
    assert [tuple(x) for x in out["a"]] == [tuple(x) for x in out["b"]] == [("hi", 0, 1500)] and out["c"] is None


def test_registry(spark, tmp_path):
    p = write(tmp_path / "p.yaml", "version: 2\nprojects:\n  - name: a\n    color: '#12f'\n    workspaces: [/w/a, {path: /w/b, role: archive}, {path: /w/c}]\n  - label: x\n  - name: b\n    path: /w/d\n")
    projects, warnings = small.registry(p)
    assert [w["path"] for w in projects[0]["workspaces"]] == ["/w/a", "/w/b", "/w/c"] and len(warnings) == 2 and projects[1]["workspaces"] == [{"path": "/w/d", "role": "primary"}]
    assert small.registry_table(spark, projects).where("size(workspaces) = 3").count() == 1
    small.migrate_registry(p)
    assert small.registry(p)[0] == projects
    for bad in ("- {name: a, path: /x}\n- {name: a, path: /y}", "- {name: a}", "- {name: a, path: /x, workspaces: [/y]}", "- {name: a, workspaces: [{path: ' '}]}", "- {name: a, path: /x, color: '#12'}", "- {name: a, workspaces: [{path: /x, role: ''}]}"):
        with pytest.raises(small.RegistryError):
            small.registry(write(tmp_path / "bad.yaml", bad))


def test_small_sources(spark, tmp_path):
    import subprocess

    assert small.cached_usage(tmp_path / "none.json", 10) is None
    assert small.commits(spark, str(tmp_path)).count() == 0
    assert small.plan_of(tmp_path) == ("unknown", "unknown")
    write(tmp_path / ".credentials.json", '{"claudeAiOauth": {"subscriptionType": "max"}}')
    assert small.plan_of(tmp_path) == ("max", "unknown")
    assert small.account_paths("/h/.claude", "/c") == {"account": "claude-default", "projects": "/h/.claude/projects", "usage": "/c/claude-usage/usage.json"}
    assert small.account_paths("/h/.claude-two", "/c")["usage"] == "/c/claude-usage/.claude-two-usage.json"
    assert small.blame_spec("a:b.rs:42") == ("a:b.rs", 42) and small.blame_spec("a.rs") == ("a.rs", None) and small.blame_spec("a:b") == ("a:b", None)
    assert small.config(tmp_path / "no.toml", {"a": {"b": 1}}) == {"a": {"b": 1}}
    assert small.config(write(tmp_path / "c.toml", "x = 2\n[a]\nc = 3\n"), {"a": {"b": 1}, "x": 1}) == {"a": {"b": 1, "c": 3}, "x": 2}
    repo = tmp_path / "repo"
    write(repo / "f.txt", "one\n")
    for cmd in (["init", "-q"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-qm", "a | b"]):
        subprocess.run(["git", "-C", str(repo), *cmd], check=True)
    c = small.commits(spark, str(repo)).first()
    assert c.subject == "a | b" and c.short and c.hash.startswith(c.short)
    known = spark.createDataFrame([(c.hash, "s1"), (c.short, "s1"), ("ffff", "s2"), ("", "s3")], "hash string, session_id string")
    assert [r.session_id for r in small.blamed_sessions(spark, str(repo), "f.txt:1", known).collect()] == ["s1"]
    assert small.blamed_sessions(spark, str(repo), "f.txt:9", known).count() == 0
    folder = str(tmp_path / "kept")
    write(tmp_path / "kept" / "x", "1")
    first = small.commit_folder(folder, "one")
    assert first and small.commit_folder(folder, "two") is None and small.commits(spark, folder).count() == 1
