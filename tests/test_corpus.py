import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import deep_json
from quern.operators import orphans, schema_drift, shredding
from quern.operators.shredding import assemble, call_tables, shred

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.sampled_from("abct"), c, max_size=4), max_leaves=25)


@given(JSON)
@settings(max_examples=300, deadline=None)
def test_shredding_is_lossless(record):
    assert assemble(shred(record)) == record


def test_calls_and_files():
    r = {"tool": "T", "input": {"file_path": ["x", "", "x"], "deep": [{"file_path": "d"}]}, "file_path": "outside", "calls": [{"tool": "U", "input": '{"edits":[{"file_path":"q"},{}]}'}, {"q": 1}, {"tool": None, "calls": [{"tool": "z", "input": {"file_path": "y"}}]}]}
    calls, files = call_tables(r, "file_path")
    assert sorted(calls) == [(0, -1, "T"), (1, 0, "U"), (2, 0, None), (3, 2, "z")]
    assert set(files) == {(0, "x"), (0, "d"), (1, "q"), (3, "y")}
    assert call_tables([], "path") == ([], []) and call_tables(None, "path") == ([], [])


def brute_calls(record):
    """Calls and files by plain recursion over the record."""
    calls, files = [], set()

    def unpacked(x):
        while isinstance(x, str) and x.lstrip()[:1] in ("{", "[", '"'):
            try:
                x = json.loads(x)
            except ValueError:
                break
        return x

    def walk(x, around, owner, named):
        if isinstance(x, list):
            for y in x:
                walk(y, around, owner, named)
        elif isinstance(x, dict):
            no = None
            if "tool" in x:
                no = len(calls)
                calls.append((no, around, x["tool"] if isinstance(x["tool"], str) else None))
            for k, v in x.items():
                if no is not None and k == "input":
                    v = unpacked(v)
                walk(v, around if no is None else no, no if k == "input" and no is not None else owner, k == "path")
        elif named and owner is not None and isinstance(x, str) and x:
            files.add((owner, x))

    walk(record, -1, None, False)
    return calls, files


CALLS = st.recursive(
    st.none() | st.integers() | st.sampled_from(["", "p", "q", '{"path":"r","tool":"x"}', '[{"path":["s",""]}]', '"{}"', "{"]),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["tool", "input", "path", "a"]), c, max_size=4), max_leaves=30)


@given(CALLS)
@settings(max_examples=400, deadline=None)
def test_calls_against_recursion(record):
    calls, files = call_tables(json.loads(json.dumps(record)), "path")
    want, found = brute_calls(record)
    assert sorted(calls) == sorted(want) and set(files) == found


def test_calls_nested_beyond_any_stack(spark):
    n = 5000
    text = '{"tool":"t","input":{"path":"p","in":[' * n + "1" + "]}}" * n
    df = spark.createDataFrame([(1, "codex", text), (2, "codex", '{"tool":"a","input":{"path":"p"}}')], "raw_id bigint, agent string, raw_json string")
    got = {(r.raw_id, r.call_no): r.parent_no for r in shredding.files(df).collect()}
    assert got == {(1, i): i - 1 for i in range(n)} | {(2, 0): -1}
    assert {(r.raw_id, r.readable, r.n_calls, r.n_files) for r in shredding.read_lines(df).collect()} == {(1, True, n, n), (2, True, 1, 1)}


def test_shredding_edge_rows(spark):
    rows = [(1, "codex", None), (2, "codex", ""), (3, "codex", "{"), (4, "other", '{"tool":"a","input":{"path":"p"}}'), (5, "codex", '{"tool":"a","input":{"path":"p"}}'), (5, "codex", '{"tool":"a","input":{"path":"p"}}'), (None, None, "[]"), (6, "codex", json.dumps({"tool": "a", "input": {"path": "x" * 100_000}}))]
    df = spark.createDataFrame(rows, "raw_id bigint, agent string, raw_json string")
    got = sorted((r.raw_id, r.call_no, r.parent_no, len(r.file_path)) for r in shredding.files(df).collect())
    assert got == [(5, 0, -1, 1), (5, 0, -1, 1), (6, 0, -1, 100_000)]
    assert sorted((r.raw_id or 0, r.readable, r.n_calls, r.n_files) for r in shredding.read_lines(df).collect()) == [(0, True, 0, 0), (1, False, 0, 0), (2, False, 0, 0), (3, False, 0, 0), (4, True, 1, 0), (5, True, 1, 1), (5, True, 1, 1), (6, True, 1, 1)]
    levels = [(r.path, r.entry_no, r.rep, r["def"], r.value) for r in shredding.columns(spark.createDataFrame([(1, "codex", '{"a":[{"b":1},{},{"b":[2,3]}],"c":"x"}')], df.schema)).collect()]
    assert sorted(levels) == sorted([("a[]", 0, 0, 1, None), ("a[]", 1, 1, 2, "{}"), ("a[]", 2, 1, 1, None), ("a[].b", 0, 0, 3, "1"), ("a[].b", 1, 1, 2, None), ("a[].b", 2, 1, 2, None), ("a[].b[]", 0, 0, 3, None), ("a[].b[]", 1, 1, 2, None), ("a[].b[]", 2, 1, 4, "2"), ("a[].b[]", 3, 2, 4, "3"), ("c", 0, 0, 1, '"x"')])
    assert shredding.files(df.limit(0)).count() == 0 and shredding.calls(df.limit(0)).count() == 0


def lines(spec):
    return [("a", "claude-code", seq, f"f{seq}", json.dumps(x) if not isinstance(x, str) else x) for seq, xs in enumerate(spec, 1) for x in xs]


def test_drift(spark):
    base = {"type": "user", "uuid": "u", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w"}
    spec = [
        [{**base, "version": "1.2.3", "gitBranch": "main"}, "garbage"],
        [{**base, "version": None, "gitBranch": "fix-1"}],  # null says nothing
        [{**base, "cliVersion": "1.2.3", "gitBranch": ["main"]}],  # moved; retyped
        [{**base, "cliVersion": [1, 2, 3], "git": {"branch": "dev"}}],  # retyped; moved
        [{**base, "requestId": "x"}],  # gone; gone
        [{**base, "client": {"version": "2"}, "branch": "main"}],  # new; new
        ["", "  ", "[]"],  # an unreadable file has no fields and is no file to compare
        [{**base, "client": {"version": "3"}, "branch": "dev"}],
    ]
    df = spark.createDataFrame(lines(spec), DRIFT)
    got = {(r.file_name, r.field_name): r.change for r in schema_drift.changes(schema_drift.carriers(df), block=3).collect()}
    assert got == {("f3", "version"): "moved", ("f3", "gitBranch"): "retyped", ("f4", "version"): "retyped", ("f4", "gitBranch"): "moved", ("f5", "version"): "gone", ("f5", "gitBranch"): "gone", ("f6", "version"): "new", ("f6", "gitBranch"): "new"}
    assert schema_drift.changes(schema_drift.carriers(df.limit(0))).count() == 0


DRIFT = "archive_id string, agent string, file_seq int, file_name string, raw_json string"


def test_fields_renamed_without_a_shared_word(spark):
    base = {"type": "user", "uuid": "u", "sessionId": "s", "cwd": "/w"}
    spec = [[{**base, "version": "1.2.3", "gitBranch": "main"}], [{**base, "version": "1.3.0", "gitBranch": "fix-audit-7"}]] * 3
    spec += [
        [{**base, "cliRelease": "1.3.1", "vcsRef": "main"}],  # both moved, no word in common
        [{**base, "requestId": "external-x", "meta": {"deep": [{"vcsRef": "fix-audit-9"}]}}],  # version gone; in an object of an array below another name
        [{**base, "version": "1.4.0", "gitBranch": "main", "requestId": "external-y"}],
        [{**base, "version": "1.4.0", "gitBranch": "main", "tags": {f"k{i}": "external-z" for i in range(5000)}}],  # keys that are data
        [{**base, "gitBranch": "main", "names": {f"q{i}": i for i in range(5000)}}],
    ]
    df = spark.createDataFrame(lines(spec), DRIFT)
    got = {(r.file_name, r.field_name): (r.change, r.after) for r in schema_drift.changes(schema_drift.carriers(df)).collect()}
    assert got == {
        ("f7", "version"): ("moved", "cliRelease string"), ("f7", "gitBranch"): ("moved", "vcsRef string"),
        ("f8", "version"): ("gone", ""), ("f8", "gitBranch"): ("moved", "meta.deep[].vcsRef string"),
        ("f9", "version"): ("new", "version string"), ("f9", "gitBranch"): ("moved", "gitBranch string"), ("f11", "version"): ("gone", ""),
    }


def test_flooding_decides():
    node = schema_drift.Node
    version = node("version", {"string": 0.5, "number": 0.3, "object": 0.2}, {"dotted": 0.65, "digits": 0.35})
    branch = node("gitBranch", {"string": 0.6, "object": 0.4}, {"slug": 0.9, "path": 0.1})
    may = lambda b: {"version": None, "gitBranch": b}
    renamed = [node("cliRelease", {"string": 1}, {"dotted": 1}, may(None)), node("vcsRef", {"string": 1}, {"slug": 1}, may(1.0))]
    assert schema_drift.flood(renamed, [version, branch]) == {"version": "cliRelease", "gitBranch": "vcsRef"}
    assert schema_drift.flood(renamed, [version, branch], rounds=0) == {}
    held = [node("git", {"object": 1}, {"dotted": 0.5, "slug": 0.5}, may(1.0)), node("git.version", {"string": 1}, {"dotted": 1}, may(None)), node("git.head", {"string": 1}, {"slug": 1}, may(1.0))]
    assert schema_drift.flood(held, [version, branch]) == {"version": "git.version", "gitBranch": "git.head"}
    assert schema_drift.flood(held, [version, branch], rounds=0) == {"gitBranch": "git"}  # names alone are wrong
    strangers = [node("requestId", {"string": 1}, {"slug": 1}, may(0.0)), node("m.calls[].x.old", {"string": 1}, {"slug": 1}, may(0.2)), node("m.ms", {"number": 1}, {"digits": 1}, may(None)), node("id", {"string": 1}, {"uuid": 1}, may(None))]
    assert schema_drift.flood(strangers, [version, branch]) == {}
    thread = node("thread_id", {"string": 0.7, "number": 0.3}, {"prefixed_hex": 0.6, "digits": 0.4})
    assert schema_drift.flood([node("thread", {"object": 1}, {"prefixed_hex": 1}, {"thread_id": 1.0}), node("thread.id", {"string": 1}, {"prefixed_hex": 1}, {"thread_id": 1.0})], [thread]) == {"thread_id": "thread.id"}
    assert schema_drift.flood([], [thread]) == {} and schema_drift.flood(renamed, []) == {}
    many = [node(f"map.k{i}", {"string": 1}, {"uuid": 1}, may(None)) for i in range(50_000)]
    assert schema_drift.flood([*many, *renamed], [version, branch]) == {"version": "cliRelease", "gitBranch": "vcsRef"}


def test_consistent_table(spark):
    deep = '{"version": "9.1.1", "x": ' + '{"y": [' * 3000 + "1" + "]}" * 3000 + "}"
    rows = [(1, "a", "claude-code", 1, "f1", 1, '{"version": {"major": 2, "minor": 3}, "gitBranch": {"name": "main", "dirty": false}}'), (2, "a", "claude-code", 2, "f2", 1, '{"cliVersion": [1,0,6], "branch": "dev", "type": "user", "n": 1.50, "input": {"a": [1, null]}, "z": null}'), (3, "b", "codex", 1, "f3", 1, '{"thread": {"id": 42}}'), (4, "b", "codex", 1, "f3", 2, "nope"), (5, "b", "codex", 1, "f3", 3, "[1]"), (6, "a", "claude-code", 3, "f4", 1, deep), (7, "c", "other", 1, "f5", 1, '{"a.b": "c"}'), (8, "c", "other", 1, "f5", 2, None)]
    df = spark.createDataFrame(rows, "raw_id bigint, archive_id string, agent string, file_seq int, file_name string, line_no int, raw_json string")
    table = {r.raw_id: r for r in schema_drift.consistent_table(df).collect()}
    got = {k: (r.version, r.git_branch, r.thread_id) for k, r in table.items()}
    assert got == {1: ("2.3", "main", None), 2: ("1.0.6", "dev", None), 3: (None, None, "42"), 4: (None, None, None), 5: (None, None, None), 6: ("9.1.1", None, None), 7: (None, None, None), 8: (None, None, None)}
    assert table[2].fields == {"type": "user", "n": "1.5", "input": '{"a": [1, null]}', "z": None} and table[1].fields == {} and table[4].fields is None
    assert table[7].fields == {"a.b": "c"} and json.loads(table[6].fields["x"][:0] or "1") == 1 and len(table[6].fields["x"]) > 20_000


def test_deep_json():
    for t in ['{"a":[1,2.5,-3e4,{"b":null,"c":[true,false,[]],"d":{}}],"e":"x\\u00e9\\n"}', "[]", " 1 ", "[1,", '{"a"}', '{"a":1,}', "[1 2]", "", "[1]]", "01", "1.", "-", '{"a":1,"a":2}']:
        for written in (False, True):
            try:
                want = repr(json.loads(t, parse_float=str, parse_int=str) if written else json.loads(t))
            except ValueError:
                want = "bad"
            try:
                got = repr(deep_json._loads(t, written))
            except ValueError:
                got = "bad"
            assert got == want
    text = '{"a": [' * 40_000 + "1" + "]}" * 40_000
    assert deep_json.dumps(deep_json.loads(text)) == text


def test_orphans(spark):
    refs = spark.createDataFrame([("p", "2024-01", "r1", "a"), ("p", "2024-01", "r1", "a"), ("p", "2024-02", "r2", "A"), ("s", "2024-01", None, "zz"), ("p", None, "r3", "zz"), ("p", "2024-01", "r4", None)], "ref_table string, period string, row_key string, key string")
    live = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "key string")
    got = sorted((r.ref_table, r.row_key or "", r.key) for r in orphans.orphan_references(refs, live).collect())
    assert got == [("p", "r2", "A"), ("p", "r3", "zz"), ("s", "", "zz")]
    assert orphans.orphan_references(refs, live.limit(0)).count() == 4
    assert orphans.orphan_references(refs.limit(0), live).count() == 0
    rep = {(r.ref_table, r.period): (r["keys"], r.missing_keys, r.refs, r.missing_refs) for r in orphans.orphan_report(refs, live).collect()}
    assert rep["p", "2024-01"] == (1, 0, 2, 0) and rep["s", "2024-01"] == (1, 1, 1, 1)


def test_many_keys_over_several_bitmaps(spark):
    refs = spark.range(100_000).selectExpr("'t' as ref_table", "'p' as period", "cast(id as string) as row_key", "concat('k', id) as key")
    live = spark.range(100_000).where("id % 1000 <> 7").selectExpr("concat('k', id) as key")
    got = {r.key for r in orphans.orphan_references(refs, live).collect()}
    assert got == {f"k{i}" for i in range(100_000) if i % 1000 == 7}


@given(st.lists(st.one_of(st.integers(0, 32_767), st.integers(100, 140)), max_size=60), st.lists(st.integers(0, 200), max_size=60), st.integers(0, 20_000), st.integers(0, 12_000))
@settings(max_examples=150, deadline=None)
def test_compressed_bitmaps(a, b, start, length):
    for x in (set(a), set(a) | set(range(start, start + length)), set(range(start % 7, 32_768, 3))):
        packed = orphans.compress(list(x))
        assert set(np.flatnonzero(orphans.expand(packed))) == x and len(packed) <= 1 + min(2 * len(x), 4096)
        for y in (None, set(b), set(range(50, 50 + length))):
            assert set(orphans.and_not(packed, None if y is None else orphans.compress(list(y))).tolist()) == x - (y or set())
    assert len(orphans.compress(list(range(9000)))) == 5
