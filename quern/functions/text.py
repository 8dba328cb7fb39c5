"""Column functions over text: error fingerprints, redaction, paths, tags, session and problem types."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# What counts as an error message, in order.
ERROR_PATTERNS = [
    r"error\[?[E\d]{4,5}\]?:.*",
    r"thread '.*' panicked at.*",
    r"Traceback \(most recent call last\):",
    r"\b\w+Error: .+",
    r"(?:TypeError|ReferenceError|SyntaxError|RangeError): .+",
    r"panic: .+",
    r"fatal error: .+",
    r"HTTP/[12]\.[01] [45]\d\d .+",
    r"(?:SQLSTATE\[|ORA-\d{5}:|ERROR: \d+ ).+",
    r"(?:cannot find module|undefined symbol|undefined reference).+",
    r"(?:ECONNREFUSED|ECONNRESET|ETIMEDOUT|ENOTFOUND|Connection refused|Connection timed out).+",
    r"(?i)(?:token[_ ]refresh[_ ]fail(?:ed|ing|ure)|oauth[_ ]error|authentication[_ ]fail(?:ed|ure)|authorization[_ ]fail(?:ed|ure)).+",
    r"(?i)(?:invalid[_ ](?:token|credentials?|api[_ ]key)|expired[_ ](?:token|session|credentials?)|access[_ ]token[_ ](?:expired|invalid|revoked)).+",
    r"(?i)(?:401 Unauthorized|403 Forbidden|re-?authenticate|session[_ ]expired|login[_ ]required).+",
    r"(?:error|Error|ERROR): .+",
    r"Permission denied.*",
    r"(?:No such file|file not found|File not found).+",
]
# What varies in an error message and what stands for it, in order.
ERROR_RULES = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\b\d{2}:\d{2}:\d{2}\b", "<TIME>"),
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>"),
    (r"0x[0-9a-fA-F]{8,16}", "<ADDR>"),
    (r"(?:/[\w.-]+){2,}", "<PATH>"),
    (r"\b\w[\w-]*/[\w./\-]+", "<PATH>"),
    (r"[A-Z]:\\[\w\\.-]+", "<PATH>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<HOST>"),
    (r":\d{2,5}\b", ":<LINE>"),
    (r"\bpid\s+\d+\b", "pid <PID>"),
    (r"\b\d{6,}\b", "<NUM>"),
    (r"(?i)(?:bearer\s+|(?:token|api[_-]?key|access[_-]?token|refresh[_-]?token)\s*[=:]\s*)[\w\-\.]+", "<CREDENTIAL>"),
]
# Personal data, in the order in which it is replaced.
PII = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{3}\)?[\s\-\.])?\d{3}[\s\-\.]\d{4}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]){3}\d{1,4}\b|\b\d{16,19}\b",
    "ssn": r"\b\d{3}[\s\-]\d{2}[\s\-]\d{4}\b",
}
# Words that speak for a session's type; the order settles ties (the last of equal scores wins).
SESSION_SIGNALS = {
    "debug": (2, ["error", "bug", "fix", "crash", "exception", "traceback", "panic", "segfault", "stack trace", "debug"]),
    "feature": (1, ["implement", "add feature", "create new", "build ", "new module", "new function", "new endpoint"]),
    "refactor": (1, ["refactor", "cleanup", "clean up", "rename", "reorganize", "simplify", "extract method"]),
    "configuration": (1, ["config", "settings", "docker-compose", "yaml", "kubernetes", "deployment", "ci/cd", "github actions"]),
    "documentation": (1, ["readme", "documentation", "docs", "comment", "docstring", "changelog"]),
    "investigation": (1, ["investigate", "explore", "understand", "why does", "what causes", "how does"]),
}
# Patterns of the problem types.
PROBLEM = {
    "debug": r"(?i)\b(fix|bug|error|crash|debug|broken|fault|regression)\b",
    "feature": r"(?i)\b(add|implement|create|build|new|support|integrate|enable)\b",
    "refactor": r"(?i)\b(refactor|rename|move|extract|clean\s*up|restructure|simplify|reorganize)\b",
    "investigation": r"(?i)\b(explain|how does|what is|why|understand|investigate|explore|look into|figure out)\b",
    "documentation": r"(?i)\b(document|readme|changelog|docstring|comment|docs)\b",
}
# Names of configuration files and of documentation.
CONFIG_FILE = r"Dockerfile|Makefile|docker-compose\.ya?ml|\.env|\.(?:toml|yaml|yml|json|ini|cfg|conf)$"
DOC_FILE = r"\.(?:md|rst|txt|adoc)$"
# Tags of file extensions and of commands.
EXTENSION_TAGS = {
    "rs": "rust", "py": "python", "ts": "typescript", "tsx": "react", "jsx": "react", "js": "javascript", "go": "go", "mod": "go", "rb": "ruby", "java": "java",
    "kt": "kotlin", "swift": "swift", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "sh": "shell", "bash": "shell", "sql": "sql",
    "html": "html", "css": "css", "scss": "scss", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "lua": "lua", "r": "r",
    "dart": "dart", "zig": "zig", "ex": "elixir", "exs": "elixir", "hs": "haskell", "scala": "scala",
}
COMMAND_TAGS = {
    "docker": "docker", "docker-compose": "docker", "git": "git", "npm": "npm", "cargo": "cargo", "kubectl": "kubectl", "make": "make", "pip": "pip", "pip3": "pip",
    "python": "python", "python3": "python", "node": "node", "yarn": "yarn", "pnpm": "pnpm",
}
# Where file paths stand in text, and corrections by users.
PATH_PATTERNS = [
    r"[\"']([^\"']+\.[a-z]{1,6})[\"']",
    r"(?:edit|cat|less|vim|nano|open|read|write|create|delete|modify)\s+([^\s]+\.[a-z]{1,6})",
    r"`([^`]+\.[a-z]{1,6})`",
    r"(?:^|\s)([~/][^\s,\)]+|/\S+)",
    r"(?:^|\s)((?:\w[\w\-]*/)+[\w\-]+\.[a-z]{1,8})(?:\s|$|,|\))",
]
FILE_EXTENSIONS = [
    "rs", "py", "js", "ts", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "cs", "php", "rb", "swift", "kt", "scala", "sh", "bash", "zsh", "fish",
    "toml", "yaml", "yml", "json", "xml", "html", "css", "scss", "sass", "md", "txt", "rst", "adoc", "sql", "db", "sqlite", "db3", "lock", "sum", "mod",
    "gitignore", "dockerignore", "env", "dockerfile", "makefile", "cmakelists", "gradle", "pom",
]
TASK_EXTENSIONS = ["rs", "py", "ts", "js", "tsx", "jsx", "go", "java", "c", "cpp", "h", "hpp", "rb", "php", "sh", "yaml", "yml", "toml", "json", "md"]
TASK_FOLDERS = [
    "src/", "tests?/", None, "lib/", "cmd/", "pkg/", "internal/", "api/", "components?", "handlers?", "middlewares?", "utils?", "helpers?", "models?", "views?", "controllers?", "services?", "routes?", "config/",
]  # in this order; None: any path with a known extension
CORRECTIONS = [
    r"(?i)don'?t use\s+(\S+).*?(?:use|try|prefer)\s+(\S+)",
    r"(?i)(?:use|try|prefer)\s+(\S+)\s+instead\s+of\s+(\S+)",
    r"(?i)always\s+(?:use|prefer)\s+(\S+)",
    r"(?i)never\s+(?:use|prefer)\s+(\S+)",
    r"(?i)prefer\s+(\S+)\s+over\s+(\S+)",
    r"(?i)(\S+)\s+is\s+(?:not\s+)?preferred",
]
# Commands that stand in for each other.
COMPETING_TOOLS = [("pnpm", "npm"), ("pnpm", "yarn"), ("yarn", "npm"), ("bun", "npm"), ("cargo", "rustup"), ("pip", "conda"), ("pytest", "unittest"), ("vitest", "jest"), ("pnpm", "bun")]
# Words that tell nothing about a text.
STOP_WORDS = [
    "about", "after", "all", "also", "and", "are", "because", "been", "being", "but", "can", "could", "did", "does", "doing", "each", "for", "from", "get", "got",
    "had", "has", "have", "her", "how", "into", "its", "just", "like", "make", "may", "new", "not", "now", "old", "one", "other", "our", "out", "over",
    "see", "should", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "this", "was", "way", "were", "who", "will", "with", "would", "you",
]


def quoted(words: str) -> str:
    """A text as a pattern that matches it and nothing else, in the notation that all engines share."""
    return "".join(c if c.isalnum() or c in " _-" else "\\" + c for c in words)


def normalize_error(e: Column) -> Column:
    """The message with what varies replaced; beyond 200 bytes its last word is dropped (if that blank is past byte 150)."""
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), ERROR_RULES, e)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.transform(F.array(out), lambda x: F.when((F.octet_length(x) > 200) & (F.octet_length(F.regexp_replace(x, r" [^ ]*$", "")) > 150), F.regexp_replace(x, r" [^ ]*$", "")).otherwise(x))[0]


def error_messages(text: Column) -> Column:
    """All matches of the error patterns, pattern by pattern."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 0) for p in ERROR_PATTERNS]))


def error_fingerprints(text: Column) -> Column:
    """Distinct normalised error messages in order."""
    return F.array_distinct(F.transform(error_messages(text), normalize_error))


# ``\b``, ``\d`` and ``\s`` for text of any script: a Unicode digit is a digit, a no-break space a blank, and a letter
# outside ASCII (which may stand beside an address without a blank) is no part of a word.  On ASCII text nothing differs.
_EDGE = r"(?:(?=[\w\p{Nd}])(?<![\w\p{Nd}])|(?![\w\p{Nd}])(?<=[\w\p{Nd}]))"
# What a match can begin with, looked at before the edge: digits are rare.
_LEAD = {"phone": r"(?=[+(\d])", "credit_card": r"(?=\d)", "ssn": r"(?=\d)"}


def _any_script(kind: str) -> str:
    p = _LEAD.get(kind, "") + f"(?:{PII[kind]})"
    return p.replace(r"\b", _EDGE).replace(r"\d", r"\p{Nd}").replace(r"\s", r"\s\x{85}\p{Z}")


def redact(text: Column, kinds: tuple[str, ...] = tuple(PII), custom: dict[str, str] | None = None) -> Column:
    out = reduce(lambda c, k: F.regexp_replace(c, _any_script(k), f"[REDACTED:{k}]"), [k for k in PII if k in kinds], text)
    return reduce(lambda c, kv: F.regexp_replace(c, kv[1], f"[REDACTED:{kv[0]}]"), (custom or {}).items(), out)


def has_pii(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(_any_script(k)) for k in PII])


def session_type(text: Column, unresolved: Column | None = None) -> Column:
    """Type by substrings present; ties go to the later type, no signal is an investigation."""
    t = F.lower(text)
    scores = {k: sum((F.when(t.contains(s), w).otherwise(0) for s in words), F.lit(0)) for k, (w, words) in SESSION_SIGNALS.items()}
    if unresolved is not None:
        scores["debug"] = scores["debug"] + F.when(unresolved, 5).otherwise(0)
    ranked = F.array(*[F.struct(s.alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())])
    best = F.array_max(ranked)
    return F.when(best["s"] == 0, "investigation").otherwise(best["k"])


def problem_type(text: Column, has_error: Column, has_config: Column, has_doc: Column) -> Column:
    """struct(primary, secondary): the strongest and second strongest type, fixed order on ties; secondary null without evidence."""
    n = {k: F.regexp_count(text, F.lit(p)) for k, p in PROBLEM.items()}
    scores = {
        "debug": n["debug"] + F.when(has_error, 3).otherwise(0), "feature": n["feature"],
        "refactor": F.when(n["refactor"] > 0, 2).otherwise(0), "investigation": F.when(n["investigation"] > 0, 2).otherwise(0),
        "configuration": F.when(has_config, 3).otherwise(0), "documentation": n["documentation"] + F.when(has_doc, 3).otherwise(0),
    }
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(s.cast("int").alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())])))
    return F.struct(ranked[0]["k"].alias("primary"), F.when(ranked[1]["s"] > 0, ranked[1]["k"]).alias("secondary"))


def extension_tag(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    return F.create_map(*[F.lit(x) for kv in EXTENSION_TAGS.items() for x in kv])[ext]


def command_tag(command: Column) -> Column:
    first = F.split(F.trim(command), r"\s+")[0]
    return F.create_map(*[F.lit(x) for kv in COMMAND_TAGS.items() for x in kv])[first]


def file_paths(text: Column) -> Column:
    """Sorted distinct paths named in a text."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in PATH_PATTERNS]))))


def path_like(path: Column) -> Column:
    """Whether a text looks like a file's path: by how it begins, or by a known extension; addresses and coloured text do not."""
    other = path.rlike(r"^(?:https?|ftp)://") | path.contains("\x1b")
    return ~other & (path.rlike(r"^(?:~/|\.{1,2}/|/[\p{L}\p{N}])") | path.rlike(r"\.(?:" + "|".join(FILE_EXTENSIONS) + r")$"))


def resolve_path(path: Column, project: Column, home: Column) -> Column:
    """A path made absolute: as it is, below the home folder, or below the project; without a project as it is."""
    joined = F.concat(F.regexp_replace(project, "/+$", ""), F.lit("/"), path)
    return F.when(path.startswith("/"), path).when(path.startswith("~/") & home.isNotNull(), F.concat(F.regexp_replace(home, "/+$", ""), F.lit("/"), F.substring(path, 3, 1 << 30))).when(project.isNotNull(), joined).otherwise(path)


def task_paths(task: str) -> list[str]:
    """File paths that a task names, in the order of the patterns and then of the text."""
    name = r"[a-zA-Z0-9_/\-.]+\."
    patterns = [name + "(?:" + "|".join(TASK_EXTENSIONS) + ")" if f is None else f + name + "[a-z]{2,4}" for f in TASK_FOLDERS]
    return list(dict.fromkeys(m[0] for p in patterns for m in re.finditer(p, task)))


def path_parts(path: Column) -> Column:
    """struct(name, extension, parent): the last part of a path, what stands behind its last dot, and what stands before."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.struct(name.alias("name"), F.nullif(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1), F.lit("")).alias("extension"), F.nullif(F.regexp_replace(path, r"/?[^/]*$", ""), F.lit("")).alias("parent"))


def corrections(text: Column) -> Column:
    """First match of each correction pattern, trimmed and without closing punctuation, of 5 to 200 bytes, distinct."""
    hits = F.transform(F.array(*[F.regexp_extract(text, p, 0) for p in CORRECTIONS]), lambda x: F.trim(F.regexp_replace(F.trim(x), r"[.!?,]+$", "")))
    return F.array_distinct(F.filter(hits, lambda x: F.octet_length(x).between(5, 200)))


def snippet(text: Column, limit: int) -> Column:
    """A prefix of ``limit`` characters cut at a blank, three dots behind; short texts as they are."""
    cut = F.left(text, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.trim(F.when(cut.contains(" "), F.regexp_replace(cut, r"(?s) [^ ]*$", "")).otherwise(cut)), F.lit("...")))


def token_cost(snippet_: Column, summary: Column) -> Column:
    return F.ceil((F.octet_length(snippet_) + F.octet_length(F.coalesce(summary, F.lit("")))) / 4)


def _osa(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours counts as one edit."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


@F.pandas_udf(IntegerType())
def _osa_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def osa_within(a: Column, b: Column, d: int = 1) -> Column:
    """Whether the edit distance is at most d, a swap of neighbours counting as one edit.

    Up to one edit in built-in functions; beyond that the values that can be
    within it (a swap is two edits to the built-in distance) are worked out.
    """
    lev = F.levenshtein(a, b)
    if d > 1:
        return F.when(lev <= d, True).when(lev > 2 * d, False).otherwise(_osa_column(a, b) <= d)
    n = F.length(a)
    swap = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (lev <= d) | ((F.length(b) == n) & (n >= 2) & (lev == 2) & swap) if d == 1 else lev <= d
