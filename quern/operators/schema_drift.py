"""Schemas that drift between files (problem 3).

Each file's fields form a schema graph: paths, what they stand in, their types,
the looks of their values and the values' words.  Similarity flooding matches
it with the graph of the followed fields, whose types, looks and words are those
that the corpus shows at their usual place: first scores come from names and
shared values, then every pair of nodes passes its score to the pairs that its
edges lead to until nothing moves, and the flooded scores choose.

A correspondence must be consistent with the corpus: a path that stands beside
a followed field in other files is another field and no pair of it.  Files of
one schema are matched once.  A field is followed through the files of an
archive by where and as what type it stands (its carrier); one consistent table
is read through the carriers.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import deep_json
from quern.session import shared_checkpoint

# Looks of a scalar, first that fits.
LOOKS = [
    ("uuid", r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    ("time", r"\d{4}-\d\d-\d\d[T ].*"),
    ("dotted", r"v?\d+(\.\d+){1,3}([-+].*)?"),
    ("digits", r"\d+"),
    ("prefixed_hex", r"[a-z]{1,6}[-_](?=[0-9a-f]*\d)[0-9a-f]{6,}"),
    ("path", r"[~.]?/?(?:[\w.@-]++/)+[\w.@-]+/?"),
    ("slug", r"[\w.-]*\w[\w.-]*"),
]
_LOOKS = [(n, re.compile(p, re.S)) for n, p in LOOKS]
# The fields that problem 3 follows, by agent: their name, which is their usual path.
TARGETS = {"claude-code": ["version", "gitBranch"], "codex": ["thread_id"]}
NAMES = sorted({t for ts in TARGETS.values() for t in ts})
KEYS = ["archive_id", "agent", "file_seq", "file_name"]
SKETCH = 256  # smallest word hashes that are kept of a path
BESIDE = 0.05  # share of its files in which a carrier may stand beside the field it carries elsewhere (files that mix two shapes)
FLOOR = 0.37  # flooded score, against that of the field at its usual place, from which a path is its carrier


_KINDS = {type(None): "null", bool: "boolean", dict: "object", list: "array", str: "string"}


def type_of(v: object) -> str:
    return _KINDS.get(type(v), "number")


def look_of(v: object) -> str:
    if isinstance(v, bool) or v is None:
        return "other"
    if isinstance(v, (int, float)):
        return "dotted" if isinstance(v, float) else "digits"
    s = str(v)
    if not s or (s[0] not in "0123456789v" and (" " in s or "\n" in s or "\t" in s)):
        return "other"  # prose; a time is the only look with a blank in it
    return next((n for n, p in _LOOKS if p.fullmatch(s)), "other")


_WORD, _BLANK, _DIGIT = re.compile(r"[^\W_]+"), re.compile(r"\s"), re.compile(r"\d")


def words_of(s: str) -> tuple[int, ...]:
    """Hashes of the words of an identifier; runs that hold a digit vary freely and are none, and prose has none."""
    if _BLANK.search(s):
        return ()
    return tuple({zlib.crc32(w.lower().encode("utf-8", "replace")) for w in _WORD.findall(s) if not _DIGIT.search(w)})


_PLAIN = re.compile(r'[^."\[\]]+')


def _step(key: str) -> str:
    """A key as a step of a path; keys that would be read as several steps stand in quotes."""
    return key if _PLAIN.fullmatch(key) else json.dumps(key, ensure_ascii=False)


class _Scalars:
    """Looks and words of scalars, remembered for short ones."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}

    def __call__(self, v: object) -> tuple[str, tuple[int, ...]]:
        if not isinstance(v, str):
            return look_of(v), ()
        got = self.known.get(v)
        if got is None:
            got = (look_of(v), words_of(v))
            if len(v) <= 64:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[v] = got
        return got


def fields(record: dict, scalars: _Scalars) -> Iterator[tuple[str, str, str, tuple[int, ...]]]:
    """(path, type, look, words) of every field at any depth; containers look and speak as the scalars in them do.

    Fields of objects in arrays stand at ``a[].b``; other items are values of
    their array.
    """
    todo = [("", record)]
    while todo:
        prefix, node = todo.pop()
        for k, v in node.items():
            path = prefix + (k if k.isalnum() else _step(k))
            if isinstance(v, (dict, list)):
                looks: Counter = Counter()
                said: set[int] = set()
                inside = [(path, v)]
                while inside:
                    at, c = inside.pop()
                    if isinstance(c, dict):
                        todo.append((at + ".", c))
                        if c is not v:
                            continue
                    for x in c.values() if isinstance(c, dict) else c:
                        if isinstance(x, (dict, list)):
                            if isinstance(c, list):
                                inside.append((at + "[]", x))
                        else:
                            look, words = scalars(x)
                            looks[look] += 1
                            said.update(words)
                yield path, type_of(v), looks.most_common(1)[0][0] if looks else "other", tuple(said)
            else:
                yield path, type_of(v), *scalars(v)


TYPES = ["null", "array", "boolean", "number", "object", "string"]  # bits of a mask of types, in this order
_BIT = {t: 1 << i for i, t in enumerate(TYPES)}


def observed(lines: DataFrame) -> DataFrame:
    """All that the corpus shows of its fields, from one pass: archive_id, agent, file_seq, file_name, fields, path, types, looks, words.

    ``lines``: archive_id, agent, file_seq, file_name, raw_json.  Unreadable
    lines and lines that are no object count for nothing; a file of nothing else
    has no rows.  A row is either of a file (``fields``: its paths with a mask of
    their types) or of an agent's ``path`` (counts of types and looks, and the
    smallest ``SKETCH`` hashes of its values' words); a task gives at most one of
    each, and one more file row a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scalars = _Scalars()
        kinds: dict[tuple[str, str], Counter] = {}
        said: dict[tuple[str, str], set[int]] = {}
        for pdf in batches:
            files: dict[tuple, dict[str, int]] = {}
            for *key, text in zip(*(pdf[k] for k in KEYS), pdf["raw_json"]):
                try:
                    record = deep_json.loads(text)
                except (ValueError, TypeError):
                    continue
                if not isinstance(record, dict):
                    continue
                seen = files.setdefault(tuple(key), {})
                for path, kind, look, words in fields(record, scalars):
                    seen[path] = seen.get(path, 0) | _BIT[kind]
                    of_path = (key[1], path)
                    if (n := kinds.get(of_path)) is None:
                        n = kinds[of_path] = Counter()
                    n[kind, look] += 1
                    if words:
                        of = said.setdefault(of_path, set())
                        of.update(words)
                        if len(of) > 4 * SKETCH:
                            said[of_path] = set(sorted(of)[:SKETCH])
            if files:
                rows = [(*k, [{"path": p, "mask": m} for p, m in seen.items()], None, None, None, None) for k, seen in files.items()]
                yield pd.DataFrame(rows, columns=[*KEYS, "fields", "path", "types", "looks", "words"])
        rows = []
        for (agent, path), n in kinds.items():
            looks: Counter = Counter()
            types: Counter = Counter()
            for (kind, look), k in n.items():
                if kind != "null":
                    types[kind] += k
                    looks[look] += k
            rows.append((None, agent, None, None, None, path, dict(types), dict(looks), sorted(said.get((agent, path), ()))[:SKETCH]))
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=[*KEYS, "fields", "path", "types", "looks", "words"]).astype({"file_seq": "Int32"})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[*KEYS, "fields", "path", "types", "looks", "words"]).astype({"file_seq": "Int32"})

    out = "archive_id string, agent string, file_seq int, file_name string, fields array<struct<path: string, mask: int>>, path string, types map<string, bigint>, looks map<string, bigint>, words array<bigint>"
    return lines.select(*KEYS, "raw_json").mapInPandas(run, out)


def file_fields(seen: DataFrame) -> DataFrame:
    """archive_id, agent, file_seq, file_name, fields (path, mask), has: the fields of each file and which of the followed ones stand at their usual place."""
    each = seen.where("path is null").select(*KEYS, F.inline("fields")).repartition(*KEYS)  # one shuffle for both groupings
    of = each.groupBy(*KEYS, "path").agg(F.bit_or("mask").alias("mask")).groupBy(*KEYS).agg(F.collect_list(F.struct("path", "mask")).alias("fields"))
    has = F.filter(_targets_of(), lambda t: F.exists("fields", lambda f: (f["path"] == t) & (f["mask"] > _BIT["null"])))
    return of.withColumn("has", has)


@dataclass
class Node:
    """A path with the shares of its types and looks, and for each followed field that it may carry the share of its words that the field has (None: no words)."""

    path: str
    types: dict[str, float] = field(default_factory=dict)
    looks: dict[str, float] = field(default_factory=dict)
    may: dict[str, float | None] = field(default_factory=dict)
    empty: bool = False  # nothing but null in this file


def _parts(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)}


def alike(path: str, target: str) -> float:
    """How alike two names are: shared words, or shared runs of three letters, of the whole path."""
    a, b = _parts(path), _parts(target)
    words = len(a & b) / len(a | b) if a | b else 0.0
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    x, y = grams("".join(sorted(a))), grams("".join(sorted(b)))
    return max(words, 0.5 * len(x & y) / len(x | y) if x | y else 0.0)


def flood(nodes: list[Node], targets: list[Node], rounds: int = 200, floor: float = FLOOR) -> dict[str, str]:
    """Followed field -> path of its carrier among the nodes, by similarity flooding.

    Nodes of the two graphs are paths (the root among them), types, looks and,
    for each path, its values; edges lead from a path to its parent, types,
    looks and values.  A pair of paths begins with what the names say, a pair of
    values with the share of common words, equal types, looks and the roots with
    1.  In each round a pair receives what the pairs next to it hold, each edge
    kind as an average; scores are divided by the greatest, until they stay.
    The followed fields themselves take part as nodes of the first graph, so
    that a score can be told against that of the field at its usual place.
    With 0 rounds the first scores choose.
    """
    if not nodes or not targets:
        return {}
    ours = [*nodes, *(Node(t.path, t.types, t.looks, {t.path: None}) for t in targets)]
    n, m = len(ours), len(targets)
    index = {x.path: i for i, x in enumerate(nodes)}

    def parent(path: str) -> int | None:  # index of the path around, -1: the root, None: a path that is no candidate
        head = re.sub(r"(?:\[\])*$", "", path[: max(path.rfind("."), 0)])
        return -1 if not head else index.get(head)

    may = np.array([[t.path in x.may for t in targets] for x in ours])
    names = np.array([[alike(x.path, t.path) for t in targets] for x in ours]) * may
    shared = np.array([[x.may.get(t.path) if x.may.get(t.path) is not None else 0.5 for t in targets] for x in ours]) * may
    shared[len(nodes) :][np.eye(m, dtype=bool)] = 1.0

    def overlap(of: str) -> tuple[np.ndarray, np.ndarray]:
        kinds = sorted({k for x in [*ours, *targets] for k in getattr(x, of)})
        a = np.array([[getattr(x, of).get(k, 0.0) for k in kinds] for x in ours]).reshape(n, len(kinds))
        b = np.array([[getattr(t, of).get(k, 0.0) for k in kinds] for t in targets]).reshape(m, len(kinds))
        return a, b

    (la, lb), (ya, yb) = overlap("looks"), overlap("types")
    up = [parent(x.path) for x in ours]
    top = np.array([u == -1 for u in up])
    inner = np.array([i for i, u in enumerate(up) if u is not None and u >= 0], int)
    around = np.array([up[i] for i in inner], int)
    s, v, root = names.copy(), shared.copy(), 1.0
    holds = np.zeros(n)  # pairs of a path with the root
    looks, kinds = np.ones(la.shape[1]), np.ones(ya.shape[1])
    weigh = lambda a, w, b: (a * w) @ b.T

    def back(a: np.ndarray, p: np.ndarray, b: np.ndarray) -> np.ndarray:  # a pair of equal kinds gets the mean of the path pairs that share it
        got, of = ((a.T @ (p * may)) * b.T).sum(1), ((a.T @ may) * b.T).sum(1)
        return np.divide(got, of, out=np.zeros_like(got), where=of > 0)

    for _ in range(rounds):
        nest = np.where(top, root, 0.0)
        if len(inner):
            nest[inner] = holds[around]
        new = names + s + 0.8 * v + 0.5 * weigh(la, looks, lb) + 0.1 * weigh(ya, kinds, yb) + 0.25 * nest[:, None]
        new = new * may
        new_v = shared + v + 0.5 * s
        up_scores = np.zeros(n)
        if len(inner):
            np.maximum.at(up_scores, around, s[inner].max(1))
        new_holds = holds + 0.5 * up_scores
        new_looks, new_kinds = 1 + looks + 0.5 * back(la, s, lb), 1 + kinds + 0.5 * back(ya, s, yb)
        new /= max(new.max(), 1e-12)
        new_v /= max(new_v.max(), 1e-12)
        new_holds /= max(new_holds.max(), 1.0)
        new_looks, new_kinds = (x / max(x.max(), 1e-12) if x.size else x for x in (new_looks, new_kinds))
        moved = max(np.abs(new - s).max(), np.abs(new_v - v).max())
        s, v, holds, looks, kinds = new, new_v * may, new_holds, new_looks, new_kinds
        if moved < 1e-6:
            break
    own = s[len(nodes) :].diagonal()
    score = s[: len(nodes)] / np.maximum(own, 1e-12) * np.array([0.5 if x.empty else 1.0 for x in nodes])[:, None]
    out: dict[str, str] = {}
    taken: list[str] = []
    order = sorted(((i, j) for i in range(len(nodes)) for j in range(m) if may[i, j] and score[i, j] * (2.0 if nodes[i].empty else 1.0) >= floor), key=lambda p: (-round(score[p], 9), len(nodes[p[0]].path), nodes[p[0]].path))
    for i, j in order:
        p = nodes[i].path
        if targets[j].path in out or any(p == q or p.startswith((q + ".", q + "[")) or q.startswith((p + ".", p + "[")) for q in taken):
            continue
        out[targets[j].path] = p
        taken.append(p)
    return out


def _targets_of(column: str = "agent") -> Column:
    """The fields that an agent's files are followed for."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for agent, names in TARGETS.items():
        out = out.when(F.col(column) == agent, F.array(*map(F.lit, names)))
    return out


def paths(seen: DataFrame, files: DataFrame) -> DataFrame:
    """Per agent and path what the corpus shows: files, looks and types (counts), words (sketch), and beside (field -> files in which both stand)."""
    here = files.select("agent", "has", F.inline("fields")).where(F.col("mask") > _BIT["null"])
    beside = [F.count_if(F.array_contains("has", t)).alias(f"beside_{i}") for i, t in enumerate(NAMES)]
    stats = here.groupBy("agent", "path").agg(F.count("*").alias("files"), *beside)
    of = seen.where("path is not null")
    counts = lambda c: of.select("agent", "path", F.explode(c).alias("k", "n")).groupBy("agent", "path", "k").agg(F.sum("n").alias("n")).groupBy("agent", "path").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(c))
    words = of.select("agent", "path", F.explode("words").alias("w")).distinct().groupBy("agent", "path").agg(F.slice(F.array_sort(F.collect_list("w")), 1, SKETCH).alias("words"))  # at most SKETCH a task
    out = stats.join(counts("looks"), ["agent", "path"], "left").join(counts("types"), ["agent", "path"], "left").join(words, ["agent", "path"], "left")
    return out.withColumn("beside", F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*[F.col(f"beside_{i}") for i in range(len(NAMES))]))).drop(*[f"beside_{i}" for i in range(len(NAMES))])


def _shares(counts: dict[str, int] | None) -> dict[str, float]:
    total = sum((counts or {}).values())
    return {k: n / total for k, n in sorted(counts.items())} if total else {}


def _common(mine: Column, theirs: list[int]) -> Column:
    """The share of a path's words that a followed field has too, by what both sketches cover; null without words."""
    full = len(theirs) == SKETCH
    within = F.filter(mine, lambda w: (w <= max(theirs)) if full else F.lit(True)) if theirs else F.array().cast("array<bigint>")
    shared = F.array_intersect(within, F.array(*map(F.lit, theirs)).cast("array<bigint>")) if theirs else within
    return F.when(F.size(within) > 0, F.round(F.size(shared) / F.size(within), 3))


def carriers(lines: DataFrame) -> DataFrame:
    """file -> carriers: archive_id, agent, file_seq, file_name, field_name, path, types.

    One row a file and followed field of its agent; ``path`` is null where the
    file has no carrier, ``types`` ('+' between) leaves nulls out and is '' if
    the carrier holds nothing but null.  A path may carry a field if it never,
    or in at most ``BESIDE`` of its files, stands beside it.
    """
    seen = shared_checkpoint(observed(lines))
    files = shared_checkpoint(file_fields(seen))
    known = shared_checkpoint(paths(seen, files))
    usual = {(r.agent, r.path): r for r in known.where(F.array_contains(_targets_of(), F.col("path"))).collect()}  # one row a followed field
    targets = {}
    for agent, names in TARGETS.items():
        rows = [(t, usual.get((agent, t))) for t in names]
        targets[agent] = [Node(t, _shares(r and r.types), _shares(r and r.looks)) for t, r in rows]
    sketches = {k: sorted(r.words or []) for k, r in usual.items()}
    may = F.filter(_targets_of(), lambda t: (t == F.col("path")) | (F.try_element_at("beside", t) <= F.col("files") * BESIDE))
    shared = F.when(F.lit(False), F.lit(None).cast("double"))
    for (agent, t), sketch in sketches.items():
        shared = shared.when((F.col("agent") == agent) & (F.col("__t") == t), _common(F.col("words"), sketch))
    pairs = known.withColumn("may", may).where("size(may) > 0").withColumn("__t", F.explode("may")).withColumn("shared", shared)
    able = pairs.groupBy("agent", "path").agg(F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), "shared"))).alias("may"), F.any_value("looks").alias("looks"), F.any_value("types").alias("types"))
    able = able.select("agent", "path", F.to_json(F.struct("path", "may", "looks", "types")).alias("node"))
    inside = files.select(*KEYS, F.inline("fields")).join(able, ["agent", "path"])
    empty = F.when(F.col("mask") == _BIT["null"], "-").otherwise("+")
    nodes = inside.groupBy(*KEYS).agg(F.to_json(F.array_sort(F.collect_list(F.concat(empty, "node")))).alias("schema"), F.map_from_entries(F.collect_list(F.struct("path", "mask"))).alias("masks"))
    schemas = shared_checkpoint(files.select(*KEYS).join(nodes, KEYS, "left").withColumn("key", F.md5("schema")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for agent, key, schema in zip(pdf["agent"], pdf["key"], pdf["schema"]):
                of = [(s[0], json.loads(s[1:])) for s in json.loads(schema)]
                ours = [Node(x["path"], _shares(x.get("types")), _shares(x.get("looks")), {m["t"]: m.get("shared") for m in x["may"]}, sign == "-") for sign, x in of]
                rows += [(agent, key, t, p) for t, p in flood(ours, targets.get(agent, [])).items()]
            yield pd.DataFrame(rows, columns=["agent", "key", "field_name", "path"])

    one = schemas.where("schema is not null").groupBy("agent", "key").agg(F.any_value("schema").alias("schema"))
    matched = one.select("agent", "key", "schema").mapInPandas(run, "agent string, key string, field_name string, path string")
    asked = schemas.select(*KEYS, "key", "masks", F.explode(_targets_of()).alias("field_name"))
    found = asked.join(matched, ["agent", "key", "field_name"], "left")
    mask = F.try_element_at("masks", F.col("path"))
    types = F.array_join(F.filter(F.array(*[F.when(mask.bitwiseAND(_BIT[t]) > 0, t) for t in TYPES[1:]]), lambda t: t.isNotNull()), "+")
    return found.select(*KEYS, "field_name", "path", F.when(F.col("path").isNotNull(), types).alias("types"))


def changes(found: DataFrame, block: int = 1024) -> DataFrame:
    """Carriers that differ from the preceding file of the archive, with the kind of change.

    Kinds: ``new``, ``gone``, ``moved`` (other key or path), ``retyped``.  A file
    whose carrier holds only nulls says nothing and is passed over.  The file
    before is looked up within blocks of consecutive files and, at the start of
    a block, among the blocks' last files, so that one archive may hold any
    number of files.
    """
    said = found.where("path is null or types != ''").withColumns({
        "carrier": F.coalesce(F.concat_ws(" ", "path", "types"), F.lit("")),
        "block": F.floor(F.col("file_seq") / block),
    })
    said = said.withColumn("state", F.struct("carrier", "path", "types"))
    inside = Window.partitionBy("archive_id", "agent", "field_name", "block").orderBy("file_seq", "file_name")
    over = Window.partitionBy("archive_id", "agent", "field_name").orderBy("block")
    last = said.groupBy("archive_id", "agent", "field_name", "block").agg(F.max_by("state", F.struct("file_seq", "file_name")).alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(over)).drop("last")
    seen = said.withColumn("prev", F.lag("state").over(inside)).join(carried, ["archive_id", "agent", "field_name", "block"])
    seen = seen.withColumn("prev", F.coalesce("prev", "carried")).where(F.col("prev").isNotNull() & (F.col("prev.carrier") != F.col("carrier")))
    kind = F.when(F.col("path").isNull(), "gone").when(F.col("prev.path").isNull(), "new").when(F.col("path") != F.col("prev.path"), "moved").otherwise("retyped")
    return seen.select("archive_id", "agent", "file_seq", "file_name", "field_name", kind.alias("change"), F.col("prev.carrier").alias("before"), F.col("carrier").alias("after"))


_STEP = re.compile(r'\.?(?:("(?:[^"\\]|\\.)*")|([^."\[\]]+))|(\[\])')


def _texts(v: object) -> list[str]:
    """Scalars in a value, as text."""
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif x is not None and not isinstance(x, bool):
            out.append(x)
    return out


def cast(v: object) -> str | None:
    """A carrier's value as text: scalars as written, several numbers joined by dots, else the first text in it."""
    if isinstance(v, (dict, list)):
        texts = _texts(v)
        return ".".join(texts) if texts and all(x.isdigit() for x in texts) else texts[0] if texts else None
    return v if isinstance(v, str) or v is None else str(v).lower()


def at_path(record: object, path: str) -> object:
    """The value at a path; of an array on the way the first item that has one."""
    here = [record]
    for quoted, plain, item in _STEP.findall(path):
        if item:
            here = [y for x in here if isinstance(x, list) for y in x]
        else:
            k = json.loads(quoted) if quoted else plain
            here = [x[k] for x in here if isinstance(x, dict) and k in x]
    return next((x for x in here if x is not None), None)


def column_of(name: str) -> str:
    return re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)


def consistent_table(lines: DataFrame) -> DataFrame:
    """Every line as one row of one schema: the followed fields cast to text (null where a line lacks them), and ``fields``.

    ``fields`` holds the line's other fields by their name at the top, scalars as
    they are written and the nested as JSON; a carrier, or the field that holds
    it, is left out of it.  Lines of unreadable text, and lines that are no
    object, are kept with nulls.
    """
    found = carriers(lines).where("path is not null")
    at = found.groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "path"))).alias("__at"))  # one entry a followed field
    rows = lines.select("raw_id", "archive_id", "agent", "file_seq", "file_name", "line_no", "raw_json").join(at, "file_name", "left")
    names = list(NAMES)
    kind = T.StructType([*[T.StructField(column_of(n), T.StringType()) for n in names], T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])

    @F.pandas_udf(kind)
    def read(text: pd.Series, where: pd.Series) -> pd.DataFrame:
        out = []
        for s, paths_ in zip(text, where):
            paths_ = dict(paths_ or {})
            try:
                v = deep_json.loads(s)
                written = deep_json.loads(s, as_written=True) if paths_ else None
            except (ValueError, TypeError):
                v = None
            if not isinstance(v, dict):
                out.append([None] * (len(names) + 1))
                continue
            first = {_STEP.match(p) for p in paths_.values()}
            held = {json.loads(m[1]) if m[1] else m[2] for m in first if m}
            rest = {k: x if isinstance(x, str) or x is None else deep_json.dumps(x) for k, x in v.items() if k not in held}
            out.append([*[cast(at_path(written, paths_[n])) if n in paths_ else None for n in names], rest])
        return pd.DataFrame(out, columns=kind.names, dtype=object)

    done = rows.withColumn("__read", read("raw_json", "__at"))
    return done.select("raw_id", "archive_id", "agent", "file_seq", "file_name", "line_no", "__read.*")
