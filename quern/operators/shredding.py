"""Nested records as flat tables (problem 5).

A record is shredded into one column per leaf path, with a repetition and a
definition level for each entry, as columnar formats store nested data.  Tables
per repeated ancestor are rebuilt from the level sequences: repetition levels
tell at which array a new element began, which gives every entry the indexes of
the elements around it; definition levels tell how much of its path is there.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from quern.functions import deep_json

ITEM = 0  # path step into an array; all other steps are field names
Path = tuple[Any, ...]
Column = list[tuple[int, int, Any]]  # (repetition level, definition level, value)


class Node:
    """Schema of the values at one path: whether scalars occur, fields in order of first occurrence, and array items.

    ``depth`` counts the steps from the record to here, ``arrays`` those into
    arrays.  Nothing here or below calls itself: a record may be nested to any
    depth.
    """

    __slots__ = ("arrays", "depth", "fields", "item", "leaf", "parent", "pos", "step")

    def __init__(self, parent: Node | None = None, step: Any = None) -> None:
        self.parent, self.step = parent, step
        self.depth = parent.depth + 1 if parent else 0
        self.arrays = (parent.arrays if parent else 0) + (parent is not None and step == ITEM)
        self.pos = len(parent.fields) if parent else 0
        self.leaf, self.item = False, None
        self.fields: dict[str, Node] = {}

    def add(self, value: Any) -> None:
        todo = [(self, value)]
        while todo:
            n, v = todo.pop()
            if isinstance(v, dict) and v:
                for k in v:
                    if k not in n.fields:
                        n.fields[k] = Node(n, k)
                todo.extend((n.fields[k], x) for k, x in reversed(v.items()))
            elif isinstance(v, list) and v:
                n.item = n.item or Node(n, ITEM)
                todo.extend((n.item, x) for x in reversed(v))
            else:
                n.leaf = True  # scalars, null, and empty arrays and objects

    def nodes(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if n.item:
                todo.append(n.item)
            todo.extend(reversed(n.fields.values()))

    def leaves(self) -> Iterator[Node]:
        return (n for n in self.nodes() if n.leaf)

    def path(self) -> Path:
        out, n = [], self
        while n.parent:
            out.append(n.step)
            n = n.parent
        return tuple(reversed(out))


def shred(record: Any, schema: Node | None = None) -> dict[Node, Column]:
    """Columns of a record: leaf -> [(repetition level, definition level, value)].

    The definition level counts the steps of the path that are there; an entry
    holds a value if that is the whole path.  Where one path holds values of
    several shapes, each shape has its own columns.
    """
    if schema is None:
        schema = Node()
        schema.add(record)
    out: dict[Node, Column] = {n: [] for n in schema.leaves()}
    todo = [(schema, True, record, 0, 0)]  # node, whether it is there, value (or how much of the path is there), repetition, arrays around
    while todo:
        n, there, value, rep, arrays = todo.pop()
        if not there:
            for leaf in n.leaves():
                out[leaf].append((rep, value, None))
            continue
        fields, items = isinstance(value, dict) and bool(value), isinstance(value, list) and bool(value)
        if n.leaf:
            out[n].append((rep, n.depth - 1, None) if fields or items else (rep, n.depth, value))
        if n.item:
            if items:
                todo.extend((n.item, True, v, rep if i == 0 else arrays + 1, arrays + 1) for i, v in reversed(list(enumerate(value))))
            else:
                todo.append((n.item, False, n.depth, rep, arrays))
        for k, child in reversed(n.fields.items()):
            todo.append((child, True, value[k], rep, arrays) if fields and k in value else (child, False, n.depth, rep, arrays))
    return out


def entries(leaf: Node, column: Column) -> Iterator[tuple[list[int], int, Any]]:
    """(element indexes, definition level, value) of a column's entries, from the repetition levels.  The list of indexes is one and the same, changed from entry to entry."""
    n = leaf.arrays
    at = [0] * n
    for i, (rep, depth, value) in enumerate(column):
        if i and rep:
            at[rep - 1] += 1
            at[rep:] = [0] * (n - rep)
        yield at, depth, value


def instances(node: Node, column: Column) -> Iterator[int]:
    """For each entry of a column below a node the number of the node's value that it belongs to, -1 where there is none."""
    k = -1
    for rep, depth, _ in column:
        k += rep <= node.arrays and depth >= node.depth
        yield k if depth >= node.depth else -1


def assemble(columns: dict[Node, Column]) -> Any:
    """The record again, from its columns alone."""
    root: list[Any] = [None]
    for leaf, column in columns.items():
        path = leaf.path()
        for at, depth, value in entries(leaf, column):
            if depth != len(path):
                continue
            holder, slot, n = root, 0, 0
            for step in path:
                if step == ITEM:
                    if not isinstance(holder[slot], list):
                        holder[slot] = []
                    holder, slot, n = holder[slot], at[n], n + 1
                    holder.extend([None] * (slot + 1 - len(holder)))
                else:
                    if not isinstance(holder[slot], dict):
                        holder[slot] = {}
                    holder, slot = holder[slot], step
                    holder.setdefault(slot, None)
            holder[slot] = value
    return root[0]


def opened(record: Any) -> Any:
    """The record with every tool call's input that is stored as JSON text replaced by what the text says (in place)."""
    todo = [record]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(x)
        if not isinstance(x, dict):
            continue
        inner = x.get("input") if "tool" in x else None
        while isinstance(inner, str) and inner.lstrip()[:1] in ("{", "[", '"'):
            try:
                inner = x["input"] = deep_json.loads(inner)
            except ValueError:
                break
        todo.extend(x.values())
    return record


def _above(node: Node, step: str | None = None) -> Iterator[Node]:
    """The nodes around that have a field ``tool``, from the inside out; with ``step`` only those that the path leaves by it."""
    while node.parent:
        if "tool" in node.parent.fields and (step is None or node.step == step):
            yield node.parent
        node = node.parent


def _key(node: Node, above: Node | None, at: list[int]) -> tuple[int, ...]:
    """Where a value stands in the one above: places of fields and of array elements on the way."""
    out, n = [], node
    while n.parent and n is not above:
        out.append(at[n.arrays - 1] if n.step == ITEM else n.pos)
        n = n.parent
    return tuple(reversed(out))


Call = tuple[Node, int]


def call_tables(record: Any, path_field: str) -> tuple[list[tuple[int, int, str | None]], list[tuple[int, str]]]:
    """Calls (call_no, parent_no, tool) and files (call_no, path) of a record.

    A call is an object with the field ``tool``.  Calls are numbered from 0, a
    call before those inside it, siblings in array order, and belong to the
    nearest call around them (-1: none).  Files are the distinct non-empty texts
    under ``path_field``, or in an array under it, anywhere in a call's ``input``.
    """
    schema = Node()
    record = opened(record)
    schema.add(record)
    callers = [n for n in schema.nodes() if "tool" in n.fields]
    if not callers:
        return [], []
    columns = shred(record, schema)
    tools: dict[Node, dict[int, str | None]] = {}
    for c in callers:
        has = tools[c] = {}
        t = c.fields["tool"]
        for leaf in t.leaves():
            for k, (_, depth, value) in zip(instances(c, columns[leaf]), columns[leaf]):
                if depth >= t.depth and has.get(k) is None:
                    has[k] = value if leaf is t and isinstance(value, str) else None
    inside: dict[Call | None, list[tuple[tuple[int, ...], Call]]] = defaultdict(list)
    for c in callers:
        leaf = next(c.fields["tool"].leaves())
        column = columns[leaf]
        last, begun = -1, []  # entries at which a call begins
        for i, k in enumerate(instances(c, column)):
            if k > last:
                last = k
                if k in tools[c]:
                    begun.append((i, k))
        holder: dict[int, Call] = {}
        for m in _above(c):
            if len(holder) == len(begun):
                break
            of = list(instances(m, column))
            for i, _ in begun:
                if i not in holder and of[i] in tools[m]:
                    holder[i] = (m, of[i])
        at_begin = dict(begun)
        for i, (at, _, _) in enumerate(entries(leaf, column)):
            if i in at_begin:
                h = holder.get(i)
                inside[h].append((_key(c, h and h[0], at), (c, at_begin[i])))
    number: dict[Call, int] = {}
    calls: list[tuple[int, int, str | None]] = []
    todo = [(-1, one) for _, one in sorted(inside[None], key=lambda x: x[0], reverse=True)]
    while todo:
        around, one = todo.pop()
        no = number[one] = len(calls)
        calls.append((no, around, tools[one[0]][one[1]]))
        todo.extend((no, x) for _, x in sorted(inside.get(one, ()), key=lambda x: x[0], reverse=True))
    files: dict[tuple[int, str], None] = {}
    for leaf, column in columns.items():
        field = leaf
        while field.parent and field.step == ITEM:
            field = field.parent
        if not field.parent or field.step != path_field:
            continue
        left = {i: value for i, (_, depth, value) in enumerate(column) if depth == leaf.depth and isinstance(value, str) and value}
        for m in _above(leaf, "input"):
            if not left:
                break
            of = list(instances(m, column))
            for i in [i for i in left if of[i] in tools[m]]:
                files[number[m, of[i]], left.pop(i)] = None
    return calls, list(files)


def _records(batches: Iterator[pd.DataFrame], fields: dict[str, str]) -> Iterator[tuple[Any, Any, str | None, bool]]:
    """(raw_id, record, the agent's path field, whether the line could be read)."""
    for pdf in batches:
        for raw_id, agent, text in zip(pdf["raw_id"], pdf["agent"], pdf["raw_json"]):
            try:
                yield raw_id, deep_json.loads(text), fields.get(agent), True
            except (ValueError, TypeError):
                yield raw_id, None, None, False


def _batched(rows: Iterator[tuple], names: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


# The field that holds a file's path, by agent.
PATH_FIELDS = {"claude-code": "file_path", "codex": "path"}


def files(lines: DataFrame) -> DataFrame:
    """raw_id, call_no, parent_no, file_path.  ``lines``: raw_id, agent, raw_json; unreadable lines give no rows.

    Null and empty lines, other agents and records without calls give no rows.
    Lines may be nested to any depth.
    """
    names = ["raw_id", "call_no", "parent_no", "file_path"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for raw_id, record, field, _ in _records(batches, PATH_FIELDS):
                if field and record is not None:
                    calls, found = call_tables(record, field)
                    parent = {no: p for no, p, _ in calls}
                    for no, path in found:
                        yield raw_id, no, parent[no], path

        yield from _batched(rows(), names)

    return lines.select("raw_id", "agent", "raw_json").mapInPandas(run, "raw_id bigint, call_no int, parent_no int, file_path string")


def calls(lines: DataFrame) -> DataFrame:
    """raw_id, call_no, parent_no, tool: one row a tool call (``tool`` null where it is no text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for raw_id, record, field, _ in _records(batches, PATH_FIELDS):
                if record is not None:
                    for no, parent, tool in call_tables(record, field or "file_path")[0]:
                        yield raw_id, no, parent, tool

        yield from _batched(rows(), ["raw_id", "call_no", "parent_no", "tool"])

    return lines.select("raw_id", "agent", "raw_json").mapInPandas(run, "raw_id bigint, call_no int, parent_no int, tool string")


def read_lines(lines: DataFrame) -> DataFrame:
    """raw_id, readable, n_calls, n_files: one row a line, the parent of its calls (and they of their files)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for raw_id, record, field, readable in _records(batches, PATH_FIELDS):
                made, found = call_tables(record, field or "file_path") if readable else ([], [])
                yield raw_id, readable, len(made), len(found) if field else 0

        yield from _batched(rows(), ["raw_id", "readable", "n_calls", "n_files"])

    return lines.select("raw_id", "agent", "raw_json").mapInPandas(run, "raw_id bigint, readable boolean, n_calls int, n_files int")


def columns(lines: DataFrame) -> DataFrame:
    """raw_id, path, entry_no, rep, def, value: the shredded columns of every readable line, entry by entry.

    Steps of a path are parted by dots, ``[]`` is a step into an array; values
    are JSON text, null where the entry's path is not wholly there.
    """

    def named(path: Path) -> str:
        return "".join("[]" if s == ITEM and not isinstance(s, str) else f".{s}" for s in path).lstrip(".")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for raw_id, record, _, readable in _records(batches, PATH_FIELDS):
                if readable:
                    for leaf, column in shred(record).items():
                        path = named(leaf.path())
                        for i, (rep, depth, value) in enumerate(column):
                            yield raw_id, path, i, rep, depth, deep_json.dumps(value) if depth == leaf.depth else None

        yield from _batched(rows(), ["raw_id", "path", "entry_no", "rep", "def", "value"])

    return lines.select("raw_id", "agent", "raw_json").mapInPandas(run, "raw_id bigint, path string, entry_no int, rep int, def int, value string")
