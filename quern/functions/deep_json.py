"""JSON of any depth: the library's reader, and a reader without recursion where it gives up."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def loads(text: str, as_written: bool = False) -> Any:
    """The value of a JSON text; ValueError if it is none.  ``as_written`` gives numbers as their text."""
    try:
        return json.loads(text, parse_float=str, parse_int=str) if as_written else json.loads(text)
    except RecursionError:
        return _loads(text, as_written)


def _loads(s: str, as_written: bool) -> Any:
    open_: list[tuple[Any, str | None]] = []  # the containers around, each with the key that waits for its value
    skip = lambda i: _BLANK.match(s, i).end()

    def key(i: int) -> tuple[str, int]:
        if s[i : i + 1] != '"':
            raise ValueError(f"no key at {i}")
        k, i = scanstring(s, i + 1)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return k, skip(i + 1)

    i = skip(0)
    while True:
        c = s[i : i + 1]
        if c in ("{", "["):
            value: Any = {} if c == "{" else []
            i = skip(i + 1)
            if s[i : i + 1] != ("}" if c == "{" else "]"):
                k = None
                if c == "{":
                    k, i = key(i)
                open_.append((value, k))
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(s, i + 1)
        elif m := _NUMBER.match(s, i):
            i = m.end()
            value = m[0] if as_written else float(m[0]) if m[2] or m[3] else int(m[0])
        else:
            word = next((w for w in _WORDS if s.startswith(w, i)), None)
            if word is None:
                raise ValueError(f"no value at {i}")
            value, i = _WORDS[word], i + len(word)
        while open_:
            holder, k = open_[-1]
            if k is None:
                holder.append(value)
            else:
                holder[k] = value
            i = skip(i)
            c = s[i : i + 1]
            if c == ",":
                i = skip(i + 1)
                if k is not None:
                    k, i = key(i)
                    open_[-1] = (holder, k)
                break
            if c != ("]" if k is None else "}"):
                raise ValueError(f"neither comma nor end at {i}")
            value, i = open_.pop()[0], i + 1
        else:
            if skip(i) != len(s):
                raise ValueError(f"more text at {i}")
            return value


def dumps(value: Any) -> str:
    """The JSON text of a value, of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]  # (ready text, text or value)
    while todo:
        ready, x = todo.pop()
        if ready:
            out.append(x)
        elif isinstance(x, dict):
            todo.append((True, "}"))
            for n, (k, v) in enumerate(reversed(list(x.items())), 1):
                todo += [(False, v), (True, ("" if n == len(x) else ", ") + json.dumps(k, ensure_ascii=False) + ": ")]
            todo.append((True, "{"))
        elif isinstance(x, list):
            todo.append((True, "]"))
            for n, v in enumerate(reversed(x), 1):
                todo += [(False, v), (True, "" if n == len(x) else ", ")]
            todo.append((True, "["))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)
