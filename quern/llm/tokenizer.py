"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

The merges are compiled into a finite-state transducer over bytes that is made
deterministic lazily: a state is built when a text first leads to it and kept
for all later texts.  It rests on two properties of BPE with ranked merges:

* a sequence of tokens is the encoding of its bytes exactly if every two
  neighbours are the encoding of their own bytes;
* so the last token of each prefix is determined by the tokens that end there
  and the last tokens of the prefixes before them.

A state is therefore the last tokens of the most recent prefixes, as many as the
longest token has bytes.  A token is emitted as soon as the paths back from all
those prefixes run through it: after bounded lookahead, whatever the text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how byte_bpe_50k splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ids of a vocabulary file's contents: a token in base64 and its id a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return read_ranks(f.read())


class LazyTransducer:
    """Byte-level BPE as a transducer, states made on demand.

    ``max_states`` bounds the memory for states: a table that is full starts
    anew, which costs time but changes no result.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.width = max(map(len, ranks))
        self.max_states = max_states
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # state: (bytes still needed, last tokens of the prefixes that end in them); transitions by byte
        self._number: dict[tuple[bytes, tuple[int, ...]], int] = {(b"", ()): 0}
        self._state: list[tuple[bytes, tuple[int, ...]]] = [(b"", ())]
        self._step: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._final: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition: merge the pair of lowest rank, the leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, a: int, b: int) -> bool:
        ok = self._pairs.get((a, b))
        if ok is None:
            ok = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _is_own(self, t: int) -> bool:
        ok = self._whole.get(t)
        if ok is None:
            ok = self._whole[t] = self.merge(self.bytes_of[t]) == [t]
        return ok

    def _last(self, text: bytes, last: tuple[int, ...], at_start: bool) -> int:
        """Last token of the encoding of a prefix: ``text`` are its last bytes, ``last`` the last tokens at each of them but the newest."""
        n = len(text)
        for size in range(min(n, self.width), 0, -1):
            t = self.ranks.get(text[n - size :])
            if t is None:
                continue
            before = n - size - 1
            if before < 0:
                if before == -1 and at_start and self._is_own(t):
                    return t
                continue
            if self._is_own(t) and self._fits(last[before], t):
                return t
        raise ValueError("the vocabulary lacks single bytes")

    def _advance(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        text, last = self._state[number]
        text += bytes((byte,))
        # What was emitted ends at the start of ``text``, so its first token may rest on it (the pair was settled then).
        last = (*last, self._last(text, last, True))
        out: tuple[int, ...] = ()
        if len(text) > self.width:
            # paths back from every prefix that a later token can follow; their common part is settled
            n = len(text)
            common: list[int] | None = None
            for end in range(n - self.width, n):
                path, at = [], end
                while at >= 0:
                    path.append(last[at])
                    at -= len(self.bytes_of[last[at]])
                path.reverse()
                if common is None:
                    common = path
                else:
                    k = 0
                    while k < min(len(common), len(path)) and common[k] == path[k]:
                        k += 1
                    common = common[:k]
                if not common:
                    break
            # The last settled token stays, for the next one must fit it.
            if common and len(common) > 1:
                out = tuple(common[:-1])
                cut = sum(len(self.bytes_of[t]) for t in out)
                text, last = text[cut:], last[cut:]
        key = (text, last)
        to = self._number.get(key)
        if to is None:
            to = self._number[key] = len(self._state)
            self._state.append(key)
            self._step.append({})
        self._step[number][byte] = (to, out)
        return to, out

    def encode_bytes(self, data: bytes) -> list[int]:
        out: list[int] = []
        if len(self._state) > self.max_states:
            self._reset()
        at = 0
        for b in data:
            step = self._step[at].get(b)
            if step is None:
                step = self._advance(at, b)
            at = step[0]
            if step[1]:
                out.extend(step[1])
        tail = self._final.get(at)
        if tail is None:
            text, last = self._state[at]
            path, i = [], len(text) - 1
            while i >= 0:
                path.append(last[i])
                i -= len(self.bytes_of[last[i]])
            tail = self._final[at] = tuple(reversed(path))
        out.extend(tail)
        return out


class Utf8Decoder:
    """Incremental UTF-8: feed bytes in any pieces, get text; wrong bytes become U+FFFD, an unfinished end waits."""

    def __init__(self) -> None:
        self._held = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self._held + data
        keep = 0 if final else self._unfinished(data)
        self._held = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC2:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                if need <= back:
                    return 0
                rest = data[len(data) - back :]
                try:
                    rest.decode("utf-8")
                except UnicodeDecodeError as e:
                    return back if e.reason == "unexpected end of data" else 0
                return 0
        return 0


class Encoder:
    """Texts to ids and back.  Pieces seen before are answered from a memo of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, memo: int = 300_000, memo_piece: int = 64) -> None:
        self.fst = LazyTransducer(ranks)
        self.split = regex.compile(pattern).findall
        self._memo: dict[str, list[int]] = {}
        self._size, self._piece = memo, memo_piece

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for an empty and for a null text.  A lone surrogate counts as U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        memo = self._memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.fst.encode_bytes(piece.encode("utf-8", "replace"))
                if len(piece) <= self._piece:
                    if len(memo) >= self._size:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece, never cutting a character."""
        utf8 = Utf8Decoder()
        for i in ids:
            yield utf8.feed(self.fst.bytes_of[i])
        yield utf8.feed(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, data: bytes | None = None) -> Encoder:
    """The encoder of a vocabulary file (or of its contents), one a process, so that its states serve all batches of an executor's worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path) if data is None else read_ranks(data))
    return _encoders[path]


def _shipped(documents: DataFrame, path: str) -> Broadcast:
    """The vocabulary file's contents, read where the job is planned: no executor needs the file (a public vocabulary has a megabyte or two)."""
    with open(path, "rb") as f:
        return documents.sparkSession.sparkContext.broadcast(f.read())


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, name)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids: one row a document; empty and null texts have the empty list."""
    path = path or vocabulary()
    data = _shipped(documents, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, data.value)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [enc.encode(t) for t in pdf[text]]})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``documents`` without its text, with ``n_tokens``; 0 for empty and null texts."""
    path = path or vocabulary()
    keep = [c for c in documents.columns if c != text]
    data = _shipped(documents, path)
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, data.value)
        for pdf in batches:
            yield pdf[keep].assign(n_tokens=[len(enc.encode(t)) for t in pdf[text]])

    return documents.select(*keep, text).mapInPandas(run, f"{schema}, n_tokens bigint")


def token_totals(counted: DataFrame, by: str) -> DataFrame:
    return counted.groupBy(by).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("documents"))
