"""Text garbled by decoding with a wrong encoding (problem 10).

Every line of a text went through a latent chain: none, or "written in one
encoding, read in another", perhaps twice.  A chain can be undone, so the
likelihood of a line under it is that of the undone line in a character model
of the corpus.  Expectation-maximisation estimates, over the whole corpus, how
often each source uses each chain, and the character model of the text as it was
meant; weak evidence is pooled over a line's words and over a source's records.
Each line is then repaired by its posterior.

The texts are read twice: once for their distinct lines, of which only the words
beyond ASCII are kept and counted, and once to be repaired; all rounds of the
estimation run over the counted lines.  The character model is two tables of
fixed size (hashed character pairs and characters) whatever the corpus holds;
the weights of the chains are a table of one row a source that never leaves the
cluster.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import shared_checkpoint

# Fixed values: (encoding the text was written in, encoding it was read in).  Twice garbled text is tried as pairs of the first.
READ_AS = ["cp1252", "cp1250", "cp1251", "cp437", "mac_roman", "cp850", "koi8_r", "cp866", "iso8859_2", "gbk", "cp932", "big5", "cp949"]
CHAINS: list[tuple[str, str]] = [
    *(("utf_8", r) for r in READ_AS),
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1252"), ("cp866", "cp1251"),
    ("gbk", "cp1252"), ("euc_jp", "cp1252"), ("cp932", "cp1252"), ("big5", "cp1252"), ("cp949", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"),
    ("utf_8 utf_8", "cp1252"), ("utf_8 utf_8", "mac_roman"), ("utf_8 utf_8", "cp437"),
]
MULTIBYTE = {"gbk", "cp932", "big5", "cp949"}
LOST = "�"
PAIR_BITS, CHAR_BITS = 18, 14
_PAIRS, _CHARS = 1 << PAIR_BITS, 1 << CHAR_BITS


def _byte_table(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that the encoding leaves out were read as control characters."""
    out = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(256):
        try:
            out[bytes((b,)).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    if codec == "cp1252":
        out.update({chr(b): b for b in range(0xA0, 0x100)})
    return out


def _leads(codec: str) -> frozenset[str]:
    """Characters that the first byte of a UTF-8 sequence was read as."""
    return frozenset(c for c, b in _byte_table(codec).items() if 0xC2 <= b < 0xF5)


_TABLES: dict[str, dict[str, int]] = {c: _byte_table(c) for c in {r for _, r in CHAINS} - MULTIBYTE}
_LEADS: dict[str, frozenset[str]] = {c: _leads(c) for c in _TABLES}


def _utf8_again(word: str, codec: str) -> str | None:
    """The word with every run of characters that are the bytes of a UTF-8 character put back; None if there is none."""
    if codec in MULTIBYTE:
        try:
            data = word.replace(LOST, "\x00").encode(codec).replace(b"\x00", b"\xff")
        except UnicodeEncodeError:
            return None
        out = data.decode("utf-8", "replace")
        good = sum(c > "\x7f" and c != LOST for c in out)
        return out if good and good > 2 * (out.count(LOST) - word.count(LOST)) else None
    if _LEADS[codec].isdisjoint(word):
        return None
    table = _TABLES[codec]
    out, i, n, changed = [], 0, len(word), False
    while i < n:
        b = table.get(word[i], -1)
        size = 0 if b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 0
        if size and i + size <= n:
            data = [b] + [table.get(c, -1) for c in word[i + 1 : i + size]]
            if all(0x80 <= x < 0xC0 for x in data[1:]):
                try:
                    out.append(bytes(data).decode("utf-8"))
                    i += size
                    changed = True
                    continue
                except UnicodeDecodeError:
                    pass
        out.append(word[i])
        i += 1
    return "".join(out) if changed else None


def undo(word: str, chain: tuple[str, str]) -> str | None:
    """The word as it was before the chain, None if the chain cannot have made it."""
    written, read = chain
    if written == "utf_8":
        return _utf8_again(word, read)
    if written == "utf_8 utf_8":
        once = _utf8_again(word, read)
        return None if once is None else _utf8_again(once, read)
    table = _TABLES[read]
    try:
        data = bytes([table[c] for c in word])
        out = data.decode(written)
    except (KeyError, UnicodeDecodeError):
        return None
    return None if out == word or any(c < " " or "\x7f" <= c < "\xa0" for c in out) else out


_undone: dict[str, list[tuple[int, str]]] = {}


def undone(word: str) -> list[tuple[int, str]]:
    """(chain, word before it) for the chains that can have made the word; a chain's number counts from 1.  Remembered by the worker, for it rests on no model."""
    got = _undone.get(word)
    if got is None:
        got = _undo_all(word)
        if len(word) <= 64:
            if len(_undone) >= 200_000:
                _undone.clear()
            _undone[word] = got
    return got


def _undo_all(word: str) -> list[tuple[int, str]]:
    once = {read: _utf8_again(word, read) for read in READ_AS}
    out = []
    for z, chain in enumerate(CHAINS, 1):
        written, read = chain
        if written == "utf_8":
            u = once[read]
        elif written == "utf_8 utf_8":
            u = once[read] and _utf8_again(once[read], read)
        else:
            u = undo(word, chain)
        if u:
            out.append((z, u))
    return out


def _pair(a: int, b: int) -> int:
    return (a * 1_000_003 ^ b * 8_191 ^ (a << 7)) & (_PAIRS - 1)


def _char(a: int) -> int:
    return (a * 2_654_435_761 >> 8) & (_CHARS - 1)


@dataclass
class Model:
    """Counts of the corpus and the weights of the chains in it (index 0: no chain)."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros(_PAIRS, np.float32))
    chars: np.ndarray = field(default_factory=lambda: np.zeros(_CHARS, np.float32))
    overall: np.ndarray = field(default_factory=lambda: np.array([0.95] + [0.05 / len(CHAINS)] * len(CHAINS)))


class Reader:
    """Scores lines with a model; one a task."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.total = float(model.chars.sum()) or 1.0
        self._words: dict[str, tuple[float, list[tuple[int, str, float]]]] = {}
        self._steps: dict[tuple[str, str], float] = {}

    def likelihood(self, word: str) -> float:
        """Log probability of a word, its ends included."""
        known, s, a = self._steps, 0.0, " "
        for b in (*word, " "):
            step = known.get((a, b))
            if step is None:
                step = self._step(a, b)
            s += step
            a = b
        return s

    def _step(self, a: str, b: str) -> float:
        pairs, chars, strength = self.model.pairs, self.model.chars, 20.0
        x, y = ord(a), ord(b)
        unigram = (float(chars[_char(y)]) + 0.02) / (self.total + 3_000.0)
        got = math.log((float(pairs[_pair(x, y)]) + strength * unigram) / (float(chars[_char(x)]) + strength))
        if len(self._steps) >= 300_000:
            self._steps.clear()
        self._steps[a, b] = got
        return got

    def word(self, w: str) -> tuple[float, list[tuple[int, str, float]]]:
        got = self._words.get(w)
        if got is None:
            got = (self.likelihood(w), [(z, u, self.likelihood(u)) for z, u in undone(w)])
            if len(self._words) >= 200_000:
                self._words.clear()
            self._words[w] = got
        return got

    def evidence(self, words: list[str]) -> np.ndarray | None:
        """Log likelihood of a line under each chain against none, -inf for chains that cannot have made it; None where no chain can."""
        scored = [self.word(w) for w in words]
        if not any(options for _, options in scored):
            return None
        log = np.full(len(CHAINS) + 1, -np.inf)
        log[0] = 0.0
        for own, options in scored:
            for z, _, ll in options:
                log[z] = (0.0 if log[z] == -np.inf else log[z]) + ll - own
        return log

    def prior(self, weights: np.ndarray | None) -> np.ndarray:
        """Log prior of the chains of a source; ``weights``: expected lines by chain, None for a source without any.  A source with few lines leans on the corpus."""
        overall = self.model.overall
        return np.log(overall if weights is None else (np.asarray(weights) + 50 * overall) / (np.sum(weights) + 50))

    @staticmethod
    def posterior(evidence: np.ndarray, prior: np.ndarray) -> np.ndarray:
        log = evidence + prior
        p = np.exp(log - log.max())
        return p / p.sum()

    def pooled(self, lines: list[np.ndarray], prior: np.ndarray) -> int:
        """The chain that a document's lines speak for together, 0 if none; ``lines``: evidence of its distinct lines."""
        if not lines:
            return 0
        of = np.array(lines)
        can = np.isfinite(of)
        p = self.posterior(np.where(can.any(axis=0), np.where(can, of, 0.0).sum(axis=0), -np.inf), prior)
        return int(p.argmax()) if p[0] <= 0.5 else 0


def foreign_words(line: str) -> list[str]:
    """Words with characters beyond ASCII; only the plain blank and tab part words, for a byte may have become another space."""
    return [] if line.isascii() else [w for w in line.replace("\t", " ").split(" ") if not w.isascii()]


def _mentioned(word: str, meant: str) -> bool:
    """A lone letter or quotation mark as a word by itself, and a word in quotation marks that came through whole, is spoken about."""
    bare = word.strip(",.;:!?")
    if len(bare) > 2 and bare[0] in "“‘«„\"'`" and bare[-1] in "”’»“\"'`":
        return True
    core = meant.strip("`'\"()[]{}<>,.;:!?*_")
    return len(core) == 1 and (core.isalpha() or core in "‘’“”«»") or core == ""


def _lossy(word: str) -> bool:
    core = word.strip("`'\"()[]{}<>,.;:!?*_")
    return LOST in core and any(c.isalnum() for c in core)


_FOREIGN = r"[^\x00-\x7F]"


def foreign_lines(documents: DataFrame) -> DataFrame:
    """source, words, n: the distinct lines with words beyond ASCII, of which only these are kept, and how often they stand."""
    line = documents.where(F.col("text").rlike(_FOREIGN)).select("source", F.explode(F.split("text", "\n")).alias("line"))
    words = F.filter(F.split("line", "[ \t]"), lambda w: w.rlike(_FOREIGN))
    return line.select("source", F.array_join(words, " ").alias("words")).where("words != ''").groupBy("source", "words").agg(F.count("*").alias("n"))


def _with_weights(df: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Add ``weights`` of the row's source; Spark decides by the size of the table how it is joined."""
    if weights is None:
        return df.withColumn("weights", F.lit(None).cast("array<double>"))
    w = weights.withColumnRenamed("source", "__source")
    return df.join(w, df["source"].eqNullSafe(w["__source"]), "left").drop("__source")


def _expected(lines: DataFrame, weights: DataFrame | None, model: Model | None) -> DataFrame:
    """kind, source, at, n: expected counts under the model (all lines taken as clean if there is none), added up within tasks.  Kinds: pair, char, chain."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model) if model else None
        pairs, chars = np.zeros(_PAIRS), np.zeros(_CHARS)
        chains: dict[tuple[str | None, int], float] = defaultdict(float)
        words_of: dict[str, float] = defaultdict(float)

        def spend() -> None:
            for word, weight in words_of.items():
                a = 32
                for c in (*word, " "):
                    b = ord(c)
                    pairs[_pair(a, b)] += weight
                    chars[_char(a)] += weight
                    a = b
            words_of.clear()

        for pdf in batches:
            for source, text, n, own in zip(pdf["source"], pdf["words"], pdf["n"], pdf["weights"]):
                words = text.split(" ")
                e = reader.evidence(words) if reader else None
                if e is None:
                    chains[source, 0] += n
                    for w in words:
                        words_of[w] += n
                    continue
                p = reader.posterior(e, reader.prior(own))
                for z in np.flatnonzero(p > 1e-3):
                    chains[source, int(z)] += n * float(p[z])
                    for w in words:
                        words_of[next((u for k, u, _ in reader.word(w)[1] if k == z), w) if z else w] += n * float(p[z])
            if len(words_of) > 200_000:
                spend()
        spend()
        for kind, table in (("pair", pairs), ("char", chars)):
            at = np.flatnonzero(table)
            if len(at):
                yield pd.DataFrame({"kind": kind, "source": None, "at": at, "n": table[at]})
        if chains:
            yield pd.DataFrame({"kind": "chain", "source": [k[0] for k in chains], "at": [k[1] for k in chains], "n": list(chains.values())})

    rows = _with_weights(lines, weights).select("source", "words", "n", "weights")
    return rows.mapInPandas(run, "kind string, source string, at bigint, n double").groupBy("kind", "source", "at").agg(F.sum("n").alias("n"))


def fit(documents: DataFrame, tolerance: float = 1e-3, most: int = 50) -> tuple[Model, DataFrame]:
    """EM over all documents until no chain's weight in the corpus moves by more than ``tolerance``.  ``documents``: source, text.

    Returns the model and the weights of the chains by source (source, weights).
    Each round brings at most 2**18 + 2**14 counts and one weight a chain to the
    driver.  ``most`` rounds are a guard, not the rule: a few settle it.
    """
    lines = shared_checkpoint(foreign_lines(documents))
    model, weights = None, None
    for _ in range(most):
        rows = shared_checkpoint(_expected(lines, weights, model))
        table = rows.where("kind != 'chain'").select("kind", "at", "n").toArrow().to_pandas()
        new = Model()
        for kind, of in table.groupby("kind"):
            (new.pairs if kind == "pair" else new.chars)[of["at"].to_numpy(np.int64)] = of["n"].to_numpy()
        if model is None:
            model = new
            continue
        chain = rows.where("kind = 'chain'")
        overall = np.full(len(CHAINS) + 1, 0.5)
        for r in chain.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row a chain
            overall[r["at"]] += r["n"]
        new.overall = overall / overall.sum()
        by = F.map_from_entries(F.collect_list(F.struct("at", "n")))  # an entry a chain
        weights = chain.groupBy("source").agg(by.alias("m")).select("source", F.transform(F.sequence(F.lit(0), F.lit(len(CHAINS))), lambda z: F.coalesce(F.try_element_at("m", z.cast("bigint")), F.lit(0.0))).alias("weights"))
        moved = np.abs(new.overall - model.overall).max()
        model = new
        if moved <= tolerance:
            break
    return model, weights


def repair(documents: DataFrame, fitted: tuple[Model, DataFrame], threshold: float = 0.5) -> DataFrame:
    """Garbled documents: doc_id, restored, chains, unrepaired.

    ``documents``: doc_id, source, text.  A document is garbled if a line's
    posterior of a chain reaches the threshold, or its lines together speak for a
    chain and the line does not speak against it, and the chain explains more than
    characters that are only spoken about, or if a word holds U+FFFD beside
    letters or digits.  ``restored`` is the text with those lines undone;
    ``chains`` names them ('lost' for U+FFFD); ``unrepaired`` tells that
    characters stay lost.  Null and empty texts are never garbled.
    """
    model, weights = fitted
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for pdf in batches:
            rows = []
            for doc, text, own in zip(pdf["doc_id"], pdf["text"], pdf["weights"]):
                prior, used, out = reader.prior(own), {}, []
                lines = [(line, foreign_words(line)) for line in text.split("\n")]
                told = {line: reader.evidence(words) for line, words in lines if words}  # a line that is repeated speaks once
                whole = reader.pooled([e for e in told.values() if e is not None], prior)
                for line, words in lines:
                    e, z = told.get(line), 0
                    if e is not None:
                        p = reader.posterior(e, prior)
                        z = int(p.argmax()) if 1 - p[0] >= threshold else 0
                        if not z and whole and np.isfinite(e[whole]) and e[whole] > 0:
                            z = whole
                    if z:
                        meant = {w: u for w in words for k, u, _ in reader.word(w)[1] if k == z}
                        telling = [w for w, u in meant.items() if not _mentioned(w, u)]
                        if telling:
                            used["->".join(CHAINS[z - 1])] = None
                            line = " ".join("\t".join(meant.get(x, x) for x in w.split("\t")) for w in line.split(" "))
                    if any(_lossy(w) for w in words):
                        used["lost"] = None
                    out.append(line)
                if used:
                    restored = "\n".join(out)
                    rows.append((doc, restored, ",".join(used), LOST in restored))
            yield pd.DataFrame(rows, columns=["doc_id", "restored", "chains", "unrepaired"])

    read = _with_weights(documents.select("doc_id", "source", "text").where(F.col("text").rlike(_FOREIGN)), weights)
    return read.select("doc_id", "text", "weights").mapInPandas(run, "doc_id bigint, restored string, chains string, unrepaired boolean")
