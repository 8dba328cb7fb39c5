"""Text cut off by field limits or in transfer (problem 2).

Intact values are cut artificially to make positives, and a logistic regression
over hashed features of the closing characters, the punctuation and the length
against the limits of the row's collector is trained on both; every row is then
scored.  What the features rest on is counted over all rows:

* the limits: lengths at which different texts of a collector that nothing
  closes pile up;
* which tokens and pairs of tokens end lines, and which go on (hashed counts);
* which runs of letters are whole words (hashed counts).

Only the regression is fitted on a sample (``sample``: about that many rows).
Null, empty and blank texts are no case: they are neither trained on nor scored.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import shared_checkpoint

TABLE_BITS, FEATURE_BITS = 18, 18
_T, _D = (1 << TABLE_BITS) - 1, (1 << FEATURE_BITS) - 1
# A sign that something was left out, at the very end; it may itself be incomplete.
_SAYS_CUT = re.compile(r"cut|trunc|snip|omit|clip|more|abbrev", re.I)
_IN_MARK = re.compile(r"[\w .+…-]*+")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"(?=[a-f]*\d)[0-9a-f]{12,}")
_JOINED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:_[^\W\d_]++)+")
_LETTERS = re.compile(r"[^\W\d_]+")
_CLOSING = ".!?:;。！？`)]}\"'”’»…"
_ENDS = tuple(".!?:;。！？`")


def _mark(text: str) -> str:
    """The closing mark of a text with the blank before it, '' if it has none: dots, or what stands in brackets, or behind an open one, and speaks of cutting."""
    end = text.rstrip("])>}")
    at = max(end.rfind(c) for c in "[(<{")
    if at >= 0 and _SAYS_CUT.search(end, at + 1) and _IN_MARK.fullmatch(end[at + 1 :].lstrip()):
        head = text[:at].rstrip("[(<{").removesuffix("...")
    elif text.endswith("…"):
        head = text[:-1]
    elif text.endswith("..."):
        head = text[:-3]
    else:
        return ""
    if head[-1:].isspace():
        head = head[:-1]
    return text[len(head) :]


def _without_tail(s: str) -> int:
    """Where the run of letters at the end of a text begins."""
    j = len(s)
    while j and s[j - 1].isalpha():
        j -= 1
    return j


def _hash(s: str) -> int:
    """A hash of the text that all workers share."""
    h = 2166136261
    for c in s:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h ^ (h >> 15)


_skeletons: dict[str, str] = {}


def skeleton(token: str) -> str:
    """A token with what varies freely taken out: digits, names with underscores, and paths up to their extension."""
    got = _skeletons.get(token)
    if got is None:
        s = _DIGITS.sub("9", token) if not _HEX.fullmatch(token) else "H"
        if "/" in s:
            head, _, ext = s.rpartition(".")
            tail = re.sub(r"[^\W_]+", "a", ext) if len(ext.split(":")[0]) > 6 else ext
            s = ("P." + tail) if head and "/" in head and "/" not in ext else "P"
        else:
            s = _JOINED.sub("w_w", s)
        got = s if len(s) <= 24 else s[:8] + "~" + s[-12:]
        if len(_skeletons) >= 200_000:
            _skeletons.clear()
        if len(token) <= 256:  # longer ones are worked out again each time
            _skeletons[token] = got
    return got


@dataclass
class Counts:
    """What is counted over all rows; tables of fixed size."""

    ends: np.ndarray = field(default_factory=lambda: np.zeros(_T + 1, np.float32))
    goes_on: np.ndarray = field(default_factory=lambda: np.zeros(_T + 1, np.float32))
    words: np.ndarray = field(default_factory=lambda: np.zeros(_T + 1, np.float32))
    lines: float = 0.0
    texts: float = 0.0
    limits: dict[str, list[tuple[str, int, float]]] = field(default_factory=dict)


def _end_grams(line: str) -> tuple[int, int]:
    """Hashes of the last token of a line, and of its last two."""
    head, _, end = line.rpartition(" ")
    s = skeleton(end)
    before = skeleton(head[head.rfind(" ") + 1 :]) if _ else "^"
    return _gram("1" + s), _gram(before + "\x01" + s)


_grams: dict[str, int] = {}


def _gram(s: str) -> int:
    got = _grams.get(s)
    if got is None:
        if len(_grams) >= 400_000:
            _grams.clear()
        got = _grams[s] = _hash(s) & _T
    return got


def count(rows: DataFrame) -> Counts:
    """All counts, in one pass over the texts.  ``rows``: collector, text.

    Lengths are counted in different texts (a sketch of 5 % error), so that a
    text that is said again and again makes no pile.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {k: np.zeros(_T + 1) for k in ("ends", "goes_on", "words")}
        lines = texts = 0
        ends, goes_on, words = tables.values()
        single: Counter = Counter()  # skeletons that go on
        pair: Counter = Counter()
        last: Counter = Counter()  # (skeleton before, skeleton) at a line's end
        token: Counter = Counter()  # tokens, those at a line's end without their last run of letters

        def spend() -> None:
            for s, n in single.items():
                goes_on[_gram("1" + s)] += n
            for (p, s), n in pair.items():
                goes_on[_gram(p + "\x01" + s)] += n
            for (p, s), n in last.items():
                ends[_gram("1" + s)] += n
                ends[_gram(p + "\x01" + s)] += n
            for t, n in token.items():
                for w in _LETTERS.findall(t):
                    words[_gram("w" + w.lower())] += n
            for c in (single, pair, last, token):
                c.clear()

        for pdf in batches:
            stops: set[tuple[str, str, int, int]] = set()
            for who, text in zip(pdf["collector"], pdf["text"]):
                if not text or text.isspace():
                    continue
                who = who or ""
                texts += 1
                mark = _mark(text)
                core = text[: len(text) - len(mark)]
                if core[-1:] not in _ENDS:
                    data = text.encode("utf-8", "replace")
                    h = zlib.crc32(data)
                    if mark:
                        stops.add((who, "core", len(core), h))
                    else:
                        stops.add((who, "chars", len(text), h))
                        stops.add((who, "bytes", len(data), h))
                for line in text.split("\n"):
                    if line:
                        lines += 1
                        toks = line.split(" ")
                        skels = [skeleton(t) for t in toks]
                        last[skels[-2] if len(skels) > 1 else "^", skels[-1]] += 1
                        if len(skels) > 1:
                            single.update(skels[:-1])
                            pair.update(zip(("^", *skels), skels[:-1]))
                            token.update(toks[:-1])
                        token[toks[-1][: _without_tail(toks[-1])]] += 1
            if len(token) + len(pair) > 200_000:
                spend()
            if stops:
                yield pd.DataFrame(list(stops), columns=["who", "kind", "at", "h"]).assign(n=0.0)
        spend()
        for k, t in tables.items():
            at = np.flatnonzero(t)
            if len(at):
                yield pd.DataFrame({"kind": k, "who": "", "at": at, "n": t[at], "h": 0})
        yield pd.DataFrame({"kind": ["lines", "texts"], "who": "", "at": 0, "n": [float(lines), float(texts)], "h": 0})

    found = rows.select("collector", "text").mapInPandas(run, "kind string, who string, at bigint, n double, h bigint")
    length = F.col("kind").isin("chars", "bytes", "core")
    counted = found.groupBy("kind", "who", "at").agg(F.when(F.first(length), F.approx_count_distinct("h")).otherwise(F.sum("n")).cast("double").alias("n"))
    counted = shared_checkpoint(counted)
    out = Counts()
    # at most 3 tables of 2**18 counts
    table = counted.where(~length).select("kind", "at", "n").toArrow().to_pandas()
    for k, part in table.groupby("kind"):
        if k in ("lines", "texts"):
            setattr(out, k, float(part["n"].sum()))
        else:
            getattr(out, k)[part["at"].to_numpy(np.int64)] = part["n"].to_numpy()
    for r in limits(counted.where(length)).collect():
        out.limits.setdefault(r.who, []).append((r.kind, int(r.at), float(r.piled)))
    return out


def limits(lengths: DataFrame, least: int = 5, share: float = 5e-4, times: float = 8.0) -> DataFrame:
    """Lengths at which values of a collector pile up: who, kind, at, piled (how many times the usual).

    ``lengths``: who, kind (chars, bytes: of texts without a closing mark; core:
    of marked texts without the mark), at, n (different texts of that length
    that nothing closes).  A length is a limit if ``least`` texts stop there,
    ``share`` of all (of the few that end in a mark: a tenth), and ``times`` as
    many as at the lengths up to 20 away on average.  Every such length counts.
    A group has one row a length.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        at, n = pdf["at"].to_numpy(), pdf["n"].to_numpy()
        upto = np.concatenate([[0.0], np.cumsum(n)])
        near = upto[np.searchsorted(at, at + 20, "right")] - upto[np.searchsorted(at, at - 20)] - n
        piled = n / np.maximum(near / (20 + np.minimum(at - 1, 20)), 0.3)
        of_all = 0.1 if pdf["kind"].iloc[0] == "core" else share
        hit = (n >= max(least, of_all * upto[-1])) & (piled >= times)
        return pd.DataFrame({"who": pdf["who"].iloc[0], "kind": pdf["kind"].iloc[0], "at": at[hit], "piled": piled[hit]})

    return lengths.groupBy("who", "kind").applyInPandas(run, "who string, kind string, at bigint, piled double")


def _level(x: float) -> int:
    return max(-4, min(5, round(math.log2(x)))) if x > 0 else -5


_features: dict[str, int] = {}


def _feature(name: str) -> int:
    got = _features.get(name)
    if got is None:
        if len(_features) >= 400_000:
            _features.clear()
        got = _features[name] = _hash(name) & _D
    return got


class Features:
    """Hashed features of a text's end."""

    def __init__(self, counts: Counts) -> None:
        self.c = counts
        self.per_line = 100_000.0 / max(counts.lines, 1.0)

    def at_limit(self, who: str, text: str, core: str) -> str:
        """How far the text is from the nearest limit of its collector below which it stays ('-': none near)."""
        return self._nearest(who, text, core)[0]

    def _nearest(self, who: str, text: str, core: str) -> tuple[str, float]:
        best, piled = 9, 1.0
        n_bytes = None
        for kind, at, times in self.c.limits.get(who, ()):
            if kind == "bytes":
                if len(core) != len(text):
                    continue
                if n_bytes is None:
                    n_bytes = len(text) if text.isascii() else len(text.encode("utf-8", "replace"))
                d = at - n_bytes
                ok = 0 <= d <= 3
            else:
                d = at - (len(core) if kind == "core" else len(text))
                ok = 0 <= d <= 1 and (kind == "core") == (len(core) != len(text))
            if ok and d < best:
                best, piled = d, times
        return (str(best), piled) if best < 9 else ("-", 1.0)

    def offset(self, who: str, text: str) -> float:
        """What the pile-up at a limit adds to the logit of a text that stops there without a closing character.

        Of the values of just that length, all but the usual number were cut.
        """
        if who not in self.c.limits:
            return 0.0
        core = text[: len(text) - len(_mark(text))]
        near, piled = self._nearest(who, text, core)
        return min(math.log(piled), 4.0) if near == "0" and core[-1:] not in _ENDS else 0.0

    def __call__(self, who: str, role: str, text: str, own: float = 0.0, limit: str | None = None) -> list[int]:
        c = self.c
        mark = _mark(text)
        core = text[: len(text) - len(mark)]
        sign = mark.strip()[:3]
        limit = self.at_limit(who, text, core) if limit is None else limit
        fences = core.count("```")
        line = core[core.rfind("\n") + 1 :]
        whole = text[text.rfind("\n") + 1 :]
        tail = core[-1:] or " "
        kind = "9" if tail.isdigit() else "a" if tail.islower() else "A" if tail.isalpha() else tail
        shape = "".join("9" if x.isdigit() else "a" if x.isalpha() else x for x in core[-3:])
        g1, g2 = _end_grams(whole)
        e1, e2 = max(c.ends[g1] - own, 0.0), max(c.ends[g2] - own, 0.0)
        i1, i2 = c.goes_on[g1], c.goes_on[g2]
        r1, r2 = _level((e1 + 0.3) / (i1 + 0.3)), _level((e2 + 0.3) / (i2 + 0.3))
        k1, k2 = _level(self.per_line * (e1 + i1)), _level(self.per_line * (e2 + i2))
        run = line[_without_tail(line) :]
        word = _level(self.per_line * float(c.words[_gram("w" + run.lower())])) if run else 9
        inside = "code" if fences % 2 else "text"
        closed = "y" if tail in _CLOSING else "n"
        multi = "m" if "\n" in text else "s"
        opened = "".join(q for q, o in (("`", line.count("`") % 2), ("(", line.count("(") - line.count(")")), ("“", line.count("“") - line.count("”")), ('"', line.count('"') % 2)) if o > 0)
        n_words = min(line.count(" "), 6)
        prose = "p" if ". " in core or n_words >= 5 else "q"
        names = [
            f"c{kind}", f"s{shape}", f"i{inside}{closed}", f"rk{role}{kind}", f"r1{r1}", f"r2{r2}", f"r{r1},{r2}", f"k1{k1}", f"k2{k2}",
            f"rr{role}{r2},{min(k2, 0)}", f"w{word}", f"wk{word}{closed}{role}", f"o{opened}", f"n{n_words}{role}{closed}", f"p{prose}{role}{closed}",
            f"m{sign}", f"mr{sign}{r2}", f"L{limit}", f"Lc{limit}{closed}", f"Lr{limit}{r2}", f"Lm{limit}{bool(mark)}", f"x{multi}{role}{closed}{r2}", f"io{inside}{r2}",
            f"e{core[-6:] if not tail.isalnum() else ''}", "b",
        ]
        tail_ids = [(g1 * 31 + 17) & _D, (g2 * 37 + 29) & _D, (g2 * 41 + ord(role) * 7919) & _D]  # the end itself
        return [_feature(x) for x in names] + tail_ids


# What a cut may leave at the end, as shares of the artificial cuts.
_LEFT_BEHIND = [("", 0.62), ("…", 0.04), ("...", 0.04), ("...[cut]", 0.04), (" [output truncated]", 0.04), (" (trunc", 0.04), ("<snip", 0.04), ("�", 0.04), ("\\", 0.05), ("\\u00", 0.05)]


def cut(text: str, rng: random.Random) -> str:
    """The text (of two characters or more) cut at a random place, with what such cuts leave behind."""
    at = rng.randrange(max(1, len(text) // 8), len(text))
    left = rng.choices([a for a, _ in _LEFT_BEHIND], [b for _, b in _LEFT_BEHIND])[0]
    return text[:at] + left


class Regression:
    """Logistic regression over sparse binary features, by AdaGrad in a fixed order."""

    def __init__(self) -> None:
        self.w = np.zeros(_D + 1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.15, l2: float = 1e-6, batch: int = 256) -> None:
        # only features that occur have weights to learn
        known, x = np.unique(x, return_inverse=True)
        x = x.reshape(len(y), -1)
        w, g2 = self.w[known], np.full(len(known), 1e-3)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                b = order[s : s + batch]
                p = 1 / (1 + np.exp(-w[x[b]].sum(1)))
                err = np.repeat((p - y[b])[:, None], x.shape[1], 1)
                g = np.bincount(x[b].ravel(), err.ravel(), len(known)) / len(b)
                at = np.flatnonzero(g)
                step = g[at] + l2 * w[at]
                g2[at] += step**2
                w[at] -= rate * step / np.sqrt(g2[at])
        self.w[known] = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w[x].sum(1)


def plain_role(role: str | None) -> str:
    r = (role or "").strip().lower().replace("_", "").replace("-", "").replace(" ", "")
    return {"human": "u", "user": "u", "ai": "a", "assistant": "a", "toolcall": "c", "toolresult": "r"}.get(r, "o")


def train(sampled: pd.DataFrame, counts: Counts, seed: int = 11) -> tuple[Regression, dict[str, float]]:
    """A regression from sampled rows (collector, role, text) and its held-out figures.

    Rows at a limit without a closing character are no intact values and left
    out; after a first fit so are those it takes for cut.
    """
    rng = random.Random(seed)
    f = Features(counts)
    neg, pos, keys = [], [], []
    sampled = sampled[(sampled["text"].str.len() > 0) & ~sampled["text"].str.isspace().astype(bool)]

    def stops(who: str, text: str) -> bool:
        core = text[: len(text) - len(_mark(text))]
        return f.at_limit(who, text, core) != "-" and core[-1:] not in _ENDS

    limited = [bool(counts.limits.get(who or "")) and stops(who or "", text) for who, text in zip(sampled["collector"], sampled["text"])]
    usable = sum(bool(counts.limits.get(who or "")) for who in sampled["collector"])
    # as many artificial cuts at a limit as there are values that look so: whole values of just that length exist too
    at_limit_share = sum(limited) / max(usable, 1)
    for who, role, text, at in zip(sampled["collector"], sampled["role"], sampled["text"], limited):
        if at:
            continue
        who, role = who or "", plain_role(role)
        neg.append(f(who, role, text, 1.0))
        # a text of one character has no part: it is only an intact value
        pos.append(f(who, role, cut(text, rng), 0.0, "0" if counts.limits.get(who) and rng.random() < at_limit_share else "-") if len(text) > 1 else None)
        keys.append(rng.random() < 0.2)
    if not neg:
        return Regression(), {"rows": 0}
    a, held = np.array(neg), np.array(keys)
    cuts = np.array([p is not None for p in pos])
    b, held_b = np.array([p for p in pos if p is not None]).reshape(-1, a.shape[1]), held[cuts]
    model = Regression()
    for again in range(2):
        keep = ~held if not again else ~held & (model.logit(a) < 1.0)
        x, y = np.concatenate([a[keep], b[~held_b]]), np.concatenate([np.zeros(keep.sum()), np.ones((~held_b).sum())])
        model = Regression()
        model.fit(x, y)
    ta, tb = model.logit(a[held]), model.logit(b[held_b])
    return model, {"rows": len(a), "held_out_recall": float((tb > 0).mean()) if len(tb) else 0.0, "held_out_flagged_intact": float((ta > 0).mean()) if len(ta) else 0.0}


def fit(rows: DataFrame, sample: int = 60_000, counts: Counts | None = None) -> tuple[Counts, Regression, dict[str, float]]:
    """``rows``: row_id, collector, role, text.  The sample is drawn by a hash of row_id."""
    counts = counts or count(rows)
    texts = rows.where("text is not null")
    share = min(1.0, sample / counts.texts) if counts.texts else 1.0
    drawn = texts.where(F.pmod(F.xxhash64("row_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else texts
    model, figures = train(drawn.select("row_id", "collector", "role", "text").toPandas().sort_values("row_id"), counts)
    return counts, model, figures


def score(rows: DataFrame, counts: Counts, model: Regression) -> DataFrame:
    """row_id, collector, logit of every row with a text; null, empty and blank texts give no row."""
    shared = rows.sparkSession.sparkContext.broadcast((counts, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, m = shared.value
        f = Features(c)
        for pdf in batches:
            pdf = pdf[~pdf["text"].str.isspace().astype(bool)]
            x = [f(who or "", plain_role(role), text, 1.0) for who, role, text in zip(pdf["collector"], pdf["role"], pdf["text"])]
            if x:
                more = np.array([f.offset(who or "", text) for who, text in zip(pdf["collector"], pdf["text"])])
                yield pd.DataFrame({"row_id": pdf["row_id"], "collector": pdf["collector"], "logit": m.logit(np.array(x)) + more})

    return rows.where("text is not null and text != ''").select("row_id", "collector", "role", "text").mapInPandas(run, "row_id bigint, collector string, logit double")


# A row is cut from this logit on: the artificial sample holds as many cut as whole values, logs hold few.
THRESHOLD = 2.0


def cut_rows(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("logit") >= threshold)


def rates(rows: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per collector: rows, rows with a text that is not blank, cut rows and their share of the rows with a text."""
    n = rows.groupBy("collector").agg(F.count("*").alias("n_rows"))
    c = scored.groupBy("collector").agg(F.count("*").alias("with_text"), F.count(F.when(F.col("logit") >= threshold, 1)).alias("cut"))
    c = c.withColumnRenamed("collector", "c")
    out = n.join(c, n["collector"].eqNullSafe(c["c"]), "left").na.fill(0, ["with_text", "cut"])
    return out.select("collector", "n_rows", "with_text", "cut", F.when(F.col("with_text") > 0, F.col("cut") / F.col("with_text")).otherwise(0.0).alias("cut_rate"))
