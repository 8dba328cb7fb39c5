"""Credentials in commands and source code (problem 7).

1. Literals that could be credentials are taken from every text by where they
   stand (after a name, in a URL, behind an option, in a key block) or by their
   form, and indexed over the corpus with the owners they occur at.
2. Literals told by a name alone that a good part of the owners share are
   placeholders and are dropped; those whose form or place leaves no doubt stay,
   however many share them.
3. Every text is scanned again for the confirmed literals, which finds them
   where nothing around tells what they are, and they are redacted in the same
   scan without touching the code around them.

Nothing grows with the corpus on one machine: a literal stands between
characters that are no letters or digits, so its longest word is a word of the
text.  A bit set of fixed size tells which words of a text may be those of
literals, a join on the word brings each text the literals that can be in it,
and an automaton of these settles where they are.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from hashlib import blake2b

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import shared_checkpoint

# Public forms of tokens that name themselves.
FORMS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{40,}", r"glpat-[\w-]{18,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{10,}", r"sk-[A-Za-z0-9][\w-]{18,}", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[\w-]{30,}", r"npm_[A-Za-z0-9]{30,}", r"hf_[A-Za-z0-9]{30,}", r"pypi-[\w-]{30,}", r"dop_v1_[0-9a-f]{40,}",
    r"shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}", r"SG\.[\w-]{12,}\.[\w-]{12,}", r"pat[A-Za-z0-9]{14}\.[0-9a-f]{32,}",
    r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
]
# Words that make a name one of a credential, several languages.
SECRET_WORDS = (
    r"pass(?:word|wd|phrase|code)?|pwd|passwort|kennwort|mot_?de_?passe|contrase(?:n|ñ)a|senha|"
    r"secret|token|api_?key|access_?key|secret_?key|auth_?key|account_?key|encryption_?key|signing_?key|service_?key|"
    r"authorization|auth_?header|credentials?"
)
_NAME = re.compile(rf"(?:^|[_.-])(?:{SECRET_WORDS})$", re.I)
# Names that speak of a credential without holding one.
_NOT_NAME = re.compile(r"(?:^|_)(?:max|num|n|min|public|csrf|next|page)_|(?:field|file|path|url|uri|name|hash|id|count|env|var|type|len|length|ttl|prefix|column|label|policy)s?$", re.I)
# What people write in place of a credential.
_PLACEHOLDER = re.compile(
    r"^(?:change_?-?me.*|replace_?-?me.*|placeholder|example.*|dummy.*|sample.*|todo|tbd|none|null|nil|true|false|undefined|redacted.*|hidden|secret|password|passwd|token|"
    r"test(?:ing)?|foo(?:bar)?|bar|baz|your[-_ ].*|my[-_](?:secret|password|token).*|insert[-_ ].*|enter[-_ ].*|abc123|123456\d*|<.*>|\[.*\]|\{.*\}|%.*%|(.)\1{3,}|[x*.•-]{3,})$",
    re.I,
)
_REFERENCE = re.compile(r"^\$|\$\{|\$\(|\{\{|%\(|#\{|^@|^&|^\*{3}|(?:^|\W)(?:os|process|sys)\.|getenv|environ|vault|secrets?\.|keyring|^file:|^/(?:run|etc|var|home|secrets)/|^arn:")
# Every pattern begins where a run of its characters begins and gives nothing back, so that it reads a text once, however long its parts are.
_PEM_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s:/@\"'`<>]*+:([^\s@\"'`<>/]++)@", re.I)
_SCHEME = re.compile(r"\b(Bearer|Basic|Token)\s+([A-Za-z0-9._~+/=:-]{6,})", re.I)
_FORM = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(FORMS) + r")(?![A-Za-z0-9])")
_OPTIONS = [
    re.compile(r"\bsshpass\s+-p\s*(?P<q>['\"]?)(?P<v>[^\s'\"]++)(?P=q)"),
    re.compile(r"--(?:password|passwd|pass|token|secret|api-?key|auth-token)[= ](?P<q>['\"]?)(?P<v>[^\s'\"]++)(?P=q)"),
    re.compile(r"\b[A-Z]*(?:PASSWORD|PASS|PWD)=(?P<q>['\"]?)(?P<v>[^\s'\"]++)(?P=q)\s+[a-z]"),
    re.compile(r"\bpassword=(?P<q>['\"]?)(?P<v>[^\s'\"&;]++)(?P=q)(?=[\s'\";&]|$)"),
    re.compile(r"[?&](?:access_token|api_?key|apikey|token|key|auth|sig|signature|password|secret|client_secret)=(?P<q>)(?P<v>[^\s&'\"#<>]++)", re.I),
    re.compile(r"(?<![\w-])(?:X-[A-Za-z-]*(?:Key|Token|Secret|Auth)|Private-Token|Api-Key)\s*:\s*(?P<q>)(?P<v>[^\s'\"]++)", re.I),
]
# Options that mean a credential behind a certain command only: the command, what parts commands, the option.
_COMMANDS = [
    (re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b"), re.compile(r"[^\n|;&]++"), re.compile(r"\s-p(?P<q>['\"]?)(?P<v>[^\s'\"=-][^\s'\"]*+)(?P=q)")),
    (re.compile(r"\bredis-cli\b"), re.compile(r"[^\n|;&]++"), re.compile(r"\s-a\s+(?P<q>['\"]?)(?P<v>[^\s'\"]++)(?P=q)")),
    (re.compile(r"\bcurl\b"), re.compile(r"[^\n|;]++"), re.compile(r"\s(?:-u|--user|--proxy-user)[ =]?(?P<q>['\"]?)[^\s:'\"]*+:(?P<v>[^\s'\"]++)(?P=q)")),
]
_ASSIGN = re.compile(
    r"(?<![\w.-])(?P<name>[^\W\d][\w.-]*+)[\"'`]?\]?\s*+(?::\s*+&?(?:'static\s+)?[A-Za-z]\w*+\s*+=|:=|=>|==?|:|>)\s*+"
    r"(?:(?P<q>\"\"\"|'''|[\"'`])(?P<quoted>[^\n]*?)(?P=q)|(?P<bare>[^\s\"'`,;<>(){}\[\]|]++))"
)
_ELEMENT = re.compile(r"<(?P<b>[A-Za-z_][\w.-]*+)(?P<more>[^<>]*+)>(?P<v>[^<>\n]++)</")
_NAMED = re.compile(r"""\b(?:name|key|id)=["']([^"'\n]++)["']""")
_ATTRIBUTE = re.compile(r"""\b(?:name|key|id)=["'](?P<a>[^"'\n]++)["']\s++value=["'](?P<v>[^"'\n]++)["']""")
_WORDS = re.compile(r"^(?:[A-Za-z][a-z]*)?(?:[_ .-](?:[A-Za-z][a-z]*)?)+$|^[A-Z]+(?:_[A-Z]+)+$")

SURE, LIKELY = 2, 1  # told by form or place; told by a name and the look of the value


def _secret_name(name: str) -> bool:
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").lower()
    return bool(_NAME.search(name)) and not _NOT_NAME.search(name)


def _usable(value: str) -> bool:
    return len(value) >= 4 and not _PLACEHOLDER.match(value) and not _REFERENCE.search(value)


def _random_looking(value: str, quoted: bool) -> bool:
    digit, lower, upper = any(c.isdigit() for c in value), any(c.islower() for c in value), any(c.isupper() for c in value)
    if " " in value or len(value) < 6 or _WORDS.match(value):
        return False
    if digit and (lower or upper):
        return True
    if digit and not quoted:
        return False  # a number
    if lower and upper and not re.fullmatch(r"[A-Z]?[a-z]+(?:[A-Z][a-z]+)*", value):
        return True
    return quoted and len(value) >= 8 and (lower or upper)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, certainty) of the literals in a text that may be credentials, none inside another."""
    found: list[tuple[int, int, int]] = []
    at = 0
    while m := _PEM_BEGIN.search(text, at):
        end = _PEM_END.search(text, m.end())
        if not end:
            break
        found.append((m.start(), end.end(), SURE))
        at = end.end()
    for m in _URL.finditer(text):
        if _usable(m[1]):
            found.append((m.start(1), m.end(1), SURE))
    for m in _SCHEME.finditer(text):
        value = m[2].rstrip(".:")
        if not _usable(value):
            continue
        if m[1].lower() == "basic":
            try:
                login = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
            except (binascii.Error, UnicodeDecodeError, ValueError):
                continue
            if ":" not in login or not login.isprintable():
                continue
        elif not _random_looking(value, True) or m[1].lower() == "token":
            continue
        found.append((m.start(2), m.start(2) + len(value), SURE))
    for m in _FORM.finditer(text):
        if "EXAMPLE" not in m[0].upper() and _usable(m[0]):
            found.append((m.start(), m.end(), SURE))
    for p in _OPTIONS:
        for m in p.finditer(text):
            if _usable(m["v"]) and not m["v"].startswith("-"):
                found.append((m.start("v"), m.end("v"), SURE if len(m["v"]) >= 6 else LIKELY))
    for command, part, option in _COMMANDS:
        if command.search(text):
            for segment in part.finditer(text):
                if c := command.search(text, *segment.span()):
                    for m in option.finditer(text, c.end(), segment.end()):
                        if _usable(m["v"]) and not m["v"].startswith("-"):
                            found.append((m.start("v"), m.end("v"), SURE if len(m["v"]) >= 6 else LIKELY))
    for p in (_ELEMENT, _ATTRIBUTE):
        for m in p.finditer(text):
            if p is _ATTRIBUTE:
                name = m["a"]
            elif (n := _NAMED.search(m["more"])) or not m["more"]:
                name = n[1] if n else m["b"]
            else:
                continue
            value, start = m["v"], m.start("v")
            if s := re.match(r"(?:Bearer|Basic|Token)\s+", value, re.I):
                start, value = start + s.end(), value[s.end() :]
            if _secret_name(name) and "://" not in value and _usable(value) and _random_looking(value, True):
                found.append((start, start + len(value), LIKELY))
    for m in _ASSIGN.finditer(text):
        if not _secret_name(m["name"]):
            continue
        quoted = m["quoted"] is not None
        start = m.start("quoted") if quoted else m.start("bare")
        value = m["quoted"] if quoted else m["bare"].rstrip(".")
        if s := re.match(r"(?:Bearer|Basic|Token)\s+", value, re.I):
            start, value = start + s.end(), value[s.end() :]
        if "://" in value or not _usable(value) or not _random_looking(value, quoted):
            continue
        found.append((start, start + len(value), LIKELY))
    return outermost(found)


def outermost(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans without those that lie in another; of equal spans the surest."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(set(found), key=lambda f: (f[0], -f[1], -f[2])):
        if out and s[1] <= out[-1][1]:
            continue
        out.append(s)
    return out


def index(texts: DataFrame) -> DataFrame:
    """literal, sure, owners, places, of_owners: every candidate literal of the corpus and the number of all owners.  ``texts``: src_table, row_id, field_name, owner, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for owner, text in zip(pdf["owner"], pdf["text"]):
                for a, b, sure in candidates(text):
                    got = seen.setdefault((text[a:b], owner or ""), [0, 0])
                    got[0] = max(got[0], sure)
                    got[1] += 1
            if seen:
                yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["literal", "owner", "sure", "n"])

    found = texts.select("owner", "text").mapInPandas(run, "literal string, owner string, sure int, n bigint")
    # a literal that stands everywhere is added up by owner first
    by_owner = found.groupBy("literal", "owner").agg(F.max("sure").alias("sure"), F.sum("n").alias("n"))
    every = texts.agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("of_owners"))  # one row
    return by_owner.groupBy("literal").agg(F.max("sure").alias("sure"), F.count("*").alias("owners"), F.sum("n").alias("places")).crossJoin(F.broadcast(every))


def confirmed(indexed: DataFrame, share: float = 0.05, least: int = 5) -> DataFrame:
    """literal of the credentials: all told by form or place; of those told by a name the ones of at most ``share`` of all owners (or ``least`` owners, where these are more)."""
    few = F.col("owners") <= F.greatest(F.lit(float(least)), F.col("of_owners") * share)
    return indexed.where((F.col("sure") == SURE) | few).select("literal")


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Where confirmed literals stand in a text: as a candidate, or between characters that are no letters or digits."""
    hits = [(end + 1 - n, end + 1) for end, n in automaton.iter(text)]
    if not hits:
        return []
    own = {(a, b) for a, b, _ in candidates(text)}
    edge = lambda a, b: (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    kept = [(a, b, 0) for a, b in hits if (a, b) in own or (b - a >= 6 and edge(a, b))]
    return [(a, b) for a, b, _ in outermost(kept)]


_WORD = re.compile(r"[^\W_]+")
BITS = 1 << 25  # of the set of words that may be literals': 4 MB wherever it goes


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def anchor(literal: str) -> int:
    """Hash of a literal's longest word (the first of equals; the literal itself if it has none)."""
    return word_hash(max(_WORD.findall(literal), key=len, default=literal))


@F.pandas_udf(T.LongType())
def _anchors(literals: pd.Series) -> pd.Series:
    return literals.map(anchor).astype("int64")


def word_set(words: DataFrame) -> bytes:
    """Bit set of the anchors: a few kilobytes to ``BITS`` / 8 bytes, whatever the number of literals."""
    bit = F.pmod("anchor", F.lit(BITS))
    rows = words.select(F.shiftright(bit, 15).alias("bucket"), (bit % 32768).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:  # at most BITS / 32768 rows of 4 KB
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    return bytes(out)


def scan(texts: DataFrame, words: DataFrame) -> DataFrame:
    """src_table, row_id, field_name, redacted, places (start, end, secret_text): every text with a confirmed literal.

    ``words``: literal.  The texts are read once; only those with a word of the
    set move, and each meets the literals that share one of its words.
    """
    keys = ["src_table", "row_id", "field_name"]
    words = shared_checkpoint(words.select("literal", _anchors("literal").alias("anchor")))
    shared = texts.sparkSession.sparkContext.broadcast(word_set(words))

    def doubtful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known = shared.value, {}

        def hashed(word: str) -> int | None:
            got = known.get(word, 0)
            if got == 0:
                h = word_hash(word)
                b = h % BITS
                got = h if bits[b >> 3] >> (b & 7) & 1 else None
                if len(known) >= 400_000:
                    known.clear()
                if len(word) <= 64:
                    known[word] = got
            return got

        for pdf in batches:
            rows = []
            for *key, text in zip(*(pdf[k] for k in keys), pdf["text"]):
                hit = {h for w in set(_WORD.findall(text)) if (h := hashed(w)) is not None}
                # a literal told by its place may have letters right beside it
                for a, b, _ in candidates(text):
                    if (h := hashed(max(_WORD.findall(text, a, b), key=len, default=text[a:b]))) is not None:
                        hit.add(h)
                if hit:
                    rows.append((*key, text, list(hit)))
            yield pd.DataFrame(rows, columns=[*keys, "text", "anchors"])

    of = "src_table string, row_id bigint, field_name string, text string, anchors array<bigint>"
    hit = shared_checkpoint(texts.select(*keys, "text").mapInPandas(doubtful, of).withColumn("no", F.monotonically_increasing_id()))
    # as many literals as a text has words at most
    near = hit.select("no", F.explode("anchors").alias("anchor")).join(words, "anchor").groupBy("no").agg(F.collect_set("literal").alias("literals"))

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            automaton = _automaton(sorted({w for ws in pdf["literals"] for w in ws})) if len(pdf) else None
            rows = []
            for *key, text in zip(*(pdf[k] for k in keys), pdf["text"]):
                at = spans(text, automaton)
                if at:
                    rows.append((*key, replaced(text, at), [{"start": a, "end": b, "secret_text": text[a:b]} for a, b in at]))
            yield pd.DataFrame(rows, columns=[*keys, "redacted", "places"])

    out = "src_table string, row_id bigint, field_name string, redacted string, places array<struct<start: int, `end`: int, secret_text: string>>"
    return hit.drop("anchors").join(near, "no").drop("no").mapInPandas(settled, out)


def replaced(text: str, places: list[tuple[int, int]], by: str = "REDACTED") -> str:
    """The text with the places, which are in order, replaced and nothing else."""
    parts, last = [], 0
    for a, b in places:
        if a >= last:
            parts += [text[last:a], by]
            last = b
    return "".join([*parts, text[last:]])


def find(texts: DataFrame) -> DataFrame:
    """Texts with credentials: src_table, row_id, field_name, redacted, places.

    ``texts``: src_table, row_id, field_name, owner, text; null and empty texts
    hold none.  The answer does not depend on how the work is parted.
    """
    texts = texts.where("text is not null and text != ''")
    return scan(texts, shared_checkpoint(confirmed(index(texts))))
