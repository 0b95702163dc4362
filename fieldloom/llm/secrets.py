"""Secret scans by assignment-aware lexing.

Beside three base patterns, every line with `=` or `:` is lexed as source or configuration: strings, names, operators. Name-literal pairs
come from `name = "literal"`, `name: literal`, `name: type = literal`, `"name": "literal"`, `export NAME=literal` and calls' keyword
arguments; a literal may also stand alone on the line after an open `=` or `:`. A right side may join literals and earlier names
with `+`. Names keep their constants for the rest of the text, so `a = "..."` with a later `password = a` charges the literal
where it stands. A literal's score is its target name's sensitivity times its own look (length, variety, no placeholder); literals at or above
`THRESHOLD` give spans of kind `literal`, unless a base span holds them. Base spans always stay.

Cost grows with the text's length, whatever it holds: constants share what they are made of and carry what scoring needs, so a name
joined to itself over and over, or built up in thousands of steps, costs a step each.

Offsets count code points, ends are exclusive. Nulls: a null text is empty. Ties: spans with the same start come in the order assign, access,
hex, literal. Equal literals at several places count at each. Repeated rows give equal rows; an empty table gives an empty result. Very
long texts are read whole. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
STRING = {
    '"': re.compile(r'"(?:[^"\\]|\\.)*+"'),
    "'": re.compile(r"'(?:[^'\\]|\\.)*+'"),
    "`": re.compile(r"`[^`]*+`"),
}
LEX = re.compile(r"""(?P<name>[^\W\d][\w.-]*\w|[^\W\d])|(?P<op>:=|=>|==|!=|<=|>=|[=:+])|(?P<bare>[^\s"'`=:+,;(){}\[\]]+)|(?P<quote>["'`])|(?P<other>\S)""")
SEPARATORS = re.compile(r"[\s,;)}\]]*")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]#]+")
#: Fixed weights of words in names.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "private": 0.6, "auth": 0.6, "access": 0.4, "key": 0.5, "signature": 0.5, "bearer": 0.9, "pin": 0.5,
}
#: Fixed values that stand where a secret would.
PLACEHOLDERS = ("changeme", "example", "none", "null", "true", "false", "todo", "dummy", "test")
#: Signs around a value to be filled in.
FILLED_IN = (("<", ">"), ("${", "}"), ("%", "%"))
THRESHOLD = 0.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


@lru_cache(4096)
def name_weight(name: str) -> float:
    """How sensitive a name's words are, 0 to 1."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)
    words = [p.lower() for p in parts]
    words += [a + b for a, b in zip(words, words[1:], strict=False)]
    return min(1.0, sum(SENSITIVE.get(w, 0.0) for w in set(words)))


class Value:
    """A constant: a literal of the text, or two constants joined. `look` needs its ends, length and counts of characters only."""

    __slots__ = ("span", "parts", "n", "head", "tail", "counts", "bits", "digit", "blank", "before", "after", "spaced")
    ENOUGH = 24.0

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple[Value, Value] | None = None):
        self.span, self.parts = span, parts
        if parts:
            a, b = parts
            self.n = a.n + b.n
            self.head, self.tail = (a.head + b.head)[:8], (a.tail + b.tail)[-2:]
            self.counts = a.counts + b.counts if a.counts is not None and b.counts is not None else None
            self.digit, self.blank = a.digit or b.digit, a.blank and b.blank
            self.before = a.before or (a.blank and b.before)
            self.after = b.after or (b.blank and a.after)
            self.spaced = a.spaced or b.spaced or (not a.blank and not b.blank and (a.after or b.before))
        else:
            self.n, self.head, self.tail = len(text), text[:8], text[-2:]
            self.counts = Counter(text)
            self.digit, core = any(map(str.isdigit, self.counts)), text.strip()
            self.blank, self.spaced = not core, " " in core
            self.before, self.after = " " in text[: len(text) - len(text.lstrip())], " " in text[len(text.rstrip()) :]
        # n times the entropy never falls as characters are added, so counts aren't needed once it is enough
        c = self.counts
        self.bits = self.ENOUGH if c is None else 0.0 if len(c) < 2 else -sum(k * math.log2(k / self.n) for k in c.values())
        if self.bits >= self.ENOUGH:
            self.counts, self.bits = None, self.ENOUGH

    def look(self) -> float:
        """How much it looks like a secret, 0 to 1: bits of variety in all, halved without digits; 0 for placeholders and short ones."""
        if self.n < 6 or self.spaced or self.placeholder():
            return 0.0
        return self.bits / self.ENOUGH * (1.0 if self.digit else 0.5)

    def placeholder(self) -> bool:
        head = self.head.lower()
        if head.startswith("your") or self.n <= 8 and head in PLACEHOLDERS or any(head.startswith(a) and self.tail.endswith(b) for a, b in FILLED_IN):
            return True
        return self.counts is not None and set("".join(self.counts).lower()) in ({"x"}, {"*"})

    def literals(self, seen: set[int]) -> list[tuple[int, int]]:
        """The spans it is made of, without those of constants in seen, which then has them."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if id(v) not in seen:
                seen.add(id(v))
                if v.parts:
                    todo += v.parts
                else:
                    out.append(v.span)
        return out


def look(value: str) -> float:
    return Value(value).look()


def lex(line: str, start: int) -> list[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of a line's tokens; a quote without its partner is one by itself."""
    out, at, open_ended = [], 0, set()
    while m := LEX.search(line, at):
        kind = m.lastgroup
        if kind == "quote":
            kind, quote = "other", m[0]
            if quote not in open_ended:
                if whole := STRING[quote].match(line, m.start()):
                    kind, m = "string", whole
                else:  # nor has any later one of this line
                    open_ended.add(quote)
        out.append((kind, m[0], start + m.start(), start + m.end()))
        at = m.end()
    return out


def lines_of(text: str) -> list[tuple[int, str]]:
    """(offset, line) of all lines."""
    lines = text.split("\n")
    return list(zip(accumulate((len(x) + 1 for x in lines), initial=0), lines, strict=False))


def alone(line: str, start: int) -> tuple[str, str, int, int] | None:
    """The string of a line that holds nothing else but separators."""
    at = len(line) - len(line.lstrip())
    m = STRING[line[at]].match(line, at) if line[at : at + 1] in STRING else None
    return ("string", m[0], start + at, start + m.end()) if m and SEPARATORS.fullmatch(line, m.end()) else None


def annotation_end(toks: list[tuple[str, str, int, int]], j: int) -> int:
    """The token after a type annotation that begins at j. Beyond 12 tokens it may hold no names side by side and no commas outside brackets, as prose does."""
    k, depth, typed = j + 1, 0, True
    while k < len(toks) and (toks[k][0] == "name" or toks[k][1] in ("[", "]", "|", "?", "<", ">", ",", "[]", "<>")) and (typed or k < j + 12):
        kind, sign, _, _ = toks[k]
        depth += (sign in ("[", "<")) - (sign in ("]", ">"))
        typed = typed and depth >= 0 and not (kind == "name" and toks[k - 1][0] == "name") and not (sign == "," and not depth)
        k += 1
    return k if k <= j + 12 or typed and not depth else j


def pairs(text: str) -> list[tuple[str, Value]]:
    """(target name, its constant), constants being propagated."""
    known: dict[str, Value] = {}
    out = []
    lines = lines_of(text)
    for number, (start, line) in enumerate(lines):
        if "=" not in line and ":" not in line:
            continue
        toks = lex(line, start)
        if len(toks) > 1 and toks[-1][1] in ("=", ":", ":=", "=>") and number + 1 < len(lines) and (after := alone(lines[number + 1][1], lines[number + 1][0])):
            toks.append(after)
        i = 0
        while i + 2 < len(toks):
            kind, name, _, _ = toks[i]
            if kind not in ("name", "string") or toks[i + 1][1] not in ("=", ":", ":=", "=>"):
                i += 1
                continue
            name = name[1:-1] if kind == "string" else name
            value, j = None, i + 2
            if kind == "name" and toks[i + 1][1] == ":" and toks[j][0] == "name":
                k = annotation_end(toks, j)
                if k + 1 < len(toks) and toks[k][1] == "=":
                    j = k + 1
            first = j
            while j < len(toks):
                k, word, a, b = toks[j]
                if k == "string":
                    one = Value(word[1:-1], (a + 1, b - 1))
                elif k == "name" and word in known:
                    one = known[word]
                elif k in ("name", "bare") and j == first:
                    end = BARE.match(text, a).end()
                    if end < start + len(line) and text[end] == "(":
                        break  # a call
                    value = Value(text[a:end], (a, end))
                    while j + 1 < len(toks) and toks[j + 1][2] < end:
                        j += 1
                    j += 1
                    break
                else:
                    break
                value = Value(parts=(value, one)) if value else one
                if j + 1 < len(toks) and toks[j + 1][1] == "+":
                    j += 2
                    continue
                j += 1
                break
            if value:
                known[name] = value
                out.append((name, value))
            i = max(j, i + 2)
    return out


def secret_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    begins, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    extra, seen = set(), set()
    if "=" in text or ":" in text:
        for name, value in pairs(text):
            if (weight := name_weight(name)) and weight * value.look() >= THRESHOLD:
                for a, b in value.literals(seen):
                    before = bisect_right(begins, a)
                    if not before or reach[before - 1] < b:
                        extra.add(("literal", a, b))
    return base, sorted([*base, *extra], key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")])


@F.arrow_udf(RESULT)
def scan_of(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        base, spans = secret_spans(text)
        n = Counter(k for k, _, _ in base)
        rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    kinds = [pa.int64()] * 3 + [pa.string()] * 2
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.name for f in RESULT.fields])


def secret_scan(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", scan_of("text").alias("r")).select("doc_id", "r.*")
