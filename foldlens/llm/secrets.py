"""Secret scans: base patterns and an assignment-aware lexer.

The lexer reads source and configuration syntax around every assignment sign (``=``,
``:=``, ``:``, ``=>``) and makes pairs of a name and its literal: the name stands to the
left (``conn.password``, ``"api_key"``, ``cfg['token']``), to the right an expression of
string literals, names and bare configuration values joined by ``+`` or, in brackets, side
by side. It goes on over line breaks after the sign, around ``+`` and in brackets. Names of
constants are propagated: a later expression that uses one takes its literal's places,
however many. A literal
is scored by how sensitive its target's name is times how much it looks like a secret
(length, variety, no placeholder); from ``MIN_SCORE`` on each of its places becomes a
span of kind ``literal``, unless a base span covers it already.

Defined results: a null text is an empty one; spans are in code points, end exclusive,
sorted by start, then kind as listed in ``KINDS``, then end; texts of any length are read whole;
repeated rows have equal results; an empty table gives an empty one; columns named like the
results are replaced, all others stay. Texts without any sign of an assignment, an access key
or a long hexadecimal run cost one pass.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import need

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


SIGN = re.compile(r":=|=>|=(?![=>~])|:(?![:/])")
NAME = re.compile(
    r"""(?:(?<![\w$])(?:(?![A-Za-z_$])\w)*+([A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+)(?:\[\s*["']([\w.-]+)["']\s*\])?|["']([A-Za-z_][\w. -]*)["'])(?:\x20*:\x20*[A-Za-z_][\w\[\]]*+)?[\x20\t]*$"""
)
TERM = re.compile(
    r"""(?:(?P<string>[rbuf]{0,2}(?:"(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'|`(?P<tick>[^`\n]*)`))|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?=[\x20\t]*(?:$|[+;,)\n}]))|(?P<bare>[^\s"'`,;(){}\[\]]+))""",
    re.MULTILINE,
)
BLANKS = re.compile(r"[\x20\t]*")
GAP = re.compile(r"(?:[\x20\t\r\n]|\\\r?\n)*")
PLUS = re.compile(r"(?:\+|\.\.)(?=[\s\\(\"'`A-Za-z_$])")
#: What a name never has; it has one colon at most.
BREAK = re.compile(r"""[^\w$.\[\]"'\s:-]|\n""")

#: How sensitive the parts of a name are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0, "signature": 0.5, "auth": 0.6,
}
#: A key is sensitive next to one of these.
KEYED = {"api", "access", "private", "secret", "signing", "encryption", "auth", "client", "account", "master"}
PLACEHOLDER = re.compile(r"^(?:x{3,}|\*+|\.+|-+|<.*>|\$[{(].*|%.*%|\{\{.*|(?:your|my|example|sample|test|dummy|change|insert|placeholder|todo|none|null|true|false|undefined|default).*)$", re.I)
MIN_SCORE = 0.5
MIN_LITERAL = 8


def name_score(name: str) -> float:
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts and KEYED & set(parts):
        best = 1.0
    joined = "".join(parts)
    return max(best, max((s for k, s in SENSITIVE.items() if len(k) >= 6 and joined.endswith(k)), default=0.0))


class Value:
    """What the score needs of a concatenated value, without the value itself.

    Constants that use each other can stand for texts far longer than the document; every
    field here adds up from two values, so that no length has to be given up.
    """

    __slots__ = ("length", "counts", "head", "tail", "lead", "trail", "blank")
    ENDS = 32

    def __init__(self, text: str = ""):
        self.length, self.counts, self.blank = len(text), Counter(text), not text.strip()
        self.head, self.tail = text[: self.ENDS], text[-self.ENDS :]
        self.lead = text[: len(text) - len(text.lstrip())].count(" ")
        self.trail = text[len(text.rstrip()) :].count(" ")

    def add(self, other: Value) -> None:
        """Appends ``other``."""
        spaces = other.counts[" "]
        if self.blank:
            self.lead += other.lead
        self.trail = self.trail + spaces if other.blank else other.trail
        self.head, self.tail = (self.head + other.head)[: self.ENDS], (self.tail + other.tail)[-self.ENDS :]
        self.length += other.length
        self.blank = self.blank and other.blank
        self.counts.update(other.counts)

    def placeholder(self) -> bool:
        """Whether PLACEHOLDER matches: it looks at the ends and at which characters there are."""
        return bool(PLACEHOLDER.match(self.head + "".join(self.counts) + self.tail))

    def score(self) -> float:
        if self.length < MIN_LITERAL or self.placeholder() or not self.blank and self.counts[" "] > self.lead + self.trail:
            return 0.0
        bits = -sum(n / self.length * math.log2(n / self.length) for n in self.counts.values())
        kinds = sum(any(f(c) for c in self.counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in self.counts)
        return min(1.0, bits / 3.0) * (1.0 if kinds >= 2 else 0.6)


class Expression:
    """An expression's own literals (text, start, end) and the constants it uses, in order."""

    __slots__ = ("parts", "_value")

    def __init__(self, *parts: tuple[str, int, int] | Expression):
        self.parts = list(parts)
        self._value: Value | None = None

    def value(self) -> Value:
        """The sum of the parts' values, those of constants first; each is made once, if at all."""
        left = [self]
        while left:
            one = left[-1]
            if one._value is None:
                if first := [p for p in one.parts if isinstance(p, Expression) and p._value is None]:
                    left += first
                    continue
                one._value = Value()
                for p in one.parts:
                    one._value.add(p._value if isinstance(p, Expression) else Value(p[0]))
            left.pop()
        return self._value


class Lexer:
    """Name-literal pairs of one text, with the constants seen so far."""

    def __init__(self, text: str):
        self.text = text
        self.constants: dict[str, Expression] = {}

    def pairs(self):
        """(name, expression) for each assignment."""
        breaks = [m.end() for m in BREAK.finditer(self.text)]
        colons = [m.end() for m in re.finditer(":", self.text)]
        for sign in SIGN.finditer(self.text):
            at = sign.start()
            b, c = bisect_right(breaks, at), bisect_right(colons, at)
            begin = max(breaks[b - 1] if b else 0, colons[c - 2] if c > 1 else 0)
            if not (left := NAME.search(self.text[begin:at])):
                continue
            name = left[2] or left[1] or left[3]
            full = ".".join(x for x in (left[1], left[2], left[3]) if x)
            found = self._expression(sign.end())
            if found.parts:
                self.constants[full] = self.constants[name.rpartition(".")[2]] = found
                yield full, found

    def _term(self, at: int, wrap: bool) -> tuple[re.Match | None, int]:
        """The term after blanks and open brackets, and the brackets' number.

        With ``wrap``, or after a bracket, it may stand on a later line. There only strings
        that are no names themselves and constants count: the rest is a line of its own.
        """
        start, opened = at, 0
        while True:
            after = (GAP if wrap or opened else BLANKS).match(self.text, at).end()
            if self.text[after : after + 1] != "(":
                break
            at, opened = after + 1, opened + 1
        term = TERM.match(self.text, after)
        if term and (opened or "\n" in self.text[start:after]):
            own = term["string"] is not None and not SIGN.match(self.text, BLANKS.match(self.text, term.end()).end())
            if not own and not (term["name"] in self.constants and not SIGN.match(self.text, term.end())):
                term = None
        return term, opened

    def _expression(self, at: int) -> Expression:
        found, depth, wrap = Expression(), 0, True
        while True:
            term, opened = self._term(at, wrap or depth > 0)
            if not term:
                break
            depth += opened
            if term["string"] is not None:
                kind = next(k for k in ("double", "single", "tick") if term[k] is not None)
                found.parts.append((term[kind], *term.span(kind)))
            elif term["name"] is not None and term["name"] in self.constants:
                found.parts.append(self.constants[term["name"]])
            elif not found.parts and (kind := "name" if term["name"] is not None else "bare"):
                return Expression((term[kind], *term.span(kind))) if len(term[kind]) >= MIN_LITERAL else found
            at = term.end()
            while depth and self.text[(after := GAP.match(self.text, at).end()) : after + 1] == ")":
                at, depth = after + 1, depth - 1
            # a line that begins with the sign goes on, too
            if plus := PLUS.match(self.text, GAP.match(self.text, at).end()):
                at, wrap = plus.end(), True
            elif depth and (side := TERM.match(self.text, GAP.match(self.text, at).end())) and side["string"] is not None:
                at, wrap = side.start(), False
            else:
                break
        return found


def literal_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals of sensitive names outside of ``base``, which is sorted by start."""
    found, told = set(), set()
    for name, expression in Lexer(text).pairs():
        if (worth := name_score(name)) and worth * expression.value().score() >= MIN_SCORE:
            left = [expression]
            while left:
                if (one := left.pop()) not in told:
                    told.add(one)
                    left += [p for p in one.parts if isinstance(p, Expression)]
                    found |= {("literal", p[1], p[2]) for p in one.parts if not isinstance(p, Expression) and p[2] > p[1]}
    # base is sorted by start: a span lies within one of those that begin by then if the farthest end reaches it
    starts = [a for _, a, _ in base]
    reach = [0, *accumulate((b for _, _, b in base), max)]
    return [s for s in found if reach[bisect_right(starts, s[1])] < s[2]]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None) -> dict:
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    extra = literal_spans(text, base) if "=" in text or ":" in text else []
    counts = Counter(k for k, _, _ in base)
    return {f"n_{k}": counts[k] for k in KINDS[:3]} | {
        "base_sha256": hashlib.sha256(written(base).encode()).hexdigest(),
        "spans": written(sorted(base + extra, key=order)),
    }


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_assign, n_access, n_hex, base_sha256 and spans."""
    need(docs, text_col)
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in kept]
    added = [T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in names]

    def run(frames):
        for pdf in frames:
            new = pd.DataFrame([scan(t) for t in pdf[text_col]], columns=names, index=pdf.index)
            yield pd.concat([pdf[columns], new], axis=1)

    return docs.mapInPandas(run, T.StructType([*kept, *added]))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs).drop("text")
