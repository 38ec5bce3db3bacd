"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

1. Base spans by fixed patterns (email, ip, card, phone) always stay.
2. Generators propose further, overlapping candidates: obfuscated addresses, local phone
   numbers, national identity numbers, bank accounts, hardware and IPv6 addresses, long
   numbers.
3. Gradient boosted trees score each candidate from its format (lengths, groups, checksums)
   and its context (words before it, what touches it, digits around).
4. Per kind the smallest threshold is taken that keeps ``PRECISION`` on held-out examples;
   of overlapping accepted candidates the best scored stays.

No table labels personal data, so the trees are fitted to examples that ``examples``
generates from the formats with a fixed seed: real-looking values in and out of fitting
contexts against order numbers, versions, hashes, dates and decimals. They are fitted once
on the driver (some thousand rows) and sent with the tasks.

Defined results: a null text is an empty one and an empty one has no spans; texts of any length
are searched whole, and no candidate depends on text beyond its context (40 code points
before it, 20 after); spans are in code points, end exclusive; repeated rows have equal
results; an empty table gives an empty one; columns named like the results are replaced, all
others stay.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .boosting import BoostedTrees
from .shared import need

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("email_obfuscated", "phone_local", "ssn", "iban", "mac", "ipv6", "number")
PRECISION = 0.99

Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The lookbehind changes no match (one can only begin where a run of digits does), but
# keeps long runs of digits from being tried at each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def emails(text: str) -> list[Span]:
    """The matches of the email pattern, found from each @ to both sides."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def part_ok(part: str) -> bool:
    """Whether it is at most 255, without making a number of any length."""
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Sorted by kind as listed, then start."""
    found = emails(text)
    if not DIGIT.search(text):
        return found
    if text.count(".") >= 3:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(part_ok(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


AT = re.compile(r"\(at\)|\[at\]|\{at\}", re.I)
HOST = re.compile(r"\x20?[\w-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z]{2,}+)+", re.I)
#: Kind, pattern, and characters of which every match has one.
GENERATORS = (
    ("phone_local", re.compile(r"(?<![\w.-])(?:\([0-9]{2,5}\)[\x20-]?|0?[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])", re.A), DIGIT),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.A), DIGIT),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.A), DIGIT),
    ("mac", re.compile(r"(?<![\w:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:-])", re.A), re.compile("[:-]")),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])", re.A), re.compile(":")),
    ("number", re.compile(r"(?<![\w.,-])[0-9]{7,19}(?![\w.,-]*[0-9])", re.A), DIGIT),
)


def obfuscated(text: str) -> list[Span]:
    """Addresses such as ``jo (at) host [dot] org``, of any length, found from each (at) to both sides."""
    found, done = [], 0
    for at in AT.finditer(text):
        end = at.start() - (text[at.start() - 1 : at.start()] == " ")
        start = end
        while start > done and (text[start - 1] in LOCAL or text[start - 1].isalnum()):
            start -= 1
        if start < end and (host := HOST.match(text, at.end())):
            found.append(("email_obfuscated", start, host.end()))
            done = host.end()
    return found


def candidates(text: str) -> list[Span]:
    found = obfuscated(text) if AT.search(text) else []
    return found + [(kind, *m.span()) for kind, pattern, needs in GENERATORS if needs.search(text) for m in pattern.finditer(text)]


CONTEXT = {
    "email": ("mail", "contact", "reach", "write", "kontakt", "correo", "courriel"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "whatsapp", "telefon", "sms"),
    "ssn": ("ssn", "social", "security", "national", "tax", "insurance"),
    "bank": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte"),
    "device": ("mac", "ip", "address", "host", "device", "server", "interface"),
    "other": ("order", "invoice", "version", "build", "sku", "isbn", "ref", "ticket", "issue", "page", "commit", "serial"),
}


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    value = text[start:end]
    digits = [c for c in value if c.isdigit()]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20]
    words = set(re.findall(r"[a-z]+", before))
    near = [sum(w in words for w in names) for names in CONTEXT.values()]
    steps = {int(b) - int(a) for a, b in zip(digits, digits[1:], strict=False)} if digits and all(c in "0123456789" for c in digits) else set()
    return [
        *[float(kind == k) for k in EXTRA],
        len(value), len(digits), len(digits) / len(value), len(set(digits)), float(len(steps) <= 1),
        sum(not c.isalnum() for c in value), sum(c.isupper() for c in value),
        float(kind == "iban" and iban_valid(value)), float(bool(digits) and all(c in "0123456789" for c in digits) and luhn("".join(digits))),
        *near, float(before[-1:].isalnum()), float(before[-2:-1] in (":", "=") or before[-1:] in (":", "=")), float(after[:1].isalnum()),
        sum(c.isdigit() for c in before) / 40, sum(c.isdigit() for c in after) / 20, float(before[-1:] in "#$%€£/_"),
    ]


def _check_iban(country: str, body: str) -> str:
    rest = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{country}{rest:02d}{body}"


def examples(n: int, seed: int) -> tuple[list[tuple[str, Span]], np.ndarray]:
    """``n`` generated (text, candidate) and whether it is personal data."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    cue = lambda kind: rng.choice(CONTEXT[kind])
    made = {
        "email_obfuscated": (lambda: f"{word()}{rng.choice([' ', ''])}{rng.choice(['(at)', '[at]'])} {word()}{rng.choice(['.', ' [dot] '])}{rng.choice(['com', 'org', 'net'])}", "email"),
        "phone_local": (lambda: rng.choice([f"({some(3)}) {some(3)}-{some(4)}", f"{some(3)}-{some(3)}-{some(4)}", f"{some(3)} {some(3)} {some(4)}"]), "phone"),
        "ssn": (lambda: f"{some(3)}-{some(2)}-{some(4)}", "ssn"),
        "iban": (lambda: _check_iban(rng.choice(["DE", "FR", "ES", "GB"]), some(18)), "bank"),
        "mac": (lambda: ":".join(hexes(2) for _ in range(6)), "device"),
        "ipv6": (lambda: ":".join(hexes(4) for _ in range(8)), "device"),
        "number": (lambda: some(rng.randint(8, 12)), "phone"),
    }
    found, labels = [], []
    while len(found) < n:
        kind = rng.choice(EXTRA)
        make, context = made[kind]
        true = rng.random() < 0.5
        value = make()
        if true:
            lead = f"{prose(rng.randint(0, 4))} {cue(context)}{rng.choice([': ', ' ', ' is ', '='])}"
        elif kind == "iban" and rng.random() < 0.7:
            lead, value = f"{prose(3)} ", rng.choice(["DE", "FR", "AB"]) + some(18)
        else:
            lead = rng.choice([f"{prose(3)} {cue('other')} ", f"{prose(4)} ", f"{some(4)} {some(6)} ", f"{prose(2)} #", f"{prose(2)} = "])
            value = rng.choice([value, "0" * 7 + some(2) if kind == "number" else value])
        text = f"{lead}{value}{rng.choice(['.', ' ', ', '])}{prose(rng.randint(0, 3)) if true or rng.random() < 0.6 else some(5)}"
        spans = [s for s in candidates(text) if s[0] == kind and s[1] >= len(lead) - 1]
        if spans:
            found.append((text, spans[0]))
            labels.append(true)
    return found, np.array(labels, float)


@functools.cache
def model() -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and a threshold for each kind."""
    train, y = examples(3000, 11)
    trees = BoostedTrees(rounds=60, depth=4, rate=0.2).fit(np.array([features(*e) for e in train]), y)
    held, truth = examples(2000, 12)
    score = trees.predict(np.array([features(*e) for e in held]))
    limits = {}
    for kind in EXTRA:
        own = np.array([s[0] == kind for _, s in held])
        order = np.argsort(-score[own], kind="stable")
        ranked, right = score[own][order], np.cumsum(truth[own][order])
        good = np.flatnonzero(right / np.arange(1, len(right) + 1) >= PRECISION)
        limits[kind] = max(0.5, float(ranked[good[-1]])) if len(good) else 2.0
    return trees, limits


def added_spans(text: str, base: list[Span], trees: BoostedTrees, limits: dict[str, float]) -> list[Span]:
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = [0, *accumulate((b for _, b in taken), max)]  # the farthest end of the spans before each
    free = [s for s in candidates(text) if reach[bisect_left(starts, s[2])] <= s[1]]
    if not free:
        return []
    scores = trees.predict(np.array([features(text, s) for s in free]))
    kept: list[Span] = []
    begins, ends = [], []  # of the kept spans, in order: they don't overlap, so only the last that begins before can
    for score, span in sorted(zip(scores.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][1], x[1][0])):
        if score >= limits[span[0]]:
            at = bisect_left(begins, span[2])
            if not at or ends[at - 1] <= span[1]:
                kept.append(span)
                begins.insert(at, span[1])
                ends.insert(at, span[2])
    return kept


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str | None, trees: BoostedTrees, limits: dict[str, float]) -> dict:
    text = text or ""
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, *EXTRA))}
    spans = sorted(base + added_spans(text, base, trees, limits), key=lambda s: (order[s[0]], s[1], s[2]))
    counts = Counter(k for k, _, _ in base)
    return {f"n_{k}": counts[k] for k in KINDS} | {"base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(spans)}


def redact(text: str | None, spans: str) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    text, out, at = text or "", [], 0
    for kind, a, b in sorted((s.split(":") for s in spans.split(",") if s), key=lambda s: (int(s[1]), -int(s[2]))):
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_email, n_ip, n_card, n_phone, base_sha256, spans and redacted (text)."""
    need(docs, text_col)
    names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "redacted"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    columns = [f.name for f in kept]
    added = [T.StructField(n, T.LongType() if n.startswith("n_") else T.StringType()) for n in names]
    trees, limits = model()

    def run(frames):
        for pdf in frames:
            rows = [scan(t, trees, limits) for t in pdf[text_col]]
            new = pd.DataFrame(rows, columns=names[:-1], index=pdf.index)
            new["redacted"] = [redact(t, r["spans"]) for t, r in zip(pdf[text_col], rows, strict=True)]
            yield pd.concat([pdf[columns], new], axis=1)

    return docs.mapInPandas(run, T.StructType([*kept, *added]))


def op10_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs).drop("text", "redacted")
