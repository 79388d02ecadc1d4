"""Personal data by offset-preserving deobfuscation.

A transducer rewrites a text, character by character or token by token, and remembers for every output character which source characters it came
from: homoglyphs become ASCII, zero-width characters go, runs of spelled digits become digits, disguised at and dot signs become @ and '.'.
Identifiers are found in the rewritten text and their spans mapped back to the source. Spans that the plain patterns find in the source itself
always stay; the transducer only adds spans that hold at least one rewritten character and overlap no plain span of their kind.

Every text is a row of its own: no shuffle, memory of one batch. Patterns that would be quadratic on long runs are scanned from their
rare character ('@') or barred from starting inside a run of digits, which gives the same matches.

Defined cases: null text counts as empty: no spans; other columns pass through `redact` unchanged; n_email, n_ip, n_card and n_phone count the plain
spans, n_added the others.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumtide.llm._kit import table

KINDS = ("email", "ip", "card", "phone")
MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

#: Letters of other alphabets that look like ASCII ones (full-width forms and foreign digits follow by rule).
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅοαρνικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ․‐‑−",
    "aeopcyxijsdhqwABEKMHOPCTXIJSoapvikuABEZHIKMNOPTYXig.---",
    strict=True,
))
_ZERO_WIDTH = "​‌‍⁠﻿­"
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DW = "|".join(_DIGIT_WORDS)
_FOREIGN = re.compile("[­ıɡͰ-῿​-‍‐‑․⁠⁰-₉−①-⒛　-￿\U0001d400-\U0001d7ff]")
#: A run of at least four spelled digits, single digits among them, with dots, dashes or spaces between; an optional plus before it.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:plus|\+)[ -]+)?(?:(?:{_DW})(?:(?:[ ,.-]{{1,3}}|[ ]+(?:dot|point|dash)[ ]+)(?:{_DW}|[0-9]{{1,4}})(?![A-Za-z0-9])){{3,}})(?![A-Za-z0-9])", re.I)
_SPELLED_PART = re.compile(rf"plus|dot|point|dash|{_DW}|[0-9]+|[+.]|[ ,-]+", re.I)
_AT = r"(?:\s*[\[({<]\s*(?:at|@|arroba)\s*[\])}>]\s*|\s+(?:at|arroba)\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.|punto|point|punkt)\s*[\])}>]\s*|\s+(?:dot|punto|point|punkt)\s+|\s\.\s|\.)"
_DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}})({_AT})([A-Za-z0-9-]{{1,64}}(?:{_DOT}[A-Za-z0-9-]{{2,64}})+)(?![A-Za-z0-9-])", re.I)
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|dot|\.|punto|point|punkt)\s*[\])}>]", re.I)
_BARE_DOT = re.compile(r"\s(?:dot|punto|point|punkt)\s|\s\.\s", re.I)
_DOT_AT = re.compile(_DOT, re.I)
#: Last labels that make a host name of words joined by a bare "dot": fixed values, and any two letters.
_ENDS = re.compile(r"(?:com|org|net|edu|gov|mil|int|info|biz|name|app|dev|example|test|invalid|local|[a-z]{2})", re.I)
_SPACED_AT = re.compile(r"\s@|@\s")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the plain patterns, leftmost and non-overlapping within a kind; failing matches are dropped, not retried."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Rewritten:
    """A rewritten text with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.a, self.b, self.new = text, None, None, None

    def _start(self):
        if self.a is None:
            n = len(self.text)
            self.a, self.b, self.new = list(range(n)), list(range(1, n + 1)), [False] * n

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, replacement) of the present text, in order. Each output character stands for the whole of its edit's source span."""
        if not edits:
            return
        self._start()
        t, a, b, new, at = [], [], [], [], 0
        for s, e, r in edits:
            t.append(self.text[at:s])
            a += self.a[at:s]
            b += self.b[at:s]
            new += self.new[at:s]
            if r:
                t.append(r)
                a += [self.a[s]] * len(r)
                b += [self.b[e - 1]] * len(r)
                new += [True] * len(r)
            elif a and s > 0:
                new[-1] = True
            at = e
        t.append(self.text[at:])
        self.a, self.b, self.new, self.text = a + self.a[at:], b + self.b[at:], new + self.new[at:], "".join(t)


def _ascii(c: str) -> str | None:
    """The ASCII look-alike of a character, '' for zero-width ones, None to leave it."""
    if c in _ZERO_WIDTH:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and len(plain) == 1 and plain.isascii() and plain.isprintable() else None


def _digits_of(run: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED_PART.finditer(run):
        w = m[0].lower()
        if w in _DIGIT_WORDS:
            out.append((m.start(), m.end(), _DIGIT_WORDS[w]))
        elif w in ("plus", "+"):
            out.append((m.start(), m.end(), "+"))
        elif w in ("dot", "point", "."):
            out.append((m.start(), m.end(), "."))
        elif w[0].isdigit():
            pass
        else:
            out.append((m.start(), m.end(), ""))
    return out


def rewrite(text: str) -> Rewritten | None:
    """The transducer; None where nothing in the text asks for it."""
    low = text.lower()
    foreign = not text.isascii() and _FOREIGN.search(text)
    spelled = any(w in low for w in _DIGIT_WORDS if w != "oh") and _SPELLED.search(text)
    disguised = _BRACKETED.search(text) or _SPACED_AT.search(text) or _BARE_DOT.search(text)
    if not (foreign or spelled or disguised):
        return None
    out = Rewritten(text)
    if foreign:
        out.replace([(m.start(), m.end(), r) for m in _FOREIGN.finditer(text) if (r := _ascii(m[0])) is not None])
    if spelled or foreign and _SPELLED.search(out.text):
        out.replace([(m.start() + s, m.start() + e, r) for m in _SPELLED.finditer(out.text) for s, e, r in _digits_of(m[0])])
    edits = []
    for m in _DISGUISED.finditer(out.text):
        at, domain = m[2], m[3]
        bare = at.strip().lower() in ("at", "arroba")
        dots = [d for d in _DOT_AT.finditer(domain)]
        told = any(d[0] != "." for d in dots)
        if at == "@" and not told and not any(d[0] != "." for d in _DOT_AT.finditer(m[1])) or bare and not told:
            continue  # nothing disguised, or just the word "at" before a host name
        if bare and any(d[0].strip().isalpha() for d in dots) and not _ENDS.fullmatch(domain[dots[-1].end() :]):
            continue  # prose
        start = m.start(1)
        if bare or at.strip() == "@":  # the words before a bare sign may be prose: only the last one is the name
            name = [d for d in _DOT_AT.finditer(m[1]) if d[0].strip() == "." and d[0] != "." or d[0].strip().isalpha()]
            start = m.start(1) + (name[-1].end() if name and bare and len(name) > 1 else 0)
        edits += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in _DOT_AT.finditer(m[1]) if d[0] != "." and m.start(1) + d.start() >= start]
        if at != "@":
            edits.append((m.start(2), m.end(2), "@"))
        edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in dots if d[0] != "."]
    out.replace(edits)
    return out if out.a is not None else None


def _spelled_numbers(out: Rewritten) -> list[tuple[int, int, int]]:
    """Digits that were spelled out, without a plus sign: 9 to 15 make a phone number."""
    got = []
    for m in re.finditer(r"(?<![0-9.+])[0-9]{9,15}(?![0-9.])", out.text):
        if sum(out.new[m.start() : m.end()]) * 2 >= m.end() - m.start() and all(out.b[i] - out.a[i] > 1 for i in range(m.start(), m.end()) if out.new[i]):
            got.append((m.start(), 3, m.end()))
    return got


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = rewrite(text)
    if out is None:
        return []
    found = plain_spans(out.text)
    cards = [(s, e) for s, k, e in found if k == 2]
    found += [x for x in _spelled_numbers(out) if not any(s < x[2] and x[0] < e for s, e in cards)]
    taken = {k: sorted((s, e) for s, kind, e in base if kind == k) for k in range(4)}
    got = []
    for s, k, e in sorted(found):
        if not any(out.new[s:e]):
            continue
        a, b = out.a[s], out.b[e - 1]
        i = bisect_left(taken[k], (a, b))
        if (i == 0 or taken[k][i - 1][1] <= a) and (i == len(taken[k]) or taken[k][i][0] >= b):
            taken[k].insert(i, (a, b))
            got.append((a, k, b))
    return got


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and both digests of every document's spans."""

    def run(it):
        for pdf in it:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text, strict=True):
                text = text or ""
                base = plain_spans(text)
                more = added_spans(text, base)
                n = [0, 0, 0, 0]
                for _, k, _ in base:
                    n[k] += 1
                rows.append((doc, *n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + more) if more else base), len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind's mask; overlapping spans by the mask of the first."""
    if not text:
        return text
    base = plain_spans(text)
    spans = sorted(base + added_spans(text, base))
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], MASKS[k]]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with masks in place of personal data and n_chars, where there is one, made to fit."""

    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(redacted, na_action="ignore")

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find(table(spark, sf_dir, "documents"))
