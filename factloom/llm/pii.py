"""Personal data, also in disguise: transducers normalise a text and keep, for each character, where it came from.

The transducers undo zero-width characters, homoglyphs, bracketed or spoken `at` and `dot`, and digits spelled out in
English, German, French and Spanish. The same detectors run over the plain and the normalised text; a span found only
in the normalised one is mapped back to the source characters that it was made of.

All work is per row inside Arrow batches, with no shuffle; offsets are code points of the whole text, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind: string, start: int, end: int, disguised: boolean>>"

# Runs of digits are taken whole by every pattern, so a match never starts inside one.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost non-overlapping matches of local@label(.label)+, in linear time: every match is found from its @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL_CHARS:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
        # The local run of a later @ cannot reach back over this one, nor into a match.
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all plain spans, by start, then kind."""
    found = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(small, m.groups()))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# Characters that look like ASCII ones, and the words for digits.
HOMOGLYPHS = {
    **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)},
    **dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS", strict=True)),
    **dict(zip("αινορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivoptuxABEZHIKMNOPTYX", strict=True)),
    **{chr(0x660 + d): str(d) for d in range(10)},
    **dict.fromkeys("‐‑‒–—−", "-"),
    **dict.fromkeys("    ", " "),
    "․": ".", "。": ".", "﹒": ".", "﹫": "@",
}
DIGIT_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TABLE = str.maketrans(HOMOGLYPHS)
#: A run of spelled digits holds one of these; `un` alone is an article.
SPOKEN = frozenset(DIGIT_WORDS) - {"un"}
LOOKALIKE = re.compile(f"[{re.escape(''.join(HOMOGLYPHS))}]")
INVISIBLE = re.compile("[­​‌‍⁠﻿]+")
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:plus\s+)?(?:{_WORD})(?:[\s,-]{{1,3}}(?:{_WORD}|[0-9])){{3,}}(?!\w)", re.I)
SPELLED_PART = re.compile(rf"plus\s+|{_WORD}|[0-9]|[\s,-]+", re.I)
_DOT, _OPEN, _SHUT = r"(?:dot|punkt|point|punto)", r"[\[({<]\s?", r"\s?[\])}>]"
_TOP = r"(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us)(?![A-Za-z0-9])"
#: Without brackets, `at` and `dot` only count before a usual top-level domain or, for `dot`, between digits.
AT = re.compile(rf"\s?{_OPEN}(?:at|ät|arroba|@){_SHUT}\s?|(?<=[A-Za-z0-9])\s(?:at|arroba)\s(?=[A-Za-z0-9-]+(?:\s?{_OPEN}{_DOT}{_SHUT}\s?|\s{_DOT}\s|\.){_TOP})", re.I)
DOT = re.compile(rf"\s?{_OPEN}{_DOT}{_SHUT}\s?|(?<=[A-Za-z0-9])\s{_DOT}\s(?={_TOP})|(?<=[0-9])\s{_DOT}\s(?=[0-9])", re.I)


class Traced:
    """A text and, for each of its characters, the first source character and the end of the last one it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, pieces: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        """Replace parts of each match; pieces: (start, end, new text of at most one character), in order."""
        out, starts, ends, last = [], [], [], 0
        for m in pattern.finditer(self.text):
            for s, e, new in pieces(m):
                out += [self.text[last:s], new]
                starts += self.starts[last:s] + [self.starts[s]] * len(new)
                ends += self.ends[last:s] + [self.ends[e - 1]] * len(new)
                last = e
        self.text, self.starts, self.ends = "".join([*out, self.text[last:]]), starts + self.starts[last:], ends + self.ends[last:]


def _spoken(m: re.Match) -> list[tuple[int, int, str]]:
    parts = [(m.start() + p.start(), m.start() + p.end(), p.group().lower()) for p in SPELLED_PART.finditer(m.group())]
    return [(s, e, "+" if w.startswith("plus") else str(DIGIT_WORDS[w]) if w in DIGIT_WORDS else w if w.isdigit() else "") for s, e, w in parts]


def normalise(text: str) -> Traced | None:
    """The text without disguises; None where there is none."""
    plain = text.isascii()
    low = text.lower()
    bracket = any(c in text for c in "[({<")
    steps = []
    if not plain and INVISIBLE.search(text):
        steps.append((INVISIBLE, lambda m: [(*m.span(), "")]))
    lookalike = not plain and LOOKALIKE.search(text)
    if "at" in low and (bracket or " at " in low) or "arroba" in low or lookalike:
        steps.append((AT, lambda m: [(*m.span(), "@")]))
    if any(w in low for w in ("dot", "punkt", "point", "punto")) or lookalike:
        steps.append((DOT, lambda m: [(*m.span(), ".")]))
    if lookalike or not SPOKEN.isdisjoint(low.replace("-", " ").replace(",", " ").split()):
        steps.append((SPELLED, _spoken))
    if not lookalike and not any(p.search(text) for p, _ in steps):
        return None
    traced = Traced(text)
    if lookalike:
        traced.text = traced.text.translate(TABLE)
    for step in steps:
        traced.rewrite(*step)
    return traced


def scan(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind. Null and empty texts have none."""
    if not text:
        return []
    found = [(*x, False) for x in detect(text)]
    traced = normalise(text)
    if traced is not None:
        for s, e, kind in detect(traced.text):
            s, e = traced.starts[s], traced.ends[e - 1]
            if not any(k == kind and a < e and s < b for a, b, k, _ in found):
                found.append((s, e, kind, True))
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [{"kind": k, "start": s, "end": e, "disguised": d} for s, e, k, d in found]


def pii_spans(text: Column) -> Column:
    """Column of all spans of personal data of a text column; empty array for null."""

    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([scan(t) for t in batch], dtype=object)

    return spans(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): a row for each row of docs, whatever its id; null and empty texts have no spans."""
    return docs.select(F.col(id_col).alias("doc_id"), pii_spans(F.col(text_col)).alias("spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain spans, and all spans with the disguised ones."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')".format
    count = [f"CAST(size(filter(spans, s -> s.kind = '{k}' AND NOT s.disguised)) AS BIGINT) AS n_{k}" for k in KINDS]
    base = joined("filter(spans, s -> NOT s.disguised)")
    return found.selectExpr("doc_id", *count, f"sha2({base}, 256) AS base_sha256", f"{joined('spans')} AS spans", "CAST(size(filter(spans, s -> s.disguised)) AS BIGINT) AS n_disguised")
