"""Secrets: fixed patterns, and dictionary-primed zstandard novelty for strings that no pattern names.

The novelty of a string is the number of bytes that it adds to the compressed size of the code around it, for each of
its characters, when the compressor starts from a dictionary of common identifiers. Names, words and repeated values
are in the dictionary or the surroundings and cost little; random material cannot be told more briefly. A string in a
sensitive context (a credential word shortly before it, on its line or the line above) whose novelty reaches a threshold is reported as `novel`.

All work is per row inside Arrow batches, with no shuffle; offsets are code points of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
SPANS = "array<struct<kind: string, start: int, end: int, novelty: double>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so failing shorter ones need no match
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
CONTEXT_WORDS = (b"secret", b"token", b"passw", b"pwd", b"credential", b"bearer", b"auth", b"private", b"api", b"key", b"signature")
CONTEXT = re.compile(r"(?:secret|token|passw|pwd|credential|bearer|auth|private|api|key|signature)[^\n]{0,40}(?:\n[^\n]{0,40})?\Z", re.I | re.A)

#: Primes the compressor: identifiers, words and values that code repeats and that are no secrets.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 xxxxxxxxxxxxxxxxxxxx "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users?page=1&limit=10 application/json charset=utf-8 "
    "import from return function class public private static final void string integer boolean double float const let var "
    "getElementById addEventListener prototype undefined null true false self this super __init__ __name__ __main__ "
    "username password passwd secret token api_key apikey access_key client_id client_secret authorization bearer credential "
    "environment configuration config settings default example changeme placeholder your-secret-here your_api_key_here "
    "database connection host port user localhost 127.0.0.1 postgres mysql redis mongodb production development staging test "
    "org.apache.spark com.example.project package module version 1.0.0 2024-01-01T00:00:00Z description license repository"
)


class Novelty:
    """Marginal compressed bytes for each character of a string, given its surroundings and the identifiers."""

    def __init__(self, identifiers: str = IDENTIFIERS, around: int = 256, level: int = 3):
        data = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False).compress
        self.around = around

    def __call__(self, text: str, start: int, end: int) -> float:
        context = (text[max(0, start - self.around) : start] + text[end : end + self.around]).encode("utf-8", "replace")
        value = text[start:end].encode("utf-8", "replace")
        more = len(self.compress(context + value)) - len(self.compress(context))
        return max(0, more) / max(1, end - start)


def pattern_spans(text: str, low: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns; low: the text's UTF-8 bytes in lower case."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if b"akia" in low:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    return found


def scan(text: str | None, novelty: Novelty, threshold: float = 0.75) -> list[dict]:
    """All spans of a text by start, then kind. Null and empty texts have none."""
    if not text:
        return []
    low = text.encode("utf-8", "replace").lower()
    found = pattern_spans(text, low)
    if any(w in low for w in CONTEXT_WORDS):
        taken = sorted(found)
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            if CONTEXT.search(text, max(0, s - 100), s) and not any(a < e and s < b for a, b, _ in taken) and novelty(text, s, e) >= threshold:
                found.append((s, e, "novel"))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return [{"kind": k, "start": s, "end": e, "novelty": round(novelty(text, s, e), 4)} for s, e, k in found]


def secret_spans(text: Column, threshold: float = 0.75, identifiers: str = IDENTIFIERS) -> Column:
    """Column of all secret spans of a text column; empty array for null."""

    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty(identifiers)
        for batch in texts:
            yield pd.Series([scan(t, novelty, threshold) for t in batch], dtype=object)

    return spans(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(doc_id, spans): a row for each row of docs, whatever its id; null and empty texts have no spans."""
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col), threshold).alias("spans"))


def joined(spans: str) -> str:
    """SQL for kind:start:end of an array of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the fixed patterns, and all spans with the novel ones."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = [f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in KINDS]
    base = joined("filter(spans, s -> s.kind <> 'novel')")
    return found.selectExpr("doc_id", *count, f"sha2({base}, 256) AS base_sha256", f"{joined('spans')} AS spans", "array_max(transform(spans, s -> s.novelty)) AS top_novelty")
