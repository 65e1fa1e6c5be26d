"""Chinese numerals, financial numbers and canonical text: what Spark's functions cannot say, as Arrow-batched functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SMALL = {"十": 10, "百": 100, "千": 1000}
BIG = {"万": 10_000, "亿": 100_000_000}
AMOUNT = re.compile(r"(?P<n>\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百千万]+(?=亿)|[零〇一二两三四五六七八九十百千]+)\s*(?P<u>%|％|个点|倍|成|亿元|万元|元|亿|万|点)?")
SCALE = {"亿元": 1e8, "万元": 1e4, "亿": 1e8, "万": 1e4, "成": 10.0}
UNITS = {"%": "PERCENT", "％": "PERCENT", "个点": "PERCENT", "成": "PERCENT", "倍": "TIMES", "亿元": "CNY", "万元": "CNY", "元": "CNY", "点": "POINT"}


def chinese_number(text: str | None) -> float | None:
    """Value of a Chinese numeral; a last digit after 十, 百 or 千 without a zero between counts a tenth of that unit.

    A big unit multiplies what stands between it and the big unit before; null for other characters or no numeral.
    """
    if not text or any(c not in DIGITS and c not in SMALL and c not in BIG for c in text):
        return None
    total = 0.0
    for part, big in re.findall(r"([^万亿]*)([万亿]?)", text):
        value, digit, unit = 0, 0, 1
        for c in part:
            if c in SMALL:
                value, digit, unit = value + (digit or 1) * SMALL[c], 0, SMALL[c]
            else:
                digit = DIGITS[c]
                unit = 1 if c == "零" else unit
        last = digit * (1 if big else max(unit // 10, 1))
        total += (value + last) * BIG.get(big, 1)
    return total


def amounts(text: str | None) -> list[dict]:
    """Numbers with a unit, or in Arabic digits, with their spans: value scaled to the unit, unit class, start, end."""
    out = []
    for m in AMOUNT.finditer(text or ""):
        raw, unit = m.group("n"), m.group("u")
        value = float(raw) if raw[0].isdigit() and raw.isascii() else chinese_number(raw)
        if value is None or not unit and not raw.isascii():
            continue
        out.append({"value": round(value * SCALE.get(unit or "", 1.0), 6), "unit": UNITS.get(unit or "", "NUMBER"), "start": m.start(), "end": m.end()})
    return out


def chinese_numbers(text: Column) -> Column:
    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        return texts.map(chinese_number).astype("float64")

    return value(text)


def amounts_of(text: Column) -> Column:
    @F.pandas_udf("array<struct<value: double, unit: string, start: int, end: int>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(amounts)

    return found(text)


def nfc(text: Column) -> Column:
    """Unicode normal form C, so that equal texts hash alike."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return normal(text)


def gestalt(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts (Ratcliff and Obershelp)."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(a=p, b=q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
