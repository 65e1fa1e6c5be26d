"""Canonical texts and redaction of nested values against plain Python."""

import datetime
import decimal
import json
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import nested

SCHEMA = """id int, v struct<z: string, `a b`: double, n: decimal(20,6), i: bigint, ok: boolean, day: date, at: timestamp, warnings: array<string>, list: array<string>,
    m: map<string, struct<x: double, y: array<int>>>, evidence: array<struct<evidence_id: string, start_ms: bigint, text: string>>, items: array<struct<predicate: string, subject: struct<type: string, key: string>, knowledge_id: string>>>"""


def number(x):
    d = decimal.Decimal(str(x))
    if d == 0:
        return "0"
    text = format(d.normalize(), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def text_of(s):
    s = unicodedata.normalize("NFC", s)
    if re.match(r"^\d{4}-\d\d-\d\dT", s):
        try:
            t = datetime.datetime.fromisoformat(s.replace("Z", "+00:00"))
        except ValueError:
            return json.dumps(s, ensure_ascii=False)
        if t.tzinfo:
            s = t.astimezone(datetime.UTC).isoformat(timespec="microseconds").replace("+00:00", "Z").replace(".000000Z", "Z")
    return json.dumps(s, ensure_ascii=False)


def canon(v, key=None):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float | decimal.Decimal):
        return number(v)
    if isinstance(v, datetime.datetime):
        return text_of(v.isoformat() + "+00:00")
    if isinstance(v, datetime.date):
        return f'"{v}"'
    if isinstance(v, str):
        return text_of(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canon(x, k)}" for k, x in sorted((unicodedata.normalize("NFC", k), x) for k, x in v.items())) + "}"
    if key in nested.SET_ARRAYS:
        return "[" + ",".join(sorted(map(canon, v))) + "]"
    if key == "evidence":
        v = sorted(v, key=lambda e: (str(e["evidence_id"]), -1 if e["start_ms"] is None else e["start_ms"]))
    if key == "items":
        v = sorted(v, key=lambda e: (str((e["subject"] or {}).get("type", "")), str((e["subject"] or {}).get("key", "")), str(e["predicate"]), str(e["knowledge_id"])))
    return "[" + ",".join(map(canon, v)) + "]"


def value(**changes):
    base = dict.fromkeys("z|a b|n|i|ok|day|at|warnings|list|m|evidence|items".split("|"))
    return base | changes


VALUES = [
    value(),
    value(z="é\ń\"\\\x01\x1f/ ", i=-5, ok=True, day=datetime.date(2024, 2, 29), at=datetime.datetime(2024, 1, 2, 3, 4, 5, 60)),
    value(z="2024-01-02T03:04:05+08:00", list=["2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05", "2024-13-02T03:04:05Z", "é", "b", None, "a"], warnings=["b", "Å", "a", None, "Å", "é", "b"]),
    *[value(**{"a b": x}) for x in (0.0, -0.0, 1.0, 1.5, -2.25, 1e7, 12345678.9, 1e20, 1.25e-7, -3e-10, 100.0, 1e300, 0.001)],
    *[value(n=decimal.Decimal(x)) for x in ("0", "0.000000", "1.500000", "-12.340000", "100", "99999999999999.000001")],
    value(m={"b": {"x": 1.0, "y": [2, 1]}, "a": None, "é": {"x": None, "y": None}, "Z": {"x": 2.50, "y": []}}),
    value(evidence=[{"evidence_id": "b", "start_ms": 1, "text": "x"}, {"evidence_id": "a", "start_ms": 10, "text": "y"}, {"evidence_id": "a", "start_ms": None, "text": "z"}, {"evidence_id": "a", "start_ms": 9, "text": "2"}]),
    value(items=[{"predicate": "p", "subject": {"type": "T", "key": "2"}, "knowledge_id": "k"}, {"predicate": "p", "subject": None, "knowledge_id": "k"}, {"predicate": None, "subject": {"type": "T", "key": "1"}, "knowledge_id": None}]),
]


def test_canonical_texts(spark):
    df = nested.normal_form(spark.createDataFrame(list(enumerate(VALUES)), SCHEMA), "v")
    got = {r.id: r.t for r in df.select("id", nested.canonical(F.col("v"), df.schema["v"].dataType).alias("t")).collect()}
    for i, v in enumerate(VALUES):
        assert got[i] == canon(v)


def test_equal_digests_for_other_spellings(spark):
    a = value(z="Å", n=decimal.Decimal("1.5"), warnings=["x", "y"], evidence=[{"evidence_id": "a", "start_ms": 1, "text": None}, {"evidence_id": "b", "start_ms": 1, "text": None}], list=["p", "q"])
    b = value(z="Å", n=decimal.Decimal("1.500"), warnings=["y", "x"], evidence=a["evidence"][::-1], list=["p", "q"])
    c = value(**(a | {"list": ["q", "p"]}))
    found = {r.id: r.h for r in nested.digest(spark.createDataFrame([(1, a), (2, b), (3, c), (4, None)], SCHEMA), "v", "h").collect()}
    assert found[1] == found[2] != found[3] and found[4] == "sha256:" + __import__("hashlib").sha256(b"null").hexdigest()


def test_no_text(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (None,)], "x double").select(F.struct("x").alias("s"))
    assert [r.t for r in df.select(nested.canonical(F.col("s"), df.schema["s"].dataType).alias("t")).collect()] == [None, None, '{"x":1}', '{"x":null}']
    for kind in ("timestamp_ntz", "map<int, int>", "binary"):
        with pytest.raises(ValueError):
            nested.canonical(F.col("x"), spark.createDataFrame([], f"x {kind}").schema["x"].dataType)
    with pytest.raises(ValueError):
        nested.canonical(F.col("x"), spark.createDataFrame([], "x struct<`é`: int, `é`: int>").schema["x"].dataType)


def test_redaction_at_any_depth(spark):
    kind = "struct<apiKey: struct<a: int>, fencing_token: int, deep: array<struct<note: string, sessions: map<string, array<struct<password: string, url: string>>>>>, m: map<string, int>>"
    row = {"apiKey": {"a": 1}, "fencing_token": 7, "deep": [{"note": "token=abc&x", "sessions": {"k": [{"password": None, "url": "https://h/p?q#f"}, None], "my secret": [{"password": "p", "url": "u"}]}}, None], "m": {"cookie": 1, "Fencing_Token": 2, "n": 3}}
    df = spark.createDataFrame([(row,), (None,)], f"v {kind}")
    clean, of = nested.redacted(F.col("v"), df.schema["v"].dataType)
    got = df.select(clean.alias("v"))
    assert got.schema["v"].dataType.simpleString() == of.simpleString()
    one, none = (r.v and r.v.asDict(recursive=True) for r in got.collect())
    hidden = nested.REDACTED
    assert none is None and one == {"apiKey": hidden, "fencing_token": 7, "deep": [{"note": "token=<redacted>&x", "sessions": {"k": [{"password": hidden, "url": "https://h/p"}, None], "my secret": None}}, None], "m": {"cookie": None, "Fencing_Token": 2, "n": 3}}


def test_arrays_are_made_once(spark):
    """However deep arrays are nested, each text of an inner value is made once."""
    kind = spark.createDataFrame([], "v array<array<array<array<int>>>>").schema["v"].dataType
    made = nested.canonical(F.col("v"), kind)._jc.toString()
    assert made.count("array_join") == 4


def test_texts_of_json_in_normal_form():
    """Whole texts and single literals get the same normal form, but for letters of escapes, which stay."""
    texts = ['["e\u0301", "\\"2\\" e\u0301"]', '["\\n\u0301"]', '["a\\u000b\u0301"]', '""', None]
    assert list(nested._normalised.func(pd.Series(texts))) == ['["\u00e9", "\\"2\\" \u00e9"]', '["\\n\u0301"]', '["a\\u000b\u0301"]', '""', None]
