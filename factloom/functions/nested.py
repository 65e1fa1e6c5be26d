"""Canonical text and redaction of nested values: one expression is built by walking the schema, however deep it is."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import redacted_credentials

# fixed values: arrays that are sets, and the keys by which two others are ordered
SET_ARRAYS = frozenset({"reason_codes", "warnings", "evidence_refs", "evidence_ids"})
ITEM_ORDER = (("subject", "type"), ("subject", "key"), ("predicate",), ("temporal", "target_start"), ("temporal", "target_end"), ("occurrence_id",))
ITEM_IDS = ("knowledge_id", "claim_id")
EVIDENCE_ORDER = (("evidence_id", ""), ("start_ms", -1), ("end_ms", -1))
# fixed values: keys whose values are secrets, but for the public ones
SENSITIVE_KEY = r"(?i)(?:authorization|cookie|storage[ _-]?state|secret|token|password|api[ _-]?key|signed)"
PUBLIC_KEYS = frozenset({"fencing_token"})
REDACTED = "<redacted>"

#: Options that keep microseconds on the way through JSON.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Texts with any of these may have another normal form; all others are their own (marks, jamo, and what has a canonical twin).
_MAY_CHANGE = r"[\p{M}\u0374\u037E\u0387\u1100-\u11FF\u1F00-\u1FFF\u2000\u2001\u2126\u212A\u212B\u2329\u232A\u2ADC\uF900-\uFAFF\uFB00-\uFB4F\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
#: An escape in JSON before a character that might join with its last letter.
_AFTER_ESCAPE = re.compile(r"\\(?:u[0-9A-Fa-f]{4}|.)[^\x00-\x7f]")
_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)$"
_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _plain(number: Column) -> Column:
    """The digits of a number's text without exponent, trailing zeros or negative zero."""
    def short(text: Column) -> Column:
        cut = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
        return F.when(text.contains("E"), _unscaled(text)).otherwise(F.when(cut == "-0", "0").otherwise(cut))

    return _let(number.cast("string"), short)


def _unscaled(text: Column) -> Column:
    sign, body = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    mantissa, exponent = F.substring_index(body, "E", 1), F.when(body.contains("E"), F.substring_index(body, "E", -1).cast("int")).otherwise(0)
    whole = F.substring_index(mantissa, ".", 1)
    digits, point = F.concat(whole, F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")), F.length(whole) + exponent
    left = F.when(point <= 0, "0").otherwise(F.rpad(F.substr(digits, F.lit(1), F.greatest(point, F.lit(0))), F.greatest(point, F.lit(0)), "0"))
    right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substr(digits, point + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    left = F.regexp_replace(left, "^0+(?=[0-9])", "")
    made = F.concat(left, F.when(right != "", F.concat(F.lit("."), right)).otherwise(""))
    return F.when(made == "0", made).otherwise(F.concat(sign, made))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quoted(text: Column) -> Column:
    def escaped(t: Column) -> Column:
        marked = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        controls = marked
        for i in range(32):
            controls = F.replace(controls, F.lit(chr(i)), F.lit(_ESCAPES.get(chr(i), f"\\u{i:04x}")))
        return F.when(t.rlike(r"[\x00-\x1f]"), controls).otherwise(marked)

    return F.concat(F.lit('"'), _let(text, lambda t: F.when(t.rlike(r'[\x00-\x1f"\\]'), escaped(t)).otherwise(t)), F.lit('"'))


def _utc(instant: Column) -> Column:
    in_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.replace(F.concat(F.date_format(in_utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), F.lit(".000000Z"), F.lit("Z"))


def canonical(value: Column, kind: T.DataType, key: str | None = None) -> Column:
    """The canonical JSON of a value of the type kind: equal for equal values, however they are spelled.

    Keys of structs and maps are in order of code points, numbers plain without trailing zeros (1.50 is 1.5, -0.0 is 0),
    instants in UTC with `Z`, also where a string holds one with its offset. The arrays named in SET_ARRAYS are sorted, `items`
    and `evidence` too (by their keys, in which a null is the word None; equal keys keep their order); all others keep their
    order. Nulls are `null`. A number that isn't finite makes the whole text null. Doubles have the digits that the JVM
    prints. Strings are taken to be in normal form C (see normal_form). Types without a canonical text, such as an instant without
    a zone or a map whose keys are no strings, raise ValueError when the expression is built.
    """
    if isinstance(kind, T.StructType):
        names = sorted(((unicodedata.normalize("NFC", f.name), f) for f in kind.fields), key=lambda n: n[0])
        if len({n for n, _ in names}) < len(names):
            raise ValueError("two keys have the same normal form")
        parts = [F.concat(F.lit(json.dumps(n, ensure_ascii=False) + ":"), canonical(value[f.name], f.dataType, n)) for n, f in names]
        text = F.concat(F.lit("{"), *[p for i, part in enumerate(parts) for p in ([F.lit(",")] if i else []) + [part]], F.lit("}"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise ValueError("keys must be strings")
        text = _listed("{", F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(_quoted(k), F.lit(":"), canonical(value[k], kind.valueType))), "}")
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        if key in SET_ARRAYS:
            made = F.array_sort(F.transform(value, lambda x: canonical(x, element)))
        elif key in ("items", "evidence") and isinstance(element, T.StructType):
            ranked = F.transform(value, lambda x, i: F.struct(*[c.alias(f"k{n}") for n, c in enumerate(_order(x, element, key))], i.alias("i"), canonical(x, element).alias("text")))
            made = F.transform(F.array_sort(ranked), lambda r: r["text"])
        else:
            made = F.transform(value, lambda x: canonical(x, element))
        text = _listed("[", made, "]")
    elif isinstance(kind, T.StringType):
        text = _quoted(_let(value, lambda v: F.when(v.rlike(_INSTANT), F.coalesce(_utc(F.try_to_timestamp(v)), v)).otherwise(v)))
    elif isinstance(kind, T.BooleanType):
        text = value.cast("string")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = F.when(F.abs(value) < float("inf"), _plain(value))
    elif isinstance(kind, T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        text = _plain(value)
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, T.TimestampType):
        text = F.concat(F.lit('"'), _utc(value), F.lit('"'))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise ValueError(f"no canonical text for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(text)


def _listed(opened: str, texts: Column, closed: str) -> Column:
    return _let(texts, lambda made: F.when(~F.exists(made, lambda t: t.isNull()), F.concat(F.lit(opened), F.array_join(made, ","), F.lit(closed))))


def _order(item: Column, kind: T.StructType, key: str) -> list[Column]:
    def at(path: Sequence[str], default: str) -> Column:
        here, inner, empty = item, kind, F.lit(False)
        for name in path:
            if not isinstance(inner, T.StructType) or name not in inner.names:
                return F.lit(default)
            here, inner = here[name], inner[name].dataType
            empty = empty | here.isNull() if name != path[-1] else empty
        return F.when(empty, default).otherwise(F.coalesce(here.cast("string"), F.lit("None")))

    if key == "evidence":
        return [at((n,), d) if isinstance(d, str) else (F.coalesce(item[n].cast("long"), F.lit(d)) if n in kind.names else F.lit(d)) for n, d in EVIDENCE_ORDER]
    held = next((n for n in ITEM_IDS if n in kind.names), ITEM_IDS[-1])
    return [*(at(path, "") for path in ITEM_ORDER), at((held,), "")]


@F.pandas_udf(T.StringType())
def _normalised(texts: pd.Series) -> pd.Series:
    def literal(m: re.Match) -> str:
        return json.dumps(unicodedata.normalize("NFC", json.loads(m[0], strict=False)), ensure_ascii=False)

    def text(t: str | None) -> str | None:
        if t is None or not _AFTER_ESCAPE.search(t):  # quotes and all else that JSON adds never join with a mark
            return t and unicodedata.normalize("NFC", t)
        return re.sub(r'"(?:[^"\\]|\\.)*"', literal, t)

    return texts.map(text)


def normal_form(df: DataFrame, column: str) -> DataFrame:
    """df with all strings inside the column, keys of maps included, in Unicode's normal form C.

    Rows without a character that could change, nearly all as a rule, stay in the JVM as they are; the others' string
    literals go through one Arrow UDF. Names of fields must be in normal form themselves.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        may = F.col(column).rlike(_MAY_CHANGE)
        changed = F.get_json_object(_normalised(F.when(may, F.to_json(F.array(F.col(column))))), "$[0]")
    else:
        text = F.to_json(F.col(column), {"ignoreNullFields": "false"} | _EXACT)
        may = text.rlike(_MAY_CHANGE)
        changed = F.from_json(_normalised(F.when(may, text)), kind, _EXACT)
    return df.withColumn(column, F.when(F.coalesce(may, F.lit(False)), changed).otherwise(F.col(column)))


def digest(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the content hash of the column's canonical text."""
    normal = normal_form(df, column)
    text = _let(F.col(column), lambda v: canonical(v, df.schema[column].dataType, column))
    return normal.withColumn(name, F.concat(F.lit("sha256:"), F.sha2(text, 256)))


def redacted(value: Column, kind: T.DataType, text: Callable[[Column], Column] = redacted_credentials) -> tuple[Column, T.DataType]:
    """The value without secrets, and its type: fields and map entries with a sensitive key hold REDACTED, strings are cleaned.

    A sensitive field becomes a string whatever it was (null stays REDACTED: that a key is there is known from the schema); in a
    map with values of another type a sensitive key's value becomes null, since values of a map have one type. Keys of maps stay.
    """
    if isinstance(kind, T.StructType):
        fields, kinds = [], []
        for f in kind.fields:
            made, of = (F.lit(REDACTED), T.StringType()) if _sensitive(f.name) else redacted(value[f.name], f.dataType, text)
            fields.append(made.alias(f.name))
            kinds.append(T.StructField(f.name, of))
        return F.when(value.isNotNull(), F.struct(*fields)), T.StructType(kinds)
    if isinstance(kind, T.ArrayType):
        _, of = redacted(F.lit(None).cast(kind.elementType), kind.elementType, text)
        return F.transform(value, lambda x: redacted(x, kind.elementType, text)[0]), T.ArrayType(of)
    if isinstance(kind, T.MapType):
        _, of = redacted(F.lit(None).cast(kind.valueType), kind.valueType, text)
        hidden = F.lit(REDACTED) if isinstance(of, T.StringType) else F.lit(None).cast(of)

        def entry(k: Column, v: Column) -> Column:
            secret = k.rlike(SENSITIVE_KEY) & ~F.lower(k).isin(*PUBLIC_KEYS) if isinstance(kind.keyType, T.StringType) else F.lit(False)
            return F.when(secret, hidden).otherwise(redacted(v, kind.valueType, text)[0])

        return F.transform_values(value, entry), T.MapType(kind.keyType, of)
    return (text(value), kind) if isinstance(kind, T.StringType) else (value, kind)


def _sensitive(name: str) -> bool:
    return name.lower() not in PUBLIC_KEYS and re.search(SENSITIVE_KEY, name) is not None
