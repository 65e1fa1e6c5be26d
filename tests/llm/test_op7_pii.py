import hashlib
import random
import re

from factloom.llm import pii

SCHEMA = "doc_id long, text string, spans string, kind string"


def brute(text):
    """The fixed patterns, as they are stated."""

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text or "") if ok(m)]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def spans(text, disguised):
    return [(x["kind"], x["start"], x["end"]) for x in pii.scan(text) if x["disguised"] == disguised]


def test_patterns_against_brute_force():
    r = random.Random(7)
    parts = ["a", "b.c", "@", "x-y", ".", "..", " ", "-", "+", "(", ")", "1", "255", "256", "007", "4111", "1111", "12.34", "\n", "é", "%"]
    for _ in range(30_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 16)))
        assert spans(text, False) == brute(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_disguises_map_back_to_the_source():
    for text, kind in (
        ("write to [john (at) example [dot] com] soon", "email"),
        ("é john.doe at example dot com", "email"),
        ("jоhn@exаmple.com", "email"),
        ("ｊohn＠ｅxample．com", "email"),
        ("4111​1111​1111​1111", "card"),
        ("plus one four one five five five five two six seven one", "phone"),
        ("plus vier neun eins fünf eins zwei drei vier fünf sechs", "phone"),
        ("192 dot 168 dot 0 dot 12", "ip"),
    ):
        found = [x for x in pii.scan(text) if x["kind"] == kind]
        assert len(found) == 1 and found[0]["disguised"], text
        value = text[found[0]["start"] : found[0]["end"]]
        assert value == value.strip() and pii.detect(pii.normalise(value).text), value


def test_clean_prose_is_left_alone():
    for text in ("meet me at noon at the point of no return", "un deux mots", "one two buckle my shoe", "look at this (at last)", "a b c", ""):
        assert pii.scan(text) == []


def test_query_and_odd_rows(spark, tmp_path):
    rows = [(1, "mail a@b.co"), (1, "mail a@b.co"), (2, None), (3, ""), (None, "ip 10.0.0.1 +1 (017) 555-7713"), (4, "1" * 3000 + " é" * 100_000 + "@" + "a." * 1000 + " x@y.zz")]
    spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_phone, r.base_sha256, r.spans) for r in pii.op7_pii(spark, str(tmp_path)).fillna({"doc_id": -1}).collect())
    want = []
    for d, t in rows:
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        kinds = [k for k, _, _ in brute(t)]
        want.append((-1 if d is None else d, kinds.count("email"), kinds.count("ip"), kinds.count("phone"), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want)


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], SCHEMA)).collect() == []
