import hashlib
import random
import re
import string

from factloom.llm import secret_scan

SCHEMA = "doc_id long, text string, spans string, kind string"
NOVELTY = secret_scan.Novelty()


def brute(text):
    """The fixed patterns, as they are stated."""
    text, found = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, (p, ok) in enumerate(
        (
            (re.compile(assign, re.I | re.A), lambda m: len(m.group(2)) >= 6),
            (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
            (re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 24),
        )
    ):
        found += [(m.start(), k, m.end()) for m in p.finditer(text) if ok(m)]
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(found)]


def base(text):
    return [(x["kind"], x["start"], x["end"]) for x in secret_scan.scan(text, NOVELTY) if x["kind"] != "novel"]


def test_patterns_against_brute_force():
    r = random.Random(5)
    parts = ["password", "Token", "apikey", "API_KEY", "secret", "ſecret", '"', "'", " ", " = ", ":", "abc123", "a" * 30, "AKIA" + "Z9" * 9, "AKIA", "ü", "0f" * 13, "\n", "toKen", "deadbeef"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert base(text) == brute(text), text


def test_novel_strings():
    r = random.Random(6)
    random_value = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(32))
    found = secret_scan.scan(f"auth bearer {random_value} end", NOVELTY)
    assert [(x["kind"], x["start"], x["end"]) for x in found] == [("novel", 12, 44)]
    assert secret_scan.scan(f"some text {random_value} end", NOVELTY) == []  # no sensitive context
    assert secret_scan.scan("auth key username_password_0123456789", NOVELTY) == []  # known identifiers
    repeated = f"{random_value} and the private key {random_value}"
    assert secret_scan.scan(repeated, NOVELTY) == []  # the surroundings already tell it


def test_query_and_odd_rows(spark, tmp_path):
    secret = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(1, secret), (1, secret), (2, None), (3, ""), (None, "é" + secret), (4, "z" * 300_000 + " password=hunter22")]
    spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_assign, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.op2_secrets(spark, str(tmp_path)).fillna({"doc_id": -1}).collect())
    want = []
    for d, t in rows:
        spans = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        kinds = [k for k, _, _ in brute(t)]
        want.append((-1 if d is None else d, kinds.count("assign"), kinds.count("hex"), hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert got == sorted(want)


def test_empty_table(spark):
    assert secret_scan.find_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


def test_novelty_alone_decides():
    r = random.Random(7)
    for letters in (string.ascii_letters, string.digits, string.ascii_letters + "7", string.ascii_letters + string.digits):
        for n in (12, 16, 20, 32):
            for _ in range(50):
                value = "".join(r.choice(letters) for _ in range(n))
                assert [(x["start"], x["end"]) for x in secret_scan.scan(f"auth bearer {value} end", NOVELTY)] == [(12, 12 + n)], value


def test_value_on_the_next_line():
    value = "qTzWvKpLmXrJhBnYcGdF"
    assert [x["kind"] for x in secret_scan.scan(f"private key:\n    {value}\n", NOVELTY)] == ["novel"]
    assert secret_scan.scan(f"private key:\n\n{value}\n", NOVELTY) == []  # two line breaks away
