"""Entity extraction against a plain walk through the passes, and a large dictionary against `in`."""

import random
import re

import pytest

from factloom.operators import entities

SCHEMA = "name string, ticker string, entity_type string, ordinal long"


def strip(name):
    changed = True
    while changed and name:
        changed = False
        for filler in entities.FILLERS:
            if name.startswith(filler) and len(name) > len(filler) + 1:
                name, changed = name[len(filler) :].strip(), True
    return name


def likely(name):
    name = re.sub("[^一-鿿]", "", name)
    return 3 <= len(name) <= 8 and name not in entities.NO_COMPANIES and not name.endswith(tuple(entities.NO_ENDINGS))


def walk(text, aliases):
    out, seen = [], set()
    for name, ticker, kind, _ in sorted(aliases, key=lambda a: a[3]):
        if name and name in text and ticker not in seen:
            out.append((name, ticker, kind))
            seen.add(ticker)
    pairs = [(m[1], strip(m[2])) for m in re.finditer(entities.CODE_THEN_NAME, text)] + [(m[2], strip(m[1])) for m in re.finditer(entities.NAME_THEN_CODE, text)]
    for ticker, name in pairs:
        if likely(name) and ticker not in seen and name not in seen:
            out.append((name, ticker, "EQUITY"))
            seen |= {ticker, name}
    for code in re.findall(r"\b\d{6}\b|\b\d{4}\.HK\b|\b[A-Z]{1,5}\b", text, flags=re.IGNORECASE):
        code = code.upper()
        if code in seen or (code.isalpha() and len(code) <= 2):
            continue
        kind = "EQUITY" if re.fullmatch(r"\d{4}\.HK|\d{6}", code) else "THEME" if code in entities.THEMES else "UNKNOWN"
        out.append((code, code, kind))
        seen.add(code)
    for m in re.finditer(entities.COMPANY, text):
        name = strip(m[1])
        if likely(name) and name not in seen:
            out.append((name, name, "EQUITY"))
            seen.add(name)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 200_000), (2, 3)])
def test_against_the_passes(spark, seed, chunk):
    rng = random.Random(seed)
    words = ["600519", "000001", "0700.HK", "0700.hk", "AI", "FED", "semi", "the", "Été", "word_x", "贵州茅台", "平安科技", "这里平安科技", "看看再看中芯国际集团", "行情", "市场行情", "股份", "沪指", "上证指数", "黄金", "（", "(", " ", " ", "，", "SH", "SH600519", "中芯", "资讯服务", "12345678"]
    texts = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(150)] + [(900, None), (901, ""), (902, "茅台科技 " * 20_000)]
    aliases = [(n, t, k, i) for i, (n, k, t) in enumerate(entities.ALIASES)] + [("指数", "000001.SH", "INDEX", -1), ("", "X", "Y", 50), (None, "X", "Y", 51), ("the", "600519", "WORD", 60), ("黄金", "GOLD", "METAL", 61)]
    got = {}
    for r in entities.extract(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(aliases, SCHEMA), "id", "t", chunk).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.name, r.ticker, r.entity_type))
        assert r.ordinal == len(got[r.id]) - 1
    want = {i: walk(t, [a for a in aliases if a[0]]) for i, t in texts if t}
    assert got == {i: w for i, w in want.items() if w}


def test_a_large_dictionary(spark):
    """A hundred thousand names, nested and overlapping ones among them, in two automata."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(110_000)})
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(400))) for i in range(12)]
    hits = entities.alias_hits(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, ordinal long"), "id", "t", 60_000)
    got = sorted(map(tuple, hits.collect()))
    assert len(names) > 60_000 and got == sorted((i, n) for i, t in texts for n, name in enumerate(names) if name in t)
