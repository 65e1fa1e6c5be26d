import math
from collections import Counter

from factloom.llm import license_scan as ls

SCHEMA = "doc_id long, text string, path string, license string"
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
ROWS = [
    (1, MIT, "a/LICENSE", "x"),
    (2, "plain text", "a/b/c/one.txt", "x"),
    (3, f"code\n\n{GPL}\n\nmore", "a/b/COPYING.txt", "x"),
    (4, None, "a/b/c/two.txt", "x"),
    (5, "", "a/three.txt", "x"),
    (6, "nothing", "z/four.txt", "x"),
    (7, "a license to kill is no licence at all", "a/b/five.txt", "x"),
    (8, "no path", None, "x"),
    (None, "word " * 100_000, "top.txt", "x"),
    (9, "Licensed under the Apache License, Version 2.0.", "z/six.py", "x"),
    (9, "Licensed under the Apache License, Version 2.0.", "z/six.py", "x"),
]


def test_inheritance_from_the_nearest_ancestor(spark):
    got = Counter((r.doc_id, r.own_license, r.license, r.inherited_from) for r in ls.scan(spark.createDataFrame(ROWS, SCHEMA), "doc_id", "text", "path").collect())
    assert got == Counter(
        [
            (1, "MIT", "MIT", None),
            (2, None, "GPL-3.0", "a/b"),
            (3, "GPL-3.0", "GPL-3.0", None),
            (4, None, "GPL-3.0", "a/b"),
            (5, None, "MIT", "a"),
            (6, None, None, None),
            (7, None, "GPL-3.0", "a/b"),
            (8, None, None, None),
            (None, None, None, None),
            (9, "Apache-2.0", "Apache-2.0", None),
            (9, "Apache-2.0", "Apache-2.0", None),
        ]
    )


def test_licence_at_the_root_and_empty_table(spark):
    df = spark.createDataFrame([(1, MIT, "LICENSE", "x"), (2, "t", "a/b/c.txt", "x"), (3, "t", "d.txt", "x")], SCHEMA)
    assert {r.doc_id: (r.license, r.inherited_from) for r in ls.scan(df, "doc_id", "text", "path").collect()} == {1: ("MIT", None), 2: ("MIT", ""), 3: ("MIT", "")}
    assert ls.scan(df.limit(0), "doc_id", "text", "path").count() == 0


def test_cosine_by_hand():
    w = ls.Weights(10, {"the": 9, "license": 2})
    idf = {"the": 1 + math.log(11 / 10), "license": 1 + math.log(11 / 3)}
    mit = {"released": 1 + math.log(11), "under": 1 + math.log(11), "the": idf["the"], "mit": 1 + math.log(11), "license": idf["license"]}
    text = {"the": idf["the"], "mit": 1 + math.log(11), "license": idf["license"], "other": 1 + math.log(11)}
    dot = sum(v * text[t] for t, v in mit.items() if t in text)
    norm = math.sqrt(sum(v * v for v in mit.values())) * math.sqrt(sum(v * v for v in text.values()))
    assert math.isclose(sum(v * w.unit("the MIT license, other").get(t, 0) for t, v in w.unit(MIT).items()), dot / norm)
    assert ls.own_license("the words mean nothing", w) == (None, 0.0)


def test_restrictive_and_unmatched_licences_are_told(spark):
    w = ls.Weights(1000, {"licensed": 300, "under": 900, "cc": 200, "4.0": 200, "the": 999, "license": 300})
    for text, name in (
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY NC ND 4.0.", "CC-BY-NC-ND-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("SPDX-License-Identifier: CC-BY-NC-ND-4.0", "CC-BY-NC-ND-4.0"),
        ("Licensed under Quux Corporation internal evaluation terms, revision seven.", ls.UNKNOWN),
        ("You need a license to drive.", None),
    ):
        assert ls.own_license(text, w)[0] == name, text
    rows = [(1, MIT, "a/LICENSE", "x"), (2, "Licensed under Quux Corporation internal evaluation terms, revision seven.", "a/b.txt", "x"), (3, "Licensed under CC BY-NC 4.0.", "a/c.txt", "x")]
    got = {r.doc_id: (r.license, r.inherited_from) for r in ls.scan(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "path").collect()}
    assert got == {1: ("MIT", None), 2: (ls.UNKNOWN, None), 3: ("CC-BY-NC-4.0", None)}
