import pickle
import random
import tracemalloc
import zlib

import numpy as np

from factloom.llm import language_id as li

SCHEMA = "doc_id long, text string, lang string, source string, score string"
WORDS = {"en": "the and of to in is that it was for on are with his they".split(), "de": "der die und das nicht ist mit für auf ein eine sich auch über".split()}


def texts(n, seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(30)), lang, "s", "c") for i in range(n) for lang in [r.choice(["en", "de"])]]


def longest_phrases(text, sample):
    """Greedy parse into the longest substrings of the sample."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample and text[i : i + k] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_against_brute_force():
    r = random.Random(8)
    samples = {k: ["".join(r.choice("abc ") for _ in range(300))] for k in "xy"}
    model = li.Model(samples)
    table = model.table()
    for _ in range(30):
        texts = ["".join(r.choice("abcdé ") for _ in range(r.randint(1, 1300))).strip() or "a" for _ in range(5)]
        codes = [li.encode(t, table) for t in texts]
        got = model.phrases(codes)
        names = {0: " ", 1: "?"} | {2 + i: c for i, c in enumerate(model.letters)}
        for i, c in enumerate(codes):
            flat = "".join(names[x] for x in c.tolist())
            for j, lang in enumerate(model.langs):
                sample = "".join(names[x] for x in li.encode(samples[lang][0].lower(), table).tolist())
                want = sum(longest_phrases(flat[s : s + li.SEGMENT], sample) for s in range(0, len(flat), li.SEGMENT))
                assert got[i, j] == want


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(400, 1) + [(1000, None, "en", "s", "c"), (1001, "", "de", "s", "c"), (1002, "123 !?", "de", "s", "c"), (None, "the and of", None, "s", "c"), (1003, "und das ist nicht " * 30_000, "de", None, "c")]
    got = {r.doc_id: r for r in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    held = [d for d, _, _, _, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 3 == 1]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    lang = {d: x for d, _, x, _, _ in rows}
    assert all(got[d].lang_pred == lang[d] for d in held if d < 1000)
    assert [(got[d].lang_pred, got[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = texts(300, 2)
    lied = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 3 == 1 else lang, s, c) for d, t, lang, s, c in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in li.identify(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, lied))
    assert a == b


def test_nothing_to_learn_from(spark):
    assert li.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    got = li.identify(spark.createDataFrame([(1, "the", None, "s", "c")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_automaton_recognises_substrings_only():
    r = random.Random(3)
    seq = [r.randint(0, 2) for _ in range(60)]
    step = li.automaton(seq)
    subs = {tuple(seq[i:j]) for i in range(60) for j in range(i, 61)}
    for _ in range(3000):
        word, state = tuple(r.randint(0, 2) for _ in range(r.randint(1, 7))), 0
        for c in word:
            state = step[state].get(c) if state is not None else None
        assert (state is not None) == (word in subs)
    assert np.issubdtype(li.Model({"x": ["abc"]}).next.dtype, np.int32)


def test_no_letter_loses_its_identity(spark):
    """Two scripts of hundreds of letters, of which most are rare, are told apart."""
    r = random.Random(6)
    scripts = {"x": [chr(0x4E00 + i) for i in range(700)], "y": [chr(0xAC00 + i) for i in range(700)], "z": [chr(0x4E00 + 700 + i) for i in range(700)]}
    words = {lang: ["".join(r.choice(letters) for _ in range(3)) for _ in range(400)] for lang, letters in scripts.items()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(40)), lang, "s", "c") for i in range(240) for lang in [r.choice("xyz")]]
    got = {x.doc_id: x for x in li.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert np.mean([got[d].lang_pred == lang for d, _, lang, _, _ in rows if got[d].held_out]) > 0.95


def test_foreign_texts_are_rejected(spark):
    r = random.Random(7)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000)) for _ in range(5)]
    rows = texts(600, 3) + [(2000 + i, t, "en", "s", "c") for i, t in enumerate(noise)] + [(3000, "the and of " * 1000, None, "s", "c"), (3001, None, "en", "s", "c"), (3002, "", None, "s", "c")]
    got = li.in_known_language(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "lang", "source", "score"]
    assert sorted(x.doc_id for x in got.collect()) == [*range(600), 3000]


def test_windows_are_spread_over_whole_texts(spark):
    """What stands at the end of long texts is learnt too."""
    rows = [(i, ("the and of to " * 3000) + "quip" * 3000, "en", "s", "c") for i in range(1, 30)]
    model = li.learn(spark.createDataFrame(rows, SCHEMA))
    assert "q" in model.letters


def test_tables_are_built_once_and_sent_small():
    """The driver holds one copy of the tables while it builds them, and what it sends is a fraction of them."""
    r = random.Random(4)
    samples = {k: [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(1500))] for k in "xyz"}
    tracemalloc.start()
    model = li.Model(samples)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * model.next.nbytes
    sent = pickle.dumps(model)
    assert len(sent) < model.next.nbytes / 4
    again = pickle.loads(sent)
    assert (again.next == model.next).all() and again.roots == model.roots
    assert again.predict(samples["y"], again.table()) == model.predict(samples["y"], model.table())
