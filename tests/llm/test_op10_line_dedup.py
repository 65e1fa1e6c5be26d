import random
from collections import defaultdict

from factloom.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, n_lines string, lines string"


def brute(rows):
    """Each document against the first holder of each of its windows."""
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, ld.lines_of(r[1])[0]))
    first, out = {}, {}
    for d, t in order:
        content, hashes, words, windows = ld.lines_of(t)
        gone = set()
        for p in {first[w] for w in windows if w in first}:
            gone |= set(ld.common_blocks(ld.lines_of(p)[1], hashes, words))
        for w in windows:
            first.setdefault(w, t)
        out[d, t] = sorted(gone)
    return out


def test_patience_by_hand():
    assert ld.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert ld.patience([9, 1, 2, 8], [7, 1, 2, 6]) == [(1, 1), (2, 2)]
    assert ld.patience([], [1]) == []
    assert ld.increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in "ab")
        got = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < q and r_ < s for (p, r_), (q, s) in zip(got, got[1:], strict=False))


def test_blocks_moved_and_short():
    first, later = [1, 2, 3, 4, 5, 6], [9, 4, 5, 8, 1, 2, 7, 6]
    assert ld.common_blocks(first, later, [20] * 8) == [1, 2, 4, 5]  # the moved block too, but no single short line
    assert ld.common_blocks(first, later, [5] * 8) == []


def test_every_shared_window_goes():
    """Moved, repeated and reordered passages against all common blocks of two documents."""
    first, later = ld.lines_of("w " * 60 + "\na b\nc d"), ld.lines_of("a b\nc d\n" + "w " * 60)
    assert ld.common_blocks(first[1], later[1], later[2]) == [2]  # the short lines are aligned first
    twice = ld.lines_of("\n".join(["w " * 40, "x", "w " * 40]))
    assert ld.common_blocks(twice[1], twice[1][::-1], twice[2][::-1]) == [0, 1, 2]
    r = random.Random(4)
    for _ in range(300):
        lines = [" ".join("v" * r.randint(1, 12)) + str(k) for k in range(8)] + [""]
        a, b = (ld.lines_of("\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for _ in "ab")
        gone = set(ld.common_blocks(a[1], b[1], b[2]))
        common = set()
        for i in range(len(a[1])):
            for j in range(len(b[1])):
                k = 0
                while i + k < len(a[1]) and j + k < len(b[1]) and a[1][i + k] == b[1][j + k]:
                    k += 1
                if sum(b[2][j : j + k]) >= ld.MIN_WORDS:
                    common |= set(range(j, j + k))
        held = {h for _, _, h in ld.windows_of(a[1], a[2])}
        shared = {x for j, end, h in ld.windows_of(b[1], b[2]) if h in held for x in range(j, end)}
        assert shared <= gone <= common


def test_many_lines_are_aligned_in_time():
    same = ld.lines_of("w " * 40 + "\n" + "ab cd\n" * 20_000)
    turned = [ld.lines_of("\n".join(order)) for order in (["u " * 31 + str(k) for k in range(3000)], ["u " * 31 + str(k) for k in range(2999, -1, -1)])]
    assert ld.common_blocks(same[1], same[1][::-1], same[2][::-1]) == list(range(1, len(same[1])))  # all but the empty line, which now stands first
    assert len(ld.common_blocks(turned[0][1], turned[1][1], turned[1][2])) == 3000


def passage(r, n):
    return "\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 5) for _ in range(r.randint(1, 25))) for _ in range(n))


def test_against_brute_force(spark):
    r = random.Random(2)
    shared = [passage(r, r.randint(1, 6)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [passage(r, r.randint(0, 4)) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, 3), r.choice(shared))
        rows.append((i, "\n".join(parts)))
    rows += [(300 + i, rows[5][1]) for i in range(30)] + [rows[7], rows[7], (None, rows[3][1]), (400, None), (401, ""), (402, "w " * 200_000 + "\n" + shared[0])]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA)
    want = brute(rows)
    got = ld.deduplicate(df).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    for x in got:
        t = texts[x.doc_id][0]
        gone = want[x.doc_id, t]
        kept = None if t is None else "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
        assert (x.n_deleted, x.text) == (len(gone), kept)
        assert x.n_lines == (0 if t is None else len(t.split("\n"))) and x.lines == "b"
    assert sum(x.n_deleted > 0 for x in got) > 40


def test_empty_table(spark):
    assert ld.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
