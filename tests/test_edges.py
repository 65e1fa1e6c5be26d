"""Queries against their SQL on small tables with rows that the given ones hold only at larger sizes."""

import random
from difflib import SequenceMatcher

import duckdb
import pytest
from test_oracles import plain

import __spark_entry__ as entry
from factloom.operators import ordered, retrieval


def same(spark, folder, tables, name):
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    got = sorted((plain(tuple(r)) for r in df.collect()), key=repr)
    want = sorted((plain(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want and want
    return got


RESULTS = {
    "orders": "SELECT range AS o_orderkey, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM range(40)",
    "lineitem": "SELECT range // 4 AS l_orderkey, 1 AS l_linenumber, CASE WHEN (range // 4 + range) % 3 = 0 THEN 'R' WHEN range % 2 = 0 THEN 'A' ELSE 'N' END AS l_returnflag, 'F' AS l_linestatus, TIMESTAMP '1997-05-01' AS l_shipdate FROM range(140)",
}


@pytest.mark.parametrize("name", ["k24_initial_signals", "k9_initial_plan"])
def test_results_of_one_id_and_time(spark, tmp_path, name):
    """Several results with the same id and time: the greatest status is the latest."""
    assert len(same(spark, tmp_path, RESULTS, name)) == 40


@pytest.mark.parametrize("name", ["l51_payloads_at_own_clocks", "l51_replay_at_own_clocks"])
def test_prices_of_half_a_unit(spark, tmp_path, name):
    """Minutes are prices rounded half to even; an event known in the very minute tells."""
    tables = {
        "orders": "SELECT range AS o_orderkey, range * 10 AS o_custkey, 'O' AS o_orderstatus, 30.5 + range::DOUBLE AS o_totalprice, TIMESTAMP '1997-05-01' AS o_orderdate FROM range(60)",
        "events": "SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, range % 60 AS user_id, 'view' AS event_type, 5.0 + range AS value, '{\"k\": ' || (1440 + range % 60 + range // 60) || '}' AS props FROM range(120)",
    }
    same(spark, tmp_path, tables, name)


@pytest.mark.parametrize("name", ["l13_code_name_pairs", "t14_entities"])
def test_a_number_ends_a_text(spark, tmp_path, name):
    """A card number or six digits at a text's end are no code of the name said beside the text."""
    tables = {
        "documents": "SELECT range AS doc_id, 'the end ' || (['4225571210290012', '290012', 'x'])[range % 3 + 1] AS text, 'src' || range % 5 AS source FROM range(30)",
        "benchmark": "SELECT 1::BIGINT AS item_id, 'an item of more than forty characters, all of them plain' AS text",
    }
    same(spark, tmp_path, tables, name)


def test_names_of_one_edit(spark, tmp_path):
    """Equal names, and those that differ by a character put in, left out or changed, at either end too; nulls and empty names."""
    names = ["", "a", "b", "ab", "ba", "abc", "abd", "xabc", "abcx", "abxc", "acb", "aabc", "ring", "rings", "rin", "hot bolt", "hot bold", "hot bot"]
    values = ", ".join(f"({i}, '{n}', 'B{i % 2}', {i % 3})" for i, n in enumerate(names * 7)) + ", (900, NULL, 'B0', 0), (901, 'a', NULL, 0)"
    same(spark, tmp_path, {"part": f"SELECT CAST(k AS BIGINT) AS p_partkey, n AS p_name, b AS p_brand, s AS p_size FROM (VALUES {values}) AS t(k, n, b, s)"}, "j20_fuzzy_names")


def test_names_are_not_compared_in_pairs(spark):
    """Many different names in one group give each itself."""
    rows = spark.range(3000).selectExpr("1 AS k", "md5(CAST(id AS STRING)) AS n")
    assert retrieval.one_edit(rows, ["k"], "n", "m").where("n = m").count() == 3000


def test_first_alike():
    """As plain ratios say it, for texts around the limit; few ratios are worked out."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30))) for _ in range(120)]
    texts += [t[:k] + rng.choice("abx") + t[k + 1 :] for t in texts for k in (3, 9)]

    def plain(a, b):
        a, b = "".join(a.split()), "".join(b.split())
        return bool(a and b) and (a in b or b in a or SequenceMatcher(a=a, b=b).ratio() >= 0.84)

    for b in texts[::5]:
        want = next((i for i, a in enumerate(texts) if plain(a, b)), None)
        assert ordered.first_alike([ordered.squeezed(a) for a in texts], ordered.squeezed(b), 0.84) == want


def test_ratios_that_cannot_reach_the_limit(monkeypatch):
    """Texts without letters in common are never matched."""
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: pytest.fail("a ratio was worked out"))
    assert not ordered.alike("abcdefgh", "stuvwxyz", 0.84)


def test_equal_hashes_are_stored_together(spark, tmp_path):
    """Rows equal those of the SQL, and written they take less than half of the digits of their hashes."""
    words = "SELECT range // 500 AS doc_id, 'w' || range * 48271 % 2147483647 % 20000 AS word FROM range(100000)"
    rows = same(spark, tmp_path, {"documents": f"SELECT doc_id, CASE WHEN doc_id % 50 > 0 THEN string_agg(word, ' ') END AS text FROM ({words}) GROUP BY doc_id"}, "s21_array_backfill")
    entry.queries()["s21_array_backfill"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 32 * len(rows)
