import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from factloom.functions import numeric
from factloom.operators import lineage, ordered
from factloom.streaming import outbox


def test_chinese_numbers():
    for text, value in {"一百五": 150, "一百零五": 105, "三千四": 3400, "十": 10, "二十三": 23, "两万": 20_000, "一亿二千万": 120_000_000, "一百五十亿": 15e9, "〇": 0, "五": 5}.items():
        assert numeric.chinese_number(text) == value, text
    assert numeric.chinese_number("abc") is None and numeric.chinese_number("") is None and numeric.chinese_number(None) is None


def test_amounts(spark):
    df = spark.createDataFrame([(1, "营收12.5亿元，同比增长30%"), (2, "一万五千亿和两成"), (3, None), (4, "无数字")], "id long, s string")
    got = {r.id: [(x["value"], x["unit"]) for x in r.a] for r in df.select("id", numeric.amounts_of(F.col("s")).alias("a")).collect()}
    assert got == {1: [(12.5e8, "CNY"), (30.0, "PERCENT")], 2: [(1.5e12, "NUMBER"), (20.0, "PERCENT")], 3: [], 4: []}


def test_normal_form_and_gestalt(spark):
    df = spark.createDataFrame([("é", "abcd", "bcde"), (None, None, "x")], "t string, a string, b string")
    rows = df.select(numeric.nfc(F.col("t")).alias("t"), numeric.gestalt(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r.t, r.r) for r in rows] == [("é", 0.75), (None, None)]


def statements(n):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(12)]
    out = []
    for i in range(n):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            s[r.randrange(40)] = r.choice("xyz")
        out.append((i % 4, i, "".join(s), r.random()))
    return out


def test_merge_near_is_first_fit(spark):
    data = statements(120)
    got = {r.uid: r.kept_uid for r in ordered.merge_near(spark.createDataFrame(random.Random(1).sample(data, 120), "k long, uid long, s string, c double"), ["k"], "uid", "s").collect()}
    want, kept = {}, []
    for k, uid, s, _ in data:
        a = "".join(s.split())
        home = next((u for q, u, t in kept if q == k and (t in a or a in t or SequenceMatcher(a=t, b=a).ratio() >= 0.84)), None)
        if home is None:
            kept.append((k, uid, a))
        want[uid] = uid if home is None else home
    assert got == want and len(set(want.values())) < 120


def test_top_units_leave_out_what_is_alike(spark):
    data = statements(80)
    got = ordered.select_distinct_top(spark.createDataFrame(data, "k long, uid long, s string, c double"), ["k"], "uid", "s", ["c"], 3).collect()
    texts = {uid: s for _, uid, s, _ in data}
    for k in range(4):
        own = sorted((r.rank, r.uid) for r in got if r.k == k)
        assert [n for n, _ in own] == [1, 2, 3][: len(own)]
        assert own[0][1] == max((c, -uid, uid) for q, uid, _, c in data if q == k)[2]
        assert not any(ordered.alike(texts[a], texts[b], 0.82) for i, (_, a) in enumerate(own) for _, b in own[:i])


def test_temporal_windows(spark):
    rows = [(1, i, i * 20_000, (i + 1) * 20_000, "最后 x" if i == 5 else "x") for i in range(12)] + [(2, 0, 0, 5000, " "), (3, 0, 0, 5000, "only")]
    got = sorted((r.v, r.window, r.first_index, r.last_index) for r in ordered.temporal_windows(spark.createDataFrame(rows, "v long, i long, s long, e long, t string"), "v", "i", "s", "e", "t", markers=("最后",)).collect())
    assert got == [(1, 0, 0, 4), (1, 1, 4, 9), (1, 2, 9, 11), (3, 0, 0, 0)]


def test_long_chain_of_ancestors(spark):
    spark.sparkContext.setCheckpointDir("/tmp/factloom-checkpoints")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "c long, p long")
    assert lineage.ancestors(edges, "c", "p").count() == 40 * 41 // 2


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_deliveries_and_leases_as_streams(spark, tmp_path):
    for n, rows in enumerate([[(1, False), (2, True), (3, False)], [(1, False), (2, False), (3, True)], [(1, False)] * 4]):
        spark.createDataFrame(rows, "outbox_id long, ok boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
    stream = spark.readStream.schema("outbox_id long, ok boolean").parquet(f"{tmp_path}/a")
    drain(outbox.deliveries(stream), "deliveries", "update")
    last = {r.outbox_id: r for r in spark.table("deliveries").collect()}
    assert last[1].status == "DEAD_LETTER" and last[1].attempts == 6
    assert last[2].status == "PUBLISHED"
    spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 10), (1, "a", 8, 10), (1, "b", 18, 10)], "task_id long, owner string, at long, seconds long").coalesce(1).write.parquet(f"{tmp_path}/l")
    drain(outbox.leases(spark.readStream.schema("task_id long, owner string, at long, seconds long").parquet(f"{tmp_path}/l")), "leases", "append")
    assert [(r.owner, r.token, r.accepted) for r in spark.table("leases").collect()] == [("a", 1, True), ("b", 1, False), ("a", 1, True), ("b", 2, True)]


def test_upserts_keep_the_newest_row(spark, tmp_path):
    write = outbox.upsert_by_key(f"{tmp_path}/t", "k", "at")
    one = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k long, at long, v string")
    two = spark.createDataFrame([(1, 4, "late"), (2, 9, "c"), (3, 1, "d")], "k long, at long, v string")
    write(one, 0)
    write(two, 1)
    write(two, 1)  # a replayed batch
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t/version=1").collect()) == [(1, "a"), (2, "c"), (3, "d")]
