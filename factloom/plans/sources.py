"""Source and sink queries: subtitles of `conversations`, writes over `customer` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.sources import sinks, subtitles
from factloom.plans.catalog import dealt, query, table
from factloom.plans.intervals import SEGMENTS_SQL, segments

STAMPS = "(1, '00:01.5'), (2, '01:02:03.045'), (3, '1:00:00,1'), (4, '00:61.000'), (5, 'x'), (6, '59:59.999'), (7, '00:00:60.000')"


@query(
    "s5_timestamps",
    rf"""SELECT id, CASE WHEN regexp_matches(s, '^(?:(\d{{1,2}}):)?(\d{{2}}):(\d{{2}})[,.](\d{{1,3}})$') AND m < 60 AND sec < 60 THEN (h * 3600 + m * 60 + sec) * 1000 + ms END AS ms FROM
    (SELECT *, coalesce(TRY_CAST(regexp_extract(s, '^(?:(\d{{1,2}}):)?(\d{{2}}):(\d{{2}})[,.](\d{{1,3}})$', 1) AS BIGINT), 0) AS h, TRY_CAST(regexp_extract(s, '^(?:(\d{{1,2}}):)?(\d{{2}}):(\d{{2}})[,.](\d{{1,3}})$', 2) AS BIGINT) AS m,
     TRY_CAST(regexp_extract(s, '^(?:(\d{{1,2}}):)?(\d{{2}}):(\d{{2}})[,.](\d{{1,3}})$', 3) AS BIGINT) AS sec, TRY_CAST(rpad(regexp_extract(s, '^(?:(\d{{1,2}}):)?(\d{{2}}):(\d{{2}})[,.](\d{{1,3}})$', 4), 3, '0') AS BIGINT) AS ms FROM (VALUES {STAMPS}) AS t(id, s))""",
    over=STAMPS,
)
def s5_timestamps(spark, sf_dir):
    """Subtitle time stamps in milliseconds; malformed ones are null."""
    return dealt(spark, sf_dir, STAMPS, "id, s").select("id", subtitles.milliseconds(F.col("s")).alias("ms"))


#: Each conversation as a subtitle file: what the system says is a note, and a turn whose length divides by 11 lost its times.
_TURNS_SQL = f"SELECT conv_id AS file_id, turn, role, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS said, start_ms, end_ms, length(text) % 11 = 0 AS lost FROM ({SEGMENTS_SQL})"


def turns(spark, sf_dir):
    return segments(spark, sf_dir).select(F.col("conv_id").alias("file_id"), "turn", "role", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")).alias("said"), "start_ms", "end_ms", (F.length("text") % 11 == 0).alias("lost"))


def _stamp(ms):
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(F.col(ms) / 3_600_000, 2), F.lit(":"), part(F.col(ms) / 60_000 % 60, 2), F.lit(":"), part(F.col(ms) / 1000 % 60, 2), F.lit("."), part(F.col(ms) % 1000, 3))


@query(
    "s4_text_cues",
    f"""SELECT file_id, CAST(turn + 1 AS INTEGER) AS position, CASE WHEN NOT lost THEN start_ms END AS start_ms, CASE WHEN NOT lost THEN end_ms END AS end_ms, CASE WHEN NOT lost THEN concat(said, chr(10), role) END AS text,
    coalesce(NOT lost AND start_ms < end_ms AND start_ms >= coalesce(lag(CASE WHEN NOT lost THEN end_ms END) OVER (PARTITION BY file_id ORDER BY turn), 0), false) AS valid FROM ({_TURNS_SQL}) WHERE role <> 'system'""",
)
def s4_text_cues(spark, sf_dir):
    """Cues of VTT bodies with their notes and settings left out."""
    timed = F.concat(_stamp("start_ms"), F.lit(" --> "), _stamp("end_ms"), F.lit(" align:start\n"), "said", F.lit("\n"), "role")
    block = F.when(F.col("role") == "system", F.concat(F.lit("NOTE "), "said")).when(F.col("lost"), F.concat(F.lit("lost: "), "said")).otherwise(timed)
    bodies = turns(spark, sf_dir).withColumn("block", block).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("b"))
    files = bodies.select("file_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join("b.block", "\r\n\r\n")).alias("body"))
    return subtitles.ordered_cues(subtitles.text_cues(files, "file_id", "body"), "file_id", "start_ms", "end_ms", "position")


@query("s3_json_cues", f"SELECT file_id, CAST(turn AS INTEGER) AS position, start_ms, CASE WHEN NOT lost THEN end_ms END AS end_ms, CASE WHEN role = 'system' THEN '' ELSE said END AS text FROM ({_TURNS_SQL})")
def s3_json_cues(spark, sf_dir):
    """Cues of JSON bodies in either naming; seconds round half to even."""
    user = F.col("role") == "user"
    seconds = lambda ms: (F.col(ms) / 1000).cast("string")
    end = F.when(F.col("lost"), "late").otherwise(seconds("end_ms"))
    cue = F.struct(F.col("turn"), F.struct(F.when(user, seconds("start_ms")).alias("from"), F.when(~user, seconds("start_ms")).alias("start"), F.when(user, end).alias("to"), F.when(~user, end).alias("end"), F.when(user, F.col("said")).alias("content"), F.when(F.col("role") == "assistant", F.col("said")).alias("text")).alias("cue"))
    bodies = turns(spark, sf_dir).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(cue["cue"]).alias("cue")))).alias("b"))
    files = bodies.select("file_id", F.concat(F.lit('{"body":['), F.array_join("b.cue", ","), F.lit("]}")).alias("body"))
    return subtitles.json_cues(files, "file_id", "body")


TRACKS = "(1, 0, 'en', 'official'), (1, 1, 'zh_Hans', 'automatic'), (1, 2, 'zh-TW', 'official'), (2, 0, 'zh-CN', 'official'), (2, 1, 'zh-Hans', 'official'), (3, 0, 'en', 'official'), (4, 0, 'zh', 'automatic')"


@query(
    "s7_track_preference",
    f"""SELECT v, CASE WHEN r IS NOT NULL THEN CAST(r % 100 AS INT) END AS pos, CASE r // 100 WHEN 0 THEN 'manual_zh_hans_or_zh_cn' WHEN 1 THEN 'manual_other_chinese' WHEN 2 THEN 'automatic_zh_hans_or_zh_cn' WHEN 3 THEN 'automatic_other_chinese' ELSE 'asr_required' END AS reason
    FROM (SELECT v, min(CASE WHEN starts_with(l, 'zh') THEN (CASE src WHEN 'official' THEN 0 ELSE 2 END + CASE WHEN l IN ('zh-hans', 'zh-cn') THEN 0 ELSE 1 END) * 100 + pos END) AS r FROM (SELECT *, replace(lower(lang), '_', '-') AS l FROM (VALUES {TRACKS}) AS t(v, pos, lang, src)) GROUP BY v)""",
    over=TRACKS,
    key="v",
    n=4,
)
def s7_track_preference(spark, sf_dir):
    """The subtitle track to take of each video."""
    return subtitles.chinese_track(dealt(spark, sf_dir, TRACKS, "v, pos, lang, src", 4), "v", "lang", "src", "pos")


@query("s13_insert_ignore", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey >= 8 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_nationkey < 8 AND c_acctbal >= 5000")
def s13_insert_ignore(spark, sf_dir):
    """Rows whose key exists are left as they are."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sinks.insert_ignore(base.where("c_nationkey >= 8"), base.where("c_acctbal >= 5000").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@query(
    "s15_replace_for_parent",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice >= 300000 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 300000) THEN 'ACTIVE'
      WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 300000) THEN 'SUPERSEDED' ELSE o_orderstatus END AS status FROM orders""",
)
def s15_replace_for_parent(spark, sf_dir):
    """Replacement of a parent's rows: missing ones are superseded, other parents untouched."""
    old = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus AS status")
    new = old.where("o_totalprice >= 300000").withColumn("status", F.lit("ACTIVE"))
    return sinks.replace_for_parent(old, new, "o_custkey", "o_orderkey", "status")


@query("s1_filtered_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount > 0.08")
def s1_filtered_scan(spark, sf_dir):
    """Scan with filters and columns pushed to the files."""
    return table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1998-01-01 00:00:00' AND l_discount > 0.08").select("l_orderkey", "l_extendedprice")


@query("s18_index_rebuild", "SELECT lang, count(*) FILTER (n_chars >= 500) AS indexed, count(*) FILTER (n_chars < 500) AS skipped FROM documents GROUP BY lang")
def s18_index_rebuild(spark, sf_dir):
    """Rows that an index rebuild keeps and skips."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") >= 500).alias("indexed"), F.count_if(F.col("n_chars") < 500).alias("skipped"))


@query("s21_array_backfill", "SELECT doc_id, CAST(generate_subscripts AS BIGINT) AS ordinal, sha256(word) AS ref FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS generate_subscripts FROM documents)")
def s21_array_backfill(spark, sf_dir):
    """Array elements as rows of their own, with their place; a task's rows of equal elements follow each other.

    A hash of 64 digits takes Parquet's dictionary to its limit after some 15,000 words, and from there on each row would be
    stored with its digits. Side by side, equal ones compress to a few bytes. Sorted are the words, before they are hashed.
    """
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "word"))
    return words.sortWithinPartitions(F.xxhash64("word")).select("doc_id", (F.col("p") + 1).cast("long").alias("ordinal"), F.sha2("word", 256).alias("ref"))
