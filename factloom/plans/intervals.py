"""Interval queries: `conversations` as transcripts (a turn's text lasts 60 ms a character), `events` as frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import intervals as iv
from factloom.plans.catalog import dealt, query, table

SEGMENTS_SQL = """SELECT conv_id, turn, role, text, CAST(coalesce(sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
    CAST(sum(length(text) * 60) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_ms FROM conversations"""


def segments(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    upto = F.sum(F.length("text") * 60).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").withColumns({"end_ms": upto, "start_ms": upto - F.length("text") * 60})


#: What users and the system say, each 300 ms into the next turn: leaves gaps where the assistant answers, and overlaps.
SPOKEN_SQL = f"SELECT conv_id, turn, start_ms, end_ms + 300 AS end_ms, max(end_ms) OVER (PARTITION BY conv_id) AS duration FROM ({SEGMENTS_SQL}) WHERE role <> 'assistant'"


def spoken(spark, sf_dir):
    kept = segments(spark, sf_dir).where("role <> 'assistant'").withColumn("duration", F.max("end_ms").over(Window.partitionBy("conv_id")))
    return kept.selectExpr("conv_id", "turn", "start_ms", "end_ms + 300 AS end_ms", "duration")


ISLANDS_SQL = f"""WITH s AS (SELECT conv_id, start_ms, least(end_ms, duration) AS end_ms, duration FROM ({SPOKEN_SQL})),
    r AS (SELECT *, max(end_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM r),
    u AS (SELECT conv_id, island, min(start_ms) AS s, max(end_ms) AS e, max(duration) AS d, sum(CASE WHEN start_ms <= reach THEN greatest(0, least(end_ms, reach) - start_ms) ELSE 0 END) AS again,
          max(CASE WHEN reach IS NULL OR start_ms > reach THEN start_ms - coalesce(reach, 0) END) AS gap FROM i GROUP BY conv_id, island)"""


@query(
    "g16_transcript_coverage",
    ISLANDS_SQL
    + """ SELECT conv_id, CAST(max(d) AS BIGINT) AS duration_ms, CAST(sum(e - s) AS BIGINT) AS covered_ms, CAST(sum(again) AS BIGINT) AS overlap_ms,
    CAST(greatest(max(gap), max(d) - max(e)) AS BIGINT) AS max_gap_ms, sum(e - s) * 10 >= max(d) * 9 AS covers_90_percent FROM u GROUP BY conv_id""",
)
def g16_transcript_coverage(spark, sf_dir):
    """Union length, overlap and largest gap of each transcript, and whether it covers nine tenths."""
    out = iv.coverage(spoken(spark, sf_dir), ["conv_id"], "start_ms", "end_ms", "duration")
    return out.withColumn("covers_90_percent", F.col("covered_ms") * 10 >= F.col("duration_ms") * 9)


@query(
    "w7_transcript_gaps",
    f"""WITH r AS (SELECT *, coalesce(max(end_ms) OVER (PARTITION BY conv_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM ({SPOKEN_SQL}))
    SELECT conv_id, CAST(reach AS BIGINT) AS gap_start, CAST(start_ms AS BIGINT) AS gap_end FROM r WHERE start_ms > reach
    UNION ALL SELECT conv_id, CAST(max(end_ms) AS BIGINT), CAST(max(duration) AS BIGINT) FROM ({SPOKEN_SQL}) GROUP BY conv_id HAVING max(end_ms) < max(duration)""",
)
def w7_transcript_gaps(spark, sf_dir):
    """Stretches that no segment covers, the tail included."""
    return iv.gaps(spoken(spark, sf_dir), ["conv_id"], "start_ms", "end_ms", "duration")


@query(
    "w8_monotonic_check",
    f"""SELECT conv_id, bool_and(coalesce(p <= start_ms, true)) AS monotonic FROM (SELECT *, lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM ({SPOKEN_SQL})) GROUP BY conv_id""",
)
def w8_monotonic_check(spark, sf_dir):
    """Whether segments in their own order neither step back nor overlap."""
    before = F.lag("end_ms").over(Window.partitionBy("conv_id").orderBy("turn"))
    return spoken(spark, sf_dir).withColumn("p", before).groupBy("conv_id").agg(F.bool_and(F.coalesce(F.col("p") <= F.col("start_ms"), F.lit(True))).alias("monotonic"))


@query(
    "g17_source_mix",
    f"""SELECT conv_id, role, CAST(sum(end_ms - start_ms) AS BIGINT) AS role_ms, round(sum(end_ms - start_ms) / max(total), 9) AS share
    FROM (SELECT *, sum(end_ms - start_ms) OVER (PARTITION BY conv_id) AS total FROM ({SEGMENTS_SQL})) WHERE total > 0 GROUP BY conv_id, role""",
)
def g17_source_mix(spark, sf_dir):
    """Share of each source in what a transcript covers."""
    span = segments(spark, sf_dir).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    parts = span.groupBy("conv_id", "role").agg(F.sum("ms").alias("role_ms"))
    total = F.sum("role_ms").over(Window.partitionBy("conv_id"))
    return parts.withColumn("total", total).where("total > 0").select("conv_id", "role", "role_ms", F.round(F.col("role_ms") / F.col("total"), 9).alias("share"))


@query(
    "w5_contiguous_segments",
    """WITH b AS (SELECT conv_id, turn AS boundary, max(turn) OVER (PARTITION BY conv_id) AS last, role FROM conversations),
    p AS (SELECT DISTINCT conv_id, boundary, last FROM b WHERE role = 'assistant' AND boundary < last)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY boundary) - 1 AS segment_index, coalesce(lag(boundary) OVER (PARTITION BY conv_id ORDER BY boundary) + 1, 0) AS start_index, boundary AS end_index FROM p
    UNION ALL SELECT conv_id, count(*), max(boundary) + 1, max(last) FROM p GROUP BY conv_id HAVING max(boundary) + 1 <= max(last)""",
)
def w5_contiguous_segments(spark, sf_dir):
    """Semantic segments between boundaries (turns that end an exchange), covering every turn once."""
    turns = table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    points = turns.where("role = 'assistant' AND turn < last").selectExpr("conv_id", "turn AS boundary", "last")
    return iv.contiguous(points, ["conv_id"], "boundary", "last")


@query(
    "w6_full_coverage_check",
    """SELECT conv_id, bool_and(coalesce(turn = p + 1, turn = 0)) AS contiguous, count(*) AS n_turns FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id""",
)
def w6_full_coverage_check(spark, sf_dir):
    """Whether indices run from 0 without a hole."""
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    ok = F.coalesce(F.col("turn") == F.col("p") + 1, F.col("turn") == 0)
    return table(spark, sf_dir, "conversations").withColumn("p", before).groupBy("conv_id").agg(F.bool_and(ok).alias("contiguous"), F.count("*").alias("n_turns"))


@query(
    "w10_evidence_windows",
    f"""SELECT conv_id, turn, CAST(greatest(0, start_ms - 1500) AS BIGINT) AS window_start, CAST(least(d, end_ms + 1500) AS BIGINT) AS window_end,
    CAST((greatest(0, start_ms - 1500) + least(d, end_ms + 1500)) // 2 AS BIGINT) AS center_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY conv_id) AS d FROM ({SEGMENTS_SQL})) WHERE role = 'user'""",
)
def w10_evidence_windows(spark, sf_dir):
    """Windows around evidence, padded by 1.5 s and clamped to the media."""
    seg = segments(spark, sf_dir).withColumn("d", F.max("end_ms").over(Window.partitionBy("conv_id"))).where("role = 'user'")
    lo, hi = "greatest(0L, start_ms - 1500)", "least(d, end_ms + 1500)"
    return seg.selectExpr("conv_id", "turn", f"{lo} AS window_start", f"{hi} AS window_end", f"({lo} + {hi}) div 2 AS center_ms")


FRAMES_SQL = "SELECT event_id AS frame_id, user_id % 100 AS conv_id, (event_id * 7919) % 120000 AS at_ms, event_type FROM events"


def frames(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id AS frame_id", "user_id % 100 AS conv_id", "(event_id * 7919) % 120000 AS at_ms", "event_type")


@query(
    "j9_frames_in_segments",
    f"""SELECT s.conv_id, s.turn, f.frame_id, f.at_ms FROM ({SEGMENTS_SQL}) s JOIN ({FRAMES_SQL}) f ON f.conv_id = s.conv_id AND f.at_ms BETWEEN s.start_ms - 1000 AND s.end_ms + 1000""",
)
def j9_frames_in_segments(spark, sf_dir):
    """Frames within a second of a segment."""
    met = iv.range_join(frames(spark, sf_dir), segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms"), ["conv_id"], "at_ms", "start_ms", "end_ms", 20_000, 1000)
    return met.select("conv_id", "turn", "frame_id", "at_ms")


@query(
    "j10_anchor_context",
    f"""SELECT frame_id, conv_id, turn, rank FROM (SELECT f.frame_id, s.conv_id, s.turn, row_number() OVER (PARTITION BY f.frame_id ORDER BY s.turn) AS rank FROM ({SEGMENTS_SQL}) s JOIN ({FRAMES_SQL}) f
    ON f.conv_id = s.conv_id AND f.at_ms BETWEEN s.start_ms - 12000 AND s.end_ms + 12000 WHERE f.event_type = 'error') WHERE rank <= 4""",
)
def j10_anchor_context(spark, sf_dir):
    """The first four segments within twelve seconds of a visual anchor."""
    met = iv.range_join(frames(spark, sf_dir).where("event_type = 'error'"), segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms"), ["conv_id"], "at_ms", "start_ms", "end_ms", 20_000, 12_000)
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy("turn"))
    return met.withColumn("rank", rank).where("rank <= 4").select("frame_id", "conv_id", "turn", "rank")


@query(
    "j24_nearest_page",
    f"""SELECT conv_id, turn, arg_min(frame_id, struct_pack(a := abs(2 * at_ms - start_ms - end_ms), b := frame_id)) AS frame_id FROM
    (SELECT s.conv_id, s.turn, s.start_ms, s.end_ms, f.frame_id, f.at_ms FROM ({SEGMENTS_SQL}) s JOIN ({FRAMES_SQL}) f ON f.conv_id = s.conv_id AND f.at_ms BETWEEN s.start_ms AND s.end_ms) GROUP BY conv_id, turn""",
)
def j24_nearest_page(spark, sf_dir):
    """Of the frames inside a segment the one nearest to its middle."""
    met = iv.range_join(frames(spark, sf_dir), segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms"), ["conv_id"], "at_ms", "start_ms", "end_ms", 20_000)
    near = F.struct(F.abs(2 * F.col("at_ms") - F.col("start_ms") - F.col("end_ms")), F.col("frame_id"))
    return met.groupBy("conv_id", "turn").agg(F.min_by("frame_id", near).alias("frame_id"))


@query(
    "k37_segment_distance",
    f"""SELECT f.frame_id, CAST(min(greatest(0, s.start_ms - f.at_ms, f.at_ms - s.end_ms)) AS BIGINT) AS gap_ms FROM ({SEGMENTS_SQL}) s JOIN ({FRAMES_SQL}) f USING (conv_id) WHERE f.event_type = 'signup' GROUP BY f.frame_id""",
)
def k37_segment_distance(spark, sf_dir):
    """Distance from a frame to the nearest segment of its video, 0 inside one."""
    met = frames(spark, sf_dir).where("event_type = 'signup'").join(segments(spark, sf_dir).select("conv_id", "start_ms", "end_ms"), "conv_id")
    return met.groupBy("frame_id").agg(F.min(F.expr("greatest(0L, start_ms - at_ms, at_ms - end_ms)")).alias("gap_ms"))


BINDINGS = (
    "(1, DATE '2024-01-01', DATE '2024-03-31'), (2, DATE '2024-04-01', CAST(NULL AS DATE)), (3, CAST(NULL AS DATE), DATE '2024-01-31'),"
    "(4, CAST(NULL AS DATE), CAST(NULL AS DATE)), (5, DATE '2024-03-31', DATE '2024-03-31'), (6, DATE '2025-01-01', DATE '2025-12-31')"
)


@query(
    "f5_binding_overlap",
    f"""SELECT binding_id, (s IS NOT NULL OR e IS NOT NULL) AND (e IS NULL OR e >= DATE '2024-03-31') AND (s IS NULL OR s <= DATE '2024-06-30') AS overlaps FROM (VALUES {BINDINGS}) AS t(binding_id, s, e)""",
    over=BINDINGS, key="binding_id",
)
def f5_binding_overlap(spark, sf_dir):
    """Temporal bindings that meet the second quarter: closed intervals, open ends unbounded, no ends no match."""
    lo, hi = F.lit("2024-03-31").cast("date"), F.lit("2024-06-30").cast("date")
    return dealt(spark, sf_dir, BINDINGS, "binding_id, s, e").select("binding_id", iv.overlaps_closed(F.col("s"), F.col("e"), lo, hi).alias("overlaps"))


OCR = "(1, 0, 1000, 1000, 2000), (2, 0, 1000, 999, 2000), (3, 0, CAST(NULL AS INT), 5000, 6000), (4, 500, 600, 0, 5000)"


@query("j12_ocr_overlap", f"SELECT pair, (a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL) OR (a < d AND c < b) AS overlaps FROM (VALUES {OCR}) AS t(pair, a, b, c, d)", over=OCR, key="pair")
def j12_ocr_overlap(spark, sf_dir):
    """Claim evidence against on-screen text: strict overlap, unknown bounds match."""
    return dealt(spark, sf_dir, OCR, "pair, a, b, c, d").select("pair", iv.overlaps_open(*map(F.col, "abcd")).alias("overlaps"))


@query(
    "w1_chapters",
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT conv_id, turn, start_ms, end_ms FROM ({SEGMENTS_SQL})),
    g AS (SELECT conv_id, turn, start_ms AS gs, end_ms, 0 AS grp FROM s WHERE turn = 0
      UNION ALL SELECT s.conv_id, s.turn, CASE WHEN s.end_ms - g.gs > 30000 THEN s.start_ms ELSE g.gs END, s.end_ms, CASE WHEN s.end_ms - g.gs > 30000 THEN g.grp + 1 ELSE g.grp END FROM g JOIN s ON s.conv_id = g.conv_id AND s.turn = g.turn + 1)
    SELECT conv_id, grp AS "group", min(turn) AS first_index, max(turn) AS last_index, max(gs) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM g GROUP BY conv_id, grp""",
)
def w1_chapters(spark, sf_dir):
    """Chapters: segments packed greedily up to 30 s."""
    return iv.pack(segments(spark, sf_dir), ["conv_id"], "turn", "start_ms", "end_ms", 30_000)


@query(
    "s6_cue_validation",
    f"""SELECT conv_id, count(*) AS n_cues, count(*) FILTER (NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= duration AND start_ms >= coalesce(p, 0))) AS n_invalid, count(*) <= 10000 AS within_limit
    FROM (SELECT *, lag(end_ms) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM ({SPOKEN_SQL})) GROUP BY conv_id""",
)
def s6_cue_validation(spark, sf_dir):
    """Subtitle cues that are empty, out of bounds or start before the one before has ended."""
    cues = spoken(spark, sf_dir).withColumn("p", F.lag("end_ms").over(Window.partitionBy("conv_id").orderBy("turn")))
    bad = F.expr("NOT (start_ms >= 0 AND start_ms < end_ms AND end_ms <= duration AND start_ms >= coalesce(p, 0))")
    return cues.groupBy("conv_id").agg(F.count("*").alias("n_cues"), F.count_if(bad).alias("n_invalid"), (F.count("*") <= 10_000).alias("within_limit"))
