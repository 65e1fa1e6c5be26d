"""Claim drafts made of `conversations`: each turn is a draft that cites its transcript, most with one thing wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import claims
from factloom.plans.catalog import query, table

#: What a turn's transcript says beside its text, and the draft's fields, by v (the length of the text modulo 24). Semantic
#: segments are runs of four turns; a turn of the system names none. v = 1 and 23 are theses over the run up to the turn.
SAID = "concat(text, CASE v WHEN 4 THEN ' 如果价格下降' WHEN 5 THEN ' 逻辑证伪' WHEN 19 THEN ' 12%' ELSE '' END)"
FIELDS = {
    "draft_id": "conv_id * 1000 + turn", "media_id": "conv_id", "semantic_segment_id": "CASE WHEN role = 'system' THEN 'none' ELSE concat('s', CAST(run AS {text})) END", "quality": "CASE WHEN v = 21 THEN 'REVIEW' ELSE 'PASS' END",
    "claim_type": "'OPINION'", "quote": "CASE v WHEN 3 THEN 'nowhere said' WHEN 4 THEN '如果价格下降' WHEN 5 THEN '逻辑证伪' ELSE substr(text, 1, 30) END",
    "statement": "CASE v WHEN 8 THEN concat(substr(text, 1, 30), ' 12%') WHEN 13 THEN concat(substr(text, 1, 30), ' 增长') WHEN 14 THEN concat(substr(text, 1, 30), ' 去年') WHEN 16 THEN concat(substr(text, 1, 30), ' Zzzzz') WHEN 19 THEN concat(substr(text, 1, 30), ' 12%') WHEN 20 THEN concat(substr(text, 1, 30), '；', text) WHEN 22 THEN '' ELSE substr(text, 1, 30) END",
    "subject_key": "CASE WHEN v = 12 THEN 'zzzz' ELSE substr(text, 1, 5) END", "subject_name": "CAST(NULL AS {text})", "predicate": "CASE WHEN v = 9 THEN 'zzzz' ELSE substr(text, 1, 3) END",
    "object_text": "CASE WHEN v = 10 THEN 'zzzz' ELSE substr(text, 5, 4) END", "object_value": "CASE WHEN v = 11 THEN '987654' END",
    "condition_text": "CASE v WHEN 6 THEN 'not said' WHEN 0 THEN substr(text, 3, 8) END", "invalidation_text": "CASE v WHEN 7 THEN 'not said' WHEN 0 THEN substr(text, 2, 6) END",
    "sentiment": "'NEUTRAL'", "assertion_tense": "CASE WHEN v = 15 THEN 'FUTURE' ELSE 'UNKNOWN' END",
}
_ROWS = "SELECT *, CAST(length(text) % 24 AS INT) AS v, CAST(floor(turn / 4) AS INT) AS run, CAST(turn AS INT) AS t FROM {conversations}"


def drafts(spark, sf_dir):
    rows = spark.sql(_ROWS, conversations=table(spark, sf_dir, "conversations"))
    thesis = F.col("v").isin(1, 23)
    first = F.col("run") * 4
    own = F.array("t")
    anchor = F.struct(F.when(F.col("v") == 18, "").otherwise("f").alias("frame_id"), F.array(*[F.lit(float(i)) for i in range(4)]).alias("bbox"), F.lit("text").alias("ocr_text"), F.lit(None).cast("string").alias("visual_label"), F.lit("m").alias("model_id"), F.lit("1").alias("model_version"), F.lit(0.5).alias("confidence"), F.when(F.col("v") == 19, "INFERRED_VISUAL").otherwise("OCR").alias("support_type"))
    said = F.struct(F.when(F.col("v") == 17, "明日").otherwise(F.substring("text", 1, 4)).alias("raw"), F.when(F.col("v") == 0, F.substring("text", 2, 3)).alias("target"), own.alias("evidence"), F.lit(1.0).alias("confidence"))
    scope = F.struct(first.alias("first"), F.col("t").alias("last"), F.array(F.when(F.col("v") == 23, F.col("t")).otherwise(first)).alias("proposal"), F.array(first).alias("argument"), own.alias("conclusion"))
    return rows.select(
        *[F.expr(sql.format(text="STRING")).alias(name) for name, sql in FIELDS.items()],
        F.lit(1.0).alias("confidence"), F.when(F.col("v") == 2, F.array(F.col("t") + 40)).when(thesis, F.sequence(first, F.col("t"))).otherwise(own).alias("evidence"), own.alias("condition_evidence"), own.alias("invalidation_evidence"),
        F.when(F.col("v").isin(0, 17), F.array(said)).alias("expressions"), F.when(F.col("v").isin(18, 19), F.array(anchor)).alias("anchors"), F.when(thesis, "THESIS").alias("role"), F.when(thesis, scope).alias("scope"),
    )


_NUM = r"\b[0-9]{6}\b|[0-9]+(?:[.,][0-9]+)?(?:%|％|万亿|亿|万|百万|千|元)|[零一二三四五六七八九十百千万亿两]+(?:元|年|月|日|季度|%)?"
_DUCK = ", ".join(f"{sql.format(text='VARCHAR')} AS {name}" for name, sql in FIELDS.items())
_NEG, _POS, _IF, _WILL, _WAS = ("|".join(terms) for terms in (claims.NEGATIVE, claims.POSITIVE, claims.CONDITION_MARKS, claims.FUTURE, claims.PAST))


def _pol(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NEG}') THEN 'NEGATIVE' WHEN regexp_matches({x}, '{_POS}') THEN 'POSITIVE' ELSE 'NEUTRAL' END"


def _tense(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_IF}') THEN 'CONDITIONAL' WHEN regexp_matches({x}, '{_WILL}') THEN 'FUTURE' WHEN regexp_matches({x}, '{_WAS}') THEN 'PAST' WHEN {x} <> '' THEN 'PRESENT' ELSE 'UNKNOWN' END"


def _held(needle: str, hay: str) -> str:
    return f"contains(lower({hay}), trim(lower({needle}), ' ' || chr(9) || chr(10) || chr(13)))"


REJECTIONS_SQL = f"""WITH r AS (SELECT *, length(text) % 24 AS v, turn // 4 AS run FROM conversations), said AS (SELECT conv_id, list({SAID} ORDER BY turn) AS texts FROM r GROUP BY conv_id),
    d AS (SELECT {_DUCK}, v, turn, run, texts, v IN (1, 23) AS thesis, CASE WHEN v = 2 THEN turn + 40 ELSE turn END AS upto, CASE WHEN v IN (1, 23) THEN run * 4 WHEN v = 2 THEN turn + 40 ELSE turn END AS since, texts[turn + 1] AS own FROM r JOIN said USING (conv_id)),
    p AS (SELECT *, array_to_string(texts[since + 1 : upto + 1], ' ') AS prim FROM d), q AS (SELECT *, CASE WHEN thesis THEN quote ELSE prim END AS al FROM p)
    SELECT draft_id, CASE WHEN quality <> 'PASS' THEN 'TRANSCRIPT_QUALITY_NOT_PASS' WHEN quote = '' OR statement = '' OR predicate = '' THEN 'SCHEMA_INVALID' WHEN semantic_segment_id = 'none' THEN 'SEMANTIC_SEGMENT_MISMATCH'
      WHEN upto >= len(texts) OR upto > run * 4 + 3 OR v = 23 AND turn > run * 4 THEN 'EVIDENCE_COORDINATE_INVALID' WHEN NOT {_held("quote", "prim")} THEN 'QUOTE_NOT_VERBATIM'
      WHEN len(list_filter(regexp_split_to_array(statement, '[；;。！？!?]'), lambda c: trim(c) <> '')) <> 1 OR regexp_matches(statement, '{claims.JOINED}') THEN 'NOT_ATOMIC'
      WHEN regexp_matches(quote, '{_IF}') AND condition_text IS NULL THEN 'CONDITION_NOT_GROUNDED' WHEN regexp_matches(quote, '{"|".join(claims.INVALIDATION_MARKS)}') AND invalidation_text IS NULL THEN 'INVALIDATION_NOT_GROUNDED'
      WHEN NOT {_held("condition_text", "own")} THEN 'CONDITION_NOT_GROUNDED' WHEN NOT {_held("invalidation_text", "own")} THEN 'INVALIDATION_NOT_GROUNDED'
      WHEN len(list_filter(regexp_extract_all(statement, '{_NUM}'), lambda n: NOT list_contains(regexp_extract_all(al, '{_NUM}'), n))) > 0 THEN 'HARD_FACT_MISMATCH' WHEN NOT {_held("predicate", "al")} THEN 'PREDICATE_MISMATCH'
      WHEN NOT {_held("object_text", "al")} OR NOT {_held("object_value", "al")} THEN 'HARD_FACT_MISMATCH' WHEN NOT {_held("subject_key", "al")} THEN 'SUBJECT_MISMATCH'
      WHEN {_pol("statement")} <> {_pol("al")} AND {_pol("statement")} <> 'NEUTRAL' THEN 'POLARITY_MISMATCH' WHEN {_tense("statement")} <> {_tense("al")} OR assertion_tense <> 'UNKNOWN' AND assertion_tense <> {_tense("al")} THEN 'TENSE_MISMATCH'
      WHEN len(list_filter(regexp_extract_all(statement, '\\b[A-Z][A-Za-z0-9.&-]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda e: NOT contains(lower(al), lower(e)) AND NOT list_contains({list(claims.NO_ENTITIES)}, e))) > 0 THEN 'ENTITY_MISMATCH'
      WHEN v = 17 THEN 'TEMPORAL_NOT_GROUNDED' WHEN v = 18 THEN 'VISUAL_ANCHOR_INVALID' WHEN v = 19 THEN 'INFERRED_VISUAL_HIGH_RISK' END AS rejection FROM q"""


@query("k2_draft_rejections", REJECTIONS_SQL)
def k2_draft_rejections(spark, sf_dir):
    """The first rule that each claim draft breaks."""
    turns = spark.sql(_ROWS, conversations=table(spark, sf_dir, "conversations"))
    transcript = turns.selectExpr("conv_id AS media_id", "t AS segment_index", f"{SAID} AS text")
    segments = turns.selectExpr("conv_id AS media_id", "concat('s', run) AS semantic_segment_id", "run * 4 AS start_index", "run * 4 + 3 AS end_index").distinct()
    return claims.rejections(drafts(spark, sf_dir), transcript, segments)
