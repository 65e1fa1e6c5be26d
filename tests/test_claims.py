"""Rejections of claim drafts against a plain walk through the rules."""

import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import claims

TEXTS = {0: "Acme Corp 营收 12% up", 1: "如果价格下降 then", 2: "逻辑证伪 here", 3: "plain words Only", 4: "价格 rose 5元", 5: "去年 it fell", 7: "after a gap"}
BASE = {
    "draft_id": 0, "media_id": 1, "semantic_segment_id": "s0", "quality": "PASS", "claim_type": "OPINION", "quote": "plain words", "statement": "plain words", "subject_key": "plain", "subject_name": None, "predicate": "words",
    "object_text": None, "object_value": None, "condition_text": None, "invalidation_text": None, "sentiment": "NEUTRAL", "assertion_tense": "UNKNOWN", "confidence": 0.5, "evidence": [3], "condition_evidence": None, "invalidation_evidence": [],
    "expressions": None, "anchors": None, "role": None, "scope": None,
}
ANCHOR = {"frame_id": "f", "bbox": [0.0, 0.0, 1.0, 1.0], "ocr_text": "t", "visual_label": None, "model_id": "m", "model_version": "1", "confidence": 1.0, "support_type": "OCR"}
THESIS = {"role": "THESIS", "evidence": [3, 4, 5], "scope": {"first": 3, "last": 5, "proposal": [3], "argument": [3, 4], "conclusion": [5]}}


def said(raw, target=None, evidence=(3,), confidence=1.0):
    return {"raw": raw, "target": target, "evidence": list(evidence) if evidence is not None else None, "confidence": confidence}


CASES = [
    (None, {}),
    ("TRANSCRIPT_QUALITY_NOT_PASS", {"quality": None, "statement": ""}),
    ("SCHEMA_INVALID", {"statement": ""}), ("SCHEMA_INVALID", {"quote": None}), ("SCHEMA_INVALID", {"evidence": []}), ("SCHEMA_INVALID", {"evidence": None}), ("SCHEMA_INVALID", {"confidence": 1.5}), ("SCHEMA_INVALID", {"confidence": float("nan")}),
    ("SCHEMA_INVALID", {"sentiment": "HAPPY"}), ("SCHEMA_INVALID", {"claim_type": None}), ("SCHEMA_INVALID", {"anchors": [ANCHOR | {"bbox": [1.0]}]}), ("SCHEMA_INVALID", {"anchors": [ANCHOR | {"ocr_text": ""}]}), ("SCHEMA_INVALID", {"expressions": [said("plain", evidence=())]}),
    ("SEMANTIC_SEGMENT_MISMATCH", {"semantic_segment_id": "s9", "evidence": [99]}), ("SEMANTIC_SEGMENT_MISMATCH", {"media_id": 2}),
    ("EVIDENCE_COORDINATE_INVALID", {"evidence": [3, 7]}), ("EVIDENCE_COORDINATE_INVALID", {"evidence": [6]}), ("EVIDENCE_COORDINATE_INVALID", {"condition_evidence": [44]}), ("EVIDENCE_COORDINATE_INVALID", {"expressions": [said("plain", evidence=(9,))]}),
    ("QUOTE_NOT_VERBATIM", {"quote": "plain word s"}), (None, {"quote": "  PLAIN words "}), (None, {"evidence": [3, 2], "quote": "plain"}), (None, {"evidence": [3, 2], "quote": "Only 逻辑", "statement": "Only 逻辑"}), ("QUOTE_NOT_VERBATIM", {"evidence": [2, 3], "quote": "Only 逻辑"}),
    ("NOT_ATOMIC", {"statement": "plain; words"}), (None, {"statement": "plain words;"}), ("NOT_ATOMIC", {"statement": "营收以及利润"}),
    ("CONDITION_NOT_GROUNDED", {"evidence": [1], "quote": "如果价格"}), ("INVALIDATION_NOT_GROUNDED", {"evidence": [2], "quote": "证伪"}), ("CONDITION_NOT_GROUNDED", {"condition_text": "plain"}), ("CONDITION_NOT_GROUNDED", {"condition_text": "plain", "condition_evidence": [2]}),
    ("INVALIDATION_NOT_GROUNDED", {"condition_text": "plain", "condition_evidence": [3], "invalidation_text": "x", "invalidation_evidence": [3]}),
    ("HARD_FACT_MISMATCH", {"statement": "plain 12%"}), (None, {"evidence": [0, 3], "statement": "plain 12％"}), ("HARD_FACT_MISMATCH", {"statement": "plain 600519"}),
    ("PREDICATE_MISMATCH", {"predicate": "verbs", "object_text": "nothing"}), ("HARD_FACT_MISMATCH", {"object_text": "nothing"}), ("HARD_FACT_MISMATCH", {"object_value": "7"}), ("SUBJECT_MISMATCH", {"subject_key": "other"}), ("SUBJECT_MISMATCH", {"subject_key": "", "subject_name": "other"}), (None, {"subject_key": ""}),
    ("POLARITY_MISMATCH", {"statement": "plain 增长"}), ("TENSE_MISMATCH", {"statement": "plain 去年"}), ("TENSE_MISMATCH", {"assertion_tense": "FUTURE"}), (None, {"assertion_tense": "PRESENT"}),
    ("ENTITY_MISMATCH", {"statement": "plain Globex"}), ("ENTITY_MISMATCH", {"statement": "plain 苹果"}), (None, {"statement": "plain 公司"}), (None, {"statement": "plain only"}),
    ("TEMPORAL_NOT_GROUNDED", {"expressions": [said("明日")]}), ("TEMPORAL_NOT_GROUNDED", {"expressions": [said("plain", "Q3")]}), (None, {"expressions": [said("plain", "plain"), said("ONLY", "words")]}),
    ("VISUAL_ANCHOR_INVALID", {"anchors": [ANCHOR | {"frame_id": ""}]}), ("VISUAL_ANCHOR_INVALID", {"anchors": [ANCHOR, ANCHOR | {"bbox": [0.0, float("inf"), 0.0, 0.0]}]}), (None, {"anchors": [ANCHOR | {"support_type": "INFERRED_VISUAL"}]}),
    ("INFERRED_VISUAL_HIGH_RISK", {"evidence": [4], "quote": "rose", "statement": "rose 5元", "subject_key": "", "predicate": "rose", "anchors": [ANCHOR | {"support_type": "INFERRED_VISUAL"}]}),
    (None, THESIS), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"evidence": [3, 5]}), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"scope": None}), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"scope": THESIS["scope"] | {"argument": [2]}}), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"scope": THESIS["scope"] | {"last": 6}}),
    ("EVIDENCE_COORDINATE_INVALID", THESIS | {"scope": THESIS["scope"] | {"proposal": [4], "argument": [3]}}), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"scope": THESIS["scope"] | {"conclusion": []}}), ("EVIDENCE_COORDINATE_INVALID", THESIS | {"semantic_segment_id": "s1"}), ("TENSE_MISMATCH", {"evidence": [3, 5]}),
]


def test_every_rule(spark):
    drafts = spark.createDataFrame([BASE | changes | {"draft_id": i} for i, (_, changes) in enumerate(CASES)], claims.DRAFT)
    transcript = spark.createDataFrame([(1, i, t) for i, t in TEXTS.items()], "media_id long, segment_index int, text string")
    segments = spark.createDataFrame([(1, "s0", 0, 6), (1, "s1", 7, 9)], "media_id long, semantic_segment_id string, start_index int, end_index int")
    got = {r.draft_id: r.rejection for r in claims.rejections(drafts, transcript, segments).collect()}
    assert [(i, got[i]) for i in range(len(CASES))] == [(i, want) for i, (want, _) in enumerate(CASES)]
    assert {w for w, _ in CASES} >= {"SCHEMA_INVALID", "VISUAL_ANCHOR_INVALID", "INFERRED_VISUAL_HIGH_RISK", None} and len({w for w, _ in CASES}) == 18


@pytest.mark.parametrize("text", ["人民币 5 亿元 and 12.5% of 600519 in 2024年 Q3 2024", "一百五十元，三季度 2024-03-01日", "1234567 12", ""])
def test_numbers(spark, text):
    want = {re.sub(r"\s+", "", t).replace("％", "%").upper() for p in claims.NUMBER_PATTERNS for t in re.findall(p, text)}
    assert set(spark.createDataFrame([(text,)], "t string").select(claims.numbers(F.col("t")).alias("n")).first().n) == want


def test_conflicts_are_dealt_to_more_tasks_as_a_table_has_more_splits(spark, tmp_path):
    from factloom.plans import aggregates

    sql = "SELECT id % 50 AS l_partkey, id AS l_orderkey, 1 AS l_linenumber, CAST(id % 3 AS DOUBLE) AS l_quantity, 0.0D AS l_discount, 1L AS l_suppkey, TIMESTAMP_NTZ'1995-01-02 00:00:00' AS l_shipdate FROM range(600)"
    spark.sql(sql).repartition(6).write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        splits = spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions()
        found = aggregates.g1_conflicts(spark, str(tmp_path))
        assert splits >= 6 and found.rdd.getNumPartitions() == 8 * splits
        got = {(r.l_partkey, r.n_claims, r.n_values, r.first_id) for r in found.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {(k, 12, 3, k * 10 + 1) for k in range(50)}
