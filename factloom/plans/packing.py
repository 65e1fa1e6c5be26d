"""Packing queries: lines of `documents` and turns of `conversations` in blocks of a model's token budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import packing
from factloom.plans.catalog import query, table

#: Tokens of a block, and rows that it repeats at most.
BUDGET, OVERLAP = 700, 12

_COST = r"greatest(1, CAST(ceil((length(x) - length(regexp_replace(x, '[\x00-\x7F]', '', 'g'))) / 4) AS BIGINT) + length(regexp_replace(x, '[\x00-\x7F]', '', 'g')))"
BLOCKS_SQL = """WITH RECURSIVE i AS MATERIALIZED (SELECT k, o, {cost} AS cost FROM ({items})), p AS MATERIALIZED (SELECT k, o, row_number() OVER w AS pos, cost, CAST(sum(cost) OVER w - cost AS BIGINT) AS total FROM i WINDOW w AS (PARTITION BY k ORDER BY o)),
    dear AS (SELECT k FROM p GROUP BY k HAVING max(cost) > {budget}), spans AS (SELECT k, max(pos) AS ends, max(total + cost) AS everything FROM p GROUP BY k),
    stops AS (SELECT k, total AS upto, pos AS "end" FROM p UNION ALL SELECT k, everything, ends + 1 FROM spans),
    e AS MATERIALIZED (SELECT p.k, p.pos, p.total, s."end", s.upto, n.ends FROM p ASOF JOIN stops s ON s.k = p.k AND p.total + {budget} >= s.upto JOIN spans n ON n.k = p.k WHERE p.k NOT IN (SELECT k FROM dear)),
    b AS (SELECT *, 0 AS block FROM e WHERE pos = 1 UNION ALL SELECT e.*, b.block + 1 FROM b JOIN e ON e.k = b.k AND b."end" <= b.ends AND e.pos = b."end" - least({overlap}, (b."end" - b.pos) // 3))
    SELECT b.k AS "{key}", b.block, f.o AS first, l.o AS last, b."end" - b.pos AS n, b.upto - b.total AS total, NULL AS fault FROM b JOIN p f ON f.k = b.k AND f.pos = b.pos JOIN p l ON l.k = b.k AND l.pos = b."end" - 1
    UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, '{fault}' FROM dear"""
_LINES = "SELECT doc_id AS k, unnest(range(len(lines)::BIGINT)) AS o, unnest(lines) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"


@query("w3_line_blocks", BLOCKS_SQL.format(cost=_COST, items=_LINES, key="doc_id", budget=BUDGET, overlap=OVERLAP, fault=packing.TOO_LARGE))
def w3_line_blocks(spark, sf_dir):
    """Each document's lines in overlapping blocks that a model's window holds."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    costs = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.greatest(F.lit(1), tx.token_estimate(F.col("text"))).alias("tokens"))
    return packing.budget_blocks(costs, ["doc_id"], "line", "tokens", BUDGET, OVERLAP)


@query("w3_transcript_blocks", BLOCKS_SQL.format(cost=_COST, items="SELECT 0 AS k, conv_id * 1000 + turn AS o, text AS x FROM conversations", key="transcript", budget=BUDGET, overlap=OVERLAP, fault=packing.TOO_LARGE).replace("b.k AS", "b.k::INTEGER AS"))
def w3_transcript_blocks(spark, sf_dir):
    """All turns as one long transcript: a single key whose blocks no task sees as a whole."""
    turns = table(spark, sf_dir, "conversations").select(F.lit(0).alias("transcript"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), F.greatest(F.lit(1), tx.token_estimate(F.col("text"))).alias("tokens"))
    return packing.budget_blocks(turns, ["transcript"], "turn", "tokens", BUDGET, OVERLAP)
