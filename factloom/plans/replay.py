"""Replay queries: `orders` as snapshots with clocks of their own, `events` as the ledger they are replayed from."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import replay
from factloom.plans.asof import LEDGER_SQL, ledger
from factloom.plans.catalog import query, table

#: A snapshot of a claim (a tenth of the customers share one) is closed on the day of the month of its order; it knew what
#: was recorded up to half an hour before or one and a half hours after. An order in progress has no clocks yet.
CLAIMS = """SELECT o_orderkey, CAST(floor(o_custkey / 10) AS BIGINT) AS user_id, CASE WHEN o_orderstatus <> 'P' THEN {day} END AS business_as_of,
    CASE WHEN o_orderstatus <> 'P' THEN {day} + {minutes} END AS knowledge_as_of FROM orders"""
CLAIMS_SQL = CLAIMS.format(day="TIMESTAMP '2024-01-01' + to_days(CAST(day(o_orderdate) AS INTEGER))", minutes="to_minutes(CAST(o_totalprice AS BIGINT) % 120 - 30)")
#: Claims whose chain was tampered with (an event without a value), and those of before the ledger (a first event that is no signup).
FAULTS_SQL = "SELECT user_id, bool_or(value < 0.5) AS invalid, min_by(event_type, event_id) = 'error' AS incomplete FROM events GROUP BY user_id"


def claims(spark, sf_dir):
    day = "timestamp_ntz'2024-01-01' + make_dt_interval(day(o_orderdate))"
    return spark.sql(CLAIMS.format(day=day, minutes="make_dt_interval(0, 0, CAST(CAST(rint(o_totalprice) AS BIGINT) % 120 - 30 AS INT))").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def history_faults(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("value") < 0.5).alias("invalid"), (F.min_by("event_type", "event_id") == "error").alias("incomplete"))


@query(
    "l51_replay_at_own_clocks",
    f"""WITH c AS ({CLAIMS_SQL}), f AS ({FAULTS_SQL}), p AS (SELECT o_orderkey, max_by(event_type, struct_pack(a := ts, b := recorded, c := event_id)) AS status, max_by(event_id, struct_pack(a := ts, b := recorded, c := event_id)) AS event_id
        FROM c JOIN ({LEDGER_SQL}) e ON e.user_id = c.user_id AND e.ts <= c.business_as_of AND e.recorded <= c.knowledge_as_of GROUP BY o_orderkey),
    v AS (SELECT c.o_orderkey, p.status, p.event_id, CASE WHEN business_as_of IS NULL OR knowledge_as_of IS NULL THEN '{replay.CLOCK_MISSING}' WHEN f.invalid THEN '{replay.HISTORY_INVALID}'
        WHEN coalesce(f.incomplete, false) OR p.o_orderkey IS NULL THEN '{replay.HISTORY_INCOMPLETE}' ELSE 'OK' END AS verdict FROM c LEFT JOIN f USING (user_id) LEFT JOIN p USING (o_orderkey))
    SELECT o_orderkey, verdict, CASE WHEN verdict = 'OK' THEN status END AS status, CASE WHEN verdict = 'OK' THEN event_id END AS event_id FROM v""",
)
def l51_replay_at_own_clocks(spark, sf_dir):
    """State of every snapshot's claim at the snapshot's own clocks, or the reason why it can't be replayed."""
    events = ledger(spark, sf_dir).withColumnRenamed("event_type", "status")
    found = replay.project_each(claims(spark, sf_dir), events, "user_id", "business_as_of", "knowledge_as_of", "ts", "recorded", "event_id", ["status", "event_id"], history_faults(spark, sf_dir))
    return found.select("o_orderkey", "verdict", "status", "event_id")


@query(
    "l51_payloads_at_own_clocks",
    f"""SELECT o_orderkey, event_type AS field, max_by(value, struct_pack(a := ts, b := recorded, c := event_id)) AS value FROM ({CLAIMS_SQL}) c
    JOIN ({LEDGER_SQL}) e ON e.user_id = c.user_id AND e.ts <= c.business_as_of AND e.recorded <= c.knowledge_as_of GROUP BY ALL""",
)
def l51_payloads_at_own_clocks(spark, sf_dir):
    """The payload folded from the events that each snapshot could see, field by field."""
    events = ledger(spark, sf_dir).withColumnRenamed("event_type", "field")
    return replay.fold_each(claims(spark, sf_dir), events, "user_id", "business_as_of", "knowledge_as_of", "ts", "recorded", "event_id", "field", "value", "o_orderkey")


#: A customer's orders of a year are refreshes of one snapshot; urgent first ones name the last as their parent (a cycle),
#: first ones in progress a parent that was never stored, and those of high priority also supersede the one before the last.
SNAPSHOTS_SQL = """SELECT o_orderkey AS id, o_orderstatus = 'F' AS wanted, CASE WHEN before IS NOT NULL THEN before WHEN o_orderstatus = 'P' THEN -1 - o_orderkey WHEN o_orderpriority = '1-URGENT' THEN newest END AS parent,
    CASE WHEN o_orderpriority = '2-HIGH' THEN earlier END AS supersedes FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS before,
    lag(o_orderkey, 2) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS earlier,
    max_by(o_orderkey, struct(o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS newest FROM orders) AS o"""
WALK_SQL = f"""WITH RECURSIVE s AS MATERIALIZED ({SNAPSHOTS_SQL.replace("struct(o_orderdate, o_orderkey)", "struct_pack(a := o_orderdate, b := o_orderkey)")}),
    e AS MATERIALIZED (SELECT id, parent AS p FROM s WHERE parent IS NOT NULL UNION SELECT id, supersedes FROM s WHERE supersedes IS NOT NULL),
    w AS (SELECT id AS root, id AS node FROM s WHERE wanted UNION SELECT w.root, e.p FROM w JOIN e ON e.id = w.node WHERE e.p >= 0),
    c AS (SELECT id AS root, p AS node FROM e UNION SELECT c.root, e.p FROM c JOIN e ON e.id = c.node),
    stuck AS (SELECT DISTINCT root AS node FROM c WHERE node IN (SELECT root FROM c WHERE root = node)),
    faults AS (SELECT root, '{replay.MISSING}' AS code, node AS snapshot, e.p AS parent FROM w JOIN e ON e.id = w.node WHERE e.p < 0
        UNION ALL SELECT root, '{replay.CYCLE}', min(node), NULL FROM w WHERE node IN (SELECT node FROM stuck) GROUP BY root)"""


def walked(spark, sf_dir):
    held = spark.sql(SNAPSHOTS_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return replay.ancestry(held.where("wanted").select("id"), held, "id", ["parent", "supersedes"])


@query("l49_snapshot_ancestry", WALK_SQL + " SELECT root, node AS snapshot FROM w WHERE root NOT IN (SELECT root FROM faults)")
def l49_snapshot_ancestry(spark, sf_dir):
    """All that each wanted snapshot with a sound ancestry was derived from."""
    reached, faults = walked(spark, sf_dir)
    return reached.join(faults.select("root").distinct(), "root", "left_anti").select("root", "snapshot")


@query("l49_ancestry_faults", WALK_SQL + " SELECT root, code, snapshot, parent FROM faults")
def l49_ancestry_faults(spark, sf_dir):
    """Missing parents and cycles in the ancestry of wanted snapshots."""
    return walked(spark, sf_dir)[1]


#: Events up to the 19th are stored. Later ones come as a batch: errors with a wrong hash, signups that name no event of the
#: chain; the others name the sound one before. Purchases from the 19th on are sent a second time after all others.
CHAIN = """SELECT user_id, event_id, ts, event_type, ts < TIMESTAMP{ntz} '2024-01-20 00:00:00' AS stored, {sha}concat(event_type, '|', CAST(event_id AS {text})){end} AS hash FROM {events}"""
SENT = """SELECT user_id, event_id, event_type, ts, stored, hash, concat(event_type, '|', CAST(event_id AS {text})) AS logical, stored OR event_type NOT IN ('error', 'signup') AS sound FROM chain"""
LINKED = """SELECT *, CASE WHEN sound THEN lag(hash) OVER (PARTITION BY user_id, sound ORDER BY event_id) ELSE 'elsewhere' END AS previous_hash FROM sent"""
BATCH = """SELECT user_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'forged' ELSE hash END AS event_hash, previous_hash, logical, hash AS right_hash FROM linked WHERE NOT stored
    UNION ALL SELECT user_id, event_id + 1000000000, hash, previous_hash, logical, hash FROM linked WHERE event_type = 'purchase' AND ts >= TIMESTAMP{ntz} '2024-01-19 00:00:00'"""
_DUCK = {"ntz": "", "sha": "sha256(", "end": ")", "text": "VARCHAR", "events": "events"}
_SPARK = {"ntz": "_NTZ", "sha": "sha2(", "end": ", 256)", "text": "STRING", "events": "{events}"}


@query(
    "l58_event_appends",
    f"""WITH RECURSIVE chain AS ({CHAIN.format(**_DUCK)}), sent AS ({SENT.format(**_DUCK)}), linked AS MATERIALIZED ({LINKED}), batch AS MATERIALIZED ({BATCH.format(**_DUCK)}),
    fresh AS MATERIALIZED (SELECT * FROM batch WHERE event_hash = right_hash AND logical NOT IN (SELECT logical FROM linked WHERE stored)),
    ends AS (SELECT user_id, max_by(hash, event_id) AS h FROM linked WHERE stored GROUP BY user_id),
    nodes AS (SELECT user_id, -1 AS seq, h FROM ends UNION ALL SELECT user_id, seq, event_hash FROM fresh),
    nexts AS MATERIALIZED (SELECT n.user_id, n.seq AS f, min(b.seq) AS t FROM nodes n JOIN fresh b ON b.user_id = n.user_id AND b.previous_hash = n.h AND b.seq > n.seq GROUP BY ALL),
    w AS (SELECT user_id, t FROM nexts WHERE f = -1 UNION ALL SELECT user_id, min(seq) FROM fresh WHERE user_id NOT IN (SELECT user_id FROM ends) GROUP BY user_id UNION ALL SELECT n.user_id, n.t FROM w JOIN nexts n ON n.user_id = w.user_id AND n.f = w.t)
    SELECT user_id, seq, CASE WHEN event_hash <> right_hash THEN '{replay.WRONG_HASH}' WHEN logical IN (SELECT logical FROM linked WHERE stored) THEN '{replay.REPEATED}' WHEN seq IN (SELECT t FROM w) THEN '{replay.APPENDED}'
        WHEN EXISTS (SELECT 1 FROM w JOIN fresh x ON x.seq = w.t WHERE x.logical = b.logical AND x.seq < b.seq) THEN '{replay.REPEATED}' ELSE '{replay.FORKED}' END AS verdict FROM batch b""",
)
def l58_event_appends(spark, sf_dir):
    """What becomes of a batch of events that are appended to their claims' chains."""
    sql = f"WITH chain AS ({CHAIN.format(**_SPARK)}), sent AS ({SENT.format(**_SPARK)}), linked AS ({LINKED}) "
    events = table(spark, sf_dir, "events")
    batch = spark.sql(sql + BATCH.format(**_SPARK), events=events)
    stored = spark.sql(sql + "SELECT user_id, hash AS event_hash, previous_hash, logical FROM linked WHERE stored", events=events)
    return replay.append(stored, batch, "user_id", "seq", "event_hash", "previous_hash", "logical", F.col("right_hash")).select("user_id", "seq", "verdict")
