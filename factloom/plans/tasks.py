"""Task queries: `events` as requests to task runs and as effects that workers send under a fence."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.catalog import query, table
from factloom.streaming import run, tasks

#: A user's signups are workers that ask for the task's lease; the others act for the latest of them, some views with the
#: token before. Errors are releases or operators' actions by their value.
REQUESTS = """SELECT user_id AS task_id, event_id AS seq, ts AS at, CASE event_type WHEN 'signup' THEN 'acquire' WHEN 'view' THEN 'renew' WHEN 'click' THEN 'checkpoint' WHEN 'purchase' THEN 'transition' ELSE
    CASE WHEN value < 3 THEN 'release' WHEN value < 5 THEN 'pause' WHEN value < 20 THEN 'resume' WHEN value < 22 THEN 'retry' WHEN value < 22.2 THEN 'invalidate' WHEN value < 26 THEN 'rebuild' WHEN value < 27 THEN 'explode' ELSE 'renew' END END AS action,
    concat('w', CAST(last_value(CASE WHEN event_type = 'signup' THEN CASE WHEN k % 7 = 0 THEN k % 3 ELSE 1 END END{ignored}){ignoring} OVER w AS {text})) AS owner,
    CAST((count(CASE WHEN event_type = 'signup' AND k % 7 <> 0 THEN 1 END) OVER w) - CASE WHEN event_type = 'view' AND value < 5 THEN 1 ELSE 0 END AS BIGINT) AS token,
    CAST(CASE WHEN event_type = 'signup' THEN 345600 ELSE 172800 END AS BIGINT) AS ttl_s,
    CASE WHEN value < 10 THEN 'PAUSED' WHEN value < 25 THEN 'RETRYING' WHEN value < 60 THEN 'RUNNING' WHEN value < 65 THEN 'FAILED' WHEN value < 65.5 THEN 'SUCCEEDED' ELSE 'PAUSED' END AS target
    FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM {events}) AS e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
_DUCK = {"ignored": " IGNORE NULLS", "ignoring": "", "text": "VARCHAR", "k": "props::JSON->>'k'", "events": "events"}
REQUESTS_SQL = REQUESTS.format(**_DUCK)


def requests(spark, sf_dir):
    sql = REQUESTS.format(ignored="", ignoring=" IGNORE NULLS", text="STRING", k="get_json_object(props, '$.k')", events="{events}")
    return spark.sql(sql, events=table(spark, sf_dir, "events")).withColumn("at", F.col("at").cast("timestamp"))


#: One step a request: what it comes to under the state before it, then the state after it.
STEPS_SQL = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, epoch_us("at") // 1000 AS ms, row_number() OVER (PARTITION BY task_id ORDER BY "at", seq) AS i FROM ({REQUESTS_SQL})),
    s AS (SELECT task_id, 0::BIGINT AS i, 'PENDING' AS state, NULL::VARCHAR AS owner, 0::BIGINT AS token, NULL::BIGINT AS until, 0::BIGINT AS attempt, false AS reported, NULL::VARCHAR AS outcome, NULL::VARCHAR AS o_owner, NULL::BIGINT AS o_until, NULL::VARCHAR AS o_state, NULL::BIGINT AS o_token, NULL::BIGINT AS o_attempt, false AS expired FROM (SELECT DISTINCT task_id FROM r)
      UNION ALL SELECT task_id, i,
        CASE WHEN o <> 'OK' THEN state WHEN action IN ('acquire', 'resume') THEN 'RUNNING' WHEN action = 'transition' THEN target WHEN action = 'pause' THEN 'PAUSED' WHEN action IN ('retry', 'rebuild') THEN 'RETRYING' WHEN action = 'invalidate' THEN 'INVALIDATED' ELSE state END,
        CASE WHEN o <> 'OK' THEN owner WHEN action = 'acquire' THEN asking WHEN action IN ('release', 'invalidate', 'rebuild') OR action = 'transition' AND target IN ('SUCCEEDED', 'FAILED') THEN NULL ELSE owner END,
        CASE WHEN o = 'OK' AND action = 'acquire' THEN token + 1 ELSE token END, new_until,
        CASE WHEN o = 'OK' AND (action = 'rebuild' OR action = 'transition' AND target = 'RETRYING') THEN attempt + 1 ELSE attempt END,
        (reported OR expired) AND new_until IS NOT DISTINCT FROM until, o, owner, until, state, token, attempt, expired FROM
        (SELECT *, CASE WHEN o <> 'OK' THEN until WHEN action IN ('acquire', 'renew') THEN ms + 1000 * ttl_s WHEN action IN ('release', 'invalidate', 'rebuild') OR action = 'transition' AND target IN ('SUCCEEDED', 'FAILED') THEN NULL ELSE until END AS new_until FROM
        (SELECT s.task_id, r.i, s.state, s.owner, s.token, s.until, s.attempt, s.reported, r.action, r.owner AS asking, r.ms, r.ttl_s, r.target, s.until IS NOT NULL AND s.until <= r.ms AND NOT s.reported AS expired,
          CASE WHEN r.action = 'acquire' THEN CASE WHEN s.state IN ('SUCCEEDED', 'INVALIDATED') THEN 'TERMINAL' WHEN s.owner IS NOT NULL AND s.until > r.ms AND s.owner <> r.owner THEN 'HELD' ELSE 'OK' END
            WHEN r.action IN ('pause', 'resume', 'retry', 'invalidate', 'rebuild') THEN 'OK' WHEN r.action NOT IN ('renew', 'release', 'transition', 'checkpoint') THEN 'UNKNOWN'
            WHEN s.owner IS NULL OR s.owner IS DISTINCT FROM r.owner OR s.token <> r.token THEN 'STALE' WHEN s.until IS NULL OR s.until <= r.ms THEN 'EXPIRED'
            WHEN r.action = 'transition' AND NOT (s.state = 'RUNNING' AND r.target IN ('SUCCEEDED', 'FAILED', 'PAUSED', 'RETRYING') OR s.state = 'RETRYING' AND r.target IN ('RUNNING', 'FAILED') OR s.state = 'PAUSED' AND r.target IN ('RUNNING', 'INVALIDATED')) THEN 'ILLEGAL' ELSE 'OK' END AS o
          FROM s JOIN r ON r.task_id = s.task_id AND r.i = s.i + 1)))"""


@query(
    "q6_task_runs",
    STEPS_SQL
    + """ SELECT r.task_id, r.seq, r.ms AS at_ms, r.action, s.outcome, s.state, s.owner, s.token, s.attempt FROM s JOIN r USING (task_id, i)
    UNION ALL SELECT task_id, NULL, o_until, 'expire', 'OK', o_state, o_owner, o_token, o_attempt FROM s WHERE expired
    UNION ALL SELECT task_id, NULL, until, 'expire', 'OK', state, owner, token, attempt FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY i DESC) = 1) WHERE NOT reported AND until <= (SELECT max(ms) FROM r) - 600000""",
)
def q6_task_runs(spark, sf_dir):
    """What every request to a task run comes to, and every lease that ran out, from a stream with timers."""
    landed = f"{run.shared_folder(spark)}/landing"
    requests(spark, sf_dir).write.parquet(landed)
    found = run.available_now(tasks.task_runs(spark.readStream.schema(tasks.REQUEST).parquet(landed)), "append")
    return found.select("task_id", "seq", F.unix_millis("at").alias("at_ms"), "action", "outcome", "state", "owner", "token", F.col("attempt").cast("long").alias("attempt"))


#: Clicks and purchases are effects; a task's fence is that of its latest request for the lease, for twelve days.
JUDGED_SQL = f"""WITH r AS MATERIALIZED ({REQUESTS_SQL}), f AS (SELECT task_id, max_by(owner, seq) AS owner, max_by(token, seq) AS token, max("at") + INTERVAL 12 DAYS AS until FROM r WHERE action = 'acquire' GROUP BY task_id),
    x AS (SELECT task_id, concat('page-', CAST(floor(value / 3) AS BIGINT)) AS effect_key, CASE WHEN event_type = 'click' THEN 'notify' ELSE 'index' END AS kind, concat('v', CAST(floor(value / 1.5) AS BIGINT)) AS payload, owner, token, seq, "at"
        FROM r JOIN events e ON e.event_id = r.seq WHERE e.event_type IN ('click', 'purchase')),
    j AS (SELECT x.*, 'eff_' || sha256(CAST(x.task_id AS VARCHAR) || '|' || effect_key) AS effect_id, coalesce(x.owner = f.owner AND x.token = f.token AND x."at" < f.until, false) AS fresh FROM x LEFT JOIN f USING (task_id)),
    g AS (SELECT effect_id, min(seq) AS first, min_by(kind || sha256(payload), seq) AS bound FROM j WHERE fresh GROUP BY effect_id)
    SELECT seq, effect_id, CASE WHEN NOT fresh THEN 'STALE' WHEN kind || sha256(payload) <> bound THEN 'CONFLICT' WHEN seq > first THEN 'AGAIN' ELSE 'DONE' END AS verdict FROM j LEFT JOIN g USING (effect_id)"""


@query("q7_fenced_effects", JUDGED_SQL)
def q7_fenced_effects(spark, sf_dir):
    """Verdicts on effects that are sent in two batches, the second of which is replayed as after a loss."""
    asked = requests(spark, sf_dir)
    acquired = asked.where("action = 'acquire'").groupBy("task_id")
    fences = acquired.agg(F.max_by("owner", "seq").alias("owner"), F.max_by("token", "seq").alias("token"), (F.max("at") + F.expr("INTERVAL 12 DAYS")).alias("until"))
    events = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')").selectExpr(
        "event_id AS seq", "concat('page-', CAST(floor(value / 3) AS BIGINT)) AS effect_key", "IF(event_type = 'click', 'notify', 'index') AS kind", "concat('v', CAST(floor(value / 1.5) AS BIGINT)) AS payload"
    )
    effects = asked.select("task_id", "seq", "at", "owner", "token").join(events, "seq")
    path = run.shared_folder(spark)
    write = tasks.effect_sink(path, lambda _: fences)
    early = F.col("at") < F.lit("2024-01-16").cast("timestamp")
    for batch, number in ((effects.where(early), 3), (effects.where(~early), 8), (effects.where(~early), 8)):
        write(batch, number)
    return spark.read.parquet(f"{path}/verdicts").select("seq", "effect_id", "verdict")
