"""Queries over nested values: `orders` with their `lineitem` rows as bundles, `events` with credentials inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import nested
from factloom.plans.catalog import query, table

_NUM = r"regexp_replace(regexp_replace(CAST({} AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '')"


def _duck_item(alias: str) -> str:
    return f"""concat('{{"claim_id":"', {alias}.claim_id, '","object":', {_NUM.format(alias + ".price")}, ',"predicate":"', {alias}.flag, '","subject":{{"key":"', {alias}.part, '","type":"PART"}}}}')"""


BUNDLES_SQL = f"""SELECT o_orderkey, 'sha256:' || sha256(concat('{{"as_of":"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 'Z","counts":{{"lines":', n, ',"taxed":', taxed, '}},"items":[', items, '],"published":"', strftime(o_orderdate - INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S'), 'Z","total":', {_NUM.format("o_totalprice")}, ',"warnings":[', warnings, ']}}')) AS bundle_hash
    FROM (SELECT o_orderkey, any_value(o_orderdate) AS o_orderdate, any_value(o_totalprice) AS o_totalprice, count(*) AS n, count(*) FILTER (l_tax > 0.04) AS taxed,
      array_to_string(list_transform(list_sort(list(struct_pack(a := part, b := flag, c := claim_id, d := price))), lambda x: {_duck_item("x").replace("x.part", "x.a").replace("x.flag", "x.b").replace("x.claim_id", "x.c").replace("x.price", "x.d")}), ',') AS items,
      array_to_string(list_sort(list(concat('"', l_linestatus, ' \\"', l_suppkey, '\\" é"'))), ',') AS warnings
      FROM orders JOIN (SELECT *, CAST(l_partkey AS VARCHAR) AS part, l_returnflag AS flag, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) AS claim_id, l_extendedprice AS price FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def bundles(spark, sf_dir):
    """(o_orderkey, bundle): an order as a nested bundle; its lines are in whatever order they come. An order has few lines."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "struct(l_extendedprice AS object, struct('PART' AS type, CAST(l_partkey AS STRING) AS key) AS subject, l_returnflag AS predicate, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey) AS claim_id) AS item",
        "concat(l_linestatus, ' \"', l_suppkey, '\" é') AS warning", "l_tax > 0.04 AS taxed",
    )
    held = lines.groupBy("l_orderkey").agg(F.collect_list("item").alias("items"), F.collect_list("warning").alias("warnings"), F.count("*").alias("n"), F.count_if("taxed").alias("taxed"))
    orders = table(spark, sf_dir, "orders").withColumn("as_of", F.col("o_orderdate").cast("timestamp"))
    published = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    bundle = F.struct("warnings", F.col("o_totalprice").alias("total"), "items", "as_of", F.create_map(F.lit("taxed"), "taxed", F.lit("lines"), "n").alias("counts"), published.alias("published"))
    return orders.join(held, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", bundle.alias("bundle"))


@query("a2_bundle_hashes", BUNDLES_SQL)
def a2_bundle_hashes(spark, sf_dir):
    """Content hash of every bundle, whatever the order of its sets and items and the spelling of its numbers, instants and accents."""
    return nested.digest(bundles(spark, sf_dir), "bundle", "bundle_hash").select("o_orderkey", "bundle_hash")


@query(
    "t12_redacted_payloads",
    """SELECT event_id, 'https://example.com/' || event_type AS url, '<redacted>' AS api_token, user_id AS fencing_token, 'call Bearer <redacted> now' AS first_note, 'key=<redacted>&k=' || (props::JSON->>'k') AS second_note,
    '<redacted>' AS header_cookie, 'v' || CAST(user_id AS VARCHAR) AS header_agent FROM events""",
)
def t12_redacted_payloads(spark, sf_dir):
    """Payloads of events without secrets at any depth: under sensitive keys of structs and maps, and inside strings of arrays."""
    payload = F.expr("""struct(concat('https://example.com/', event_type, '?sig=', event_id) AS url, struct(event_id AS api_token, user_id AS fencing_token,
        array(named_struct('note', concat('call Bearer abc', event_id, ' now')), named_struct('note', concat('key=', event_id, '&k=', get_json_object(props, '$.k')))) AS notes,
        map('Set-Cookie', CAST(event_id AS STRING), 'agent', concat('v', user_id)) AS headers) AS request)""")
    events = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    clean, _ = nested.redacted(F.col("payload"), events.schema["payload"].dataType)
    found = events.select("event_id", clean.alias("p"))
    return found.selectExpr(
        "event_id", "p.url", "p.request.api_token", "p.request.fencing_token", "p.request.notes[0].note AS first_note", "p.request.notes[1].note AS second_note", "p.request.headers['Set-Cookie'] AS header_cookie", "p.request.headers['agent'] AS header_agent"
    )
