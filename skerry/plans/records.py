"""Registered queries on records of work: transcripts, submissions, turns of a conversation."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.shared import new_path
from skerry.operators import submissions
from skerry.plans import transcripts
from skerry.sources.cache import Cache, status
from skerry.sources.tables import cache_key, load
from skerry.streaming import turns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT o_orderkey, json_object('p_value', (o_orderkey * 7919 % 1000) / 5000.0, 'passed', o_orderkey % 2 = 0,
    'groups', json_array(json_object('label', o_orderstatus, 'mean', o_totalprice), json_object('label', o_orderpriority, 'n', o_custkey)),
    'note', concat('held in ', CAST(o_orderkey % 100 AS VARCHAR), '% of 1,', CAST(100 + o_custkey % 900 AS VARCHAR), ' re-runs')) AS j FROM orders),
  t AS (SELECT o_orderkey, fullkey, type, atom FROM r, json_tree(r.j)),
  n AS (SELECT o_orderkey, fullkey, CAST(atom AS DOUBLE) AS number FROM t WHERE type IN ('UBIGINT', 'BIGINT', 'DOUBLE')
    UNION ALL SELECT o_orderkey, fullkey, CAST(unnest(regexp_extract_all(replace(atom ->> '$', ',', ''), '[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?')) AS DOUBLE) FROM t WHERE type = 'VARCHAR')
  SELECT concat('t', o_orderkey) AS transcript_id, fullkey AS path, number FROM n""")
def transcript_numbers_orders(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    note = F.concat(F.lit("held in "), (F.col("o_orderkey") % 100).cast("string"), F.lit("% of 1,"), (100 + F.col("o_custkey") % 900).cast("string"), F.lit(" re-runs"))
    groups = [F.to_json(F.struct(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("mean"))), F.to_json(F.struct(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("n")))]
    head = F.to_json(F.struct(((F.col("o_orderkey") * 7919 % 1000) / F.lit(5000.0)).alias("p_value"), (F.col("o_orderkey") % 2 == 0).alias("passed"), note.alias("note")))
    # two members of one list differ in shape, which a typed array can't hold
    result = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"groups":['), groups[0], F.lit(","), groups[1], F.lit("]}"))
    return transcripts.numbers(o.select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("transcript_id"), result.alias("result")))


@query("""WITH r AS (SELECT sha256(concat('{"c_mktsegment":"', c_mktsegment, '","c_acctbal":', c_acctbal, '}')) AS h FROM customer),
  s AS (SELECT count(*) AS n, sum(CAST(concat('0x', substr(h, 1, 12)) AS BIGINT)) AS x, sum(CAST(concat('0x', substr(h, 13, 12)) AS BIGINT)) AS y FROM r), i AS (SELECT substr(sha256(concat_ws('|', n, x, y)), 1, 32) AS data_id FROM s),
  k AS (SELECT count(DISTINCT c_mktsegment) AS k FROM customer)
  SELECT 'describe' AS tool, 'describe(df=<c_mktsegment, c_acctbal>, group="c_mktsegment", value="c_acctbal")' AS call, data_id, CAST(NULL AS VARCHAR) AS error, k AS results FROM i, k
  UNION ALL SELECT 'compare_groups', 'compare_groups(df=<c_mktsegment, c_acctbal>, group="c_mktsegment", value="c_acctbal")', data_id, 'ValueError: compare_groups needs a justification', 0 FROM i""")
def recorded_calls_customer(spark: SparkSession, d: str) -> DataFrame:
    store = transcripts.TranscriptStore(spark, new_path(spark, "transcripts"))
    asked = {"df": load(spark, d, "customer").select("c_mktsegment", "c_acctbal"), "group": "c_mktsegment", "value": "c_acctbal"}
    store.run("describe", **asked)
    try:
        store.run("compare_groups", **asked)
    except ValueError:
        pass  # the refusal is in the record
    n = store.results().groupBy("transcript_id").agg(F.count("*").alias("results"))
    return store.calls().join(n, "transcript_id", "left").select("tool", "call", "data_id", "error", F.coalesce("results", F.lit(0)).alias("results"))


def _submitted(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o = load(spark, d, "orders")
    name, data = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    p = (F.col("o_orderkey") * 7919 % 1000) / F.lit(5000.0)
    tests = o.select(
        name.alias("transcript_id"), data.alias("data_id"), F.col("o_orderdate").alias("at"), p.alias("p_value"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"),
        F.when(F.col("o_orderkey") % 9 == 0, "block").when(F.col("o_orderkey") % 9 == 1, "warn").alias("stability"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 8 == 0).alias("verified"),
    )
    shown = F.when(F.col("o_orderkey") % 5 == 0, p + 0.25).otherwise(p)
    item = (F.col("o_orderkey") / 3).cast("long")
    work = o.groupBy(item.alias("item_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), shown.alias("p")))), lambda x: F.concat(F.lit("p = "), F.format_string("%.4f", x["p"]))), "; ").alias("claim"),
        F.collect_set(name).alias("transcript_ids"), F.max("o_orderdate").alias("submitted_at"),
    )
    excluded = o.where("o_orderkey % 6 = 0").select(data.alias("data_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderkey") % 12 == 0, "the tube cracked").otherwise("it spoils the result").alias("justification"))
    foretold = o.where("o_orderkey % 3 = 0").select(data.alias("data_id"), F.date_sub("o_orderdate", 30).cast("timestamp_ntz").alias("created_at"), F.lit("more").alias("prediction"))
    return {"submissions": work, "tests": tests, "numbers": tests.select("transcript_id", F.col("p_value").alias("number")), "exclusions": excluded, "predictions": foretold}


@query("""WITH t AS (SELECT concat('t', o_orderkey) AS transcript_id, concat('c', o_custkey) AS data_id, o_orderdate AS tested, o_orderkey AS k, o_orderstatus <> 'P' AS counted, o_orderkey // 3 AS item_id, (o_orderkey * 7919 % 1000) / 5000.0 AS p FROM orders),
  h AS (SELECT *, sum(CASE WHEN counted THEN 1 ELSE 0 END) OVER (PARTITION BY data_id ORDER BY tested, transcript_id ROWS UNBOUNDED PRECEDING) AS no,
    EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey % 3 = 0 AND concat('c', x.o_custkey) = t.data_id AND CAST(CAST(x.o_orderdate AS DATE) - 30 AS TIMESTAMP) <= t.tested) AS foretold FROM t),
  s AS (SELECT item_id, max(tested) AS submitted_at FROM t GROUP BY 1), d AS (SELECT item_id, data_id, count(*) FILTER (NOT foretold) AS n FROM h GROUP BY ALL),
  e AS (SELECT item_id, data_id, (SELECT count(*) FROM orders x WHERE x.o_orderkey % 6 = 0 AND x.o_orderkey % 12 <> 0 AND concat('c', x.o_custkey) = d.data_id AND x.o_orderdate <= s.submitted_at) AS n FROM d JOIN s USING (item_id)),
  c AS (SELECT item_id, k, CAST(printf('%.4f', CASE WHEN k % 5 = 0 THEN p + 0.25 ELSE p END) AS DOUBLE) AS shown FROM t), u AS (SELECT item_id, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.item_id = c.item_id AND abs(t.p - c.shown) <= 0.00005 + 1e-6) GROUP BY 1)
  SELECT item_id, 'stability' AS kind, CASE k % 9 WHEN 0 THEN 'block' ELSE 'warn' END AS severity, transcript_id, CAST(NULL AS VARCHAR) AS data_id, 'the result depends on single points' AS detail FROM h WHERE k % 9 < 2
  UNION ALL SELECT item_id, 'verification_mismatch', 'block', transcript_id, NULL, 'a recomputation gave other numbers' FROM h WHERE k % 4 = 0 AND k % 8 <> 0
  UNION ALL SELECT item_id, 'multiple_comparisons', 'warn', transcript_id, NULL, concat(no, ' tests on these data by then') FROM h WHERE no >= 3
  UNION ALL SELECT item_id, 'no_prediction', 'warn', NULL, data_id, concat(n, ' tests before any prediction was written') FROM d WHERE n > 0
  UNION ALL SELECT item_id, 'exclusion_justified_by_result', 'block', NULL, data_id, concat(n, ' exclusions for a reason about the result') FROM e WHERE n > 0
  UNION ALL SELECT item_id, 'unverified_number_in_claim', 'block', NULL, NULL, concat(n, ' numbers come from none of the transcripts') FROM u""")
def submission_flags_orders(spark: SparkSession, d: str) -> DataFrame:
    return submissions.flags(**_submitted(spark, d))


@query("""WITH t AS (SELECT o_orderkey, concat('c', o_custkey) AS data_id, o_orderdate AS tested FROM orders)
  SELECT o_orderkey, data_id, EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey % 3 = 0 AND concat('c', x.o_custkey) = t.data_id AND CAST(CAST(x.o_orderdate AS DATE) - 30 AS TIMESTAMP) <= t.tested) AS allowed FROM t""")
def prediction_gate_orders(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("data_id"), F.col("o_orderdate").alias("at"))
    return submissions.gate(asked, _submitted(spark, d)["predictions"]).select("o_orderkey", "data_id", "allowed")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))
  SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place, n FROM r WHERE place <= 5""")
def latest_orders_by_customer(spark: SparkSession, d: str) -> DataFrame:
    parents = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return submissions.children(parents, load(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", page=5).select("o_custkey", "o_orderkey", "place", "n")


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'turn' WHEN conv_id % 3 = 0 AND turn = 2 THEN 'prediction' ELSE 'result' END AS kind, round(turn * 1.25 + conv_id % 7, 2) AS shown, conv_id % 5 = 0 AS wrong,
    CASE WHEN conv_id % 4 <> 0 THEN concat('d', conv_id % 4) END AS data_id, turn % 4 = 1 AS searching, turn % 4 = 3 AS asks FROM conversations),
  s AS (SELECT *, sum(CASE WHEN kind = 'turn' THEN 1 ELSE 0 END) OVER w AS turns, sum(CASE WHEN kind = 'result' THEN 1 ELSE 0 END) OVER w AS tests, sum(CASE WHEN kind = 'prediction' THEN 1 ELSE 0 END) OVER w AS foretold FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
  t AS (SELECT *, CASE WHEN wrong OR NOT EXISTS (SELECT 1 FROM s r WHERE r.conv_id = s.conv_id AND r.kind = 'result' AND r.turns + 1 = s.turns AND abs(r.shown - round((s.turn - 1) * 1.25 + s.conv_id % 7, 2)) <= 0.005001) THEN 1 ELSE 0 END AS unverified FROM s WHERE kind = 'turn')
  SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn AS seq, CASE WHEN searching THEN 'leave out that point, ask [EMAIL]' ELSE 'is it significant?' END AS message,
    concat_ws(',', CASE WHEN asks AND data_id IS NOT NULL AND foretold = 0 THEN 'no_prediction' END, CASE WHEN searching THEN 'specification_search' END, CASE WHEN unverified = 1 THEN 'unverified_number' END) AS reasons,
    unverified, CASE WHEN data_id IS NULL THEN 0 ELSE CAST(tests AS BIGINT) END AS tests_on_data, data_id IS NOT NULL AND tests >= 3 AS notice FROM t""")
def guarded_turns_conversations(spark: SparkSession, d: str) -> DataFrame:
    c, turn = load(spark, d, "conversations"), F.col("turn")
    kind = F.when(turn % 2 == 1, "turn").when((F.col("conv_id") % 3 == 0) & (turn == 2), "prediction").otherwise("result")
    shown = lambda at: F.round(at * 1.25 + F.col("conv_id") % 7, 2)
    quoted = F.format_string("The mean is %.2f.", F.when(F.col("conv_id") % 5 == 0, shown(turn - 1) + 900).otherwise(shown(turn - 1)))
    events = c.select(
        F.col("conv_id").cast("string").alias("conv_id"), turn.alias("seq"), F.timestamp_seconds(turn).alias("at"), kind.alias("kind"),
        F.when(turn % 4 == 1, "leave out that point, ask me.too@school.org").otherwise("is it significant?").alias("message"), F.when(turn % 2 == 1, quoted).alias("reply"),
        F.when(turn % 2 == 0, F.array(shown(turn))).alias("numbers"), F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("d"), (F.col("conv_id") % 4).cast("string"))).alias("data_id"), F.when(turn % 2 == 0, 0.04).alias("p_value"),
    )
    return turns.judged(events).withColumn("reasons", F.array_join("reasons", ","))


def ask_upstream(source: str, path: str, params: dict) -> str:
    """What stands for an upstream source: it fails for every fifth path."""
    if int(path.rsplit("/", 1)[1]) % 5 == 0:
        raise OSError("no answer")
    return f"{source} {path} {params.get('q', '')}"


_NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events), k AS (SELECT user_id, event_type, max(ts) AS fetched FROM events WHERE user_id % 3 <> 0 GROUP BY ALL),
  s AS (SELECT a.user_id, a.event_type, k.fetched IS NOT NULL AS known, k.fetched + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00' AS fresh FROM a LEFT JOIN k USING (user_id, event_type))
  SELECT event_type AS source, concat('users/', user_id) AS path, CASE WHEN known AND fresh THEN 'hit' WHEN user_id % 5 <> 0 THEN 'fetched' WHEN known THEN 'stale' ELSE 'failed' END AS state,
    CASE WHEN known AND (fresh OR user_id % 5 = 0) THEN 'old' WHEN user_id % 5 <> 0 THEN concat(event_type, ' users/', user_id, ' x') END AS body FROM s""")
def cached_requests_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select(F.col("event_type").alias("source"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    asked = e.select("source", "path").distinct().withColumn("params", F.create_map(F.lit("q"), F.lit("x"), F.lit("api_key"), F.lit("hidden")))
    store = Cache(spark, new_path(spark, "cache"), {})
    key = cache_key(F.col("source"), F.col("path"), F.create_map(F.lit("q"), F.lit("x")))
    old = e.where("user_id % 3 <> 0").select(key.alias("key"), "source", "path", F.lit("old").alias("body"), F.col("ts").alias("fetched_at"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    old.write.mode("append").parquet(store.folder)
    return store.fetch(asked, ask_upstream, _NOW).select("source", "path", "state", "body")


@query("""WITH c AS (SELECT event_type AS source, user_id, ts FROM events), l AS (SELECT source, user_id, max(ts) AS ts FROM c GROUP BY ALL)
  SELECT source, count(*) AS keys, count(*) FILTER (ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00') AS fresh, count(*) FILTER (ts + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20 00:00:00') AS expired, (SELECT count(*) FROM c x WHERE x.source = l.source) AS rows FROM l GROUP BY source""")
def cache_status_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(F.concat_ws("|", "event_type", "user_id").alias("key"), F.col("event_type").alias("source"), F.lit("").alias("path"), F.lit("").alias("body"), F.col("ts").alias("fetched_at"), (F.col("ts") + F.expr("interval 7 days")).alias("expires_at"))
    return status(rows, F.lit(_NOW)).select("source", "keys", "fresh", "expired", "rows")
