"""Registered queries on tables, texts, records and events, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import governance, guards, validate
from skerry.operators.validate import Rule
from skerry.plans.statistics import rounded
from skerry.sources.tables import load
from skerry.streaming import ledgers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_REDACTED = "text"
for _pattern, _tag in guards.PERSONAL:
    _REDACTED = f"regexp_replace({_REDACTED}, {_quoted(_pattern)}, {_quoted(_tag)}, 'g')"


@query(f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5, len({_REDACTED}) AS length FROM documents")
def redaction_documents(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", guards.redact(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("redacted_md5"), F.length("t").cast("long").alias("length"))


_SENTENCES = "concat(text, CASE WHEN turn % 3 = 0 THEN ' The UMAP shows they are far apart.' WHEN turn % 3 = 1 THEN ' p = .62, not significant, which proves no difference exists' ELSE ' please try a different test until it works' END)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("turn") % 3 == 0, " The UMAP shows they are far apart.").when(F.col("turn") % 3 == 1, " p = .62, not significant, which proves no difference exists").otherwise(" please try a different test until it works")
    return load(spark, d, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("t"))


_SPOKEN = f"regexp_replace(concat(' ', regexp_replace(regexp_replace(lower(t), {_quoted(guards.SENTENCE_END)}, ' {guards.BREAK} ', 'g'), {_quoted(guards.NOT_A_WORD)}, ' ', 'g'), ' '), {_quoted(guards.NEGATIONS)}, ' {guards.NEGATION} ', 'g')"


def _said(phrases: list[str]) -> str:
    return "CAST(" + " OR ".join(f"regexp_matches(s, {_quoted(p)})" for p in phrases) + " AS INTEGER)"


_TURNS_SPOKEN = f"(SELECT conv_id, turn, {_SPOKEN} AS s FROM (SELECT conv_id, turn, {_SENTENCES} AS t FROM conversations))"


@query(f"SELECT conv_id, turn, {' + '.join(f'{_said(phrases)} * {10**i}' for i, phrases in enumerate(guards.CLAIMS.values()))} AS claims FROM {_TURNS_SPOKEN}")
def claims_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d).select("conv_id", "turn", guards.blocked_claims(F.col("t")).alias("found"))
    return turns.select("conv_id", "turn", sum((F.array_contains("found", k).cast("int") * 10**i for i, k in enumerate(guards.CLAIMS)), F.lit(0)).alias("claims"))


@query(f"SELECT conv_id, turn, CAST({' + '.join(map(_said, guards.SEARCHING))} AS INTEGER) AS wordings FROM {_TURNS_SPOKEN}")
def searching_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", F.size(guards.searching(F.col("t"))).alias("wordings"))


@query()
def unverified_numbers(spark: SparkSession, d: str) -> DataFrame:
    known = load(spark, d, "conversations").where("conv_id % 2 = 0").select("conv_id", F.lit(0.62).alias("value")).distinct()
    return guards.scan_numbers(_turns(spark, d), "conv_id", "t", known)


@query(f"""WITH l AS (SELECT conv_id, conv_id * 1000 + turn AS row, unnest(string_split(concat_ws(chr(10), text, 'pip install ete3 numpy==1.0', 'import igraph.core'), chr(10))) AS line FROM conversations),
  w AS (SELECT conv_id, row, string_split_regex(trim(lower(line)), '\\s+') AS w FROM l),
  i AS (SELECT *, list_filter(range(2, len(w) + 1), lambda i: w[i] IN ('install', 'add') AND w[i - 1] IN ({', '.join(map(_quoted, guards.INSTALLERS))}))[1] AS i FROM w),
  p AS (SELECT conv_id, row, unnest(list_transform(list_filter(w[i + 1:], lambda x: NOT starts_with(x, '-')), lambda x: regexp_extract(x, '^[a-z0-9._-]*'))) AS package FROM i WHERE i IS NOT NULL
    UNION ALL SELECT conv_id, row, regexp_extract(coalesce(w[2], ''), '^\\w*') FROM w WHERE w[1] IN ('import', 'from')),
  known(package, issue) AS (VALUES {', '.join(f"({_quoted(k)}, {_quoted(v)})" for k, v in [(n, 'name') for n in guards.NAME_TRAPS] + list(guards.COPYLEFT.items()))})
  SELECT conv_id, package, issue FROM (SELECT DISTINCT conv_id, row, package FROM p) JOIN known USING (package)""")
def package_issues_conversations(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "conversations").select("conv_id", F.concat_ws("\n", "text", F.lit("pip install ete3 numpy==1.0"), F.lit("import igraph.core")).alias("t"))
    return guards.package_issues(t, "conv_id", "t")


_EVENT_RULES = [Rule("user_id", "integer", least=0, most=80), Rule("event_type", "category", allowed=("click", "view", "purchase", "signup")), Rule("value", least=0, most=90), Rule("site")]


def _event_table(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 50 == 0, F.lit("n/a")).when(F.col("event_id") % 51 == 0, F.lit("high")).otherwise(F.col("value").cast("string")).alias("value"))


@query("""WITH e AS (SELECT event_id + 2 AS r, user_id, event_type, CASE WHEN event_id % 50 = 0 THEN 'n/a' WHEN event_id % 51 = 0 THEN 'high' END AS word, value FROM events),
  i AS (SELECT 'block' AS severity, r AS row_num, 'user_id' AS column_name, 'above_maximum' AS rule FROM e WHERE user_id > 80
    UNION ALL SELECT 'warn', r, 'event_type', 'not_allowed' FROM e WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')
    UNION ALL SELECT 'warn', r, 'value', 'missing_value' FROM e WHERE word = 'n/a' UNION ALL SELECT 'block', r, 'value', 'not_a_number' FROM e WHERE word = 'high'
    UNION ALL SELECT 'block', r, 'value', 'above_maximum' FROM e WHERE word IS NULL AND value > 90 UNION ALL SELECT 'block', r, 'value', 'below_minimum' FROM e WHERE word IS NULL AND value < 0)
  SELECT severity, column_name, rule, count(*) AS issues, CAST(min(row_num) AS BIGINT) AS first_row FROM i GROUP BY ALL UNION ALL SELECT 'block', 'site', 'missing_column', 1, NULL
  UNION ALL SELECT 'warn', NULL, 'duplicate_row', count(*), CAST(min(r) AS BIGINT) FROM (SELECT r, row_number() OVER (PARTITION BY user_id, event_type, coalesce(word, CAST(value AS VARCHAR)) ORDER BY r) AS k FROM e) WHERE k > 1""")
def validation_events(spark: SparkSession, d: str) -> DataFrame:
    issues = validate.validate(_event_table(spark, d), "event_id", _EVENT_RULES)
    return issues.groupBy("severity", "column_name", "rule").agg(F.count("*").alias("issues"), F.min("row_num").alias("first_row"))


@query("""WITH c AS (SELECT 'user_id' AS column_name, CAST(user_id AS VARCHAR) AS raw, CAST(user_id AS DOUBLE) AS v FROM events UNION ALL SELECT 'event_type', event_type, NULL FROM events UNION ALL SELECT 'value', CAST(value AS VARCHAR), value FROM events)
  SELECT column_name, CASE WHEN column_name = 'event_type' THEN 'category' WHEN count(v) FILTER (v <> round(v)) > 0 THEN 'number' ELSE 'integer' END AS kind, min(v) AS minimum, max(v) AS maximum, count(DISTINCT raw) AS n_distinct, CAST(0 AS BIGINT) AS missing, CASE WHEN column_name = 'event_type' THEN string_agg(DISTINCT raw, ',' ORDER BY raw) END AS allowed FROM c GROUP BY 1""")
def schema_events(spark: SparkSession, d: str) -> DataFrame:
    return validate.infer(load(spark, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id").withColumn("allowed", F.array_join("allowed", ","))


@query("""WITH w AS (SELECT event_id + 2 AS r, CASE WHEN event_id % 51 = 0 THEN 'high' END AS word FROM events WHERE event_id % 50 <> 0), s AS (SELECT count(*) FILTER (word IS NULL) / CAST(count(*) AS DOUBLE) AS share FROM w)
  SELECT 'block' AS severity, r AS row_num, 'value' AS column_name, 'not_a_number' AS rule, concat(CAST(round(share * 100) AS INTEGER), ' % of this column are numbers') AS hint FROM w, s WHERE word IS NOT NULL ORDER BY r LIMIT 5""")
def mixed_columns_events(spark: SparkSession, d: str) -> DataFrame:
    return validate.mixed(_event_table(spark, d), "event_id")


@query("SELECT doc_id + 2 AS row_num, CAST(f AS BIGINT) + 2 AS first_row FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS f FROM documents) WHERE doc_id > f")
def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(load(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")


_NAMES = ("sample", "dilution_factor", "plaque_count", "reading", "group")


@query(f"""WITH n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT 'Reeding' UNION SELECT 'plaquecount' UNION SELECT 'grup'), x AS (SELECT name, c, i, levenshtein(lower(name), lower(c)) AS d FROM n, (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_NAMES))}) v(i, c))
  SELECT name, CASE WHEN min(d) <= greatest(2, len(name) // 3) THEN arg_min(c, d * 100 + i) END AS closest FROM x GROUP BY name""")
def closest_columns(spark: SparkSession, d: str) -> DataFrame:
    names = load(spark, d, "part").select(F.col("p_type").alias("name")).union(spark.createDataFrame([("Reeding",), ("plaquecount",), ("grup",)], "name string")).distinct()
    return validate.closest(names, "name", list(_NAMES))


@query("SELECT event_id, user_id, event_type, CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events WHERE event_id % 50 = 0 OR event_id % 51 <> 0")
def coerced_events(spark: SparkSession, d: str) -> DataFrame:
    return validate.coerce(_event_table(spark, d), ["value"])[0]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("transcript_id"), F.col("o_orderkey").alias("seq"), F.lit("compare_groups").alias("tool"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("data_id"), ((F.col("o_orderkey") * 7919 % 1000) / F.lit(5000.0)).alias("p_value"), (F.col("o_orderkey") % 40).alias("n"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))


_R = "t AS (SELECT concat('t', o_orderkey) AS transcript_id, o_orderkey AS seq, concat('c', o_custkey) AS data_id, CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 5000.0 AS p_value, o_orderkey % 40 AS n FROM orders WHERE o_orderstatus <> 'P')"


@query(f"""WITH {_R}, r AS (SELECT *, count(*) OVER (PARTITION BY data_id) AS tests, row_number() OVER (PARTITION BY data_id ORDER BY p_value, seq) AS i FROM t),
  h AS (SELECT *, least(1.0, max((tests - i + 1) * p_value) OVER (PARTITION BY data_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS holm FROM r), c AS (SELECT *, CASE WHEN tests >= 3 THEN holm ELSE p_value END AS corrected FROM h)
  SELECT data_id, transcript_id, seq, 'compare_groups' AS tool, round(p_value, 6) AS p_value, tests, round(corrected, 6) AS corrected, p_value < 0.05 AND corrected >= 0.05 AS lost, CAST(round(tests * 0.05, 6) AS DOUBLE) AS expected_false_alarms FROM c""")
def ledger_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(governance.ledger(_records(spark, d)))


@query(f"""WITH {_R}, s AS (SELECT data_id, count(*) AS tests, round(min(p_value), 6) AS best_p, round(arg_min(p_value, seq), 6) AS first_p, arg_min(n, seq) AS first_n, arg_max(n, seq) AS last_n FROM t GROUP BY 1)
  SELECT *, last_n < first_n AS shrinking, CASE WHEN tests >= 6 OR (last_n < first_n AND tests >= 4) THEN 'block' WHEN tests >= 3 THEN 'warn' ELSE 'none' END AS severity FROM s""")
def behaviour_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(governance.behaviour(_records(spark, d)))


@query("""WITH r AS (SELECT c_mktsegment, sha256(concat('{"c_custkey":', c_custkey, ',"c_acctbal":', c_acctbal, '}')) AS h FROM customer),
  s AS (SELECT c_mktsegment, count(*) AS n, sum(CAST(concat('0x', substr(h, 1, 12)) AS BIGINT)) AS x, sum(CAST(concat('0x', substr(h, 13, 12)) AS BIGINT)) AS y FROM r GROUP BY 1)
  SELECT c_mktsegment, substr(sha256(concat_ws('|', n, x, y)), 1, 32) AS data_id FROM s""")
def fingerprints_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return governance.fingerprint(load(spark, d, "customer"), "c_custkey", "c_acctbal", by=("c_mktsegment",))


@query("""WITH j AS (SELECT user_id AS school, event_id, value AS minutes, ts FROM events)
  SELECT school, event_id, minutes, round(coalesce(sum(minutes) OVER w, 0), 4) AS used, coalesce(sum(minutes) OVER w, 0) + minutes <= 600 AS accepted FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM j) WINDOW w AS (PARTITION BY school ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)""")
def quota_events(spark: SparkSession, d: str) -> DataFrame:
    jobs = load(spark, d, "events").select(F.col("user_id").alias("school"), "event_id", F.col("value").alias("minutes"), F.col("ts").cast("timestamp").alias("requested_at"))
    return governance.quota(jobs).select("school", "event_id", "minutes", F.round("used", 4).alias("used"), "accepted")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS group_label, count(*) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) END, 6) AS sd FROM events GROUP BY 1, 2""")
def windows_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(ledgers.windowed(e, "ts", "event_type", "value")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS x FROM events), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions_events(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledgers.sessions(e, "ts", "user_id").withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))
