"""Registered queries on measurements, with their SQL twins.  Doubles are rounded alike in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import groups, resample, robust, series
from skerry.plans.compare import compare_groups, contingency_test, correlate, post_hoc, trend_test
from skerry.sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """All double columns rounded, the others as they are."""
    return df.select(*(F.round(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


@query("""SELECT l_returnflag AS group_label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(*)), 6) AS se,
  round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum
  FROM (SELECT l_returnflag, l_extendedprice AS v FROM lineitem) GROUP BY 1""")
def describe_price_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.describe(load(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


_SUMMARY = """s AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1)"""


@query(f"""WITH {_SUMMARY}, p AS (SELECT a.g AS a_group_label, b.g AS b_group_label, a.n AS n, b.n AS k, a.m - b.m AS difference, b.v AS bv, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS s
  FROM s a JOIN s b ON a.g < b.g)
  SELECT a_group_label, b_group_label, round(difference, 6) AS difference, round(difference / s, 6) AS cohens_d, round(difference / s * (1 - 3.0 / (4 * (n + k - 2) - 1)), 6) AS hedges_g, round(difference / sqrt(bv), 6) AS glass_delta FROM p""")
def effect_sizes_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.effects(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


_RANKS = """r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x),
  t AS (SELECT sum(power(c, 3) - c) AS tie_term FROM (SELECT count(*) AS c FROM x GROUP BY v))"""


@query(f"""WITH x AS (SELECT event_type AS g, value AS v FROM events WHERE event_type IN ('click', 'view')), {_RANKS},
  u AS (SELECT count(*) FILTER (g = 'click') AS n_a, count(*) FILTER (g = 'view') AS n_b, sum(r) FILTER (g = 'click') AS ra FROM r)
  SELECT n_a, n_b, CAST(ra - n_a * (n_a + 1) / 2.0 AS DOUBLE) AS u, round(CAST((ra - n_a * (n_a + 1) / 2.0) AS DOUBLE) / (n_a * n_b), 6) AS cles, round(2 * CAST((ra - n_a * (n_a + 1) / 2.0) AS DOUBLE) / (n_a * n_b) - 1, 6) AS rank_biserial, CAST(tie_term AS DOUBLE) AS tie_term FROM u, t""")
def mann_whitney_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.pairwise_ranks(load(spark, d, "events"), "event_type", "value", "click", "view"))


@query(f"""WITH {_SUMMARY}, t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS s2, sum((n - 1) * v) AS w FROM s)
  SELECT k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, round(((s2 - s * s / n) / (k - 1)) / (w / (n - k)), 6) AS f, round((s2 - s * s / n) / (s2 - s * s / n + w), 6) AS eta_squared FROM t""")
def anova_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.anova(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


@query("""WITH s AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
  p AS (SELECT a.g AS a_group_label, b.g AS b_group_label, a.m - b.m AS d, a.n AS n, b.n AS k, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS s2, a.v / a.n AS x, b.v / b.n AS y FROM s a JOIN s b ON a.g < b.g)
  SELECT a_group_label, b_group_label, round(d / sqrt(s2 * (1.0 / n + 1.0 / k)), 6) AS t, n + k - 2 AS df, round(d / sqrt(x + y), 6) AS welch_t, round((x + y) * (x + y) / (x * x / (n - 1) + y * y / (k - 1)), 6) AS welch_df FROM p""")
def t_tests_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.t_tests(load(spark, d, "events"), "event_type", "value"))


@query("""WITH d AS (SELECT l_extendedprice - l_quantity * 1000 AS d FROM lineitem), s AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM d)
  SELECT n, n - 1 AS df, round(m / (sd / sqrt(n)), 6) AS t, round(m / sd, 6) AS cohens_d FROM s""")
def paired_t_price(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("flat"))
    return rounded(groups.paired_t(rows, "l_extendedprice", "flat"))


@query("""WITH d AS (SELECT o_totalprice - 150000 AS d FROM orders WHERE o_totalprice <> 150000),
  r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
  SELECT count(*) AS n, CAST(sum(r) FILTER (d > 0) AS DOUBLE) AS w_plus, CAST(sum(r) FILTER (d < 0) AS DOUBLE) AS w_minus, (SELECT CAST(sum(power(c, 3) - c) AS DOUBLE) FROM (SELECT count(*) AS c FROM d GROUP BY abs(d))) AS tie_term FROM r""")
def wilcoxon_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_totalprice", F.lit(150000.0).alias("centre"))
    return groups.signed_ranks(rows, "o_totalprice", "centre")


@query(f"""WITH x AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders), {_RANKS},
  q AS (SELECT sum(n) AS n, count(*) AS k, sum(s * s / n) AS ss FROM (SELECT g, count(*) AS n, CAST(sum(r) AS DOUBLE) AS s FROM r GROUP BY g)),
  h AS (SELECT k, CAST(n AS DOUBLE) AS n, (12 / (CAST(n AS DOUBLE) * (n + 1)) * ss - 3 * (n + 1)) / (1 - tie_term / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM q, t)
  SELECT k - 1 AS df, round(h, 4) AS h, round((h - k + 1) / (n - k), 6) AS epsilon_squared FROM h""")
def kruskal_priority(spark: SparkSession, d: str) -> DataFrame:
    r = groups.kruskal(load(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return r.select("df", F.round("h", 4).alias("h"), F.round("epsilon_squared", 6).alias("epsilon_squared"))


@query("""WITH x AS (SELECT c_mktsegment AS g, abs(c_acctbal - quantile_cont(c_acctbal, 0.5) OVER (PARTITION BY c_mktsegment)) AS v FROM customer),
  s AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM x GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS s2, sum((n - 1) * v) AS w FROM s)
  SELECT k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, round(((s2 - s * s / n) / (k - 1)) / (w / (n - k)), 5) AS levene FROM t""")
def brown_forsythe_segment(spark: SparkSession, d: str) -> DataFrame:
    return groups.brown_forsythe(load(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumn("levene", F.round("levene", 5))


@query("""WITH c AS (SELECT o_orderstatus AS row_label, o_orderpriority AS col_label, count(*) AS observed FROM orders GROUP BY 1, 2),
  r AS (SELECT row_label, sum(observed) AS r FROM c GROUP BY 1), k AS (SELECT col_label, sum(observed) AS k FROM c GROUP BY 1)
  SELECT row_label, col_label, coalesce(observed, 0) AS observed, round(CAST(r AS DOUBLE) * k / (SELECT sum(observed) FROM c), 6) AS expected FROM r CROSS JOIN k LEFT JOIN c USING (row_label, col_label)""")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.contingency(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), t AS (SELECT a, b, o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c),
  s AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum((o - e) * (o - e) / e) AS x, count(DISTINCT a) AS r, count(DISTINCT b) AS k, min(e) AS least FROM t)
  SELECT n, round(x, 6) AS chi2, (r - 1) * (k - 1) AS df, round(least, 6) AS least_expected,
    round(sqrt(greatest(0.0, x / n - CAST((k - 1) * (r - 1) AS DOUBLE) / (n - 1)) / (least(r - CAST((r - 1) * (r - 1) AS DOUBLE) / (n - 1), k - CAST((k - 1) * (k - 1) AS DOUBLE) / (n - 1)) - 1)), 6) AS cramers_v FROM s""")
def chi_square_status_priority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(groups.chi_square(load(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def line_quantity_price(spark: SparkSession, d: str) -> DataFrame:
    r = series.line(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select("n", F.round("pearson", 6).alias("pearson"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
  r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
  SELECT count(*) AS n, round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 6) AS spearman FROM r""")
def spearman_quantity_price(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("v"))
    first = e.agg(F.min("hour").alias("zero"))
    return e.join(F.broadcast(first)).select("event_type", ((F.unix_timestamp("hour") - F.unix_timestamp("zero")) / 3600).cast("double").alias("t"), F.round("v", 2).alias("v"))


_HOURLY = "h AS (SELECT event_type, date_trunc('hour', ts) AS hour, round(sum(value), 2) AS v FROM events GROUP BY 1, 2), x AS (SELECT event_type, date_diff('second', (SELECT min(hour) FROM h), hour) / 3600.0 AS t, v FROM h)"


@query(f"""WITH {_HOURLY}, s AS (SELECT a.event_type, quantile_cont((b.v - a.v) / CAST(b.t - a.t AS DOUBLE), 0.5) AS slope FROM x a JOIN x b ON a.event_type = b.event_type AND a.t < b.t GROUP BY 1),
  m AS (SELECT event_type, count(*) AS n, quantile_cont(CAST(t AS DOUBLE), 0.5) AS mx, quantile_cont(v, 0.5) AS my FROM x GROUP BY 1)
  SELECT event_type, n, round(slope, 6) AS slope, round(my - slope * mx, 5) AS intercept FROM s JOIN m USING (event_type)""")
def theil_sen_hourly(spark: SparkSession, d: str) -> DataFrame:
    r = series.theil_sen(_daily(spark, d), "t", "v", ["event_type"])
    return r.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"""WITH {_HOURLY}, s AS (SELECT a.event_type, CAST(sum(sign(b.v - a.v)) AS DOUBLE) AS s FROM x a JOIN x b ON a.event_type = b.event_type AND a.t < b.t GROUP BY 1),
  c AS (SELECT event_type, v, CAST(count(*) AS DOUBLE) AS t FROM x GROUP BY 1, 2), q AS (SELECT event_type, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS term, sum(t * (t - 1) / 2) AS p FROM c GROUP BY 1),
  j AS (SELECT *, (n * (n - 1) * (2 * n + 5) - term) / 18 AS variance FROM s JOIN q USING (event_type))
  SELECT event_type, CAST(n AS BIGINT) AS n, s AS score, round(variance, 6) AS variance, round(CASE WHEN s > 0 THEN s - 1 WHEN s < 0 THEN s + 1 ELSE 0 END / sqrt(variance), 6) AS z, round(s / sqrt((n * (n - 1) / 2 - p) * (n * (n - 1) / 2)), 6) AS tau_b FROM j""")
def mann_kendall_hourly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.mann_kendall(_daily(spark, d), "t", "v", ["event_type"]))


@query(f"""WITH {_HOURLY}, w AS (SELECT event_type, t, v, lag(t) OVER o AS t0, lag(v) OVER o AS v0, row_number() OVER o AS i FROM x WINDOW o AS (PARTITION BY event_type ORDER BY t)),
  s AS (SELECT event_type, count(*) AS n, max(v) AS peak, max(CASE WHEN v > 0 AND v0 > 0 THEN (ln(v) - ln(v0)) / CAST(t - t0 AS DOUBLE) END) AS growth_rate, sum(coalesce(CAST(t - t0 AS DOUBLE) * (v + v0) / 2, 0)) AS auc, arg_max(v, t) AS final FROM w GROUP BY 1),
  p AS (SELECT event_type, min(t) AS peak_time, min(i) AS pi FROM w JOIN s USING (event_type) WHERE v = peak GROUP BY 1)
  SELECT event_type, n, peak, CAST(peak_time AS DOUBLE) AS peak_time, round(growth_rate, 6) AS growth_rate, round(ln(2) / growth_rate, 6) AS doubling_time, round(auc, 4) AS auc, final, n - pi > 2 AND final < 0.6 * peak AS crashes FROM s JOIN p USING (event_type)""")
def growth_descriptors_hourly(spark: SparkSession, d: str) -> DataFrame:
    r = series.growth(_daily(spark, d), "t", "v", ["event_type"])
    return r.select("event_type", "n", "peak", "peak_time", F.round("growth_rate", 6).alias("growth_rate"), F.round("doubling_time", 6).alias("doubling_time"), F.round("auc", 4).alias("auc"), "final", "crashes")


_AIC = "m AS (SELECT l_returnflag AS d, l_linestatus AS model, round(avg(l_discount) * 1000, 6) AS aicc FROM lineitem GROUP BY 1, 2)"


@query(f"""WITH {_AIC}, x AS (SELECT *, aicc - min(aicc) OVER (PARTITION BY d) AS delta FROM m)
  SELECT d, model, aicc, round(delta, 6) AS delta, round(exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY d), 6) AS weight FROM x""")
def akaike_weights(spark: SparkSession, d: str) -> DataFrame:
    m = load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("d"), F.col("l_linestatus").alias("model")).agg(F.round(F.avg("l_discount") * 1000, 6).alias("aicc"))
    return rounded(series.akaike(m, "aicc", ["d"]))


_P = "p AS (SELECT n_regionkey AS d, n_nationkey AS t, ((n_nationkey * 37 + 11) % 101) / 1000.0 AS p FROM nation)"


def _p_values(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_regionkey").alias("d"), F.col("n_nationkey").alias("t"), (F.pmod(F.col("n_nationkey") * 37 + 11, F.lit(101)) / F.lit(1000.0)).cast("double").alias("p"))


@query(f"""WITH {_P}, r AS (SELECT d, t, CAST(p AS DOUBLE) AS p, (count(*) OVER (PARTITION BY d) - row_number() OVER (PARTITION BY d ORDER BY p, t) + 1) * CAST(p AS DOUBLE) AS x FROM p)
  SELECT d, t, p, round(least(1.0, max(x) OVER (PARTITION BY d ORDER BY p, t ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM r""")
def holm_p_values(spark: SparkSession, d: str) -> DataFrame:
    return groups.holm(_p_values(spark, d), "p", ["d"], ["t"]).withColumn("p_holm", F.round("p_holm", 9))


@query(f"""WITH {_P}, r AS (SELECT d, t, CAST(p AS DOUBLE) AS p, row_number() OVER (PARTITION BY d ORDER BY p, t) AS i, count(*) OVER (PARTITION BY d) AS m FROM p)
  SELECT d, t, p, round(least(1.0, min(p * m / i) OVER (PARTITION BY d ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_bh FROM r""")
def bh_p_values(spark: SparkSession, d: str) -> DataFrame:
    return groups.benjamini_hochberg(_p_values(spark, d), "p", ["d"], ["t"]).withColumn("p_bh", F.round("p_bh", 9))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return resample.indexed(load(spark, d, "supplier"), "s_suppkey", "s_acctbal")


_DRAW = "CAST(concat('0x', substr(md5(concat_ws('|', '20260901', CAST({r} AS VARCHAR), CAST({i} AS VARCHAR))), 1, 8)) AS BIGINT)"


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM s),
  d AS (SELECT r.range AS r, {_DRAW.format(r='r.range', i='s.idx')} % n AS idx FROM range(9999) r, s, n), b AS (SELECT r, avg(v) AS x FROM d JOIN s USING (idx) GROUP BY r)
  SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, round(stddev_samp(x), 6) AS se, round(avg(x), 6) AS mean FROM b""")
def bootstrap_mean_supplier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.percentile_interval(resample.bootstrap(_sample(spark, d), "s_acctbal", 9_999)))


@query("""WITH s AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS idx, s_acctbal AS v FROM supplier), t AS (SELECT count(*) AS n, sum(v) AS sv FROM s)
  SELECT idx, v AS s_acctbal, round((sv - v) / (n - 1), 5) AS left_out, round(sv / n - (sv - v) / (n - 1), 5) AS influence FROM s, t""")
def jackknife_supplier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.jackknife(_sample(spark, d), "s_acctbal"), "s_acctbal", digits=5)


def _left_out(name: str, statistic: str) -> str:
    return f"""WITH s AS (SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS idx, s_acctbal AS v FROM supplier), w AS (SELECT {statistic} AS w FROM s)
  SELECT a.idx, a.v AS s_acctbal, round({statistic.replace('v,', 'b.v,')}, 5) AS left_out, round(any_value(w) - ({statistic.replace('v,', 'b.v,')}), 5) AS influence FROM s a JOIN s b ON a.idx <> b.idx, w GROUP BY a.idx, a.v"""


def _jackknife(name: str, statistic: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(resample.jackknife(_sample(spark, d), "s_acctbal", name), "s_acctbal", digits=5)

    run.__name__ = f"jackknife_{name}_supplier"
    QUERIES[run.__name__], SQL[run.__name__] = run, _left_out(name, statistic)


_jackknife("median", "quantile_cont(v, 0.5)")
_jackknife("iqr", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)")


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, CASE WHEN s_nationkey < 12 THEN 'low' ELSE 'high' END AS g, s_acctbal AS v FROM supplier), k AS (SELECT count(*) FILTER (g = 'low') AS k FROM s),
  o AS (SELECT avg(v) FILTER (g = 'low') - avg(v) FILTER (g = 'high') AS o FROM s),
  d AS (SELECT r.range AS r, v, row_number() OVER (PARTITION BY r.range ORDER BY md5(concat_ws('|', '20260901', CAST(r.range AS VARCHAR), CAST(idx AS VARCHAR))), idx) <= k AS f FROM range(9999) r, s, k),
  x AS (SELECT r, avg(v) FILTER (f) - avg(v) FILTER (NOT f) AS x FROM d GROUP BY r)
  SELECT round(max(o), 6) AS observed, round((count(*) FILTER (abs(x) >= abs(o) - 1e-9) + 1) / 10000.0, 6) AS p_value FROM x, o""")
def shuffle_test_supplier(spark: SparkSession, d: str) -> DataFrame:
    rows = resample.indexed(load(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal").withColumn("g", F.when(F.col("s_nationkey") < 12, "low").otherwise("high"))
    return rounded(resample.shuffle_test(rows, "g", "s_acctbal", "low", "high", 9_999))


def t_p(t: str, df: str) -> str:
    """SQL for the two-sided p of Student's t: one less twice the density's Simpson sum from 0 to |t|."""
    return f"""greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * abs({t}) / 6000 *
      list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow({t} * i / 2000.0, 2) / {df}, -({df} + 1) / 2.0))))"""


@query(f"""WITH {_SUMMARY}, p AS (SELECT a.g AS a_group_label, b.g AS b_group_label, a.m - b.m AS d, a.n AS n, b.n AS k, a.v / a.n AS x, b.v / b.n AS y, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS s FROM s a JOIN s b ON a.g < b.g),
  t AS (SELECT *, d / sqrt(x + y) AS welch_t, (x + y) * (x + y) / (x * x / (n - 1) + y * y / (k - 1)) AS welch_df, d / s * (1 - 3.0 / (4 * (n + k - 2) - 1)) AS hedges_g FROM p), q AS (SELECT *, {t_p('welch_t', 'welch_df')} AS p_value FROM t),
  h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p_value, a_group_label, b_group_label) + 1) * p_value AS raised FROM q)
  SELECT a_group_label, b_group_label, round(welch_t, 6) AS welch_t, round(welch_df, 6) AS welch_df, round(p_value, 6) AS p_value, round(least(1.0, max(raised) OVER (ORDER BY p_value, a_group_label, b_group_label ROWS UNBOUNDED PRECEDING)), 6) AS p_holm, round(hedges_g, 6) AS hedges_g FROM h""")
def post_hoc_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(post_hoc(load(spark, d, "customer"), "c_mktsegment", "c_acctbal"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return resample.indexed(load(spark, d, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal").withColumn("g", F.when(F.col("s_nationkey") < 12, "low").otherwise("high"))


@query(f"""WITH s AS (SELECT CASE WHEN s_nationkey < 12 THEN 'low' ELSE 'high' END AS g, row_number() OVER (PARTITION BY s_nationkey < 12 ORDER BY s_suppkey) - 1 AS slot, count(*) OVER (PARTITION BY s_nationkey < 12) AS size, s_acctbal AS v FROM supplier),
  d AS (SELECT r.range AS r, g, CAST(concat('0x', substr(md5(concat_ws('|', '20260901', CAST(r.range AS VARCHAR), g, CAST(slot AS VARCHAR))), 1, 8)) AS BIGINT) % size AS slot FROM s, range(999) r),
  x AS (SELECT r, d.g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM d JOIN s USING (g, slot) GROUP BY 1, 2),
  y AS (SELECT a.r, a.n + b.n - 2 AS f, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM x a JOIN x b ON a.r = b.r AND a.g = 'low' AND b.g = 'high'), z AS (SELECT d * (1 - 3.0 / (4 * f - 1)) AS g FROM y)
  SELECT round(quantile_cont(g, 0.025), 6) AS low, round(quantile_cont(g, 0.975), 6) AS high, round(stddev_samp(g), 6) AS se, round(avg(g), 6) AS mean FROM z""")
def effect_interval_supplier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.effect_interval(_two(spark, d), "g", "s_acctbal", "low", "high"))


@query()
def stability_supplier(spark: SparkSession, d: str) -> DataFrame:
    return robust.stability(_two(spark, d), "g", "s_acctbal")


@query(f"""WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS idx, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM s),
  d AS (SELECT r.range AS r, {_DRAW.format(r='r.range', i='s.idx')} % n AS idx FROM range(999) r, s, n), b AS (SELECT r, avg(v) AS x FROM d JOIN s USING (idx) GROUP BY r),
  c AS (SELECT quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM b), t AS (SELECT *, (mean - 4500) / (sd / sqrt(n)) AS t FROM n, c)
  SELECT n, round(mean, 6) AS mean, 'ttest' AS route, round(t, 6) AS statistic, round({t_p('t', '(n - 1)')}, 6) AS p_value, round((mean - 4500) / sd, 6) AS cohens_d, round(low, 6) AS low, round(high, 6) AS high, false AS refused FROM t""")
def one_sample_supplier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.one_sample(_sample(spark, d), "s_acctbal", 4500.0))


@query("""WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), x AS (SELECT CAST(least(39, floor((value - a) / (b - a) * 40)) AS INTEGER) AS bin, a, b FROM events, e)
  SELECT bin, round(a + bin * (b - a) / 40, 6) AS from_value, count(*) AS n FROM x GROUP BY bin, a, b""")
def histogram_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(robust.histogram(load(spark, d, "events"), "value"))


@query("SELECT l_orderkey, series, value FROM (SELECT l_orderkey, 'l_discount' AS series, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem)")
def long_series_lines(spark: SparkSession, d: str) -> DataFrame:
    return robust.long_series(load(spark, d, "lineitem"), "l_orderkey", "l_discount", "l_tax")


def _simpson(upper: str, density: str, pieces: int = 2000) -> str:
    """SQL for the integral from 0 to ``upper`` of a density in ``x``."""
    at = density.replace("@", f"({upper} * i / {float(pieces)})")
    return f"{upper} / {3 * pieces} * list_sum(list_transform(range({pieces + 1}), lambda i: (CASE WHEN i IN (0, {pieces}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at})))"


def chi2_p(x: str, df: str) -> str:
    return f"greatest(0.0, 1 - {_simpson(x, f'pow(@, {df} / 2.0 - 1) * exp(-@ / 2)')} / exp(lgamma({df} / 2.0) + {df} / 2.0 * ln(2)))"


@query(f"""WITH x AS (SELECT o_orderpriority AS d, o_orderstatus AS g, o_totalprice AS v FROM orders), s AS (SELECT d, g, count(*) AS n, avg(v) AS m, var_samp(v) AS var FROM x GROUP BY ALL),
  e AS (SELECT d, count(*) AS k, min(n) AS least_n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS between_, sum((n - 1) * var) AS within_ FROM s GROUP BY d),
  r AS (SELECT d, g, v, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0 AS r FROM x), t AS (SELECT d, sum(power(c, 3) - c) AS ties FROM (SELECT d, count(*) AS c FROM x GROUP BY d, v) GROUP BY d),
  q AS (SELECT d, sum(n) AS n, sum(s * s / n) AS ss FROM (SELECT d, g, count(*) AS n, CAST(sum(r) AS DOUBLE) AS s FROM r GROUP BY ALL) GROUP BY d),
  h AS (SELECT d, k, least_n, between_, within_, (12 / (CAST(n AS DOUBLE) * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM q JOIN t USING (d) JOIN e USING (d))
  SELECT d AS o_orderpriority, k, least_n, 'kruskal' AS route, round(h, 4) AS statistic, round({chi2_p('h', '(k - 1)')}, 6) AS p_value, round(between_ / (between_ + within_), 6) AS eta_squared, false AS refused FROM h""")
def compare_groups_by_priority(spark: SparkSession, d: str) -> DataFrame:
    r = compare_groups(load(spark, d, "orders"), "o_orderstatus", "o_totalprice", ["o_orderpriority"], prefer_robust=True)
    return r.select("o_orderpriority", "k", "least_n", "route", F.round("statistic", 4).alias("statistic"), F.round("p_value", 6).alias("p_value"), F.round("eta_squared", 6).alias("eta_squared"), "refused")


@query(f"""WITH x AS (SELECT c_mktsegment AS d, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS g, c_acctbal AS v FROM customer), s AS (SELECT d, g, count(*) AS n, avg(v) AS m, var_samp(v) AS v FROM x GROUP BY ALL),
  p AS (SELECT a.d, a.n AS n, b.n AS k, a.m - b.m AS diff, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM s a JOIN s b ON a.d = b.d AND a.g = 'high' AND b.g = 'low'),
  r AS (SELECT d, g, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0 AS r FROM x), u AS (SELECT d, CAST(sum(r) AS DOUBLE) AS ra FROM r WHERE g = 'high' GROUP BY d)
  SELECT d AS c_mktsegment, least(n, k) AS least_n, round(diff / sqrt(pooled) * (1 - 3.0 / (4 * (n + k - 2) - 1)), 6) AS hedges_g, round((ra - n * (n + 1) / 2.0) / (CAST(n AS DOUBLE) * k), 6) AS cles FROM p JOIN u USING (d)""")
def compared_pairs_segment(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").withColumn("g", F.when(F.col("c_nationkey") < 12, "low").otherwise("high"))
    r = compare_groups(c, "g", "c_acctbal", ["c_mktsegment"])
    return r.select("c_mktsegment", "least_n", F.round("hedges_g", 6).alias("hedges_g"), F.round("cles", 6).alias("cles"))



def f_p(f: str, d1: str, d2: str) -> str:
    return f"greatest(0.0, 1 - {_simpson(f, f'pow(@, {d1} / 2.0 - 1) * pow(1 + {d1} * @ / {d2}, -({d1} + {d2}) / 2.0)')} * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)) * pow({d1} / CAST({d2} AS DOUBLE), {d1} / 2.0))"


def normal_p(z: str) -> str:
    return f"greatest(0.0, 1 - 2 * {_simpson(f'least(12.0, abs({z}))', 'exp(-@ * @ / 2)')} / sqrt(2 * pi()))"


def _tested(name: str, kind: str, *arguments: str, sql: str) -> None:
    """A query ``name``_p: the query's rows with the p of its statistic, computed from the rounded columns in both engines."""
    base = QUERIES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return groups.with_p(base(spark, d), kind, *arguments).withColumn("p_value", F.round("p_value", 6))

    run.__name__ = f"{name}_p"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"SELECT *, round({sql}, 6) AS p_value FROM ({SQL[name]})"


_SPREAD = "sqrt(CAST(n_a AS DOUBLE) * n_b / 12 * ((n_a + n_b + 1) - tie_term / (CAST(n_a + n_b AS DOUBLE) * (n_a + n_b - 1))))"
_tested("anova_segment", "f", "f", "df_between", "df_within", sql=f_p("f", "df_between", "df_within"))
_tested("brown_forsythe_segment", "f", "levene", "df_between", "df_within", sql=f_p("levene", "df_between", "df_within"))
_tested("kruskal_priority", "chi2", "h", "df", sql=chi2_p("h", "df"))
_tested("chi_square_status_priority", "chi2", "chi2", "df", sql=chi2_p("chi2", "df"))
_tested("mann_whitney_events", "mann_whitney", "u", "n_a", "n_b", "tie_term", sql=normal_p(f"((greatest(u, CAST(n_a AS DOUBLE) * n_b - u) - CAST(n_a AS DOUBLE) * n_b / 2 - 0.5) / {_SPREAD})"))
_tested("wilcoxon_orders", "wilcoxon", "w_plus", "n", "tie_term", sql=normal_p("((w_plus - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - tie_term / 48))"))
_tested("mann_kendall_hourly", "normal", "z", sql=normal_p("z"))
_tested("t_tests_events", "t", "welch_t", "welch_df", sql=t_p("welch_t", "welch_df"))


@query(f"""WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem),
  r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x),
  c AS (SELECT count(*) AS n, corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)) AS r, regr_slope(b, a) AS slope, regr_intercept(b, a) AS intercept FROM r), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
  SELECT n, 'spearman' AS route, round(r, 6) AS coefficient, round({t_p('least(40.0, t)', '(n - 2)')}, 6) AS p_value, round(r * r, 6) AS r_squared, round(slope, 4) AS slope, round(intercept, 2) AS intercept, false AS refused FROM t""")
def correlate_quantity_price(spark: SparkSession, d: str) -> DataFrame:
    r = correlate(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return r.select("n", "route", F.round("coefficient", 6).alias("coefficient"), F.round("p_value", 6).alias("p_value"), F.round("r_squared", 6).alias("r_squared"), F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), "refused")


@query(f"""WITH x AS (SELECT o_orderstatus = 'F' AS a, o_orderpriority = '1-URGENT' AS b FROM orders), c AS (SELECT a, b, count(*) AS o FROM x GROUP BY 1, 2),
  t AS (SELECT a, b, o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c),
  s AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum(power(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS y, sum((o - e) * (o - e) / e) AS x, min(e) AS least FROM t)
  SELECT n, 'chi2' AS route, round(y, 6) AS statistic, CAST(1 AS BIGINT) AS df, round({normal_p('sqrt(y)')}, 6) AS p_value, round(least, 6) AS least_expected, round(sqrt(greatest(0.0, x / n - 1.0 / (n - 1)) / (2 - 1.0 / (n - 1) - 1)), 6) AS cramers_v FROM s""")
def contingency_test_urgent(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select((F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return rounded(contingency_test(o, "a", "b"))


@query(f"""WITH {_HOURLY}, s AS (SELECT a.event_type, (b.v - a.v) / CAST(b.t - a.t AS DOUBLE) AS slope, sign(b.v - a.v) AS g FROM x a JOIN x b ON a.event_type = b.event_type AND a.t < b.t),
  m AS (SELECT event_type, count(*) AS n, quantile_cont(CAST(t AS DOUBLE), 0.5) AS mx, quantile_cont(v, 0.5) AS my FROM x GROUP BY 1), q AS (SELECT event_type, quantile_cont(slope, 0.5) AS slope, CAST(sum(g) AS DOUBLE) AS score, count(*) AS size FROM s GROUP BY 1),
  c AS (SELECT event_type, v, CAST(count(*) AS DOUBLE) AS t FROM x GROUP BY 1, 2), k AS (SELECT event_type, sum(t) AS k, sum(t * (t - 1) * (2 * t + 5)) AS term, sum(t * (t - 1) / 2) AS p FROM c GROUP BY 1),
  j AS (SELECT *, (k * (k - 1) * (2 * k + 5) - term) / 18 AS variance FROM q JOIN m USING (event_type) JOIN k USING (event_type)),
  z AS (SELECT *, (score - sign(score)) / sqrt(variance) AS z, greatest(1.0, round_even((size - 1.959963984540054 * sqrt(variance)) / 2, 0)) AS lo, least(round_even((size + 1.959963984540054 * sqrt(variance)) / 2, 0), size) AS hi FROM j),
  r AS (SELECT event_type, slope AS e, row_number() OVER (PARTITION BY event_type ORDER BY slope) AS i FROM s), e AS (SELECT r.event_type, max(e) FILTER (i = lo) AS low, max(e) FILTER (i = hi) AS high FROM r JOIN z USING (event_type) GROUP BY 1), p AS (SELECT *, {normal_p('z')} AS p_value FROM z)
  SELECT event_type, n, score, round(z, 6) AS z, round(p_value, 6) AS p_value, round(score / sqrt((k * (k - 1) / 2 - p) * (k * (k - 1) / 2)), 6) AS tau_b, round(slope, 6) AS slope, round(my - slope * mx, 5) AS intercept, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN p_value >= 0.05 THEN 'none' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM p JOIN e USING (event_type)""")
def trend_test_hourly(spark: SparkSession, d: str) -> DataFrame:
    r = rounded(trend_test(_daily(spark, d), "t", "v", ["event_type"]), "intercept")
    return r.withColumn("intercept", F.round("intercept", 5))
