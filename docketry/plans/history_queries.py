"""Queries over ``events`` as an answer log (user = session, event type = route, value = latency, props.k = tokens, errors = refusals), payroll over ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import evaluation as E
from docketry.operators import history as H
from docketry.operators import payroll as P
from docketry.plans.tables import load
from docketry.streaming.history import deduplicated, windowed_stats


def log(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.from_json("props", "k INT")["k"]
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), "ts", F.concat(F.lit("m"), F.col("user_id") % 3).alias("model_name"), F.col("event_type").alias("route_taken"),
        F.col("props").alias("query"), F.concat_ws(" ", "event_type", "props").alias("answer"), (F.col("event_type") == "error").alias("is_refused"), F.col("value").alias("total_latency_ms"),
        tokens.alias("input_tokens"), (tokens * 2).alias("output_tokens"), (tokens * 3).alias("total_tokens"), H.estimate_cost(tokens, tokens * 2).alias("estimated_cost_usd"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 4).cast("int")).alias("user_rating"),
    )


LOG = """log AS (
  SELECT event_id AS id, user_id AS session_id, ts, 'm' || (user_id % 3) AS model_name, event_type AS route_taken, props AS query, event_type || ' ' || props AS answer, event_type = 'error' AS is_refused,
         value AS total_latency_ms, (props::JSON->>'k')::INT AS input_tokens, 2 * (props::JSON->>'k')::INT AS output_tokens, 3 * (props::JSON->>'k')::INT AS total_tokens,
         round(((props::JSON->>'k')::INT * 0.15::DOUBLE + 2 * (props::JSON->>'k')::INT * 0.6::DOUBLE) / 1e6, 6) AS estimated_cost_usd, CASE WHEN event_id % 5 = 0 THEN (event_id % 4)::INT END AS user_rating
  FROM events)"""


def h1(spark, d):
    return H.history(log(spark, d), model="m1", refused=False, keyword="K\": 1", start="2024-01-05", end="2024-01-20").select("id", "session_id", "ts", "route_taken")


H1 = f"""WITH {LOG} SELECT id, session_id, ts, route_taken FROM log WHERE model_name = 'm1' AND NOT is_refused AND (contains(lower(query), 'k": 1') OR contains(lower(answer), 'k": 1'))
AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"""


def h2(spark, d):
    out = H.history_stats(log(spark, d))
    return out.withColumns({c: F.round(c, 4) for c in ("refusal_rate", "mean_latency_ms", "cost_usd")})


H2 = f"""WITH {LOG} SELECT 'total' AS kind, NULL::VARCHAR AS value, count(*) AS n, round(avg(is_refused::INT), 4) AS refusal_rate, round(avg(total_latency_ms), 4) AS mean_latency_ms,
  sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(estimated_cost_usd), 4) AS cost_usd FROM log
UNION ALL SELECT 'model_name', model_name, count(*), NULL, NULL, NULL, NULL, NULL FROM log GROUP BY model_name
UNION ALL SELECT 'route_taken', route_taken, count(*), NULL, NULL, NULL, NULL, NULL FROM log GROUP BY route_taken
UNION ALL SELECT 'user_rating', user_rating::VARCHAR, count(*), NULL, NULL, NULL, NULL, NULL FROM log WHERE user_rating IS NOT NULL GROUP BY user_rating"""


def h3(spark, d):
    titles = load(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))
    return H.sessions(log(spark, d), titles, keyword="error")


H3 = f"""WITH {LOG} , t AS (SELECT c_custkey AS session_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title FROM customer)
SELECT session_id, coalesce(any_value(title), arg_min(query, (ts, id))) AS title, count(*) AS n, arg_max(query, (ts, id)) AS latest_query, max(ts) AS latest
FROM log LEFT JOIN t USING (session_id) GROUP BY session_id HAVING bool_or(contains(lower(query), 'error') OR contains(lower(answer), 'error')) OR bool_or(coalesce(contains(lower(title), 'error'), false))"""


def h4(spark, d):
    old = load(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("title"), F.lit("2023-01-01").alias("created_at"), F.lit("2023-01-01").alias("updated_at"))
    new = log(spark, d).groupBy("session_id").agg(F.lit(None).cast("string").alias("title"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("created_at"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("updated_at"))
    return H.upsert_sessions(old, new)


H4 = f"""WITH {LOG}, n AS (SELECT session_id, strftime(min(ts), '%Y-%m-%d') AS a, strftime(max(ts), '%Y-%m-%d') AS b FROM log GROUP BY session_id)
SELECT coalesce(c_custkey, session_id) AS session_id, c_name AS title, CASE WHEN c_custkey IS NULL THEN a ELSE '2023-01-01' END AS created_at, coalesce(b, '2023-01-01') AS updated_at FROM customer FULL JOIN n ON c_custkey = session_id"""


def h5(spark, d):
    updates = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, 5).alias("user_rating"))
    return H.apply_feedback(log(spark, d).select("id", "session_id", "user_rating"), updates)


H5 = f"WITH {LOG} SELECT id, session_id, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE user_rating END AS user_rating FROM log LEFT JOIN orders ON id = o_orderkey"


def h6(spark, d):
    return H.delete_rows(log(spark, d), load(spark, d, "customer").select(F.col("c_custkey").alias("id"))).select("id", "route_taken")


H6 = f"WITH {LOG} SELECT id, route_taken FROM log WHERE id NOT IN (SELECT c_custkey FROM customer)"


def h7(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("query"), F.col("text").alias("answer"))
    return H.with_token_estimates(rows).select("conv_id", "turn", "input_tokens", "output_tokens", "estimated_cost_usd")


WORDS = r"len(list_filter(string_split_regex(coalesce({}, ''), '[\s\p{{Z}}]+'), lambda w: w <> ''))"
H7 = f"""WITH t AS (SELECT conv_id, turn, floor({WORDS.format("role")} * 1.3)::INT AS input_tokens, floor({WORDS.format("text")} * 1.3)::INT AS output_tokens FROM conversations)
SELECT *, round((input_tokens * 0.15::DOUBLE + output_tokens * 0.6::DOUBLE) / 1e6, 6) AS estimated_cost_usd FROM t"""


def h8(spark, d):
    out = windowed_stats(log(spark, d), F.window("ts", "1 day"))
    return out.withColumns({c: F.round(c, 6) for c in ("refusal_rate", "mean_latency_ms")})


H8 = f"""WITH {LOG} SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end", route_taken, count(*) AS n, round(avg(is_refused::INT), 6) AS refusal_rate,
round(avg(total_latency_ms), 6) AS mean_latency_ms, sum(total_tokens)::BIGINT AS tokens FROM log GROUP BY ALL"""


def h8_sliding(spark, d):
    out = windowed_stats(log(spark, d), F.window("ts", "12 hours", "6 hours"), by=("model_name",))
    return out.withColumns({c: F.round(c, 6) for c in ("refusal_rate", "mean_latency_ms")})


H8_SLIDING = f"""WITH {LOG}, w AS (SELECT *, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOURS]) AS start FROM log)
SELECT start, start + INTERVAL 12 HOURS AS "end", model_name, count(*) AS n, round(avg(is_refused::INT), 6) AS refusal_rate, round(avg(total_latency_ms), 6) AS mean_latency_ms, sum(total_tokens)::BIGINT AS tokens FROM w GROUP BY ALL"""


def h8_session(spark, d):
    out = windowed_stats(log(spark, d), F.session_window("ts", "2 hours"), by=("session_id",))
    return out.select("start", "end", "session_id", "n", "tokens")


H8_SESSION = f"""WITH {LOG}, f AS (SELECT *, coalesce(ts >= lag(ts) OVER o + INTERVAL 2 HOURS, true)::INT AS fresh FROM log WINDOW o AS (PARTITION BY session_id ORDER BY ts, id)
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", session_id, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM g GROUP BY session_id, s"""


def h9(spark, d):
    twice = log(spark, d).select("id", "ts", "route_taken")
    return twice.unionByName(twice.filter("id % 3 = 0")).dropDuplicates(["id"]) if not twice.isStreaming else deduplicated(twice)


H9 = f"WITH {LOG} SELECT id, ts, route_taken FROM log"


def m13(spark, d):
    out = E.latency_profile(log(spark, d), ["route_taken"], "total_latency_ms")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95", "share")})


M13 = f"""WITH {LOG}, r AS (SELECT route_taken, total_latency_ms AS v, row_number() OVER (PARTITION BY route_taken ORDER BY total_latency_ms) - 1 AS i, count(*) OVER (PARTITION BY route_taken) AS n FROM log WHERE total_latency_ms IS NOT NULL)
SELECT route_taken, any_value(n) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(min(v) FILTER (i = least(floor(0.95 * n), n - 1)), 6) AS p95, min(v) AS least, max(v) AS most,
  round(any_value(n) / sum(any_value(n)) OVER (), 6) AS share FROM r GROUP BY route_taken"""


def m12(spark, d):
    return E.count_matrix(log(spark, d), "model_name", "route_taken", ["click", "error", "purchase", "view", "none"])


M12 = f"""WITH {LOG} SELECT model_name, count(*) AS total, """ + ", ".join(
    f"count(*) FILTER (route_taken = '{v}') AS n_{v}, round(100.0 * count(*) FILTER (route_taken = '{v}') / count(*), 2)::DOUBLE AS pct_{v}" for v in ("click", "error", "purchase", "view", "none")
) + " FROM log GROUP BY model_name"


def daily(spark, d):
    """The slowest answer of each model and day."""
    return log(spark, d).groupBy("model_name", F.to_date("ts").alias("day")).agg(F.max("total_latency_ms").alias("value"))


DAILY = f"{LOG}, daily AS (SELECT model_name, ts::DATE AS day, max(total_latency_ms) AS value FROM log GROUP BY ALL)"


def m15(spark, d):
    out = E.paired_test(daily(spark, d), "day", "model_name", "value", "m0", "m1")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M15 = f"""WITH {DAILY}, p AS (SELECT a.value AS va, b.value AS vb, a.value - b.value AS d FROM daily a JOIN daily b USING (day) WHERE a.model_name = 'm0' AND b.model_name = 'm1'
), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM p
), w AS (SELECT least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w, count(*)::DOUBLE AS n, count(*) FILTER (d = 0)::DOUBLE AS z, sum(CASE WHEN d <> 0 THEN c * c - 1 ELSE 0 END)::DOUBLE AS ties FROM r)
SELECT count(*) AS n, round(avg(va), 6) AS mean_a, round(stddev_samp(va), 6) AS std_a, round(avg(vb), 6) AS mean_b, round(stddev_samp(vb), 6) AS std_b, round(avg(d), 6) AS mean_diff, round(stddev_samp(d), 6) AS std_diff,
  round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic, round(avg(d) / stddev_samp(d), 6) AS cohens_d, round(any_value(w.w), 6) AS wilcoxon_statistic,
  round(any_value((w.w - (w.n * (w.n + 1) - z * (z + 1)) / 4) / sqrt((w.n * (w.n + 1) * (2 * w.n + 1) - z * (z + 1) * (2 * z + 1) - ties / 2) / 24)), 6) AS wilcoxon_z FROM p, w"""


def m22(spark, d):
    return E.paired_comparison(daily(spark, d), "day", "model_name", "value", ["m0", "m1", "m2"]).withColumns({c: F.round(c, 6) for c in ("m1_gain", "m2_gain")})


M22 = f"""WITH {DAILY}, s AS (SELECT day, max(value) FILTER (model_name = 'm0') AS m0, max(value) FILTER (model_name = 'm1') AS m1, max(value) FILTER (model_name = 'm2') AS m2 FROM daily GROUP BY day)
SELECT *, round(m1 - m0, 6) AS m1_gain, round(m2 - m0, 6) AS m2_gain FROM s"""


def m19(spark, d):
    rows = daily(spark, d)
    side = lambda m: rows.filter(F.col("model_name") == m).select("day", "value")
    return E.compare_retrieval(side("m0"), side("m1"), "day", "value").withColumn("gain", F.round("gain", 6))


M19 = f"""WITH {DAILY}, j AS (SELECT coalesce(a.day, b.day) AS day, coalesce(a.value, 0) AS before, coalesce(b.value, 0) AS after FROM (SELECT * FROM daily WHERE model_name = 'm0') a FULL JOIN (SELECT * FROM daily WHERE model_name = 'm1') b ON a.day = b.day)
SELECT *, round(after - before, 6) AS gain, CASE WHEN after > before THEN 'IMPROVED' WHEN after < before THEN 'REGRESSED' ELSE 'MAINTAINED' END AS outcome FROM j"""


def m25(spark, d):
    rows = log(spark, d).withColumn("run", F.col("id") % 4)
    out = E.multirun_stats(rows, ["model_name"], "run", "session_id", "total_latency_ms", "route_taken")
    return out.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M25 = f"""WITH {LOG}, a AS (SELECT model_name, avg(total_latency_ms) AS mean, stddev_pop(total_latency_ms) AS std, quantile_cont(total_latency_ms, 0.5) AS median, quantile_cont(total_latency_ms, 0.95) AS p95 FROM log GROUP BY model_name
), b AS (SELECT model_name, stddev_pop(m) AS inter_run_std FROM (SELECT model_name, id % 4 AS run, avg(total_latency_ms) AS m FROM log GROUP BY ALL) GROUP BY model_name
), c AS (SELECT model_name, avg((k = 1)::INT) AS route_stability FROM (SELECT model_name, session_id, count(DISTINCT route_taken) AS k FROM log GROUP BY ALL) GROUP BY model_name)
SELECT model_name, round(mean, 5) AS mean, round(std, 5) AS std, round(median, 5) AS median, round(p95, 5) AS p95, round(inter_run_std, 5) AS inter_run_std, round(route_stability, 5) AS route_stability FROM a JOIN b USING (model_name) JOIN c USING (model_name)"""


def m26(spark, d):
    return E.stratified_pick(log(spark, d).select("id", "route_taken"), "route_taken", "id", 7)


M26 = f"""WITH {LOG}, r AS (SELECT id, route_taken, row_number() OVER (PARTITION BY route_taken ORDER BY id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY route_taken) // 7) AS s FROM log)
SELECT id, route_taken FROM r WHERE i % s = 0 AND i // s < 7"""


def m27(spark, d):
    prices = spark.createDataFrame([("small", 0.15, 0.60), ("large", 2.5, 10.0)], "model string, usd_in double, usd_out double")
    out = E.cost_matrix(log(spark, d), ["route_taken"], prices, scales=(1, 1000))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


M27 = f"""WITH {LOG}, s AS (SELECT route_taken, avg(input_tokens) AS i, avg(output_tokens) AS o, sum(input_tokens)::BIGINT AS si, sum(output_tokens)::BIGINT AS so, min(input_tokens) AS li, min(output_tokens) AS lo, max(input_tokens) AS ni, max(output_tokens) AS no FROM log GROUP BY ALL
), p AS (SELECT * FROM (VALUES ('small', 0.15::DOUBLE, 0.6::DOUBLE), ('large', 2.5, 10.0)) t(model, a, b)), c AS (SELECT *, (i * a + o * b) / 1e6 AS one FROM s, p)
SELECT route_taken, round(i, 6) AS mean_input_tokens, si AS sum_input_tokens, li AS least_input_tokens, ni AS most_input_tokens, round(o, 6) AS mean_output_tokens, so AS sum_output_tokens, lo AS least_output_tokens, no AS most_output_tokens,
  model, round(one, 6) AS usd_1, round(one * 25400, 6) AS local_1, round(one * 1000, 6) AS usd_1000, round(one * 1000 * 25400, 6) AS local_1000 FROM c"""


def payroll(spark, d):
    o = load(spark, d, "orders")
    k, salary = F.col("o_orderkey"), F.floor("o_totalprice").cast("double")
    kind = F.element_at(F.array(F.lit("normal"), F.lit("weekend"), F.lit("holiday")), (k % 3 + 1).cast("int"))
    return o.select(
        "o_orderkey", P.overtime_pay(salary, (k % 9).cast("double"), kind, k % 2 == 0, k % 5 < 3).alias("p1"), P.severance(salary, (k % 200).cast("double"), (k % 50).cast("double"), (k % 7).cast("double"), k % 4 == 0).alias("p2"),
        P.accident_benefit(salary, (k % 110).cast("double"), k % 3 == 0).alias("p3"), P.unemployment_benefit(salary, (k % 180).cast("double"), F.lit(4000.0)).alias("p4"),
    )


def p_all(spark, d):
    r = lambda c: F.round(c, 4).alias(c.replace(".", "_"))
    return payroll(spark, d).select("o_orderkey", *map(r, ("p1.rate", "p1.amount", "p2.years", "p2.months", "p2.amount", "p3.months", "p3.amount", "p4.monthly", "p4.months", "p4.amount")))


P_ALL = """WITH b AS (SELECT o_orderkey, o_orderkey % 3 AS kind, o_orderkey % 2 = 0 AS night, o_orderkey % 5 < 3 AS over, floor(o_totalprice) AS s, greatest(0, o_orderkey % 200 - o_orderkey % 50 - o_orderkey % 7) AS q, o_orderkey % 110 AS imp, o_orderkey % 180 AS paid FROM orders
), c AS (SELECT *, CASE kind WHEN 0 THEN 150.0 WHEN 1 THEN 200.0 ELSE 300.0 END::DOUBLE AS day, (q // 12 + CASE WHEN q % 12 = 0 THEN 0 WHEN q % 12 <= 6 THEN 0.5 ELSE 1 END)::DOUBLE AS years,
    (CASE WHEN imp >= 81 THEN 30.0 WHEN imp <= 10 THEN 1.5 ELSE 1.5 + (imp - 10) * 0.4 END * CASE WHEN o_orderkey % 3 = 0 THEN 0.4 ELSE 1 END)::DOUBLE AS m3, least(s * 0.6, 20000)::DOUBLE AS monthly,
    CASE WHEN paid < 36 THEN 3 ELSE least(12, 3 + (paid - 36) // 12) END::INT AS m4 FROM b
), e AS (SELECT *, CASE WHEN night AND over THEN day + 30 + 0.2 * day WHEN night THEN 130 WHEN over THEN day ELSE 100 END AS rate, CASE WHEN o_orderkey % 4 = 0 THEN greatest(2, years) ELSE years * 0.5 END AS m2 FROM c)
SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN round(rate, 4) END AS p1_rate, CASE WHEN o_orderkey % 9 > 0 THEN round(s * (rate / 100) * (o_orderkey % 9), 4) END AS p1_amount, round(years, 4) AS p2_years, round(m2, 4) AS p2_months,
  round(s * m2, 4) AS p2_amount, CASE WHEN imp BETWEEN 5 AND 100 THEN round(m3, 4) END AS p3_months, CASE WHEN imp BETWEEN 5 AND 100 THEN round(s * m3, 4) END AS p3_amount,
  CASE WHEN paid >= 12 THEN round(monthly, 4) END AS p4_monthly, CASE WHEN paid >= 12 THEN m4 END AS p4_months, CASE WHEN paid >= 12 THEN round(monthly * m4, 4) END AS p4_amount FROM e"""

QUERIES = {
    "h1_history": (h1, H1), "h2_history_stats": (h2, H2), "h3_sessions": (h3, H3), "h4_upsert_session": (h4, H4), "h5_apply_feedback": (h5, H5), "h6_delete_rows": (h6, H6), "h7_estimate_cost": (h7, H7),
    "h8_daily_stats": (h8, H8), "h8_sliding_stats": (h8_sliding, H8_SLIDING), "h8_session_stats": (h8_session, H8_SESSION), "h9_dedup_log": (h9, H9), "m12_routing_matrix": (m12, M12), "m13_branch_latency": (m13, M13),
    "m15_paired_test": (m15, M15), "m19_compare_retrieval": (m19, M19), "m22_paired_comparison": (m22, M22), "m25_multirun_stats": (m25, M25), "m26_stratified_pick": (m26, M26), "m27_cost_matrix": (m27, M27), "p1_p4_payroll": (p_all, P_ALL),
}
