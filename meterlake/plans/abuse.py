"""Queries of abuse detection; day-long windows suit the sparse sample logs."""

from __future__ import annotations

from meterlake.operators import abuse as A
from meterlake.operators.logs import with_owner
from meterlake.plans import NOW, query
from meterlake.sources import samples as S

DAYS = A.Settings(
    window=86_400,
    least_quota=2_500,
    least_requests=3,
    least_errors=1,
    consume_ratio=1.2,
    request_ratio=1.1,
    error_ratio=1.05,
    gate_requests=1,
    lookback=20 * 86_400,
    most_span=25 * 86_400,
)
FIRST, CURRENT, END, LOOKBACK = A.bounds(NOW - 2 * 86_400 + 5, DAYS)
COUNTS = f"""counts AS (SELECT token_id, created_at // 86400 * 86400 AS bucket, count(*) AS requests,
  count(*) FILTER (type = 2) AS consumes, CAST(COALESCE(sum(quota) FILTER (type = 2), 0) AS BIGINT) AS quota,
  count(*) FILTER (type = 5) AS errors,
  count(*) FILTER (type = 2 AND other LIKE '%"quota_saturation":%') AS saturated_rows,
  CAST(COALESCE(sum(quota) FILTER (type = 2 AND other LIKE '%"quota_saturation":%'), 0) AS BIGINT) AS saturated_quota
  FROM logs WHERE token_id > 0 AND created_at >= {FIRST} AND created_at < {END} GROUP BY 1, 2)"""
SPINE = f"(SELECT {FIRST} + k * 86400 AS bucket FROM range(6) t(k))"
BASE = f"""base AS (SELECT t.token_id, median(COALESCE(requests, 0)) AS median_requests,
  median(COALESCE(quota - saturated_quota, 0)) AS median_quota, count(*) FILTER (requests >= 1) < 3 AS gated,
  CAST(COALESCE(sum(consumes), 0) AS BIGINT) AS base_consumes, CAST(COALESCE(sum(errors), 0) AS BIGINT) AS base_errors
  FROM (SELECT DISTINCT token_id FROM counts) t CROSS JOIN {SPINE} s LEFT
  JOIN counts c ON c.token_id = t.token_id AND c.bucket = s.bucket GROUP BY 1),
  joined AS (SELECT b.*, COALESCE(requests, 0) AS requests, COALESCE(quota - saturated_quota, 0) AS quota,
  COALESCE(consumes, 0) AS consumes, COALESCE(errors, 0) AS errors FROM base b LEFT
  JOIN counts c ON b.token_id = c.token_id AND c.bucket = {CURRENT})"""
RATE, THEN = "errors / NULLIF(CAST(consumes + errors AS DOUBLE), 0)", "base_errors / NULLIF(CAST(base_consumes + base_errors AS DOUBLE), 0)"
WITH = S.with_(S.LOGS, COUNTS)


def counts(spark, sf_dir):
    return A.window_counts(S.logs(spark, sf_dir), FIRST, END, DAYS.window)


def rows(spark, sf_dir):
    return A.baselines(counts(spark, sf_dir), FIRST, CURRENT, DAYS)


@query(WITH + "SELECT * FROM counts")
def d1_d2_window_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@query(WITH + f""", {BASE} SELECT token_id, median_requests, median_quota, gated, requests, quota, base_consumes,
  base_errors FROM joined""")
def d3_d5_baselines(spark, sf_dir):
    return rows(spark, sf_dir).select(
        "token_id", "median_requests", "median_quota", "gated", "requests", "quota", "base_consumes", "base_errors"
    )


SPIKES = f"""f AS (SELECT token_id, 'consume_spike' AS rule, 'high' AS severity, CAST(quota AS DOUBLE) AS current,
  median_quota AS baseline FROM joined WHERE NOT gated AND quota >= 1.2 * median_quota AND quota >= 2500
  UNION ALL SELECT token_id, 'request_spike', 'medium', CAST(requests AS DOUBLE), median_requests FROM joined
  WHERE NOT gated AND requests >= CAST(1.1 AS DOUBLE) * median_requests AND requests >= 3
  UNION ALL SELECT token_id, 'error_rate_spike', 'high', {RATE}, {THEN} FROM joined
  WHERE NOT gated AND base_errors > 0 AND {RATE} >= CAST(1.05 AS DOUBLE) * {THEN} AND errors >= 1)"""


@query(WITH + f""", {BASE}, {SPIKES} SELECT *, COALESCE(current / NULLIF(baseline, 0), 0) AS ratio, 'up' AS direction,
  CAST(0 AS BIGINT) AS excluded_rows FROM f""")
def d6_d8_spikes(spark, sf_dir):
    return A.spike_findings(rows(spark, sf_dir), DAYS)


FIRST_USE = f"""u AS (SELECT token_id, model_name, min(created_at) AS first_at, count(*) AS n FROM logs
  WHERE token_id > 0 AND model_name <> '' AND created_at >= {LOOKBACK} AND created_at < {END} GROUP BY 1, 2),
  w AS (SELECT *, sum(n) OVER (PARTITION BY token_id) AS requests FROM u)"""


@query(S.with_(S.LOGS, FIRST_USE) + f"""SELECT token_id, model_name, 'new_model' AS rule, 'medium' AS severity,
  first_at FROM w WHERE first_at >= {CURRENT} AND requests >= 40""")
def d9_new_models(spark, sf_dir):
    return A.new_models(S.logs(spark, sf_dir), LOOKBACK, CURRENT, END, 40)[0]


@query(WITH + f""", {FIRST_USE}, {BASE} SELECT token_id, rule, 'insufficient_baseline' AS reason
  FROM joined, (VALUES ('consume_spike'), ('request_spike'), ('error_rate_spike')) r(rule) WHERE gated
  UNION ALL SELECT token_id, 'error_rate_spike', 'insufficient_baseline' FROM joined
  WHERE NOT gated AND base_errors = 0
  UNION ALL SELECT DISTINCT token_id, 'new_model', 'insufficient_baseline' FROM w
  WHERE first_at >= {CURRENT} AND requests < 1""")
def d10_skips(spark, sf_dir):
    return A.detect(S.logs(spark, sf_dir), NOW - 2 * 86_400 + 5, DAYS)[1]


@query(WITH + f""", {FIRST_USE}, {BASE}, {SPIKES}, {S.TOKENS}, {S.USERS}, found AS (SELECT token_id, rule, severity,
  COALESCE(current / NULLIF(baseline, 0), 0) AS ratio, NULL AS model_name FROM f
  UNION ALL SELECT token_id, 'new_model', 'medium', NULL, model_name FROM w
  WHERE first_at >= {CURRENT} AND requests >= 1)
  SELECT token_id, rule, severity, ratio, model_name, tokens.name AS token_name, users.username AS owner_name
  FROM found LEFT JOIN tokens ON token_id = tokens.id LEFT JOIN users ON tokens.user_id = users.id""")
def d11_findings(spark, sf_dir):
    """All findings of one scan with the owners of their tokens; findings without an owner stay."""
    found = A.detect(S.logs(spark, sf_dir), NOW - 2 * 86_400 + 5, DAYS)[0]
    owned = with_owner(found, S.tokens(spark, sf_dir), S.users(spark, sf_dir))
    return owned.select("token_id", "rule", "severity", "ratio", "model_name", "token_name", "owner_name")


@query(S.with_(S.LOGS) + f"""SELECT min(created_at) AS earliest, min(created_at) <= {NOW - 6 * 86400} AS ready, CASE
  WHEN min(created_at) > {NOW - 6 * 86400} THEN min(created_at) + {6 * 86400} END AS ready_at FROM logs""")
def d12_readiness(spark, sf_dir):
    return A.readiness(S.logs(spark, sf_dir), NOW, DAYS)
