"""Queries of health and performance."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scalars import health_window
from meterlake.operators import health as H
from meterlake.plans import NOW, query
from meterlake.sources import samples as S

FROM, UNTIL = health_window(NOW - 100, 240)
COUNTERS = """counters AS (SELECT model AS model_name, COALESCE(NULLIF("group", ''), 'default') AS "group",
  ts - ts % 300 AS bucket_ts, count(*) AS request_count, count(*) FILTER (success) AS success_count,
  CAST(COALESCE(sum(latency_ms) FILTER (latency_ms > 0), 0) AS BIGINT) AS total_latency_ms,
  CAST(COALESCE(sum(ttft_ms) FILTER (has_ttft AND ttft_ms >= 0), 0) AS BIGINT) AS ttft_sum_ms,
  count(*) FILTER (has_ttft AND ttft_ms >= 0) AS ttft_count,
  CAST(COALESCE(sum(output_tokens) FILTER (output_tokens > 0 AND generation_ms > 0), 0) AS BIGINT) AS output_tokens,
  CAST(COALESCE(sum(generation_ms) FILTER (output_tokens > 0 AND generation_ms > 0), 0) AS BIGINT) AS generation_ms
  FROM samples WHERE model <> '' GROUP BY 1, 2, 3)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in H.COUNTERS)
RATES = """CASE WHEN request_count > 0 THEN total_latency_ms // request_count
  ELSE 0 END AS avg_latency_ms, COALESCE(round(CAST(success_count * 100 AS DOUBLE) / NULLIF(request_count,
  0) * 100) / 100, 0) AS success_rate,
  COALESCE(round(CAST(output_tokens * 1000 AS DOUBLE) / NULLIF(generation_ms, 0) * 100) / 100, 0) AS tps, CASE
  WHEN ttft_count > 0 THEN ttft_sum_ms // ttft_count ELSE 0 END AS avg_ttft_ms"""
WITH = S.with_(S.SAMPLES, COUNTERS)


def counters(spark, sf_dir):
    return H.bucket_counters(S.samples(spark, sf_dir), 300)


CODES = ("", "invalid_api_key", "context_length_exceeded", "violation_fee.csam", "odd")
TYPES = ("invalid_request_error", "server_error", "")
RESPONSES = ("completed", "failed", "cancelled", "incomplete", "unknown")
REASONS = ("max_tokens", "safety", "other")
ENDS = ("done", "ping_fail", "client_gone", "timeout", "eof")


def relays(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.expr(f"event_id div {n}") % len(values) + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select(
        "event_id", (i % 41 == 0).alias("business_rejection"), (i % 43 == 0).alias("cancelled"), (i % 6 == 0).alias("has_error"), (i % 4 == 0).alias("error_local"), pick(CODES, 3).alias("error_code"), pick(TYPES, 5).alias("error_type"),
        (i % 30 + 395).alias("error_status"), pick(RESPONSES, 7).alias("response"), pick(REASONS, 11).alias("incomplete_reason"), pick(ENDS, 2).alias("end_reason"), (i % 13 == 0).alias("has_stream_errors"), (i % 17 == 0).alias("deadline_exceeded"), (i % 3 == 0).alias("expects_terminal"),
        S.text("model-", i % 23).alias("model"), F.lit("").alias("group"), S.unix("ts").alias("ts"), (i % 2 == 0).alias("is_stream"), F.lit(1000).alias("start_ms"), F.when(i % 5 == 0, 0).otherwise(1000 + i % 700).alias("first_ms"), (1000 + i % 900).alias("end_ms"), (i % 251).alias("output_tokens"),
    )


def _pick(values, n):
    return "CASE event_id // %d %% %d %s END" % (
        n, len(values), " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    )


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


RELAYS = f"""relays AS (SELECT event_id, event_id % 41 = 0 AS business, event_id % 43 = 0 AS cancelled,
  event_id % 6 = 0 AS has_error, event_id % 4 = 0 AS is_local, {_pick(CODES, 3)} AS code, {_pick(TYPES, 5)} AS kind,
  event_id % 30 + 395 AS status,
  {_pick(RESPONSES, 7)} AS response, {_pick(REASONS, 11)} AS reason, {_pick(ENDS, 2)} AS ended,
  event_id % 13 = 0 AS errors, event_id % 17 = 0 AS deadline, event_id % 3 = 0 AS expects FROM events),
  outcomes AS (SELECT event_id, CASE WHEN business OR cancelled THEN 'ignored'
  WHEN response = 'failed' OR has_error THEN CASE WHEN is_local AND response <> 'failed' THEN CASE
  WHEN code LIKE 'violation_fee.%' OR code IN {_in(H.LOCAL_IGNORED)} THEN 'ignored' ELSE 'failure' END
    WHEN code IN {_in(H.FAILURES)} THEN 'failure' WHEN code IN {_in(H.IGNORED)}
    OR code LIKE 'violation_fee.%' THEN 'ignored' WHEN kind IN {_in(H.FAILURES)} THEN 'failure'
    WHEN kind IN {_in(H.IGNORED)} THEN 'ignored'
    WHEN status IN (400, 405, 409, 413, 415, 422) THEN 'ignored' ELSE 'failure' END
  WHEN response = 'cancelled' OR ended = 'ping_fail' THEN 'ignored'
  WHEN ended = 'client_gone' AND NOT deadline THEN 'ignored'
  WHEN response = 'incomplete' THEN CASE reason WHEN 'max_tokens' THEN 'success' WHEN 'safety' THEN 'ignored'
  ELSE 'failure' END
  WHEN errors OR deadline OR ended = 'timeout' THEN 'failure'
  WHEN expects AND response = 'unknown' AND ended <> 'done' THEN 'failure' ELSE 'success' END AS outcome FROM relays)"""


@query(S.with_(RELAYS) + "SELECT * FROM outcomes")
def p1_outcomes(spark, sf_dir):
    return relays(spark, sf_dir).select("event_id", H.outcome().alias("outcome"))


@query(S.with_(RELAYS) + """, t AS (SELECT e.event_id, outcome, CASE WHEN e.event_id % 2 = 0
  AND e.event_id % 5 <> 0 THEN 1000 + e.event_id % 700 ELSE 0 END AS first, 1000 + e.event_id % 900 AS fin
  FROM outcomes o JOIN events e USING (event_id) WHERE outcome <> 'ignored')
  SELECT event_id % 23 AS model, count(*) AS n, CAST(sum(fin - 1000) AS BIGINT) AS latency, CAST(sum(CASE
  WHEN first > 0 THEN first - 1000 ELSE 0 END) AS BIGINT) AS ttft, count(*) FILTER (first > 0) AS firsts,
  CAST(sum(CASE WHEN first > 0 AND fin - first > 0 THEN fin - first ELSE fin - 1000 END) AS BIGINT) AS generation
  FROM t GROUP BY 1""")
def p2_relay_samples(spark, sf_dir):
    rows = H.relay_samples(relays(spark, sf_dir))
    return rows.groupBy(F.substring("model", 7, 9).cast("bigint").alias("model")).agg(
        F.count("*").alias("n"),
        F.sum("latency_ms").alias("latency"),
        F.sum("ttft_ms").alias("ttft"),
        F.count_if("has_ttft").alias("firsts"),
        F.sum("generation_ms").alias("generation"),
    )


@query(S.with_(S.TASKS) + f""", f AS (SELECT *, CASE WHEN finish_time > 0 THEN finish_time
  ELSE {NOW} END AS fin, COALESCE(NULLIF(start_time, 0), submit_time) AS begun FROM tasks)
  SELECT id, CASE WHEN submit_time > 0 AND fin > submit_time THEN (fin - submit_time) * 1000
  ELSE 0 END AS latency_ms, CASE WHEN status = 'SUCCESS' AND total_tokens > 0 AND fin > begun THEN total_tokens
  ELSE 0 END AS output_tokens,
  CASE WHEN status = 'SUCCESS' AND total_tokens > 0 AND fin > begun THEN (fin - begun) * 1000
  ELSE 0 END AS generation_ms FROM f""")
def p3_task_samples(spark, sf_dir):
    t = S.tasks(spark, sf_dir).withColumns({"completion_tokens": F.lit(0), "group": F.lit("")})
    return H.task_samples(t.withColumn("model_name", F.col("id")), NOW).select(
        F.col("model").alias("id"), "latency_ms", "output_tokens", "generation_ms"
    )


@query(WITH + "SELECT * FROM counters")
def p4_bucket_counters(spark, sf_dir):
    return counters(spark, sf_dir)


@query(WITH + f"""SELECT model_name, request_count, {RATES}, hours, worst FROM (SELECT model_name, {SUMS}
  FROM counters WHERE bucket_ts BETWEEN {FROM} AND {UNTIL} AND "group" IN ('g1', 'default') GROUP BY 1)
  JOIN (SELECT model_name, count(*) AS hours, min(r) AS worst
  FROM (SELECT model_name, bucket_ts - bucket_ts % 3600 AS hour,
  round(CAST(sum(success_count) * 100 AS DOUBLE) / sum(request_count) * 100) / 100 AS r FROM counters
  WHERE bucket_ts BETWEEN {FROM} AND {UNTIL} AND "group" IN ('g1', 'default') GROUP BY 1, 2)
  GROUP BY 1) USING (model_name)""")
def p5_p6_model_summaries(spark, sf_dir):
    rows = H.model_summaries(counters(spark, sf_dir), FROM, UNTIL, ["g1", "default"])
    return rows.select(
        "*",
        F.size("series").cast("bigint").alias("hours"),
        F.array_min(F.transform("series", lambda p: p["success_rate"])).alias("worst"),
    ).drop("series")


@query(WITH + f"""SELECT "group", bucket_ts, request_count, {RATES} FROM (SELECT "group", bucket_ts, {SUMS}
  FROM counters WHERE bucket_ts BETWEEN {FROM} AND {UNTIL} AND model_name = 'model-7'
  GROUP BY GROUPING SETS (("group", bucket_ts), (bucket_ts), ("group"), ()))""")
def p7_model_detail(spark, sf_dir):
    return H.model_detail(counters(spark, sf_dir), "model-7", FROM, UNTIL)


@query(WITH + f"""SELECT request_count, {RATES} FROM (SELECT {SUMS} FROM counters
  WHERE bucket_ts BETWEEN {FROM} AND {UNTIL})""")
def p8_overall(spark, sf_dir):
    return H.overall(counters(spark, sf_dir), FROM, UNTIL)


HOURS = """hours AS (SELECT model_name, bucket_ts - bucket_ts % 3600 AS hour,
  round(CAST(sum(success_count) * 100 AS DOUBLE) / sum(request_count) * 100) / 100 AS success_rate FROM counters
  GROUP BY 1, 2)"""


@query(WITH + f""", {HOURS} SELECT *, CASE WHEN success_rate >= 100 THEN 'excellent'
  WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 70 THEN 'warning' ELSE 'critical' END AS grade FROM hours""")
def p9_p11_hourly_success(spark, sf_dir):
    return H.hourly_success(counters(spark, sf_dir), "model_name").withColumn(
        "grade", H.success_grade(F.col("success_rate"))
    )


@query(S.with_(S.LOGS) + """SELECT id, CASE WHEN completion_tokens < 100 OR use_time <= 0 THEN CASE
  WHEN use_time < 10 THEN 'fast' WHEN use_time < 30 THEN 'medium' ELSE 'slow' END
  WHEN CAST(completion_tokens AS DOUBLE) / use_time >= 30 THEN 'fast'
  WHEN CAST(completion_tokens AS DOUBLE) / use_time >= 15 THEN 'medium' ELSE 'slow' END AS response, CASE
  WHEN use_time < 5 THEN 'fast' WHEN use_time < 10 THEN 'medium' ELSE 'slow' END AS first_token FROM logs""")
def p10_response_class(spark, sf_dir):
    return S.logs(spark, sf_dir).select(
        "id", H.response_class().alias("response"), H.first_token_class(F.col("use_time")).alias("first_token")
    )


@query(WITH + f""", {HOURS} SELECT model_name, count(*) AS buckets, count(*) FILTER (success_rate < 100) AS incidents,
  min(success_rate) AS worst FROM hours GROUP BY 1""")
def p12_uptime(spark, sf_dir):
    return H.uptime(H.hourly_success(counters(spark, sf_dir), "model_name"), "model_name")


@query(S.with_(S.LOGS) + """, n AS (SELECT id, model_name AS req, CASE
  WHEN id % 5 = 0 THEN 'Vendor/Model-' || (id % 3) ELSE '' END AS up, CASE id % 4
  WHEN 0 THEN upper(model_name) || '-2024' WHEN 1 THEN 'x/' || model_name WHEN 2 THEN ''
  ELSE 'vendor/model-1' END AS got FROM logs)
  SELECT id, got <> '' AND (req <> '' OR up <> '') AND NOT ((req <> '' AND (starts_with(lower(got), lower(req))
  OR ends_with(lower(got), lower(req)))) OR (up <> '' AND (starts_with(lower(got), lower(up)) OR ends_with(lower(got),
  lower(up))))) AS mismatch FROM n""")
def p13_model_mismatch(spark, sf_dir):
    i = F.col("id")
    got = F.when(
        i % 4 == 0, F.concat(F.upper("model_name"), F.lit("-2024"))
    ).when(i % 4 == 1, F.concat(F.lit("x/"), "model_name")).when(i % 4 == 2, "").otherwise("vendor/model-1")
    up = F.when(i % 5 == 0, S.text("Vendor/Model-", i % 3)).otherwise("")
    return S.logs(spark, sf_dir).select("id", H.model_mismatch(F.col("model_name"), up, got).alias("mismatch"))
