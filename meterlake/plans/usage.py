"""Queries of usage cubes and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import usage as U
from meterlake.plans import NOW, START, query
from meterlake.sources import samples as S

CUBE = """cube AS (SELECT user_id, username, model_name, created_at - created_at % 3600 AS created_at,
  "group" AS use_group, token_id, channel_id, '' AS node_name,
  CAST(count(*) AS BIGINT) AS "count", CAST(sum(quota) AS BIGINT) AS quota,
  CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS token_used
  FROM logs WHERE type = 2 GROUP BY ALL)"""
SUMS = 'CAST(sum("count") AS BIGINT) AS "count", CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(token_used) AS BIGINT) AS token_used'


def cube(spark, sf_dir):
    return U.hourly_cube(S.logs(spark, sf_dir))


WITH = S.with_(S.LOGS, CUBE)


@query(WITH + "SELECT * FROM cube")
def a1_hourly_cube(spark, sf_dir):
    return cube(spark, sf_dir)


@query(S.with_(S.VOLUME) + """SELECT user_id, username, model_name, created_at - created_at % 3600 AS created_at,
  "group" AS use_group, token_id, channel_id, 'n1' AS node_name,
  count(*) AS "count", CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(CASE WHEN channel_id = 3 THEN 0
  ELSE prompt_tokens + completion_tokens END) AS BIGINT) AS token_used FROM volume_logs WHERE type = 2 GROUP BY ALL""")
def a1_hourly_cube_volume(spark, sf_dir):
    return U.hourly_cube(S.volume_logs(spark, sf_dir), "n1", task_billing=F.col("channel_id") == 3)


@query(WITH + f""", doubled AS (SELECT row_number() OVER () AS x, *, created_at AS id FROM cube UNION ALL
  SELECT 0, *, created_at + 1 FROM cube WHERE channel_id < 3)
  SELECT user_id, COALESCE(NULLIF(username, 'user-1'), '') AS username, model_name, created_at, use_group, token_id,
  channel_id, node_name, CAST(min(id) AS BIGINT) AS id, {SUMS}
  FROM doubled GROUP BY user_id, COALESCE(NULLIF(username, 'user-1'), ''), model_name, created_at, use_group,
  token_id, channel_id, node_name""")
def a2_dedupe_cube(spark, sf_dir):
    c = cube(spark, sf_dir).withColumn("username", F.nullif(F.col("username"), F.lit("user-1")))
    twice = c.withColumn("id", F.col("created_at")).unionByName(
        c.where("channel_id < 3").withColumn("id", F.col("created_at") + 1)
    )
    return U.dedupe_cube(twice)


@query(WITH + f"SELECT user_id, username, model_name, created_at, {SUMS} FROM cube WHERE user_id = 17 GROUP BY ALL")
def a3_usage_of_user(spark, sf_dir):
    return U.usage_by(cube(spark, sf_dir).where("user_id = 17"), "user_id", "username", "model_name", "created_at")


@query(WITH + f"SELECT username, created_at, {SUMS} FROM cube GROUP BY ALL")
def a4_usage_by_user(spark, sf_dir):
    return U.usage_by(cube(spark, sf_dir), "username", "created_at")


@query(WITH + f"SELECT model_name, created_at, {SUMS} FROM cube GROUP BY ALL")
def a5_usage_by_model(spark, sf_dir):
    return U.usage_by(cube(spark, sf_dir), "model_name", "created_at")


@query(WITH + f"""SELECT username, model_name, created_at, CAST(grouping(username, model_name,
  created_at) AS BIGINT) AS level, {SUMS} FROM cube GROUP BY GROUPING SETS ((username, created_at), (model_name,
  created_at), (created_at), ())""")
def a6_usage_levels(spark, sf_dir):
    return U.usage_levels(cube(spark, sf_dir))


@query(WITH + f"""SELECT CAST(COALESCE(sum(quota) FILTER (created_at BETWEEN {START} AND {NOW - 86400}),
  0) AS BIGINT) AS quota, count(*) FILTER (created_at >= {NOW - 86400 - 60}) AS rpm,
  CAST(COALESCE(sum(prompt_tokens + completion_tokens) FILTER (created_at >= {NOW - 86400 - 60}), 0) AS BIGINT) AS tpm
  FROM logs WHERE type = 2""")
def a7_log_stat(spark, sf_dir):
    return U.log_stat(S.logs(spark, sf_dir), NOW - 86400, START, NOW - 86400)


@query(WITH + f"""SELECT CAST(COALESCE(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS tokens FROM logs
  WHERE type = 2 AND created_at BETWEEN {START} AND {NOW}""")
def a8_token_total(spark, sf_dir):
    return U.token_total(S.logs(spark, sf_dir), START, NOW)


@query(WITH + f"""SELECT {SUMS}, round(sum("count") / {(NOW - START) / 60.0} * 1000) / 1000 AS avg_rpm,
  round(sum(token_used) / {(NOW - START) / 60.0} * 1000) / 1000 AS avg_tpm FROM cube""")
def a9_dashboard(spark, sf_dir):
    return U.dashboard(cube(spark, sf_dir), START, NOW)


def _flow(role, keys, more=""):
    return WITH + f"""SELECT {', '.join(keys)}, {SUMS} FROM cube WHERE created_at BETWEEN {START} AND {NOW}
  AND use_group <> '' {more} GROUP BY ALL"""


@query(_flow("root", U.FLOW_KEYS["root"]))
def a10_flow_root(spark, sf_dir):
    return U.flow_cube(cube(spark, sf_dir), "root", START, NOW)


@query(_flow("admin", U.FLOW_KEYS["admin"]))
def a10_flow_admin(spark, sf_dir):
    return U.flow_cube(cube(spark, sf_dir), "admin", START, NOW)


@query(_flow("self", U.FLOW_KEYS["self"], "AND user_id = 4"))
def a10_flow_self(spark, sf_dir):
    return U.flow_cube(cube(spark, sf_dir), "self", START, NOW, user_id=4)


@query(WITH + f"""SELECT model_name, CAST(sum(token_used) AS BIGINT) AS tokens FROM cube
  WHERE created_at BETWEEN {START} AND {NOW} AND model_name <> '' GROUP BY 1 HAVING sum(token_used) > 0""")
def a11_model_totals(spark, sf_dir):
    return U.model_totals(cube(spark, sf_dir), START, NOW)


@query(WITH + f"""SELECT model_name, created_at // 86400 * 86400 AS bucket, CAST(sum(token_used) AS BIGINT) AS tokens
  FROM cube WHERE created_at BETWEEN {START} AND {NOW} GROUP BY 1, 2 HAVING sum(token_used) > 0""")
def a12_model_buckets(spark, sf_dir):
    return U.model_buckets(cube(spark, sf_dir), START, NOW, 86400)


@query(S.with_(S.CHANNELS) + """SELECT type, count(*) AS channels, count(DISTINCT NULLIF(tag, '')) AS tags
  FROM channels GROUP BY 1""")
def a13_channels_by_type(spark, sf_dir):
    return U.channels_by_type(S.channels(spark, sf_dir))


@query("""SELECT s_suppkey AS vendor_id, COALESCE(n, 0) AS models FROM supplier LEFT
  JOIN (SELECT p_partkey % 37 * 3 AS vendor_id, count(*) AS n FROM part GROUP BY 1) ON vendor_id = s_suppkey""")
def a13_models_of_vendors(spark, sf_dir):
    models = S.table(spark, sf_dir, "part").select((F.col("p_partkey") % 37 * 3).alias("vendor_id"))
    return U.models_of_vendors(models, S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


@query(S.with_(S.LOGS) + """SELECT type, max(id) AS last_id, min(id) AS first_id, arg_max(username,
  id) AS last_username, arg_min(username, id) AS first_username FROM logs GROUP BY 1""")
def a14_newest_by_type(spark, sf_dir):
    return U.newest_by_type(S.logs(spark, sf_dir), "username")


@query(S.with_(S.AUDITS) + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, token_ref
  ORDER BY created_at DESC, event_id DESC) AS n FROM audits WHERE category = 'access_token')
  SELECT user_id, token_ref, created_at AS last_at, ip AS last_ip FROM r WHERE n = 1""")
def a15_last_access(spark, sf_dir):
    return U.last_access(S.audits(spark, sf_dir))


@query("""SELECT user_id, count(*) FILTER (strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-01'
  AND '2024-01-31') AS month_count, count(*) AS total_count, CAST(sum(event_id % 100) AS BIGINT) AS total_quota,
  max(strftime(ts, '%Y-%m-%d') = '2024-01-15') AS checked_today FROM events WHERE event_type = 'click' GROUP BY 1""")
def a16_checkins(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").where("event_type = 'click'")
    return U.checkin_stats(
        e.select(
            "user_id",
            F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd").alias("checkin_date"),
            (F.col("event_id") % 100).alias("quota"),
        ),
        "2024-01",
        "2024-01-15",
    )


@query(S.with_(S.LOGS) + """, d AS (SELECT 'user_quota' AS kind, user_id AS id, -quota AS delta FROM logs
  WHERE type = 2 UNION ALL SELECT 'used_quota', user_id, quota FROM logs WHERE type = 2
  UNION ALL SELECT 'requests', user_id, 1 FROM logs WHERE type = 2 UNION ALL SELECT 'token_quota', token_id, -quota
  FROM logs WHERE type = 2 UNION ALL SELECT 'channel_used', channel_id, quota FROM logs WHERE type = 2)
  SELECT kind, id, CAST(sum(delta) AS BIGINT) AS delta FROM d GROUP BY 1, 2""")
def a17_net_deltas(spark, sf_dir):
    # one pass over the logs, five deltas a row
    q = F.col("quota")
    kinds = [
        ("user_quota", "user_id", -q),
        ("used_quota", "user_id", q),
        ("requests", "user_id", F.lit(1)),
        ("token_quota", "token_id", -q),
        ("channel_used", "channel_id", q),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(i).cast("bigint").alias("id"), d.cast("bigint").alias("delta")) for k, i, d in kinds))
    return U.net_deltas(S.logs(spark, sf_dir).where("type = 2").select(F.inline(rows)))


@query(S.with_(S.LOGS) + """SELECT model_name, round(avg(use_time) * 1000) / 1000 AS mean,
  round(stddev_pop(use_time) * 1000) / 1000 AS deviation, count(*) AS probes FROM logs GROUP BY 1""")
def a18_probe_latency(spark, sf_dir):
    return U.probe_latency(S.logs(spark, sf_dir), "model_name", "use_time")


@query(S.with_(S.ABILITIES) + 'SELECT DISTINCT "group", model FROM abilities WHERE enabled')
def a19_models_of_groups(spark, sf_dir):
    return U.models_of_groups(S.abilities(spark, sf_dir))


@query(S.with_(S.LOGS) + """SELECT model_name, created_at // 86400 AS day, count(DISTINCT user_id) AS users, true AS near
  FROM logs GROUP BY 1, 2""")
def a19_rolled_up_counts(spark, sf_dir):
    """Users of each model and day by hourly sketches, beside the exact number: within 2 per cent of it."""
    logs, day = S.logs(spark, sf_dir), F.expr("created_at div 86400").alias("day")
    rolled = U.distinct_counts(U.distinct_sketches(logs, ["model_name"], "user_id"), ["model_name", day])
    exact = logs.groupBy("model_name", day).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("total") - F.col("users")) <= F.col("users") * 0.02
    return exact.join(rolled, ["model_name", "day"]).select("model_name", "day", "users", near.alias("near"))


@query(
    S.with_(
        S.ABILITIES
    ) + "SELECT model, list_sort(list(DISTINCT \"group\")) AS groups FROM abilities WHERE enabled GROUP BY 1"
)
def a20_groups_of_models(spark, sf_dir):
    return U.groups_of_models(S.abilities(spark, sf_dir))


@query(S.with_(S.ABILITIES, S.CHANNELS, S.ENDPOINTS, S.MODEL_ENDPOINTS) + "SELECT * FROM model_endpoints")
def a20_endpoints_of_models(spark, sf_dir):
    return U.endpoints_of_models(S.abilities(spark, sf_dir), S.channels(spark, sf_dir), S.endpoints(spark, sf_dir))


@query(WITH + f""", old AS (SELECT * FROM cube WHERE channel_id < 5), new AS (SELECT * FROM cube WHERE channel_id > 2)
  SELECT user_id, username, model_name, created_at, use_group, token_id, channel_id, node_name, {SUMS} FROM (SELECT *
  FROM old UNION ALL SELECT * FROM new) GROUP BY ALL""")
def s6_upsert_add(spark, sf_dir):
    c = cube(spark, sf_dir)
    return U.upsert_add(c.where("channel_id < 5"), c.where("channel_id > 2"), U.CUBE_KEY, U.MEASURES)
