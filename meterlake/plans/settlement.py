"""Queries of subscriptions and task settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import settlement as B
from meterlake.plans import query
from meterlake.sources import samples as S

NOW = 893_462_400 + 5_000  # in the middle of the sample orders
SUB = S.with_(S.SUBSCRIPTIONS)
T0 = "TIMESTAMP '1970-01-01'"


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderdate + to_seconds(o_orderkey % 86400) AS t,
  o_orderkey % 5 AS unit, CAST(o_orderkey % 14 AS INTEGER) AS n FROM orders),
  m AS (SELECT *, date_trunc('month', t) + to_months(CASE unit WHEN 0 THEN n * 12 ELSE n END) AS first FROM s)
  SELECT id, CAST(CASE WHEN unit = 4 THEN epoch(t) + 12345 WHEN n <= 0 THEN NULL
  WHEN unit IN (0, 1) THEN epoch(first + to_days(CAST(day(t) - 1 AS INTEGER))) + CAST(epoch(t) AS BIGINT) % 86400
  WHEN unit = 2 THEN epoch(t) + n * 86400 ELSE epoch(t) + n * 3600 END AS BIGINT) AS end_time FROM m""")
def b1_plan_ends(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("year", "month", "day", "hour", "custom"))), (k % 5 + 1).cast("int"))
    rows = S.table(spark, sf_dir, "orders").select(
        k.alias("id"), (S.unix("o_orderdate") + k % 86400).alias("start"), unit.alias("unit"), (k % 14).alias("n")
    )
    return rows.select(
        "id", B.plan_end(F.col("start"), F.col("unit"), F.col("n"), F.lit(12345)).cast("bigint").alias("end_time")
    )


NEXT = "CASE {p} WHEN 'daily' THEN epoch(date_trunc('day', {t}) + INTERVAL 1 DAY) WHEN 'weekly' THEN epoch(date_trunc('week', {t}) + INTERVAL 7 DAY) WHEN 'monthly' THEN epoch(date_trunc('month', {t}) + INTERVAL 1 MONTH) ELSE 0 END"


@query(SUB + f""", n AS (SELECT id, end_time,
  CAST({NEXT.format(p='reset_period', t='make_timestamp(start_time * 1000000)')} AS BIGINT) AS t FROM subscriptions)
  SELECT id, CASE WHEN t > end_time THEN 0 ELSE t END AS next_reset FROM n""")
def b2_next_resets(spark, sf_dir):
    return S.subscriptions(spark, sf_dir).select(
        "id", B.next_reset(F.col("start_time"), F.col("reset_period"), F.lit(0), F.col("end_time")).alias("next_reset")
    )


AT = f"make_timestamp(CAST({NOW} AS BIGINT) * 1000000)"


@query(SUB + f""", d AS (SELECT *, CAST(CASE reset_period WHEN 'daily' THEN epoch(date_trunc('day', {AT}))
  WHEN 'weekly' THEN epoch(date_trunc('week', {AT})) ELSE epoch(date_trunc('month', {AT})) END AS BIGINT) AS b
  FROM subscriptions WHERE status = 'active' AND next_reset_time BETWEEN 1 AND {NOW} AND end_time > {NOW}),
  n AS (SELECT *, CAST({NEXT.format(p='reset_period', t='make_timestamp(b * 1000000)')} AS BIGINT) AS t FROM d
  WHERE b > last_reset_time) SELECT id, CAST(0 AS BIGINT) AS amount_used, b AS last_reset_time, CASE
  WHEN t > end_time THEN 0 ELSE t END AS next_reset_time FROM n""")
def b3_due_resets(spark, sf_dir):
    return B.due_resets(S.subscriptions(spark, sf_dir), NOW).select(
        "id", "amount_used", "last_reset_time", "next_reset_time"
    )


AFTER = f"""after AS (SELECT * REPLACE (CASE WHEN status = 'active' AND end_time <= {NOW} THEN 'expired'
  ELSE status END AS status), status = 'active' AND end_time <= {NOW} AS due FROM subscriptions)"""


@query(S.with_(S.SUBSCRIPTIONS, AFTER) + f""", last AS (SELECT user_id, downgrade_group, upgrade_group, prev_group
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_time DESC, id DESC) AS n FROM after
  WHERE status = 'expired' AND (downgrade_group <> '' OR upgrade_group <> '')) WHERE n = 1),
  u AS (SELECT DISTINCT user_id FROM after WHERE due AND user_id NOT IN (SELECT user_id FROM after
  WHERE status = 'active' AND end_time > {NOW} AND upgrade_group <> '')),
  t AS (SELECT user_id, 'up-' || (user_id % 4) AS current, CASE WHEN downgrade_group <> '' THEN downgrade_group
  WHEN upgrade_group = 'up-' || (user_id % 4) THEN prev_group END AS target FROM u JOIN last USING (user_id))
  SELECT user_id, target FROM t WHERE target <> current""")
def b4_group_changes(spark, sf_dir):
    subs = S.subscriptions(spark, sf_dir)
    users = subs.select(F.col("user_id").alias("id")).distinct().withColumn("group", S.text("up-", F.col("id") % 4))
    return B.expire(subs, users, NOW)[1]


@query(S.with_(S.SUBSCRIPTIONS, AFTER) + "SELECT id, user_id, status FROM after WHERE due")
def b4_expired(spark, sf_dir):
    subs = S.subscriptions(spark, sf_dir)
    users = subs.select(F.col("user_id").alias("id"), F.lit("").alias("group")).distinct()
    return B.expire(subs, users, NOW)[0].select("id", "user_id", "status")


@query(SUB + f"""SELECT id, user_id, row_number() OVER (PARTITION BY user_id
  ORDER BY end_time DESC, id DESC) AS place, bool_and(allow_overflow) OVER (PARTITION BY user_id) AS all_overflow
  FROM subscriptions WHERE status = 'active' AND end_time > {NOW}""")
def b5_active(spark, sf_dir):
    return B.active_subscriptions(S.subscriptions(spark, sf_dir), NOW).select(
        "id", "user_id", F.col("place").cast("bigint").alias("place"), "all_overflow"
    )


@query(S.with_(S.TASKS) + """SELECT id, user_id, channel_id, token_id, CASE WHEN actual_quota > quota THEN 2
  ELSE 6 END AS type, abs(actual_quota - quota) AS log_quota, actual_quota - quota AS delta FROM tasks
  WHERE actual_quota >= 0 AND actual_quota <> quota""")
def b6_settlement(spark, sf_dir):
    return B.settle_tasks(S.tasks(spark, sf_dir))


@query(S.with_(S.TASKS) + """SELECT id, CASE WHEN total_tokens > 0 AND id % 4 > 0 THEN CAST(floor(total_tokens *
  CAST(id % 4 * 0.25 AS DOUBLE) * CAST(0.75 AS DOUBLE) * CAST(1.5 AS DOUBLE)) AS BIGINT) END AS actual FROM tasks""")
def b7_task_quota(spark, sf_dir):
    return S.tasks(spark, sf_dir).select(
        "id", B.task_quota(F.col("total_tokens"), F.col("id") % 4 * 0.25, F.lit(0.75), F.lit(1.5)).alias("actual")
    )


@query(S.with_(S.TASKS) + """, r AS (SELECT * FROM tasks WHERE status = 'FAILURE' AND quota <> 0),
  k AS (SELECT 'user' AS kind, user_id AS id, -quota AS delta FROM r UNION ALL SELECT 'channel', channel_id, -quota
  FROM r UNION ALL SELECT 'token', token_id, -quota FROM r) SELECT kind, id, CAST(sum(delta) AS BIGINT) AS delta
  FROM k GROUP BY 1, 2""")
def b8_refunds(spark, sf_dir):
    return B.net_usage(B.refunds(S.tasks(spark, sf_dir)))
