"""Adapters: the library's tables derived from the sample star schema, and the same as DuckDB CTEs.

Plain integer arithmetic, so that both engines agree; each table grows with the one that it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unix(column: str) -> Column:
    """Whole unix seconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(SECONDS.format(f"cast(`{column}` as timestamp_ntz)"))


def text(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request logs in the 20-column form, from events."""
    e, i, u = table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("id"), u.alias("user_id"), unix("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "signup", 7).otherwise(2).alias("type"),
        text(F.col("event_type"), " ", i).alias("content"), text("user-", u).alias("username"), text("token-", u % 40).alias("token_name"),
        text("model-", i % 23).alias("model_name"), F.floor(F.col("value") * 1000).cast("bigint").alias("quota"),
        (i % 997).alias("prompt_tokens"), (i % 251).alias("completion_tokens"), (i % 61).alias("use_time"), (i % 2 == 0).alias("is_stream"),
        (i % 7).alias("channel_id"), u.alias("token_id"), F.when(u % 3 == 0, "default").when(u % 3 == 1, "vip").otherwise("").alias("group"),
        text("10.0.", u % 16, ".", i % 250).alias("ip"), i.cast("string").alias("request_id"), F.lit("").alias("upstream_request_id"), F.col("props").alias("other"),
    )


LOGS = """logs AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
  CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 7 ELSE 2 END AS type, event_type || ' ' || event_id AS content,
  'user-' || user_id AS username, 'token-' || (user_id % 40) AS token_name, 'model-' || (event_id % 23) AS model_name,
  CAST(floor(value * 1000) AS BIGINT) AS quota, event_id % 997 AS prompt_tokens, event_id % 251 AS completion_tokens,
  event_id % 61 AS use_time, event_id % 2 = 0 AS is_stream, event_id % 7 AS channel_id, user_id AS token_id,
  CASE user_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'vip' ELSE '' END AS "group",
  '10.0.' || (user_id % 16) || '.' || (event_id % 250) AS ip, CAST(event_id AS VARCHAR) AS request_id,
  '' AS upstream_request_id, props AS other FROM events)"""


def volume_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request logs from line items, for volume: six models, suppliers as tokens."""
    l, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    j = l.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), l["l_orderkey"] == o["o_orderkey"]).join(p.select("p_partkey", "p_type"), l["l_partkey"] == p["p_partkey"])
    return j.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("user_id"), (unix("l_shipdate") + F.col("l_linenumber") * 3600).alias("created_at"),
        F.when(F.col("l_returnflag") == "R", 6).otherwise(2).alias("type"), text("user-", F.col("o_custkey")).alias("username"), F.col("p_type").alias("model_name"),
        F.floor("l_extendedprice").cast("bigint").alias("quota"), (F.floor("l_quantity") * 10).cast("bigint").alias("prompt_tokens"), F.floor("l_quantity").cast("bigint").alias("completion_tokens"),
        (F.col("l_suppkey") % 11).alias("channel_id"), F.col("l_suppkey").alias("token_id"), F.col("o_orderpriority").alias("group"),
    )


VOLUME = """volume_logs AS (SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS user_id,
  CAST(floor(epoch(l_shipdate)) AS BIGINT) + l_linenumber * 3600 AS created_at, CASE WHEN l_returnflag = 'R' THEN 6
  ELSE 2 END AS type,
  'user-' || o_custkey AS username, p_type AS model_name, CAST(floor(l_extendedprice) AS BIGINT) AS quota,
  CAST(floor(l_quantity) AS BIGINT) * 10 AS prompt_tokens, CAST(floor(l_quantity) AS BIGINT) AS completion_tokens,
  l_suppkey % 11 AS channel_id, l_suppkey AS token_id, o_orderpriority AS "group"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels from suppliers; ids from 0; every fifth has no name, every fourth is disabled."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k - 1).alias("id"), F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").cast("bigint").alias("type"),
        F.when(k % 4 == 0, 2).otherwise(1).alias("status"), F.when(k % 3 == 0, "").otherwise(text("tag-", k % 6)).alias("tag"),
        text("model-", k % 9, ",model-", k % 7, ",,model-", k % 4).alias("models"), text("default,vip-", k % 3).alias("groups"),
        (k % 3).alias("priority"), (k % 4 * 10).alias("weight"),
    )


CHANNELS = """channels AS (SELECT s_suppkey - 1 AS id, CASE WHEN s_suppkey % 5 = 0 THEN ''
  ELSE s_name END AS name, CAST(s_nationkey AS BIGINT) AS type,
  CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 1 END AS status, CASE WHEN s_suppkey % 3 = 0 THEN ''
  ELSE 'tag-' || (s_suppkey % 6) END AS tag,
  'model-' || (s_suppkey % 9) || ',model-' || (s_suppkey % 7) || ',,model-' || (s_suppkey % 4) AS models,
  'default,vip-' || (s_suppkey % 3) AS groups, s_suppkey % 3 AS priority, s_suppkey % 4 * 10 AS weight FROM supplier)"""


def abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which channel serves which model to which group, from parts."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(text("g", F.col("p_size") % 3).alias("group"), F.col("p_brand").alias("model"), (F.col("p_partkey") % 40).alias("channel_id")).agg(
        F.max(F.col("p_partkey") % 6 != 0).alias("enabled"), F.max(F.col("p_partkey") % 4).alias("priority"), F.max(F.col("p_partkey") % 5 * 10).alias("weight"))


ABILITIES = """abilities AS (SELECT 'g' || (p_size % 3) AS "group", p_brand AS model, p_partkey % 40 AS channel_id,
  max(p_partkey % 6 <> 0) AS enabled, max(p_partkey % 4) AS priority, max(p_partkey % 5 * 10) AS weight
  FROM part GROUP BY 1, 2, 3)"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint types that a channel type serves, in order of preference, from nations."""
    k = F.col("n_nationkey").cast("bigint")
    listed = F.array(F.when(k % 2 == 0, "chat").otherwise("messages"), F.when(k % 3 == 0, "embeddings"), F.when(k % 4 == 1, "chat"))
    rows = table(spark, sf_dir, "nation").select(k.alias("channel_type"), F.posexplode(listed).alias("position", "endpoint"))
    return rows.where("endpoint is not null")


ENDPOINTS = """endpoints AS (SELECT CAST(n_nationkey AS BIGINT) AS channel_type, 0 AS position, CASE
  WHEN n_nationkey % 2 = 0 THEN 'chat' ELSE 'messages' END AS endpoint FROM nation
  UNION ALL SELECT n_nationkey, 1, 'embeddings' FROM nation WHERE n_nationkey % 3 = 0 UNION ALL
  SELECT n_nationkey, 2, 'chat' FROM nation WHERE n_nationkey % 4 = 1)"""
MODEL_ENDPOINTS = """first_endpoints AS (SELECT a.model, e.endpoint, min((channel_id, position)) AS place
  FROM (SELECT DISTINCT model, channel_id FROM abilities WHERE enabled) a
  JOIN channels c ON c.id = a.channel_id JOIN endpoints e ON e.channel_type = c.type
  GROUP BY 1, 2), model_endpoints AS (SELECT model, list(endpoint ORDER BY place, endpoint) AS endpoints
  FROM first_endpoints GROUP BY 1)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("id"), F.col("c_name").alias("username"), F.lower(F.substring("c_mktsegment", 1, 4)).alias("group"))


USERS = "users AS (SELECT c_custkey - 1 AS id, c_name AS username, lower(substring(c_mktsegment, 1, 4)) AS \"group\" FROM customer)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens from customers: every ninth was deleted."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 9 != 0).select((k - 1).alias("id"), text("tok-", k).alias("name"), (k - 1).alias("user_id"))


TOKENS = """tokens AS (SELECT c_custkey - 1 AS id, 'tok-' || c_custkey AS name, c_custkey - 1 AS user_id
  FROM customer WHERE c_custkey % 9 <> 0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance samples from events."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(i % 50 == 0, "").otherwise(text("model-", i % 23)).alias("model"), F.when(F.col("user_id") % 3 == 0, "").otherwise(text("g", F.col("user_id") % 3)).alias("group"), unix("ts").alias("ts"),
        (i % 5000 - 20).alias("latency_ms"), (i % 900 - 5).alias("ttft_ms"), (i % 2 == 0).alias("has_ttft"), (F.col("event_type") != "error").alias("success"),
        (i % 251).alias("output_tokens"), (i % 3000).alias("generation_ms"),
    )


SAMPLES = """samples AS (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE 'model-' || (event_id % 23) END AS model,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE 'g' || (user_id % 3) END AS "group", CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  event_id % 5000 - 20 AS latency_ms, event_id % 900 - 5 AS ttft_ms, event_id % 2 = 0 AS has_ttft,
  event_type <> 'error' AS success,
  event_id % 251 AS output_tokens, event_id % 3000 AS generation_ms FROM events)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asynchronous tasks from orders."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), text("task-", k).alias("task_id"), F.lower(F.substring("o_orderpriority", 3, 4)).alias("platform"), F.col("o_custkey").alias("user_id"), (k % 20).alias("channel_id"), (k % 90).alias("token_id"),
        F.when(k % 2 == 0, "generate").otherwise("extend").alias("action"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "P", "FAILURE").otherwise("IN_PROGRESS").alias("status"),
        F.when(F.col("o_orderstatus") == "O", "50%").otherwise("100%").alias("progress"), F.floor("o_totalprice").cast("bigint").alias("quota"), unix("o_orderdate").alias("submit_time"),
        (unix("o_orderdate") + k % 30).alias("start_time"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(unix("o_orderdate") + k % 5000).alias("finish_time"),
        (k % 4000).alias("total_tokens"), F.when(k % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.floor(F.col("o_totalprice") * (k % 5) / 3).cast("bigint")).alias("actual_quota"), text("model-", k % 23).alias("model_name"),
    )


TASKS = """tasks AS (SELECT o_orderkey AS id, 'task-' || o_orderkey AS task_id, lower(substring(o_orderpriority, 3,
  4)) AS platform, o_custkey AS user_id, o_orderkey % 20 AS channel_id, o_orderkey % 90 AS token_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'generate' ELSE 'extend' END AS action, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS'
  WHEN 'P' THEN 'FAILURE' ELSE 'IN_PROGRESS' END AS status,
  CASE o_orderstatus WHEN 'O' THEN '50%' ELSE '100%' END AS progress, CAST(floor(o_totalprice) AS BIGINT) AS quota,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS submit_time,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 30 AS start_time, CASE o_orderstatus WHEN 'O' THEN 0
  ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) + o_orderkey % 5000 END AS finish_time,
  o_orderkey % 4000 AS total_tokens, CASE WHEN o_orderkey % 11 = 0 THEN -1
  ELSE CAST(floor(o_totalprice * (o_orderkey % 5) / 3) AS BIGINT) END AS actual_quota,
  'model-' || (o_orderkey % 23) AS model_name FROM orders)"""


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit logs from events."""
    i, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        i.alias("event_id"), u.alias("user_id"), F.when(u % 7 == 0, "root").when(u % 7 == 1, "admin").otherwise("common").alias("actor_role"), unix("ts").alias("created_at"),
        F.when(i % 3 == 0, "access_token").otherwise("login").alias("category"), F.col("event_type").alias("action"), text("ref-", u % 5).alias("token_ref"),
        text("10.1.", u % 9, ".", i % 200).alias("ip"), (F.col("event_type") != "error").alias("success"), F.col("props").alias("other"),
    )


AUDITS = """audits AS (SELECT event_id, user_id, CASE user_id % 7 WHEN 0 THEN 'root' WHEN 1 THEN 'admin'
  ELSE 'common' END AS actor_role, CAST(floor(epoch(ts)) AS BIGINT) AS created_at,
  CASE WHEN event_id % 3 = 0 THEN 'access_token' ELSE 'login' END AS category, event_type AS action,
  'ref-' || (user_id % 5) AS token_ref,
  '10.1.' || (user_id % 9) || '.' || (event_id % 200) AS ip, event_type <> 'error' AS success, props AS other
  FROM events)"""


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions from orders: five plans by priority."""
    k, start = F.col("o_orderkey"), unix("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("user_id"), (F.substring("o_orderpriority", 1, 1).cast("int")).alias("plan_id"), start.alias("start_time"), (start + (k % 200 + 1) * 86400).alias("end_time"),
        F.when(k % 5 == 0, "cancelled").otherwise("active").alias("status"), F.floor("o_totalprice").cast("bigint").alias("amount_used"), F.when(k % 3 == 0, "daily").when(k % 3 == 1, "weekly").otherwise("monthly").alias("reset_period"),
        (start + 86400).alias("next_reset_time"), start.alias("last_reset_time"), (k % 2 == 0).alias("allow_overflow"), F.when(k % 4 == 0, "").otherwise(text("up-", k % 4)).alias("upgrade_group"), F.when(k % 6 == 0, text("down-", k % 5)).otherwise("").alias("downgrade_group"), text("prev-", k % 3).alias("prev_group"),
    )


SUBSCRIPTIONS = """subscriptions AS (SELECT o_orderkey AS id, o_custkey AS user_id, CAST(substring(o_orderpriority,
  1, 1) AS INTEGER) AS plan_id, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS start_time,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) + (o_orderkey % 200 + 1) * 86400 AS end_time, CASE
  WHEN o_orderkey % 5 = 0 THEN 'cancelled' ELSE 'active' END AS status,
  CAST(floor(o_totalprice) AS BIGINT) AS amount_used,
  CASE o_orderkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly'
  ELSE 'monthly' END AS reset_period, CAST(floor(epoch(o_orderdate)) AS BIGINT) + 86400 AS next_reset_time,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS last_reset_time,
  o_orderkey % 2 = 0 AS allow_overflow, CASE WHEN o_orderkey % 4 = 0 THEN ''
  ELSE 'up-' || (o_orderkey % 4) END AS upgrade_group, CASE WHEN o_orderkey % 6 = 0 THEN 'down-' || (o_orderkey % 5)
  ELSE '' END AS downgrade_group, 'prev-' || (o_orderkey % 3) AS prev_group FROM orders)"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price records of upstreams from parts: brand as model, size class as upstream."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model"), text("up-", F.col("p_size") % 4).alias("upstream")).agg(
        F.min(F.when(k % 9 == 0, F.lit(None)).otherwise(k % 5 + F.lit(0.5))).alias("model_ratio"), F.min((k % 3 + 1).cast("double")).alias("completion_ratio"), F.min(F.when(k % 2 == 0, F.lit(0.25))).alias("cache_ratio"), F.max(F.when(k % 40 == 0, F.lit(0.02))).alias("model_price"))


PRICES = """prices AS (SELECT p_brand AS model, 'up-' || (p_size % 4) AS upstream, min(CASE
  WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 5 + CAST(0.5 AS DOUBLE) END) AS model_ratio,
  min(CAST(p_partkey % 3 + 1 AS DOUBLE)) AS completion_ratio, min(CASE
  WHEN p_partkey % 2 = 0 THEN CAST(0.25 AS DOUBLE) END) AS cache_ratio, max(CASE
  WHEN p_partkey % 40 = 0 THEN CAST(0.02 AS DOUBLE) END) AS model_price
  FROM part GROUP BY 1, 2)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
