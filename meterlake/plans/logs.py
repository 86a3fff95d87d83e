"""Queries of filters, joins and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions import scalars as X
from meterlake.operators import logs as L
from meterlake.plans import NOW, START, query
from meterlake.plans.usage import WITH, cube
from meterlake.sources import samples as S
from meterlake.sources.logs import with_request_id

LOG = S.with_(S.LOGS)
BRIEF = "id, user_id, created_at, type, model_name, quota"


@query(
    LOG + f"SELECT {BRIEF} FROM logs WHERE type = 2 AND created_at BETWEEN {START + 86400} AND {NOW} AND model_name LIKE 'model-1%' AND \"group\" = 'vip' AND channel_id = 3"
)
def f1_filter_logs(spark, sf_dir):
    return L.filter_logs(
        S.logs(spark, sf_dir), type=2, start=START + 86400, end=NOW, model="model-1%", group="vip", channel=3
    ).select(*BRIEF.split(", "))


@query(LOG + f"SELECT {BRIEF} FROM logs WHERE username LIKE '%er-1!_' ESCAPE '!' OR username LIKE '%r-14%' ESCAPE '!'")
def f2_text_filter(spark, sf_dir):
    return S.logs(spark, sf_dir).where(
        X.text_match("username", "%er-1_") | X.text_match("username", "%r-14%")
    ).select(*BRIEF.split(", "))


@query(LOG + "SELECT id, other FROM logs")
def f5_project_other(spark, sf_dir):
    """Nothing in the sample's ``other`` is private, so every row must come back byte for byte."""
    return S.logs(spark, sf_dir).select("id", L.project_other("user").alias("other"))


@query(LOG + f"""SELECT display_id, id, '' AS channel_name, other
  FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS display_id FROM logs WHERE user_id = 5)
  WHERE display_id <= 20""")
def f6_user_view(spark, sf_dir):
    return L.user_view(
        S.logs(spark, sf_dir).where("user_id = 5"), 20
    ).select("display_id", "id", "channel_name", "other")


@query(LOG + """SELECT user_id, count(*) FILTER (other LIKE '%"quota_saturation":%') AS saturated,
  count(*) FILTER (other LIKE '%"k":%') AS keyed FROM logs GROUP BY 1""")
def f7_saturation(spark, sf_dir):
    return S.logs(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(L.saturated()).alias("saturated"), F.count_if(F.col("other").contains('"k":')).alias("keyed")
    )


@query(S.with_(S.CHANNELS) + "SELECT id, groups FROM channels WHERE list_contains(string_split(groups, ','), 'vip-1')")
def f8_csv_member(spark, sf_dir):
    return S.channels(spark, sf_dir).where(X.csv_has("groups", "vip-1")).select("id", "groups")


@query("""SELECT p_partkey, 90 + p_partkey % 520 AS code, ((90 + p_partkey % 520) BETWEEN 100 AND 599)
  AND (90 + p_partkey % 520) NOT IN (504, 524) AND ((90 + p_partkey % 520) BETWEEN 500 AND 530
  OR (90 + p_partkey % 520) IN (401, 429)) AS retriable FROM part""")
def f9_f10_status_codes(spark, sf_dir):
    code = 90 + F.col("p_partkey") % 520
    return S.table(spark, sf_dir, "part").select(
        "p_partkey", code.alias("code"), X.retriable(code, X.status_ranges("401，429,500-530")).alias("retriable")
    )


@query(f"""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 4 = 3 THEN 3
  ELSE 1 END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE {START} - 500 + o_orderkey % 1000 END AS expired_time
  FROM orders)
  SELECT id, CASE WHEN status = 1 AND expired_time <> 0 AND expired_time < {START} THEN 'expired'
  WHEN status = 1 THEN 'usable' WHEN status = 3 THEN 'used' ELSE 'disabled' END AS state FROM r""")
def f11_redemptions(spark, sf_dir):
    k = F.col("o_orderkey")
    r = S.table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 4 == 0, 2).when(k % 4 == 3, 3).otherwise(1).alias("status"),
        F.when(k % 3 == 0, 0).otherwise(START - 500 + k % 1000).alias("expired_time"),
    )
    return r.select("id", L.redemption_state(START).alias("state"))


@query(S.with_(S.TASKS) + """SELECT id, submit_time FROM tasks WHERE progress <> '100%' AND status NOT IN ('FAILURE',
  'SUCCESS') AND submit_time < 800000000 ORDER BY submit_time, id LIMIT 100""")
def f12_timed_out_tasks(spark, sf_dir):
    return L.timed_out(S.tasks(spark, sf_dir), 800_000_000, 100).select("id", "submit_time")


@query(S.with_(S.TASKS) + """SELECT status, count(*) AS tasks FROM tasks
  WHERE action = 'extend' AND user_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89) AND submit_time >= 700000000 GROUP BY 1""")
def f13_search_tasks(spark, sf_dir):
    return L.search_tasks(
        S.tasks(spark, sf_dir), action="extend", users=[1, 2, 3, 5, 8, 13, 21, 34, 55, 89], start=700_000_000
    ).groupBy("status").agg(F.count("*").alias("tasks"))


def scoped_audits(spark, sf_dir):
    """Audit rows with every scope in ``other`` for most events, and without any for the rest."""
    i, u = F.col("event_id"), F.col("user_id")
    scopes = F.concat(
        F.lit('{"root_info": {"r": 1}, "n": 123456789012345678901, "audit_info": {"u": "x y"}, "admin_info": {"i": '),
        i.cast("string"),
        F.lit("}}"),
    )
    rows = S.audits(spark, sf_dir).withColumn("other", F.when(i % 4 > 0, scopes).otherwise(F.col("other")))
    return rows.withColumns({"username": S.text("user-", u), "request_id": S.text("r", i)})


SCOPED = """scoped AS (SELECT * REPLACE (CASE WHEN event_id % 4 > 0
    THEN
    '{"root_info": {"r": 1}, "n": 123456789012345678901, "audit_info": {"u": "x y"}, "admin_info": {"i": ' || event_id || '}}'
    ELSE other END AS other),
  'user-' || user_id AS username, 'r' || event_id AS request_id FROM audits)"""
ADMIN_SEES = """CASE WHEN event_id % 4 > 0 THEN
  '{"admin_info":{"i":' || event_id || '},"audit_info":{"u":"x y"},"n":123456789012345678901}' ELSE other END"""
USER_SEES = """CASE WHEN event_id % 4 > 0 THEN '{"n":123456789012345678901}' ELSE other END"""


@query(S.with_(S.AUDITS, SCOPED) + f"""SELECT event_id, actor_role, token_ref, {ADMIN_SEES} AS other FROM scoped
  WHERE actor_role IN ('common', 'admin') AND category = 'login' AND token_ref <> 'ref-2'
  AND created_at BETWEEN {START} AND {NOW} AND success""")
def f14_search_audits(spark, sf_dir):
    found = L.search_audits(
        scoped_audits(spark, sf_dir), "admin", category="login", not_token="ref-2", start=START, end=NOW, success=True
    )
    return found.select("event_id", "actor_role", "token_ref", "other")


@query(S.with_(S.AUDITS, SCOPED) + """SELECT event_id, other FROM scoped WHERE username = 'user-7'
  AND token_ref = 'ref-2' UNION ALL SELECT event_id, other FROM scoped WHERE request_id = 'r77'""")
def f14_root_view(spark, sf_dir):
    rows = scoped_audits(spark, sf_dir)
    found = L.search_audits(rows, "root", username="user-7", token="ref-2").unionByName(
        L.search_audits(rows, "root", request_id="r77")
    )
    return found.select("event_id", "other")


@query(S.with_(S.AUDITS, SCOPED) + f"""SELECT event_id, created_at, {USER_SEES} AS other, (SELECT count(*) FROM scoped
  WHERE user_id = 8) AS total
  FROM scoped WHERE user_id = 8 ORDER BY created_at DESC, event_id DESC LIMIT 20 OFFSET 5""")
def f14_own_view(spark, sf_dir):
    found = L.search_audits(scoped_audits(spark, sf_dir), "root", self_view=True, user_id=8)
    return L.page_with_total(
        found, [F.desc("created_at"), F.desc("event_id")], 20, 5
    ).select("event_id", "created_at", "other", "total")


def described_models(spark, sf_dir):
    k = F.col("p_partkey")
    return S.table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("model_name"), F.col("p_type").alias("description"), F.col("p_brand").alias("tags"), (k % 20 + 1).alias("vendor_id"),
        F.when(k % 5 == 0, 2).otherwise(1).alias("status"), (k % 3).cast("int").alias("sync_official"),
    )


@query("""SELECT p_partkey AS id, p_name AS model_name FROM part JOIN supplier ON p_partkey % 20 + 1 = s_suppkey
  WHERE (p_name LIKE '%1%' OR p_type LIKE '%1%' OR p_brand LIKE '%1%') AND contains(s_name, '#000000001')""")
def f15_search_models(spark, sf_dir):
    v = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return L.search_models(
        described_models(spark, sf_dir), v, keyword="1", vendor="#000000001"
    ).select("id", "model_name")


@query("""WITH f AS (SELECT p_partkey AS id, p_name AS model_name FROM part
  WHERE (p_name LIKE '%2%' OR p_type LIKE '%2%' OR p_brand LIKE '%2%') AND p_partkey % 20 + 1 = 3
  AND p_partkey % 5 <> 0 AND p_partkey % 3 = 1)
  SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY id DESC LIMIT 10 OFFSET 2""")
def f15_models_page(spark, sf_dir):
    v = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    found = L.search_models(described_models(spark, sf_dir), v, keyword="2", vendor="3", status=1, sync_official=1)
    return L.page_with_total(found.select("id", "model_name"), [F.desc("id")], 10, 2)


@query(LOG + f"SELECT created_at >= {NOW - 10 * 86400} AS kept, count(*) AS rows FROM logs GROUP BY 1")
def f16_retention(spark, sf_dir):
    rows, cutoff = S.logs(spark, sf_dir), NOW - 10 * 86400
    both = L.retained(rows, cutoff).select(F.lit(True).alias("kept")).unionAll(
        L.expired(rows, cutoff).select(F.lit(False))
    )
    return both.groupBy("kept").agg(F.count("*").alias("rows"))


@query(LOG + f"""SELECT id, type FROM logs WHERE created_at < {NOW - 5 * 86400} AND id NOT IN (SELECT max(id)
  FROM logs GROUP BY type) AND id < (SELECT max(id) FROM logs)""")
def f17_prunable(spark, sf_dir):
    return L.prunable(S.logs(spark, sf_dir), NOW - 5 * 86400).select("id", "type")


@query(S.with_(S.LOGS, S.CHANNELS) + """SELECT logs.id, channel_id, COALESCE(name, '') AS channel_name FROM logs LEFT
  JOIN channels ON channel_id = channels.id""")
def j1_channel_names(spark, sf_dir):
    return L.with_channel_name(
        S.logs(spark, sf_dir), S.channels(spark, sf_dir)
    ).select("id", "channel_id", "channel_name")


@query(WITH + f""", {S.TOKENS} SELECT token_id, COALESCE(name, '') AS token_name, CAST(sum(quota) AS BIGINT) AS quota
  FROM cube LEFT JOIN tokens ON token_id = id GROUP BY 1, 2""")
def j2_token_names(spark, sf_dir):
    flow = cube(spark, sf_dir).groupBy("token_id").agg(F.sum("quota").alias("quota"))
    return L.with_token_name(flow, S.tokens(spark, sf_dir)).select("token_id", "token_name", "quota")


@query(WITH + f""", {S.CHANNELS} SELECT channel_id, COALESCE(NULLIF(name, ''), CASE
  WHEN channel_id > 0 THEN 'channel-' || channel_id ELSE '' END) AS channel_name, CAST(sum(quota) AS BIGINT) AS quota
  FROM cube LEFT JOIN channels ON channel_id = id GROUP BY 1, 2""")
def j3_channel_labels(spark, sf_dir):
    flow = cube(spark, sf_dir).groupBy("channel_id").agg(F.sum("quota").alias("quota"))
    return L.with_channel_label(flow, S.channels(spark, sf_dir)).select("channel_id", "channel_name", "quota")


@query(S.with_(S.LOGS, S.TOKENS, S.USERS) + """SELECT logs.id, token_id, name AS token_name,
  tokens.user_id AS owner_id, users.username AS owner_name FROM logs LEFT JOIN tokens ON token_id = tokens.id LEFT
  JOIN users ON tokens.user_id = users.id WHERE type = 5""")
def j4_owners(spark, sf_dir):
    findings = S.logs(spark, sf_dir).where("type = 5").select("id", "token_id")
    return L.with_owner(
        findings, S.tokens(spark, sf_dir), S.users(spark, sf_dir)
    ).select("id", "token_id", "token_name", "owner_id", "owner_name")


@query(LOG + f"""SELECT display_id, id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC,
  id DESC) AS display_id FROM logs) WHERE display_id BETWEEN 41 AND 60""")
def s12_page(spark, sf_dir):
    return L.page(S.logs(spark, sf_dir), 20, 40).select("display_id", "id", "created_at")


@query(LOG + """SELECT display_id, id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC,
  id DESC) AS display_id, count(*) OVER () AS n FROM logs) WHERE display_id > n * 4 // 5 AND display_id <= n * 4 // 5 + 50""")
def s12_deep_page(spark, sf_dir):
    """A page that begins after four fifths of all logs, found by ranges of 100 rows."""
    logs = S.logs(spark, sf_dir)
    return L.deep_page(logs, logs.count() * 4 // 5, 50, 256, 100).select("display_id", "id", "created_at")


@query(LOG + f"""SELECT id, created_at FROM logs WHERE created_at < {NOW - 86400} OR (created_at = {NOW - 86400}
  AND id < 500) ORDER BY created_at DESC, id DESC LIMIT 25""")
def s12_page_after(spark, sf_dir):
    return L.page_after(S.logs(spark, sf_dir), NOW - 86400, 500, 25).select("id", "created_at")


@query(LOG + "SELECT LEAST(count(*), 10000) AS total FROM logs WHERE type = 2")
def s12_capped_count(spark, sf_dir):
    return L.capped_count(S.logs(spark, sf_dir).where("type = 2"))


@query(LOG + """SELECT token_id, id FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY id DESC) AS n
  FROM logs) WHERE n <= 5""")
def w13_recent(spark, sf_dir):
    return L.recent(S.logs(spark, sf_dir), 5).select("token_id", "id")


@query(LOG + """SELECT yyyymm, count(*) AS rows, count(DISTINCT request_id) AS ids, min(length(request_id)) AS short,
  max(length(request_id)) AS long FROM (SELECT strftime(to_timestamp(created_at) AT TIME ZONE 'UTC',
  '%Y%m') AS yyyymm, CASE WHEN id % 2 = 0 THEN lpad(CAST(id AS VARCHAR), 64, '0') ELSE 'r-' || id END AS request_id
  FROM logs) GROUP BY 1""")
def s5_request_ids(spark, sf_dir):
    """Rows without an id get a hash of their contents, 64 characters, one for each different row."""
    rows = S.logs(spark, sf_dir).withColumn(
        "request_id", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("r-"), F.col("id").cast("string")))
    )
    rows = with_request_id(rows)
    month = F.date_format(F.timestamp_seconds("created_at"), "yyyyMM")
    return rows.groupBy(month.alias("yyyymm")).agg(
        F.count("*").alias("rows"),
        F.count_distinct("request_id").alias("ids"),
        F.min(F.length("request_id")).cast("bigint").alias("short"),
        F.max(F.length("request_id")).cast("bigint").alias("long"),
    )
