"""Queries of leaderboards, histories and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scalars import period_window
from meterlake.operators import rankings as R
from meterlake.operators import usage as U
from meterlake.plans import NOW, START, query
from meterlake.plans.usage import CUBE, WITH, cube
from meterlake.sources import samples as S

WEEK = period_window("week", NOW)
TOTALS = f"""totals AS (SELECT model_name, CAST(COALESCE(sum(token_used) FILTER (created_at BETWEEN {WEEK[0]}
  AND {WEEK[1]}), 0) AS BIGINT) AS tokens,
  CAST(COALESCE(sum(token_used) FILTER (created_at BETWEEN {WEEK[2]} AND {WEEK[3]}), 0) AS BIGINT) AS previous
  FROM cube WHERE model_name <> '' GROUP BY 1)"""
GROWTH = """CASE WHEN previous > 0 THEN round(CAST(tokens - previous AS DOUBLE) / previous * 100 * 10000) / 10000
  WHEN tokens > 0 THEN 100.0 ELSE 0.0 END"""
RANKED = f"""ranked AS (SELECT model_name, tokens, previous, CASE
  WHEN previous > 0 THEN previous_rank END AS previous_rank, row_number() OVER (ORDER BY tokens DESC,
  model_name) AS rank,
  round(CAST(tokens AS DOUBLE) / sum(tokens) OVER () * 10000) / 10000 AS share, {GROWTH} AS growth
  FROM (SELECT *, row_number() OVER (ORDER BY previous DESC, model_name) AS previous_rank FROM totals
  WHERE tokens > 0 OR previous > 0) WHERE tokens > 0)"""
VENDOR = """v AS (SELECT 'model-' || (s_suppkey % 20) AS model_name, min_by(s_name, s_suppkey) AS vendor
  FROM supplier WHERE s_suppkey % 20 < 18 AND s_suppkey <= 60 GROUP BY 1)"""
WEEKLY = S.with_(S.LOGS, CUBE, TOTALS)


def totals(spark, sf_dir):
    return R.period_totals(cube(spark, sf_dir), *WEEK[:4])


def vendors(spark, sf_dir):
    """(meta, vendors): the models that suppliers own; the least key counts."""
    s = S.table(spark, sf_dir, "supplier")
    of = s.where("s_suppkey % 20 < 18").groupBy(
        S.text("model-", F.col("s_suppkey") % 20).alias("model_name")
    ).agg(F.min("s_suppkey").alias("vendor_id"))
    return of.withColumn("owner", F.lit("")), s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query(WEEKLY + f", {RANKED} SELECT * FROM ranked WHERE rank <= 20")
def w2_model_leaderboard(spark, sf_dir):
    return R.model_leaderboard(totals(spark, sf_dir))


@query(WEEKLY + f""", {VENDOR}, w AS (SELECT COALESCE(vendor, 'Unknown') AS vendor, t.* FROM totals t LEFT
  JOIN v USING (model_name) WHERE tokens > 0 OR previous > 0),
  g AS (SELECT vendor, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(previous) AS BIGINT) AS previous,
  count(*) FILTER (tokens > 0) AS models_count, first(model_name ORDER BY tokens DESC, model_name) AS top_model FROM w
  GROUP BY 1 HAVING sum(tokens) > 0)
  SELECT *, row_number() OVER (ORDER BY tokens DESC, vendor) AS rank,
  round(CAST(tokens AS DOUBLE) / sum(tokens) OVER () * 10000) / 10000 AS share, {GROWTH} AS growth FROM g""")
def w3_w7_vendor_leaderboard(spark, sf_dir):
    return R.vendor_leaderboard(R.with_vendor(totals(spark, sf_dir), *vendors(spark, sf_dir)))


@query(WEEKLY + f""", {RANKED}, d AS (SELECT *, previous_rank - rank AS delta, CASE
  WHEN previous_rank > rank THEN 'up' ELSE 'down' END AS direction FROM ranked WHERE previous_rank <> rank)
  SELECT direction, place, model_name, rank, previous_rank, delta, growth
  FROM (SELECT *, row_number() OVER (PARTITION BY direction
  ORDER BY abs(delta) DESC, abs(growth) DESC, model_name) AS place FROM d) WHERE place <= 6""")
def w4_movers(spark, sf_dir):
    return R.movers(R.ranked_models(totals(spark, sf_dir)))


BUCKETS = f"""b AS (SELECT model_name, created_at // 86400 * 86400 AS bucket,
  CAST(sum(token_used) AS BIGINT) AS tokens FROM cube WHERE created_at BETWEEN {START} AND {NOW} GROUP BY 1, 2
  HAVING sum(token_used) > 0)"""


def folded(name, value, rows, by, limit, other):
    return f"""top AS (SELECT {name} AS kept FROM {rows} GROUP BY 1 ORDER BY sum({value}) DESC, 1 LIMIT {limit}),
  folded AS (SELECT {''.join(x + ', ' for x in by)} COALESCE(kept, '{other}') AS {name},
  CAST(sum({value}) AS BIGINT) AS {value} FROM {rows} LEFT JOIN top ON {name} = kept GROUP BY ALL
  HAVING sum({value}) > 0)"""


@query(WITH + f", {BUCKETS}, {folded('model_name', 'tokens', 'b', ['bucket'], 10, 'Others')} SELECT * FROM folded")
def w5_model_history(spark, sf_dir):
    return R.model_history(U.model_buckets(cube(spark, sf_dir), START, NOW, 86400))


@query(WITH + f""", {BUCKETS}, {VENDOR}, bv AS (SELECT bucket, COALESCE(vendor, 'Unknown') AS vendor, tokens FROM b
  LEFT JOIN v USING (model_name)), {folded('vendor', 'tokens', 'bv', ['bucket'], 5, 'Others')}
  SELECT *, round(CAST(tokens AS DOUBLE) / sum(tokens) OVER (PARTITION BY bucket) * 10000) / 10000 AS share
  FROM folded""")
def w6_vendor_history(spark, sf_dir):
    buckets = U.model_buckets(cube(spark, sf_dir), START, NOW, 86400)
    return R.vendor_history(R.with_vendor(buckets, *vendors(spark, sf_dir)))


@query(WITH + """SELECT created_at, count(*) AS cells, strftime(make_timestamp(created_at * 1000000),
  '%m-%d %H:00') AS hour_key, strftime(make_timestamp(created_at * 1000000), '%m-%d') AS day_key,
  strftime(make_timestamp(created_at * 1000000), '%m-%d') || ' - ' || strftime(make_timestamp((created_at + 518400) *
  1000000), '%m-%d') AS week_key FROM cube GROUP BY 1""")
def w8_chart_keys(spark, sf_dir):
    return cube(spark, sf_dir).groupBy("created_at").agg(F.count("*").alias("cells")).select(
        "created_at", "cells", *(R.chart_key("created_at", g).alias(f"{g}_key") for g in ("hour", "day", "week"))
    )


GRID = "SELECT bucket, model_name, CAST(COALESCE(sum(\"count\"), 0) AS BIGINT) AS \"count\", CAST(COALESCE(sum(quota), 0) AS BIGINT) AS quota FROM axis CROSS JOIN (SELECT DISTINCT model_name FROM r) LEFT JOIN r USING (bucket, model_name) GROUP BY ALL"


@query(
    WITH + f", r AS (SELECT created_at // 86400 * 86400 AS bucket, model_name, \"count\", quota FROM cube), axis AS (SELECT DISTINCT bucket FROM r) {GRID}"
)
def w9_dense_grid(spark, sf_dir):
    rows = cube(spark, sf_dir).select(U.bucket(86400).alias("bucket"), "model_name", "count", "quota")
    return R.dense_grid(rows, "bucket", "model_name", ["count", "quota"], 86400)


@query(
    WITH + f", r AS (SELECT created_at // 86400 * 86400 AS bucket, model_name, \"count\", quota FROM cube WHERE created_at >= {NOW - 4 * 86400}), axis AS (SELECT (SELECT max(bucket) FROM r) - k * 86400 AS bucket FROM range(7) t(k)) {GRID}"
)
def w9_short_axis(spark, sf_dir):
    rows = cube(spark, sf_dir).where(F.col("created_at") >= NOW - 4 * 86400).select(
        U.bucket(86400).alias("bucket"), "model_name", "count", "quota"
    )
    return R.dense_grid(rows, "bucket", "model_name", ["count", "quota"], 86400)


@query(WITH + f""", r AS (SELECT created_at // 86400 * 86400 AS bucket, model_name, quota
  FROM cube), {folded('model_name', 'quota', 'r', ['bucket'], 15, 'Other')}
  SELECT *, round(CAST(quota AS DOUBLE) / 500000 * 10000) / 10000 AS usd FROM folded""")
def w10_area_series(spark, sf_dir):
    return R.area_series(cube(spark, sf_dir), 86400)


@query(
    WITH + f", r AS (SELECT created_at // 86400 * 86400 AS bucket, model_name, \"count\" FROM cube), {folded('model_name', chr(34) + 'count' + chr(34), 'r', ['bucket'], 20, 'Other')} SELECT * FROM folded"
)
def w10_count_series(spark, sf_dir):
    return R.count_series(cube(spark, sf_dir), 86400)


@query(
    WITH + f", {folded('model_name', chr(34) + 'count' + chr(34), 'cube', [], 20, 'Other')} SELECT *, round(CAST(\"count\" AS DOUBLE) / sum(\"count\") OVER () * 10000) / 10000 AS share FROM folded"
)
def w10_count_shares(spark, sf_dir):
    return R.count_shares(cube(spark, sf_dir))


@query(WITH + """, top AS (SELECT username FROM cube GROUP BY 1 ORDER BY sum(quota) DESC, 1
  LIMIT 10), r AS (SELECT created_at // 86400 * 86400 AS bucket, username, quota FROM cube
  JOIN top USING (username)), axis AS (SELECT DISTINCT bucket FROM r)
  SELECT bucket, username, CAST(COALESCE(sum(quota), 0) AS BIGINT) AS quota FROM axis CROSS JOIN top LEFT
  JOIN r USING (bucket, username) GROUP BY ALL""")
def w11_user_trend(spark, sf_dir):
    return R.user_trend(cube(spark, sf_dir), 86400)
