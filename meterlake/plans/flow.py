"""Queries of the flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import flow as G
from meterlake.operators import logs as L
from meterlake.plans import query
from meterlake.plans.usage import WITH, cube
from meterlake.sources import samples as S

ADMIN = G.stages_of("admin")
SUMS = "CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(requests) AS BIGINT) AS requests"
NODES = """n AS (SELECT CASE WHEN user_id > 0 THEN 'user:' || user_id
  ELSE 'user:' || username END AS u, 'group:' || COALESCE(NULLIF(use_group, ''), 'unknown') AS g,
  'model:' || model_name AS m, CASE WHEN channel_id > 0 THEN 'channel:' || channel_id
  ELSE 'channel:' || COALESCE(NULLIF(name, ''), 'unknown') END AS c,
  username AS u_label, COALESCE(NULLIF(use_group, ''), 'unknown') AS g_label, model_name AS m_label,
  COALESCE(NULLIF(name, ''), CASE WHEN channel_id > 0 THEN 'channel-' || channel_id
  ELSE 'Unknown' END) AS c_label, quota, token_used AS tokens, "count" AS requests FROM cube LEFT
  JOIN channels ON channel_id = id)"""
START = WITH + f", {S.CHANNELS}, {NODES}"


def totals(source, where=""):
    return " UNION ALL ".join(f"""SELECT '{k}' AS kind, {k[0]} AS id, {k[0]}_label AS label, {SUMS}
  FROM {source} {where} GROUP BY ALL""" for k in ADMIN)


def rows(spark, sf_dir):
    named = S.channels(spark, sf_dir).select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return cube(spark, sf_dir).join(named, "channel_id", "left")


def admin_paths(spark, sf_dir):
    return G.paths(rows(spark, sf_dir), ADMIN)


@query(START + f" SELECT u, g, m, c, {SUMS} FROM n GROUP BY 1, 2, 3, 4")
def g1_paths(spark, sf_dir):
    names = [F.col("path")[k]["id"].alias(n) for k, n in enumerate("ugmc")]
    return admin_paths(spark, sf_dir).select(*names, *G.METRICS)


@query(START + f""" SELECT {SUMS} FROM n WHERE g IN ('group:vip', 'group:unknown') AND m IN ('model:model-1',
  'model:model-2')""")
def g2_g7_filtered_summary(spark, sf_dir):
    chosen = {"group": ["group:vip", "group:unknown"], "model": ["model:model-1", "model:model-2"], "user": []}
    return G.summary(G.filtered(admin_paths(spark, sf_dir), chosen))


@query(START + f""" SELECT kind, id, CASE WHEN kind = 'model' THEN label
  ELSE '***' END AS label, quota, tokens, requests FROM ({totals('n')})""")
def g4_g5_nodes(spark, sf_dir):
    return G.masked(G.node_totals(admin_paths(spark, sf_dir)))


TOP = f""", t AS ({totals('n')}), top AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY kind
  ORDER BY quota DESC, label, id) AS r FROM t) WHERE r <= 5)"""
FOLD = ", ".join(f"CASE WHEN {x} IN (SELECT id FROM top) THEN {x} ELSE '{k}:__other__' END AS {x}" for x, k in zip("ugmc", ADMIN, strict=True))
LINKS = f"""l AS (SELECT 0 AS stage, u AS source, g AS target, quota, tokens, requests FROM f UNION ALL
  SELECT 1, g, m, quota, tokens, requests FROM f UNION ALL SELECT 2, m, c, quota, tokens, requests FROM f)"""
SHARE = f"""SELECT source, target, {SUMS}, CAST(sum(quota) AS DOUBLE) / (SELECT sum(quota) FROM l
  WHERE stage = 0) AS share FROM l GROUP BY 1, 2"""


@query(START + TOP + f", f AS (SELECT {FOLD}, quota, tokens, requests FROM n), {LINKS} {SHARE}")
def g3_g4_folded_links(spark, sf_dir):
    return G.links(G.limited(admin_paths(spark, sf_dir), "quota", 5))


@query(START + TOP + f""", f AS (SELECT * FROM n WHERE u IN (SELECT id FROM top) AND g IN (SELECT id
  FROM top) AND m IN (SELECT id FROM top) AND c IN (SELECT id FROM top)), {LINKS} {SHARE}""")
def g3_hidden_links(spark, sf_dir):
    return G.links(G.limited(admin_paths(spark, sf_dir), "quota", 5, hide=True))


@query(START + " " + " UNION ALL ".join(f"""SELECT '{k}' AS kind, {k[0]} AS id, {k[0]}_label AS label, {SUMS} FROM n
  WHERE {w} GROUP BY ALL""" for k, w in zip(ADMIN, ["g = 'group:vip' AND m = 'model:model-3'", "m = 'model:model-3'", "g = 'group:vip'", "g = 'group:vip' AND m = 'model:model-3'"], strict=True)))
def g6_option_totals(spark, sf_dir):
    return G.option_totals(rows(spark, sf_dir), ADMIN, {"group": ["group:vip"], "model": ["model:model-3"]})


@query(START + f" SELECT g, m, {SUMS} FROM n WHERE u = 'user:4' GROUP BY 1, 2")
def g1_visible_stages(spark, sf_dir):
    mine = L.with_token_name(rows(spark, sf_dir).where("user_id = 4"), S.tokens(spark, sf_dir))
    p = G.paths(mine, G.stages_of("user", ["group", "model"]))
    return p.select(F.col("path")[0]["id"].alias("g"), F.col("path")[1]["id"].alias("m"), *G.METRICS)
