"""Queries of model catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.operators import models as C, usage as U
from meterlake.plans import query
from meterlake.sources import samples as S

A = S.with_(S.ABILITIES, S.CHANNELS)


def rules(spark, sf_dir):
    """Name rules from parts: brands cut to prefixes, suffixes and infixes."""
    k = F.col("p_partkey")
    pattern = F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, F.substring("p_brand", 1, 7)).when(
        k % 4 == 3, F.expr("substring(p_brand, 7, 1)")
    ).otherwise(F.lit("#1"))
    return S.table(spark, sf_dir, "part").select(
        k.alias("id"),
        (k % 4).cast("int").alias("name_rule"),
        pattern.alias("pattern"),
        F.when(k % 5 == 0, 2).otherwise(1).alias("status"),
    )


RULES = """rules AS (SELECT p_partkey AS id, CAST(p_partkey % 4 AS INTEGER) AS name_rule, CASE p_partkey % 4
  WHEN 0 THEN p_brand WHEN 1 THEN substring(p_brand, 1, 7) WHEN 3 THEN substring(p_brand, 7, 1)
  ELSE '#1' END AS pattern,
  CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS status FROM part)"""
MATCH = "CASE name_rule WHEN 0 THEN model = pattern WHEN 1 THEN starts_with(model, pattern) WHEN 3 THEN ends_with(model, pattern) ELSE contains(model, pattern) END"
RESOLVED = f"""hits AS (SELECT model, r.*, row_number() OVER (PARTITION BY model ORDER BY CASE name_rule WHEN 0 THEN 0
  WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END, id) AS n FROM (SELECT DISTINCT model FROM abilities)
  JOIN rules r ON {MATCH}), resolved AS (SELECT * FROM hits WHERE n = 1)"""


@query(
    A + "SELECT \"group\", model, channel_id, type AS channel_type FROM abilities LEFT JOIN channels ON channel_id = id WHERE enabled"
)
def j5_enabled_abilities(spark, sf_dir):
    return C.enabled_abilities(
        S.abilities(spark, sf_dir), S.channels(spark, sf_dir)
    ).select("group", "model", "channel_id", "channel_type")


@query(A + """SELECT DISTINCT model, channel_id, name, type FROM abilities JOIN channels ON channel_id = id
  WHERE enabled AND status = 1""")
def j6_connections(spark, sf_dir):
    return C.connections(
        S.abilities(spark, sf_dir), S.channels(spark, sf_dir)
    ).select("model", "channel_id", "name", "type")


@query(A + """SELECT DISTINCT model FROM abilities WHERE enabled AND model NOT IN (SELECT p_brand FROM part
  WHERE substring(p_brand, 7, 1) <> '3')""")
def j7_missing_models(spark, sf_dir):
    meta = S.table(spark, sf_dir, "part").where(
        "substring(p_brand, 7, 1) != '3'"
    ).select(F.col("p_brand").alias("model"))
    return C.missing_models(S.abilities(spark, sf_dir), meta)


@query(
    A + ", r AS (SELECT model, channel_id, type, row_number() OVER (PARTITION BY model ORDER BY COALESCE(a.priority, 0) DESC, a.weight DESC, channel_id) AS n FROM abilities a JOIN channels c ON channel_id = id WHERE enabled AND status = 1 AND \"group\" IN ('g0', 'g2')) SELECT model, channel_id, type FROM r WHERE n = 1"
)
def j8_preferred_owner(spark, sf_dir):
    return C.preferred_owner(S.abilities(spark, sf_dir), S.channels(spark, sf_dir), ["g0", "g2"])


@query(S.with_(S.ABILITIES, RULES, RESOLVED) + "SELECT model, id AS rule_id, name_rule, pattern, status FROM resolved")
def j9_metadata(spark, sf_dir):
    return C.resolve_metadata(S.abilities(spark, sf_dir), rules(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT lower(substring(s_name, length(s_name), 1)) AS pattern, 'v' || substring(s_name,
  length(s_name), 1) AS vendor FROM supplier UNION SELECT DISTINCT '#' || substring(s_name, length(s_name), 1),
  'w' || substring(s_name, length(s_name), 1) FROM supplier),
  h AS (SELECT model, vendor, row_number() OVER (PARTITION BY model ORDER BY length(pattern) DESC, pattern) AS n
  FROM (SELECT DISTINCT p_brand AS model FROM part) JOIN p ON contains(lower(model), pattern)) SELECT model, vendor
  FROM h WHERE n = 1""")
def j10_default_vendor(spark, sf_dir):
    last = F.expr("substring(s_name, length(s_name), 1)")
    s = S.table(spark, sf_dir, "supplier")
    patterns = s.select(
        F.lower(last).alias("pattern"), F.concat(F.lit("v"), last).alias("vendor")
    ).union(s.select(F.concat(F.lit("#"), last), F.concat(F.lit("w"), last))).distinct()
    return C.default_vendor(S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("model")), patterns)


@query(
    S.with_(S.CHANNELS) + ", m AS (SELECT id, unnest(string_split(models, ',')) AS model, groups, status, priority, weight FROM channels), g AS (SELECT id, model, unnest(string_split(groups, ',')) AS \"group\", status, priority, weight FROM m WHERE model <> '') SELECT DISTINCT \"group\", model, id AS channel_id, status = 1 AS enabled, priority, weight FROM g WHERE \"group\" <> ''"
)
def c1_abilities(spark, sf_dir):
    return C.build_abilities(S.channels(spark, sf_dir))


@query(S.with_(S.CHANNELS) + """, x AS (SELECT c.id, list_distinct(list_filter(string_split(c.models, ','),
  lambda y: y <> '')) AS a, list_distinct(list_filter(string_split(d.models, ','), lambda y: y <> '')) AS b
  FROM channels c JOIN channels d ON d.id = c.id + 1)
  SELECT id, list_sort(list_distinct(list_concat(a, b))) AS "union", list_sort(list_filter(a,
  lambda y: NOT list_contains(b, y))) AS difference, list_sort(list_intersect(a, b)) AS intersection FROM x""")
def c2_list_sets(spark, sf_dir):
    c = S.channels(spark, sf_dir)
    pairs = c.select("id", F.col("models").alias("a")).join(
        c.select((F.col("id") - 1).alias("id"), F.col("models").alias("b")), "id"
    )
    found = C.list_sets(pairs, "a", "b")
    return found.select("id", *(F.array_sort(x).alias(x) for x in ("union", "difference", "intersection")))


LISTS = """own AS (SELECT DISTINCT channel_id, model FROM abilities
  WHERE "group" = 'g0'), up AS (SELECT DISTINCT channel_id, model FROM abilities WHERE "group" = 'g1')"""


@query(S.with_(S.ABILITIES, LISTS) + """SELECT channel_id, model, 'add' AS change FROM up
  WHERE (channel_id, model) NOT IN (SELECT channel_id, model
  FROM own) AND NOT (channel_id % 4 = 0 AND model = 'Brand#22') AND NOT (channel_id % 3 = 0 AND model = 'Brand#11')
  AND NOT (channel_id % 5 = 0 AND regexp_matches(model, '#3[1-3]$'))
  UNION ALL SELECT channel_id, model, 'remove' FROM own WHERE (channel_id, model) NOT IN (SELECT channel_id, model
  FROM up) AND NOT (channel_id % 4 = 0 AND model = 'Brand#44')""")
def c3_pending_changes(spark, sf_dir):
    a = S.abilities(spark, sf_dir)
    own, up = (a.where(F.col("group") == g).select("channel_id", "model").distinct() for g in ("g0", "g1"))
    ids = a.select("channel_id").distinct()
    redirects = ids.where("channel_id % 4 = 0").select(
        "channel_id", F.lit("Brand#44").alias("source"), F.lit("Brand#22").alias("target")
    )
    ignored = ids.where("channel_id % 3 = 0").select("channel_id", F.lit("Brand#11").alias("pattern")).unionAll(
        ids.where("channel_id % 5 = 0").select("channel_id", F.lit("regex:#3[1-3]$"))
    )
    return C.pending_changes(own, up, redirects, ignored)


MODED = """moded AS (SELECT model || upstream AS model, CASE
  WHEN length(model) % 2 = 0 AND upstream = 'up-1' THEN 'tiered_expr' END AS mode, CASE WHEN model LIKE '%1' THEN ' '
  ELSE ' p * 2 ' END AS expression, CASE WHEN upstream = 'up-2' THEN -model_ratio
  ELSE model_ratio END AS model_ratio, completion_ratio, cache_ratio, CASE
  WHEN upstream = 'up-3' THEN model_price END AS model_price FROM prices)"""


@query(S.with_(S.PRICES, MODED) + """SELECT model, CASE WHEN t THEN 'tiered_expr' ELSE 'ratio' END AS mode, CASE
  WHEN t THEN trim(expression) END AS expression, CASE WHEN t OR model_price IS NOT NULL THEN NULL
  ELSE mr END AS model_ratio, CASE WHEN t OR model_price IS NOT NULL THEN NULL
  ELSE completion_ratio END AS completion_ratio,
  CASE WHEN t OR model_price IS NOT NULL THEN NULL ELSE cache_ratio END AS cache_ratio, CASE WHEN t THEN NULL
  ELSE model_price END AS model_price FROM (SELECT *, mode IS NOT NULL AS t, CASE
  WHEN model_ratio >= 0 THEN model_ratio END AS mr FROM moded) WHERE CASE WHEN t THEN trim(expression) <> ''
  ELSE model_price IS NOT NULL OR mr IS NOT NULL END""")
def c4_effective_prices(spark, sf_dir):
    p, up = S.prices(spark, sf_dir), F.col("upstream")
    rows = p.select(
        F.concat("model", "upstream").alias("model"),
        F.when((F.length("model") % 2 == 0) & (up == "up-1"), "tiered_expr").alias("mode"),
        F.when(F.col("model").endswith("1"), " ").otherwise(" p * 2 ").alias("expression"),
        F.when(up == "up-2", -F.col("model_ratio")).otherwise(F.col("model_ratio")).alias("model_ratio"),
        "completion_ratio",
        "cache_ratio",
        F.when(up == "up-3", F.col("model_price")).alias("model_price"),
    )
    return C.effective_prices(rows)


@query(S.with_(S.PRICES) + """, r AS (SELECT model, upstream AS provider, model_ratio AS input,
  completion_ratio AS output, cache_ratio AS cache_read, row_number() OVER (PARTITION BY model
  ORDER BY model_ratio, upstream) AS n FROM prices WHERE model_ratio > 0)
  SELECT model, provider, round(input * 0.5 * 1000000) / 1000000 AS model_ratio,
  round(output / input * 1000000) / 1000000 AS completion_ratio,
  round(cache_read / input * 1000000) / 1000000 AS cache_ratio FROM r WHERE n = 1""")
def c5_provider_ratios(spark, sf_dir):
    return C.provider_ratios(
        S.prices(spark, sf_dir).select(
            "model",
            F.col("upstream").alias("provider"),
            F.col("model_ratio").alias("input"),
            F.col("completion_ratio").alias("output"),
            F.col("cache_ratio").alias("cache_read"),
        )
    )


LONG = " UNION ALL ".join(
    f"SELECT model, upstream, '{f}' AS field, {f} AS value FROM prices WHERE {f} IS NOT NULL" for f in C.FIELDS
)


@query(S.with_(S.PRICES) + f""", long AS ({LONG}), l AS (SELECT model, field, value AS current FROM long
  WHERE upstream = 'up-0'), u AS (SELECT * FROM long WHERE upstream <> 'up-0'),
  grid AS (SELECT model, field, upstream FROM (SELECT model, field FROM l UNION SELECT model, field FROM u) CROSS
  JOIN (SELECT DISTINCT upstream FROM prices WHERE upstream <> 'up-0')),
  s AS (SELECT model, field, upstream, current, CASE WHEN value IS NULL AND current IS NULL
  OR abs(value - current) < 1e-9 THEN 'same' WHEN value IS NOT NULL THEN CAST(value AS VARCHAR) END AS value FROM grid
  LEFT JOIN u USING (model, field, upstream) LEFT JOIN l USING (model, field)),
  d AS (SELECT *, bool_or(COALESCE(value <> 'same', false)) OVER (PARTITION BY model, field) AS any_diff
  FROM s), e AS (SELECT *, bool_or(COALESCE(value <> 'same', false)) OVER (PARTITION BY upstream) AS useful FROM d
  WHERE any_diff)
  SELECT model, field, upstream, current, value, NOT COALESCE(model_ratio = 37.5 AND completion_ratio = 1,
  false) AS confident FROM e LEFT JOIN prices USING (model, upstream) WHERE useful""")
def j13_c6_price_differences(spark, sf_dir):
    p = S.prices(spark, sf_dir)
    return C.price_differences(p.where("upstream = 'up-0'"), p.where("upstream != 'up-0'"))


TIERS = "tiers AS (SELECT *, dense_rank() OVER (PARTITION BY \"group\", model ORDER BY COALESCE(priority, 0) DESC) - 1 AS tier FROM abilities WHERE enabled)"


@query(
    S.with_(
        S.ABILITIES, TIERS
    ) + "SELECT \"group\", model, channel_id, tier FROM (SELECT *, max(tier) OVER (PARTITION BY \"group\", model) AS last FROM tiers) WHERE tier = least(2, last)"
)
def c7_route_tiers(spark, sf_dir):
    return C.tier_of_retry(C.route_tiers(S.abilities(spark, sf_dir)), 2).select(
        "group", "model", "channel_id", F.col("tier").cast("bigint").alias("tier")
    )


SHARES = "shares AS (SELECT *, CASE WHEN sum(weight) OVER t > 0 THEN weight / CAST(sum(weight) OVER t AS DOUBLE) ELSE CAST(1 AS DOUBLE) / count(*) OVER t END AS share FROM tiers WINDOW t AS (PARTITION BY \"group\", model, tier))"


@query(
    S.with_(
        S.ABILITIES, TIERS, SHARES
    ) + "SELECT \"group\", model, channel_id, round(share * 1000000) / 1000000 AS share FROM shares"
)
def c8_weight_shares(spark, sf_dir):
    shares = C.weight_shares(C.route_tiers(S.abilities(spark, sf_dir)))
    return shares.select("group", "model", "channel_id", (F.round(F.col("share") * 1e6) / 1e6).alias("share"))


@query(S.with_(S.ABILITIES, TIERS, SHARES) + """, f AS (SELECT *, sum(share) OVER (PARTITION BY "group", model
  ORDER BY channel_id ROWS UNBOUNDED PRECEDING) AS high, lead(channel_id) OVER (PARTITION BY "group", model
  ORDER BY channel_id) IS NULL AS last FROM shares WHERE tier = 0),
  q AS (SELECT o_orderkey AS id, 'g' || (o_orderkey % 3) AS "group",
  'Brand#' || (1 + o_orderkey % 5) || (1 + o_orderkey % 4) AS model,
  CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / 10007 AS draw FROM orders)
  SELECT id, channel_id FROM q JOIN f USING ("group", model) WHERE draw >= high - share AND draw < CASE
  WHEN last THEN 2 ELSE high END""")
def c9_weighted_pick(spark, sf_dir):
    k = F.col("o_orderkey")
    requests = S.table(spark, sf_dir, "orders").select(
        k.alias("id"), S.text("g", k % 3).alias("group"), S.text("Brand#", 1 + k % 5, 1 + k % 4).alias("model")
    )
    shares = C.weight_shares(C.route_tiers(S.abilities(spark, sf_dir))).where("tier = 0")
    return C.weighted_pick(
        requests, shares, (F.col("id") * 7919 % 10007).cast("double") / 10007
    ).select("id", "channel_id")


STATES = """states AS (SELECT model, CASE WHEN status <> 1 THEN 'hidden' WHEN model IN (SELECT model FROM abilities
  WHERE enabled AND channel_id IN (SELECT id FROM channels WHERE status = 1 AND tag = '')) THEN 'visible' ELSE 'unavailable' END AS state FROM (SELECT DISTINCT model
  FROM abilities) LEFT JOIN resolved USING (model))"""


def states(spark, sf_dir):
    a = S.abilities(spark, sf_dir)
    untagged = S.channels(spark, sf_dir).where("tag = ''")
    return C.name_states(a, C.resolve_metadata(a, rules(spark, sf_dir)), C.connections(a, untagged))


@query(S.with_(S.ABILITIES, S.CHANNELS, RULES, RESOLVED, STATES) + "SELECT * FROM states")
def c10_name_states(spark, sf_dir):
    return states(spark, sf_dir)


@query(S.with_(S.ABILITIES, S.CHANNELS, RULES, RESOLVED, STATES) + f""", n AS (SELECT id, status, count(model) AS matched,
  count(*) FILTER (state = 'visible') AS visible, count(*) FILTER (state = 'hidden') AS hidden
  FROM (SELECT id, name_rule, pattern, status FROM rules) r LEFT JOIN states ON {MATCH} GROUP BY 1, 2)
  SELECT id, matched, CASE WHEN matched = 0 THEN CASE WHEN status <> 1 THEN 'hidden' ELSE 'unavailable' END
  WHEN hidden = matched THEN 'hidden' WHEN visible = matched THEN 'visible' WHEN visible > 0 THEN 'partial'
  ELSE 'unavailable' END AS state FROM n""")
def c10_rule_states(spark, sf_dir):
    return C.rule_states(rules(spark, sf_dir), states(spark, sf_dir))


CATALOG = f"""best AS (SELECT model, max(model_price) AS mp, max(model_ratio) AS mr, max(completion_ratio) AS cr,
  max(cache_ratio) AS car FROM prices GROUP BY 1),
  cat AS (SELECT a.model, list_sort(list(DISTINCT "group")) AS groups, COALESCE(any_value(endpoints),
  []) AS endpoints, 'vendor-' || substring(a.model, 7, 1) AS vendor,
    'about ' || reverse(a.model) AS description, 'Tag-' || right(a.model, 1) || ', all' AS tags,
    any_value(mp) AS price,
    CASE WHEN any_value(mp) IS NULL THEN COALESCE(any_value(mr), 37.5) END AS ratio, CASE
    WHEN any_value(mp) IS NULL THEN COALESCE(any_value(cr), 1.0) END AS completion_ratio,
    any_value(car) AS cache_ratio, CASE WHEN a.model LIKE '%2' THEN CAST(1.25 AS DOUBLE) END AS creation_ratio,
    CAST(NULL AS DOUBLE) AS image_ratio,
    CASE WHEN a.model LIKE '%3' THEN CAST(8 AS DOUBLE) END AS audio_ratio, CASE
    WHEN a.model LIKE '%3' THEN CAST(2 AS DOUBLE) END AS audio_completion_ratio, any_value(mp) IS NOT NULL AS by_price
  FROM abilities a LEFT JOIN best b ON a.model = b.model LEFT JOIN model_endpoints e ON e.model = a.model
  WHERE enabled AND a.model NOT LIKE '%5' GROUP BY a.model)"""
LISTED = S.with_(S.ABILITIES, S.CHANNELS, S.ENDPOINTS, S.MODEL_ENDPOINTS, S.PRICES, CATALOG)


def model_endpoints(spark, sf_dir):
    return U.endpoints_of_models(S.abilities(spark, sf_dir), S.channels(spark, sf_dir), S.endpoints(spark, sf_dir))


def catalog(spark, sf_dir):
    a, model = S.abilities(spark, sf_dir), F.col("model")
    best = S.prices(spark, sf_dir).groupBy("model").agg(
        *(F.max(c).alias(c) for c in ("model_price", "model_ratio", "completion_ratio", "cache_ratio"))
    )
    audio = lambda x: F.when(model.endswith("3"), F.lit(x))
    best = best.withColumns(
        {
            "creation_ratio": F.when(model.endswith("2"), 1.25),
            "image_ratio": F.lit(None).cast("double"),
            "audio_ratio": audio(8.0),
            "audio_completion_ratio": audio(2.0),
        }
    )
    meta = a.select("model").distinct().select(
        "model", F.concat(F.lit("vendor-"), F.expr("substring(model, 7, 1)")).alias("vendor"), F.when(model.endswith("5"), 2).otherwise(1).alias("status"),
        F.concat(F.lit("about "), F.reverse("model")).alias("description"), F.concat(F.lit("Tag-"), F.expr("right(model, 1)"), F.lit(", all")).alias("tags"),
    )
    return C.price_list(a, best, meta, model_endpoints(spark, sf_dir))


@query(LISTED + "SELECT * FROM cat")
def c11_price_list(spark, sf_dir):
    return catalog(spark, sf_dir)


@query(LISTED + """SELECT model, price, ratio FROM cat WHERE (contains(lower(model), 'd#2')
  OR contains(lower(vendor), 'd#2') OR contains(lower(tags), 'd#2') OR contains(lower(description), 'd#2'))
  AND list_contains(groups, 'g1') AND by_price""")
def c12_search(spark, sf_dir):
    return C.search_catalog(
        catalog(spark, sf_dir), keyword="D#2", group="g1", by_price=True, sort="price"
    ).select("model", "price", "ratio")


@query(LISTED + """SELECT model, ratio, tags FROM cat WHERE contains(lower(description), '2#d')
  AND list_contains(endpoints, 'chat') AND tags LIKE 'Tag-2%' AND vendor = 'vendor-1' OR contains(lower(tags),
  'tag-4') AND vendor = 'vendor-2'""")
def c12_filters(spark, sf_dir):
    listed = catalog(spark, sf_dir)
    by_description = C.search_catalog(
        listed, keyword="2#D", endpoint="chat", tag="TAG-2", vendor="vendor-1", sort="-price"
    )
    return by_description.unionByName(
        C.search_catalog(listed, keyword="tag-4", vendor="vendor-2")
    ).select("model", "ratio", "tags")


@query(
    "SELECT DISTINCT trim(tag) AS tag FROM (SELECT unnest(regexp_split_to_array(lower(p_type || ', ' || p_brand || ';' || p_name || '|x'), '[,;|\\s]+')) AS tag FROM part) WHERE trim(tag) <> ''"
)
def c13_tags(spark, sf_dir):
    rows = S.table(spark, sf_dir, "part").select(
        F.concat("p_type", F.lit(", "), "p_brand", F.lit(";"), "p_name", F.lit("|x")).alias("tags")
    )
    return C.distinct_tags(rows, "tags")


@query(LISTED + f""", {RULES}, conns AS (SELECT model, "group", channel_id, name, type FROM abilities
  JOIN channels ON channel_id = channels.id WHERE enabled AND channels.status = 1),
  names AS (SELECT DISTINCT model FROM conns), hits AS (SELECT r.id, model FROM rules r JOIN names ON {MATCH}),
  h AS (SELECT hits.id, conns.* FROM hits JOIN conns USING (model)),
  g AS (SELECT id, list_sort(list(DISTINCT model)) AS models, list_sort(list(DISTINCT "group")) AS groups FROM h
  GROUP BY 1),
  b AS (SELECT id, list_sort(list({{'name': name, 'type': type}})) AS bound
  FROM (SELECT DISTINCT id, channel_id, name, type FROM h) GROUP BY 1),
  e AS (SELECT id, list_sort(list(DISTINCT endpoint)) AS endpoints FROM (SELECT hits.id, unnest(endpoints) AS endpoint
  FROM hits JOIN cat USING (model)) GROUP BY 1),
  t AS (SELECT hits.id, list_sort(list(DISTINCT CASE WHEN by_price THEN 1 ELSE 0 END)) AS quota_types FROM hits
  JOIN cat USING (model) GROUP BY 1),
  conf AS (SELECT DISTINCT c.id AS channel_id, trim(m) AS model
  FROM (SELECT id, unnest(string_split(models, ',')) AS m FROM configured_channels) c WHERE trim(m) <> ''),
  n AS (SELECT r.id, count(DISTINCT channel_id) AS n FROM rules r JOIN conf ON {MATCH} GROUP BY 1)
  SELECT r.id, CASE WHEN name_rule = 0 THEN [] ELSE COALESCE(models, []) END AS names, CASE WHEN name_rule = 0 THEN 0
  ELSE COALESCE(len(models), 0) END AS matched, COALESCE(groups, []) AS groups,
    list_transform(COALESCE(bound, []), lambda x: x.name || ':' || x.type) AS bound_channels, COALESCE(endpoints,
    []) AS endpoints, COALESCE(quota_types, []) AS quota_types, COALESCE(n, 0) AS configured_channels
  FROM rules r LEFT JOIN g USING (id) LEFT JOIN b USING (id) LEFT JOIN e USING (id) LEFT JOIN t USING (id) LEFT
  JOIN n USING (id)""".replace("configured_channels) c", """(SELECT
  s_suppkey - 1 AS id, 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey % 3) || ',, Brand#' || (1 + s_suppkey % 4) ||
  '2' AS models FROM supplier)) c"""))
def c14_enriched_rules(spark, sf_dir):
    k = F.col("id") + 1
    channels = S.channels(spark, sf_dir).withColumn(
        "models", S.text("Brand#", 1 + k % 5, 1 + k % 3, ",, Brand#", 1 + k % 4, "2")
    )
    found = C.enriched_rules(rules(spark, sf_dir), S.abilities(spark, sf_dir), channels, catalog(spark, sf_dir))
    return found.withColumn(
        "bound_channels",
        F.transform("bound_channels", lambda c: F.concat(c["name"], F.lit(":"), c["type"].cast("string"))),
    )
