"""Queries of usage pricing. Sample ratios are binary fractions, so that doubles in the oracle are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlake.functions.scalars import quota_rounded, quota_truncated, usd, wallet
from meterlake.operators import pricing as M
from meterlake.plans import query
from meterlake.sources import samples as S

NAMES = (
    "gpt-4o-mini",
    "gpt-4o-2024-05-13",
    "gpt-5-pro",
    "gpt-5.4-nano-x",
    "gpt-5.6",
    "gpt-4-gizmo-abc",
    "gemini-2.5-flash-thinking-128",
    "gemini-2.5-pro-exp",
    "claude-3-haiku",
    "claude-opus-4-1",
    "o3-mini",
    "command-r-plus",
    "ERNIE-Lite-8K",
    "llama3-8b-8192",
    "vendor/own",
    "x-all",
    "mistral-large",
    "else",
)


def named(spark, sf_dir):
    i = F.col("id")
    return S.logs(spark, sf_dir).withColumn(
        "model_name", F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int"))
    )


NAMED = f"""named AS (SELECT * REPLACE (CASE id % {len(NAMES)}
  {' '.join(f'WHEN {k} THEN ' + repr(n) for k, n in enumerate(NAMES))} END AS model_name) FROM logs)"""
LOOKUP = """CASE WHEN starts_with(model_name, 'gpt-4-gizmo') THEN 'gpt-4-gizmo-*'
  WHEN starts_with(model_name, 'gemini-2.5-flash') AND contains(model_name,
  '-thinking-') THEN 'gemini-2.5-flash-thinking-*' ELSE model_name END"""
RULES = "CASE " + " ".join(
    f"WHEN regexp_matches({LOOKUP}, '{p}') THEN CAST({v!r} AS DOUBLE)" for p, v, _ in M.COMPLETION_RULES
) + " ELSE 1.0 END"
LOCKS = "CASE " + " ".join(
    f"WHEN regexp_matches({LOOKUP}, '{p}') THEN {x}" for p, _, x in M.COMPLETION_RULES
) + " ELSE false END"
WITH = S.with_(S.LOGS, NAMED)


@query(WITH + f"""SELECT model_name, {LOOKUP} AS price_name, count(*) AS rows, CASE
  WHEN contains(model_name, '/') THEN 7.5 WHEN {LOCKS} THEN {RULES} ELSE CASE WHEN length(model_name) % 2 = 0 THEN 7.5
  ELSE {RULES} END END AS ratio,
  CASE WHEN contains(model_name, '/') THEN false ELSE {LOCKS} END AS locked FROM named GROUP BY ALL""")
def m1_m2_completion_ratios(spark, sf_dir):
    # rules run on distinct names
    names = named(spark, sf_dir).groupBy("model_name").agg(F.count("*").alias("rows")).withColumn(
        "price_name", M.lookup_name(F.col("model_name"))
    )
    configured = F.when(F.col("model_name").contains("/") | (F.length("model_name") % 2 == 0), F.lit(7.5))
    return M.with_completion_ratio(names, "price_name", configured).select(
        "model_name", "price_name", "rows", "ratio", "locked"
    )


@query(S.with_(S.LOGS) + """SELECT id, "group", CASE WHEN user_id % 5 = 0 AND "group" = 'vip' THEN 0.5
  WHEN "group" = 'vip' THEN 0.75 WHEN "group" = 'default' THEN 1.5 ELSE 1.0 END AS group_ratio FROM logs""")
def m3_group_ratios(spark, sf_dir):
    ratios = S.logs(spark, sf_dir).where("`group` != ''").select("group").distinct().withColumn(
        "ratio", F.when(F.col("group") == "vip", 0.75).otherwise(1.5)
    )
    special = ratios.where("`group` = 'vip'").select(
        F.lit("u0").alias("user_group"), "group", F.lit(0.5).alias("ratio")
    )
    rows = S.logs(spark, sf_dir).withColumn("user_group", S.text("u", F.col("user_id") % 5))
    return M.with_group_ratio(rows, ratios, special).select("id", "group", "group_ratio")


def usage(spark, sf_dir):
    i = F.col("event_id")
    n = lambda e: e.cast("bigint")
    r = lambda x: F.lit(x)
    return S.table(spark, sf_dir, "events").select(
        i.alias("id"), n(i % 9000).alias("prompt"), n(i % 700).alias("completion"), n(i % 300).alias("cache"), n(i % 90).alias("cache_creation"), n(i % 40).alias("creation_5m"), n(i % 60).alias("creation_1h"), n(i % 50).alias("image"), n(i % 30).alias("audio"), (i % 3 == 0).alias("anthropic"),
        r(0.02).alias("model_price"), (i % 8 * 0.25).alias("model_ratio"), r(4.0).alias("completion_ratio"), r(0.125).alias("cache_ratio"), r(1.25).alias("creation_ratio"), r(1.25).alias("creation_5m_ratio"), r(2.0).alias("creation_1h_ratio"), r(1.5).alias("image_ratio"), F.when(i % 2 == 0, 4.0).otherwise(0.0).alias("audio_price"), (i % 4 * 0.5).alias("group_ratio"),
    )


USAGE = """usage AS (SELECT event_id AS id, event_id % 9000 AS prompt, event_id % 700 AS completion,
  event_id % 300 AS cache, event_id % 90 AS creation, event_id % 40 AS c5, event_id % 60 AS c1,
  event_id % 50 AS image, event_id % 30 AS audio, event_id % 3 = 0 AS anthropic,
  CAST(event_id % 8 * 0.25 AS DOUBLE) AS mr, CASE WHEN event_id % 2 = 0 THEN CAST(4 AS DOUBLE)
  ELSE 0 END AS ap, CAST(event_id % 4 * 0.5 AS DOUBLE) AS gr FROM events),
  parts AS (SELECT *, greatest(0, prompt - CASE WHEN anthropic THEN 0 ELSE cache + creation END - image - CASE
  WHEN ap > 0 THEN audio ELSE 0 END) + cache * CAST(0.125 AS DOUBLE) + image * CAST(1.5 AS DOUBLE)
    + CASE WHEN anthropic AND (c5 > 0 OR c1 > 0) THEN greatest(creation - c5 - c1,
    0) * CAST(1.25 AS DOUBLE) + c5 * CAST(1.25 AS DOUBLE) + c1 * CAST(2 AS DOUBLE)
    ELSE creation * CAST(1.25 AS DOUBLE) END + completion * CAST(4 AS DOUBLE) AS priced FROM usage),
  total AS (SELECT *, (priced * mr * gr + ap * audio * gr * CAST(0.5 AS DOUBLE)) * CAST(1.5 AS DOUBLE) + CAST(0.25 AS
  DOUBLE) * (id % 2) AS t FROM parts)"""


@query(S.with_(USAGE) + """SELECT id, CASE WHEN prompt + completion = 0 AND id % 2 = 0 THEN 0
  WHEN id % 10 = 7 THEN CASE WHEN mr * gr <> 0 AND CAST(round(CAST(10000 AS DOUBLE) * gr * CAST(1.5 AS DOUBLE) +
  CAST(0.25 AS DOUBLE) * (id % 2)) AS BIGINT) = 0 THEN 1
  ELSE CAST(round(CAST(10000 AS DOUBLE) * gr * CAST(1.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (id % 2)) AS BIGINT) END
  WHEN mr * gr <> 0 AND (t <= 0 OR round(t) = 0) THEN 1 ELSE CAST(round(t) AS BIGINT) END AS quota FROM total
  WHERE id % 10 <> 7 OR id % 10 = 7""")
def m4_m6_text_quota(spark, sf_dir):
    i = F.col("id")
    extra = (i % 2 * F.lit(0.25)).cast("decimal(20,6)")
    ratios = F.create_map(
        F.lit("size"), F.lit(3.0), F.lit("none"), F.lit(1.0), F.lit("bad"), F.lit(-2.0), F.lit("half"), F.lit(0.5)
    )
    priced = M.with_text_quota(usage(spark, sf_dir), i % 10 == 7, extra, M.other_multiplier(ratios))
    return priced.select("id", F.col("priced_quota").alias("quota"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 8 * event_id % 4 <> -1 THEN CASE
  WHEN (event_id % 8) * (event_id % 4) = 0 THEN CAST(0 AS BIGINT)
  ELSE CAST(greatest(round((event_id % 400 + event_id % 70 * CAST(4 AS DOUBLE) + event_id % 50 * CAST(2 AS DOUBLE) +
  event_id % 20 * CAST(1 AS DOUBLE)) * CAST(event_id % 8 * 0.25 AS DOUBLE) * CAST(event_id % 4 * 0.5 AS DOUBLE)),
  CASE WHEN event_id % 400 + event_id % 70 + event_id % 50 + event_id % 20 = 0 THEN 1
  ELSE 0 END) AS BIGINT) END END AS quota FROM events""")
def m7_audio_quota(spark, sf_dir):
    i = F.col("id")
    rows = usage(spark, sf_dir).withColumns(
        {
            "text_in": i % 400,
            "text_out": i % 70,
            "audio_in": i % 50,
            "audio_out": i % 20,
            "audio_ratio": F.lit(2.0),
            "audio_completion_ratio": F.lit(0.5),
        }
    )
    return rows.select("id", M.audio_quota()["value"].alias("quota"))


@query("""WITH c AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'search'
  WHEN o_orderkey % 3 = 1 THEN 'files' ELSE 'none' END AS tool, 'model-' || (o_orderkey % 13) AS model,
  o_orderkey % 5 AS n FROM orders),
  p AS (SELECT *, CASE WHEN tool = 'search' THEN CASE WHEN starts_with(model, 'model-12') THEN 8.0
  WHEN starts_with(model, 'model-1') THEN 4.0 ELSE 2.0 END WHEN tool = 'files' THEN 1.0 ELSE 0.0 END AS price FROM c)
  SELECT o_custkey AS user_id, CAST(sum(n) AS BIGINT) AS calls,
  round(sum(CAST(price * n AS DOUBLE) / 1000 * 0.5 * 500000) * 10000) / 10000 AS surcharge FROM p
  WHERE n > 0 AND price > 0 GROUP BY 1""")
def j11_m8_tool_surcharges(spark, sf_dir):
    k = F.col("o_orderkey")
    calls = S.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(k % 3 == 0, "search").when(k % 3 == 1, "files").otherwise("none").alias("tool"),
        S.text("model-", k % 13).alias("model_name"),
        (k % 5).alias("count"),
        F.lit(0.5).alias("group_ratio"),
    )
    table = spark.createDataFrame(
        [("search", "", 2.0), ("search", "model-1", 4.0), ("search", "model-12", 8.0), ("files", "", 1.0)],
        "tool string, prefix string, price double",
    )
    return M.tool_surcharges(M.tool_prices(calls, table), "user_id")


@query("""SELECT event_id AS id, CASE WHEN value > 300 THEN 2147483647
  ELSE CAST(trunc((value - 100) * 10000000) AS BIGINT) END AS truncated, CASE WHEN value > 300 THEN 2147483647
  ELSE CAST(round(CAST(event_id % 100 AS DOUBLE) / 2 - 20) AS BIGINT) END AS rounded, CASE
  WHEN value > 300 THEN 'overflow' END AS kind, CAST(round(value) AS BIGINT) AS wallet FROM events""")
def m10_m11_conversions(spark, sf_dir):
    big = F.col("value") > 300
    half = (F.col("event_id") % 100).cast("double") / 2 - 20
    t, r = quota_truncated(
        F.when(big, F.lit(1e12)).otherwise((F.col("value") - 100) * 10_000_000)
    ), quota_rounded(F.when(big, F.lit(1e12)).otherwise(half))
    return S.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        t["value"].alias("truncated"),
        r["value"].alias("rounded"),
        r["kind"].alias("kind"),
        wallet(F.col("value"))["value"].alias("wallet"),
    )


USED = {"cr", "cc", "cc1h", "img_cr", "ai"}
PARTS = """x AS (SELECT event_id AS id, CAST(event_id % 9000 AS DOUBLE) AS prompt,
  CAST(event_id % 700 AS DOUBLE) AS completion, CAST(event_id % 300 AS DOUBLE) AS cache, event_id % 90 AS creation,
  event_id % 40 AS c5, event_id % 60 AS c1, CAST(event_id % 50 AS DOUBLE) AS image, event_id % 30 AS audio,
  event_id % 3 = 0 AS a, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 45 END AS ci FROM events),
  y AS (SELECT *, CASE WHEN a THEN c5 ELSE creation END AS cc, CASE WHEN a THEN c1 ELSE 0 END AS cc1h, CASE
  WHEN NOT a AND ci IS NOT NULL AND cache >= ci AND image >= ci AND cache <= prompt
  AND image <= prompt - (cache - ci) THEN ci ELSE 0 END AS img_cr FROM x),
  parts AS (SELECT id, a, CAST(greatest(0, CASE WHEN a THEN prompt
  ELSE prompt - (cache - img_cr) - cc - cc1h - img_cr - audio END) AS DOUBLE) AS p, CAST(completion AS DOUBLE) AS c,
  CAST(CASE WHEN a THEN prompt + cache + cc + cc1h ELSE prompt END AS DOUBLE) AS len,
  CAST(cache - img_cr AS DOUBLE) AS cr, CAST(cc AS DOUBLE) AS cc, CAST(img_cr AS DOUBLE) AS img_cr FROM y)"""


def parts(spark, sf_dir):
    i = F.col("id")
    rows = usage(spark, sf_dir).withColumns(
        {
            "cached_image": F.when(i % 4 == 0, F.lit(None)).otherwise(i % 45),
            "cached_text": F.lit(0),
            "cached_audio": F.lit(0),
            "image_out": F.lit(0),
            "audio_out": F.lit(0),
        }
    )
    return rows.select("id", *(c.alias(n) for n, c in M.token_parts(USED).items()))


@query(S.with_(PARTS) + "SELECT id, p, c, len, cr, cc, img_cr FROM parts")
def m12_token_parts(spark, sf_dir):
    return parts(spark, sf_dir).select("id", "p", "c", "len", "cr", "cc", "img_cr")


TIERS = [
    {"name": "request", "when": [("len", "<", 100)], "fixed": 0.0009765625},
    {"name": "standard", "when": [("len", "<=", 4000), ("c", "<", 500)], "per": {"p": 1.5, "c": 7.5, "cr": 0.25}},
    {"name": "long", "per": {"p": 3.0, "c": 11.25, "cr": 0.5}},
]


@query(S.with_(PARTS) + """, t AS (SELECT *, CASE WHEN len < 100 THEN 'request'
  WHEN len <= 4000 AND c < 500 THEN 'standard' ELSE 'long' END AS tier FROM parts)
  SELECT id, tier, tier <> 'standard' AS crossed, CAST(round(CASE tier WHEN 'request' THEN CAST(976.5625 AS DOUBLE)
  WHEN 'standard' THEN p * CAST(1.5 AS DOUBLE) + c * CAST(7.5 AS DOUBLE) + cr * CAST(0.25 AS DOUBLE)
  ELSE p * CAST(3 AS DOUBLE) + c * CAST(11.25 AS DOUBLE) + cr * CAST(0.5 AS DOUBLE) END / 1000000 * 500000 * CAST(0.5
  AS DOUBLE)) AS BIGINT) AS quota FROM t""")
def m13_tier_quota(spark, sf_dir):
    found = M.tier_quota(TIERS, F.lit(0.5), F.lit("standard"))
    return parts(spark, sf_dir).withColumn("found", found).select(
        "id", "found.tier", "found.crossed", F.col("found.value").alias("quota")
    )


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 0
  ELSE CAST(round(CAST(event_id % 400 * 1024 AS DOUBLE) / 1024) AS BIGINT) END AS creation FROM events""")
def m14_inferred_creation(spark, sf_dir):
    """Costs are built from known creation tokens, which must come back."""
    i = F.col("id")
    rows = usage(spark, sf_dir).withColumns(
        {"model_ratio": F.lit(1.0), "creation_ratio": F.when(i % 5 == 0, 1.0).otherwise(1.25)}
    )
    unit = 1 / 500_000
    cost = (
        F.col("prompt") - F.col("cache") * (
            1 - F.col("cache_ratio")
        ) + F.col("completion") * F.col("completion_ratio") + (i % 400) * 0.25
    ) * unit
    return rows.withColumn("cost", cost).select("id", M.inferred_creation().cast("bigint").alias("creation"))


#: Logs whose model is a brand for every other row and one of NAMES for the rest, with usage detail in ``other``.
RERATED = f"""l AS (SELECT id, user_id, quota, "group", CASE WHEN id % 2 = 0 THEN 'Brand#' || (1 + id % 5) || (1 + id
  % 4)
    ELSE CASE id % {len(NAMES)} {' '.join(f'WHEN {k} THEN ' + repr(n) for k, n in enumerate(NAMES))} END END AS
    model_name,
  prompt_tokens AS prompt, completion_tokens AS completion, id % 300 AS cache, id % 90 AS creation, id % 40 AS c5,
  id % 60 AS c1, id % 50 AS image,
  id % 5 < 2 AS tiered, CASE WHEN id % 11 = 0 THEN 2.5 ELSE 1.0 END * CASE WHEN id % 13 = 0 THEN 0.5 ELSE 1.0 END AS times,
  id % 30 AS audio, id % 3 = 0 AS claude, CASE WHEN id % 7 = 0 THEN id % 4 ELSE 0 END AS calls FROM logs),
best AS (SELECT model, max(model_ratio) AS mr, max(model_price) AS mp, max(completion_ratio) AS cr,
  max(cache_ratio) AS car,
  CASE WHEN model LIKE '%1' THEN CAST(4 AS DOUBLE) END AS ap FROM prices GROUP BY 1),
j AS (SELECT l.*, CAST(COALESCE(mr, 1.0) AS DOUBLE) AS tr, CASE WHEN tiered AND ends_with(model, '2') THEN 2
  WHEN tiered AND ends_with(model, '3') THEN 3 END AS plan, COALESCE(mr, 37.5) AS mr, mp, COALESCE(car, 1.0) AS car, COALESCE(ap, 0.0) AS ap,
  CASE WHEN contains({LOOKUP}, '/') AND cr IS NOT NULL THEN cr WHEN {LOCKS} THEN {RULES}
  ELSE COALESCE(cr, {RULES}) END AS cr,
  CASE WHEN u."group" = 'auto' AND l."group" = 'vip' THEN 0.5 WHEN l."group" = 'vip' THEN 0.75
  WHEN l."group" = 'default' THEN 1.5 ELSE 1.0 END AS gr
  FROM l LEFT JOIN best ON {LOOKUP} = model LEFT JOIN users u ON u.id = l.user_id),
p AS (SELECT *, greatest(0, prompt - CASE WHEN claude THEN 0 ELSE cache + creation END - image - CASE
  WHEN ap > 0 THEN audio ELSE 0 END) + cache * car + image
    + CASE WHEN claude AND (c5 > 0 OR c1 > 0) THEN greatest(creation - c5 - c1,
    0) * CAST(1.25 AS DOUBLE) + c5 * CAST(1.25 AS DOUBLE) + c1 * CAST(2 AS DOUBLE)
      ELSE creation * CAST(1.25 AS DOUBLE) END + completion * cr AS priced,
  CASE WHEN starts_with(model_name, 'gpt-') THEN 4.0 ELSE 2.0 END * calls / 1000 * gr * 500000 AS extra FROM j),
v AS (SELECT *, CASE WHEN claude THEN prompt + cache + c5 + c1 ELSE prompt END AS len,
  CASE WHEN plan = 3 THEN CASE WHEN claude THEN prompt + cache ELSE prompt END WHEN claude THEN prompt
  ELSE greatest(prompt - cache - audio, 0) END AS tp FROM p),
w AS (SELECT *, CASE WHEN plan = 2 AND len <= 400 THEN 'short' WHEN plan = 2 THEN 'long'
  WHEN plan = 3 AND completion < 100 AND len < 600 THEN 'request' WHEN plan = 3 THEN 'rest' END AS tier FROM v),
t AS (SELECT *, CASE tier WHEN 'short' THEN tp * tr + completion * tr * 4 + cache * tr / 4
  WHEN 'long' THEN tp * tr * 2 + completion * tr * 8 + audio * tr WHEN 'request' THEN CAST(976.5625 AS DOUBLE)
  WHEN 'rest' THEN tp * tr + completion * tr END AS cost,
  CASE WHEN mp IS NOT NULL THEN CAST(mp AS DOUBLE) * 500000 * gr * times + extra
  ELSE (priced * mr * gr + ap * audio * gr * CAST(0.5 AS DOUBLE)) * times + extra END AS total FROM w)"""


@query(S.with_(S.LOGS, S.PRICES, S.USERS, RERATED) + """, e AS (SELECT *, CASE WHEN tier IS NOT NULL
  THEN CAST(round(CAST(cost / 1000000 * 500000 * gr + extra AS DOUBLE)) AS BIGINT) WHEN prompt + completion = 0 AND extra = 0 THEN 0
    WHEN mr * gr <> 0 AND round(total) <= 0 THEN 1 ELSE CAST(round(CAST(total AS DOUBLE)) AS BIGINT) END AS expected
    FROM t)
  SELECT id, model_name, quota, CASE WHEN tier IS NOT NULL THEN 'tier' WHEN mp IS NOT NULL THEN 'price' ELSE 'ratio' END AS mode,
  CAST(expected AS BIGINT) AS expected, CAST(expected - quota AS BIGINT) AS delta, CAST(NULL AS VARCHAR) AS kind, tier,
  CASE WHEN tiered THEN tier <> 'long' END AS crossed,
  CASE WHEN c5 + c1 > 0 THEN greatest(creation, c5 + c1) ELSE creation END AS cache_write FROM e""")
def j12_m15_rerate(spark, sf_dir):
    """Three kinds of billing: by ratio, by price, and by each model's own tiers."""
    i, none = F.col("id"), F.lit(None).cast("double")
    best = S.prices(spark, sf_dir).groupBy("model").agg(
        *(F.max(c).alias(c) for c in ("model_ratio", "model_price", "completion_ratio", "cache_ratio"))
    )
    best = best.withColumns(
        {"creation_ratio": none, "image_ratio": none, "audio_price": F.when(F.col("model").endswith("1"), 4.0)}
    )
    calls = F.array(F.struct(F.lit("search").alias("name"), (i % 4).alias("count"), F.lit(1.0).alias("price")))
    detail = F.struct(
        (i % 300).alias("cache_tokens"), (i % 90).alias("cache_creation_tokens"), (i % 40).alias("cache_creation_tokens_5m"), (i % 60).alias("cache_creation_tokens_1h"),
        (i % 50).alias("image_output"), (i % 30).alias("audio_input_token_count"), (i % 3 == 0).alias("claude"), F.when(i % 7 == 0, calls).alias("tool_surcharges"),
        F.when(i % 5 < 2, M.TIERED).alias("billing_mode"), F.when(i % 5 < 2, "long").alias("matched_tier"), F.when(i % 11 == 0, 2.5).alias("seconds"), F.when(i % 13 == 0, 0.5).alias("size"),
    )
    ratio = F.coalesce("model_ratio", F.lit(1.0))
    price = lambda **by: F.array(*(F.struct(F.lit(v).alias("variable"), (ratio * x).alias("price")) for v, x in by.items()))
    when = lambda *cs: F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(op).alias("op"), F.lit(float(x)).alias("value")) for v, op, x in cs))
    tier = lambda name, conditions, fixed, prices: F.struct(F.lit(name).alias("name"), conditions.alias("conditions"), F.lit(fixed).cast("double").alias("fixed"), prices.alias("prices"))
    always, free = F.lit(None).cast("array<struct<variable:string,op:string,value:double>>"), F.lit(None).cast("array<struct<variable:string,price:double>>")
    two = F.array(tier("short", when(("len", "<=", 400)), None, price(p=1, c=4, cr=0.25)), tier("long", always, None, price(p=2, c=8, ai=1)))
    three = F.array(tier("request", when(("c", "<", 100), ("len", "<", 600)), 0.0009765625, free), tier("rest", always, None, price(p=1, c=1)))
    tiers = best.select("model", F.when(F.col("model").endswith("2"), two).when(F.col("model").endswith("3"), three).alias("tiers"))
    own = F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int"))
    name = F.when(i % 2 == 0, S.text("Brand#", 1 + i % 5, 1 + i % 4)).otherwise(own)
    logs = S.logs(spark, sf_dir).withColumns({"model_name": name, "other": F.to_json(detail)})
    logs = logs.join(
        S.users(spark, sf_dir).select(F.col("id").alias("user_id"), F.col("group").alias("user_group")),
        "user_id",
        "left",
    )
    groups = S.logs(spark, sf_dir).where("`group` != ''").select("group").distinct().withColumn(
        "ratio", F.when(F.col("group") == "vip", 0.75).otherwise(1.5)
    )
    special = groups.where("`group` = 'vip'").select(
        F.lit("auto").alias("user_group"), "group", F.lit(0.5).alias("ratio")
    )
    tools = spark.createDataFrame(
        [("search", "", 2.0), ("search", "gpt-", 4.0)], "tool string, prefix string, price double"
    )
    return M.rerate(logs, best, groups, special, tools, tiers)


@query(S.with_(S.LOGS) + """SELECT id, CASE WHEN quota % 97 > 0 AND round(CAST(quota % 97 AS DOUBLE) / 500000 *
  10000) / 10000 < 0.0001 THEN CAST(0.0001 AS DOUBLE) ELSE round(CAST(quota % 97 AS DOUBLE) / 500000 * 10000) / 10000
  END AS tiny,
  CASE WHEN quota > 0 AND round(CAST(quota AS DOUBLE) / 500000 * 10000) / 10000 < 0.0001 THEN CAST(0.0001 AS DOUBLE)
  ELSE round(CAST(quota AS DOUBLE) / 500000 * 10000) / 10000 END AS usd FROM logs""")
def m16_usd(spark, sf_dir):
    return S.logs(spark, sf_dir).select("id", usd(F.col("quota") % 97).alias("tiny"), usd(F.col("quota")).alias("usd"))


@query(S.with_(S.PRICES) + """, k AS (SELECT model || upstream AS model, 'input' AS kind,
  model_ratio * 2 * 0.5 AS usd FROM prices UNION ALL SELECT model || upstream, 'output',
  model_ratio * 2 * 0.5 * completion_ratio FROM prices UNION ALL
  SELECT model || upstream, 'cache', model_ratio * 2 * 0.5 * cache_ratio FROM prices
  UNION ALL SELECT model || upstream, 'create_cache', model_ratio * 2 * 0.5 * 1.25 FROM prices)
  SELECT model, kind, round(usd * 1000000) / 1000000 AS usd FROM k WHERE usd IS NOT NULL""")
def m17_price_sheet(spark, sf_dir):
    none = F.lit(None).cast("double")
    rows = S.prices(spark, sf_dir).withColumns(
        {
            "model": F.concat("model", "upstream"),
            "group_ratio": F.lit(0.5),
            "creation_ratio": F.lit(1.25),
            "image_ratio": none,
            "audio_ratio": none,
            "audio_completion_ratio": none,
        }
    )
    return M.price_sheet(rows)


@query(S.with_(S.ABILITIES) + """, g AS (SELECT "group", CASE WHEN "group" = 'g0' THEN 0.5
  WHEN "group" = 'g1' THEN 0.75 END AS ratio FROM (SELECT DISTINCT "group" FROM abilities))
  SELECT model, COALESCE(max(CASE WHEN "group" = 'g1' THEN ratio END), min(ratio), 1.0) AS ratio
  FROM (SELECT DISTINCT model, "group" FROM abilities WHERE enabled) LEFT JOIN g USING ("group") GROUP BY 1""")
def m18_display_ratio(spark, sf_dir):
    from meterlake.operators.usage import groups_of_models

    a = S.abilities(spark, sf_dir)
    groups = a.select("group").distinct().withColumn(
        "ratio", F.when(F.col("group") == "g0", 0.5).when(F.col("group") == "g1", 0.75)
    ).where("ratio is not null")
    return M.display_group_ratio(groups_of_models(a), groups, "g1")
