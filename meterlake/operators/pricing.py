"""Usage pricing as column arithmetic over joined price tables.

Tokens are decimal(15,0) and ratios decimal(14,8); Spark keeps at least 6 digits of products and the result is
rounded once, half away from zero, so a quota differs from the exact one only within 1e-6 of a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlake.functions.scalars import INT32_MAX, INT32_MIN, QUOTA_PER_UNIT, clamped, quota_rounded, rounded

#: Fixed values.
DEFAULT_RATIO, DEFAULT_CACHE, DEFAULT_CREATION = 37.5, 1.0, 1.25
#: Completion ratio by name, first match wins; locked ones beat configured ratios.
COMPLETION_RULES = (
    (r"(-all|-gizmo-\*)$", 2.0, False),
    (r"^gpt-4o-2024-05-13$", 3.0, True),
    (r"^gpt-4o-mini-tts", 20.0, False),
    (r"^gpt-4o", 4.0, False),
    (r"^gpt-5[^.]*$", 8.0, True),
    (r"^gpt-5\.4-nano", 6.25, True),
    (r"^gpt-5\.4", 6.0, True),
    (r"^gpt-5", 6.0, False),
    (r"^gpt-4\.5-preview", 2.0, True),
    (r"^gpt-4-turbo|^gpt-4-110[56]$|^gpt-.*gpt-4-110[56]$", 3.0, True),
    (r"^gpt-", 2.0, False),
    (r"^o[13]", 4.0, True),
    (r"^chatgpt-4o-latest$", 3.0, True),
    (r"claude-3|claude-(sonnet|opus|haiku)-4", 5.0, True),
    (r"^mistral-", 3.0, True),
    (r"^gemini-(1\.5|2\.0)", 4.0, True),
    (r"^gemini-2\.5-pro", 8.0, False),
    (r"^gemini-2\.5-flash-preview", 3.5 / 0.15, False),
    (r"^gemini-2\.5-flash-lite", 4.0, False),
    (r"^gemini-2\.5-flash|^gemini-robotics-er-1\.5", 2.5 / 0.3, False),
    (r"^gemini-3-pro-image", 60.0, False),
    (r"^gemini-3-pro", 6.0, False),
    (r"^gemini-", 4.0, False),
    (r"^command-r$", 3.0, True),
    (r"^command-r-plus$", 5.0, True),
    (r"^command-r-(plus-)?08-2024$", 4.0, True),
    (r"^command", 4.0, False),
    (r"^ERNIE-(Speed-|Lite-|Character|Functions)", 2.0, True),
    (r"^llama2-70b-4096$", 0.8 / 0.64, True),
    (r"^llama3-8b-8192$", 2.0, True),
    (r"^llama3-70b-8192$", 0.79 / 0.59, True),
)


def lookup_name(name: Column) -> Column:
    """The name under which a model's price is looked up: thinking budgets and gizmos share wildcards."""
    out = F.when(name.startswith("gpt-4-gizmo"), "gpt-4-gizmo-*").when(name.startswith("gpt-4o-gizmo"), "gpt-4o-gizmo-*")
    for base in ("gemini-2.5-flash-lite", "gemini-2.5-flash", "gemini-2.5-pro"):
        out = out.when(name.startswith(base) & name.contains("-thinking-"), base + "-thinking-*")
    return out.otherwise(name)


def with_completion_ratio(names: DataFrame, name: str, configured: Column) -> DataFrame:
    """Adds ratio and locked: a configured name with `/`, else a locked rule, else configured, else the rule, else 1.

    Rules are tried in order, once a row: call it on distinct names.
    """
    of = lambda value, locked: F.struct(F.lit(value).alias("value"), F.lit(locked).alias("locked"))
    rule = F.when(F.lit(False), of(1.0, False))
    for pattern, value, locked in COMPLETION_RULES:
        rule = rule.when(F.col(name).rlike(pattern), of(float(value), locked))
    own = F.col(name).contains("/") & F.col("x_configured").isNotNull()
    ratio = F.when(own, F.col("x_configured")).when(F.col("x_rule.locked"), F.col("x_rule.value")).otherwise(F.coalesce("x_configured", "x_rule.value"))
    rows = names.withColumns({"x_rule": rule.otherwise(of(1.0, False)), "x_configured": configured})
    return rows.withColumns({"ratio": ratio, "locked": ~own & F.col("x_rule.locked")}).drop("x_rule", "x_configured")


def with_group_ratio(rows: DataFrame, groups: DataFrame, special: DataFrame) -> DataFrame:
    """Adds group_ratio: the override of (user_group, group), else the group's, else 1."""
    s = special.select("user_group", "group", F.col("ratio").alias("special_ratio"))
    g = groups.select("group", F.col("ratio").alias("plain_ratio"))
    joined = rows.join(s, ["user_group", "group"], "left").join(g, "group", "left")
    return joined.withColumn("group_ratio", F.coalesce("special_ratio", "plain_ratio", F.lit(1.0))).drop("special_ratio", "plain_ratio")


def tokens(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("decimal(15,0)")


def factor(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(14,8)")


def other_multiplier(ratios: Column) -> Column:
    """Product of a map's values that are positive, finite and not 1; 1 for null."""
    usable = F.filter(F.map_values(ratios), lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf")) & (v != 1))
    return F.coalesce(F.aggregate(usable, F.lit(1.0), lambda a, v: a * v), F.lit(1.0))


def creation_total() -> Column:
    """Cache-write tokens: the total or its split parts, whichever is more."""
    parts = F.col("creation_5m") + F.col("creation_1h")
    return F.when(parts > 0, F.greatest("cache_creation", parts)).otherwise(F.col("cache_creation"))


def with_text_quota(rows: DataFrame, use_price: Column, surcharge: Column, multiplier: Column) -> DataFrame:
    """Adds priced_quota and priced_kind: quota of a text request, and how it was clamped.

    Columns: prompt, completion, cache, cache_creation, creation_5m, creation_1h, image, audio (tokens), anthropic
    (input excludes cache tokens), model_price and the ratios model_ratio, completion_ratio, cache_ratio,
    creation_ratio, creation_5m_ratio, creation_1h_ratio, image_ratio, audio_price (USD per million), group_ratio.
    Each step is a column of its own, so that a row computes it once.
    """
    anthropic = F.col("anthropic")
    split = (F.col("creation_5m") > 0) | (F.col("creation_1h") > 0)
    zero = F.lit(0).cast("decimal(15,0)")
    base = tokens("prompt") - F.when(anthropic, zero).otherwise(tokens("cache") + tokens("cache_creation")) - tokens("image")
    base = base - F.when(F.col("audio_price") > 0, tokens("audio")).otherwise(zero)
    rest = F.greatest(tokens("cache_creation") - tokens("creation_5m") - tokens("creation_1h"), zero)
    parts = rest.cast("decimal(15,0)") * factor("creation_ratio")
    parts = parts + tokens("creation_5m") * factor("creation_5m_ratio") + tokens("creation_1h") * factor("creation_1h_ratio")
    creation = F.when(anthropic & split, parts).otherwise(tokens("cache_creation") * factor("creation_ratio"))
    priced = F.greatest(base, zero).cast("decimal(18,0)") * factor(F.lit(1)) + tokens("cache") * factor("cache_ratio")
    priced = priced + tokens("image") * factor("image_ratio") + creation + tokens("completion") * factor("completion_ratio")
    per_token = (factor("group_ratio") * F.lit(QUOTA_PER_UNIT / 1_000_000).cast("decimal(4,3)")).cast("decimal(12,6)")
    audio = F.when(F.col("audio_price") > 0, (factor("audio_price") * tokens("audio")).cast("decimal(26,8)") * per_token).otherwise(F.lit(0))
    by_price = factor("model_price") * F.lit(QUOTA_PER_UNIT).cast("decimal(7,0)") * factor("group_ratio") * F.col("x_times")
    steps = [
        {"x_times": factor(multiplier), "x_extra": surcharge, "x_fixed": use_price, "x_both": factor("model_ratio") * factor("group_ratio"), "x_priced": priced.cast("decimal(26,8)"), "x_audio": audio},
        {"x_by_ratio": ((F.col("x_priced") * F.col("x_both").cast("decimal(12,6)") + F.col("x_audio")) * F.col("x_times") + F.col("x_extra")).cast("double"), "x_by_price": (by_price + F.col("x_extra")).cast("double")},
        {"x_total": F.round(F.when(F.col("x_fixed"), F.col("x_by_price")).when((F.col("x_both") != 0) & (F.col("x_by_ratio") <= 0), 1.0).otherwise(F.col("x_by_ratio")))},
        {"x_found": clamped(F.col("x_total"), INT32_MIN, INT32_MAX), "x_billable": (F.col("prompt") + F.col("completion") > 0) | (F.col("x_extra") != 0)},
    ]
    out = rows
    for step in steps:
        out = out.withColumns(step)
    value = F.when(~F.col("x_billable"), 0).when((F.col("x_both") != 0) & (F.col("x_found.value") == 0), 1).otherwise(F.col("x_found.value"))
    return out.select(*rows.columns, value.cast("bigint").alias("priced_quota"), F.when(F.col("x_billable"), F.col("x_found.kind")).alias("priced_kind"))


def audio_quota() -> Column:
    """struct(value, kind) from text_in, text_out, audio_in, audio_out, completion_ratio, audio_ratio, audio_completion_ratio, model_ratio, group_ratio."""
    parts = tokens("text_in") * factor(F.lit(1)) + tokens("text_out") * factor("completion_ratio") + tokens("audio_in") * factor("audio_ratio") + tokens("audio_out") * (factor("audio_ratio") * factor("audio_completion_ratio")).cast("decimal(14,8)")
    both = factor("model_ratio") * factor("group_ratio")
    total = parts.cast("decimal(26,8)") * both.cast("decimal(12,6)")
    return quota_rounded(F.when((both != 0) & (total <= 0), F.lit(1.0)).otherwise(total.cast("double")))


def tool_prices(calls: DataFrame, table: DataFrame) -> DataFrame:
    """Calls (tool, model_name, ...) with price: the longest model prefix of the tool's rows, else its default, else 0.

    The theta join runs on distinct (tool, model) pairs; the price table has a row a tool and prefix ('' is the default).
    """
    pairs = calls.select("tool", "model_name").distinct()
    t = table.select(F.col("tool").alias("of"), "prefix", "price")
    hit = pairs.join(t, (pairs["tool"] == t["of"]) & pairs["model_name"].startswith(t["prefix"]), "left")
    best = hit.groupBy("tool", "model_name").agg(F.coalesce(F.max_by("price", F.length("prefix")), F.lit(0.0)).alias("price"))
    return calls.join(best, ["tool", "model_name"])


def tool_surcharges(priced: DataFrame, *keys: str) -> DataFrame:
    """Quota of tool calls by key: lines of one (tool, price) are merged, counts saturate at int64."""
    lines = priced.where((F.col("count") > 0) & (F.col("price") > 0) & (F.col("price") < float("inf")))
    lines = lines.groupBy(*keys, "tool", "price", "group_ratio").agg(F.least(F.sum(F.col("count").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint").alias("calls"))
    cost = F.col("price") * F.col("calls") / 1000 * F.col("group_ratio") * QUOTA_PER_UNIT
    return lines.groupBy(*keys).agg(F.sum("calls").alias("calls"), rounded(F.sum(cost), 4).alias("surcharge"))


def token_parts(used: set[str] | Column) -> dict[str, Column]:
    """Columns p, c, len, cr, cc, cc1h, img, img_cr, ai, img_o, ao for tiered prices that use the variables ``used``: the
    same ones for all rows, or a column of arrays.

    From prompt, completion, cache, cache_creation, creation_5m, creation_1h, image, cached_image (null: unknown),
    cached_text, cached_audio, audio, image_out, audio_out and anthropic. Priced sub-categories leave the rest; a
    breakdown of cached tokens that can't be true is not used; nothing is negative.
    """
    d = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    uses = lambda v: F.array_contains(used, v) if isinstance(used, Column) else F.lit(v in used)
    anthropic, p, c = F.col("anthropic"), d("prompt"), d("completion")
    cc, cc1h = F.when(anthropic, d("creation_5m")).otherwise(d("cache_creation")), F.when(anthropic, d("creation_1h")).otherwise(0.0)
    ci = F.col("cached_image")
    left = d("cache") - ci
    fits = ci.isNotNull() & (ci >= 0) & (d("cache") >= ci) & (d("image") >= ci) & (d("cache") <= p) & (d("image") <= p - left)
    fits = fits & (d("cached_text") >= 0) & (d("cached_text") <= left) & (d("cached_audio") >= 0) & (d("cached_audio") <= left - d("cached_text"))
    split = F.coalesce(fits, F.lit(False)) & ~anthropic & uses("img_cr")
    img_cr = F.when(split, ci.cast("double")).otherwise(0.0)
    cr, img, ai, img_o, ao = d("cache") - img_cr, d("image") - img_cr, d("audio"), d("image_out"), d("audio_out")
    outside, outside_c = p, c
    for name, value in (("cr", cr), ("cc", cc), ("cc1h", cc1h), ("img", img), ("img_cr", img_cr), ("ai", ai)):
        outside = outside - F.when(uses(name), value).otherwise(0.0)
    for name, value in (("img_o", img_o), ("ao", ao)):
        outside_c = outside_c - F.when(uses(name), value).otherwise(0.0)
    inside = F.when(uses("cr"), p).otherwise(p + cr)
    zero = F.lit(0.0)
    return {
        "p": F.greatest(zero, F.when(anthropic, inside).otherwise(outside)), "c": F.greatest(zero, F.when(anthropic, c).otherwise(outside_c)), "len": F.when(anthropic, p + cr + cc + cc1h).otherwise(p),
        "cr": cr, "cc": cc, "cc1h": cc1h, "img": img, "img_cr": img_cr, "img_o": img_o, "ai": ai, "ao": ao,
    }


def tier_price(tiers: list[dict]) -> Column:
    """struct(tier, cost): the first tier whose conditions hold. A tier: name, when (column name, operator, number), and
    either per (column -> USD per million) or fixed (USD a request). The last tier may have no condition."""
    name = F.when(F.lit(False), F.lit(""))
    cost = F.when(F.lit(False), F.lit(0.0))
    for t in tiers:
        hit = F.lit(True)
        for column, op, value in t.get("when", ()):
            hit = hit & {"<": F.col(column) < value, "<=": F.col(column) <= value, ">": F.col(column) > value, ">=": F.col(column) >= value, "==": F.col(column) == value}[op]
        price = F.lit(float(t["fixed"]) * 1_000_000) if "fixed" in t else sum((F.col(v) * float(x) for v, x in t["per"].items()), F.lit(0.0))
        name, cost = name.when(hit, F.lit(t["name"])), cost.when(hit, price)
    return F.struct(name.alias("tier"), cost.alias("cost"))


def tier_quota(tiers: list[dict], group_ratio: Column, estimated_tier: Column) -> Column:
    """struct(value, kind, tier, crossed): cost per million to quota, rounded and saturated; crossed if the tier differs
    from the estimated one."""
    found = tier_price(tiers)
    quota = quota_rounded(found["cost"] / 1_000_000 * QUOTA_PER_UNIT * group_ratio)
    return F.struct(quota["value"].alias("value"), quota["kind"].alias("kind"), found["tier"].alias("tier"), (found["tier"] != estimated_tier).alias("crossed"))


#: Tiers of a model as data: the first one counts whose conditions all hold. It has a price a request (USD) in ``fixed``,
#: or prices of variables (USD per million).
TIERS = "array<struct<name:string,conditions:array<struct<variable:string,op:string,value:double>>,fixed:double,prices:array<struct<variable:string,price:double>>>>"


def tier_variables(tiers: Column) -> Column:
    """Array of the variables that a column of tiers names."""
    empty = F.array().cast("array<string>")
    each = F.transform(tiers, lambda t: F.concat(F.coalesce(t["conditions"]["variable"], empty), F.coalesce(t["prices"]["variable"], empty)))
    return F.array_distinct(F.flatten(each))


def matched_tier(tiers: Column, values: Column) -> Column:
    """The first tier whose conditions hold for a map of variables (missing ones are 0); null without one."""
    of = lambda c: F.coalesce(F.try_element_at(values, c["variable"]), F.lit(0.0))

    def holds(c):
        value, op = of(c), c["op"]
        found = F.when(op == "<", value < c["value"]).when(op == "<=", value <= c["value"]).when(op == ">", value > c["value"])
        return F.coalesce(found.when(op == ">=", value >= c["value"]).when(op == "==", value == c["value"]), F.lit(False))

    none = F.array().cast("array<struct<variable:string,op:string,value:double>>")
    return F.try_element_at(F.filter(tiers, lambda t: F.forall(F.coalesce(t["conditions"], none), holds)), F.lit(1))


def tier_cost(tier: Column, values: Column) -> Column:
    """Cost of a matched tier in millionths of a USD."""
    each = lambda x: F.coalesce(x["price"] * F.try_element_at(values, x["variable"]), F.lit(0.0))
    prices = F.coalesce(tier["prices"], F.array().cast("array<struct<variable:string,price:double>>"))
    return F.coalesce(tier["fixed"] * 1_000_000, F.aggregate(prices, F.lit(0.0), lambda a, x: a + each(x)))


def with_tier_quota(rows: DataFrame, surcharge: Column) -> DataFrame:
    """Adds tier, tier_quota and tier_kind to rows of tiered billing, by the tiers in column ``tiers``.

    Variables are ``billing_tokens`` where the log kept them, else the token parts. Cost by group ratio and surcharge
    are rounded once and saturated. A row without tiers, or that no tier fits, has nulls.
    """
    parts = token_parts(F.col("x_used"))
    own = F.create_map(*(x for name, value in parts.items() for x in (F.lit(name), value)))
    steps = [
        {"x_used": tier_variables(F.col("tiers"))},
        {"x_values": F.when(F.col("tiers").isNotNull(), F.coalesce("billing_tokens", own))},
        {"x_tier": F.when(F.col("tiers").isNotNull(), matched_tier(F.col("tiers"), F.col("x_values")))},
        {"x_quota": quota_rounded(tier_cost(F.col("x_tier"), F.col("x_values")) / 1_000_000 * QUOTA_PER_UNIT * F.col("group_ratio") + surcharge.cast("double"))},
    ]
    out = rows
    for step in steps:
        out = out.withColumns(step)
    fits = F.col("x_tier").isNotNull()
    return out.select(*rows.columns, F.col("x_tier.name").alias("tier"), F.when(fits, F.col("x_quota.value")).cast("bigint").alias("tier_quota"), F.when(fits, F.col("x_quota.kind")).alias("tier_kind"))


def inferred_creation() -> Column:
    """Cache-creation tokens that explain a reported cost; -1 if out of range, 0 if they cost what input costs.

    From cost (USD), prompt, completion, cache, model_ratio, creation_ratio, cache_ratio, completion_ratio.
    """
    unit = F.col("model_ratio") / QUOTA_PER_UNIT
    value = (F.col("cost") - F.col("prompt") * unit + F.col("cache") * (unit - unit * F.col("cache_ratio")) - F.col("completion") * (unit * F.col("completion_ratio"))) / F.nullif(unit * F.col("creation_ratio") - unit, F.lit(0.0))
    found = quota_rounded(value)
    return F.when(F.col("creation_ratio") == 1, 0).when(value.isNull() | found["kind"].isNotNull(), -1).otherwise(found["value"])


#: Keys of the usage detail in a log's ``other``, and what a 1-hour cache write costs over a 5-minute one.
DETAIL = {
    "cache": "cache_tokens", "cache_creation": "cache_creation_tokens", "creation_5m": "cache_creation_tokens_5m", "creation_1h": "cache_creation_tokens_1h",
    "image": "image_output", "audio": "audio_input_token_count", "audio_out": "audio_output",
}
HOUR_CREATION = 6 / 3.75
#: Keys of other ratios in ``other``, and the billing mode of tiers.
RATIO_KEYS, TIERED = ("n", "seconds", "size"), "tiered_expr"


def usage_detail(logs: DataFrame, ratio_keys: tuple[str, ...] = RATIO_KEYS) -> DataFrame:
    """Logs with prompt, completion, the tokens of DETAIL (0 where ``other`` has none), anthropic, tool_calls, tiered
    (whether tiers billed it), estimated_tier, billing_tokens (null where not kept), cached_image and multiplier, the
    product of the ratios under ``ratio_keys``."""
    schema = ", ".join(f"{k} bigint" for k in DETAIL.values()) + ", claude boolean, tool_surcharges array<struct<name string, count bigint, price double>>"
    schema += ", billing_mode string, matched_tier string, billing_tokens map<string, double>, image_cache_tokens bigint, " + ", ".join(f"`{k}` double" for k in ratio_keys)
    rows = logs.withColumn("detail", F.from_json("other", schema))
    found = {c: F.coalesce(F.col(f"detail.{k}"), F.lit(0)) for c, k in DETAIL.items()}
    found |= {"prompt": F.col("prompt_tokens"), "completion": F.col("completion_tokens"), "anthropic": F.coalesce("detail.claude", F.lit(False)), "tool_calls": F.col("detail.tool_surcharges")}
    found |= {"tiered": F.coalesce(F.col("detail.billing_mode") == TIERED, F.lit(False)), "estimated_tier": F.col("detail.matched_tier"), "billing_tokens": F.col("detail.billing_tokens")}
    found |= {"cached_image": F.col("detail.image_cache_tokens")} | {c: F.lit(0) for c in ("cached_text", "cached_audio", "image_out")}
    ratios = F.create_map(*(x for k in ratio_keys for x in (F.lit(k), F.col(f"detail.`{k}`")))) if ratio_keys else F.lit(None).cast("map<string, double>")
    return rows.withColumns(found | {"multiplier": other_multiplier(ratios)}).drop("detail")


def priced_names(names: DataFrame, prices: DataFrame, tools: DataFrame, tiers: DataFrame | None = None) -> DataFrame:
    """One row for each distinct model_name, with all that its price depends on, so that no rule runs on a log row.

    ``prices`` (model, model_ratio, model_price, completion_ratio, cache_ratio, creation_ratio, image_ratio,
    audio_price) is looked up under the normalised name, and so is ``tiers`` (model, tiers). tool_prices: price by tool,
    that of the longest prefix.
    """
    distinct = names.select("model_name").distinct().withColumn("price_name", lookup_name(F.col("model_name")))
    known = distinct.join(prices.withColumnRenamed("model", "price_name"), "price_name", "left")
    if tiers is None:
        known = known.withColumn("tiers", F.lit(None).cast(TIERS))
    else:
        known = known.join(tiers.select(F.col("model").alias("price_name"), F.col("tiers").cast(TIERS).alias("tiers")), "price_name", "left")
    known = with_completion_ratio(known, "price_name", F.col("completion_ratio"))
    defaults = {"model_ratio": DEFAULT_RATIO, "cache_ratio": DEFAULT_CACHE, "creation_ratio": DEFAULT_CREATION, "image_ratio": 1.0, "audio_price": 0.0}
    filled = {c: F.coalesce(F.col(c), F.lit(x)) for c, x in defaults.items()}
    creation = filled["creation_ratio"]
    known = known.select("model_name", "model_price", "tiers", F.col("ratio").alias("completion_ratio"), *(c.alias(k) for k, c in filled.items()), creation.alias("creation_5m_ratio"), (creation * HOUR_CREATION).alias("creation_1h_ratio"))
    hit = distinct.select("model_name").join(tools, F.col("model_name").startswith(F.col("prefix")))
    best = hit.groupBy("model_name", "tool").agg(F.max_by("price", F.length("prefix")).alias("price"))
    by_tool = best.groupBy("model_name").agg(F.map_from_entries(F.collect_list(F.struct("tool", "price"))).alias("tool_prices"))
    return known.join(by_tool, "model_name", "left")


def tool_quota() -> Column:
    """Quota of a row's tool_calls at its tool_prices and group_ratio; calls without count or price cost nothing."""
    cost = lambda t: F.coalesce(F.try_element_at("tool_prices", t["name"]), F.lit(0.0)) * F.greatest(t["count"], F.lit(0))
    dollars = F.aggregate(F.coalesce("tool_calls", F.array()), F.lit(0.0), lambda a, t: a + F.coalesce(cost(t), F.lit(0.0)))
    return (dollars / 1000 * F.col("group_ratio") * QUOTA_PER_UNIT).cast("decimal(20,6)")


def rerate(logs: DataFrame, prices: DataFrame, groups: DataFrame, special: DataFrame, tools: DataFrame, tiers: DataFrame | None = None, ratio_keys: tuple[str, ...] = RATIO_KEYS) -> DataFrame:
    """Logs with the quota that today's prices give, its difference from the charged one, and the clamp kind.

    ``mode``: how it was priced. Logs that tiers billed go by the tiers of their model (``tier``; ``crossed``: another
    one than the log names), where it still has some; the others by price or ratio, times the log's other ratios.
    ``cache_write``: tokens written to caches. Token detail, ratios and tool calls come from ``other``; logs have
    user_group beside their columns. Prices, tiers, completion rules and tool prices are resolved on distinct names and
    joined by equality.
    """
    rows = with_group_ratio(usage_detail(logs, ratio_keys), groups, special)
    rows = rows.join(priced_names(logs, prices, tools, tiers), "model_name").withColumn("surcharge", tool_quota())
    rows = rows.withColumn("tiers", F.when(F.col("tiered"), F.col("tiers")))
    rows = with_text_quota(rows, F.col("model_price").isNotNull(), F.col("surcharge"), F.col("multiplier"))
    rows = with_tier_quota(rows, F.col("surcharge"))
    by_tier = F.col("tier_quota").isNotNull()
    expected = F.coalesce("tier_quota", "priced_quota")
    return rows.select(
        "id", "model_name", "quota", F.when(by_tier, "tier").when(F.col("model_price").isNotNull(), "price").otherwise("ratio").alias("mode"), expected.alias("expected"), (expected - F.col("quota")).alias("delta"),
        F.when(by_tier, F.col("tier_kind")).otherwise(F.col("priced_kind")).alias("kind"), "tier", (F.col("tier") != F.col("estimated_tier")).alias("crossed"), creation_total().alias("cache_write"),
    )


#: Columns of the price sheet and the ratios that multiply the base price.
SHEET = {"input": (), "output": ("completion_ratio",), "cache": ("cache_ratio",), "create_cache": ("creation_ratio",), "image": ("image_ratio",), "audio_input": ("audio_ratio",), "audio_output": ("audio_ratio", "audio_completion_ratio")}


def price_sheet(models: DataFrame, recharge: float = 1.0) -> DataFrame:
    """(model, kind, usd) per million tokens in long form; a missing ratio gives no row."""
    base = F.col("model_ratio") * 2 * F.col("group_ratio") * recharge
    kinds = []
    for kind, ratios in SHEET.items():
        usd = base
        for r in ratios:
            usd = usd * F.col(r)
        kinds.append(F.struct(F.lit(kind).alias("kind"), rounded(usd, 6).alias("usd")))
    return models.select("model", F.inline(F.array(*kinds))).where("usd is not null")


def display_group_ratio(models: DataFrame, groups: DataFrame, selected: str = "") -> DataFrame:
    """(model, ratio): the selected group's if the model has it, else the least of its groups' ratios, else 1."""
    rows = models.select("model", F.explode_outer("groups").alias("group")).join(groups, "group", "left")
    chosen = F.max(F.when(F.col("group") == selected, F.col("ratio")))
    return rows.groupBy("model").agg(F.coalesce(chosen, F.min("ratio"), F.lit(1.0)).alias("ratio"))
