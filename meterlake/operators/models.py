"""Model catalogs: abilities, metadata rules, list sets, price reconciliation, routes, search.

Pattern joins run on distinct names against rule tables, and rejoin their rows by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import rounded

#: Name rules in their order of precedence.
EXACT, PREFIX, CONTAINS, SUFFIX = 0, 1, 2, 3
PATTERN = ["name_rule", "pattern"]
PRECEDENCE = {EXACT: 0, PREFIX: 1, SUFFIX: 2, CONTAINS: 3}
#: Characters of the pieces by which names are indexed.
GRAM = 3
TOLERANCE = 1e-9
FIELDS = ("model_ratio", "completion_ratio", "cache_ratio", "model_price")


def pieces(column: str, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text; the empty piece is in every text, the empty one too."""
    starts = F.sequence(F.lit(1), F.length(column) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size)))
    return F.when(F.length(column) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) for each distinct text and each distinct pattern that it contains; nulls fit nothing.

    An inverted index answers: patterns under GRAM characters are looked up among the pieces of their size, longer ones
    meet only the texts that hold the rarest of their grams, and are then compared whole. All joins are by equality.
    """
    texts = texts.select("text").where("text is not null").distinct()
    patterns = patterns.select("pattern").where("pattern is not null").distinct()
    short = texts.select("text", F.explode(F.concat(*(pieces("text", k) for k in range(GRAM)))).alias("pattern"))
    short = short.join(patterns.where(F.length("pattern") < GRAM), "pattern")
    grams = texts.select("text", F.explode(pieces("text", GRAM)).alias("gram"))
    held = patterns.select("pattern", F.explode(pieces("pattern", GRAM)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text holds comes first, so that its pattern meets none
    rarest = held.join(often, "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    long = grams.join(rarest, "gram").where(F.contains("text", "pattern"))
    return short.select("text", "pattern").unionByName(long.select("text", "pattern"))


def rule_hits(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(model, name_rule, pattern) for each distinct name and each distinct pattern that fits it; rules of one pattern
    have the same names.

    All rules join by equality: prefix and suffix rules on every beginning and end of a name, the empty one included,
    ``contains`` rules as in ``containing``.
    """
    distinct = names.select("model").where("model is not null").distinct()
    rules = rules.select(*PATTERN).distinct()
    of = lambda rule: rules.where(F.col("name_rule") == rule)
    size = F.explode(F.sequence(F.lit(0), F.length("model")))
    sized = distinct.withColumn("size", size)
    begins = sized.withColumn("pattern", F.expr("left(model, size)")).drop("size")
    ends = sized.withColumn("pattern", F.expr("right(model, size)")).drop("size")
    found = distinct.withColumn("pattern", F.col("model")).join(of(EXACT), "pattern")
    for ends_of, rule in ((begins, PREFIX), (ends, SUFFIX)):
        found = found.unionByName(ends_of.join(of(rule), "pattern"))
    held = containing(distinct.select(F.col("model").alias("text")), of(CONTAINS)).withColumnRenamed("text", "model")
    return found.unionByName(held.withColumn("name_rule", F.lit(CONTAINS))).select("model", *PATTERN)


def resolve_metadata(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(model, rule_id, ...) of the rule row that describes each distinct name: exact, prefix, suffix, contains; then
    the lowest id."""
    order = F.element_at(F.create_map(*(F.lit(x) for p in PRECEDENCE.items() for x in p)), F.col("name_rule"))
    first = rules.groupBy(*PATTERN).agg(F.min_by(F.struct(*rules.columns), "id").alias("rule")).select("rule.*")
    hit = rule_hits(names, rules).join(first, PATTERN).withColumn("place", F.struct(order.alias("o"), F.col("id").alias("i")))
    return hit.groupBy("model").agg(F.min_by(F.struct(*rules.columns), "place").alias("rule")).select("model", F.col("rule.id").alias("rule_id"), "rule.*").drop("id")


def default_vendor(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(model, vendor): the longest pattern in the lower-cased name, then the first by alphabet; no row without one."""
    distinct = names.select("model", F.lower("model").alias("text")).distinct()
    lowered = patterns.withColumn("own", F.col("pattern")).withColumn("pattern", F.lower("pattern"))
    hit = containing(distinct, lowered).join(lowered, "pattern").join(distinct, "text")
    return hit.groupBy("model").agg(F.min_by("vendor", F.struct(-F.length("own"), "own")).alias("vendor"))


def enabled_abilities(abilities: DataFrame, channels: DataFrame) -> DataFrame:
    types = channels.select(F.col("id").alias("channel_id"), F.col("type").alias("channel_type"))
    return abilities.where("enabled").join(types, "channel_id", "left")


def connections(abilities: DataFrame, channels: DataFrame) -> DataFrame:
    """Models and the enabled channels that serve them, in order."""
    live = channels.where("status = 1").select(F.col("id").alias("channel_id"), "name", "type")
    return abilities.where("enabled").select("model", "channel_id").distinct().join(live, "channel_id").orderBy("model", "channel_id")


def missing_models(abilities: DataFrame, meta: DataFrame) -> DataFrame:
    return abilities.where("enabled").select("model").distinct().join(meta.select("model"), "model", "left_anti")


def preferred_owner(abilities: DataFrame, channels: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(model, channel_id, type): by priority (null is 0), weight, then the lowest channel, of enabled channels."""
    rows = abilities.where("enabled")
    if groups:
        rows = rows.where(F.col("group").isin(groups))
    rows = rows.join(channels.where("status = 1").select(F.col("id").alias("channel_id"), "type"), "channel_id")
    best = F.max_by(F.struct("channel_id", "type"), F.struct(F.coalesce("priority", F.lit(0)), "weight", -F.col("channel_id")))
    return rows.groupBy("model").agg(best.alias("best")).select("model", "best.channel_id", "best.type")


def split_list(column: str) -> Column:
    """Items of a comma-separated list: trimmed, not empty, first seen once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)), lambda x: x != ""))


def build_abilities(channels: DataFrame) -> DataFrame:
    """(group, model, channel_id, enabled, priority, weight): every model and group of each channel, once."""
    rows = channels.select(F.explode(split_list("models")).alias("model"), "groups", F.col("id").alias("channel_id"), (F.col("status") == 1).alias("enabled"), "priority", "weight")
    return rows.select(F.explode(split_list("groups")).alias("group"), "model", "channel_id", "enabled", "priority", "weight").dropDuplicates(["group", "model", "channel_id"])


def list_sets(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Union (first list's order first), difference and intersection of two lists, and changes where adding wins."""
    x, y = split_list(a), split_list(b)
    return rows.withColumns({"union": F.array_union(x, y), "difference": F.array_except(x, y), "intersection": F.array_intersect(x, y)})


def apply_changes(models: Column, add: Column, remove: Column) -> Column:
    """A list after additions and removals; a name in both is added."""
    return F.array_union(F.array_except(models, F.array_except(remove, add)), add)


def pending_changes(local: DataFrame, upstream: DataFrame, redirects: DataFrame, ignored: DataFrame) -> DataFrame:
    """(channel_id, model, change) between local and upstream models of channels.

    add: upstream models that are neither local, nor a redirect's target, nor ignored (literally or by `regex:`);
    remove: local models that upstream lacks and that no redirect starts from.
    """
    key = ["channel_id", "model"]
    targets, sources = (redirects.select("channel_id", F.col(c).alias("model")) for c in ("target", "source"))
    add = upstream.select(*key).distinct().join(local, key, "left_anti").join(targets, key, "left_anti")
    literal = ignored.where(~F.col("pattern").startswith("regex:")).select("channel_id", F.col("pattern").alias("model"))
    regex = ignored.where(F.col("pattern").startswith("regex:")).select(F.col("channel_id").alias("of"), F.expr("substring(pattern, 7)").alias("regex"))
    add = add.join(literal, key, "left_anti").join(regex, (F.col("channel_id") == F.col("of")) & F.expr("model rlike regex"), "left_anti")
    remove = local.select(*key).distinct().join(upstream, key, "left_anti").join(sources, key, "left_anti")
    return add.withColumn("change", F.lit("add")).unionByName(remove.withColumn("change", F.lit("remove")))


def effective_prices(prices: DataFrame) -> DataFrame:
    """One record a model: an expression drops numbers, a fixed price drops ratios, bad numbers go, empty records too.

    Columns: model, mode, expression and FIELDS.
    """
    good = {f: F.when((F.col(f) >= 0) & ~F.isnan(f) & (F.col(f) < float("inf")), F.col(f)) for f in FIELDS}
    tiered, text = F.coalesce(F.col("mode") == "tiered_expr", F.lit(False)), F.trim(F.coalesce("expression", F.lit("")))
    rows = prices.withColumns(good).withColumns({"tiered": tiered, "text": text})
    rows = rows.where(F.when(F.col("tiered"), F.col("text") != "").otherwise(F.col("model_price").isNotNull() | F.col("model_ratio").isNotNull()))
    fixed = F.col("model_price").isNotNull()
    out = {f: F.when(F.col("tiered") | (fixed if f != "model_price" else F.lit(False)), F.lit(None)).otherwise(F.col(f)) for f in FIELDS}
    return rows.select("model", F.when(F.col("tiered"), "tiered_expr").otherwise("ratio").alias("mode"), F.when(F.col("tiered"), F.col("text")).alias("expression"), *(c.alias(f) for f, c in out.items()))


def provider_ratios(costs: DataFrame) -> DataFrame:
    """(model, provider, model_ratio, completion_ratio, cache_ratio) of the cheapest provider with a cost above 0.

    Costs are USD per million: input, output, cache_read. Bad inputs, bad outputs and free input with paid output are
    out; equal inputs (1e-9) go to the first provider by name; ratios have 6 digits.
    """
    ok = lambda c: (F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    rows = costs.where(ok("input") & F.coalesce(ok("output"), F.lit(True)) & ~((F.col("input") == 0) & F.coalesce(F.col("output") > 0, F.lit(False))))
    least = F.min(F.when(F.col("input") > 0, F.col("input"))).over(Window.partitionBy("model"))
    rows = rows.withColumn("least", least).where(F.col("least").isNull() | ((F.col("input") > 0) & (F.abs(F.col("input") - F.col("least")) < TOLERANCE)))
    best = rows.groupBy("model").agg(F.min_by(F.struct("provider", "input", "output", "cache_read"), "provider").alias("best")).select("model", "best.*")
    over = lambda c: F.when(F.col("input") > 0, rounded(c / F.col("input"), 6))
    return best.select("model", "provider", rounded(F.col("input") * 500 / 1000, 6).alias("model_ratio"), over(F.col("output")).alias("completion_ratio"), over(F.when(ok("cache_read"), F.col("cache_read"))).alias("cache_ratio"))


def long_prices(prices: DataFrame, *keys: str) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS))
    return prices.select(*keys, F.inline(entries)).where("value is not null")


def price_differences(local: DataFrame, upstream: DataFrame) -> DataFrame:
    """(model, field, upstream, current, value, confident): how upstream prices differ from local ones.

    value: the upstream's as text, `same` within 1e-9 or where both lack it, null where only it lacks. confident is
    false where an upstream has the placeholder ratios 37.5 and 1. Fields without a difference, and upstreams without
    any, are left out.
    """
    names = upstream.select("upstream").distinct()
    l, u = long_prices(local, "model"), long_prices(upstream, "upstream", "model")
    fields = l.select("model", "field").unionAll(u.select("model", "field")).distinct()
    grid = fields.join(names, F.lit(True))  # every upstream answers for every field: the result's own size
    rows = grid.join(u, ["upstream", "model", "field"], "left").join(l.withColumnRenamed("value", "current"), ["model", "field"], "left")
    same = (F.col("value").isNull() & F.col("current").isNull()) | (F.abs(F.col("value") - F.col("current")) < TOLERANCE)
    rows = rows.withColumn("shown", F.when(F.coalesce(same, F.lit(False)), "same").when(F.col("value").isNotNull(), F.col("value").cast("string")))
    rows = rows.withColumn("differs", F.col("shown").isNotNull() & (F.col("shown") != "same"))
    rows = rows.withColumn("any", F.max("differs").over(Window.partitionBy("model", "field"))).where("any")
    rows = rows.withColumn("useful", F.max("differs").over(Window.partitionBy("upstream"))).where("useful")
    doubt = upstream.select("upstream", "model", ((F.abs(F.col("model_ratio") - 37.5) < TOLERANCE) & (F.abs(F.col("completion_ratio") - 1) < TOLERANCE)).alias("doubt"))
    out = rows.join(doubt, ["upstream", "model"], "left")
    return out.select("model", "field", "upstream", "current", F.col("shown").alias("value"), (~F.coalesce("doubt", F.lit(False))).alias("confident"))


def route_tiers(abilities: DataFrame) -> DataFrame:
    """Enabled routes with their tier: 0 for the highest priority of a group and model."""
    tier = F.dense_rank().over(Window.partitionBy("group", "model").orderBy(F.desc(F.coalesce("priority", F.lit(0))))) - 1
    return abilities.where("enabled").withColumn("tier", tier)


def tier_of_retry(tiers: DataFrame, retry: int) -> DataFrame:
    """Routes that attempt number ``retry`` uses: that tier, or the last."""
    last = F.max("tier").over(Window.partitionBy("group", "model"))
    return tiers.withColumn("last", last).where(F.col("tier") == F.least(F.lit(retry), F.col("last"))).drop("last")


def weight_shares(tiers: DataFrame, smoothing: int = 0) -> DataFrame:
    """Share of each route in its tier; equal if no route has weight. ``smoothing`` is added to every weight."""
    tier = Window.partitionBy("group", "model", "tier")
    w = F.col("weight") + smoothing
    return tiers.withColumn("share", F.when(F.sum(w).over(tier) > 0, w / F.sum(w).over(tier)).otherwise(1 / F.count("*").over(tier)))


def weighted_pick(requests: DataFrame, shares: DataFrame, draw: Column) -> DataFrame:
    """Requests with the first channel (by id) whose cumulative share exceeds the draw, from 0 to 1 exclusive; the last
    channel if rounding leaves none. Requests without a draw or a route are left out.

    A group and model has one row with its channels and cumulative shares as arrays, so a request meets one row, and
    halves the array until the channel is found.
    """
    listed = F.array_sort(F.collect_list(F.struct("channel_id", "share")))
    routes = shares.groupBy("group", "model").agg(listed.alias("listed"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("highs"))
    highs = F.aggregate("listed", start, lambda a, x: F.struct((a["sum"] + x["share"]).alias("sum"), F.concat(a["highs"], F.array(a["sum"] + x["share"])).alias("highs")), lambda a: a["highs"])
    routes = routes.select("group", "model", F.col("listed.channel_id").alias("__channels"), highs.alias("__highs"))
    rows = requests.withColumn("draw", draw).where("draw is not null").join(routes, ["group", "model"])

    def halved(a, _):
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        over = F.get("__highs", middle) > F.col("draw")
        busy = a["low"] < a["high"]
        return F.struct(F.when(busy & ~over, middle + 1).otherwise(a["low"]).alias("low"), F.when(busy & over, middle).otherwise(a["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size("__highs"))))
    ends = F.struct(F.lit(0).alias("low"), (F.size("__highs") - 1).alias("high"))
    place = F.aggregate(steps, ends, halved, lambda a: a["low"])
    return rows.withColumn("channel_id", F.get("__channels", place)).drop("__channels", "__highs")


def name_states(names: DataFrame, resolved: DataFrame, reachable: DataFrame) -> DataFrame:
    """(model, state): hidden if its metadata is not enabled, visible if reachable, else unavailable."""
    live = reachable.select("model").distinct().withColumn("live", F.lit(True))
    rows = names.select("model").distinct().join(resolved.select("model", "status"), "model", "left").join(live, "model", "left")
    return rows.select("model", F.when(F.col("status") != 1, "hidden").when(F.col("live"), "visible").otherwise("unavailable").alias("state"))


def rule_states(rules: DataFrame, states: DataFrame) -> DataFrame:
    """(id, matched, state) of each rule: hidden or visible if all its names are, partial if some are visible."""
    hit = rule_hits(states, rules).join(states, "model")
    counts = hit.groupBy(*PATTERN).agg(F.count("model").alias("matched"), F.count_if(F.col("state") == "visible").alias("visible"), F.count_if(F.col("state") == "hidden").alias("hidden"))
    counts = rules.select("id", "status", *PATTERN).join(counts, PATTERN, "left")
    matched = F.coalesce("matched", F.lit(0))
    empty = F.when(F.col("status") != 1, "hidden").otherwise("unavailable")
    state = F.when(matched == 0, empty).when(F.col("hidden") == matched, "hidden").when(F.col("visible") == matched, "visible").when(F.col("visible") > 0, "partial").otherwise("unavailable")
    return counts.select("id", matched.alias("matched"), state.alias("state"))


#: Ratios that a price list shows beside the model ratio.
RATIOS = ("cache_ratio", "creation_ratio", "image_ratio", "audio_ratio", "audio_completion_ratio")


def price_list(abilities: DataFrame, prices: DataFrame, meta: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(model, groups, endpoints, vendor, description, tags, price, ratio, completion_ratio, RATIOS, by_price) of enabled
    models whose metadata does not hide them.

    A model with a fixed price has no ratio and completion_ratio. ``prices``: model, model_price, model_ratio,
    completion_ratio and RATIOS; ``endpoints``: model, endpoints.
    """
    from meterlake.operators.pricing import DEFAULT_RATIO, with_completion_ratio
    from meterlake.operators.usage import groups_of_models

    rows = groups_of_models(abilities).join(prices.select("model", "model_price", "model_ratio", "completion_ratio", *RATIOS), "model", "left")
    rows = rows.join(meta.select("model", "vendor", "status", "description", "tags"), "model", "left").join(endpoints, "model", "left")
    rows = with_completion_ratio(rows.where(F.coalesce(F.col("status"), F.lit(1)) == 1), "model", F.col("completion_ratio"))
    free = F.col("model_price").isNull()
    return rows.select(
        "model", "groups", F.coalesce("endpoints", F.array().cast("array<string>")).alias("endpoints"), "vendor", "description", "tags", F.col("model_price").alias("price"),
        F.when(free, F.coalesce("model_ratio", F.lit(DEFAULT_RATIO))).alias("ratio"), F.when(free, F.col("ratio")).alias("completion_ratio"), *RATIOS, (~free).alias("by_price"),
    )


def search_catalog(catalog: DataFrame, keyword: str = "", vendor: str = "", group: str = "", by_price: bool | None = None, endpoint: str = "", tag: str = "", sort: str = "name") -> DataFrame:
    """Models of a price list: keyword (any case) in name, description, tags or vendor; the other filters are exact, a tag
    in any case. ``sort``: name, price or -price (fixed price or ratio), then name."""
    if keyword:
        found = F.lit(False)
        for c in ("model", "description", "tags", "vendor"):
            found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword.lower()))
        catalog = catalog.where(found)
    if vendor:
        catalog = catalog.where(F.col("vendor") == vendor)
    for column, value in (("groups", group), ("endpoints", endpoint)):
        if value:
            catalog = catalog.where(F.array_contains(column, value))
    if tag:
        catalog = catalog.where(F.array_contains(F.transform(F.split(F.lower("tags"), TAG_BREAK), lambda t: F.trim(t)), tag.lower()))
    if by_price is not None:
        catalog = catalog.where(F.col("by_price") == by_price)
    price = F.when(F.col("by_price"), F.coalesce("price", F.lit(0.0))).otherwise(F.col("ratio"))
    return catalog.orderBy(*{"price": [price.asc()], "-price": [price.desc()]}.get(sort, []), "model")


#: Fixed value: what separates tags.
TAG_BREAK = r"[,;|\s]+"


def distinct_tags(rows: DataFrame, column: str) -> DataFrame:
    """All tags of texts like `a, b;c|d e`, lower-cased, once each."""
    tags = rows.select(F.explode(F.split(F.lower(column), TAG_BREAK)).alias("tag"))
    return tags.select(F.trim("tag").alias("tag")).where("tag != ''").distinct()


def enriched_rules(rules: DataFrame, abilities: DataFrame, channels: DataFrame, catalog: DataFrame) -> DataFrame:
    """(id, names, matched, groups, bound_channels, endpoints, quota_types, configured_channels) of each rule.

    Matched are names that enabled channels serve; exact rules list none. bound_channels: (name, type) of those
    channels; quota_types: 1 for a fixed price, 0 for ratios. configured_channels counts all channels, disabled ones
    included, that list a matching name. ``catalog``: model, endpoints, by_price. Sets are gathered a distinct name
    first, and sorted.
    """
    live = channels.where("status = 1").select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), F.col("type").alias("channel_type"))
    served = abilities.where("enabled").join(live, "channel_id").groupBy("model").agg(
        F.collect_set("group").alias("groups"), F.collect_set(F.struct("channel_id", F.col("channel_name").alias("name"), F.col("channel_type").alias("type"))).alias("channels"))
    quota = F.when(F.col("by_price"), 1).when(F.col("by_price").isNotNull(), 0)
    served = served.join(catalog.select("model", "endpoints", quota.alias("quota_type")), "model", "left")
    hit = rule_hits(served, rules).join(served, "model")
    merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    listed = F.col("name_rule") != EXACT
    found = hit.groupBy(*PATTERN).agg(
        F.collect_set("model").alias("all_names"), merged("groups").alias("groups"), merged("channels").alias("channels"), merged("endpoints").alias("endpoints"), F.collect_set("quota_type").alias("quota_types"))
    configured = channels.select(F.explode(split_list("models")).alias("model"), F.col("id").alias("channel_id"))
    counts = rule_hits(configured, rules).join(configured, "model").groupBy(*PATTERN).agg(F.count_distinct("channel_id").alias("configured_channels"))
    bound = F.array_sort(F.transform("channels", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"))))
    columns = {"names": F.when(listed, F.array_sort("all_names")), "bound_channels": bound, **{c: F.array_sort(c) for c in ("groups", "endpoints", "quota_types")}}
    found = found.select(*PATTERN, *(c.alias(k) for k, c in columns.items()))
    out = rules.select("id", *PATTERN).join(found, PATTERN, "left").join(counts, PATTERN, "left")
    filled = {k: F.coalesce(k, F.array().cast(found.schema[k].dataType)) for k in columns}
    return out.select("id", *(c.alias(k) for k, c in filled.items()), F.size(filled["names"]).cast("bigint").alias("matched"), F.coalesce("configured_channels", F.lit(0)).alias("configured_channels"))
