"""Usage cubes and totals over request logs. One grouped aggregate each, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlake.functions.scalars import INT64_MAX, INT64_MIN, ratio, rounded

CUBE_KEY = ["user_id", "username", "model_name", "created_at", "use_group", "token_id", "channel_id", "node_name"]
MEASURES = ["count", "quota", "token_used"]


def hour(column: str = "created_at") -> Column:
    return F.col(column) - F.col(column) % 3600


def bucket(size: int, column: str = "created_at") -> Column:
    """Epoch-aligned bucket; a size of 0 or less means an hour."""
    size = size if size > 0 else 3600
    return F.expr(f"`{column}` div {size} * {size}")


def hourly_cube(logs: DataFrame, node: str = "", task_billing: Column | None = None) -> DataFrame:
    """Consume logs by hour and the eight business keys: count, quota, token_used (0 for task billing rows)."""
    used = F.col("prompt_tokens") + F.col("completion_tokens")
    used = used if task_billing is None else F.when(task_billing, F.lit(0)).otherwise(used)
    rows = logs.where("type = 2").select("user_id", "username", "model_name", hour().alias("created_at"), F.col("group").alias("use_group"), "token_id", "channel_id", F.lit(node).alias("node_name"), "quota", used.alias("used"))
    return rows.groupBy(*CUBE_KEY).agg(F.count("*").alias("count"), F.sum("quota").alias("quota"), F.sum("used").alias("token_used"))


def dedupe_cube(cube: DataFrame) -> DataFrame:
    """One row a business key: nulls in keys count as 0 or '', the least id stays, measures are added."""
    text = {"username", "model_name", "use_group", "node_name"}
    keys = [F.coalesce(F.col(k), F.lit("") if k in text else F.lit(0)).alias(k) for k in CUBE_KEY]
    return cube.groupBy(*keys).agg(F.min("id").alias("id"), *(F.sum(m).alias(m) for m in MEASURES))


def usage_by(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(*(F.sum(m).alias(m) for m in MEASURES))


def usage_levels(cube: DataFrame) -> DataFrame:
    """User and hour, model and hour, hour, and total in one pass; level is Spark's grouping id."""
    sets = [["username", "created_at"], ["model_name", "created_at"], ["created_at"], []]
    grouped = cube.groupingSets(sets, "username", "model_name", "created_at")
    return grouped.agg(F.grouping_id().cast("bigint").alias("level"), *(F.sum(m).alias(m) for m in MEASURES))


def log_stat(logs: DataFrame, now: int, start: int, end: int) -> DataFrame:
    """Quota of consume rows in [start, end]; requests and tokens of the last 60 seconds, whatever the window."""
    last = F.col("created_at") >= now - 60
    inside = (F.col("created_at") >= start) & (F.col("created_at") <= end)
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    rows = logs.where("type = 2").where(inside | last)
    return rows.agg(F.coalesce(F.sum(F.when(inside, F.col("quota"))), F.lit(0)).alias("quota"), F.count_if(last).alias("rpm"), F.coalesce(F.sum(F.when(last, tokens)), F.lit(0)).alias("tpm"))


def token_total(logs: DataFrame, start: int, end: int) -> DataFrame:
    rows = logs.where((F.col("type") == 2) & F.col("created_at").between(start, end))
    return rows.agg(F.coalesce(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")), F.lit(0)).alias("tokens"))


def dashboard(cube: DataFrame, start: int, end: int) -> DataFrame:
    """Totals and their averages a minute, at 3 digits; 0 for an empty window."""
    minutes = F.lit((end - start) / 60.0)
    totals = cube.where(F.col("created_at").between(start, end)).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES))
    return totals.select(*MEASURES, rounded(ratio(F.col("count"), minutes), 3).alias("avg_rpm"), rounded(ratio(F.col("token_used"), minutes), 3).alias("avg_tpm"))


#: Keys of the flow cube that each role sees.
FLOW_KEYS = {
    "root": ["user_id", "username", "node_name", "token_id", "use_group", "model_name", "channel_id"],
    "admin": ["user_id", "username", "use_group", "model_name", "channel_id"],
    "self": ["token_id", "use_group", "model_name"],
}


def flow_cube(cube: DataFrame, role: str, start: int, end: int, user_id: int | None = None, username: str = "") -> DataFrame:
    """Cube rows with a group, by the keys of a role, largest quota first."""
    rows = cube.where(F.col("created_at").between(start, end) & (F.col("use_group") != ""))
    if role == "self":
        rows = rows.where(F.col("user_id") == user_id)
    elif username:
        rows = rows.where(F.col("username") == username)
    return rows.groupBy(*FLOW_KEYS[role]).agg(*(F.sum(m).alias(m) for m in MEASURES)).orderBy(F.desc("quota"), *FLOW_KEYS[role])


def model_totals(cube: DataFrame, start: int, end: int) -> DataFrame:
    rows = cube.where(F.col("created_at").between(start, end) & (F.col("model_name") != ""))
    return rows.groupBy("model_name").agg(F.sum("token_used").alias("tokens")).where("tokens > 0").orderBy(F.desc("tokens"), "model_name")


def model_buckets(cube: DataFrame, start: int, end: int, size: int) -> DataFrame:
    rows = cube.where(F.col("created_at").between(start, end) & (F.col("model_name") != ""))
    return rows.groupBy("model_name", bucket(size).alias("bucket")).agg(F.sum("token_used").alias("tokens")).where("tokens > 0")


def newest_by_type(rows: DataFrame, *values: str) -> DataFrame:
    """The row of the largest and the least id of each type, without sorting."""
    picked = [f(F.struct(*values), F.col("id")).alias(n) for n, f in (("last", F.max_by), ("first", F.min_by))]
    out = rows.groupBy("type").agg(F.max("id").alias("last_id"), F.min("id").alias("first_id"), *picked)
    return out.select("type", "last_id", "first_id", *(F.col(f"{n}.{v}").alias(f"{n}_{v}") for n in ("last", "first") for v in values))


def last_access(audits: DataFrame) -> DataFrame:
    """Time and address of the latest access by (user, token_ref), ties to the larger event id."""
    rows = audits.where("category = 'access_token'")
    latest = F.max_by(F.struct("created_at", "ip"), F.struct("created_at", "event_id")).alias("at")
    return rows.groupBy("user_id", "token_ref").agg(latest).select("user_id", "token_ref", F.col("at.created_at").alias("last_at"), F.col("at.ip").alias("last_ip"))


def checkin_stats(checkins: DataFrame, month: str, today: str) -> DataFrame:
    """By user: check-ins of the month, all check-ins, all quota, and whether one is today; dates are text."""
    inside = F.col("checkin_date").between(f"{month}-01", f"{month}-31")
    return checkins.groupBy("user_id").agg(F.count_if(inside).alias("month_count"), F.count("*").alias("total_count"), F.sum("quota").alias("total_quota"), F.max(F.col("checkin_date") == today).alias("checked_today"))


def net_deltas(deltas: DataFrame) -> DataFrame:
    """Counter deltas netted by (kind, id), the exact total clamped to int64."""
    total = F.sum(F.col("delta").cast("decimal(38,0)"))
    return deltas.groupBy("kind", "id").agg(F.greatest(F.lit(INT64_MIN).cast("decimal(38,0)"), F.least(F.lit(INT64_MAX).cast("decimal(38,0)"), total)).cast("bigint").alias("delta"))


def probe_latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(rounded(F.avg(value), 3).alias("mean"), rounded(F.stddev_pop(value), 3).alias("deviation"), F.count("*").alias("probes"))


def models_of_groups(abilities: DataFrame) -> DataFrame:
    return abilities.where("enabled").select("group", "model").distinct()


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, bits: int = 15) -> DataFrame:
    """(keys, created_at, sketch): a sketch of the distinct values of each hour, to be stored with the hourly rows.

    A sketch has at most 2**bits bytes, and few values take few. Nulls are not counted.
    """
    return rows.groupBy(*keys, hour().alias("created_at")).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def distinct_counts(sketches: DataFrame, keys: list[Column | str]) -> DataFrame:
    """(keys, total): distinct values over all hours of each key, from sketches merged where they lie first; the standard
    error is 0.6 % for 15 bits."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("total"))


def groups_of_models(abilities: DataFrame) -> DataFrame:
    return abilities.where("enabled").groupBy("model").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def endpoints_of_models(abilities: DataFrame, channels: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(model, endpoints): endpoint types of the channels that serve a model, each once, the preferred one first.

    ``endpoints``: channel_type, position, endpoint. They come in the order of the lowest channel, then position.
    """
    types = channels.select(F.col("id").alias("channel_id"), F.col("type").alias("channel_type"))
    served = abilities.where("enabled").select("model", "channel_id").distinct().join(types, "channel_id").join(endpoints, "channel_type")
    first = served.groupBy("model", "endpoint").agg(F.min(F.struct("channel_id", "position")).alias("place"))
    listed = F.array_sort(F.collect_list(F.struct("place", "endpoint")))
    return first.groupBy("model").agg(F.transform(listed, lambda x: x["endpoint"]).alias("endpoints"))


def channels_by_type(channels: DataFrame) -> DataFrame:
    """(type, channels, tags): channels and distinct tags that are not empty."""
    return channels.groupBy("type").agg(F.count("*").alias("channels"), F.count_distinct(F.nullif(F.col("tag"), F.lit(""))).alias("tags"))


def models_of_vendors(models: DataFrame, vendors: DataFrame) -> DataFrame:
    """(vendor_id, models) of every vendor, 0 for those without models."""
    counts = models.groupBy("vendor_id").agg(F.count("*").alias("models"))
    return vendors.select(F.col("id").alias("vendor_id")).join(counts, "vendor_id", "left").select("vendor_id", F.coalesce("models", F.lit(0)).alias("models"))


def upsert_add(state: DataFrame, delta: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The counter table after adding deltas: existing and new rows are summed by key."""
    return state.unionByName(delta).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))
