"""Detection of abusive tokens against their own baselines of earlier windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterlake.functions.scalars import ratio
from meterlake.operators.logs import saturated


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the detection."""

    window: int = 600
    baseline: int = 6
    gate_windows: int = 3
    gate_requests: int = 10
    consume_ratio: float = 5.0
    request_ratio: float = 5.0
    error_ratio: float = 3.0
    least_quota: int = 500_000
    least_requests: int = 50
    least_errors: int = 20
    lookback: int = 86_400
    most_span: int = 1_440 * 60


RULES = ("consume_spike", "request_spike", "error_rate_spike")


def bounds(now: int, s: Settings = Settings()) -> tuple[int, int, int, int]:
    """(baseline start, current start, current end, lookback start): the current window is the last complete one."""
    end = now // s.window * s.window
    current = end - s.window
    first = current - s.baseline * s.window
    lookback = min(max(s.lookback, end - first), s.most_span)
    return first, current, end, end - lookback


def window_counts(logs: DataFrame, start: int, end: int, window: int) -> DataFrame:
    """Requests, consumes, quota, errors and saturated rows of each token and window in [start, end)."""
    rows = logs.where((F.col("token_id") > 0) & (F.col("created_at") >= start) & (F.col("created_at") < end))
    consume, clamp = F.col("type") == 2, (F.col("type") == 2) & saturated()
    return rows.groupBy("token_id", F.expr(f"created_at div {window} * {window}").alias("bucket")).agg(
        F.count("*").alias("requests"), F.count_if(consume).alias("consumes"), F.coalesce(F.sum(F.when(consume, F.col("quota"))), F.lit(0)).alias("quota"),
        F.count_if(F.col("type") == 5).alias("errors"), F.count_if(clamp).alias("saturated_rows"), F.coalesce(F.sum(F.when(clamp, F.col("quota"))), F.lit(0)).alias("saturated_quota"))


def baselines(counts: DataFrame, first: int, current: int, s: Settings = Settings()) -> DataFrame:
    """One row a token: dense baseline arrays (missing windows 0), their medians, the gate, and the current window.

    A token has ``baseline`` windows at most, so its arrays are bounded.
    """
    spend = F.col("quota") - F.col("saturated_quota")
    before = F.col("bucket") < current
    now = lambda c: F.coalesce(F.sum(F.when(~before, c)), F.lit(0))
    filled = F.map_from_entries(F.collect_list(F.when(before, F.struct("bucket", F.struct(F.col("requests").alias("r"), spend.alias("q"))))))
    rows = counts.groupBy("token_id").agg(
        filled.alias("windows"), now(F.col("requests")).alias("requests"), now(spend).alias("quota"), now(F.col("consumes")).alias("consumes"), now(F.col("errors")).alias("errors"),
        F.coalesce(F.sum(F.when(before, F.col("consumes"))), F.lit(0)).alias("base_consumes"), F.coalesce(F.sum(F.when(before, F.col("errors"))), F.lit(0)).alias("base_errors"), F.sum("saturated_rows").alias("excluded_rows"))
    spine = F.array(*(F.lit(first + k * s.window).cast("bigint") for k in range(s.baseline)))
    dense = lambda of: F.transform(spine, lambda b: F.coalesce(F.try_element_at(F.col("windows"), b)[of], F.lit(0)))
    return measured(rows.withColumns({"base_requests": dense("r"), "base_quota": dense("q")}).drop("windows"), s)


def measured(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds the medians of base_requests and base_quota, and whether too few baseline windows had requests."""
    passed = F.size(F.filter("base_requests", lambda r: r >= s.gate_requests)) >= s.gate_windows
    return rows.withColumns({"median_requests": median(F.col("base_requests")), "median_quota": median(F.col("base_quota")), "gated": ~passed})


def median(values):
    """Exact median of an array; the mean of the middle two for an even length."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.try_element_at(ordered, k.cast("int")).cast("double")
    return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2


def spikes(s: Settings = Settings()) -> Column:
    """Array of (rule, severity, current, baseline): the window rules that a row of ``baselines`` breaks."""
    rate, base = ratio(F.col("errors"), F.col("consumes") + F.col("errors")), ratio(F.col("base_errors"), F.col("base_consumes") + F.col("base_errors"))
    rules = [
        ("consume_spike", "high", F.col("quota").cast("double"), F.col("median_quota"), (F.col("quota") >= s.consume_ratio * F.col("median_quota")) & (F.col("quota") >= s.least_quota)),
        ("request_spike", "medium", F.col("requests").cast("double"), F.col("median_requests"), (F.col("requests") >= s.request_ratio * F.col("median_requests")) & (F.col("requests") >= s.least_requests)),
        ("error_rate_spike", "high", rate, base, (F.col("base_errors") > 0) & (rate >= s.error_ratio * base) & (F.col("errors") >= s.least_errors)),
    ]
    each = (F.when(hit & ~F.col("gated"), F.struct(F.lit(n).alias("rule"), F.lit(v).alias("severity"), now.alias("current"), then.alias("baseline"))) for n, v, now, then, hit in rules)
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def spike_findings(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(token_id, rule, severity, current, baseline, ratio, direction, excluded_rows) of the window rules."""
    hits = rows.select("token_id", "excluded_rows", F.inline(spikes(s)))
    return hits.select("token_id", "rule", "severity", "current", "baseline", ratio(F.col("current"), F.col("baseline")).alias("ratio"), F.lit("up").alias("direction"), "excluded_rows")


def skips(rows: DataFrame) -> DataFrame:
    """(token_id, rule, reason): all window rules of a gated token, the error rule of one without baseline errors."""
    which = F.when(F.col("gated"), F.array(*map(F.lit, RULES))).when(F.col("base_errors") == 0, F.array(F.lit("error_rate_spike")))
    return rows.select("token_id", F.explode(which).alias("rule"), F.lit("insufficient_baseline").alias("reason"))


def new_models(logs: DataFrame, lookback: int, current: int, end: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(findings, skips) of models that a token first used in the current window, by its requests in the lookback."""
    rows = logs.where((F.col("token_id") > 0) & (F.col("model_name") != "") & (F.col("created_at") >= lookback) & (F.col("created_at") < end))
    first = rows.groupBy("token_id", "model_name").agg(F.min("created_at").alias("first_at"), F.count("*").alias("n"))
    first = first.withColumn("requests", F.sum("n").over(Window.partitionBy("token_id"))).where(F.col("first_at") >= current)
    findings = first.where(F.col("requests") >= least).select("token_id", "model_name", F.lit("new_model").alias("rule"), F.lit("medium").alias("severity"), "first_at")
    return findings, first.where(F.col("requests") < least).select("token_id", F.lit("new_model").alias("rule"), F.lit("insufficient_baseline").alias("reason")).distinct()


def detect(logs: DataFrame, now: int, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(findings, skips) of every rule, findings in order of severity, rule and token."""
    first, current, end, lookback = bounds(now, s)
    rows = baselines(window_counts(logs, first, end, s.window), first, current, s)
    fresh, fresh_skips = new_models(logs, lookback, current, end, s.gate_requests)
    found = spike_findings(rows, s).unionByName(fresh.withColumns({"direction": F.lit("new")}), allowMissingColumns=True)
    return found.orderBy(F.col("severity") != "high", "rule", "token_id", "model_name"), skips(rows).unionByName(fresh_skips)


def readiness(logs: DataFrame, now: int, s: Settings = Settings()) -> DataFrame:
    """Whether the earliest log is old enough for a baseline, else when it will be."""
    need = s.baseline * s.window
    return logs.agg(F.min("created_at").alias("earliest")).select("earliest", F.coalesce(F.col("earliest") <= now - need, F.lit(False)).alias("ready"), F.when(F.col("earliest") > now - need, F.col("earliest") + need).alias("ready_at"))
