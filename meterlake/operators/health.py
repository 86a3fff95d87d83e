"""Health and performance: outcome classes, samples, bucket counters, summaries and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meterlake.functions.scalars import ratio, rounded

#: Codes and types of upstream errors that count against health, or say nothing about it.
LOCAL_IGNORED = ("invalid_request", "sensitive_words_detected", "read_request_body_failed", "convert_request_failed", "access_denied", "bad_request_body", "insufficient_user_quota", "pre_consume_token_quota_failed", "prompt_blocked")
FAILURES = (
    "invalid_api_key", "api_key_invalid", "api_key_expired", "api_key_service_blocked", "invalid_authentication", "authentication_error", "unauthenticated", "permission_denied", "permission_error", "access_denied",
    "insufficient_quota", "quota_exceeded", "resource_exhausted", "rate_limit_exceeded", "rate_limit_error", "overloaded_error", "server_error", "internal_error", "service_unavailable", "model_not_found",
    "insufficient_user_quota", "pre_consume_token_quota_failed",
)
IGNORED = ("context_length_exceeded", "invalid_request", "invalid_request_error", "invalid_argument", "sensitive_words_detected", "prompt_blocked", "content_filter", "content_policy_violation", "safety")
IGNORED_STATUS = (400, 405, 409, 413, 415, 422)
SUCCESSFUL_ENDS, REFUSED_ENDS = ("max_output_tokens", "max_tokens"), ("content_filter", "safety", "content_policy_violation")
FAILED_STREAMS = ("timeout", "scanner_error", "panic")
COUNTERS = ["request_count", "success_count", "total_latency_ms", "ttft_sum_ms", "ttft_count", "output_tokens", "generation_ms"]


def error_outcome(local: Column, code: Column, kind: Column, status: Column) -> Column:
    """failure or ignored for an error; a specific code decides before a broad type, and both before the status."""
    code, kind = F.lower(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    own = F.when(code.startswith("violation_fee.") | code.isin(*LOCAL_IGNORED), "ignored").otherwise("failure")
    upstream = F.when(F.lit(False), "")
    for value in (code, kind):
        upstream = upstream.when(value.isin(*FAILURES), "failure").when(value.isin(*IGNORED) | value.startswith("violation_fee."), "ignored")
    upstream = upstream.when(status.isin(*IGNORED_STATUS), "ignored").otherwise("failure")
    return F.when(local, own).otherwise(upstream)


def outcome() -> Column:
    """success, failure or ignored of one relay.

    Columns: business_rejection, cancelled, has_error, error_local, error_code, error_type, error_status, response
    (failed, cancelled, incomplete, completed, unknown), incomplete_reason, end_reason, has_stream_errors,
    deadline_exceeded, expects_terminal. Cancellation comes before errors, errors before the stream's end.
    """
    error = error_outcome(F.col("error_local") & (F.col("response") != "failed"), F.col("error_code"), F.col("error_type"), F.col("error_status"))
    incomplete = F.when(F.col("incomplete_reason").isin(*SUCCESSFUL_ENDS), "success").when(F.col("incomplete_reason").isin(*REFUSED_ENDS), "ignored").otherwise("failure")
    return (
        F.when(F.col("business_rejection") | F.col("cancelled"), "ignored")
        .when((F.col("response") == "failed") | F.col("has_error"), error)
        .when((F.col("response") == "cancelled") | (F.col("end_reason") == "ping_fail"), "ignored")
        .when((F.col("end_reason") == "client_gone") & ~F.col("deadline_exceeded"), "ignored")
        .when(F.col("response") == "incomplete", incomplete)
        .when(F.col("has_stream_errors") | F.col("deadline_exceeded") | F.col("end_reason").isin(*FAILED_STREAMS), "failure")
        .when(F.col("expects_terminal") & (F.col("response") == "unknown") & (F.col("end_reason") != "done"), "failure")
        .otherwise("success")
    )


def relay_samples(relays: DataFrame) -> DataFrame:
    """Samples of relays with start_ms, first_ms (0: no response), end_ms; ignored outcomes give none."""
    rows = relays.withColumn("outcome", outcome()).where("outcome != 'ignored'")
    has = F.col("is_stream") & (F.col("first_ms") > 0)
    latency = F.col("end_ms") - F.col("start_ms")
    generation = F.when(has, F.col("end_ms") - F.col("first_ms")).otherwise(latency)
    return rows.select("model", "group", "ts", latency.alias("latency_ms"), F.when(has, F.col("first_ms") - F.col("start_ms")).otherwise(0).alias("ttft_ms"), has.alias("has_ttft"),
                       (F.col("outcome") == "success").alias("success"), "output_tokens", F.when(generation <= 0, latency).otherwise(generation).alias("generation_ms"))


def task_samples(tasks: DataFrame, now: int) -> DataFrame:
    """Samples of finished tasks: latency from submission, tokens only on success over a positive span."""
    end = F.when(F.col("finish_time") > 0, F.col("finish_time")).otherwise(F.lit(now))
    begin = F.coalesce(F.nullif(F.col("start_time"), F.lit(0)), F.col("submit_time"))
    tokens = F.coalesce(F.nullif(F.col("total_tokens"), F.lit(0)), F.col("completion_tokens"), F.lit(0))
    latency = F.when((F.col("submit_time") > 0) & (end > F.col("submit_time")), (end - F.col("submit_time")) * 1000).otherwise(0)
    success = F.col("status") == "SUCCESS"
    timed = success & (tokens > 0) & (begin > 0) & (end > begin)
    return tasks.select(F.col("model_name").alias("model"), F.col("group"), end.alias("ts"), latency.alias("latency_ms"), F.lit(0).alias("ttft_ms"), F.lit(False).alias("has_ttft"), success.alias("success"),
                        F.when(timed, tokens).otherwise(0).alias("output_tokens"), F.when(timed, (end - begin) * 1000).otherwise(0).alias("generation_ms"))


def bucket_counters(samples: DataFrame, size: int = 60) -> DataFrame:
    """Counters by model, group and bucket; only usable parts of a sample are added."""
    ttft, timed = F.col("has_ttft") & (F.col("ttft_ms") >= 0), (F.col("output_tokens") > 0) & (F.col("generation_ms") > 0)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    group = F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("default"))
    return samples.where("model != ''").groupBy(F.col("model").alias("model_name"), group.alias("group"), F.expr(f"ts - ts % {size}").alias("bucket_ts")).agg(
        F.count("*").alias("request_count"), F.count_if("success").alias("success_count"), total(F.col("latency_ms") > 0, "latency_ms").alias("total_latency_ms"),
        total(ttft, "ttft_ms").alias("ttft_sum_ms"), F.count_if(ttft).alias("ttft_count"), total(timed, "output_tokens").alias("output_tokens"), total(timed, "generation_ms").alias("generation_ms"))


def rates() -> list[Column]:
    """Average latency (whole ms), success per cent, tokens a second and average ttft of summed counters; 0 if empty."""
    whole = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} div {b}")).otherwise(F.lit(0))
    return [
        whole("total_latency_ms", "request_count").alias("avg_latency_ms"),
        rounded(ratio(F.col("success_count") * 100, F.col("request_count")), 2).alias("success_rate"),
        rounded(ratio(F.col("output_tokens") * 1000, F.col("generation_ms")), 2).alias("tps"),
        whole("ttft_sum_ms", "ttft_count").alias("avg_ttft_ms"),
    ]


def _chosen(counters: DataFrame, start: int, end: int, groups: list[str] | None) -> DataFrame:
    rows = counters.where(F.col("bucket_ts").between(start, end))
    return rows if groups is None else rows.where(F.col("group").isin(groups) if groups else F.lit(False))


def summed(counters: DataFrame, *keys) -> DataFrame:
    return counters.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTERS))


def hourly_success(counters: DataFrame, *keys: str) -> DataFrame:
    """Success per cent by hour, from summed counters of finer buckets: never a mean of rates."""
    return summed(counters, *keys, F.expr("bucket_ts - bucket_ts % 3600").alias("hour")).select(*keys, "hour", *rates()[1:2])


def model_summaries(counters: DataFrame, start: int, end: int, groups: list[str] | None = None) -> DataFrame:
    """One row a model, most requests first, with its hourly success series. No groups: nothing; None: all."""
    rows = _chosen(counters, start, end, groups)
    hours = summed(rows, "model_name", F.expr("bucket_ts - bucket_ts % 3600").alias("hour"))
    point = F.struct("hour", rounded(ratio(F.col("success_count") * 100, F.col("request_count")), 2).alias("success_rate"))
    total = hours.groupBy("model_name").agg(*(F.sum(c).alias(c) for c in COUNTERS), F.array_sort(F.collect_list(point)).alias("series"))  # 720 hours at most
    return total.select("model_name", "request_count", *rates(), "series").orderBy(F.desc("request_count"), "model_name")


def model_detail(counters: DataFrame, model: str, start: int, end: int) -> DataFrame:
    """Series and totals of one model in one pass: by group and bucket, by bucket, by group, and overall (nulls)."""
    rows = _chosen(counters, start, end, None).where(F.col("model_name") == model)
    sets = rows.groupingSets([["group", "bucket_ts"], ["bucket_ts"], ["group"], []], "group", "bucket_ts")
    return sets.agg(*(F.sum(c).alias(c) for c in COUNTERS)).select("group", "bucket_ts", "request_count", *rates())


def overall(counters: DataFrame, start: int, end: int) -> DataFrame:
    """One row of all models; its rates are null without samples."""
    total = _chosen(counters, start, end, None).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))
    total = total.select("request_count", *rates())
    return total.select("request_count", *(F.when(F.col("request_count") > 0, F.col(c)).alias(c) for c in total.columns[1:]))


def response_class() -> Column:
    """fast, medium or slow: by seconds for under 100 tokens or no time, else by tokens a second."""
    seconds, speed = F.col("use_time"), ratio(F.col("completion_tokens"), F.col("use_time"))
    by_time = F.when(seconds < 10, "fast").when(seconds < 30, "medium").otherwise("slow")
    return F.when((F.col("completion_tokens") < 100) | (seconds <= 0), by_time).when(speed >= 30, "fast").when(speed >= 15, "medium").otherwise("slow")


def first_token_class(seconds: Column) -> Column:
    return F.when(seconds < 5, "fast").when(seconds < 10, "medium").otherwise("slow")


def success_grade(rate: Column) -> Column:
    return F.when(rate.isNull() | F.isnan(rate), "unknown").when(rate >= 100, "excellent").when(rate >= 90, "good").when(rate >= 70, "warning").otherwise("critical")


def uptime(series: DataFrame, *keys: str) -> DataFrame:
    """Mean of success clamped to 0-100 at 2 digits, buckets, and incidents (buckets under 100)."""
    level = rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("success_rate"))), 2)
    return series.groupBy(*keys).agg(F.count("*").alias("buckets"), F.count_if(level < 100).alias("incidents"), F.min(level).alias("worst"))


def model_mismatch(requested: Column, upstream: Column, returned: Column) -> Column:
    """Whether a returned name neither starts nor ends with the requested or upstream one; empty names don't count."""
    got, names = F.lower(returned), [F.lower(requested), F.lower(upstream)]
    fits = F.lit(False)
    for n in names:
        fits = fits | ((n != "") & (got.startswith(n) | got.endswith(n)))
    return F.coalesce((got != "") & ((names[0] != "") | (names[1] != "")) & ~fits, F.lit(False))
