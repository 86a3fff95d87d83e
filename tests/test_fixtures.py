"""Exact values for operators whose semantics have corners."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.functions import scalars as X
from meterlake.operators import abuse, flow, health, logs, models, pricing, settlement, texts, usage
from meterlake.sources import logs as source
from meterlake.streaming import jobs


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


# abuse detection: one token a behaviour
BASE, W = 1_700_000_400 // 600 * 600, 600


def token_rows(token, baseline, current, model="gpt-4o", other="{}"):
    """baseline, current: lists of (count, type, quota) a window."""
    rows = []
    for window in range(7):
        for count, kind, quota in current if window == 6 else baseline:
            rows += [(token, BASE + window * W + i * W // max(count, 1), kind, quota, model, other) for i in range(count)]
    return rows


@pytest.fixture(scope="module")
def detected(spark):
    steady = [(10, 2, 1000)]
    mark = json.dumps({"admin_info": {"quota_saturation": {"clamped": True}}}).replace(": ", ":")
    rows = token_rows(9001, steady, steady) + token_rows(9002, steady, [(10, 2, 200_000)]) + token_rows(9003, steady, [(200, 2, 1000)])
    rows += token_rows(9004, [(100, 2, 1000), (1, 5, 0)], [(40, 2, 1000), (20, 5, 0)])
    rows += token_rows(9005, steady, steady) + [(9005, BASE + 6 * W + 7, 2, 1000, "zzz-new", "{}")]
    rows += [(9006, BASE + 6 * W + 5, 2, 1000, "gpt-4o", "{}")]
    rows += token_rows(9007, steady, []) + [(9007, BASE + 6 * W + i, 2, 2147483647, "gpt-4o", mark) for i in range(10)]
    rows += token_rows(9008, [], [(5, 2, 1000)])
    rows += token_rows(9009, [(10, 2, 100_000)], [(10, 2, 300_000)])
    rows += token_rows(9010, steady, [(10, 2, 200_000)], other='{"request_path":"/quota_saturation"}')
    rows += token_rows(9011, steady, steady) + token_rows(9012, [(100, 2, 1000)], [(100, 2, 1000), (25, 5, 0)])
    frame = spark.createDataFrame(rows, "token_id int, created_at bigint, type int, quota bigint, model_name string, other string")
    findings, skips = abuse.detect(frame, BASE + 7 * W + 30)
    return findings.collect(), skips.collect()


def test_abuse_findings(detected):
    found = {(r["token_id"], r["rule"]): r for r in detected[0]}
    assert set(found) == {(9002, "consume_spike"), (9003, "request_spike"), (9004, "error_rate_spike"), (9005, "new_model"), (9010, "consume_spike")}
    assert found[9002, "consume_spike"]["ratio"] == pytest.approx(200) and found[9002, "consume_spike"]["direction"] == "up"


def test_abuse_skips(detected):
    skipped = {}
    for r in detected[1]:
        skipped.setdefault(r["token_id"], set()).add(r["rule"])
    window = {"consume_spike", "request_spike", "error_rate_spike"}
    assert skipped[9006] == window | {"new_model"} and window <= skipped[9008]
    assert skipped[9011] == skipped[9012] == {"error_rate_spike"} and 9004 not in skipped


def test_abuse_excludes_saturated_rows(spark):
    mark = '{"admin_info":{"quota_saturation":{"clamped":true}}}'
    rows = token_rows(1, [(10, 2, 1000)], [(10, 2, 2147483647)], other=mark)
    counts = abuse.window_counts(spark.createDataFrame(rows, "token_id int, created_at bigint, type int, quota bigint, model_name string, other string"), BASE, BASE + 7 * W, W)
    assert counts.agg(F.sum("saturated_rows")).first()[0] == 70


def test_median_of_even_and_odd(spark):
    row = spark.sql("select array(4, 1, 3, 2) a, array(5, 1, 9) b").select(abuse.median(F.col("a")), abuse.median(F.col("b"))).first()
    assert tuple(row) == (2.5, 5.0)


# flow graph
def flow_rows(spark):
    rows = [(1, "alice", "node-a", 11, "primary", "vip", 101, "east", "gpt-4.1", 100, 40, 2), (1, "alice", "node-a", 11, "primary", "vip", 102, "west", "gpt-4.1", 50, 20, 1), (2, "bob", "node-b", 22, "backup", "default", 101, "east", "claude-4-sonnet", 70, 30, 3)]
    return spark.createDataFrame(rows, "user_id int, username string, node_name string, token_id int, token_name string, use_group string, channel_id int, channel_name string, model_name string, quota bigint, token_used bigint, count bigint")


def test_flow_of_a_user(spark):
    paths = flow.paths(flow_rows(spark).where("user_id = 1"), flow.stages_of("user"))
    assert tuple(flow.summary(paths).first()) == (150, 60, 3)
    links = {(r["source"], r["target"]): r["quota"] for r in flow.links(paths).collect()}
    assert links == {("group:vip", "model:gpt-4.1"): 150, ("token:11", "group:vip"): 150}


def test_flow_limits(spark):
    paths = flow.paths(flow_rows(spark), flow.stages_of("user"))
    folded = {(r["source"], r["target"]) for r in flow.links(flow.limited(paths, "quota", 1)).collect()}
    assert ("token:__other__", "group:__other__") in folded and ("token:11", "group:vip") in folded
    assert flow.links(flow.limited(paths, "quota", 1, hide=True)).count() == 2
    assert flow.stages_of("user", ["model"]) == ["token", "group", "model"]


# health
def counters(spark, rows):
    return spark.createDataFrame(rows, "model_name string, `group` string, bucket_ts bigint, request_count bigint, success_count bigint, total_latency_ms bigint, ttft_sum_ms bigint, ttft_count bigint, output_tokens bigint, generation_ms bigint")


def test_health_window():
    now = 1_789_389_420  # 2026-09-14 12:37 UTC
    assert X.health_window(now, 24) == (now - now % 3600 - 23 * 3600, now)


def test_health_summaries(spark):
    t = 7200
    rows = counters(spark, [("test-model", "a", t, 100, 100, 100_000, 0, 0, 500, 100_000), ("test-model", "b", t, 1, 0, 2_000, 0, 0, 0, 0), ("test-model", "hidden", t, 5, 5, 1, 0, 0, 0, 0), ("test-model", "a", 1, 9, 9, 9, 0, 0, 0, 0)])
    r = health.model_summaries(rows, t, t + 10, ["a", "b"]).first()
    assert (r["success_rate"], r["avg_latency_ms"], r["tps"]) == (99.01, 1009, 5.0)
    assert health.model_summaries(rows, t, t + 10, []).count() == 0
    assert health.overall(rows.where("false"), 0, 1).first()["success_rate"] is None


def test_hourly_success_is_weighted(spark):
    rows = counters(spark, [("m", "g", 3600, 100, 100, 0, 0, 0, 0, 0), ("m", "g", 3900, 1, 0, 0, 0, 0, 0, 0), ("m", "g", 7200, 1, 1, 0, 0, 0, 0, 0)])
    assert sorted(tuple(r) for r in health.hourly_success(rows).collect()) == [(3600, 99.01), (7200, 100.0)]


def test_task_samples_to_counters(spark):
    now = 1_000_000
    rows = [("m", "g", "SUCCESS", now - 120, now - 100, now, 5000, 0), ("m", "g", "FAILURE", now - 60, 0, now, 0, 0), ("", "g", "SUCCESS", now - 60, 0, now, 1, 0)]
    tasks = spark.createDataFrame(rows, "model_name string, `group` string, status string, submit_time bigint, start_time bigint, finish_time bigint, total_tokens bigint, completion_tokens bigint")
    r = health.bucket_counters(health.task_samples(tasks, now)).first()
    assert (r["request_count"], r["success_count"], r["total_latency_ms"], r["output_tokens"], r["generation_ms"]) == (2, 1, 180_000, 5_000, 100_000)


# pricing
def test_quota_conversions(spark):
    cases = [(42.9, 42, None), (-42.9, -42, None), (1e300, 2147483647, "overflow"), (-1e300, -2147483648, "underflow"), (float("nan"), 0, "nan")]
    for x, value, kind in cases:
        got = one(spark, X.quota_truncated(F.col("x")), x=x)
        assert (got["value"], got["kind"]) == (value, kind)
    for x, value in ((41.5, 42), (42.5, 43), (-42.5, -43)):
        assert one(spark, X.quota_rounded(F.col("x")), x=x)["value"] == value


PRICED = dict(model_price=0.0, model_ratio=1.0, completion_ratio=2.0, cache_ratio=0.1, creation_ratio=1.25, creation_5m_ratio=1.25, creation_1h_ratio=2.0, image_ratio=1.0, audio_price=0.0, group_ratio=1.0)
TOKENS = dict(prompt=1000, completion=200, cache=100, cache_creation=50, creation_5m=10, creation_1h=20, image=0, audio=0)


def test_text_quota_with_split_cache(spark):
    def quota(fixed=False, extra=0, **change):
        row = TOKENS | PRICED | dict(anthropic=True) | change
        frame = spark.createDataFrame([tuple(row.values())], list(row))
        return pricing.with_text_quota(frame, F.lit(fixed), F.lit(extra).cast("decimal(20,6)"), F.lit(1.0)).first()["priced_quota"]

    none = dict.fromkeys(TOKENS, 0)
    assert quota() == 1488
    # without tokens only tool calls cost, whatever the price mode
    assert quota(**none) == 0 and quota(**none, fixed=True, model_price=0.02) == 0 and quota(**none, extra=7) == 7
    assert quota(fixed=True, model_price=0.02, extra=7) == 10_007


def test_text_quota_computes_each_step_once(spark):
    row = TOKENS | PRICED | dict(anthropic=True, ratios={"size": 3.0})
    frame = spark.createDataFrame([tuple(row.values())] * 2, list(row)).repartition(2)
    priced = pricing.with_text_quota(frame, F.lit(False), F.lit(0).cast("decimal(20,6)"), pricing.other_multiplier(F.col("ratios")))
    assert priced._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_tiers(spark):
    tiers = [{"name": "standard", "when": [("p", "<=", 200_000)], "per": {"p": 1.5, "c": 7.5}}, {"name": "long_context", "per": {"p": 3.0, "c": 11.25}}]
    got = one(spark, pricing.tier_price(tiers), p=100_000.0, c=5_000.0)
    assert (got["tier"], got["cost"]) == ("standard", 100_000 * 1.5 + 5_000 * 7.5)
    got = one(spark, pricing.tier_quota(tiers, F.lit(1.0), F.lit("standard")), p=300_000.0, c=10_000.0)
    assert (got["tier"], got["value"], got["crossed"]) == ("long_context", round((300_000 * 3 + 10_000 * 11.25) / 1e6 * 500_000), True)


def half_up(x):
    return int(x + 0.5)


def rerated(spark, rows, tiers):
    """rows: (model, prompt, completion, other); one group, no tool prices but search's."""
    logs = spark.createDataFrame([(k, m, 0, p, c, json.dumps(o) if o is not None else None, "g", "u") for k, (m, p, c, o) in enumerate(rows)], "id bigint, model_name string, quota bigint, prompt_tokens bigint, completion_tokens bigint, other string, `group` string, user_group string")
    prices = spark.createDataFrame([("m", 1.0, None, 2.0, None, None, None, None), ("fixed", None, 0.5, None, None, None, None, None)], "model string, model_ratio double, model_price double, completion_ratio double, cache_ratio double, creation_ratio double, image_ratio double, audio_price double")
    groups, special = spark.createDataFrame([("g", 0.5)], "`group` string, ratio double"), spark.createDataFrame([], "user_group string, `group` string, ratio double")
    tools = spark.createDataFrame([("search", "", 10.0)], "tool string, prefix string, price double")
    found = pricing.rerate(logs, prices, groups, special, tools, spark.createDataFrame(tiers, f"model string, tiers {pricing.TIERS}"))
    return [(r["mode"], r["expected"], r["tier"], r["crossed"], r["kind"], r["cache_write"]) for r in found.orderBy("id").collect()]


def test_rerate_by_each_kind_of_billing(spark):
    tiers = [
        ("m", [("small", [("len", "<=", 1000.0), ("c", "<", 100.0)], None, [("p", 2.0), ("c", 8.0), ("cr", 0.5)]), ("cheap", [("p", "==", 5000.0)], 0.25, None), ("large", None, None, [("p", 4.0), ("c", 16.0)])]),
        ("narrow", [("only", [("img", ">", 3.0)], 1.0, None)]),
        ("fixed", [("flat", [], 10_000.0, None)]),
    ]
    t = {"billing_mode": "tiered_expr", "matched_tier": "small"}
    got = rerated(spark, [
        ("m", 1000, 10, None), ("m", 1000, 10, {"seconds": 4, "size": 1.5, "n": -2}), ("fixed", 10, 10, {"n": 3}),
        ("m", 900, 50, t | {"cache_tokens": 100, "seconds": 4}), ("m", 5000, 50, t), ("m", 900, 100, t | {"tool_surcharges": [{"name": "search", "count": 2, "price": 1}]}),
        ("narrow", 10, 10, t), ("other", 10, 0, t), ("fixed", 1, 1, t), ("m", 0, 0, t | {"billing_tokens": {"p": 3000.0, "len": 3000.0, "c": 1000.0}}),
        ("m", 10, 0, t | {"claude": True, "cache_creation_tokens": 5, "cache_creation_tokens_5m": 4, "cache_creation_tokens_1h": 3}),
    ], tiers)
    assert got[0] == ("ratio", 510, None, None, None, 0)
    assert got[1] == ("ratio", 510 * 6, None, None, None, 0)  # ratios that are not positive don't count
    assert got[2] == ("price", 375_000, None, None, None, 0)
    # p leaves out the cached tokens, which have a price of their own; other ratios don't multiply tiers
    assert got[3] == ("tier", half_up((800 * 2 + 50 * 8 + 100 * 0.5) / 1e6 * 500_000 * 0.5), "small", False, None, 0)
    assert got[4] == ("tier", 62_500, "cheap", True, None, 0)
    assert got[5] == ("tier", half_up((900 * 4 + 100 * 16) / 1e6 * 500_000 * 0.5 + 10 * 2 / 1000 * 0.5 * 500_000), "large", True, None, 0)
    # no tier fits, or the model has none: as by ratio
    assert got[6][0] == got[7][0] == "ratio" and got[6][2] is None and got[7][1] == half_up(10 * 37.5 * 0.5)
    assert got[8] == ("tier", 2147483647, "flat", True, "overflow", 0)
    assert got[9] == ("tier", half_up((3000 * 4 + 1000 * 16) / 1e6 * 500_000 * 0.5), "large", True, None, 0)
    assert got[10][5] == 7 and got[10][2] == "small"


def test_lookup_names(spark):
    for name, want in (("gpt-4-gizmo-g-1", "gpt-4-gizmo-*"), ("gemini-2.5-flash-lite-thinking-8", "gemini-2.5-flash-lite-thinking-*"), ("gemini-2.5-pro", "gemini-2.5-pro"), ("gpt-4o-gizmo-x", "gpt-4o-gizmo-*")):
        assert one(spark, pricing.lookup_name(F.col("x")), x=name) == want


def test_completion_ratio_rules(spark):
    names = lambda name: spark.createDataFrame([(name,)], "x string")
    got = lambda name, c: tuple(pricing.with_completion_ratio(names(name), "x", F.lit(c).cast("double")).select("ratio", "locked").first())
    assert got("a/b", 7.0) == (7.0, False) and got("gpt-5-mini", 7.0) == (8.0, True) and got("gpt-5.5", 7.0) == (7.0, False)
    assert got("gpt-3.5-turbo", None) == (2.0, False) and got("gpt-4-1106", None) == (3.0, True) and got("unknown", None) == (1.0, False)


# logs
def test_other_by_role(spark):
    rows = ['{"a": 12345678901234567890, "admin_info": {"x": 1}}', '{"reject_reason": "no", "b": [1, 2]}', '{"a": 1}', "not json", "", '{"admin_info": {"reject_reason": "old"}, "reject_reason": "new"}']
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, other string")
    seen = {role: [r["x"] for r in frame.select("i", logs.project_other(role).alias("x")).orderBy("i").collect()] for role in ("user", "admin", "root")}
    assert seen["user"] == ['{"a":12345678901234567890}', '{"b":[1,2]}', '{"a": 1}', "{}", "", "{}"]
    assert seen["admin"][1] == '{"admin_info":{"reject_reason":"no"},"b":[1,2]}' and seen["admin"][0] == rows[0]
    assert seen["root"][3] == "not json" and seen["admin"][5] == '{"admin_info":{"reject_reason":"old"}}'


def test_patterns():
    for bad in ("a%%b", "%a%b%", "%a"):
        with pytest.raises(ValueError):
            X.check_pattern(bad)
    X.check_pattern("%ab%")
    assert X.status_ranges("401，500-503") == [(401, 401), (500, 503)]
    for bad in ("abc", "700", "503-500"):
        with pytest.raises(ValueError):
            X.status_ranges(bad)
    assert X.stat_window(0, 0, 10**9) == (10**9 - 30 * 86400, 0) and X.stat_window(5, 9, 10**9) == (5, 9)


def test_json_round_trip(spark):
    other = '{"big":9007199254740993,"t":"ü"}'
    row = (7, 1, 2**62 + 7, 2, "c", "u", "t", "m", 2147483647, 1, 2, 3, True, 9, 4, "g", "ip", "r", "", other)
    frame = spark.createDataFrame([row], source.SCHEMA)
    lines = source.encode_json(frame)
    assert '"channel":9' in lines.first()["value"]
    good, bad = source.decode_json(lines.unionAll(spark.createDataFrame([("{broken",)], "value string")))
    assert [tuple(r) for r in good.collect()] == [row] and bad.count() == 1


def test_request_id_is_stable(spark):
    frame = spark.createDataFrame([("", 1), ("", 1), ("", 2), ("x", 1)], "request_id string, v int")
    ids = [r["request_id"] for r in source.with_request_id(frame).collect()]
    assert ids[0] == ids[1] != ids[2] and ids[3] == "x"


def test_log_files(spark, tmp_path):
    rows = [(i, 1, 1_704_067_200 + i * 40 * 86_400, 2, "c", "u", "t", "m", 1, 1, 2, 3, True, 9, 4, "g", "ip", "r", "", "{}") for i in range(3)]
    source.write_logs(spark.createDataFrame(rows, source.SCHEMA), str(tmp_path / "logs"))
    assert source.read_logs(spark, str(tmp_path / "logs")).count() == 3
    assert source.read_logs(spark, str(tmp_path / "logs"), start=1_704_067_201).count() == 2


# catalogs
def test_preferred_owner(spark):
    a = spark.createDataFrame([("g", "m", 1, True, 1, 5), ("g", "m", 2, True, 2, 1), ("g", "m", 3, True, 2, 9), ("g", "m", 4, True, 2, 9), ("h", "m", 5, True, None, 9)], "`group` string, model string, channel_id int, enabled boolean, priority int, weight int")
    c = spark.createDataFrame([(i, i * 10, 1) for i in range(1, 6)], "id int, type int, status int")
    assert tuple(models.preferred_owner(a, c).first()) == ("m", 3, 30)
    assert tuple(models.preferred_owner(a, c, ["h"]).first()) == ("m", 5, 50)


def test_add_wins_over_remove(spark):
    row = spark.sql("select array('a','b') m, array('b','c') x, array('a','b') y").select(models.apply_changes(F.col("m"), F.col("x"), F.col("y")).alias("r")).first()
    assert row["r"] == ["b", "c"]


def test_cube_dedupe(spark):
    rows = [(5, None, None, "m", 3600, "g", 1, 1, None, 1, 10, 100), (3, 0, "", "m", 3600, "g", 1, 1, "", 2, 20, 200)]
    cube = spark.createDataFrame(rows, "id int, user_id int, username string, model_name string, created_at bigint, use_group string, token_id int, channel_id int, node_name string, count bigint, quota bigint, token_used bigint")
    (r,) = usage.dedupe_cube(cube).collect()
    assert (r["id"], r["count"], r["quota"], r["token_used"], r["user_id"], r["username"]) == (3, 3, 30, 300, 0, "")


def test_upsert_is_associative(spark):
    frame = lambda n: spark.createDataFrame([(k, n * k) for k in range(4)], "k int, v bigint")
    add = lambda a, b: usage.upsert_add(a, b, ["k"], ["v"])
    a, b, c = frame(1), frame(2), frame(3)
    assert sorted(map(tuple, add(add(a, b), c).collect())) == sorted(map(tuple, add(a, add(b, c)).collect()))


def test_cube_does_not_depend_on_partitions(spark):
    from meterlake.sources import samples as S

    rows = S.logs(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, usage.hourly_cube(rows.repartition(1)).collect())) == sorted(map(tuple, usage.hourly_cube(rows.repartition(8)).collect()))


# settlement
def test_calendar_overflow(spark):
    start = 1_706_659_200  # 2024-01-31
    end = lambda unit, n, **k: one(spark, settlement.plan_end(F.col("s"), F.lit(unit), F.lit(n), F.lit(k.get("custom", 0))), s=start)
    assert end("month", 1) == 1_709_337_600  # 2024-03-02
    assert end("month", 13) == 1_740_960_000  # 2025-03-03
    assert end("day", 2) == start + 2 * 86400 and end("custom", 0, custom=5) == start + 5 and end("day", 0) is None


def test_resets(spark):
    sunday = 1_704_585_600 + 100  # 2024-01-07, a Sunday
    nxt = lambda period, end=0: one(spark, settlement.next_reset(F.col("b"), F.lit(period), F.lit(50), F.lit(end)), b=sunday)
    assert nxt("daily") == nxt("weekly") == 1_704_672_000 and nxt("monthly") == 1_706_745_600 and nxt("custom") == sunday + 50 and nxt("never") == 0
    assert nxt("daily", end=sunday + 1) == 0


def test_settlement_signs(spark):
    t = spark.createDataFrame([(1, 1, 1, 1, 100, 150), (2, 1, 1, 1, 100, 40), (3, 1, 1, 1, 100, 100), (4, 1, 1, 1, 100, -5)], "id int, user_id int, channel_id int, token_id int, quota bigint, actual_quota bigint")
    assert sorted((r["id"], r["type"], r["log_quota"]) for r in settlement.settle_tasks(t).collect()) == [(1, 2, 50), (2, 6, 60)]


# texts
def character_class(c: str) -> str:
    """newline, space, cjk, emoji, word, number, math, at, url or symbol; the first that fits."""
    n, category = ord(c), unicodedata.category(c)
    within = lambda ranges: any(a <= n <= b for a, b in ranges)
    if c in "\t\n\v\f\r \x85\xa0" or category in ("Zs", "Zl", "Zp"):
        return "newline" if c in "\n\t" else "space"
    if within(texts.CJK_RANGES):
        return "cjk"
    if within(texts.EMOJI_RANGES):
        return "emoji"
    if category[0] in "LN":
        return "number" if category[0] == "N" else "word"
    if c in texts.MATH or within(texts.MATH_RANGES):
        return "math"
    return "at" if c == "@" else "url" if c in texts.URL else "symbol"


def test_token_estimates_against_a_loop(spark):
    samples = ["Hello, world 42!", "abc123 x@y.z/q?a=1", "日本語 テスト\n\t", "∑ ≤ 😀", "", None, "a" * 5000, "a1b22c ３４Ⅷ²x\u0301\u00a0\u2028\x85\x0b\r𝒜𠀀〇々ａ@@#;&-!𝔸1😀2é✂x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, text string")
    got = [r["n"] for r in frame.select("i", texts.estimate_tokens("text", F.lit("openai")).alias("n")).orderBy("i").collect()]
    w, want = texts.WEIGHTS["openai"], []
    for t in samples:
        total, last = 0.0, ""
        for c in t or "":
            k = character_class(c)
            total += 0 if k == last and k in ("word", "number") else w[k]
            last = k
        want.append(-int(-round(total, 9) // 1))
    assert got == want and got[4] == got[5] == 0


def test_word_replacement(spark):
    frame = spark.createDataFrame([("Bad badger BAD",), (None,), ("",)], "text string")
    rows = frame.select(texts.replace_words("text", ["bad", "badger"]).alias("r")).collect()
    assert rows[0]["r"]["text"] == "**###** **###** **###**" and rows[0]["r"]["hits"] == ["bad", "badger"]
    assert rows[1]["r"]["text"] is None and rows[2]["r"]["text"] == ""


def test_word_replacement_where_lower_case_is_longer(spark):
    cases = {"İ bad": "İ **###**", "bad İ": "**###** İ", "İİ badger, İ Bad!": "İİ **###**, İ **###**!", "a KADİN b": "a **###** b", "xKADİ, BAD": "x**###**, **###**", "İn it": "İn it"}
    frame = spark.createDataFrame([(t,) for t in cases], "text string")
    words = ["bad", "badger", "kadİn", "kadi"]
    for r in frame.select("text", texts.replace_words("text", words).alias("r"), texts.sensitive_words("text", words).alias("found")).collect():
        assert r["r"]["text"] == cases[r["text"]] and bool(r["r"]["hits"]) == bool(r["found"])


def test_word_search_holds_few_texts_at_once(spark, monkeypatch):
    """However large the rows of a batch are, some MB of them are Python's strings at a time."""
    import tracemalloc

    import pyarrow as pa

    kept = []
    for name in ("arrow_udf", "pandas_udf"):
        monkeypatch.setattr(texts.F, name, lambda kind: lambda run: kept.append(run) or (lambda column: None))
    texts.replace_words("text", ["bad", "badger"]), texts.sensitive_words("text", ["bad", "badger"])
    batch = pa.array([None, "", *["some plain text, " * 12_000 + "Bad"] * 200, "bad"])
    for run, first in zip(kept, ({"text": None, "hits": []}, []), strict=True):
        tracemalloc.start()
        sizes, rows = [], []
        for part in run(iter([batch, batch[:2], batch[:0]])):
            sizes.append(len(part))
            rows += part[:1].to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows[0] == first and sum(sizes) == len(batch) + 2 and max(sizes) <= 12
        assert peak < batch.nbytes < 60_000_000


# streams
def test_admission_against_a_loop(spark):
    rows = [(u, i, (i * 7919) % 500) for u in (1, 2) for i in range(200)]
    frame = spark.createDataFrame(rows, "user_id bigint, id bigint, created_at bigint")
    got = {(r["user_id"], r["id"]): r["accepted"] for r in jobs.replay_admission(frame, 3, 20).collect()}
    for u in (1, 2):
        taken = []
        for _, i, t in sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1])):
            ok = sum(t - a < 20 for a in taken) < 3
            taken += [t] * ok
            assert got[u, i] == ok


def test_cache_session(spark):
    rows = [("r", "g", "k", 100, 30, 0, 100, 40, 140, "a"), ("r", "g", "k", 150, 0, 0, 10, 5, 0, "b"), ("r", "g", "k", 900, 0, 0, 1, 1, 2, "a"), ("", "g", "k", 1, 0, 0, 1, 1, 2, "a")]
    uses = spark.createDataFrame(rows, "rule string, `group` string, key string, ts bigint, cached_tokens bigint, hit_tokens bigint, prompt bigint, completion bigint, total bigint, mode string")
    got = sorted((r["first_seen"], r["total_uses"], r["hits"], r["total_tokens"], r["mode"]) for r in jobs.cache_sessions(uses, 100).collect())
    assert got == [(100, 2, 1, 155, "mixed"), (900, 1, 0, 2, "a")]


def test_cube_keeps_late_rows(spark, tmp_path):
    schema = source.SCHEMA
    row = lambda i, t: (i, 1, t, 2, "c", "u", "t", "m", 10, 1, 2, 3, True, 9, 4, "g", "ip", str(i), "", "{}")
    path = str(tmp_path / "cube")
    for batch_id, batch in enumerate(([row(1, 90_000), row(2, 3_700)], [row(3, 3_800)], [row(4, 200_000)])):
        jobs.upsert_cube(spark.createDataFrame(batch, schema), path, batch_id)
    got = sorted((r["created_at"], r["count"], r["quota"]) for r in spark.read.parquet(path).collect())
    assert got == [(3_600, 2, 20), (90_000, 1, 10), (198_000, 1, 10)]


def test_admission_on_a_stream(spark, tmp_path):
    rows = [(u, i, (i * 7919) % 500) for u in (1, 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "user_id bigint, id bigint, created_at bigint")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = jobs.stream_admission(stream, 3, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination()
    order = lambda df: sorted((r["user_id"], r["id"], r["accepted"]) for r in df.collect())
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(jobs.replay_admission(frame, 3, 60))


def test_vendors_are_read_whole(spark, tmp_path):
    from meterlake.plans import rankings

    suppliers = [(61, "S61"), (81, "S81"), (1002, "S1002"), (79, "none")]
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    meta, vendors = rankings.vendors(spark, str(tmp_path))
    assert sorted((r["model_name"], r["vendor_id"]) for r in meta.collect()) == [("model-1", 61), ("model-2", 1002)] and vendors.count() == 4


def test_replayed_batch_counts_once(spark, tmp_path):
    from meterlake.operators import usage as U
    from meterlake.sources import samples as S

    logs, path = S.logs(spark, "/root/testdata/sf0.001"), str(tmp_path / "cube")
    first, second = logs.where("id % 2 = 0"), logs.where("id % 2 = 1")
    for batch_id, batch in ((0, first), (1, second), (1, second), (0, first)):
        jobs.upsert_cube(batch, path, batch_id)
    want = U.hourly_cube(logs).agg(F.sum("count"), F.sum("quota")).first()
    assert spark.read.parquet(path).agg(F.sum("count"), F.sum("quota")).first() == want
    # another writer starts to count its batches from 0
    jobs.upsert_cube(first, path, 0, "second")
    assert spark.read.parquet(path).agg(F.sum("count")).first()[0] == want[0] + U.hourly_cube(first).agg(F.sum("count")).first()[0]


def test_kafka_source_options():
    from meterlake.sources import logs as L

    class Reader:
        def __init__(self):
            self.found = {}

        def format(self, name):
            self.found["format"] = name
            return self

        def option(self, key, value):
            self.found[key] = value
            return self

        def load(self):
            return self.found

    session = type("Session", (), {"readStream": Reader()})()
    assert L.kafka_lines(session, "a:9092,b:9092", "logs") == {"format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "logs", "startingOffsets": "earliest"}


# words by automaton
def naive_words(text, words):
    low = text.lower()
    known = sorted({w.strip().lower() for w in words} - {""})
    found = [h[2] for h in sorted((low.find(w), -len(w), w) for w in known if w in low)]
    place = [k for k, c in enumerate(text) for _ in c.lower()]
    out, hits, at, k = [], [], 0, 0
    while k < len(low):
        w = max((w for w in known if low.startswith(w, k)), key=len, default=None)
        if w:
            out += [text[at : place[k]], "#"]
            hits.append(w)
            k += len(w)
            at = place[k - 1] + 1
        else:
            k += 1
    return found, "".join([*out, text[at:]]), list(dict.fromkeys(hits))


@pytest.mark.parametrize("cells", [1, 100, 1 << 22])
def test_words_of_an_automaton_against_a_naive_scan(spark, monkeypatch, cells):
    """Nested, overlapping and long words, in texts that are walked in many stretches."""
    from meterlake.operators import automaton

    monkeypatch.setattr(automaton, "CELLS", cells)
    monkeypatch.setattr(automaton, "STRETCH", 16)
    monkeypatch.setattr(texts, "WALKED", 2_000)
    rng = np.random.default_rng(3)
    letters = list("aabbcé A\u0130ſ日")
    make = lambda n: "".join(rng.choice(letters, int(n)))
    words = [make(n) for n in rng.integers(1, 6, 40)] + ["a" * k for k in range(4, 9)] + ["ab" * 30, " Bad ", "", "  "]
    bodies = [make(n) for n in rng.integers(0, 400, 60)] + ["a" * 500, "ab" * 200, "BAD", "", None]
    frame = spark.createDataFrame([(b,) for b in bodies], "text string")
    both = frame.select("text", texts.sensitive_words("text", words).alias("found"), texts.sensitive_words("text", words, True).alias("one"), texts.replace_words("text", words, "#").alias("r"))
    for r in both.collect():
        found, text, hits = naive_words(r["text"] or "", words)
        assert r["found"] == found and r["one"] == found[:1]
        assert (r["r"]["text"] or "", r["r"]["hits"]) == (text, hits)


def test_cost_of_wide_dictionaries():
    """100,000 words cost at most twice what 100 do where texts hold few of their beginnings; where every word of the
    texts begins words of the dictionary, walks are deep in it and cost up to some ten times as much."""
    import time

    import duckdb

    from meterlake.operators.automaton import Automaton, lowered

    bodies = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    data, bounds = lowered(bodies)
    vocabulary = sorted({w for t in bodies for w in t.lower().split()})
    rare = [f"q{w[::-1]}z" for w in vocabulary] + [f"x{w}q" for w in vocabulary]
    deep = [f"{a}{b}" for far in (97, 194) for a, b in zip(vocabulary, vocabulary[far:], strict=False)]

    def cost(words):
        made, times = Automaton(words), []
        for _ in range(5):
            began = time.perf_counter()
            made.matches(data, bounds)
            times.append(time.perf_counter() - began)
        return min(times)

    assert min(len(rare), len(deep)) > 100_000
    small = cost(rare[:100])
    assert cost(rare[:100_000]) < 2 * small and cost(deep[:100_000]) < 25 * small


def test_token_estimates_run_without_python(spark):
    frame = spark.createDataFrame([("x",)], "text string").select(texts.estimate_tokens("text", F.lit("claude")))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
