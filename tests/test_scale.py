"""Busy keys, deep pages, wide rule tables and counts that roll up: each against a plain form, and its spread."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from meterlake.operators import logs, models, rankings, usage
from meterlake.plans.streams import with_rocks
from meterlake.streaming import jobs

from tests.test_streams import streamed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, count, alphabet="abcD-é", most=9):
    return ["".join(rng.choices(alphabet, k=rng.randrange(most))) for _ in range(count)]


def test_patterns_by_an_index_of_grams_equal_a_loop(spark):
    rng = random.Random(3)
    texts = [*words(rng, 300), "", None, "abcabc", "𝒂bc"]
    patterns = [*words(rng, 150, most=6), "", None, "abca", "𝒂bc", "zzz", "abczz"]
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    got = models.containing(frame(texts, "text"), frame(patterns, "pattern"))
    want = {(t, p) for t in texts for p in patterns if t is not None and p is not None and p in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert models.containing(frame(texts, "text").limit(0), frame(patterns, "pattern")).count() == 0


def test_rules_of_all_kinds_equal_a_loop(spark):
    rng = random.Random(4)
    names = [*words(rng, 200), "", None]
    rules = [(kind, p) for kind in range(4) for p in {*words(rng, 40, most=5), "", "abc"}]
    fits = [lambda n, p: n == p, lambda n, p: n.startswith(p), lambda n, p: p in n, lambda n, p: n.endswith(p)]
    got = models.rule_hits(spark.createDataFrame([(n,) for n in names], "model string"), spark.createDataFrame(rules, "name_rule int, pattern string"))
    assert sorted(map(tuple, got.collect())) == sorted({(n, k, p) for n in names if n is not None for k, p in rules if fits[k](n, p)})


def test_wide_rules_meet_names_without_a_loop(spark):
    names = spark.range(100_000).select(F.concat(F.lit("model-"), F.sha2(F.col("id").cast("string"), 256)).alias("model"))
    rules = spark.range(10_000).select((F.col("id") % 4).cast("int").alias("name_rule"), F.substring(F.sha2((F.col("id") * 7).cast("string"), 256), 9, 5).alias("pattern"))
    vendors = rules.select("pattern", F.lit("v").alias("vendor"))
    for df in (models.rule_hits(names, rules), models.default_vendor(names, vendors)):
        assert "NestedLoop" not in plan_of(df) and "Cartesian" not in plan_of(df)
    hits = models.rule_hits(names, rules)
    assert hits.where("name_rule = 2").count() == hits.where("name_rule = 2 and contains(model, pattern)").count() > 0


def test_vendor_by_the_longest_pattern_in_any_case(spark):
    names = spark.createDataFrame([("GPT-4o",), ("gpt-4o",), ("Claude",), ("other",), (None,)], "model string")
    patterns = spark.createDataFrame([("gpt", "a"), ("GPT-4", "b"), ("gpt-4", "c"), ("cla", "d"), (None, "e")], "pattern string, vendor string")
    assert sorted(map(tuple, models.default_vendor(names, patterns).collect())) == [("Claude", "d"), ("GPT-4o", "b"), ("gpt-4o", "b")]


def test_picks_equal_a_search_and_meet_one_row_each(spark):
    rng = random.Random(5)
    shares, highs = [], {}
    for n in (1, 2, 3, 7, 64, 65):
        weights = [rng.random() * (rng.random() > 0.2) for _ in range(n)]
        total, own = sum(weights) or 1.0, []
        for k, w in enumerate(weights):
            shares.append(("g", f"m{n}", 100 - n + k, w / total))
            own.append((own[-1] if own else 0.0) + w / total)
        highs[f"m{n}"] = own
    requests = [(k, "g", f"m{rng.choice((1, 2, 3, 7, 64, 65, 9))}", rng.random()) for k in range(2_000)] + [(2_000, "g", "m7", 0.0), (2_001, "g", "m7", None)]
    asked = spark.createDataFrame(requests, 'id long, "group" string, model string, d double'.replace('"', "`"))
    got = models.weighted_pick(asked, spark.createDataFrame(shares, "`group` string, model string, channel_id int, share double"), F.col("d"))
    want = {k: 100 - len(highs[m]) + min(bisect.bisect_right(highs[m], d), len(highs[m]) - 1) for k, _, m, d in requests if m in highs and d is not None}
    rows = got.select("id", "channel_id").collect()
    assert len(rows) == len(want) and dict(map(tuple, rows)) == want


@pytest.mark.parametrize("offset", [0, 7, 99, 100, 250, 503, 1_190, 1_204, 5_000])
def test_deep_pages_equal_a_sort(spark, offset):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 5, 5, 5, 6, rng.randrange(10**6), 10**12])) for k in range(1_200)] + [(None, 5)] * 2 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "id long, created_at long")
    got = logs.deep_page(df, offset, 20, cells=16, rows=10).orderBy("display_id").collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0] is not None, r[0] or 0), reverse=True)
    assert [(r["id"], r["created_at"], r["display_id"]) for r in got] == [(*r, offset + n + 1) for n, r in enumerate(order[offset : offset + 20])]


def test_a_page_at_a_million_takes_few_rows(spark):
    df = spark.range(1_200_000).select("id", (F.col("id") * 7919 % 1_000_003).alias("created_at"))
    got = logs.deep_page(df, 1_000_000, 10)
    order = df.orderBy(F.desc("created_at"), F.desc("id")).offset(1_000_000).limit(10).collect()
    assert [r["id"] for r in got.orderBy("display_id").collect()] == [r["id"] for r in order]
    limit = int(plan_of(got).split("TakeOrderedAndProject(limit=")[1].split(",")[0])
    assert limit <= 100_010


@pytest.mark.parametrize("ranges", [1, 4, 16])
def test_numbers_of_rows_equal_a_sort(spark, ranges):
    rng = random.Random(10)
    rows = [(f"m{k}", rng.choice([0, 1, 1, 1, 7, rng.randrange(10**12)]), rng.choice([None, 0, 5, rng.randrange(99)])) for k in range(900)]
    df = spark.createDataFrame([*rows, (None, 1, None), ("", 1, 0)], "name string, now long, then long")
    got = rankings.numbered(df, {"a": [F.negate(F.col("now")), F.col("name")], "b": [F.col("then"), F.col("name")]}, ranges)
    assert got.columns == ["name", "now", "then", "a", "b"]
    found = [tuple(r) for r in got.collect()]
    first = lambda x: (x is not None, x)  # noqa: E731  nulls first
    for at, order in ((3, lambda r: (-r[1], first(r[0]))), (4, lambda r: (first(r[2]), first(r[0])))):
        assert [r[at] for r in sorted(found, key=order)] == list(range(1, 903))
    assert rankings.numbered(df.limit(0), {"a": [F.col("now")]}).count() == 0


def test_a_third_of_all_names_with_one_value_is_many_ranges(spark):
    df = spark.range(60_000).select(F.concat(F.lit("a-long-common-beginning-"), "id").alias("model_name"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("tokens"), F.lit(2).alias("previous"))
    got = rankings.ranked_models(df.where("tokens > 0"))
    assert "SinglePartition" not in "".join(x for x in plan_of(got).splitlines() if "rank#" in x)
    numbers = got.agg(F.count_distinct("rank"), F.max("rank"), F.count_distinct("previous_rank"), F.max("previous_rank")).first()
    assert tuple(numbers) == (60_000,) * 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = got.groupBy(F.spark_partition_id()).count().select("count").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r[0] for r in sizes) < 30_000


def test_the_leaderboard_is_the_head_of_the_ranked_models(spark):
    rng = random.Random(11)
    rows = [(f"m{k}", rng.choice([0, 3, rng.randrange(50)]), rng.choice([0, 0, 3, rng.randrange(50)])) for k in range(300)]
    df = spark.createDataFrame(rows, "model_name string, tokens long, previous long").where("tokens > 0 or previous > 0")
    for limit in (1, 20, 1_000):
        got, want = rankings.model_leaderboard(df, limit), rankings.ranked_models(df).where(F.col("rank") <= limit)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert rankings.model_leaderboard(df.limit(0)).count() == rankings.vendor_leaderboard(df.limit(0).withColumn("vendor", F.lit("v"))).count() == 0


def requests(rng):
    """Half of the rows are of one user, in bursts with pauses."""
    rows = [(k, rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(400) + 5_000 * rng.randrange(-3, 40)) for k in range(3_000)]
    return rows + [(3_000, 1, None), (3_001, 1, None), (3_002, 4, None)]


def test_sliding_counts_of_a_busy_key(spark):
    rows = requests(random.Random(7))
    df = spark.createDataFrame(rows, "id long, user_id long, created_at long")
    counted = jobs.sliding_counts(df, 90, blocks=2)
    near = lambda a, b: a is b is None or (None not in (a, b) and 0 <= a - b < 90)
    want = {(k, sum(u == v and near(t, s) for _, v, s in rows)) for k, u, t in rows}
    assert {(r["id"], r["recent"]) for r in counted.collect()} == want and counted.columns == ["id", "user_id", "created_at", "recent"]
    parts = jobs.sliding_counts(df.where("user_id = 1").repartition(8), 90, blocks=2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert parts.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_admission_of_a_busy_key(spark):
    rows = requests(random.Random(8))
    df = spark.createDataFrame(rows, "id long, user_id long, created_at long")
    for blocks in (1, 3, 64):
        keyed = df.where("created_at is not null").select(F.col("user_id").alias("key"), F.col("created_at").alias("at"), F.col("id").alias("row"))
        found = jobs.with_segments(keyed, 50, blocks).where("key = 1").orderBy("at").collect()
        begin, before = None, None
        for r in found:
            begin = r["at"] if before is None or r["at"] - before >= 50 else begin
            assert r["segment"] == begin
            before = r["at"]
    got = {(r["id"], r["accepted"]) for r in jobs.replay_admission(df, 3, 50).collect()}
    want, state = set(), {}
    for k, u, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        own = state.setdefault(u, [])
        own[:] = [s for s in own if t - s < 50]
        want.add((k, len(own) < 3))
        if len(own) < 3:
            own.append(t)
    assert got == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert jobs.replay_admission(df.where("user_id = 1"), 3, 50).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_admission_keeps_large_ids_beside_nulls(spark):
    df = spark.createDataFrame([(2**62 + 1, None, 5), (2**62 + 3, 2**61 + 1, 5), (None, 2**61 + 3, 6)], "id long, user_id long, created_at long")
    got = {(r["user_id"], r["id"], r["accepted"]) for r in jobs.replay_admission(df, 1, 50).collect()}
    assert got == {(None, 2**62 + 1, True), (2**61 + 1, 2**62 + 3, True), (2**61 + 3, None, True)}


def test_rolled_up_counts_are_near(spark):
    df = spark.range(400_000).select((F.col("id") % 3).alias("model"), (F.col("id") * 11 % 172_800).alias("created_at"), (F.xxhash64("id") % 60_000).alias("user"))
    stored = usage.distinct_sketches(df, ["model"], "user")
    for keys in ([], ["model"], ["model", F.expr("created_at div 86400").alias("day")]):
        names = [k if isinstance(k, str) else "day" for k in keys]
        exact = df.groupBy(*keys).agg(F.count_distinct("user").alias("exact"))
        rows = usage.distinct_counts(stored, keys)
        both = rows.join(exact, names) if names else rows.join(exact, F.lit(True))
        assert all(abs(r["total"] - r["exact"]) <= 0.02 * r["exact"] for r in both.collect())
    assert usage.distinct_counts(stored.limit(0), ["model"]).count() == 0


USES = "rule string, `group` string, key string, ts bigint, cached_tokens bigint, hit_tokens bigint, prompt bigint, completion bigint, total bigint, mode string"


def test_streamed_sessions_equal_the_batch_ones(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice(["r", "r", " r ", "", "q"]), "g", rng.choice(["a", "b"]), rng.randrange(6_000), rng.randrange(3), 0, 1, 2, rng.randrange(2), rng.choice(["", "x", "y"])) for _ in range(150)]
    place = lambda r: r[3] // 2_000 + (r[3] % 2_000 > 1_700 and r[3] % 3 == 0)  # noqa: E731  late, within the allowance
    end = ("z", "g", "z", 10**6, 0, 0, 0, 0, 0, "")
    batches = [[r for r in rows if place(r) == k] for k in range(3)] + [[r for r in rows if place(r) == 3] + [end]]
    got = streamed(spark, batches, USES, tmp_path, lambda uses: jobs.cache_sessions(uses, 60, "400 seconds"))
    want = jobs.cache_sessions(spark.createDataFrame(rows, USES), 60).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 50


def test_streamed_counts_of_windows(spark, tmp_path):
    rows = [(k, 1 if k % 2 else k % 5, k * 7 % 900) for k in range(400)]
    batches = [rows[:250], rows[250:] + [(999, 9, 10_000)]]
    got = with_rocks(spark, lambda: streamed(spark, batches, "id long, user_id long, created_at long", tmp_path, lambda r: jobs.stream_sliding_counts(r, 60, 20, "1000 seconds")))
    want = {}
    for _, u, t in rows:
        for start in range(t // 20 * 20 - 40, t + 1, 20):
            want[u, start] = want.get((u, start), 0) + 1
    assert {(r["user_id"], r["start"]): r["recent"] for r in got} == want
