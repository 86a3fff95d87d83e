"""Streams over several batches against the batch operators on the same logs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meterlake.operators import abuse
from meterlake.sources import logs as source
from meterlake.streaming import jobs

LOG = "id bigint, token_id bigint, created_at bigint, type int, quota bigint, model_name string, other string"
SETTINGS = abuse.Settings(window=600, gate_requests=2, least_quota=300, least_requests=4, least_errors=1, consume_ratio=1.5, request_ratio=1.3, error_ratio=1.2, lookback=9_000, most_span=12_000)


def streamed(spark, batches, schema, path, make, sink="out"):
    """What a stream emits over one batch after the other, each with a run of its own."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{path}/in"))
        stream.writeStream.option("checkpointLocation", f"{path}/check").format("parquet").option("path", f"{path}/{sink}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{sink}").collect()


def abuse_logs():
    rng, rows = np.random.default_rng(6), []
    for k in range(600):
        token = int(rng.choice([0, 1, 1, 1, 2, 3]))
        at = int(rng.integers(0, 15_000)) if token != 3 else int(rng.integers(6_000, 6_500))
        other = '{"admin_info":{"quota_saturation":{}}}' if k % 17 == 0 else None if k % 5 == 0 else "{}"
        rows.append((k, token, at, int(rng.choice([2, 2, 2, 5, 7])), int(rng.integers(1, 900)), ["a", "b", "", None, "zzz"][int(rng.choice([0, 0, 0, 0, 1, 1, 2, 3, 4]))], other))
    return rows


def test_streamed_findings_equal_the_batch_ones_of_every_window(spark, tmp_path):
    rows = abuse_logs()
    end = (99, 1, 100_000, 2, 1, "a", None)  # lets the windows before it close
    late = lambda r: r[2] % 7 == 0 and r[2] % 5_000 > 3_000  # noqa: E731  comes with the next batch, within the hour
    batch = lambda r: min(3, r[2] // 5_000 + late(r))
    batches = [[r for r in rows if batch(r) == k] for k in range(3)] + [[r for r in rows if batch(r) == 3] + [end]]
    assert any(late(r) for r in rows)
    got = streamed(spark, batches, LOG, tmp_path, lambda logs: jobs.stream_findings(logs, SETTINGS))
    frame, want = spark.createDataFrame(rows, LOG), []
    for bucket in range(0, 15_000, 600):
        found = abuse.detect(frame, bucket + 600, SETTINGS)[0]
        want += [(r["token_id"], bucket, r["rule"], r["severity"], r["current"], r["baseline"], r["ratio"], r["direction"], r["model_name"], r["first_at"]) for r in found.collect()]
    key = lambda r: tuple(map(str, r))
    names = ("token_id", "bucket", "rule", "severity", "current", "baseline", "ratio", "direction", "model_name", "first_at")
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)
    assert {r[2] for r in want} == {"consume_spike", "request_spike", "error_rate_spike", "new_model"}


def test_logs_beyond_the_allowance_are_in_no_window(spark, tmp_path):
    row = lambda k, at: (k, 1, at, 2, 100, "a", None)
    batches = [[row(1, 100), row(2, 20_000)], [row(3, 200), row(4, 19_000)], [row(5, 60_000)]]
    got = streamed(spark, batches, LOG, tmp_path, lambda logs: jobs.recent_windows(logs, SETTINGS))
    assert sorted((r["bucket"], r["requests"]) for r in got) == [(0, 1), (18_600, 1), (19_800, 1)]
    assert [len(r["base_requests"]) for r in got] == [SETTINGS.baseline] * 3


def request(k, at, user=1, name=None):
    return (k, user, at, 2, "c", "u", "t", "m", 10, 1, 2, 3, True, 9, 4, "g", "ip", f"r{k}" if name is None else name, "", "{}")


def test_no_late_original_is_lost_and_no_late_repeat_kept(spark, tmp_path):
    """Ten batches: new logs, logs of long ago, and repeats of both from the same batch and from any batch before."""
    rng, sent, batches, state = np.random.default_rng(2), [], [], []
    for b in range(10):
        new = [request(b * 100 + k, 1_700_000_000 + b * 1_000 + k) for k in range(20)]
        new += [request(b * 100 + k, 1_690_000_000 + int(rng.integers(0, 9_000_000))) for k in range(50, 60)]
        new += [request(b * 100 + 70, 1_700_000_000 + b, name="")]
        again = [sent[int(i)] for i in rng.integers(0, len(sent), 15)] if sent else []
        batches.append(new + again + new[:3])
        sent += new
    for rows in batches:
        spark.createDataFrame(rows, source.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(source.SCHEMA).parquet(f"{tmp_path}/in")
        run = jobs.without_repeats(stream, f"{tmp_path}/logs").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        run.awaitTermination()
        state.append(sum(op["numRowsTotal"] for p in run.recentProgress for op in p["stateOperators"]))
    got = source.read_logs(spark, f"{tmp_path}/logs")
    assert sorted(r["id"] for r in got.collect()) == sorted(r[0] for r in sent) and set(state) == {0}
    source.append_new(spark.createDataFrame(batches[4], source.SCHEMA), f"{tmp_path}/logs")  # a batch that is run again
    assert source.read_logs(spark, f"{tmp_path}/logs").count() == len(sent)
    source.append_new(spark.createDataFrame([], source.SCHEMA), f"{tmp_path}/logs")


def scanned(frame):
    """Rows that a query's scan gives to the filter behind it."""
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan(), []
    todo = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return sum(found)


def test_a_user_and_day_read_few_row_groups(spark, tmp_path, monkeypatch):
    """A month of 400 users, one with a third of all rows, in ten files of some ten row groups each."""
    rows = spark.range(60_000).selectExpr("id", "if(id % 3 = 0, 7L, pmod(xxhash64(id), 400)) as user_id", "1704067200 + pmod(xxhash64(id, 1), 30 * 86400) as created_at", "cast(uuid() as string) as request_id")
    others = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in source.SCHEMA}
    rows = rows.select(*(F.col(c) if c in rows.columns else x for c, x in others.items()))
    rows.write.parquet(f"{tmp_path}/raw")
    rows = spark.read.parquet(f"{tmp_path}/raw")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("parquet.block.size")
    conf.set("parquet.block.size", "65536"), conf.set("parquet.block.size.row.check.min", "100"), conf.set("parquet.page.size.row.check.min", "100")
    try:
        source.write_logs(rows, f"{tmp_path}/logs", file_rows=6_000)
    finally:
        conf.unset("parquet.block.size") if before is None else conf.set("parquet.block.size", before)
    day = 1_704_067_200 + 86_400 * 11
    quiet = rows.where(F.col("created_at").between(day, day + 86_399) & (F.col("user_id") != 7)).orderBy("id").first()["user_id"]
    for user in (7, quiet):
        own = source.read_logs(spark, f"{tmp_path}/logs", day, day + 86_399).where(F.col("user_id") == user)
        want = rows.where((F.col("user_id") == user) & F.col("created_at").between(day, day + 86_399)).count()
        assert own.count() == want > 0 and scanned(own.select("id")) < 6_000
    one = rows.where("id = 777").first()["request_id"]
    single = source.read_logs(spark, f"{tmp_path}/logs").where(F.col("request_id") == one)
    assert single.count() == 1 and scanned(single.select("id")) < 20_000
    files = source.read_logs(spark, f"{tmp_path}/logs").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) >= 10 and max(r["count"] for r in files) < 9_000


def test_staged_days_are_deleted(spark, tmp_path):
    path = str(tmp_path / "cube")
    for k in range(2):
        jobs.upsert_cube(spark.createDataFrame([request(k, 90_000 + k)], source.SCHEMA), path, k)
    assert not (tmp_path / "cube.staged").exists() and spark.read.parquet(path).agg(F.sum("count")).first()[0] == 2


USE = "rule string, `group` string, key string, ts bigint, cached_tokens int, hit_tokens int, prompt int, completion int, total int, mode string"


def use(at, key="k"):
    return ("r", "g", key, at, 0, 0, 1, 1, 0, "")


def test_a_use_at_the_end_of_a_session_begins_another(spark):
    got = jobs.cache_sessions(spark.createDataFrame([use(0), use(99), use(199), use(300)], USE), 100).collect()
    assert sorted((r["first_seen"], r["last_seen"], r["total_uses"]) for r in got) == [(0, 99, 2), (199, 199, 1), (300, 300, 1)]


def test_a_streamed_use_at_the_end_of_a_session_begins_another(spark, tmp_path):
    batches = [[use(0), use(99)], [use(199), use(300)], [use(9_000, "z")]]
    got = streamed(spark, batches, USE, tmp_path, lambda uses: jobs.cache_sessions(uses, 100, "50 seconds"))
    assert sorted((r["first_seen"], r["last_seen"], r["total_uses"]) for r in got) == [(0, 99, 2), (199, 199, 1), (300, 300, 1)]


class Kept:
    """A state and its handle in one, for a processor without a stream."""

    def __init__(self):
        self.value, self.writes = None, 0

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        pass

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1


def test_tokens_of_a_shard_give_the_rows_of_each_alone_with_one_state(spark):
    rng = np.random.default_rng(8)
    sums = pd.DataFrame({"token_id": rng.integers(1, 40, 3_000), "model_name": rng.choice(["a", "b", "", None, "z"], 3_000), "bucket": rng.integers(0, 60, 3_000) * 600})
    sums = sums.groupby(["token_id", "model_name", "bucket"], dropna=False, as_index=False).size().drop(columns="size")
    sums = sums.assign(**{c: rng.integers(0, 9, len(sums)) for c in ("requests", "quota", "consumes", "errors", "saturated_rows")}, first_at=sums["bucket"] + 5)

    def fed(part):
        kept, found = Kept(), []
        processor = jobs.RecentWindows(SETTINGS)
        processor.init(kept)
        for low in range(0, 36_000, 9_000):
            own = part[part["bucket"].between(low, low + 8_999)]
            if len(own):
                found += [f.astype(str) for f in processor.handleInputRows((0,), iter([own]), None)]
        return kept.writes, sorted(map(tuple, pd.concat(found).to_numpy().tolist()))

    writes, got = fed(sums)
    assert writes == 4 and got == sorted(r for _, own in sums.groupby("token_id") for r in fed(own)[1])
