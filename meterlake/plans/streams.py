"""Queries of streaming jobs: each runs a real stream over files derived from the samples until it is drained."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from meterlake.operators import usage as U
from meterlake.operators.logs import with_owner
from meterlake.plans import NOW, START, query
from meterlake.plans import abuse as P
from meterlake.plans.health import COUNTERS
from meterlake.plans.usage import CUBE
from meterlake.sources import logs as L
from meterlake.sources import samples as S
from meterlake.streaming import jobs as R

LOG = S.with_(S.LOGS)


def folder(spark) -> str:
    """A new folder where the cluster's executors and driver can both read."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


#: Rows of a replayed file: a batch has as many files as it takes, so that no task writes or reads more.
REPLAYED_ROWS = 100_000


def replayed(spark, rows: DataFrame, batches: int = 1) -> tuple[DataFrame, str]:
    """(stream, folder): ``rows`` as a file stream of one batch or several, each with rows of all kinds."""
    path = folder(spark)
    files = -(-rows.count() // (batches * REPLAYED_ROWS)) or 1
    rows.repartition(files * batches).write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in"), path


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that a stream emits, as a table; the stream ends when its input does."""
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True)
    writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def in_turn(spark, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that the stream ``make`` emits over ``rows``, whose column ``batch`` deals them into batches that come one after
    the other. All are written in one pass, by as many tasks as read them; the stream takes a batch whole, stops when it
    has no more, and goes on from its checkpoint when the next one has come."""
    path = folder(spark)
    rows.write.partitionBy("batch").parquet(f"{path}/written")
    schema, at = rows.drop("batch").schema, spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at(f"{path}/in"))
    out = spark.createDataFrame([], make(spark.readStream.schema(schema).parquet(f"{path}/written")).schema)
    written = {s.getPath().getName() for s in files.listStatus(at(f"{path}/written"))}
    for k in sorted(int(name[6:]) for name in written if re.fullmatch(r"batch=\d+", name)):
        files.rename(at(f"{path}/written/batch={k}"), at(f"{path}/in/{k}"))
        out = drained(make(spark.readStream.schema(schema).parquet(f"{path}/in/*")), path)
    return out


@query(LOG + """, good AS (SELECT * FROM logs WHERE id % 10 <> 0)
  SELECT type, count(*) AS rows, CAST(sum(quota) AS BIGINT) AS quota, CAST(sum(channel_id) AS BIGINT) AS channels,
  (SELECT count(*) FROM logs WHERE id % 10 = 0) AS bad FROM good GROUP BY 1""")
def s2_decode(spark, sf_dir):
    """Every tenth line is broken."""
    lines = L.encode_json(S.logs(spark, sf_dir).where("id % 10 != 0")).unionByName(
        S.logs(spark, sf_dir).where("id % 10 = 0").select(
            F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "quota')).alias("value")
        )
    )
    good, bad = L.decode_json(lines)
    return good.groupBy("type").agg(
        F.count("*").alias("rows"), F.sum("quota").alias("quota"), F.sum("channel_id").alias("channels")
    ).join(F.broadcast(bad.agg(F.count("*").alias("bad"))), F.lit(True))


@query(LOG + """SELECT strftime(make_timestamp(created_at * 1000000), '%Y%m') AS yyyymm, count(*) AS rows,
  count(DISTINCT request_id) AS ids, CAST(sum(prompt_tokens) AS BIGINT) AS prompt FROM logs GROUP BY 1""")
def s1_s3_s4_stream_sink(spark, sf_dir):
    """Lines as a stream, decoded, written to month partitions, and read back."""
    path = folder(spark)
    L.encode_json(S.logs(spark, sf_dir)).repartition(4).write.text(f"{path}/in")
    R.stream_logs(
        L.file_lines(spark, f"{path}/in"), f"{path}/logs"
    ).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = L.read_logs(spark, f"{path}/logs", start=1, end=2_000_000_000)
    return rows.groupBy(F.date_format(F.timestamp_seconds("created_at"), "yyyyMM").alias("yyyymm")).agg(
        F.count("*").alias("rows"), F.count_distinct("request_id").alias("ids"), F.sum("prompt_tokens").alias("prompt")
    )


@query(LOG + """SELECT type, count(*) AS rows, CAST(sum(quota) AS BIGINT) AS quota,
  (SELECT count(*) FROM logs WHERE id % 10 < 2) AS dropped FROM logs WHERE id % 10 > 1 GROUP BY 1""")
def s3_kafka_records(spark, sf_dir):
    """Records as a Kafka source gives them, in four batches: of every ten one has no value and one is cut off, and
    both are counted as dropped."""
    rows = S.logs(spark, sf_dir)
    cut = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "quota'))
    values = L.encode_json(rows.where("id % 10 > 1")).unionByName(rows.where("id % 10 < 2").select(F.when(F.col("id") % 10 == 1, cut).alias("value")))
    records = values.select(
        F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("logs").alias("topic"),
        F.spark_partition_id().alias("partition"), F.monotonically_increasing_id().alias("offset"), F.lit(NOW).cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    stream, path = replayed(spark, records, batches=4)
    dropped: list[int] = []
    R.stream_logs(stream, f"{path}/logs", dropped.append).option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return L.read_logs(spark, f"{path}/logs").groupBy("type").agg(
        F.count("*").alias("rows"), F.sum("quota").alias("quota"), F.lit(sum(dropped)).cast("bigint").alias("dropped")
    )


@query(S.with_(S.LOGS, CUBE) + "SELECT * FROM cube")
def r1_stream_cube(spark, sf_dir):
    """The cube of four batches equals that of one."""
    stream, path = replayed(spark, S.logs(spark, sf_dir), batches=4)
    R.stream_cube(stream, f"{path}/cube").option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/cube").select(*U.CUBE_KEY, *U.MEASURES)


@query(S.with_(S.SAMPLES, COUNTERS) + """SELECT * FROM counters WHERE bucket_ts + 300 <= (SELECT max(ts) FROM samples
  WHERE model <> '')""")
def r2_perf_buckets(spark, sf_dir):
    """Only complete buckets are emitted: those that end by the last sample's time."""
    stream, path = replayed(spark, S.samples(spark, sf_dir))
    return drained(R.perf_buckets(stream, 300), path)


SESSIONS = """, u AS (SELECT 'rule-' || (channel_id % 2) AS rule, "group" AS grp, 'key-' || user_id AS key,
  created_at AS ts, CASE WHEN id % 3 = 0 THEN id % 70 ELSE 0 END AS cached, prompt_tokens AS p,
  completion_tokens AS c, CASE WHEN id % 4 = 0 THEN '' WHEN user_id % 5 = 0 AND id % 2 = 1 THEN 'b'
  ELSE 'a' END AS mode FROM logs WHERE type = 2),
  g AS (SELECT *, CASE WHEN ts - lag(ts) OVER k < 36000 THEN 0 ELSE 1 END AS new
  FROM u WINDOW k AS (PARTITION BY rule, grp, key ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY rule,
  grp, key ORDER BY ts) AS n FROM g)
  SELECT rule, grp AS "group", key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS total_uses,
  count(*) FILTER (cached > 0) AS hits, CAST(sum(cached) AS BIGINT) AS cached_tokens,
  CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
  CAST(sum(p + c) AS BIGINT) AS total_tokens,
  CASE WHEN count(DISTINCT NULLIF(mode, '')) > 1 THEN 'mixed' ELSE COALESCE(max(NULLIF(mode, '')), '') END AS mode
  FROM s GROUP BY rule, grp, key, n"""


def cache_uses(logs: DataFrame) -> DataFrame:
    i, u = F.col("id"), F.col("user_id")
    return logs.where("type = 2").select(S.text("rule-", F.col("channel_id") % 2).alias("rule"), "group", S.text("key-", u).alias("key"), F.col("created_at").alias("ts"), F.when(i % 3 == 0, i % 70).otherwise(0).alias("cached_tokens"), F.lit(0).alias("hit_tokens"),
        F.col("prompt_tokens").alias("prompt"), F.col("completion_tokens").alias("completion"), F.lit(0).alias("total"), F.when(i % 4 == 0, "").when((u % 5 == 0) & (i % 2 == 1), "b").otherwise("a").alias("mode"))


@query(LOG + SESSIONS)
def r3_cache_sessions(spark, sf_dir):
    return R.cache_sessions(cache_uses(S.logs(spark, sf_dir)), 36_000)


@query(LOG + SESSIONS)
def r3_stream_sessions(spark, sf_dir):
    """The same sessions from a stream of six batches with late uses, at an allowance of an hour; sessions go on over
    batches, and one more use, of user 0 long after, lets all others end."""
    last = last_log(spark, sf_dir).withColumns({"user_id": F.lit(0).cast("bigint"), "type": F.lit(2)})
    rows = S.logs(spark, sf_dir)
    timed = in_time(rows.unionByName(last.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns))), 5, 3_000)
    return in_turn(spark, timed, lambda logs: R.cache_sessions(cache_uses(logs), 36_000, "1 hour"))


@query(LOG + "SELECT type, count(*) AS rows, CAST(sum(quota) AS BIGINT) AS quota FROM logs GROUP BY 1")
def r4_without_repeats(spark, sf_dir):
    """Every third record is delivered twice; the four batches hold rows of all times, so that later ones come late."""
    rows = S.logs(spark, sf_dir)
    stream, path = replayed(spark, rows.unionByName(rows.where("id % 3 = 0")), batches=4)
    R.without_repeats(stream, f"{path}/logs").option(
        "checkpointLocation", f"{path}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return L.read_logs(spark, f"{path}/logs").groupBy("type").agg(
        F.count("*").alias("rows"), F.sum("quota").alias("quota")
    )


@query(LOG + """SELECT id, count(*) OVER (PARTITION BY user_id
  ORDER BY created_at RANGE BETWEEN 43199 PRECEDING AND CURRENT ROW) AS recent FROM logs""")
def r5_sliding_counts(spark, sf_dir):
    return R.sliding_counts(S.logs(spark, sf_dir), 43_200).select("id", "recent")


@query(LOG + """, w AS (SELECT user_id, created_at // 10800 * 10800 - k * 10800 AS start FROM logs, range(4) r(k))
  SELECT user_id, start, count(*) AS recent FROM w GROUP BY 1, 2""")
def r5_stream_counts(spark, sf_dir):
    """Windows of twelve hours that begin every three, from six batches with late logs."""
    logs = S.logs(spark, sf_dir).unionByName(last_log(spark, sf_dir)).select("id", "user_id", "created_at")
    return in_turn(spark, in_time(logs, 5, 3_000), lambda logs: R.stream_sliding_counts(logs, 43_200, 10_800, "1 hour"))


@query(LOG.replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT user_id, id, created_at,
  row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS n FROM logs),
  s AS (SELECT user_id, id, created_at, n, true AS accepted, [created_at] AS times FROM r WHERE n = 1
    UNION ALL SELECT user_id, id, created_at, n, len(live) < 3, CASE
    WHEN len(live) < 3 THEN list_append(live, created_at) ELSE live END
    FROM (SELECT r.*, list_filter(s.times, lambda x: r.created_at - x < 86400) AS live FROM s
    JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
  SELECT user_id, id, created_at, accepted FROM s""")
def r6_admission(spark, sf_dir):
    """Each decision depends on those before it: the oracle walks each user's requests in turn."""
    return R.replay_admission(S.logs(spark, sf_dir), 3, 86_400)


def last_log(spark, sf_dir):
    """One log of some token long after all others, whose window stays open: it lets the windows before it close."""
    rows = S.logs(spark, sf_dir)
    return rows.where("token_id > 0").orderBy("id").limit(1).withColumn(
        "created_at", F.lit(NOW + 100 * 86_400).cast("bigint")
    )


@query(LOG + f""", c AS (SELECT token_id, created_at // 86400 * 86400 AS bucket, count(*) AS requests,
  count(*) FILTER (type = 2) AS consumes, CAST(COALESCE(sum(quota) FILTER (type = 2), 0) AS BIGINT) AS quota,
  count(*) FILTER (type = 5) AS errors, CAST(0 AS BIGINT) AS saturated_rows, CAST(0 AS BIGINT) AS saturated_quota
  FROM logs WHERE token_id > 0 GROUP BY 1, 2)
  SELECT * FROM c""")
def r7_abuse_windows(spark, sf_dir):
    """Five batches with rows of all times: the allowance covers the whole month, so that no late log is lost. The log
    that lets all windows close comes after them, in a batch of its own."""
    rows = S.logs(spark, sf_dir)
    dealt = rows.withColumn("batch", F.pmod("id", F.lit(5)).cast("int")).unionByName(last_log(spark, sf_dir).withColumn("batch", F.lit(5)))
    return in_turn(spark, dealt, lambda logs: R.abuse_windows(logs, 86_400, "40 days"))


def in_time(rows: DataFrame, parts: int, late: int) -> DataFrame:
    """``rows`` with ``batch``, by time, but for every third one of the last ``late`` seconds before a batch ends, which
    comes with the next batch."""
    width = -(-(NOW + 86_400 - START) // parts)
    place = F.expr(f"(created_at - {START}) div {width}")
    delayed = (F.col("id") % 3 == 0) & ((F.col("created_at") - START) % width >= width - late)
    batch = F.least(F.when(delayed, place + 1).otherwise(place), F.lit(parts))
    return rows.withColumn("batch", F.when(batch < 0, 0).otherwise(batch).cast("int"))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocks(spark, run):
    """Runs a stream with the state store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return run()
    finally:
        spark.conf.set(PROVIDER, before)


D = P.DAYS
#: the rules of each day with requests: every day of the month is the current one in turn
EVERY_DAY = f"""counts AS (SELECT token_id, created_at // 86400 * 86400 AS bucket, count(*) AS requests,
  count(*) FILTER (type = 2) AS consumes, CAST(COALESCE(sum(quota) FILTER (type = 2), 0) AS BIGINT) AS quota,
  count(*) FILTER (type = 5) AS errors FROM logs WHERE token_id > 0 GROUP BY 1, 2),
  base AS (SELECT n.token_id, n.bucket, median(COALESCE(b.requests, 0)) AS median_requests,
  median(COALESCE(b.quota, 0)) AS median_quota, count(*) FILTER (b.requests >= {D.gate_requests}) < {D.gate_windows} AS gated,
  CAST(COALESCE(sum(b.consumes), 0) AS BIGINT) AS base_consumes, CAST(COALESCE(sum(b.errors), 0) AS BIGINT) AS base_errors
  FROM counts n CROSS JOIN range(1, 7) s(k) LEFT JOIN counts b
  ON b.token_id = n.token_id AND b.bucket = n.bucket - k * 86400 GROUP BY 1, 2),
  joined AS (SELECT * FROM base JOIN counts USING (token_id, bucket)),
  {P.SPIKES.replace("SELECT token_id,", "SELECT token_id, bucket,")},
  used AS (SELECT token_id, model_name, created_at // 86400 * 86400 AS bucket, min(created_at) AS first_at, count(*) AS n
  FROM logs WHERE token_id > 0 AND model_name <> '' GROUP BY 1, 2, 3),
  totals AS (SELECT n.token_id, n.bucket, sum(b.n) AS total FROM (SELECT DISTINCT token_id, bucket FROM used) n
  JOIN used b ON b.token_id = n.token_id AND b.bucket <= n.bucket AND b.bucket >= n.bucket + 86400 - {D.lookback}
  GROUP BY 1, 2),
  fresh AS (SELECT * FROM used u JOIN totals USING (token_id, bucket) WHERE total >= {D.gate_requests} AND NOT EXISTS (
  SELECT 1 FROM used b WHERE b.token_id = u.token_id AND b.model_name = u.model_name AND b.bucket < u.bucket
  AND b.bucket >= u.bucket + 86400 - {D.lookback})),
  found AS (SELECT token_id, bucket, rule, severity, current, baseline, COALESCE(current / NULLIF(baseline, 0), 0) AS ratio,
  'up' AS direction, NULL AS model_name, CAST(NULL AS BIGINT) AS first_at FROM f
  UNION ALL SELECT token_id, bucket, 'new_model', 'medium', NULL, NULL, NULL, 'new', model_name, first_at FROM fresh)"""


@query(S.with_(S.LOGS, EVERY_DAY, S.TOKENS, S.USERS) + """SELECT token_id, bucket, rule, severity, current, baseline, ratio,
  direction, model_name, first_at, tokens.name AS token_name, users.username AS owner_name FROM found
  LEFT JOIN tokens ON token_id = tokens.id LEFT JOIN users ON tokens.user_id = users.id""")
def r7_abuse_findings(spark, sf_dir):
    """All days' findings as a stream of six batches with late logs, at the allowance of an hour, and their owners."""
    timed = in_time(S.logs(spark, sf_dir).unionByName(last_log(spark, sf_dir)), 5, 3_000)
    found = with_rocks(spark, lambda: in_turn(spark, timed, lambda logs: R.stream_findings(logs, D)))
    owned = with_owner(found, S.tokens(spark, sf_dir), S.users(spark, sf_dir))
    return owned.select("token_id", "bucket", "rule", "severity", "current", "baseline", "ratio", "direction", "model_name", "first_at", "token_name", "owner_name")
