"""Structured Streaming jobs over log streams. Each has the body of its batch form, so that both give the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from meterlake.functions.scalars import ratio
from meterlake.operators import abuse as A
from meterlake.operators import usage as U
from meterlake.operators.logs import saturated
from meterlake.sources.logs import append_new, decode_json, write_logs


def upsert_cube(batch: DataFrame, path: str, batch_id: int, writer: str = "") -> None:
    """Adds a batch's cube rows to the table at ``path``, day by day; late rows land in their old hour.

    Only the day partitions that the batch touches are rewritten, and each keeps the batch and the writer that last
    did so: a day that has the batch already is left alone when the batch is replayed. Days are staged beside the table
    first, since a partition can't be overwritten while it is read, and the staged rows are deleted when they are in the
    table. A table has one writer at a time.
    """
    spark = batch.sparkSession
    day = F.expr("created_at div 86400")
    delta = U.hourly_cube(batch).withColumn("day", day)
    days = [r[0] for r in delta.select("day").distinct().collect()]  # a batch touches few days
    if not days:
        return
    marks = {"batch": F.lit(batch_id).cast("bigint"), "writer": F.lit(writer)}
    try:
        state = spark.read.parquet(path).where(F.col("day").isin(days)).select(*delta.columns, *marks)
    except Exception as missing:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        state = delta.limit(0).withColumns(marks)
    done = state.where((F.col("writer") == writer) & (F.col("batch") >= batch_id)).select("day").distinct().collect()
    left = [d for d in days if d not in {r[0] for r in done}]
    if not left:
        return
    fresh = lambda df: df.where(F.col("day").isin(left)).select(*delta.columns)
    total = U.upsert_add(fresh(state), fresh(delta), [*U.CUBE_KEY, "day"], U.MEASURES).withColumns(marks)
    staged = f"{path.rstrip('/')}.staged/{writer or 'cube'}-{batch_id}"
    total.write.mode("overwrite").parquet(staged)
    spark.read.schema(total.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.staged")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stream_cube(logs: DataFrame, path: str, writer: str = "") -> DataStreamWriter:
    """The hourly cube of a log stream, kept at ``path``. A replayed batch counts once; a stream that starts over with a new
    checkpoint needs a ``writer`` name of its own."""
    return logs.writeStream.foreachBatch(lambda batch, batch_id: upsert_cube(batch, path, batch_id, writer))


def perf_buckets(samples: DataFrame, size: int = 60, late: str = "0 seconds") -> DataFrame:
    """Counters by event-time bucket, emitted once the watermark has passed it; later samples are dropped.

    ``samples`` streams the columns of health.bucket_counters with ts in unix seconds.
    """
    timed = samples.where("model != ''").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    ttft, spoken = F.col("has_ttft") & (F.col("ttft_ms") >= 0), (F.col("output_tokens") > 0) & (F.col("generation_ms") > 0)
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    group = F.coalesce(F.nullif(F.col("group"), F.lit("")), F.lit("default"))
    counts = timed.groupBy(F.window("at", f"{size} seconds").alias("w"), F.col("model").alias("model_name"), group.alias("group")).agg(
        F.count("*").alias("request_count"), F.count_if("success").alias("success_count"), total(F.col("latency_ms") > 0, "latency_ms").alias("total_latency_ms"), total(ttft, "ttft_ms").alias("ttft_sum_ms"),
        F.count_if(ttft).alias("ttft_count"), total(spoken, "output_tokens").alias("output_tokens"), total(spoken, "generation_ms").alias("generation_ms"))
    return counts.select("model_name", "group", F.unix_seconds("w.start").alias("bucket_ts"), *counts.columns[3:])


def cache_sessions(uses: DataFrame, ttl: int, late: str | None = None) -> DataFrame:
    """Cache statistics by rule, group and key over sessions that end ``ttl`` seconds after their last use: a use at that
    very moment begins the next one.

    Columns: rule, group, key, ts, cached_tokens, hit_tokens, prompt, completion, total, mode ('' is none). Rows
    without rule or key are left out. ``late`` is the watermark of a stream.
    """
    rows = uses.where((F.trim("rule") != "") & (F.trim("key") != "")).withColumn("at", F.timestamp_seconds("ts"))
    rows = rows if late is None else rows.withWatermark("at", late)
    modes = F.collect_set(F.nullif(F.col("mode"), F.lit("")))
    total = F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("prompt") + F.col("completion"))
    # windows that touch are merged, so a gap is a microsecond short of ttl
    out = rows.groupBy(F.session_window("at", f"{ttl * 1_000_000 - 1} microseconds").alias("w"), F.trim("rule").alias("rule"), F.trim("group").alias("group"), F.trim("key").alias("key")).agg(
        F.count("*").alias("total_uses"), F.count_if((F.col("cached_tokens") > 0) | (F.col("hit_tokens") > 0)).alias("hits"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"), F.sum(total).alias("total_tokens"), F.max("ts").alias("last_seen"), modes.alias("modes"))
    mode = F.when(F.size("modes") > 1, "mixed").when(F.size("modes") == 1, F.col("modes")[0]).otherwise("")
    return out.withColumn("mode", mode).select("rule", "group", "key", F.unix_seconds("w.start").alias("first_seen"), "last_seen", "total_uses", "hits", "cached_tokens", "prompt_tokens", "completion_tokens", "total_tokens", "mode")


def without_repeats(logs: DataFrame, path: str, late: int = 3_600) -> DataStreamWriter:
    """Writes a log stream to the table at ``path`` without redelivered records: one row per request_id, however late it
    comes. The table itself says which ids came before; see ``append_new``."""
    return logs.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, late))


def blocked(rows: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """(key, at, row, block, own) of rows (key, at, row): blocks of ``size`` seconds by the time that they begin with.

    The last ``halo`` seconds of a block are in the next one too, without ``row`` and with own = false; ``halo`` is at
    most ``size``. Rows without a time share a block that is null.
    """
    place = F.pmod(F.col("at"), F.lit(size))
    block = F.col("at") - place
    both = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + size).alias("block"), F.lit(False).alias("own")))
    blocks = F.when(place >= size - halo, both).otherwise(F.slice(both, 1, 1))
    return rows.select("*", F.inline(blocks)).withColumn("row", F.when(F.col("own"), F.col("row")))


def sliding_counts(rows: DataFrame, seconds: int, key: str = "user_id", blocks: int = 8) -> DataFrame:
    """Each row with the requests of its key in the last ``seconds`` (age n excluded), itself and equal times included.

    A key's time is cut into blocks of ``blocks`` times ``seconds``, each with the last window of the block before, so
    that a busy key is counted by many tasks. Rows without a time count those of their key that have none either.
    """
    keyed = rows.select(F.col(key).alias("key"), F.col("created_at").cast("bigint").alias("at"), F.struct(*rows.columns).alias("row"))
    near = Window.partitionBy("key", "block").orderBy("at").rangeBetween(-(seconds - 1), 0)
    counted = blocked(keyed, blocks * seconds, seconds - 1).withColumn("recent", F.count("*").over(near))
    return counted.where("own").select(*(F.col("row")[c].alias(c) for c in rows.columns if c != "recent"), "recent")


def stream_sliding_counts(rows: DataFrame, seconds: int, slide: int, late: str = "0 seconds", key: str = "user_id") -> DataFrame:
    """Requests of each key in windows of ``seconds`` that begin every ``slide``, once ``late`` has passed since their end.
    Sums are made before the shuffle, so a busy key sends a row a window and task."""
    timed = rows.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", f"{seconds} seconds", f"{slide} seconds").alias("w"), key).agg(F.count("*").alias("recent"))
    return counts.select(key, F.unix_seconds("w.start").alias("start"), "recent")


def _admitted(times, most: int, seconds: int, accepted: deque[int]) -> list[bool]:
    """Which requests in time order are accepted; ``accepted`` holds the accepted times of the window and is updated."""
    out = []
    for t in times:
        while accepted and t - accepted[0] >= seconds:
            accepted.popleft()
        ok = len(accepted) < most
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def with_segments(rows: DataFrame, seconds: int, blocks: int = 64) -> DataFrame:
    """Adds ``segment`` to rows (key, at, row): the time after its key's last pause of ``seconds`` or more.

    Pauses are found in blocks of ``blocks`` times ``seconds`` of a key; what a block needs of those before it, their
    last request and last pause, comes from a table of one row a block. So no task sees the whole of a busy key.
    """
    size = blocks * seconds
    cut = rows.withColumn("block", F.col("at") - F.pmod(F.col("at"), F.lit(size)))
    inner = Window.partitionBy("key", "block").orderBy("at")
    own = cut.withColumn("gap", F.col("at") - F.lag("at").over(inner))
    pause = F.when(F.col("gap") >= seconds, F.col("at"))
    ends = own.groupBy("key", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max(pause).alias("pause"))
    blocked = Window.partitionBy("key").orderBy("block")
    waited = F.col("first") - F.lag("last").over(blocked)
    opened = F.when(waited.isNull() | (waited >= seconds), F.col("first"))
    ends = ends.withColumn("opened", opened)
    inherited = F.lag(F.coalesce("pause", "opened")).over(blocked)
    ends = ends.withColumn("inherited", inherited)
    ends = ends.withColumn("begin", F.coalesce("opened", F.last("inherited", True).over(blocked.rowsBetween(Window.unboundedPreceding, 0))))
    marked = own.withColumn("own_pause", F.max(pause).over(inner.rangeBetween(Window.unboundedPreceding, 0)))
    joined = marked.join(ends.select(F.col("key").alias("k"), F.col("block").alias("b"), "begin"), F.col("key").eqNullSafe(F.col("k")) & F.col("block").eqNullSafe(F.col("b")))
    return joined.select("key", "at", "row", F.coalesce("own_pause", "begin").alias("segment"))


def replay_admission(requests: DataFrame, most: int, seconds: int, key: str = "user_id", order: str = "id") -> DataFrame:
    """(key, order, created_at, accepted): accept while under ``most`` accepted ones lie in the last ``seconds``.

    Decisions depend on earlier ones, but none on those before a pause of ``seconds``: a key is cut there, and its
    segments go to different tasks. A segment's rows stream through in Arrow batches, in order; the state is ``most``
    times. A key that never pauses is one sequence, which costs time, not memory. Rows without a time are left out.
    """
    rows = requests.select(F.col(key).cast("bigint").alias("key"), F.col("created_at").cast("bigint").alias("at"), F.col(order).cast("bigint").alias("row")).where("at is not null")
    rows = with_segments(rows, seconds).repartition("key", "segment").sortWithinPartitions("key", "segment", "at", "row")
    schema = f"{key} bigint, {order} bigint, created_at bigint, accepted boolean"

    def run(batches):
        now, accepted = None, deque()
        for batch in batches:
            column, times = batch.column(0), batch.column(2).to_pylist()
            keys, none, segments = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            new = (keys[1:] != keys[:-1]) | (none[1:] != none[:-1]) | (segments[1:] != segments[:-1])
            starts = [0, *(np.flatnonzero(new) + 1).tolist()] if times else []
            decided = []
            for low, high in zip(starts, [*starts[1:], len(times)], strict=False):
                own = (keys[low], none[low], segments[low])
                if own != now:
                    now, accepted = own, deque()
                decided += _admitted(times[low:high], most, seconds, accepted)
            yield pa.RecordBatch.from_arrays([column, batch.column(3), batch.column(2), pa.array(decided, pa.bool_())], names=[key, order, "created_at", "accepted"])

    return rows.select("key", "segment", "at", "row").mapInArrow(run, schema)


class Admission(StatefulProcessor):
    """The same replay on a stream: the accepted times of a key are its state."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle) -> None:
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues):
        accepted = deque(self.times.get()[0] if self.times.exists() else [])
        for part in rows:
            part = part.sort_values(["created_at", "id"])
            decided = _admitted(list(part["created_at"]), self.most, self.seconds, accepted)
            yield pd.DataFrame({"user_id": part["user_id"].astype("int64"), "id": part["id"].astype("int64"), "created_at": part["created_at"].astype("int64"), "accepted": decided})
        self.times.update((list(accepted),))

    def close(self) -> None:
        pass


def stream_admission(requests: DataFrame, most: int, seconds: int) -> DataFrame:
    """Needs the RocksDB state store; rows of one batch are taken in time order, batches as they come."""
    return requests.select("user_id", "id", "created_at").groupBy("user_id").transformWithStateInPandas(Admission(most, seconds), "user_id bigint, id bigint, created_at bigint, accepted boolean", "append", "none")


def stream_logs(lines: DataFrame, path: str, dropped: Callable[[int], None] | None = None) -> DataStreamWriter:
    """Writes decoded lines to month partitions batch by batch; offsets move on after the write. Undecodable lines are
    counted and reported to ``dropped``."""

    def write(batch: DataFrame, _: int) -> None:
        written = write_logs(decode_json(batch)[0], path)
        if dropped:
            dropped(batch.count() - written)

    return lines.writeStream.foreachBatch(write)


def abuse_windows(logs: DataFrame, window: int, late: str = "1 hour") -> DataFrame:
    """Window counts of tokens as a tumbling stream, emitted once ``late`` has passed since the window's end by the newest
    log's time; feeds abuse.baselines batch by batch. A log that comes later than that is in no window."""
    timed = logs.where("token_id > 0").withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    consume = F.col("type") == 2
    clamp = consume & F.coalesce(F.col("other").contains('"quota_saturation":'), F.lit(False))
    counts = timed.groupBy("token_id", F.window("at", f"{window} seconds").alias("w")).agg(
        F.count("*").alias("requests"), F.count_if(consume).alias("consumes"), F.coalesce(F.sum(F.when(consume, F.col("quota"))), F.lit(0)).alias("quota"), F.count_if(F.col("type") == 5).alias("errors"),
        F.count_if(clamp).alias("saturated_rows"), F.coalesce(F.sum(F.when(clamp, F.col("quota"))), F.lit(0)).alias("saturated_quota"))
    return counts.select("token_id", F.unix_seconds("w.start").alias("bucket"), *counts.columns[2:])


#: Columns of a closed window and those before it.
RECENT = {
    **dict.fromkeys(("token_id", "bucket", "requests", "quota", "consumes", "errors", "base_consumes", "base_errors", "excluded_rows"), "bigint"),
    **dict.fromkeys(("base_requests", "base_quota"), "array<bigint>"), "fresh": "array<struct<model_name: string, first_at: bigint>>",
}


#: Groups of tokens that share a state; a stream that goes on from a checkpoint keeps its number.
SHARDS = 256


class RecentWindows(StatefulProcessor):
    """The last windows of a shard's tokens as its state; each closed window gives one row with those before it.

    Rows come as sums of (window, model), all of a window at once and windows in order. Kept are the sums of the windows
    that later ones may ask for, and when a token last used each model; what is older goes whenever the shard has new
    windows, and all of it by a timer. All tokens of a shard are looked up together, in arrays.
    """

    SUMS = ("token_id", "bucket", "requests", "quota", "consumes", "errors", "saturated_rows", "named")

    def __init__(self, s: A.Settings):
        self.s = s
        #: seconds from the beginning of the lookback to the end of its window
        self.back = -A.bounds(0, s)[3]

    def init(self, handle) -> None:
        self.handle = handle
        #: rows of SUMS; rows of (token, place in models, last bucket)
        self.kept = handle.getValueState("kept", "windows binary, uses binary, models array<string>")

    def handleInputRows(self, key, rows, timerValues):
        s = self.s
        part = pd.concat(list(rows), ignore_index=True)
        has = (part["model_name"] != "") & part["model_name"].notna()
        named, part["named"] = part[has], part["requests"].where(has, 0)
        new = part.groupby(["token_id", "bucket"], as_index=False)[list(self.SUMS[2:])].sum()
        old, uses, models = self.kept.get() if self.kept.exists() else (b"", b"", [])
        windows = np.concatenate([np.frombuffer(old, np.int64).reshape(-1, len(self.SUMS)), new[list(self.SUMS)].to_numpy(np.int64)])
        windows = windows[np.lexsort((windows[:, 1], windows[:, 0]))]
        last_uses = pd.DataFrame(np.frombuffer(uses, np.int64).reshape(-1, 3), columns=["token_id", "model_name", "bucket"])
        last_uses["model_name"] = np.array(models, object)[last_uses["model_name"].to_numpy()] if len(last_uses) else last_uses["model_name"].astype(object)

        # a place for each (token, window), far enough apart that no window before a token's first is another token's
        token, bucket = windows[:, 0], windows[:, 1]
        low, room = int(bucket.min()), max(s.baseline * s.window, self.back)
        span = (int(bucket.max()) - low + room) // s.window + 2
        code = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]]))
        place = code * span + (bucket - low + room) // s.window
        newest = pd.MultiIndex.from_arrays([token, bucket]).isin(pd.MultiIndex.from_frame(new[["token_id", "bucket"]]))
        here = np.flatnonzero(newest)
        asked = place[here, None] + np.arange(-s.baseline, 0)
        at = np.minimum(np.searchsorted(place, asked), len(place) - 1)
        before = np.where((place[at] == asked)[..., None], windows[at], 0)
        sums = np.concatenate([[0], np.cumsum(windows[:, 7])])
        total = sums[here + 1] - sums[np.searchsorted(place, place[here] + 1 - self.back // s.window)]

        named = named.assign(new=True)[["token_id", "model_name", "bucket", "first_at", "new"]]
        every = pd.concat([last_uses.assign(first_at=0, new=False), named]).sort_values(["token_id", "model_name", "bucket"], kind="stable")
        since = every.groupby(["token_id", "model_name"])["bucket"].shift()
        first = every[every["new"].astype(bool) & ~(since >= every["bucket"] + s.window - self.back)]
        fresh: dict[tuple[int, int], list] = {}
        for t, w, m, f in zip(first["token_id"].tolist(), first["bucket"].tolist(), first["model_name"].tolist(), first["first_at"].tolist(), strict=True):
            fresh.setdefault((t, w), []).append({"model_name": m, "first_at": f})

        now = windows[here]
        out = pd.DataFrame(now[:, :6], columns=list(RECENT)[:6])
        out["base_consumes"], out["base_errors"] = before[:, :, 4].sum(1), before[:, :, 5].sum(1)
        out["excluded_rows"] = now[:, 6] + before[:, :, 6].sum(1)
        out["base_requests"], out["base_quota"] = list(before[:, :, 2]), list(before[:, :, 3])
        out["fresh"] = [fresh.get((t, w), []) if n >= s.gate_requests else [] for t, w, n in zip(now[:, 0].tolist(), now[:, 1].tolist(), total.tolist(), strict=True)]

        end = int(bucket.max()) + s.window  # no later window begins before it
        held = windows[bucket >= end - max(s.baseline * s.window, self.back - s.window)]
        left = every[every["bucket"] >= end + s.window - self.back].drop_duplicates(["token_id", "model_name"], keep="last")
        codes, names = pd.factorize(left["model_name"])
        used = np.column_stack([left["token_id"].to_numpy(np.int64), codes.astype(np.int64), left["bucket"].to_numpy(np.int64)])
        self.kept.update((np.ascontiguousarray(held).tobytes(), used.tobytes(), [str(m) for m in names]))
        self.handle.registerTimer((end + room) * 1000)
        yield out[list(RECENT)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.kept.exists():
            windows = np.frombuffer(self.kept.get()[0], np.int64).reshape(-1, len(self.SUMS))
            room = max(self.s.baseline * self.s.window, self.back)
            if not len(windows) or (int(windows[:, 1].max()) + self.s.window + room) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def recent_windows(logs: DataFrame, s: A.Settings = A.Settings(), late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """A row for each token and closed window with requests: the columns of abuse.baselines before the medians, and
    ``fresh``, the models that the token first used in it by the lookback.

    Sums of (token, window, model) are made first, so that a busy token's logs are added up where they are read; a
    window closes ``late`` after its end by the newest log's time, and later logs are in no window. Tokens are dealt into
    ``shards`` by a hash, so that state is read and written once a shard, not once a token. Needs the RocksDB state
    store. The lookback must be a whole number of windows.
    """
    if s.lookback % s.window or s.most_span % s.window:
        raise ValueError("the lookback and its limit must be whole numbers of windows")
    timed = logs.where("token_id > 0").withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    consume = F.col("type") == 2
    clamp = consume & F.coalesce(saturated(), F.lit(False))
    sums = timed.groupBy(F.col("token_id").cast("bigint").alias("token_id"), "model_name", F.window("at", f"{s.window} seconds").alias("w")).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum(F.when(consume & ~clamp, F.col("quota"))), F.lit(0)).cast("bigint").alias("quota"), F.count_if(consume).alias("consumes"),
        F.count_if(F.col("type") == 5).alias("errors"), F.count_if(clamp).alias("saturated_rows"), F.min("created_at").alias("first_at"))
    shard = F.pmod(F.xxhash64("token_id"), F.lit(shards)).alias("shard")
    rows = sums.select(shard, "token_id", "model_name", F.unix_seconds("w.start").alias("bucket"), *sums.columns[3:], "w")
    return rows.groupBy("shard").transformWithStateInPandas(RecentWindows(s), ", ".join(f"{name} {kind}" for name, kind in RECENT.items()), "append", "eventTime")


def stream_findings(logs: DataFrame, s: A.Settings = A.Settings(), late: str = "1 hour") -> DataFrame:
    """(token_id, bucket, rule, severity, current, baseline, ratio, direction, excluded_rows, model_name, first_at):
    the findings of each window as it closes, those of abuse.detect right after the window's end."""
    rows = A.measured(recent_windows(logs, s, late), s)
    number, none = F.lit(None).cast("double"), F.lit(None)
    spiked = F.transform(A.spikes(s), lambda x: F.struct(x["rule"].alias("rule"), x["severity"].alias("severity"), x["current"].alias("current"), x["baseline"].alias("baseline"), ratio(x["current"], x["baseline"]).alias("ratio"), F.lit("up").alias("direction"), F.col("excluded_rows").alias("excluded_rows"), none.cast("string").alias("model_name"), none.cast("bigint").alias("first_at")))
    fresh = F.transform("fresh", lambda x: F.struct(F.lit("new_model").alias("rule"), F.lit("medium").alias("severity"), number.alias("current"), number.alias("baseline"), number.alias("ratio"), F.lit("new").alias("direction"), none.cast("bigint").alias("excluded_rows"), x["model_name"].alias("model_name"), x["first_at"].alias("first_at")))
    return rows.select("token_id", "bucket", F.inline(F.concat(spiked, fresh)))
