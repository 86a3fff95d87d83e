"""Sources and sinks of request logs: month-partitioned Parquet, JSON lines and Kafka."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: The 20 columns in their fixed order.
_TEXT = ("content", "username", "token_name", "model_name", "group", "ip", "request_id", "upstream_request_id", "other")
_WIDE = {"created_at": T.LongType(), "quota": T.LongType(), "is_stream": T.BooleanType()} | dict.fromkeys(_TEXT, T.StringType())
_ORDER = (
    "id", "user_id", "created_at", "type", "content", "username", "token_name", "model_name", "quota", "prompt_tokens", "completion_tokens",
    "use_time", "is_stream", "channel_id", "token_id", "group", "ip", "request_id", "upstream_request_id", "other",
)
SCHEMA = T.StructType([T.StructField(name, _WIDE.get(name, T.IntegerType())) for name in _ORDER])
#: JSON names that differ from the column names.
JSON_NAMES = {"channel_id": "channel"}
MONTH = "yyyymm"


def month() -> Column:
    return F.date_format(F.timestamp_seconds("created_at"), "yyyyMM")


def read_logs(spark: SparkSession, path: str, start: int = 0, end: int = 0) -> DataFrame:
    """Logs under ``path``; a time range prunes month partitions before any file is read."""
    rows = spark.read.schema(T.StructType([*SCHEMA, T.StructField(MONTH, T.StringType())])).option("basePath", path).parquet(path)
    for limit, op in ((start, "ge"), (end, "le")):
        if limit:
            name = F.date_format(F.timestamp_seconds(F.lit(limit)), "yyyyMM")
            rows = rows.where((F.col(MONTH) >= name) & (F.col("created_at") >= limit) if op == "ge" else (F.col(MONTH) <= name) & (F.col("created_at") <= limit))
    return rows.select(*SCHEMA.names)


#: Rows of a file, some 100 MB.
FILE_ROWS = 1_000_000


def write_logs(logs: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> int:
    """Appends logs in the fixed column order, one folder a month, and returns their number. A repeated write repeats rows
    and loses none.

    Rows are ranged by month, user and time (by a sample of them), so that files follow the volume, a busy user's rows
    go to several, and those of one user and day lie in few row groups, which the statistics of the others rule out. A
    Bloom filter of request ids in each row group answers for single requests. ``logs`` is computed once and kept on the
    executors' disks: to count, to sample and to write.
    """
    rows = logs.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in SCHEMA)).withColumn(MONTH, month())
    order = (MONTH, "user_id", "created_at")
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        total = rows.count()
        files = -(-total // file_rows)
        if not files:
            return 0
        bloom = {"parquet.bloom.filter.enabled#request_id": "true", "parquet.bloom.filter.expected.ndv#request_id": str(file_rows)}
        ranged = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
        ranged.write.mode(mode).options(**bloom).option("maxRecordsPerFile", 2 * file_rows).partitionBy(MONTH).parquet(path)
        return total
    finally:
        rows.unpersist()


def append_new(logs: DataFrame, path: str, late: int = 3_600, file_rows: int = FILE_ROWS) -> None:
    """Appends the logs whose request_id the table at ``path`` lacks, each id once; S5 fills empty ids first.

    A redelivered record has its first one's time, so only rows of the same times are asked: those of the last ``late``
    seconds by the newest log, and apart from them, for logs that come later than that, those between the times of
    such logs in their months. Nothing else is kept, so no state grows, and a batch that is written again after a
    failure adds only what is missing. The table has one writer at a time.
    """
    rows = with_request_id(logs).dropDuplicates(["request_id"])
    rows = rows.persist()
    try:
        newest = rows.agg(F.max("created_at")).first()[0]
        if newest is None:
            return
        recent = F.col("created_at") > newest - late
        ends = [end(F.when(part, F.col("created_at"))) for part in (recent, ~recent) for end in (F.min, F.max)]
        ends = rows.agg(*(x.alias(f"c{k}") for k, x in enumerate(ends))).first()
        found = []
        for part, low, high in ((rows.where(recent), *ends[:2]), (rows.where(~recent), *ends[2:])):
            if low is None:
                continue
            try:
                known = read_logs(logs.sparkSession, path, low, high).select("request_id")
            except AnalysisException as missing:  # the first batch finds no table
                if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                found.append(part)
            else:
                found.append(part.join(known, "request_id", "left_anti"))
        new = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        write_logs(new, path, file_rows=file_rows)
    finally:
        rows.unpersist()


def decode_json(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(logs, undecodable) of one JSON object a row. The raw text of a bad row stays, so that it can be counted."""
    wire = T.StructType([T.StructField(JSON_NAMES.get(f.name, f.name), f.dataType) for f in SCHEMA] + [T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.col(value).cast("string").alias("raw")).withColumn("row", F.from_json("raw", wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull()
    good = parsed.where(~bad).select(*(F.col(f"row.{JSON_NAMES.get(f.name, f.name)}").alias(f.name) for f in SCHEMA))
    return good, parsed.where(bad).select("raw")


def encode_json(logs: DataFrame) -> DataFrame:
    """One JSON object a row, under the wire's names, in column ``value``."""
    return logs.select(F.to_json(F.struct(*(F.col(f"`{f.name}`").cast(f.dataType).alias(JSON_NAMES.get(f.name, f.name)) for f in SCHEMA))).alias("value"))


def with_request_id(logs: DataFrame) -> DataFrame:
    """Fills an empty request_id with a hash of the row, so that a redelivered row gets the same one."""
    own = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in logs.columns if c != "request_id"))), 256)
    return logs.withColumn("request_id", F.when(F.coalesce(F.col("request_id"), F.lit("")) == "", own).otherwise(F.col("request_id")))


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of Kafka records from the earliest offset; offsets commit with the checkpoint of the writing query."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines from a folder, in place of Kafka."""
    return spark.readStream.schema("value string").format("text").load(path)
