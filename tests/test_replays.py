"""Queries that replay samples as streams, over tables of several files."""

import duckdb
import pytest
from pyspark.sql import Row, functions as F

from meterlake.operators import abuse
from meterlake.plans import NOW, SQL, START, streams
from meterlake.sources import logs, samples


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Six copies of the smallest events, for other users, a file each."""
    path = str(tmp_path_factory.mktemp("tables"))
    events = samples.table(spark, "/root/testdata/sf0.001", "events")
    for k in range(6):
        events.withColumns({"event_id": F.col("event_id") + 1_000_000 * k, "user_id": F.col("user_id") + 1_000_000 * k}).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return path


def test_the_last_log_closes_no_window_before_the_others_came(spark, tables):
    got = streams.r7_abuse_windows(spark, tables)
    want = abuse.window_counts(samples.logs(spark, tables), START, NOW + 86_400, 86_400)
    assert sorted(r["requests"] for r in got.collect()) == sorted(r["requests"] for r in want.collect())
    assert got.select("token_id", "bucket", "requests", "quota").exceptAll(want.select("token_id", "bucket", "requests", "quota")).count() == 0


def test_findings_of_logs_without_token_one_are_whole(spark, tmp_path):
    """Whichever tokens have logs, the last days' windows close."""
    con = duckdb.connect()
    for name, key in (("events", "user_id"), ("customer", "c_custkey")):
        rows = samples.table(spark, "/root/testdata/sf0.001", name)
        rows.withColumn(key, F.col(key) + 1_000).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(SQL["r7_abuse_findings"])
    columns = [c[0] for c in want.description]
    got = streams.r7_abuse_findings(spark, str(tmp_path))
    assert sorted(map(str, got.select(*columns).collect())) == sorted(str(Row(**dict(zip(columns, r, strict=True)))) for r in want.fetchall())


def test_a_replayed_batch_has_files_by_its_rows(spark):
    """No task reads more than a file holds, however many rows a batch has."""
    rows = spark.range(8 * streams.REPLAYED_ROWS + 1)
    _, path = streams.replayed(spark, rows, batches=4)
    counts = [r["count"] for r in spark.read.parquet(f"{path}/in").groupBy(F.input_file_name()).count().collect()]
    assert len(counts) == 12 and max(counts) <= streams.REPLAYED_ROWS


def test_logs_are_decoded_once_to_be_written(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    logs.write_logs(samples.logs(spark, "/root/testdata/sf0.001").limit(500).transform(lambda r: r.mapInArrow(seen, r.schema)), str(tmp_path / "logs"))
    assert read.value == 500 and logs.read_logs(spark, str(tmp_path / "logs")).count() == 500


def test_batches_in_turn_are_read_once_and_all_taken(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 600, 1, 3).withColumn("batch", (F.col("id") % 4).cast("int"))
    count = lambda logs: logs.where("id % 2 = 0")
    got = streams.in_turn(spark, rows.mapInArrow(seen, rows.schema), count)
    assert read.value == 600 and sorted(r["id"] for r in got.collect()) == list(range(0, 600, 2))
    assert streams.in_turn(spark, rows.limit(0), count).count() == 0


def test_logs_before_the_first_batch_come_with_it(spark):
    rows = spark.createDataFrame([(1, START - 5 * 86_400), (2, START), (3, NOW + 99 * 86_400)], "id bigint, created_at bigint")
    assert [r["batch"] for r in streams.in_time(rows, 5, 3_000).orderBy("id").collect()] == [0, 0, 5]
