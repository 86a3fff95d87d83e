"""Tables that a job writes to cut its lineage, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir``.

    A written table survives the loss of any executor and of its shuffle files. Where a session on one machine names
    no checkpoint folder (tests), one is made and set; on a cluster such a folder would be out of executors' reach.
    """

    def __init__(self, spark: SparkSession, name: str):
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.checkpoint.dir", top)
        self.spark, self.top = spark, f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made, self.tables = 0, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        self.made += 1
        path = f"{self.top}/{self.made:03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        self.tables.append(table)
        return table

    def only(self, *needed: DataFrame) -> None:
        """Deletes all tables written here but those that a result still reads."""
        paths = {t._scratch_path for t in needed}
        self.drop(*(t for t in self.tables if t._scratch_path not in paths))

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step and no result reads."""
        for table in tables:
            self.tables = [t for t in self.tables if t is not table]
            where = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
