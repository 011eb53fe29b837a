"""The session that the engine is tested with (on a cluster, the submitted configuration holds), and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


#: Rows that one task sorts or groups at once, about.
TASK_ROWS = 1 << 20


def parts_of(rows: DataFrame, most: int | None = None) -> int:
    """In how many partitions rows are dealt, so that these grow in number and not in size; never fewer than the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (most or TASK_ROWS)))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by key over ``parts`` partitions; without a number, as the session deals them."""
    return rows if parts is None else rows.repartition(parts, *keys)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder that spark.checkpoint.dir names; one of its own only where all executors are in this
    process."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{sc.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
