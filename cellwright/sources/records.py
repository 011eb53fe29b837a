"""Strict JSON Lines, file digests, and tables that are built once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON Lines of one schema; a line that doesn't parse or has another field fails the job. Blank lines are skipped."""
    schema = T.StructType.fromDDL(ddl)
    lines = spark.read.text(path).where(F.trim("value") != "")
    extra = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(f.name) for f in schema.fields]))
    known = F.when(F.json_object_keys("value").isNull(), F.raise_error(F.concat(F.lit("not a record: "), F.col("value")))).when(
        F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.concat_ws(", ", extra)))
    )
    record = F.from_json(F.coalesce(known.cast("string"), F.col("value")), schema, {"mode": "FAILFAST"})
    return lines.select(record.alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes the rows and returns how many they are, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256, lines of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"))


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None) -> DataFrame:
    """The Parquet table at ``path``; built and written if it is not there yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.parquet(path)


def append_new(source: DataFrame, path: str, key: str) -> int:
    """Appends to a JSON Lines sink the rows whose key it does not hold; returns how many."""
    from cellwright.operators.splits import todo

    spark = source.sparkSession
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    rows = todo(source, spark.read.schema(source.schema).json(path), key) if there else source
    return write_jsonl(rows, path, "append")


def annotations(tasks: DataFrame) -> DataFrame:
    """Labels of an annotation export: one row a finished annotation's choice (item_id, annotator, name, choice)."""
    done = tasks.select(F.col("data.item_id").alias("item_id"), F.explode("annotations").alias("a")).where("NOT coalesce(a.was_cancelled, false)")
    return done.select("item_id", F.col("a.completed_by").alias("annotator"), F.explode("a.result").alias("r")).select("item_id", "annotator", F.col("r.from_name").alias("name"), F.explode("r.value.choices").alias("choice"))
