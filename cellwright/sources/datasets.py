"""Question sets, gold stores and manifests: nested files as flat rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.sources.records import file_digests

# What the parts of a gold store are called.
GOLD = ("questions", "labels", "injections")
# Operations of step programs and what each one is in an expression.
STEPS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
ROWS = {"table_sum": "sum", "table_average": "avg"}
FINQA = """array<struct<id:string,filename:string,pre_text:array<string>,post_text:array<string>,`table`:array<array<string>>,
 qa:struct<question:string,program:string,answer:string,exe_ans:string,gold_inds:map<string,string>>>>"""


def step_questions(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a table, text before and after it and a step program: question_id, issuer, grid, title, passages, program,
    exe_ans (null where it is no number), percent, gold_rows."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", FINQA)).alias("d")).select("d.*")
    passages = F.filter(F.concat("pre_text", "post_text"), lambda s: ~F.trim(s).isin("", "."))
    gold = F.transform(F.filter(F.map_keys("qa.gold_inds"), lambda k: F.startswith(k, F.lit("table_"))), lambda k: F.split_part(k, F.lit("_"), F.lit(2)).try_cast("int"))
    return rows.select(
        F.col("id").alias("question_id"), F.concat(F.lit("finqa:"), F.split_part("filename", F.lit("/"), F.lit(1))).alias("issuer"), F.col("table").alias("grid"), F.array_join(F.slice("pre_text", F.greatest(F.size("pre_text") - 2, F.lit(1)), 3), " ").alias("title"),
        passages.alias("passages"), F.col("qa.question").alias("question"), F.col("qa.program").alias("program"), F.col("qa.exe_ans").try_cast("double").alias("exe_ans"), F.coalesce(F.contains("qa.answer", F.lit("%")), F.lit(False)).alias("percent"),
        F.coalesce(gold, F.array().cast("array<int>")).alias("gold_rows"),
    )


def matched_operands(operands: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell that printed each operand (question_id, evidence_id, nth, value, question, gold_rows): exactly or else by size; of gold
    rows where any fits, then with the period and line item that the question names, then the first."""
    found = operands.join(cells.where("raw IS NOT NULL").select("evidence_id", "id", "row", "metric", "period", "raw", "seq"), "evidence_id")
    found = found.where(F.abs(F.col("raw").cast("double")) == F.abs(F.col("value").cast("double"))).withColumn("exact", F.col("raw").cast("double") == F.col("value").cast("double"))
    asked = F.lower("question")
    named = F.coalesce(F.contains(asked, F.col("period")).cast("int"), F.lit(0)) + F.coalesce(F.contains(asked, F.col("metric")).cast("int"), F.lit(0))
    gold = F.coalesce(F.array_contains("gold_rows", F.col("row")), F.lit(False))
    best = Window.partitionBy("question_id", "nth").orderBy(F.desc("exact"), F.desc(gold), F.desc(named), "seq")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("question_id", "nth", "id", (~F.col("exact") & (F.col("raw") < 0)).alias("by_size"))


def step_operands(programs: DataFrame) -> DataFrame:
    """The arguments of step programs (question_id, program): step, op, nth (over all steps), arg, and its number if it is one."""
    steps = F.regexp_extract_all("program", F.lit(r"(\w+)\(([^()]*)\)"), F.lit(0))
    rows = programs.select("question_id", F.posexplode(steps).alias("step", "s")).select("question_id", "step", F.regexp_extract("s", r"^(\w+)\(", 1).alias("op"), F.split(F.regexp_extract("s", r"\((.*)\)$", 1), ",").alias("args"))
    rows = rows.select("question_id", "step", "op", F.size("args").alias("n_args"), F.posexplode("args").alias("place", "arg")).withColumn("arg", F.trim("arg"))
    number = F.when(~F.col("arg").rlike(r"^(#|const_)"), F.regexp_replace("arg", "%", "").try_cast("decimal(38,10)"))
    return rows.select("*", (F.col("step") * 100 + F.col("place")).alias("nth"), number.alias("value"))


def converted_programs(operands: DataFrame, matches: DataFrame, row_cells: DataFrame) -> DataFrame:
    """question_id, expression, used: step programs in the cell expression language; null with operations that have no equal.

    ``operands`` come from ``step_operands``, ``matches`` from ``matched_operands``, ``row_cells``: question_id, metric, ids. References
    to earlier steps are put in by one pass over a program's steps.
    """
    rows = operands.join(matches, ["question_id", "nth"], "left")
    plain = F.regexp_replace(F.col("value").cast("string"), r"\.?0+$", "")
    cell = F.when(F.col("by_size"), F.concat(F.lit("abs("), "id", F.lit(")"))).otherwise(F.col("id"))
    text = (
        F.when(F.startswith("arg", F.lit("#")), F.col("arg")).when(F.col("arg") == "const_m1", "-1").when(F.startswith("arg", F.lit("const_")), F.substr("arg", F.lit(7)))
        .when(F.col("id").isNotNull(), cell).when(F.col("value") < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain)
    )
    steps = rows.groupBy("question_id", "step", "op", "n_args").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text"), "arg"))).alias("parts"), F.count(text).alias("known"), F.array_compact(F.collect_list("id")).alias("ids"))
    whole = row_cells.select("question_id", F.col("metric").alias("row_metric"), F.col("ids").alias("row_ids"))
    name = F.lower(F.trim(F.col("parts")[0]["arg"]))
    steps = steps.join(whole, ["question_id"], "left").where(F.col("row_metric").isNull() | F.col("row_metric").eqNullSafe(F.lower(F.trim(F.col("parts")[0]["arg"]))) | ~F.col("op").isin(*ROWS))
    steps = steps.withColumn("of_row", F.col("op").isin(*ROWS) & F.col("row_metric").eqNullSafe(name)).dropDuplicates(["question_id", "step"])
    sign = F.create_map(*[F.lit(x) for two in STEPS.items() for x in two])
    call = F.create_map(*[F.lit(x) for two in ROWS.items() for x in two])
    two = F.concat(F.col("parts")[0]["text"], F.lit(" "), sign[F.col("op")], F.lit(" "), F.get("parts", F.lit(1))["text"])
    said = F.when(F.col("op").isin(*STEPS) & (F.col("n_args") == 2) & (F.col("known") == 2), two).when(F.col("of_row"), F.concat(call[F.col("op")], F.lit("("), F.array_join("row_ids", ", "), F.lit(")")))
    by = steps.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("step", said.alias("said")))).alias("steps"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("of_row"), F.col("row_ids")).otherwise(F.col("ids"))))).alias("used"))
    put = lambda acc, s: F.concat(acc, F.array(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(acc) - 1, F.lit(0))), s["said"], lambda t, i: F.replace(t, F.concat(F.lit("#"), i.cast("string")), F.concat(F.lit("("), F.coalesce(F.get(acc, i), F.lit("")), F.lit(")"))))))
    built = F.aggregate("steps", F.array().cast("array<string>"), put)
    whole_known = F.forall("steps", lambda s: s["said"].isNotNull())
    return by.select("question_id", F.when(whole_known, F.try_element_at(built, F.lit(-1))).alias("expression"), F.when(whole_known, F.col("used")).alias("used"))


def response_items(responses: DataFrame, sources: DataFrame, split: str | None = None) -> DataFrame:
    """Answers joined to what they were written from: item_id, question, passage, text, generator, status, spans."""
    rows = responses if split is None else responses.where(F.col("split") == split)
    both = rows.join(sources, "source_id")
    qa = F.col("task_type") == "QA"
    question = F.when(qa, F.coalesce("question", F.lit(""))).when(F.col("task_type") == "Summary", "Summarise the passage.").otherwise("Describe the structured data.")
    return both.select(
        F.concat(F.lit("ragtruth:"), F.col("id").cast("string")).alias("item_id"), question.alias("question"), F.col("passage"), F.col("response").alias("text"), F.col("model").alias("generator"), F.when(F.size("labels") > 0, "incorrect").otherwise("correct").alias("status"), F.col("labels").alias("spans")
    )


def save_gold(parts: dict[str, DataFrame], path: str) -> None:
    """Questions, labels and injections as three tables below a folder."""
    for name in GOLD:
        parts[name].write.mode("overwrite").json(f"{path}/{name}")


def load_gold(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schemas[name]).json(f"{path}/{name}") for name in GOLD}


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_grid(texts: pd.Series) -> pd.Series:
    """The ragged rows of a CSV text; a byte order mark is no part of it."""
    import csv
    import io

    return texts.map(lambda t: list(csv.reader(io.StringIO((t or "").removeprefix("﻿")))))


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """path, table_id (the file's name) and grid of every CSV file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("table_id"), csv_grid(F.decode("content", "UTF-8")).alias("grid"))


def drifted(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files whose size or sha256 is not what the manifest (name, bytes, sha256) says, and files that are missing or not listed."""
    found = file_digests(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha256"))
    both = manifest.join(found, "name", "full")
    state = F.when(F.col("f_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when((F.col("sha256") != F.col("f_sha256")) | (F.col("bytes") != F.col("f_bytes")), "changed")
    return both.select("name", state.alias("state")).where("state IS NOT NULL")


def outputs(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON Lines (plain or compressed) of every system's folder below a path, with the system and the kind of output."""
    rows = spark.read.schema(ddl).option("recursiveFileLookup", "true").json(path).withColumn("_file", F.input_file_name())
    return rows.withColumns({"system": F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), "kind": F.regexp_extract("_file", r"([^/]+?)\.jsonl(\.gz)?$", 1)}).drop("_file")


def round_robin(issuers: DataFrame, counts: dict[str, int], rest: str = "train") -> DataFrame:
    """country, issuer, split: sectors of a country take turns in hash order, and splits take turns until each is full."""
    own = Window.partitionBy("country", "sector").orderBy(F.sha2(F.col("issuer").cast("string"), 256), "issuer")
    turn = Window.partitionBy("country").orderBy("nth", "sector")
    rows = issuers.withColumn("nth", F.row_number().over(own)).withColumn("turn", F.row_number().over(turn))
    order = sorted(((k, i, s) for i, (s, n) in enumerate(counts.items()) for k in range(n)))
    dealt = F.array(*[F.lit(s) for _, _, s in order])
    return rows.select("country", "issuer", F.coalesce(F.get(dealt, F.col("turn") - 1), F.lit(rest)).alias("split"))


