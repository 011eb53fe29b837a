"""Benchmark questions about customers' yearly results, with planted mistakes, and what the checks find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import benchmark
from cellwright.plans.natural_queries import ANSWERS, results
from cellwright.session import stored


def written(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Questions of six kinds, and the cells: right look-ups and growth rates, a wrong difference, an unknown cell, narratives
    without a reference, differences that are typed as growth and expected without unit."""
    rows = stored(results(spark, d), "results")
    cell = lambda y: F.concat(F.lit("c"), y)
    cells = rows.select(F.col("custkey").cast("string").alias("evidence_id"), cell("y").alias("id"), (F.col("r") * 1000).alias("value"), F.lit("amount").alias("kind"), F.lit(3).alias("scale"))
    k, key = F.col("k"), F.col("custkey")
    rows = rows.where("before_y IS NOT NULL").withColumns({"k": (key + F.col("y")) % 6, "d": F.col("r") - F.col("b")}).where("k <> 2 OR b <> 0")
    pair = lambda name: F.concat(F.lit(f"{name}("), cell("y"), F.lit(", "), cell("before_y"), F.lit(")"))
    thousands = lambda v: F.concat(F.lit("Rs. "), F.format_number(v, 0), F.lit(" thousand"))
    growth = F.abs(F.col("d") * 100 / F.when(F.col("b") != 0, F.abs("b")))
    by = lambda *cases: F.coalesce(*[F.when(k == i, c) for i, c in enumerate(cases)])
    none = F.lit(None).cast("string")
    questions = rows.select(
        F.concat(F.lit("reports/"), key, F.lit(".yaml")).alias("file"), F.col("y").alias("row"), F.when(key % 50 == 7, F.concat(F.lit("q"), key)).otherwise(F.concat(F.lit("q"), key, F.lit("-"), "y")).alias("question_id"), key.cast("string").alias("evidence_id"),
        by(F.lit("lookup"), F.lit("difference"), F.lit("growth"), F.lit("lookup"), F.lit("narrative"), F.lit("growth")).alias("type"), by(cell("y"), pair("diff"), pair("growth"), F.lit("c1899"), none, pair("diff")).alias("program"),
        by(thousands(F.abs("r")), thousands(F.abs("d") + 3), F.concat(F.format_number(growth, 1), F.lit("%")), F.lit("1"), F.when(key % 2 == 1, "It grew."), F.format_number(F.abs("d"), 0)).alias("expect"),
        F.when(key % 4 != 2, "ann").alias("author"), F.when(key % 4 == 1, "ann").when(key % 4 != 2, "ben").alias("checked_by"), (key % 3 == 0).alias("pilot"), F.when(key % 5 == 0, "dev").when(key % 5 == 1, "test").alias("split"), F.lit("LK").alias("country"),
    )
    return stored(questions, "questions"), cells


def benchmark_findings(spark, d):
    return benchmark.benchmark_findings(*written(spark, d))


def benchmark_counts(spark, d):
    return benchmark.benchmark_counts(*written(spark, d))


def queries() -> dict:
    return {f.__name__: f for f in (benchmark_findings, benchmark_counts)}


WRITTEN = ANSWERS + """, questions AS (
  SELECT *, 'reports/' || c || '.yaml' AS file, CASE WHEN c % 50 = 7 THEN 'q' || c ELSE 'q' || c || '-' || y END AS question_id, CASE k WHEN 0 THEN 'lookup' WHEN 1 THEN 'difference' WHEN 2 THEN 'growth' WHEN 3 THEN 'lookup' WHEN 4 THEN 'narrative' ELSE 'growth' END AS type,
    CASE c % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' END AS split, 'diff(c' || y || ', c' || before_y || ')' AS diff FROM pairs WHERE k <> 2 OR b <> 0
), told AS (
  SELECT file, question_id, 'error' AS level, 'duplicate question id (also in ' || before || ')' AS message FROM (SELECT *, lag(file) OVER (PARTITION BY question_id ORDER BY file, y) AS before FROM questions) WHERE before IS NOT NULL
  UNION ALL SELECT file, question_id, 'warning', 'narrative question without a reference answer in ''expect''' FROM questions WHERE k = 4 AND c % 2 = 0
  UNION ALL SELECT file, question_id, 'error', 'answer expression ''c1899'' fails: unknown cell c1899' FROM questions WHERE k = 3
  UNION ALL SELECT file, question_id, 'error', 'expect ''' || CASE k WHEN 1 THEN 'Rs. ' || format('{:,}', abs(d) + 3) || ' thousand' ELSE format('{:,}', abs(d)) END || ''' does not match the cells: ' || diff || ' = ' || d * 1000 || ' (amount, base units)' FROM questions WHERE k = 1 OR (k = 5 AND d < 0)
  UNION ALL SELECT file, question_id, 'warning', 'type ''growth'' but the answer expression looks like ''difference''' FROM questions WHERE k = 5
  UNION ALL SELECT file, question_id, 'warning', CASE c % 4 WHEN 2 THEN 'not cross-checked: author and checked_by are both required' ELSE 'checked by its own author' END FROM questions WHERE k NOT IN (3, 4) AND c % 4 IN (1, 2)
  UNION ALL SELECT file, question_id, 'error', 'pilot questions must come from dev issuers; this one is test' FROM questions WHERE k NOT IN (3, 4) AND c % 3 = 0 AND split = 'test'
)
"""

SQL: dict[str, str] = {
    "benchmark_findings": WRITTEN + "SELECT * FROM told",
    "benchmark_counts": WRITTEN + "SELECT 'LK' AS country, coalesce(split, 'unassigned') AS split, type, count(*) AS n FROM questions WHERE k <> 3 GROUP BY ALL",
}
