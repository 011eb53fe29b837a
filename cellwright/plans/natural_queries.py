"""Natural answers about customers' yearly results: how they score, and why a person must read them.

A customer's result of a year is what it ordered for, in thousands, less a threshold, so about half of all are losses. A question
asks how the result changed on the customer's year before, or for the ratio of both; answers come in wordings that are right
for some results and wrong for others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.operators import claims as C
from cellwright.operators import natural, scoring, triage
from cellwright.plans.evidence_queries import table
from cellwright.session import stored

THRESHOLD = 200


def results(spark: SparkSession, d: str) -> DataFrame:
    """custkey, y, r (thousands), and before_y, b: the customer's year before."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1000, 0).cast("long").alias("s"))
    w = Window.partitionBy("custkey").orderBy("y")
    o = o.withColumn("r", F.col("s") - THRESHOLD)
    return o.select("custkey", "y", "r", F.lag("y").over(w).alias("before_y"), F.lag("r").over(w).alias("b"))


def world(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells, questions, gold values and answers."""
    rows = stored(results(spark, d), "results")
    text = lambda c: F.col(c).cast("string")
    cells = rows.select(
        text("custkey").alias("evidence_id"), F.lit("t1").alias("table_id"), F.concat(F.lit("c"), "y").alias("id"), F.lit("net result").alias("metric"), F.lit("group").alias("entity"), text("y").alias("period"),
        F.col("r").cast("double").alias("raw"), (F.col("r") * 1000).cast("double").alias("value"), F.lit(3).alias("scale"), F.lit("amount").alias("kind"), F.lit("Net result").alias("row_label"),
    )
    pairs = rows.where("before_y IS NOT NULL").withColumns({"k": (F.col("custkey") + F.col("y")) % 6, "a_id": F.concat(F.lit("c"), "y"), "b_id": F.concat(F.lit("c"), "before_y"), "d": F.col("r") - F.col("b"), "question_id": F.concat_ws(":", "custkey", "y")})
    ratio = F.col("k") == 4
    pairs = pairs.where("k <> 4 OR b <> 0")
    questions = pairs.select("question_id", text("custkey").alias("evidence_id"), F.when(ratio, F.concat("a_id", F.lit(" / "), "b_id")).otherwise(F.concat(F.lit("diff("), "a_id", F.lit(", "), "b_id", F.lit(")"))).alias("program"))
    value = lambda nth, role, kind, v, cell: F.struct(F.lit(nth).alias("nth"), F.lit(role).alias("role"), kind.alias("kind"), v.cast("double").alias("value"), cell.alias("cell"))
    amount, none = F.lit("amount"), F.lit(None).cast("string")
    answer = value(0, "answer", F.when(ratio, "ratio").otherwise("amount"), F.when(ratio, F.col("r") / F.when(F.col("b") != 0, F.col("b"))).otherwise(F.col("d") * 1000), none)
    gold = pairs.select("question_id", F.inline(F.array(answer, value(1, "operand", amount, F.col("r") * 1000, F.col("a_id")), value(2, "operand", amount, F.col("b") * 1000, F.col("b_id")))))
    said = lambda c: F.concat(F.lit("Rs. "), F.format_number(F.abs(c), 0), F.lit(" thousand"))
    k, moved = F.col("k"), said(F.col("d"))
    body = (
        F.when(k == 0, F.concat(F.lit("The net result changed by "), moved)).when(k == 1, F.concat(F.lit("The net result rose by "), moved)).when(k == 2, F.concat(F.lit("The net loss decreased by "), moved))
        .when(k == 3, F.concat(F.lit("The net loss was "), said(F.col("r")))).when(k == 4, F.concat(F.lit("The ratio was "), F.format_number(F.round(F.col("r") * 100 / F.when(F.col("b") != 0, F.col("b")), 0), 0), F.lit("%")))
        .otherwise(F.concat(F.lit("The net result was "), said(F.col("r") + 7)))
    )
    j = F.col("custkey") % 5
    tail = F.when(j == 0, ".").when(j == 1, F.concat(F.lit(" in "), "y", F.lit("."))).when(j == 2, F.concat(F.lit(" in "), "before_y", F.lit("."))).when(j == 3, ", driven by demand.").otherwise(". Figures are in millions.")
    items = pairs.select(
        F.col("question_id").alias("item_id"), "question_id", text("custkey").alias("evidence_id"), F.concat(body, tail).alias("text"), F.lit("How did the net result change?").alias("question"),
        F.when(ratio, "ratio").when(k == 5, "comparison").otherwise("difference").alias("question_type"), (F.col("custkey") % 7 == 0).alias("thinking_leak"), F.array(F.lit(3)).alias("scales"), F.array(F.lit("LKR")).alias("currencies"),
    )
    return cells, questions, gold, stored(items, "answers")


def scored_texts(spark, d):
    """States of all answers, read as natural ones and as template ones."""
    cells, questions, gold, items = world(spark, d)
    read = scoring.score_both(items, gold, natural.question_contexts(questions, gold, cells))
    return read.select("item_id", "state", "template_state", F.array_join("wrong", "; ").alias("wrong"))


def triage_reasons(spark, d):
    cells, questions, gold, items = world(spark, d)
    return triage.triage_reasons(items, questions, gold, cells, C.vocabularies(cells)).select("item_id", "state", F.array_join("reasons", "; ").alias("reasons"))


def queries() -> dict:
    return {f.__name__: f for f in (scored_texts, triage_reasons)}


# what each wording claims (v, in units; loss: a loss is named; up or down: its word of movement), held against the gold values
ANSWERS = """
WITH years AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 1000) AS BIGINT) - 200 AS r FROM orders GROUP BY ALL),
pairs AS (SELECT *, r - b AS d, (c + y) % 6 AS k, c % 5 AS j FROM (SELECT *, lag(y) OVER w AS before_y, lag(r) OVER w AS b FROM years WINDOW w AS (PARTITION BY c ORDER BY y)) WHERE b IS NOT NULL),
claims AS (
  SELECT *, c || ':' || y AS item_id, CASE k WHEN 0 THEN abs(d) WHEN 1 THEN abs(d) WHEN 2 THEN abs(d) WHEN 3 THEN abs(r) WHEN 4 THEN round(r * 100 / b) ELSE abs(r + 7) END AS v, CASE k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS way,
    CASE WHEN k = 2 AND r < 0 AND b < 0 THEN sign(abs(r) - abs(b)) ELSE sign(d) END AS moved FROM pairs WHERE k <> 4 OR b <> 0
), hits AS (
  SELECT *, CASE WHEN k = 4 THEN r * b > 0 AND v > 0 WHEN way <> 0 AND moved <> 0 THEN way = moved WHEN way <> 0 THEN way * v = d WHEN k = 3 THEN -v = d ELSE v = d END AS answer,
    k <> 4 AND CASE WHEN way <> 0 THEN way * v WHEN k = 3 THEN -v ELSE v END = r AS now, k <> 4 AND CASE WHEN way <> 0 THEN way * v WHEN k = 3 THEN -v ELSE v END = b AS base,
    k <> 4 AND CASE WHEN way <> 0 THEN way * v ELSE v END IN (d, r, b) AS plain_hit, k <> 4 AND CASE WHEN way <> 0 THEN way * v ELSE v END = d AS plain_answer FROM claims
), states AS (
  SELECT *, CASE WHEN answer THEN 'supported_useful' WHEN now OR base THEN 'supported_unhelpful' ELSE 'unsupported' END AS state,
    CASE WHEN plain_answer THEN 'supported_useful' WHEN plain_hit THEN 'supported_unhelpful' ELSE 'unsupported' END AS template_state FROM hits
)
"""

SQL: dict[str, str] = {
    "scored_texts": ANSWERS + """SELECT item_id, state, template_state, CASE WHEN state <> 'unsupported' THEN '' WHEN k = 4 THEN format('{:,}', CAST(v AS BIGINT)) || '%' ELSE 'Rs. ' || format('{:,}', CAST(v AS BIGINT)) || ' thousand' END AS wrong FROM states""",
    "triage_reasons": ANSWERS + """SELECT item_id, state, CASE WHEN k = 5 THEN 'comparison question' ELSE array_to_string(list_filter([
    CASE WHEN c % 7 = 0 THEN 'thinking leak' END, CASE state WHEN 'unsupported' THEN 'a number the gold values do not cover' WHEN 'supported_unhelpful' THEN 'no number states the answer' END,
    CASE WHEN j = 3 THEN 'an explanation or judgement' END,
    CASE WHEN state = 'supported_useful' AND way <> 0 AND way <> moved THEN 'a direction word the scorer cannot check' END,
    CASE WHEN state = 'supported_useful' AND j = 2 AND k <> 4 THEN 'a year that is not its figure''s' END,
    CASE WHEN state = 'supported_useful' AND k IN (2, 3) AND ((now AND r > 0) OR (base AND b > 0)) THEN '''loss'' beside a figure that is not one' END,
    CASE WHEN state = 'supported_useful' AND j = 4 THEN 'a unit the tables do not use' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM states""",
}
