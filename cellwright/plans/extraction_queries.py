"""Customers' orders as printed tables, and what five made-up tools extract of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import extraction
from cellwright.plans.evidence_queries import table
from cellwright.session import stored

LABELS = {"1-URGENT": "Urgent orders", "2-HIGH": "High priority orders", "3-MEDIUM": "Medium goods", "4-NOT SPECIFIED": "Unspecified", "5-LOW": "Low value shipments"}
TOOLS = ("whole", "wrapped", "swapped", "unlabelled", "cut")


def printed(spark: SparkSession, d: str) -> DataFrame:
    """custkey, at (which row a tool spoils), rows (label, filled, open) of customers with both kinds of orders; cents, a nil for none."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("p"), (F.col("o_orderstatus") == "F").alias("filled"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    cents = lambda c: F.round(F.sum(F.when(c, F.col("v"))) * 100, 0)
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    by = o.groupBy("custkey", "p").agg(cents(F.col("filled")).alias("f"), cents(~F.col("filled")).alias("o"))
    shown = lambda c: F.coalesce(F.format_number(c, 0), F.lit("-"))
    rows = by.groupBy("custkey").agg(
        F.array_sort(F.collect_list(F.struct("p", F.array(names[F.col("p")], shown("f"), shown("o")).alias("line")))).alias("r"), F.array(F.lit(""), shown(F.sum("f")), shown(F.sum("o"))).alias("total"), F.count("f").alias("nf"), F.count("o").alias("no")
    )
    rows = rows.where("nf > 0 AND no > 0")
    return rows.select("custkey", F.concat(F.transform("r", lambda x: x["line"]), F.array("total")).alias("lines"), (F.col("custkey") % F.size("r")).cast("int").alias("at"))


def extractions(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corrected grids, and a grid a tool: as printed with a note column, one label over two rows, two figures swapped, a
    label lost, a figure cut short."""
    head = F.array(F.array(F.lit(""), F.lit("Filled"), F.lit("Open")))
    gold = tables.select("custkey", F.concat(head, "lines").alias("grid"))
    line, at = F.get("lines", F.col("at")), F.col("at")
    before, after = F.slice("lines", 1, at), F.slice("lines", at + 2, F.size("lines"))
    words = F.split(line[0], " ")
    cut = F.when(F.length(line[1]) > 1, F.left(line[1], F.length(line[1]) - 1)).otherwise(line[1])
    spoilt = {
        "whole": F.array(line), "wrapped": F.array(F.array(words[0], F.lit(""), F.lit("")), F.array(F.array_join(F.slice(words, 2, 5), " "), line[1], line[2])), "swapped": F.array(F.array(line[0], line[2], line[1])),
        "unlabelled": F.array(F.array(F.lit(""), line[1], line[2])), "cut": F.array(F.array(line[0], cut, line[2])),
    }
    noted = lambda rows: F.transform(rows, lambda r, i: F.array(r[0], F.when(r[0] != "", (i + 1).cast("string")).otherwise(""), r[1], F.lit(None).cast("string"), F.concat(F.lit(" "), r[2])))
    grids = F.array(*[F.struct(F.lit(t).alias("tool"), (noted if t == "whole" else lambda x: x)(F.concat(head, before, spoilt[t], after)).alias("grid")) for t in TOOLS])
    return gold, tables.select("custkey", F.inline(grids))


def extraction_scores(spark, d):
    gold, got = extractions(stored(printed(spark, d), "printed"))
    return extraction.extraction_scores(gold, got, ["custkey"], ["tool"])


def extraction_tools(spark, d):
    return extraction.extraction_summary(extraction_scores(spark, d), ["tool"])


def queries() -> dict:
    return {f.__name__: f for f in (extraction_scores, extraction_tools)}


SCORES = """
WITH cents AS (SELECT o_custkey AS custkey, o_orderpriority AS p, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') * 100) AS BIGINT) AS f, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus <> 'F') * 100) AS BIGINT) AS o FROM orders GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY custkey) AS n FROM cents QUALIFY count(f) OVER (PARTITION BY custkey) > 0 AND count(o) OVER (PARTITION BY custkey) > 0),
tables AS (
  SELECT custkey, n AS lines, count(f) + count(o) + 2 AS figures, n + 1 AS rows, custkey % n AS at, max(f) FILTER (i = custkey % n) AS f, max(o) FILTER (i = custkey % n) AS o, max(p) FILTER (i = custkey % n) AS p FROM kept GROUP BY custkey, n
), spoilt AS (
  SELECT *, CASE tool WHEN 'swapped' THEN CASE WHEN f IS NOT DISTINCT FROM o THEN 0 ELSE (f IS NOT NULL)::INT + (o IS NOT NULL)::INT END WHEN 'unlabelled' THEN (f IS NOT NULL)::INT + (o IS NOT NULL)::INT WHEN 'cut' THEN (f IS NOT NULL)::INT ELSE 0 END AS lost
  FROM tables, (VALUES ('whole'), ('wrapped'), ('swapped'), ('unlabelled'), ('cut')) t(tool)
), scores AS (
  SELECT custkey, tool, figures, figures - lost AS found, rows, rows - (lost > 0)::INT AS rows_complete, CASE WHEN tool = 'unlabelled' THEN 0 ELSE lost END AS wrong, CASE WHEN tool = 'unlabelled' THEN lost ELSE 0 END AS unmatched_rows_figures, lost = 0 AS table_complete FROM spoilt
)
"""

SQL: dict[str, str] = {
    "extraction_scores": SCORES + "SELECT * FROM scores",
    "extraction_tools": SCORES + """, sums AS (
  SELECT tool, count(*) AS tables, sum(figures)::BIGINT AS figures, sum(found)::BIGINT AS found, sum(wrong)::BIGINT AS wrong, sum(rows)::BIGINT AS rows, sum(rows_complete)::BIGINT AS rows_complete, count(*) FILTER (table_complete) AS tables_complete FROM scores GROUP BY tool
), shares AS (SELECT *, coalesce(round(found / figures, 4), 0.0) AS found_share, coalesce(round(rows_complete / rows, 4), 0.0) AS rows_complete_share FROM sums)
SELECT *, CAST(row_number() OVER (ORDER BY found_share DESC, tables_complete DESC, tool) AS INTEGER) AS place FROM shares""",
}
