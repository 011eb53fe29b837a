"""Review operators on the star schema: order lines stand for claims, tokens and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import metrics, review
from cellwright.plans.evidence_queries import table
from cellwright.session import parts_of

YEARS = [str(y) for y in range(1992, 1999)]


def _claims(spark, d):
    start = F.col("l_linenumber").cast("int") * 3
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("int").alias("claim_id"), F.when(F.col("l_linenumber") % 2 == 0, "percent").otherwise("amount").alias("kind"),
        (F.col("l_linestatus") == "F").alias("directional"), (F.col("l_suppkey") % 3).cast("string").alias("metric"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("entity"),
        F.when(F.col("l_discount") >= 0.08, "unsupported").otherwise("supported").alias("verdict"), start.alias("start"), (start + 2).alias("end"), F.col("l_discount").cast("double").alias("p"), (F.col("l_suppkey") % 3).cast("string").alias("slot"),
    )


CLAIMS = """
WITH claims AS (
  SELECT l_orderkey AS item_id, CAST(l_linenumber AS INTEGER) AS claim_id, CASE WHEN l_linenumber % 2 = 0 THEN 'percent' ELSE 'amount' END AS kind, l_linestatus = 'F' AS directional,
    CAST(l_suppkey % 3 AS VARCHAR) AS metric, nullif(l_returnflag, 'N') AS entity, CASE WHEN l_discount >= 0.08 THEN 'unsupported' ELSE 'supported' END AS verdict,
    CAST(l_linenumber * 3 AS INTEGER) AS "start", CAST(l_linenumber * 3 + 2 AS INTEGER) AS "end", CAST(l_discount AS DOUBLE) AS p, CAST(l_suppkey % 3 AS VARCHAR) AS slot FROM lineitem
), kept AS (SELECT *, lag("end") OVER (PARTITION BY item_id ORDER BY "start") AS before FROM claims WHERE p >= 0.05
), islands AS (SELECT *, sum(CASE WHEN "start" > before + 1 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY "start") AS island FROM kept
), votes AS (SELECT item_id, island, slot, count(*) AS n, row_number() OVER (PARTITION BY item_id, island ORDER BY count(*) DESC, slot) AS nth FROM islands GROUP BY item_id, island, slot
), spans AS (
  SELECT i.item_id AS item_id, min(i."start") AS "start", max(i."end") AS "end", max(i.p) AS p, any_value(v.slot) AS slot
  FROM islands i JOIN votes v ON i.item_id = v.item_id AND i.island = v.island AND v.nth = 1 GROUP BY i.item_id, i.island
)
"""


def editable_claims(spark, d):
    return review.editable_claims(_claims(spark, d)).select("item_id", "claim_id", "verdict")


def merged_spans(spark, d):
    return review.merged_spans(_claims(spark, d), 0.05, ["item_id"], parts=parts_of(table(spark, d, "lineitem"))).select("item_id", "start", "end", "p", "slot")


def flagged_claims(spark, d):
    claims, parts = _claims(spark, d), parts_of(table(spark, d, "lineitem"))
    spans = review.merged_spans(claims, 0.05, ["item_id"], parts=parts)
    flagged = review.flag_claims(claims.select("item_id", "claim_id", "start", "end"), spans, parts=parts)
    return flagged.select("item_id", "claim_id", F.coalesce("p", F.lit(-1.0)).alias("p"), "verdict")


def settled_labels(spark, d):
    role = F.when(F.col("l_suppkey") % 5 == 0, "adjudicated").when(F.col("l_suppkey") % 5 <= 2, "human").otherwise("model")
    labels = table(spark, d, "lineitem").select("l_partkey", role.alias("role"), F.col("l_returnflag").alias("label"), "l_orderkey", "l_linenumber")
    return review.settled_labels(labels, ["l_partkey"], ["l_orderkey", "l_linenumber", "label"]).select("l_partkey", "role", "label")


def facts_by_year(spark, d):
    facts = table(spark, d, "orders").select("o_orderpriority", F.year("o_orderdate").cast("string").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    wide = review.by_period(facts, ["o_orderpriority"], "year", F.max("price").cast("double"), YEARS)
    return wide.select("o_orderpriority", *[F.coalesce(F.col(y), F.lit(0.0)).alias(f"y{y}") for y in YEARS])


def span_quality(spark, d):
    """Spans of probable tokens against the spans of wrong claims, which lie a character further on."""
    claims, parts = _claims(spark, d), parts_of(table(spark, d, "lineitem"))
    gold = claims.where("verdict = 'unsupported'").select("item_id", (F.col("start") + 1).alias("start"), (F.col("end") + 2).alias("end"))
    scores = metrics.span_scores(gold, review.merged_spans(claims, 0.05, ["item_id"], parts=parts), ["item_id"], parts)
    return scores.select("gold", "found", "hit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def queries() -> dict:
    return {f.__name__: f for f in (editable_claims, merged_spans, flagged_claims, settled_labels, facts_by_year, span_quality)}


SQL = {
    "span_quality": CLAIMS + """, g AS (SELECT DISTINCT item_id, unnest(range("start" + 1, "end" + 2)) AS spot FROM claims WHERE verdict = 'unsupported'), f AS (SELECT DISTINCT item_id, unnest(range("start", "end")) AS spot FROM spans),
n AS (SELECT (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g JOIN f USING (item_id, spot)) AS hit)
SELECT gold, found, hit, round(hit / found, 9) AS precision, round(hit / gold, 9) AS recall, round(2 * hit / (gold + found), 9) AS f1 FROM n""",
    "editable_claims": CLAIMS + """SELECT item_id, claim_id, verdict FROM claims c WHERE verdict = 'unsupported' OR (kind = 'percent' AND directional AND EXISTS (
  SELECT 1 FROM claims f WHERE f.item_id = c.item_id AND f.verdict = 'unsupported' AND f.kind = 'amount' AND f.metric IS NOT DISTINCT FROM c.metric AND f.entity IS NOT DISTINCT FROM c.entity))""",
    "merged_spans": CLAIMS + 'SELECT item_id, "start", "end", p, slot FROM spans',
    "flagged_claims": CLAIMS + """SELECT item_id, claim_id, coalesce(top, -1.0) AS p, CASE WHEN top IS NULL THEN 'supported' ELSE 'unsupported' END AS verdict
FROM (SELECT c.*, (SELECT max(s.p) FROM spans s WHERE s.item_id = c.item_id AND s."start" < c."end" AND c."start" < s."end") AS top FROM claims c)""",
    "settled_labels": """SELECT l_partkey, role, label FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE role WHEN 'adjudicated' THEN 0 WHEN 'human' THEN 1 ELSE 2 END, l_orderkey, l_linenumber, label) AS n
  FROM (SELECT l_partkey, CASE WHEN l_suppkey % 5 = 0 THEN 'adjudicated' WHEN l_suppkey % 5 <= 2 THEN 'human' ELSE 'model' END AS role, l_returnflag AS label, l_orderkey, l_linenumber FROM lineitem)) WHERE n = 1""",
    "facts_by_year": "SELECT o_orderpriority, " + ", ".join(f"coalesce(max(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)) FILTER (year(o_orderdate) = {y}), 0.0) AS y{y}" for y in YEARS) + " FROM orders GROUP BY o_orderpriority",
}
