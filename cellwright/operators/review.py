"""What reviewers and span models say of claims: which claims may be edited, labels that hold, merged and applied spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.matching import overlapping
from cellwright.session import dealt

# Whose label holds, the strongest first; any other role counts as the first label given.
PRECEDENCE = ("adjudicated", "human")


def editable_claims(claims: DataFrame) -> DataFrame:
    """Flagged claims, and directional percents of the metric and entity of a flagged amount.

    ``claims``: item_id, claim_id, kind, directional, metric, entity, verdict. Null metrics or entities equal each other.
    """
    flagged = claims.where("verdict = 'unsupported'")
    amounts = flagged.where("kind = 'amount'").select(F.col("item_id").alias("f_item"), F.col("metric").alias("f_metric"), F.col("entity").alias("f_entity"))
    same = (F.col("item_id") == F.col("f_item")) & F.col("metric").eqNullSafe(F.col("f_metric")) & F.col("entity").eqNullSafe(F.col("f_entity"))
    follows = claims.where("kind = 'percent' AND directional AND NOT verdict <=> 'unsupported'").join(amounts, same, "left_semi")
    return flagged.unionByName(follows)


def settled_labels(labels: DataFrame, keys: list[str], order: list[str], role: str = "role") -> DataFrame:
    """The label that holds for each key: an adjudicated one, else a person's, else the first one given."""
    rank = F.lit(len(PRECEDENCE))
    for i in range(len(PRECEDENCE) - 1, -1, -1):
        rank = F.when(F.col(role) == PRECEDENCE[i], i).otherwise(rank)
    w = Window.partitionBy(*keys).orderBy(rank, *order)
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merged_spans(tokens: DataFrame, threshold: float, keys: list[str], gap: int = 1, parts: int | None = None) -> DataFrame:
    """Spans of tokens (start, end, p, slot) at or above a threshold, merged over gaps of up to ``gap`` characters.

    p is the largest of a span's tokens; slot is the one most tokens name, ties to the first by name. ``parts``: over how many
    partitions the tokens are dealt.
    """
    kept = dealt(tokens.where(F.col("p") >= threshold), parts, *keys)
    w = Window.partitionBy(*keys).orderBy("start", "end", "slot", "p")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = kept.withColumn("_opens", F.coalesce((F.col("start") > before + gap).cast("int"), F.lit(1)))
    votes = opened.withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island", "slot")
    votes = votes.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("p").alias("p"), F.count("*").alias("n"))
    out = votes.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("p").alias("p"), F.min_by("slot", F.struct(-F.col("n"), F.col("slot"))).alias("slot"))
    return out.drop("island")


def flag_claims(claims: DataFrame, spans: DataFrame, item: str = "item_id", claim: str = "claim_id", parts: int | None = None) -> DataFrame:
    """Claims (start, end) with the largest p of the spans they overlap and the verdict that follows; repeated claims stay repeated."""
    right = spans.select(item, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "p")
    hits = overlapping(claims.select(item, claim, "start", "end"), right, [item], parts=parts)
    hits = dealt(hits.select(item, claim, "p"), parts, item, claim).groupBy(item, claim).agg(F.max("p").alias("p"))
    verdict = F.when(F.col("p").isNotNull(), "unsupported").otherwise("supported")
    return dealt(claims, parts, item, claim).join(hits, [item, claim], "left").withColumn("verdict", verdict)


def by_period(facts: DataFrame, keys: list[str], period: str, value: Column, periods: list[str]) -> DataFrame:
    """A row per concept and a column per stated period; null where there is no fact."""
    return facts.groupBy(*keys).pivot(period, periods).agg(value)
