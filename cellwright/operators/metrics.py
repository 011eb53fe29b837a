"""Grouped quality metrics. Every one is an aggregate of sums, so partial aggregation does the work before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.session import dealt

# What becomes of an item, and what is sent.
STATES = ("supported_useful", "supported_unhelpful", "unsupported", "abstained")
SENT = STATES[:3]


def policy_metrics(states: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """items, emitted, emission_coverage, residual_risk (0 if nothing is sent), useful_coverage, unsafe_emitted."""
    is_sent, unsafe, useful = F.col(state).isin(*SENT), F.col(state) == "unsupported", F.col(state) == "supported_useful"
    out = states.groupBy(*by).agg(F.count("*").alias("items"), F.count_if(is_sent).alias("emitted"), F.count_if(unsafe).alias("unsafe_emitted"), F.count_if(useful).alias("useful"))
    out = out.withColumns(
        {
            "emission_coverage": F.try_divide(F.col("emitted"), F.col("items")),
            "residual_risk": F.coalesce(F.try_divide(F.col("unsafe_emitted"), F.col("emitted")), F.lit(0.0)),
            "useful_coverage": F.try_divide(F.col("useful"), F.col("items")),
        }
    )
    return out.drop("useful")


def flip_matrix(pairs: DataFrame, before: list[str], after: list[str]) -> DataFrame:
    """A row per ``before`` and a column per ``after``, zero where nothing went that way."""
    rows = pairs.sparkSession.createDataFrame([(b,) for b in before], "before string")
    counts = pairs.groupBy("before").agg(*[F.count_if(F.col("after") == a).alias(a) for a in after])
    return F.broadcast(rows).join(counts, "before", "left").fillna(0, after)


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two raters; 1 where chance alone expects full agreement."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("r")), cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("r").cast("double") * F.col("c")), F.lit(0.0)).alias("both"))
    both = total.crossJoin(F.broadcast(chance))  # one row and one row
    observed, expected = F.col("same") / F.col("n"), F.col("both") / F.col("n") / F.col("n")
    return both.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected)).alias("kappa"))


def calibration(scored: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """brier and ece over equal bins, the last one closed."""
    cell = scored.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy(*by, "bin").agg(
        F.count("*").alias("n"), F.sum(F.col(p)).alias("p"), F.sum(F.col(y).cast("double")).alias("y"), F.sum((F.col(p) - F.col(y)) ** 2).alias("sq")
    )
    return cell.groupBy(*by).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def auroc(scored: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """The chance that a positive outranks a negative, ties counting half; null with one class.

    Rows become counts per distinct score first, so the ordered sums run over scores, not over rows.
    """
    at = scored.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2))
    return at.groupBy(*by).agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def order_threshold(scored: DataFrame, by: list[str], score: str, y: str, share: float = 0.9) -> DataFrame:
    """The score at place floor(share * n) (from 0) of the clean rows in order, and recall strictly above it."""
    clean = scored.where(F.col(y) == 0).groupBy(*by, score).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    clean = clean.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*by))})
    threshold = clean.where(F.col("upto") > F.floor(F.col("all") * share)).groupBy(*by).agg(F.min(score).alias("threshold"))
    return scored.join(threshold, by).groupBy(*by).agg(
        F.first("threshold").alias("threshold"), F.try_divide(F.count_if((F.col(y) == 1) & (F.col(score) > F.col("threshold"))), F.count_if(F.col(y) == 1)).alias("recall")
    )


def item_risk(items: DataFrame, checks: DataFrame, weight: Column) -> DataFrame:
    """Of every item the largest weight of its claims, and the fused risk 1 - prod(1 - p); 0.5 without claims."""
    safe = F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-300))))
    by = checks.groupBy("item_id").agg(F.max(weight).alias("risk"), (1 - F.exp(safe)).alias("fused"))
    return items.select("item_id").join(by, "item_id", "left").fillna(0.5, ["risk", "fused"])


def span_scores(gold: DataFrame, found: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Character precision, recall and F1 over spans (start, end); what both cover is what each covers less what either does.

    In order of their starts, a span adds what lies beyond the furthest end so far: of its own side, and of either. ``parts``:
    over how many partitions the spans are dealt.
    """
    side = lambda d, is_gold: d.where("`end` > start").select(F.lit(is_gold).alias("is_gold"), *keys, "start", "end")
    spans = dealt(side(gold, True).unionByName(side(found, False)), parts, *keys)
    is_gold, w = F.col("is_gold"), Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    furthest = {"_gold": F.max(F.when(is_gold, F.col("end"))).over(w), "_found": F.max(F.when(~is_gold, F.col("end"))).over(w)}
    adds = lambda before: F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = spans.withColumns(furthest).agg(total(F.when(is_gold, adds(F.col("_gold")))).alias("gold"), total(F.when(~is_gold, adds(F.col("_found")))).alias("found"), total(adds(F.greatest("_gold", "_found"))).alias("either"))
    both = n.select("gold", "found", (F.col("gold") + F.col("found") - F.col("either")).alias("hit"))
    return both.select("gold", "found", "hit", F.try_divide("hit", "found").alias("precision"), F.try_divide("hit", "gold").alias("recall"), F.try_divide(2 * F.col("hit"), F.col("gold") + F.col("found")).alias("f1"))
