"""How many calibration rows certify a setting, and what that buys on a test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.certify import hb_pvalue


def _digest(key: Column, draw: Column) -> Column:
    return F.sha2(F.concat_ws("|", key.cast("string"), draw.cast("string")), 256)


def samples(rows: DataFrame, key: str, sizes: list[int], draws: int) -> DataFrame:
    """Rows of every draw and size, drawn without replacement: the ``size`` rows of least digest; a draw's sizes nest.

    One pass for all draws and sizes: a draw keeps its best rows as partial top lists, so no draw is sorted whole.
    """
    place = F.row_number().over(Window.partitionBy("draw").orderBy(_digest(F.col(key), F.col("draw")), key))
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_place", place).where(F.col("_place") <= max(sizes))
    return drawn.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("_place") <= F.col("size")).drop("_place")


def _measures(alpha: float) -> list[Column]:
    unsafe, sent, useful = F.col("state") == "unsupported", F.col("state") != "abstained", F.col("state") == "supported_useful"
    loss = (F.count_if(unsafe) - alpha * F.count_if(sent) + alpha * F.count("*")) / (1 + alpha) / F.count("*")
    return [F.count("*").alias("n"), loss.alias("loss"), F.avg(useful.cast("double")).alias("useful"), F.count_if(unsafe).alias("unsafe"), F.count_if(sent).alias("sent")]


def setting_order(tune: DataFrame) -> DataFrame:
    """setting, place: from the most cautious on ``tune`` (decided rows: setting, state)."""
    unsafe, sent = F.count_if(F.col("state") == "unsupported"), F.count_if(F.col("state") != "abstained")
    rows = tune.groupBy("setting").agg(F.coalesce(F.try_divide(unsafe, sent), F.lit(0.0)).alias("risk"), F.try_divide(sent, F.count("*")).alias("coverage"))
    return rows.select("setting", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("risk", "coverage", "setting")).alias("place"))  # a row a setting


def budget_curve(calibration: DataFrame, test: DataFrame, order: DataFrame, key: str, sizes: list[int], draws: int, alpha: float, delta: float) -> DataFrame:
    """calibration_items, draws, certified_share, mean_test_useful_coverage (of draws that certify) for each size.

    ``calibration``: ``key`` and settings (array of setting, state), a row an item; ``test``: decided rows (setting, state).
    In a draw, settings are tested in order until one fails; of those certified the one most useful on the draw is taken, the first
    of equals. Sizes beyond the calibration rows are left out.
    """
    have = calibration.count()
    sizes = [n for n in sizes if n <= have]
    schema = "calibration_items int, draws int, certified_share double, mean_test_useful_coverage double"
    if not sizes:
        return calibration.sparkSession.createDataFrame([], schema)
    each = samples(calibration.select(key, "settings"), key, sizes, draws).select("size", "draw", F.inline("settings"))
    measured = each.groupBy("size", "draw", "setting").agg(*_measures(alpha)).join(F.broadcast(order), "setting")  # a row a setting
    measured = measured.withColumn("p_value", hb_pvalue("loss", "n", F.lit(alpha / (1 + alpha))))
    worst = F.max("p_value").over(Window.partitionBy("size", "draw").orderBy("place"))
    certified = measured.withColumn("worst", worst).where(F.col("worst") <= delta)
    best = certified.groupBy("size", "draw").agg(F.max_by("setting", F.struct("useful", -F.col("place"))).alias("setting"))
    on_test = test.groupBy("setting").agg(F.avg((F.col("state") == "supported_useful").cast("double")).alias("useful"))
    found = best.join(on_test, "setting", "left").groupBy("size").agg(F.count("*").alias("ok"), F.avg("useful").alias("mean"))
    asked = calibration.sparkSession.createDataFrame([(n,) for n in sizes], "size int").join(found, "size", "left")
    share = F.coalesce(F.col("ok"), F.lit(0)) / draws
    return asked.select(F.col("size").alias("calibration_items"), F.lit(draws).alias("draws"), share.alias("certified_share"), F.round("mean", 4).alias("mean_test_useful_coverage"))


def labels_needed(calibration: DataFrame, order: DataFrame, alpha: float, delta: float, most: int = 100) -> DataFrame:
    """setting, items: how many rows the first setting in order would need to certify at the rates seen, by repeating them 2 to
    ``most`` times; null where its risk is at alpha or above or nothing is sent, or so many are not enough."""
    first = order.where("place = 1").select("setting")
    rows = calibration.join(first, "setting").groupBy("setting").agg(*_measures(alpha))
    tried = rows.select("setting", "n", "loss", "unsafe", "sent", F.explode(F.sequence(F.lit(2), F.lit(most))).alias("k"))
    tried = tried.withColumn("p_value", hb_pvalue("loss", F.col("n") * F.col("k"), F.lit(alpha / (1 + alpha))))
    enough = (F.col("sent") > 0) & (F.col("unsafe") < alpha * F.col("sent")) & (F.col("p_value") <= delta)
    return tried.groupBy("setting").agg(F.min(F.when(enough, F.col("n") * F.col("k"))).alias("items"))


def restored_share(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of items whose original answer was unsafe (send, repair: states), the share that repair makes useful; null without any."""
    needs = F.col("send") == "unsupported"
    return rows.groupBy(*by).agg(F.count_if(needs).alias("unsafe"), F.try_divide(F.count_if(needs & (F.col("repair") == "supported_useful")), F.count_if(needs)).alias("restored"))
