"""Certified risk: p-values of bounded losses, fixed-sequence testing over a grid of settings, cluster resampling."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), as a regularised incomplete beta function by its continued fraction: no sum over the counts."""
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    out = min(1.0, front * (value - 1))
    return 1 - out if flip else out


def hoeffding_bentkus(loss: float, n: int, alpha: float) -> float:
    """The smaller of the two tail bounds that a mean loss so low has under a true risk of alpha."""
    if n <= 0 or loss >= alpha:
        return 1.0
    x = min(max(loss, 1e-12), 1 - 1e-12)
    kl = x * math.log(x / alpha) + (1 - x) * math.log((1 - x) / (1 - alpha))
    return min(1.0, math.exp(-n * kl), math.e * binomial_cdf(math.ceil(n * loss - 1e-9), n, alpha))


def zero_error_budget(alpha: float, delta: float = 0.05) -> int:
    """Rows without an error that certify a risk of alpha."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def clopper_pearson_upper(errors: int, n: int, delta: float = 0.05) -> float:
    """The risk under which so few errors have probability delta, by bisection."""
    if errors >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_cdf(errors, n, mid) > delta else (lo, mid)
    return hi


@F.pandas_udf(T.DoubleType())
def hb_pvalue(loss: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([hoeffding_bentkus(float(a), int(b), float(c)) for a, b, c in zip(loss, n, alpha, strict=True)])


def decisions(records: DataFrame, settings: list[tuple[str, float]]) -> DataFrame:
    """Each record under each setting of a small literal grid (name, threshold): sent where its risk is below."""
    grid = F.array(*[F.struct(F.lit(name).alias("setting"), F.lit(float(t)).alias("threshold")) for name, t in settings])
    return records.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g").withColumn("sent", F.col("risk") < F.col("threshold"))


def certify(tune: DataFrame, calibration: DataFrame, alpha: float, delta: float) -> DataFrame:
    """A row a setting: its place from most cautious on ``tune``, selective risk p-value on ``calibration``, certified or not.

    Inputs are decided rows (setting, sent, unsafe 0/1, useful 0/1). The loss of a row is shifted into [0, 1]:
    (unsafe - alpha * sent + alpha) / (1 + alpha); testing stops at the first p-value above delta.
    """
    order = tune.groupBy("setting").agg(
        F.coalesce(F.try_divide(F.sum(F.col("sent").cast("long") * F.col("unsafe")), F.sum(F.col("sent").cast("long"))), F.lit(0.0)).alias("tune_risk"), F.avg(F.col("sent").cast("double")).alias("tune_coverage")
    )
    sent = F.col("sent").cast("double")
    loss = F.avg((sent * F.col("unsafe") - alpha * sent + alpha) / (1 + alpha))
    measured = calibration.groupBy("setting").agg(F.count("*").alias("n"), loss.alias("loss"), F.avg(sent * F.col("useful")).alias("useful_coverage"))
    rows = order.join(measured, "setting").withColumn("p_value", hb_pvalue("loss", "n", F.lit(alpha / (1 + alpha))))
    # settings are a short list: one ordered pass over them
    cautious = Window.partitionBy(F.lit(1)).orderBy("tune_risk", "tune_coverage", "setting")
    rows = rows.withColumns({"place": F.row_number().over(cautious), "worst": F.max("p_value").over(cautious)})
    return rows.withColumn("certified", F.col("worst") <= delta).drop("worst")


def certify_states(tune: DataFrame, calibration: DataFrame, by: list[str], alpha: float, delta: float) -> DataFrame:
    """``certify`` of several families of settings at once, from states: rows of ``by``, setting and state."""
    sent, unsafe, useful = F.col("state") != "abstained", F.col("state") == "unsupported", F.col("state") == "supported_useful"
    order = tune.groupBy(*by, "setting").agg(F.coalesce(F.try_divide(F.count_if(unsafe), F.count_if(sent)), F.lit(0.0)).alias("tune_risk"), F.avg(sent.cast("double")).alias("tune_coverage"))
    loss = (F.count_if(unsafe) - alpha * F.count_if(sent) + alpha * F.count("*")) / (1 + alpha) / F.count("*")
    measured = calibration.groupBy(*by, "setting").agg(F.count("*").alias("n"), loss.alias("loss"), F.avg(useful.cast("double")).alias("useful_coverage"), F.coalesce(F.try_divide(F.count_if(unsafe), F.count_if(sent)), F.lit(0.0)).alias("risk"))
    rows = order.join(measured, [*by, "setting"]).withColumn("p_value", hb_pvalue("loss", "n", F.lit(alpha / (1 + alpha))))
    # a family's settings are a short list
    cautious = Window.partitionBy(*by).orderBy("tune_risk", "tune_coverage", "setting")
    rows = rows.withColumns({"place": F.row_number().over(cautious), "worst": F.max("p_value").over(cautious)})
    return rows.withColumn("certified", F.col("worst") <= delta).drop("worst")


def chosen(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each family how many settings are certified, and the one with the highest useful coverage, then the lowest risk, then
    the most cautious; null where none is."""
    order = F.struct(F.col("useful_coverage"), -F.col("risk"), -F.col("place"))
    best = F.max_by(F.struct("setting", "useful_coverage", "risk", "p_value"), F.when(F.col("certified"), order))
    return rows.groupBy(*by).agg(F.count_if("certified").alias("certified"), best.alias("b")).select(*by, "certified", "b.*")


def hb_zero_error_budget(alpha: float, delta: float = 0.05) -> int:
    """Rows without an error that the linear certificate needs: the first n whose p-value is at most delta, by halving."""
    p = lambda n: hoeffding_bentkus(0.0, n, alpha / (1 + alpha))
    high = 1
    while p(high) > delta:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if p(mid) <= delta else (mid, high)
    return high


def cluster_pvalue(rows: DataFrame, by: list[str], cluster: str, alpha: float) -> DataFrame:
    """The p-value of each setting when every cluster is one draw: the mean of the clusters' mean shifted losses."""
    loss = (F.count_if(F.col("state") == "unsupported") - alpha * F.count_if(F.col("state") != "abstained") + alpha * F.count("*")) / (1 + alpha) / F.count("*")
    each = rows.groupBy(*by, cluster).agg(loss.alias("m")).groupBy(*by).agg(F.avg("m").alias("loss"), F.count("*").alias("clusters"))
    return each.withColumn("p_value", hb_pvalue("loss", "clusters", F.lit(alpha / (1 + alpha))))


def paired_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, draws: int, level: float = 0.95) -> DataFrame:
    """estimate, low, high of the difference of the means of two columns of the same rows when clusters are drawn again, and
    what it says: above, below, no difference, or untestable with fewer than two clusters."""
    rows = rows.withColumns({"_d": F.col(a) - F.col(b), "_one": F.lit(1)})
    out = cluster_bootstrap(rows, cluster, "_d", "_one", draws, level)
    total = rows.agg(F.avg("_d").alias("estimate"))
    verdict = F.when(F.col("low").isNull(), "untestable").when(F.col("low") > 0, "above").when(F.col("high") < 0, "below").otherwise("no difference")
    return out.crossJoin(F.broadcast(total)).select("estimate", "low", "high", "clusters", "draws", verdict.alias("verdict"))  # one row


def drawn_times(cluster: Column, draw: Column) -> Column:
    """How often a cluster comes in a draw: Poisson with mean one, from a digest of both, the same on any platform."""
    u = (F.conv(F.substring(F.sha2(F.concat_ws("|", F.coalesce(cluster.cast("string"), F.lit("")), draw.cast("string")), 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return sum((u > c).cast("int") for c in POISSON_STEPS)


#: The chances that a Poisson number of mean one is at most 0, 1, 2 and so on.
POISSON_STEPS = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 12) for k in range(12)]


def _interval(each: DataFrame, clusters: DataFrame, by: list[str], level: float) -> DataFrame:
    """``by``, low, high, draws, clusters of a statistic x a draw: its percentiles; null with fewer than two clusters."""
    place = lambda q: F.try_element_at("xs", F.least((F.floor(F.size("xs") * q) + 1).cast("int"), F.size("xs")))
    some = each.where("x IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # as many as draws
    some = clusters.join(some, by, "left") if by else clusters.join(some, F.lit(True), "left")
    some = some.withColumn("xs", F.coalesce("xs", F.array().cast("array<double>")))
    enough = F.col("clusters") > 1
    return some.select(*by, F.when(enough, place((1 - level) / 2)).alias("low"), F.when(enough, place((1 + level) / 2)).alias("high"), F.size("xs").alias("draws"), "clusters")


def _draws(rows: DataFrame, cluster: str, draws: int) -> DataFrame:
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return drawn.withColumn("m", drawn_times(F.col(cluster), F.col("draw"))).where("m > 0")


def cluster_bootstrap(rows: DataFrame, cluster: str, hit: str, base: str, draws: int, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """low, high of sum(hit) / sum(base), of each group of ``by``, when clusters are drawn again with replacement.

    Sums of a cluster are enough for a ratio. Multiplicities come from ``drawn_times``, so draws are independent of partitions
    and no cluster list reaches the driver. With fewer than two clusters both are null; null sums count as zero; draws whose
    base is zero are left out.
    """
    sums = rows.groupBy(*by, cluster).agg(F.coalesce(F.sum(hit), F.lit(0)).cast("double").alias("h"), F.coalesce(F.sum(base), F.lit(0)).cast("double").alias("b"))
    each = _draws(sums, cluster, draws).groupBy(*by, "draw").agg(F.sum(F.col("m") * F.col("h")).alias("h"), F.sum(F.col("m") * F.col("b")).alias("b")).select(*by, F.try_divide("h", "b").alias("x"))
    return _interval(each, sums.groupBy(*by).agg(F.count("*").alias("clusters")), list(by), level)


def rank_bootstrap(rows: DataFrame, cluster: str, score: str, y: str, draws: int, level: float = 0.95) -> DataFrame:
    """estimate, low, high of the AUROC of a score when clusters are drawn again: sums a cluster can't give a rank statistic.

    Rows become counts per cluster and score first; a draw weighs these by its multiplicities, and its AUROC is the
    weighted one, ties counting half. Draws with one class are left out.
    """
    counts = rows.groupBy(cluster, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    n = lambda c: F.sum(F.col("m") * F.col(c)).alias(c)
    at = _draws(counts, cluster, draws).groupBy("draw", score).agg(n("pos"), n("neg"))
    whole = counts.groupBy(score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).withColumn("draw", F.lit(-1))
    at = at.unionByName(whole)
    under = F.coalesce(F.sum("neg").over(Window.partitionBy("draw").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("won", F.col("pos") * (under + F.col("neg") / 2))
    each = at.groupBy("draw").agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("x"))
    out = _interval(each.where("draw >= 0"), counts.agg(F.count_distinct(cluster).alias("clusters")), [], level)
    return out.join(each.where("draw < 0").select(F.col("x").alias("estimate")), F.lit(True), "left").select("estimate", "low", "high", "draws", "clusters")


def cluster_upper(rows: DataFrame, cluster: str, by: tuple[str, ...] = (), state: str = "state", draws: int = 2000) -> DataFrame:
    """The one-sided 95% upper bound of residual risk when clusters are drawn again: the upper end of a 90% interval."""
    flags = rows.select(*by, cluster, (F.col(state) == "unsupported").cast("int").alias("_u"), (F.col(state) != "abstained").cast("int").alias("_s"))
    return cluster_bootstrap(flags, cluster, "_u", "_s", draws, 0.9, by).select(*by, F.col("high").alias("upper"), "draws", "clusters")


def group_risk(rows: DataFrame, cluster: str, groups: Column, state: str = "state", draws: int = 2000) -> DataFrame:
    """Residual risk of every group with its interval; ``groups`` is an array, so groups may overlap."""
    flags = rows.select(F.explode(groups).alias("grp"), cluster, (F.col(state) == "unsupported").cast("int").alias("_u"), (F.col(state) != "abstained").cast("int").alias("_s"))
    total = flags.groupBy("grp").agg(F.count("*").alias("items"), F.sum("_s").alias("sent"), F.try_divide(F.sum("_u").cast("double"), F.sum("_s").cast("double")).alias("estimate"))
    return cluster_bootstrap(flags, cluster, "_u", "_s", draws, by=("grp",)).join(total, "grp").select("grp", "items", "sent", "estimate", "low", "high", "clusters")


def decided_direction(low: Column, high: Column, above: bool) -> Column:
    """confirmed when an interval excludes zero on the stated side, no difference, or untestable without an interval."""
    side = low > 0 if above else high < 0
    return F.when(low.isNull() | high.isNull(), "untestable").when(side, "confirmed").otherwise("no difference")
