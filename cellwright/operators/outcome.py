"""Outcome models (is an answer unsafe to send, would repair mend it), the deployed policy, and fused claim probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.functions.arithmetic import printed
from cellwright.operators.matching import overlapping
from cellwright.operators.scoring import setting_of
from cellwright.session import dealt

# Features of a claim, in order; the range of temperatures.
CLAIM_FEATURES = ("b_supported", "b_unsupported", "b_unverifiable", "b_slots", "b_has_expected", "a_max", "a_mean", "a_any", "kind_percent", "has_direction")
COOLEST, HOTTEST = 0.05, 20.0
# What each model predicts, from the states of sending and of repairing.
TARGETS = {"p_unsafe": "send = 'unsupported'", "p_fix": "repair = 'supported_useful'"}


class OutcomeModels:
    """P(unsafe) and P(fix) from features known before any action: boosted trees, or a constant where a target has one class."""

    def __init__(self, names: list[str], models: dict[str, PipelineModel | float]):
        self.names, self.models = names, models

    @classmethod
    def fit(cls, records: DataFrame, names: list[str], seed: int = 0, rounds: int = 60, depth: int = 4) -> OutcomeModels:
        """``records``: features ``names`` (nulls count as 0), send and repair (states)."""
        rows = records.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], *[F.expr(t).cast("int").alias(p) for p, t in TARGETS.items()])
        ends = rows.agg(*[f(p).alias(f"{f.__name__}_{p}") for p in TARGETS for f in (F.min, F.max)]).first()
        models: dict[str, PipelineModel | float] = {}
        for p in TARGETS:
            low, high = ends[f"min_{p}"], ends[f"max_{p}"]
            if low == high:
                models[p] = float(low or 0)
                continue
            trees = GBTClassifier(featuresCol="_x", labelCol=p, predictionCol="_label", maxIter=rounds, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=seed).setRawPredictionCol("_raw").setProbabilityCol("_p")
            models[p] = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), trees]).fit(rows)
        return cls(names, models)

    def predict(self, records: DataFrame) -> DataFrame:
        """The records with p_unsafe and p_fix."""
        out = records
        for p, model in self.models.items():
            if isinstance(model, float):
                out = out.withColumn(p, F.lit(model))
                continue
            plain = out.withColumns({n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names})
            out = model.transform(plain).withColumn(p, F.get(vector_to_array("_p"), F.lit(1))).drop("_x", "_raw", "_p", "_label")
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        constants = [(p, m if isinstance(m, float) else None) for p, m in self.models.items()]
        spark.createDataFrame([(p, c, self.names) for p, c in constants], "target string, constant double, names array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/targets")
        for p, m in self.models.items():
            if not isinstance(m, float):
                m.write().overwrite().save(f"{path}/{p}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> OutcomeModels:
        rows = spark.read.parquet(f"{path}/targets").collect()  # a row a target
        models = {r.target: r.constant if r.constant is not None else PipelineModel.load(f"{path}/{r.target}") for r in rows}
        return cls(list(rows[0].names), {p: models[p] for p in TARGETS})


def given_scores(records: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Records with the p_unsafe and p_fix that a model wrote elsewhere for each key; a missing one is an error, named, when read."""
    given = predictions.select(key, *TARGETS).dropDuplicates([key])
    rows = records.join(given, key, "left")
    missing = F.concat(F.lit("no prediction for record "), F.coalesce(F.col(key).cast("string"), F.lit("without a key")))
    return rows.withColumns({p: F.when(F.col(p).isNull(), F.raise_error(missing).cast("double")).otherwise(F.col(p)) for p in TARGETS})


def deployed_actions(records: DataFrame, setting: str) -> DataFrame:
    """Records (p_unsafe, p_fix) with action and reason under a certified setting such as send<0.02,fix>0.9."""
    limits = setting_of(F.lit(setting))
    rows = records.withColumn("_s", limits)
    send, fix = F.col("_s.send_below"), F.col("_s.fix_above")
    sent, mended = F.col("p_unsafe") < send, F.col("p_fix") > fix
    action = F.when(sent, "send").when(mended, "repair").otherwise("abstain")
    said = lambda name, p, word, limit: F.concat(F.lit(f"{name} "), printed(p, 3), F.lit(f" {word} "), limit.cast("string"))
    reason = F.when(sent, said("P(unsafe)", F.col("p_unsafe"), "below", send)).when(mended, said("P(fix)", F.col("p_fix"), "above", fix)).otherwise("neither sending nor repairing is safe enough")
    return rows.withColumns({"action": action, "reason": reason}).drop("_s")


def claim_features(checks: DataFrame, tokens: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """``keys`` and CLAIM_FEATURES of checks (start, end, d_start, d_end, verdict, slots, expected, kind, direction) and
    token probabilities (first key, start, end, p) over a claim's characters and over its word of movement. ``parts``: over how
    many partitions each step deals its rows."""
    item = keys[0]
    spans = checks.select(*keys, F.inline(F.array(F.struct(F.col("start"), F.col("end")), F.struct(F.col("d_start").alias("start"), F.col("d_end").alias("end"))))).where("start IS NOT NULL")
    right = tokens.select(item, F.col("start").alias("r_start"), F.col("end").alias("r_end"), "p")
    seen = dealt(overlapping(spans, right, [item], parts=parts).select(*keys, "p"), parts, *keys)
    seen = seen.groupBy(*keys).agg(F.max("p").alias("a_max"), F.avg("p").alias("a_mean"), F.bool_or(F.col("p") >= 0.5).cast("double").alias("a_any"))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    own = {f"b_{v}": number(F.col("verdict") == v) for v in ("supported", "unsupported", "unverifiable")}
    own |= {"b_slots": F.coalesce(F.size("slots"), F.lit(0)).cast("double"), "b_has_expected": number(F.col("expected").isNotNull()), "kind_percent": number(F.col("kind") == "percent"), "has_direction": number(F.col("direction").isNotNull())}
    rows = dealt(checks.withColumns(own).select(*keys, *[c for c in CLAIM_FEATURES if c in own]), parts, *keys).join(seen, keys, "left").fillna(0.0, ["a_max", "a_mean", "a_any"])
    return rows.select(*keys, *CLAIM_FEATURES)


def logistic(features: list[str], weights: list[float], intercept: float) -> Column:
    """The probability that a fitted logistic model gives; a Column, so it needs no model to score."""
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [F.col(f) * w for f, w in zip(features, weights, strict=True)], F.lit(intercept))))


def fit_fusion(rows: DataFrame, label: str = "label", features: tuple[str, ...] = CLAIM_FEATURES) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model of claims' labels, with a unit penalty on the weights."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows.select(F.col(label).cast("double").alias(label), *features))
    model = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=1000, tol=1e-9, regParam=1.0 / max(1, vectors.count()), elasticNetParam=0.0, standardization=False).fit(vectors)
    return [float(w) for w in model.coefficients], float(model.intercept)


def isotonic_calibrator(rows: DataFrame, p: str = "p", label: str = "label"):
    """A rising step-wise fit of labels on scores (pool adjacent violators), linear between its steps and flat beyond them."""
    return IsotonicRegression(featuresCol=p, labelCol=label, predictionCol="calibrated").fit(rows.select(F.col(p).cast("double"), F.col(label).cast("double")))


def calibrated(rows: DataFrame, model, p: str = "p") -> DataFrame:
    return model.transform(rows)


def tempered(p: Column, temperature: float | Column) -> Column:
    """A probability whose log-odds are divided by a temperature."""
    odds = F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)) / F.least(F.greatest(1 - p, F.lit(1e-6)), F.lit(1.0)))
    return 1 / (1 + F.exp(-odds / temperature))


def fit_temperature(rows: DataFrame, p: str = "p", label: str = "label", rounds: int = 5, points: int = 33) -> float:
    """The temperature of least log loss: a grid of powers, refined around its best point; a pass over the rows a round."""
    low, high = COOLEST, HOTTEST
    for _ in range(rounds):
        grid = [low * (high / low) ** (i / (points - 1)) for i in range(points)]
        q = [tempered(F.col(p), t) for t in grid]
        losses = rows.agg(*[F.avg(-F.col(label) * F.log(x + 1e-12) - (1 - F.col(label)) * F.log(1 - x + 1e-12)).alias(f"t{i}") for i, x in enumerate(q)]).first()
        best = min(range(points), key=lambda i: losses[i])
        low, high = grid[max(0, best - 1)], grid[min(points - 1, best + 1)]
    return (low * high) ** 0.5


def item_risk(claims: DataFrame, items: DataFrame, p: str = "p", parts: int | None = None) -> DataFrame:
    """item_id, risk: that at least one claim is wrong, claims being independent; 0.5 without claims."""
    sure = F.bool_or(F.col(p) >= 1)
    by = dealt(claims.select("item_id", p), parts, "item_id").groupBy("item_id").agg(F.when(sure, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.least(F.col(p), F.lit(1 - 1e-15)))))).alias("risk"))
    return dealt(items.select("item_id"), parts, "item_id").join(by, "item_id", "left").fillna(0.5, ["risk"])
