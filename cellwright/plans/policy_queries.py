"""Certification, resampling, budgets, deployed actions and fused risk, on labelled documents that stand for checked answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.operators import budget, certify, metrics, outcome, splits
from cellwright.plans.answer_queries import certificates
from cellwright.plans.evidence_queries import STATES, hb_sql, quality_states, table
from cellwright.session import parts_of, stored

DRAWS, SIZES, ALPHA, DELTA, LOOSE = 25, [20, 50, 100, 400], 0.2, 0.05, 0.6
SETTING = "send<0.02,fix>0.9"
WEIGHTS, INTERCEPT = [-1.5, 2.0, 0.25, 0.5, -0.25, 1.5, 0.75, 0.5, 0.125, -0.125], -1.0


def risk_interval(spark, d):
    """The share of toxic documents when sources are drawn again."""
    s = quality_states(spark, d).withColumns({"h": F.col("toxic"), "b": F.lit(1)})
    return _bounds(certify.cluster_bootstrap(s, "source", "h", "b", 2000))


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 9) for c in ("estimate", "low", "high", "upper") if c in rows.columns})


def paired_interval(spark, d):
    """Useful coverage of sending all against sending none, by drawing sources again."""
    tune, _ = certificates(spark, d)
    rows = tune.select("source", (F.col("send") == "supported_useful").cast("int").alias("a"), F.lit(0).alias("b"))
    return _bounds(certify.paired_bootstrap(rows, "source", "a", "b", 2000))


def rank_interval(spark, d):
    """The AUROC of risk against toxicity, by drawing sources again."""
    out = _bounds(certify.rank_bootstrap(quality_states(spark, d), "source", "risk", "toxic", 200))
    return out.withColumn("verdict", certify.decided_direction(F.col("low") - 0.5, F.col("high") - 0.5, True))


def group_risks(spark, d):
    """Residual risk by language and of short documents, which overlap, by drawing sources again."""
    groups = F.array_compact(F.array(F.col("lang"), F.when(F.col("n") < 1000, "short")))
    return _bounds(certify.group_risk(quality_states(spark, d), "source", groups, draws=500))


def cluster_bounds(spark, d):
    """Upper bounds and p-values of each language's residual risk, sources being the draws."""
    s = quality_states(spark, d)
    upper = _bounds(certify.cluster_upper(s, "source", ("lang",), draws=500))
    return upper.join(certify.cluster_pvalue(s, ["lang"], "source", ALPHA).select("lang", F.round("loss", 9).alias("loss"), F.round("p_value", 6).alias("p_value")), "lang")


def _settings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with the state that each of nine thresholds leaves them in: to tune, to calibrate, to test."""
    s = quality_states(spark, d).withColumn("half", splits.part_of(F.col("doc_id"), 2))
    sent = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported_useful").otherwise("supported_unhelpful")
    grid = F.array(*[F.struct(F.lit(f"risk<{t / 10:.1f}").alias("setting"), F.when(F.col("risk") < t / 10, sent).otherwise("abstained").alias("state")) for t in range(1, 10)])
    rows = s.select("doc_id", "half", grid.alias("settings"))
    even = F.col("doc_id") % 2 == 0
    return tuple(rows.where(c).drop("half") for c in ((F.col("half") == 0) & even, F.col("half") == 1, (F.col("half") == 0) & ~even))


def budget_curve(spark, d):
    tune, calibration, test = _settings(spark, d)
    order = stored(budget.setting_order(tune.select(F.inline("settings"))), "order")
    out = budget.budget_curve(calibration, test.select(F.inline("settings")), order, "doc_id", SIZES, DRAWS, LOOSE, DELTA)
    return out.withColumn("mean_test_useful_coverage", F.coalesce("mean_test_useful_coverage", F.lit(-1.0)))


def labels_needed(spark, d):
    tune, calibration, _ = _settings(spark, d)
    order = budget.setting_order(tune.select(F.inline("settings")))
    return budget.labels_needed(calibration.where("doc_id % 20 = 0").select(F.inline("settings")), order, LOOSE, DELTA).select("setting", F.coalesce("items", F.lit(-1)).alias("items"))


def restored_shares(spark, d):
    tune, _ = certificates(spark, d)
    return budget.restored_share(tune, ["source"]).select("source", "unsafe", F.round(F.coalesce("restored", F.lit(-1.0)), 9).alias("restored"))


def deployed_actions(spark, d):
    """What the certified setting does with probabilities that a model wrote elsewhere, joined back by key."""
    tune, _ = certificates(spark, d)
    scores = tune.select("doc_id", "p_unsafe", (F.col("doc_id") % 100 / 99).alias("p_fix"))
    rows = outcome.given_scores(tune.select("doc_id"), scores, "doc_id")
    return outcome.deployed_actions(rows, SETTING).select("doc_id", "action", "reason")


def outcome_quality(spark, d):
    """Boosted trees fitted on one half of the records, measured on the other: AUROC, Brier score, calibration error a target."""
    fit, held = (stored(r.withColumn("length", F.length("source")), "records") for r in certificates(spark, d))
    models = outcome.OutcomeModels.fit(fit, ["risk", "n_claims", "evidence_sufficient", "p_clean", "length"], rounds=20)
    scored = stored(models.predict(held).select("p_unsafe", "p_fix", *[F.expr(t).cast("int").alias(f"y_{p}") for p, t in outcome.TARGETS.items()]), "scored")
    rows = scored.select(F.inline(F.array(*[F.struct(F.lit(p).alias("target"), F.col(p).alias("p"), F.col(f"y_{p}").alias("y")) for p in outcome.TARGETS])))
    return metrics.auroc(rows, ["target"], "p", "y").join(metrics.calibration(rows, ["target"], "p", "y"), "target")


def _checks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as checked claims and as tokens with a probability; every third claim has a word of movement before it."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("int").alias("claim_id"), "l_discount", "l_tax", "l_linestatus")
    start, n = F.col("claim_id") * 3, F.col("claim_id")
    moved = n % 3 == 0
    bad = F.col("l_discount") >= 0.08
    checks = lines.select(
        "item_id", "claim_id", start.alias("start"), (start + 2).alias("end"), F.when(moved, start - 4).alias("d_start"), F.when(moved, start - 2).alias("d_end"), F.when(bad, "unsupported").when(F.col("l_discount") <= 0.01, "unverifiable").otherwise("supported").alias("verdict"),
        F.when(bad, F.array(F.lit("value"))).otherwise(F.array().cast("array<string>")).alias("slots"), F.when(F.col("l_discount") >= 0.05, F.lit(1.0)).alias("expected"), F.when(n % 2 == 0, "percent").otherwise("amount").alias("kind"), F.when(F.col("l_linestatus") == "F", "up").alias("direction"),
    )
    tokens = lines.select("item_id", (start + 1).alias("start"), (start + 3).alias("end"), (F.col("l_tax").cast("double") * 10).alias("p"))
    return checks, tokens


def claim_features(spark, d):
    return outcome.claim_features(*_checks(spark, d), ["item_id", "claim_id"], parts_of(table(spark, d, "lineitem"))).withColumn("a_mean", F.round("a_mean", 9))


def fused_risk(spark, d):
    """The chance that an order has a wrong claim, from claims' fused probabilities at a temperature."""
    parts = parts_of(table(spark, d, "lineitem"))
    rows = outcome.claim_features(*_checks(spark, d), ["item_id", "claim_id"], parts)
    p = outcome.tempered(outcome.logistic(list(outcome.CLAIM_FEATURES), WEIGHTS, INTERCEPT), 1.5)
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return outcome.item_risk(rows.withColumn("p", p), items, parts=parts).select("item_id", F.round("risk", 9).alias("risk"))


def calibrated_risk(spark, d):
    """Risk as a rising fit of toxicity, at every risk there is."""
    rows = quality_states(spark, d).select(F.col("risk").alias("p"), F.col("toxic").alias("label"))
    points = rows.select(F.col("p").cast("double").alias("p")).distinct()
    return outcome.calibrated(points, outcome.isotonic_calibrator(rows)).select("p", F.round("calibrated", 9).alias("calibrated"))


def queries() -> dict:
    fs = (risk_interval, paired_interval, rank_interval, group_risks, cluster_bounds, budget_curve, labels_needed, restored_shares, deployed_actions, outcome_quality, claim_features, fused_risk, calibrated_risk)
    return {f.__name__: f for f in fs}


def times_sql(cluster: str) -> str:
    u = f"((CAST('0x' || sha256(coalesce(CAST({cluster} AS VARCHAR), '') || '|' || draw)[1:8] AS BIGINT) + 0.5) / 4294967296.0)"
    return " + ".join(f"({u} > {c!r})::INT" for c in certify.POISSON_STEPS)


def interval_sql(by: str, level: float) -> str:
    place = lambda q: f"xs[least(CAST(floor(len(xs) * {q!r}) AS INTEGER) + 1, len(xs))]"
    return f"SELECT {by} clusters, len(xs)::INTEGER AS draws, CASE WHEN clusters > 1 THEN round({place((1 - level) / 2)}, 9) END AS low, CASE WHEN clusters > 1 THEN round({place((1 + level) / 2)}, 9) END AS high"


def ratio_sql(source: str, by: str, draws: int) -> str:
    """Draws of sum(h) / sum(b) by cluster ``source``, as table ``drawn``; with the clusters of each group, as ``found``."""
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f""", sums AS (SELECT {g}source, sum(h) AS h, sum(b) AS b FROM {source} GROUP BY {g}source),
times AS (SELECT *, {times_sql('source')} AS m FROM sums, (SELECT unnest(range(0, {draws})) AS draw)),
ratios AS (SELECT {g}draw, sum(m * h) / sum(m * b) AS x FROM times WHERE m > 0 GROUP BY {g}draw HAVING sum(m * b) > 0),
found AS (SELECT * FROM (SELECT {g}list(x ORDER BY x) AS xs FROM ratios {'GROUP BY ' + by if by else ''}) JOIN (SELECT {g}count(*) AS clusters FROM sums {'GROUP BY ' + by if by else ''}) {on})"""


HALVES = """
WITH items AS (
  SELECT doc_id, source, toxic, quality, round((n_chars % 1000) / 1000.0, 3) AS risk, CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[64] AS INTEGER) % 2 AS half,
    CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported_useful' ELSE 'supported_unhelpful' END AS send, CASE doc_id % 3 WHEN 0 THEN 'supported_useful' WHEN 1 THEN 'abstained' ELSE 'unsupported' END AS repair
  FROM documents JOIN labels USING (doc_id)
)
"""
NINE = HALVES + """, decided AS (SELECT *, 'risk<0.' || t AS setting, CASE WHEN risk < t / 10.0 THEN send ELSE 'abstained' END AS state FROM items, (SELECT unnest(range(1, 10)) AS t)),
ordered AS (
  SELECT setting, row_number() OVER (ORDER BY coalesce(unsafe / nullif(sent, 0), 0), sent / n, setting) AS place
  FROM (SELECT setting, count(*) FILTER (state = 'unsupported') AS unsafe, count(*) FILTER (state <> 'abstained') AS sent, count(*) AS n FROM decided WHERE half = 0 AND doc_id % 2 = 0 GROUP BY setting)
)"""
MEASURES = "count(*) AS n, (count(*) FILTER (state = 'unsupported') - {a} * count(*) FILTER (state <> 'abstained') + {a} * count(*)) / (1 + {a}) / count(*) AS loss, avg((state = 'supported_useful')::INT) AS useful, count(*) FILTER (state = 'unsupported') AS unsafe, count(*) FILTER (state <> 'abstained') AS sent"
LINES = """
WITH lines AS (SELECT l_orderkey AS item_id, CAST(l_linenumber AS INTEGER) AS claim_id, l_discount, CAST(l_tax AS DOUBLE) * 10 AS p, l_linestatus FROM lineitem),
spans AS (SELECT item_id, claim_id, claim_id * 3 AS s, claim_id * 3 + 2 AS e FROM lines UNION ALL SELECT item_id, claim_id, claim_id * 3 - 4, claim_id * 3 - 2 FROM lines WHERE claim_id % 3 = 0),
seen AS (SELECT s.item_id, s.claim_id, max(t.p) AS a_max, avg(t.p) AS a_mean, max((t.p >= 0.5)::INT)::DOUBLE AS a_any FROM spans s JOIN lines t ON s.item_id = t.item_id AND s.s < t.claim_id * 3 + 3 AND t.claim_id * 3 + 1 < s.e GROUP BY ALL),
features AS (
  SELECT item_id, claim_id, (l_discount < 0.08 AND l_discount > 0.01)::INT::DOUBLE AS b_supported, (l_discount >= 0.08)::INT::DOUBLE AS b_unsupported, (l_discount <= 0.01)::INT::DOUBLE AS b_unverifiable, (l_discount >= 0.08)::INT::DOUBLE AS b_slots,
    (l_discount >= 0.05)::INT::DOUBLE AS b_has_expected, coalesce(a_max, 0.0) AS a_max, coalesce(a_mean, 0.0) AS a_mean, coalesce(a_any, 0.0) AS a_any, (claim_id % 2 = 0)::INT::DOUBLE AS kind_percent, (l_linestatus = 'F')::INT::DOUBLE AS has_direction
  FROM lines LEFT JOIN seen USING (item_id, claim_id)
)
"""

SQL: dict[str, str] = {
    "risk_interval": STATES + ", flags AS (SELECT source, toxic AS h, 1 AS b FROM items)" + ratio_sql("flags", "", 2000) + interval_sql("", 0.95) + " FROM found",
    "paired_interval": HALVES + ", flags AS (SELECT source, (send = 'supported_useful')::INT AS h, 1 AS b FROM items WHERE half = 0)" + ratio_sql("flags", "", 2000) + ", bounds AS (" + interval_sql("", 0.95) + " FROM found)"
    + "SELECT round((SELECT avg(h) FROM flags), 9) AS estimate, *, CASE WHEN low IS NULL THEN 'untestable' WHEN low > 0 THEN 'above' WHEN high < 0 THEN 'below' ELSE 'no difference' END AS verdict FROM bounds",
    "rank_interval": STATES + f""", counts AS (SELECT source, risk, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg FROM items GROUP BY ALL),
times AS (SELECT *, {times_sql('source')} AS m FROM counts, (SELECT unnest(range(0, 200)) AS draw) UNION ALL SELECT *, -1, 1 FROM counts),
at_score AS (SELECT draw, risk, sum(m * pos) AS pos, sum(m * neg) AS neg FROM times WHERE m > 0 GROUP BY ALL),
won AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY draw ORDER BY risk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS w FROM at_score),
aucs AS (SELECT draw, sum(w) / nullif(sum(pos) * sum(neg), 0) AS x FROM won GROUP BY draw),
found AS (SELECT list(x ORDER BY x) AS xs, (SELECT count(DISTINCT source) FROM counts) AS clusters FROM aucs WHERE draw >= 0 AND x IS NOT NULL), bounds AS (""" + interval_sql("", 0.95) + """ FROM found)
SELECT (SELECT round(x, 9) FROM aucs WHERE draw < 0) AS estimate, *, CASE WHEN low IS NULL THEN 'untestable' WHEN low > 0.5 THEN 'confirmed' ELSE 'no difference' END AS verdict FROM bounds""",
    "group_risks": STATES + """, flags AS (SELECT grp, source, (state = 'unsupported')::INT AS h, (state <> 'abstained')::INT AS b FROM (
  SELECT *, lang AS grp FROM items WHERE lang IS NOT NULL UNION ALL SELECT i.*, 'short' FROM items i JOIN documents USING (doc_id) WHERE length(coalesce(text, '')) < 1000))""" + ratio_sql("flags", "grp", 500) + ", bounds AS (" + interval_sql("grp,", 0.95) + """ FROM found)
SELECT b.grp AS grp, t.items, t.sent, t.estimate, low, high, clusters FROM bounds b JOIN (SELECT grp, count(*) AS items, sum(b)::BIGINT AS sent, round(sum(h) / nullif(sum(b), 0), 9) AS estimate FROM flags GROUP BY grp) t USING (grp)""",
    "cluster_bounds": STATES + ", flags AS (SELECT lang, source, (state = 'unsupported')::INT AS h, (state <> 'abstained')::INT AS b FROM items)" + ratio_sql("flags", "lang", 500) + ", bounds AS (" + interval_sql("lang,", 0.9) + f""" FROM found),
means AS (SELECT lang, avg(m) AS loss, count(*) AS n FROM (SELECT lang, source, (sum(h) - {ALPHA} * sum(b) + {ALPHA} * count(*)) / (1 + {ALPHA}) / count(*) AS m FROM flags GROUP BY ALL) GROUP BY lang)
SELECT lang, high AS upper, draws, clusters, round(loss, 9) AS loss, round({hb_sql('loss', 'n', ALPHA / (1 + ALPHA))}, 6) AS p_value FROM bounds JOIN means USING (lang)""",
    "budget_curve": NINE + f""", cal AS (SELECT DISTINCT doc_id FROM items WHERE half = 1),
sampled AS (SELECT doc_id, draw, row_number() OVER (PARTITION BY draw ORDER BY sha256(doc_id || '|' || draw), doc_id) AS r FROM cal, (SELECT unnest(range(1, {DRAWS + 1})) AS draw)),
sizes AS (SELECT size FROM (SELECT unnest({SIZES}) AS size) WHERE size <= (SELECT count(*) FROM cal)),
measured AS (SELECT size, draw, setting, {MEASURES.format(a=LOOSE)} FROM sampled JOIN sizes ON r <= size JOIN decided USING (doc_id) GROUP BY ALL),
tested AS (SELECT m.*, place, {hb_sql('loss', 'n', LOOSE / (1 + LOOSE))} AS p FROM measured m JOIN ordered USING (setting)),
best AS (SELECT size, draw, arg_max(setting, useful * 1000 - place / 1000.0) AS setting FROM (SELECT *, max(p) OVER (PARTITION BY size, draw ORDER BY place) AS worst FROM tested) WHERE worst <= {DELTA} GROUP BY ALL),
on_test AS (SELECT setting, avg((state = 'supported_useful')::INT) AS useful FROM decided WHERE half = 0 AND doc_id % 2 = 1 GROUP BY setting),
curve AS (SELECT size, count(*) AS ok, round(avg(useful), 4) AS mean FROM best JOIN on_test USING (setting) GROUP BY size)
SELECT CAST(size AS INTEGER) AS calibration_items, {DRAWS} AS draws, coalesce(ok, 0) / {DRAWS} AS certified_share, coalesce(mean, -1.0) AS mean_test_useful_coverage FROM sizes LEFT JOIN curve USING (size)""",
    "labels_needed": NINE + f""", rows AS (SELECT setting, {MEASURES.format(a=LOOSE)} FROM decided JOIN ordered USING (setting) WHERE place = 1 AND half = 1 AND doc_id % 20 = 0 GROUP BY setting),
tried AS (SELECT setting, n * k AS total, sent, unsafe, {hb_sql('loss', '(n * k)', LOOSE / (1 + LOOSE))} AS p FROM rows, (SELECT unnest(range(2, 101)) AS k))
SELECT setting, coalesce(min(total) FILTER (sent > 0 AND unsafe < {LOOSE} * sent AND p <= {DELTA}), -1) AS items FROM tried GROUP BY setting""",
    "restored_shares": HALVES + "SELECT source, count(*) FILTER (send = 'unsupported') AS unsafe, round(coalesce(count(*) FILTER (send = 'unsupported' AND repair = 'supported_useful') / nullif(count(*) FILTER (send = 'unsupported'), 0), -1.0), 9) AS restored FROM items WHERE half = 0 GROUP BY source",
    "deployed_actions": HALVES + """SELECT doc_id, CASE WHEN risk / 4 < 0.02 THEN 'send' WHEN (doc_id % 100) / 99 > 0.9 THEN 'repair' ELSE 'abstain' END AS action,
  CASE WHEN risk / 4 < 0.02 THEN 'P(unsafe) ' || format('{:.3f}', risk / 4) || ' below 0.02' WHEN (doc_id % 100) / 99 > 0.9 THEN 'P(fix) ' || format('{:.3f}', (doc_id % 100) / 99) || ' above 0.9' ELSE 'neither sending nor repairing is safe enough' END AS reason FROM items WHERE half = 0""",
    "claim_features": LINES + "SELECT * REPLACE (round(a_mean, 9) AS a_mean) FROM features",
    "fused_risk": LINES + f""", logits AS (SELECT item_id, {INTERCEPT} + {' + '.join(f'{f} * {w}' for f, w in zip(outcome.CLAIM_FEATURES, WEIGHTS, strict=True))} AS z FROM features),
probs AS (SELECT item_id, least(greatest(1 / (1 + exp(-z)), 1e-6), 1 - 1e-6) AS p FROM logits), tempered AS (SELECT item_id, 1 / (1 + exp(-ln(p / (1 - p)) / 1.5)) AS p FROM probs)
SELECT o_orderkey AS item_id, round(coalesce(1 - exp(sum(ln(1 - p))), 0.5), 9) AS risk FROM orders LEFT JOIN tempered ON item_id = o_orderkey GROUP BY o_orderkey""",
    "calibrated_risk": STATES + """, points AS (SELECT risk AS p, count(*) AS n, sum(toxic) AS s FROM items GROUP BY risk), sums AS (SELECT p, row_number() OVER (ORDER BY p) AS i, n, s, sum(n) OVER (ORDER BY p) AS un, sum(s) OVER (ORDER BY p) AS us FROM points),
lowest AS (SELECT a.i AS j, b.i AS i, b.p AS p, min((b.us - a.us + a.s) / (b.un - a.un + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM sums a JOIN sums b ON a.i <= b.i)
SELECT p, round(max(m), 9) AS calibrated FROM lowest GROUP BY p""",
}
