"""The engine's operators on the star schema: evidence cells made from orders, claims made from cells, labels as verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.functions import text as T
from cellwright.operators import certify, evidence, matching, metrics, splits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of one table per market segment: rows are metrics, columns are regions and years, values are exact sums."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("string").alias("period"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", "r_name")
    customers = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "r_regionkey", "r_name", "period")
    sums = sums.agg(F.sum("price").cast("decimal(28,2)").alias("revenue"), F.count("*").cast("decimal(28,2)").alias("orders"), F.max("price").cast("decimal(28,2)").alias("largest"))
    rows = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(m).alias("metric"), F.col(m).alias("value")) for i, m in enumerate(("revenue", "orders", "largest"))])
    cells = sums.select("c_mktsegment", "r_regionkey", "r_name", "period", F.explode(rows).alias("m"))
    col = (F.col("period").cast("int") - 1990) * 10 + F.col("r_regionkey")
    return cells.select(
        F.col("c_mktsegment").alias("evidence_id"), F.lit("t1").alias("table_id"), "m.row", col.alias("col"), F.format_string("t1r%dc%d", "m.row", col).alias("id"), (F.col("m.row") * 1000 + col).alias("seq"), F.lit("amount").alias("kind"),
        "m.metric", F.col("r_name").alias("entity"), "period", F.col("m.value").alias("raw"), "m.value", F.lit(None).cast("string").alias("currency"),
    )


CELLS = """
WITH sums AS (
  SELECT c_mktsegment, r_regionkey, r_name, CAST(year(o_orderdate) AS VARCHAR) AS period,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS revenue, CAST(count(*) AS DECIMAL(28,2)) AS orders, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS largest
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), wide AS (
  SELECT *, 0 AS row, 'revenue' AS metric, revenue AS value FROM sums UNION ALL SELECT *, 1, 'orders', orders FROM sums UNION ALL SELECT *, 2, 'largest', largest FROM sums
), cells AS (
  SELECT c_mktsegment AS item_id, 't1' AS table_id, row, (CAST(period AS INTEGER) - 1990) * 10 + r_regionkey AS col, row * 1000 + (CAST(period AS INTEGER) - 1990) * 10 + r_regionkey AS seq,
    metric, r_name AS entity, period, value FROM wide
)
"""


def evidence_cells(spark, d):
    c = order_cells(spark, d).withColumnRenamed("evidence_id", "item_id")
    return c.select("item_id", "table_id", "row", "col", "seq", "metric", "entity", "period", F.col("value").cast("double").alias("value"))


def period_changes(spark, d):
    c = evidence.changes(order_cells(spark, d))
    return c.select(F.col("evidence_id").alias("item_id"), "metric", "entity", "period", "base_period", "relation", F.coalesce("slot", F.lit("")).alias("slot"), F.round("value", 4).alias("result"))


def entity_differences(spark, d):
    cells = order_cells(spark, d)
    other = cells.select("evidence_id", F.col("id").alias("other_id"), F.col("entity").alias("other"))
    found = evidence.entity_differences(cells).withColumn("other_id", F.col("cells")[1]).join(other, ["evidence_id", "other_id"])
    return found.select(F.col("evidence_id").alias("item_id"), "metric", "entity", "other", "period", F.round("value", 2).alias("result"))


def column_shares(spark, d):
    found = evidence.column_pairs(order_cells(spark, d))
    return found.select(F.col("evidence_id").alias("item_id"), "metric", F.col("other_metric").alias("of_metric"), "entity", "period", "relation", F.round("value", 6).alias("result"))


def base_period_lookup(spark, d):
    b = evidence.base_periods(order_cells(spark, d))
    return b.select(F.col("evidence_id").alias("item_id"), "metric", "entity", "period", "base_period", F.col("base").cast("double").alias("base"))


def _wanted(cells):
    none = F.array().cast("array<struct<table_id:string,row:int>>")
    wanted = cells.select("evidence_id", "metric", "entity", "period").distinct().select("*", none.alias("prefer"), F.lit(False).alias("rate"), F.lit(None).cast("string").alias("base_period"))
    return wanted.withColumn("key", F.concat_ws(":", "evidence_id", "metric", "entity", "period"))


def target_lookup(spark, d):
    """The one cell that each metric, region and year means; every third region also asks without naming a region (ambiguous)."""
    cells = order_cells(spark, d)
    wanted = _wanted(cells).withColumn("entity", F.when(F.col("entity") < "B", F.lit(None)).otherwise(F.col("entity")))
    found = evidence.target_cells(cells, wanted, ["key"])
    return wanted.join(found, "key", "left").select("key", F.col("value").cast("double").alias("target"))


def target_changes(spark, d):
    """The change that each metric, region and year means: from the latest year before, unless 1993 is stated as the base."""
    cells = order_cells(spark, d)
    wanted = _wanted(cells).withColumn("base_period", F.when(F.col("period") > "1995", F.lit("1993")))
    found = evidence.target_pairs(cells, wanted, ["key"])
    return found.select("key", F.round((F.col("now.value") - F.col("base.value")).cast("double"), 2).alias("change"))


def made_claims(cells: DataFrame) -> DataFrame:
    """A claim per revenue cell: rounded to thousands; every fourth year negative or in the wrong unit; some name the next year."""
    year = F.col("period").cast("int")
    base = F.round(F.col("value").cast("double") / 1000) * 1000
    value = F.when(year % 4 == 1, -base).when(year % 4 == 2, base * 1000).otherwise(base)
    unit = F.when(year % 4 == 2, 6).otherwise(3)
    period = F.when(year % 3 == 0, (year + 1).cast("string")).otherwise(F.col("period"))
    return cells.where("metric = 'revenue'").select("item_id", F.concat_ws(":", "entity", "period").alias("claim_id"), value.alias("value"), unit.alias("unit"), "metric", "entity", period.alias("period"))


def claim_matching(spark, d):
    cells = order_cells(spark, d).withColumnRenamed("evidence_id", "item_id")
    candidates = cells.select("item_id", F.col("seq").alias("cand_seq"), "value", F.lit("cell").alias("relation"), F.lit(0).alias("rank"), "metric", "entity", "period")
    m = matching.match_claims(made_claims(cells), candidates, [3, 6])
    return m.select("item_id", "claim_id", F.coalesce(F.array_join("slots", ","), F.lit("")).alias("slots"), F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("cand_seq", F.lit(-1)).alias("cand_seq"), "verdict")


def sibling_facts(spark, d):
    """Order sums as facts with three context parts; pairs that differ in one of them."""
    o = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    s = matching.siblings(o, ["o_orderstatus", "o_orderpriority", "year"], [])
    return s.select("o_orderstatus", "o_orderpriority", "year", "value", "differs", "other", "other_value")


def quality_states(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as checked items: risk from length and digits, state from labels."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    risk = F.round(F.col("n_chars") % 1000 / 1000.0, 3)
    state = F.when(risk >= 0.8, "abstained").when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported_useful").otherwise("supported_unhelpful")
    return docs.select("doc_id", "source", "lang", "quality", "toxic", risk.alias("risk"), state.alias("state"), F.length(F.coalesce("text", F.lit(""))).alias("n"))


def hb_sql(loss: str, n: str, alpha: float) -> str:
    """The smaller tail bound of a mean loss as SQL; the binomial tail as a sum of log-gamma terms."""
    x = f"least(greatest({loss}, 1e-12), 1 - 1e-12)"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({alpha!r}) + ({n} - i) * ln(1 - {alpha!r}))"
    tail = f"coalesce(list_sum(list_transform(range(0, CAST(ceil({n} * ({loss}) - 1e-9) AS BIGINT) + 1), lambda i: {term})), 0.0)"
    return f"CASE WHEN {loss} >= {alpha!r} THEN 1.0 ELSE least(1.0, exp(-{n} * ({x} * ln({x} / {alpha!r}) + (1 - {x}) * ln((1 - {x}) / (1 - {alpha!r})))), exp(1.0) * {tail}) END"


STATES = """
WITH items AS (
  SELECT doc_id, source, lang, quality, toxic, risk, CASE WHEN risk >= 0.8 THEN 'abstained' WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported_useful' ELSE 'supported_unhelpful' END AS state
  FROM (SELECT *, round((n_chars % 1000) / 1000.0, 3) AS risk FROM documents JOIN labels USING (doc_id))
)
"""


def policy_metrics(spark, d):
    m = metrics.policy_metrics(quality_states(spark, d), ["lang"])
    return m.select("lang", "items", "emitted", "unsafe_emitted", *[F.round(c, 9).alias(c) for c in ("emission_coverage", "residual_risk", "useful_coverage")])


def flip_matrix(spark, d):
    s = quality_states(spark, d)
    before = F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 1, "useful").otherwise("useless")
    return metrics.flip_matrix(s.select(before.alias("before"), F.col("state").alias("after")), ["unsafe", "useful", "useless"], list(metrics.STATES))


def rater_agreement(spark, d):
    s = quality_states(spark, d).withColumn("rule", (F.col("risk") < 0.5).cast("int"))
    return metrics.cohen_kappa(s, "quality", "rule").select("n", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")])


def calibration_error(spark, d):
    return metrics.calibration(quality_states(spark, d), ["lang"], "risk", "toxic").select("lang", F.round("brier", 9).alias("brier"), F.round("ece", 9).alias("ece"))


def ranking_quality(spark, d):
    return metrics.auroc(quality_states(spark, d), ["lang"], "risk", "quality").select("lang", F.round("auroc", 9).alias("auroc"))


def false_alarm_threshold(spark, d):
    return metrics.order_threshold(quality_states(spark, d), ["lang"], "risk", "toxic").select("lang", "threshold", F.round("recall", 9).alias("recall"))


def issuer_splits(spark, d):
    c = table(spark, d, "customer").select(splits.track_split(F.col("c_name")).alias("split"), splits.part_of(F.col("c_name"), 4).alias("quarter"))
    return c.groupBy("split", "quarter").agg(F.count("*").alias("n"))


def stratified_sample(spark, d):
    return splits.stratified(quality_states(spark, d), ["lang", "state"], "doc_id", 60).select("doc_id", "lang", "state")


def equal_draw(spark, d):
    return splits.draw_per_group(quality_states(spark, d), ["source"], "doc_id", 5).select("doc_id", "source")


def unlabelled_documents(spark, d):
    return splits.todo(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


def issuer_means(spark, d):
    """Mean of issuer means: the two-level mean behind a cluster p-value."""
    by = quality_states(spark, d).groupBy("lang", "source").agg(F.avg(F.col("toxic").cast("double")).alias("m"))
    return by.groupBy("lang").agg(F.round(F.avg("m"), 9).alias("mean_of_means"), F.count("*").alias("issuers"))


def certified_settings(spark, d):
    s = quality_states(spark, d).withColumn("half", splits.part_of(F.col("doc_id"), 2))
    rows = certify.decisions(s, [(f"risk<{t / 10:.1f}", t / 10) for t in range(1, 10)]).withColumns({"unsafe": F.col("toxic"), "useful": F.col("quality")})
    c = certify.certify(rows.where("half = 0"), rows.where("half = 1"), 0.2, 0.05)
    return c.select("setting", "place", "n", F.round("loss", 9).alias("loss"), F.round("useful_coverage", 9).alias("useful_coverage"), F.round("p_value", 6).alias("p_value"), "certified")


def wording_flags(spark, d):
    """Sentences of eight kinds, one an order: why code can't vouch for each, and currencies that a report in rupees lacks."""
    said = [
        "The profit was not stated.", "It may be due to higher income.", "The growth was driven by loans of $5.", "Profit doubled to Rs. 5.", "Interim profit was 7.", "The margin moved by 3 basis points.",
        "No figure for the third quarter.", "Sales of ₹5 and €3 in all.",
    ]
    o = table(spark, d, "orders").select("o_orderkey", F.get(F.array(*[F.lit(x) for x in said]), (F.col("o_orderkey") % 8).cast("int")).alias("text"))
    return o.select("o_orderkey", F.array_join(T.wording_reasons(F.col("text")), "; ").alias("reasons"), F.array_join(T.foreign_currencies(F.col("text"), F.array(F.lit("LKR"))), ",").alias("currencies"))


def label_readings(spark, d):
    """Labels written in eight ways from each order's year: the fiscal year, line item, entity and scale that they name."""
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    y, k = F.col("y").cast("string"), F.col("o_orderkey") % 8
    short = F.right(y, F.lit(2))
    after = F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    label = (
        F.when(k == 0, said("Group profit FY", y)).when(k == 1, said("Net loans & advances (note 3) ", y, "/", after)).when(k == 2, said("Bank's cost % ", y, "-", after, " Rs. '000"))
        .when(k == 3, said("Standalone ", y, "/", (F.col("y") - 1).cast("string"), " (in millions)")).when(k == 4, said("As at 31 December ", y, ", US$ mn")).when(k == 5, said("Consolidated FY", short, " (Rs 000)"))
        .when(k == 6, said("note 12 Deposits in billions")).otherwise(said("Millions of people in ", y, " and ", (F.col("y") + 1).cast("string"), " parent"))
    )
    rows = o.select("o_orderkey", label.alias("label"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    label = F.col("label")
    return rows.select("o_orderkey", empty(T.normalise_period(label)).alias("period"), T.normalise_metric(label).alias("metric"), empty(T.entity_of(label)).alias("entity"), T.detect_scale(label).alias("scale"))


def read_figures(spark, d):
    """Figures written in ten ways from each order's total: kind, value, scale and decimals as they are read."""
    from cellwright.functions.figures import figures

    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice")).cast("long").alias("v"))
    n, k = F.col("v").cast("string"), F.col("o_orderkey") % 10
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    grouped = F.format_number(F.col("v"), 0)
    text = (
        F.when(k == 0, said("sold Rs. ", grouped, " million of it")).when(k == 1, said("rose ", n, ".25% since")).when(k == 2, said("moved ", n, " bps")).when(k == 3, said("was ", n, ".5x that")).when(k == 4, said("about ", grouped, " (in thousands) left"))
        .when(k == 5, said("Rs. '000 ", grouped, " in all")).when(k == 6, said("a loss of (", n, ")% then")).when(k == 7, said("on 31 December 1995 it had ", n, ".123456789 left")).when(k == 8, said("some US$", n, "bn, FY1996"))
        .otherwise(said("-", n, " lakh"))
    )
    rows = o.select("o_orderkey", F.explode(figures(text)).alias("f"))
    return rows.select("o_orderkey", "f.kind", F.round(F.col("f.value").cast("double"), 4).alias("value"), "f.scale", "f.decimals", F.coalesce("f.currency", F.lit("")).alias("currency"))


def named_periods(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce(T.normalise_period(F.col("text")), F.lit("")).alias("period"), T.detect_scale(F.col("text")).alias("scale"))


def metric_names(spark, d):
    p = table(spark, d, "part").select(T.normalise_metric(F.concat_ws(" & ", "p_name", "p_type")).alias("metric"))
    return p.groupBy("metric").agg(F.count("*").alias("n"))


def event_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("kinds"))


def hourly_events(spark, d):
    from cellwright.streaming.items import event_windows

    w = event_windows(table(spark, d, "events"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


def series_carry(spark, d):
    """Section carry-forward: the last large order's priority down a customer's orders."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return o.select("o_orderkey", F.coalesce(F.last(F.when(F.col("o_totalprice") > 200000, F.col("o_orderpriority")), ignorenulls=True).over(w), F.lit("")).alias("section"))


def figures_per_document(spark, d):
    from cellwright.functions.figures import figures

    f = table(spark, d, "documents").where(F.col("text").rlike(r"\d")).select("doc_id", F.explode(figures("text")).alias("f"))
    return f.select("doc_id", "f.start", "f.end", "f.kind", F.col("f.value").cast("double").alias("value"), "f.decimals")


def queries() -> dict:
    fs = (
        evidence_cells, period_changes, entity_differences, column_shares, base_period_lookup, target_lookup, target_changes, claim_matching, sibling_facts, policy_metrics, flip_matrix, rater_agreement, calibration_error,
        ranking_quality, false_alarm_threshold, issuer_splits, stratified_sample, equal_draw, unlabelled_documents, issuer_means, certified_settings, wording_flags, label_readings, read_figures,
        event_props, hourly_events, series_carry, named_periods, metric_names, figures_per_document,
    )
    return {f.__name__: f for f in fs}


SQL = {
    # runs of digits are marked, as the pattern speaks of what is no digit around them
    "named_periods": r"""WITH marked AS (SELECT doc_id, text, lower(text) AS low, regexp_replace(text, '([0-9]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM documents),
found AS (SELECT *, list_last(regexp_extract_all(m, '\x01(?:19|20)[0-9]{2}\x02(?:\s?[/-]\s?\x01[0-9]{2,4}\x02)?')) AS y FROM marked),
years AS (SELECT *, regexp_extract(y, '^\x01([0-9]{4})', 1) AS a, regexp_extract(y, '^\x01[0-9]{4}\x02\s?[/-]\s?\x01([0-9]+)', 1) AS b FROM found)
SELECT doc_id, CASE WHEN y IS NULL THEN CASE WHEN regexp_matches(text, '(?i)\bFY\s?[0-9]{2}\b') THEN '20' || regexp_extract(text, '(?i)\bFY\s?([0-9]{2})\b', 1) ELSE '' END
    WHEN TRY_CAST(b AS INTEGER) + CASE length(b) WHEN 2 THEN 2000 ELSE 0 END > CAST(a AS INTEGER) THEN CAST(CAST(b AS INTEGER) + CASE length(b) WHEN 2 THEN 2000 ELSE 0 END AS VARCHAR) ELSE a END AS period,
  CASE WHEN regexp_matches(low, '[''’‘]000|in thousands|thousands of|(rs\.?|lkr|usd|us\$|\$)\s?000\b') THEN 3 WHEN regexp_matches(low, 'in millions|millions of|\bmn\b|\(million|\bmillion\)') THEN 6 WHEN regexp_matches(low, 'in billions|billions of|\bbn\b') THEN 9 ELSE 0 END AS scale FROM years""",
    "certified_settings": STATES + f""", decided AS (SELECT i.*, CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[64] AS INTEGER) % 2 AS half, 'risk<0.' || t AS setting, (risk < t / 10.0)::INT AS sent FROM items i, (SELECT unnest(range(1, 10)) AS t)),
ordered AS (SELECT setting, row_number() OVER (ORDER BY coalesce(sum(sent * toxic) / nullif(sum(sent), 0), 0), avg(sent), setting) AS place FROM decided WHERE half = 0 GROUP BY setting),
measured AS (SELECT setting, count(*) AS n, avg((sent * toxic - 0.2 * sent + 0.2) / 1.2) AS loss, avg(sent * quality) AS useful FROM decided WHERE half = 1 GROUP BY setting),
tested AS (SELECT m.*, place, {hb_sql('loss', 'n', 0.2 / 1.2)} AS p FROM measured m JOIN ordered USING (setting))
SELECT setting, CAST(place AS INTEGER) AS place, n, round(loss, 9) AS loss, round(useful, 9) AS useful_coverage, round(p, 6) AS p_value, max(p) OVER (ORDER BY place) <= 0.05 AS certified FROM tested""",
    "evidence_cells": CELLS + "SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM cells",
    "period_changes": CELLS + """, pairs AS (
  SELECT a.*, b.period AS base_period, CAST(a.value AS DOUBLE) AS x, CAST(b.value AS DOUBLE) AS y FROM cells a JOIN cells b USING (item_id, table_id, row, entity) WHERE b.period < a.period)
SELECT item_id, metric, entity, period, base_period, 'diff' AS relation, '' AS slot, round(x - y, 4) AS result FROM pairs
UNION ALL SELECT item_id, metric, entity, period, base_period, 'growth', '', round((x - y) * 100 / abs(y), 4) FROM pairs WHERE y <> 0
UNION ALL SELECT item_id, metric, entity, period, base_period, 'growth', 'basis', round((x - y) * 100 / abs(x), 4) FROM pairs WHERE x <> 0""",
    "entity_differences": CELLS + "SELECT a.item_id AS item_id, a.metric AS metric, a.entity AS entity, b.entity AS other, a.period AS period, round(CAST(a.value - b.value AS DOUBLE), 2) AS result FROM cells a JOIN cells b USING (item_id, table_id, row, period) WHERE a.entity <> b.entity",
    "column_shares": CELLS + """, pairs AS (SELECT a.item_id, a.metric, b.metric AS of_metric, a.entity, a.period, CAST(a.value AS DOUBLE) AS x, CAST(b.value AS DOUBLE) AS y FROM cells a JOIN cells b USING (item_id, table_id, col) WHERE (a.row <> b.row OR a.entity <> b.entity) AND b.value <> 0)
SELECT item_id, metric, of_metric, entity, period, 'share' AS relation, round(x * 100 / y, 6) AS result FROM pairs WHERE abs(x) <= abs(y)
UNION ALL SELECT item_id, metric, of_metric, entity, period, 'ratio', round(x / y, 6) FROM pairs WHERE abs(x) <= abs(y)""",
    "base_period_lookup": CELLS + "SELECT item_id, metric, entity, period, lag(period) OVER w AS base_period, CAST(lag(value) OVER w AS DOUBLE) AS base FROM cells WINDOW w AS (PARTITION BY item_id, row, entity ORDER BY period)",
    "target_lookup": CELLS + """, wanted AS (SELECT DISTINCT item_id, metric, entity, period, CASE WHEN entity < 'B' THEN NULL ELSE entity END AS asked FROM cells),
found AS (SELECT w.item_id || ':' || w.metric || ':' || w.entity || ':' || w.period AS key, w.asked, c.value FROM wanted w JOIN cells c ON w.item_id = c.item_id AND w.metric = c.metric AND w.period = c.period AND (w.asked IS NULL OR w.asked = c.entity))
SELECT key, CASE WHEN count(DISTINCT value) = 1 THEN CAST(min(value) AS DOUBLE) END AS target FROM found GROUP BY key""",
    "target_changes": CELLS + """, pairs AS (
  SELECT a.item_id || ':' || a.metric || ':' || a.entity || ':' || a.period AS key, a.value AS now, b.value AS base, row_number() OVER (PARTITION BY a.item_id, a.row, a.entity, a.period ORDER BY CASE WHEN a.period > '1995' AND b.period = '1993' THEN 0 ELSE 1 END, b.period DESC) AS nth
  FROM cells a JOIN cells b ON a.item_id = b.item_id AND a.row = b.row AND a.entity = b.entity AND b.period < a.period)
SELECT key, round(CAST(now - base AS DOUBLE), 2) AS change FROM pairs WHERE nth = 1""",
    "claim_matching": CELLS + """, claims AS (
  SELECT item_id, entity || ':' || period AS claim_id, metric, entity, CASE WHEN y % 3 = 0 THEN CAST(y + 1 AS VARCHAR) ELSE period END AS period,
    CASE y % 4 WHEN 1 THEN -b WHEN 2 THEN b * 1000 ELSE b END AS v, CASE WHEN y % 4 = 2 THEN 6 ELSE 3 END AS unit
  FROM (SELECT *, CAST(period AS INTEGER) AS y, round(CAST(value AS DOUBLE) / 1000) * 1000 AS b FROM cells WHERE metric = 'revenue')
), ways AS (SELECT * FROM (VALUES (0, 1, 0, NULL), (1, -1, 0, 'sign'), (2, 1, 3, 'scale_currency'), (3, 1, -3, 'scale_currency'), (4, 1, 6, 'scale_currency'), (5, 1, -6, 'scale_currency'), (6, 1, 9, 'scale_currency'), (7, 1, -9, 'scale_currency')) t(way, s, shift, slot)
), hits AS (
  SELECT c.*, k.seq, k.metric AS km, k.entity AS ke, k.period AS kp, w.way, w.slot, row_number() OVER (PARTITION BY c.item_id, c.claim_id, k.seq ORDER BY w.way) AS first
  FROM claims c JOIN cells k ON c.item_id = k.item_id JOIN ways w ON abs(c.v * w.s * pow(10.0, w.shift) - CAST(k.value AS DOUBLE)) <= pow(10.0, c.unit + w.shift) / 2 + 1e-9 * greatest(1.0, pow(10.0, c.unit + w.shift))
), ranked AS (
  SELECT *, list_sort(list_filter([slot, CASE WHEN metric <> km THEN 'metric' END, CASE WHEN entity <> ke THEN 'entity_scope' END, CASE WHEN period <> kp THEN 'period' END], lambda x: x IS NOT NULL)) AS slots FROM hits WHERE first = 1
), best AS (SELECT *, row_number() OVER (PARTITION BY item_id, claim_id ORDER BY len(slots), seq) AS n FROM ranked)
SELECT c.item_id AS item_id, c.claim_id AS claim_id, coalesce(array_to_string(b.slots, ','), '') AS slots, CASE WHEN b.seq IS NULL THEN '' ELSE 'cell' END AS relation, coalesce(b.seq, -1) AS cand_seq,
  CASE WHEN b.seq IS NULL THEN 'unverifiable' WHEN len(b.slots) = 0 THEN 'supported' ELSE 'unsupported' END AS verdict
FROM claims c LEFT JOIN best b ON c.item_id = b.item_id AND c.claim_id = b.claim_id AND b.n = 1""",
    "sibling_facts": """WITH o AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY ALL)
SELECT a.o_orderstatus AS o_orderstatus, a.o_orderpriority AS o_orderpriority, a.year AS year, a.value AS value,
  CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' WHEN a.o_orderpriority <> b.o_orderpriority THEN 'o_orderpriority' ELSE 'year' END AS differs,
  CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN b.o_orderstatus WHEN a.o_orderpriority <> b.o_orderpriority THEN b.o_orderpriority ELSE CAST(b.year AS VARCHAR) END AS other, b.value AS other_value
FROM o a JOIN o b ON (CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 1 ELSE 0 END + CASE WHEN a.o_orderpriority <> b.o_orderpriority THEN 1 ELSE 0 END + CASE WHEN a.year <> b.year THEN 1 ELSE 0 END) = 1 AND a.value <> b.value""",
    "policy_metrics": STATES + """SELECT lang, count(*) AS items, count(*) FILTER (state <> 'abstained') AS emitted, count(*) FILTER (state = 'unsupported') AS unsafe_emitted,
  round(count(*) FILTER (state <> 'abstained') / count(*), 9) AS emission_coverage, round(coalesce(count(*) FILTER (state = 'unsupported') / nullif(count(*) FILTER (state <> 'abstained'), 0), 0), 9) AS residual_risk,
  round(count(*) FILTER (state = 'supported_useful') / count(*), 9) AS useful_coverage FROM items GROUP BY lang""",
    "flip_matrix": STATES + """SELECT b.before AS before, count(*) FILTER (state = 'supported_useful') AS supported_useful, count(*) FILTER (state = 'supported_unhelpful') AS supported_unhelpful,
  count(*) FILTER (state = 'unsupported') AS unsupported, count(*) FILTER (state = 'abstained') AS abstained
FROM (VALUES ('unsafe'), ('useful'), ('useless')) b(before) LEFT JOIN (SELECT state, CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 1 THEN 'useful' ELSE 'useless' END AS before FROM items) i USING (before) GROUP BY b.before""",
    "rater_agreement": STATES + """, r AS (SELECT quality AS a, CAST(risk < 0.5 AS INTEGER) AS b FROM items), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS o, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS e FROM r)
SELECT n, round(o, 9) AS observed, round(e, 9) AS expected, round((o - e) / (1 - e), 9) AS kappa FROM t""",
    "calibration_error": STATES + """, c AS (SELECT lang, least(floor(risk * 10), 9) AS bin, count(*) AS n, sum(risk) AS p, sum(toxic) AS y, sum((risk - toxic) * (risk - toxic)) AS sq FROM items GROUP BY ALL)
SELECT lang, round(sum(sq) / sum(n), 9) AS brier, round(sum(abs(p - y)) / sum(n), 9) AS ece FROM c GROUP BY lang""",
    "ranking_quality": STATES + """, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY risk) + (count(*) OVER (PARTITION BY lang, risk) - 1) / 2.0 AS rk FROM items)
SELECT lang, round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / nullif(CAST(count(*) FILTER (quality = 1) AS DOUBLE) * count(*) FILTER (quality = 0), 0), 9) AS auroc FROM r GROUP BY lang""",
    "false_alarm_threshold": STATES + """, t AS (SELECT lang, list_sort(list(risk))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS threshold FROM items WHERE toxic = 0 GROUP BY lang)
SELECT lang, any_value(threshold) AS threshold, round(count(*) FILTER (toxic = 1 AND risk > threshold) / nullif(count(*) FILTER (toxic = 1), 0), 9) AS recall FROM items JOIN t USING (lang) GROUP BY lang""",
    "issuer_splits": """SELECT CASE WHEN x < 0.5 THEN 'fit' WHEN x < 0.6 THEN 'tune' WHEN x < 0.8 THEN 'calibration' ELSE 'test' END AS split, CAST(CAST('0x' || h[64] AS INTEGER) % 4 AS INTEGER) AS quarter, count(*) AS n
FROM (SELECT sha256(c_name) AS h, CAST('0x' || sha256(c_name)[1:8] AS BIGINT) / 4294967295.0 AS x FROM customer) GROUP BY ALL""",
    "stratified_sample": STATES + """, s AS (SELECT lang, state, count(*) AS n FROM items GROUP BY ALL), q AS (SELECT *, n * 60 / sum(n) OVER () AS exact, sum(n) OVER () AS total FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, lang, state) AS nth, least(60, total) - sum(floor(exact)) OVER () AS spare FROM q)
SELECT doc_id, lang, state FROM (SELECT i.*, floor(exact) + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS quota, row_number() OVER (PARTITION BY lang, state ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM items i JOIN r USING (lang, state)) WHERE k <= quota""",
    "equal_draw": STATES + "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM items) WHERE k <= 5",
    "unlabelled_documents": "SELECT lang, count(*) AS n FROM documents ANTI JOIN labels USING (doc_id) GROUP BY lang",
    "issuer_means": STATES + "SELECT lang, round(avg(m), 9) AS mean_of_means, count(*) AS issuers FROM (SELECT lang, source, avg(toxic) AS m FROM items GROUP BY ALL) GROUP BY lang",
    "wording_flags": r"""SELECT o_orderkey, array_to_string(list_filter([
  CASE WHEN k IN (0, 1, 6) THEN 'a negation, hedge or guess' END, CASE WHEN k IN (1, 2) THEN 'an explanation or judgement' END, CASE WHEN k IN (3, 6) THEN 'a figure in words or a fraction' END,
  CASE WHEN k IN (4, 6) THEN 'a quarter or part of a year' END, CASE WHEN k = 5 THEN 'percentage points' END], lambda x: x IS NOT NULL), '; ') AS reasons, CASE k WHEN 2 THEN 'USD' WHEN 7 THEN 'INR,EUR' ELSE '' END AS currencies
FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)""",
    "metric_names": r"""SELECT trim(regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^a-z0-9%'' ]+', ' ', 'g'), '\s+', ' ', 'g')) AS metric, count(*) AS n FROM part GROUP BY 1""",
    "label_readings": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT o_orderkey, CASE k WHEN 6 THEN '' WHEN 1 THEN CAST(2000 + (y + 1) % 100 AS VARCHAR) WHEN 2 THEN CAST(2000 + (y + 1) % 100 AS VARCHAR) WHEN 5 THEN '20' || right(CAST(y AS VARCHAR), 2) WHEN 7 THEN CAST(y + 1 AS VARCHAR) ELSE CAST(y AS VARCHAR) END AS period,
  CASE k WHEN 0 THEN 'group profit' WHEN 1 THEN 'net loans and advances' WHEN 2 THEN 'bank''s cost % rs ''000' WHEN 3 THEN 'standalone' WHEN 4 THEN 'as at 31 december us mn' WHEN 5 THEN 'consolidated fy' || right(CAST(y AS VARCHAR), 2)
    WHEN 6 THEN 'deposits in billions' ELSE 'millions of people in and parent' END AS metric,
  CASE k WHEN 0 THEN 'group' WHEN 2 THEN 'bank' WHEN 3 THEN 'company' WHEN 5 THEN 'group' WHEN 7 THEN 'company' ELSE '' END AS entity,
  CASE k WHEN 2 THEN 3 WHEN 3 THEN 6 WHEN 4 THEN 6 WHEN 5 THEN 3 WHEN 6 THEN 9 WHEN 7 THEN 6 ELSE 0 END AS scale FROM o""",
    "read_figures": """WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, CAST(floor(o_totalprice) AS DOUBLE) AS v FROM orders)
SELECT o_orderkey, CASE WHEN k IN (1, 2, 6) THEN 'percent' WHEN k = 3 THEN 'ratio' WHEN k = 7 THEN 'number' ELSE 'amount' END AS kind,
  round(CASE k WHEN 0 THEN v * 1e6 WHEN 1 THEN v + 0.25 WHEN 2 THEN v / 100 WHEN 3 THEN v + 0.5 WHEN 4 THEN v * 1e3 WHEN 5 THEN v * 1e3 WHEN 6 THEN -v WHEN 7 THEN v + 0.123456789 WHEN 8 THEN v * 1e9 ELSE -v * 1e5 END, 4) AS value,
  CASE k WHEN 0 THEN 6 WHEN 4 THEN 3 WHEN 5 THEN 3 WHEN 8 THEN 9 WHEN 9 THEN 5 ELSE 0 END AS scale, CASE k WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 7 THEN 9 ELSE 0 END AS decimals, CASE k WHEN 0 THEN 'LKR' WHEN 5 THEN 'LKR' WHEN 8 THEN 'USD' ELSE '' END AS currency FROM o""",
    "event_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS kinds FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE), 2) AS total FROM events GROUP BY ALL",
    "series_carry": "SELECT o_orderkey, coalesce(last_value(CASE WHEN o_totalprice > 200000 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), '') AS section FROM orders",
}
