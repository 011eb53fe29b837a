"""Answers about statements made of the star schema: one statement a nation, planted errors, checks, repairs, replays.

A statement has four line items (net sales and the largest order in thousands, orders handled, the share of urgent ones) in
columns of year and entity (three market segments). Questions ask for a cell, a change, a growth rate or a share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.operators import certify, checker, evidence, injection, programs, scoring, tables
from cellwright.plans.evidence_queries import hb_sql, table
from cellwright.session import stored

SEGMENTS = {"AUTOMOBILE": ("group", 1), "BUILDING": ("bank", 2), "FURNITURE": ("company", 3)}


def statement_cells(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), (F.substring("o_orderpriority", 1, 1) == "1").cast("long").alias("urgent"))
    customers = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    by = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_mktsegment").isin(*SEGMENTS)).groupBy("n_name", "c_mktsegment", "year")
    sums = by.agg(F.sum("price").alias("sales"), F.max("price").alias("largest"), F.count("*").alias("n"), F.sum("urgent").alias("urgent"))
    number = lambda c: c.cast("decimal(28,10)")
    line = lambda row, label, kind, raw, scale, places: F.struct(F.lit(row).alias("row"), F.lit(label).alias("row_label"), F.lit(kind).alias("kind"), number(raw).alias("raw"), F.lit(scale).alias("scale"), F.lit(places).alias("decimals"))
    lines = F.array(
        line(0, "Net sales", "amount", F.round(F.col("sales") / 1000, 0), 3, 0), line(1, "Largest order", "amount", F.round(F.col("largest") / 1000, 0), 3, 0), line(2, "Orders handled", "amount", F.col("n"), 0, 0),
        line(3, "Urgent share", "percent", F.round(F.col("urgent") * F.lit(100).cast("decimal(5,0)") / F.col("n"), 1), 0, 1),
    )
    entity, nth = (F.create_map(*[F.lit(x) for s, two in SEGMENTS.items() for x in (s, two[i])])[F.col("c_mktsegment")] for i in (0, 1))
    cells = sums.select("n_name", entity.alias("entity"), nth.alias("nth"), "year", F.explode(lines).alias("l")).select("*", "l.*").withColumn("col", (F.col("year") - 1992) * 3 + F.col("nth"))
    factor = F.when(F.col("scale") == 3, F.lit(1000).cast("decimal(5,0)")).otherwise(F.lit(1).cast("decimal(5,0)"))
    return cells.select(
        F.col("n_name").alias("evidence_id"), F.lit("t1").alias("table_id"), "row", "col", F.format_string("t1r%dc%d", "row", "col").alias("id"), (F.col("row") * 1000 + F.col("col")).alias("seq"), "row_label", "kind", "raw",
        (F.col("raw") * factor).cast("decimal(38,10)").alias("value"), "scale", F.when(F.col("kind") == "amount", "LKR").alias("currency"), F.lower("row_label").alias("metric"), "entity", F.col("year").cast("string").alias("period"), "decimals",
    )


def made_examples(statements: DataFrame) -> DataFrame:
    """A question a cell of each shape: look-ups of net sales, growth of net sales, changes of orders handled, shares of the largest order."""
    cells = statements.withColumn("c", injection.cell_struct())
    key = ["evidence_id", "entity", "period"]
    pick = lambda row, name: cells.where(F.col("row") == row).select(*key, F.col("c").alias(name))
    before = lambda row: cells.where(F.col("row") == row).select("evidence_id", "entity", (F.col("period").cast("int") + 1).cast("string").alias("period"), F.col("c").alias("b"))
    none = F.lit(None).cast(cells.schema["c"].dataType)
    parts = [
        pick(0, "a").withColumn("b", none).withColumn("shape", F.lit("lookup")), pick(0, "a").join(before(0), key).withColumn("shape", F.lit("growth")), pick(2, "a").join(before(2), key).withColumn("shape", F.lit("difference")),
        pick(1, "a").join(pick(0, "b"), key).withColumn("shape", F.lit("share")),
    ]
    rows = reduce(DataFrame.unionByName, [p.select(*key, "a", "b", "shape") for p in parts])
    asked = F.concat(F.lit("What was the "), "entity", F.lit("'s "), "a.metric", F.lit(" in "), "period", F.lit("?"))
    return injection.shapes(rows.select(F.concat_ws(":", "evidence_id", "entity", "period", "shape").alias("question_id"), "evidence_id", "shape", "a", "b", asked.alias("question"), F.col("shape").alias("question_type")), statements)


def made_items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items with planted errors, their examples, and the statements' cells."""
    cells = stored(statement_cells(spark, d), "cells")
    examples = stored(made_examples(cells), "examples")
    items = injection.inject(examples, cells).join(examples.select("question_id", "question", "question_type"), "question_id")
    return items.withColumn("asked_period", F.lit(None).cast("string")), examples, cells


def own_evidence(items: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and cells, where an item with removed cells has evidence of its own, without them."""
    fewer = items.where("size(removed_cells) > 0").select("item_id", "evidence_id", "removed_cells")
    copies = cells.join(fewer.select("item_id", "evidence_id"), "evidence_id").drop("evidence_id").withColumnRenamed("item_id", "evidence_id")
    gone = fewer.select(F.col("item_id").alias("evidence_id"), F.explode("removed_cells").alias("id"))
    own = F.when(F.size("removed_cells") > 0, F.col("item_id")).otherwise(F.col("evidence_id"))
    return items.withColumn("evidence_id", own), cells.unionByName(evidence.without(copies, gone))


def injected_items(spark, d):
    """Every planted error: the wrong text, the right one, what ought to be done and which cells are behind it."""
    items, _, _ = made_items(spark, d)
    joined = lambda c: F.array_join(c, ",")
    return items.select("item_id", "error", "text", F.coalesce("correct_text", F.lit("")).alias("correct_text"), "expected_action", joined("changed_cells").alias("changed"), joined("removed_cells").alias("removed"))


def target_programs(spark, d):
    """The edits that mend each planted error, and no other figure."""
    items, _, _ = made_items(spark, d)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return injection.target_edits(items).select("item_id", "claim_id", "op", text("cell"), text("expr"), text("reason"))


def extracted_claims(spark, d):
    """What is read from the right answers: kind, value, direction, change or level, and context of every figure."""
    items, _, cells = made_items(spark, d)
    c = checker.claims_of(items.where("error = 'none'"), cells)
    return c.select("item_id", "claim_id", F.col("figure.kind").alias("kind"), F.round(F.col("figure.value").cast("double"), 4).alias("value"), F.coalesce("direction", F.lit("")).alias("direction"), "is_change", "metric", "entity", "period")


def checked_claims(spark, d):
    """Structured claims against all candidates: see ``structured_claims``."""
    cells = statement_cells(spark, d)
    c = checker.check(structured_claims(cells), cells, evidence.candidates(cells))
    return c.select("item_id", "claim_id", "verdict", F.array_join("slots", ",").alias("slots"), F.array_join("cells", ",").alias("cells"), F.coalesce("relation", F.lit("")).alias("relation"), F.round("expected", 3).alias("expected"), F.coalesce("fix", F.lit("")).alias("fix"))


def structured_claims(cells: DataFrame) -> DataFrame:
    """Two claims a net sales cell, by what its column leaves over when divided by 7: right, of the next year, negative, a
    thousandfold, of another line item, of another entity, or of no cell at all; and growth on the year before, half of it wrong."""
    series = cells.where("row = 0").select("evidence_id", "entity", "period", "col", F.col("raw").cast("double").alias("raw"))
    last = series.select("evidence_id", "entity", (F.col("period").cast("int") + 1).cast("string").alias("period"), F.col("raw").alias("before"))
    k = F.col("col") % 7
    rows = series.join(last, ["evidence_id", "entity", "period"], "left")
    amount = F.when(k == 2, -F.col("raw")).when(k == 3, F.col("raw") * 1000).when(k == 6, F.col("raw") + 123457).otherwise(F.col("raw")) * 1000
    rate = F.round((F.col("raw") - F.col("before")) * 100 / F.when(k % 2 == 0, F.col("before")).otherwise(F.col("raw")), 1)
    next_year = (F.col("period").cast("int") + 1).cast("string")
    figure = lambda kind, value, scale, places: F.struct(
        F.lit(kind).alias("kind"), value.cast("decimal(38,10)").alias("value"), (value / float(10**scale)).cast("decimal(38,10)").alias("raw"), F.lit(scale).alias("scale"), F.lit(places).alias("decimals"), F.lit(False).alias("bps"),
        F.when(F.lit(kind == "amount"), "LKR").alias("currency"),
    )
    level = F.struct(F.lit("k1").alias("claim_id"), figure("amount", amount, 3, 0).alias("figure"), F.lit(None).cast("string").alias("direction"), F.lit(False).alias("is_change"), F.when(k == 1, next_year).otherwise(F.col("period")).alias("period"), F.lit(None).cast("string").alias("base_period"))
    word = F.when(F.col("raw") >= F.col("before"), "up").otherwise("down")
    change = F.struct(
        F.lit("k2").alias("claim_id"), figure("percent", F.abs(rate), 0, 1).alias("figure"), word.alias("direction"), F.lit(True).alias("is_change"), F.col("period").alias("period"), (F.col("period").cast("int") - 1).cast("string").alias("base_period")
    )
    both = rows.select("*", F.explode(F.array(level, change)).alias("c")).where("c.claim_id = 'k1' OR before IS NOT NULL")
    metric = F.when((k == 4) & (F.col("c.claim_id") == "k1"), "largest order").otherwise("net sales")
    entity = F.when((k == 5) & (F.col("c.claim_id") == "k1") & (F.col("entity") != "bank"), "bank").otherwise(F.col("entity"))
    return both.select(
        F.concat_ws(":", "evidence_id", F.col("col").cast("string")).alias("item_id"), "evidence_id", "c.*", metric.alias("metric"), entity.alias("entity"), F.array(F.lit("net sales")).alias("named"), F.lit(False).alias("by_difference")
    )


def replayed(spark: SparkSession, d: str) -> DataFrame:
    """Every action on every item: what the policy does, and where sending and repairing lead."""
    items, examples, cells = made_items(spark, d)
    items, cells = own_evidence(stored(items, "items"), cells)
    cells = stored(cells, "cells")
    pool = stored(evidence.candidates(cells), "candidates")

    def recheck(again: DataFrame) -> tuple[DataFrame, DataFrame]:
        checks = stored(checker.check(checker.claims_of(again, cells), cells, pool), "checks")
        return checks, stored(checker.verdicts(again, checks), "verdicts")

    checks, verdicts = recheck(items)
    rows = scoring.features(checks, verdicts, items)
    decisions = scoring.decide(rows).join(items.select("item_id", "error", "shape", "expected_action"), "item_id")
    repaired = programs.repair(items, checks, verdicts, cells, recheck, lambda rows: stored(rows, "repairs"))
    gold = injection.gold_values(examples)
    ids = items.select("item_id", "question_id")
    sent = scoring.score_texts(items.select("item_id", "question_id", "text"), gold)
    after = scoring.score_texts(repaired.join(ids, "item_id").select("item_id", "question_id", F.col("repaired_text").alias("text")), gold)
    return scoring.outcomes(decisions, sent, after).join(repaired.select("item_id", "status", "attempts"), "item_id")


def replay_outcomes(spark, d):
    r = replayed(spark, d)
    return r.groupBy("shape", "error", "action", "send", "repair", "status", "attempts").agg(F.count("*").alias("n"))


def certificates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Replay-like records of labelled documents, in halves to tune and to calibrate."""
    from cellwright.operators import splits
    from cellwright.plans.evidence_queries import quality_states

    s = quality_states(spark, d).withColumn("half", splits.part_of(F.col("doc_id"), 2))
    p = F.col("risk")
    send = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 1, "supported_useful").otherwise("supported_unhelpful")
    repair = F.when(F.col("doc_id") % 3 == 0, "supported_useful").when(F.col("doc_id") % 3 == 1, "abstained").otherwise("unsupported")
    records = s.select("doc_id", "source", "half", "risk", F.when(F.col("n") > 200, 1).otherwise(0).alias("n_claims"), (F.col("doc_id") % 5 == 0).cast("int").alias("evidence_sufficient"), (p / 4).alias("p_unsafe"), ((F.col("doc_id") % 100) / 100).alias("p_fix"), send.alias("send"), repair.alias("repair"))
    records = records.withColumns({"p_clean": 1 - p, "p_fixable": p / 2, "p_neither": p / 2})
    return records.where("half = 0"), records.where("half = 1")


FAMILIES = ["outcome_aware", "verified_only", "threshold_v0", "four_state", "fixed", "oracle"]


def policy_grid(spark, d):
    """Metrics of every setting of every family."""
    from cellwright.operators.metrics import policy_metrics

    tune, _ = certificates(spark, d)
    m = policy_metrics(scoring.decided(tune, FAMILIES), ["family", "setting"])
    return m.select("family", "setting", "items", "emitted", "unsafe_emitted", F.round("useful_coverage", 9).alias("useful_coverage"))


def chosen_settings(spark, d):
    """The certified setting of each family with the highest useful coverage, then the lowest risk."""
    tune, calibration = certificates(spark, d)
    c = certify.chosen(certify.certify_states(scoring.decided(tune, FAMILIES), scoring.decided(calibration, FAMILIES), ["family"], 0.2, 0.05), ["family"])
    return c.select("family", F.coalesce("setting", F.lit("")).alias("setting"), "certified", F.round(F.coalesce("useful_coverage", F.lit(-1.0)), 9).alias("useful_coverage"))


def _grids(spark: SparkSession, d: str, total: bool) -> DataFrame:
    """Net sales and the largest order of each statement as a printed grid; with a total, which is off by five in every third nation."""
    cells = statement_cells(spark, d).where("row < 2")
    columns = cells.groupBy("evidence_id", "col").agg(F.first("entity").alias("entity"), F.first("period").alias("period"), F.max(F.when(F.col("row") == 0, F.col("raw"))).alias("sales"), F.max(F.when(F.col("row") == 1, F.col("raw"))).alias("largest"))
    by = columns.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("col", "entity", "period", "sales", "largest"))).alias("c"))
    line = lambda first, of: F.concat(F.array(F.lit(first)), F.transform("c", of))
    whole = lambda v: F.format_number(v, 0)
    off = F.when(F.regexp_extract("evidence_id", r"(\d+)$", 1).try_cast("int") % 3 == 0, 5).otherwise(0)
    lines = [line("Rs. '000", lambda c: F.concat_ws(" ", F.initcap(c["entity"]), c["period"])), line("Net sales", lambda c: whole(c["sales"])), line("Largest order", lambda c: whole(c["largest"]))]
    if total:
        lines.append(line("Total", lambda c: whole(c["sales"] + c["largest"] + off)))
    return by.select(F.col("evidence_id").alias("item_id"), F.lit("t1").alias("table_id"), F.lit("LKR").alias("currency"), F.array(*lines).alias("grid"))


def grid_statements(spark, d):
    """Cells as they are read back from printed grids."""
    c = tables.grid_cells(_grids(spark, d, False))
    return c.select("item_id", "id", "metric", "entity", "period", "kind", "scale", "currency", F.col("value").cast("double").alias("value"))


def checked_totals(spark, d):
    return tables.total_rows(_grids(spark, d, True)).select("item_id", "row", "adds_up")


def queries() -> dict:
    fs = (grid_statements, checked_totals, extracted_claims, checked_claims, injected_items, target_programs, policy_grid, chosen_settings, replay_outcomes)
    return {f.__name__: f for f in fs}


STATEMENTS = """
WITH sums AS (
  SELECT n_name AS evidence_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'group' WHEN 'BUILDING' THEN 'bank' ELSE 'company' END AS entity, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS nth, CAST(year(o_orderdate) AS INTEGER) AS y,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) AS sales, max(CAST(o_totalprice AS DECIMAL(18,2))) AS largest, count(*) AS n, count(*) FILTER (o_orderpriority[1] = '1') AS urgent
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') GROUP BY ALL
), cells AS (
  SELECT evidence_id, entity, y, (y - 1992) * 3 + nth AS col, 0 AS row, 'net sales' AS metric, 'amount' AS kind, 3 AS scale, CAST(round(sales / 1000) AS DOUBLE) AS raw, CAST(round(sales / 1000) AS DOUBLE) * 1000 AS v FROM sums
  UNION ALL SELECT evidence_id, entity, y, (y - 1992) * 3 + nth, 1, 'largest order', 'amount', 3, CAST(round(largest / 1000) AS DOUBLE), CAST(round(largest / 1000) AS DOUBLE) * 1000 FROM sums
  UNION ALL SELECT evidence_id, entity, y, (y - 1992) * 3 + nth, 2, 'orders handled', 'amount', 0, CAST(n AS DOUBLE), CAST(n AS DOUBLE) FROM sums
  UNION ALL SELECT evidence_id, entity, y, (y - 1992) * 3 + nth, 3, 'urgent share', 'percent', 0, CAST(round(urgent * CAST(100 AS DECIMAL(5,0)) / n, 1) AS DOUBLE), CAST(round(urgent * CAST(100 AS DECIMAL(5,0)) / n, 1) AS DOUBLE) FROM sums
), series AS (SELECT *, 't1r' || row || 'c' || col AS id, row * 1000 + col AS seq, CAST(y AS VARCHAR) AS period FROM cells
)
"""

def _signed_sql(value: str, body: str) -> str:
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || {body}"


def _format_sql(x: str, places: str) -> str:
    return f"CASE {places} " + " ".join(f"WHEN {p} THEN format('{{:,.{p}f}}', CAST(round({x}, {p}) AS DOUBLE))" for p in range(5)) + " END"


def _amount_places(value: str, scale: str) -> str:
    """Decimals of an amount: three digits at least, with up to two decimals for it; up to four until a digit shows."""
    x = f"(abs({value}) / pow(10, {scale}))"
    digits = f"CASE WHEN {x} >= 1 THEN floor(log10({x})) + 1 ELSE 0 END"
    return f"CAST(CASE WHEN {x} = 0 THEN 0 ELSE greatest(0, least(3 - ({digits}), 2), least(4, -floor(log10(2 * {x})))) END AS INTEGER)"


def _percent_places(value: str, places: str) -> str:
    return f"CAST(greatest({places}, CASE WHEN {value} = 0 THEN 0 ELSE least(4, -floor(log10(2 * abs({value})))) END) AS INTEGER)"


def amount_sql(value: str, scale: str) -> str:
    """An amount of rupees in a scale."""
    return _signed_sql(value, f"'Rs. ' || {_format_sql(f'(abs({value}) / pow(10, {scale}))', _amount_places(value, scale))} || CASE {scale} WHEN 3 THEN ' thousand' WHEN 6 THEN ' million' ELSE '' END")


def percent_sql(value: str, places: str) -> str:
    return _signed_sql(value, f"{_format_sql(f'CAST(abs({value}) AS DECIMAL(38,10))', _percent_places(value, places))} || '%'")


def _rounded_sql(x: str, places: str) -> str:
    return f"CASE {places} " + " ".join(f"WHEN {p} THEN CAST(round(CAST({x} AS DECIMAL(38,10)), {p}) AS DOUBLE)" for p in range(5)) + " END"


def _digest_sql(k: str) -> str:
    return f"CAST('0x' || sha256('{k}|' || ex.qid)[1:5] AS INTEGER)"


RATE_PLACES, SHARE_PLACES = "coalesce(places, CASE WHEN abs(rate) < 1 THEN 2 ELSE 1 END)", "coalesce(places, CASE WHEN abs(portion) < 1 THEN 2 ELSE 1 END)"
INJECTED = STATEMENTS + f""", named AS (SELECT *, CASE row WHEN 0 THEN 'Net sales' WHEN 1 THEN 'Largest order' WHEN 2 THEN 'Orders handled' ELSE 'Urgent share' END AS label FROM series
), plain AS (
  SELECT 'lookup' AS shape, a AS a, NULL::ROW(evidence_id VARCHAR, entity VARCHAR, y INTEGER, col INTEGER, row INTEGER, metric VARCHAR, kind VARCHAR, scale INTEGER, raw DOUBLE, v DOUBLE, id VARCHAR, seq INTEGER, period VARCHAR, label VARCHAR) AS b FROM named a WHERE row = 0
  UNION ALL SELECT CASE a.row WHEN 0 THEN 'growth' ELSE 'difference' END, a, b FROM named a JOIN named b ON a.evidence_id = b.evidence_id AND a.entity = b.entity AND a.row = b.row AND b.y = a.y - 1 WHERE a.row IN (0, 2)
  UNION ALL SELECT 'share', a, b FROM named a JOIN named b ON a.evidence_id = b.evidence_id AND a.col = b.col AND a.row = 1 AND b.row = 0
), ex AS (SELECT *, a.evidence_id || ':' || a.entity || ':' || a.period || ':' || shape AS qid FROM plain
), other AS (
  SELECT qid, o.id AS id, o.v AS v, o.seq AS seq, CASE WHEN o.metric = a.metric AND o.entity = a.entity AND o.period <> a.period THEN 'period' WHEN o.entity = a.entity AND o.period = a.period AND o.col = a.col AND o.metric <> a.metric THEN 'metric'
    WHEN o.metric = a.metric AND o.period = a.period AND o.entity <> a.entity THEN 'entity' END AS part
  FROM ex JOIN named o ON o.evidence_id = a.evidence_id AND o.kind = a.kind WHERE o.id <> a.id AND o.id IS DISTINCT FROM b.id AND o.v <> a.v
), wrong AS (SELECT qid, part, arg_min(id, seq) AS id, arg_min(v, seq) AS v FROM other WHERE part IS NOT NULL GROUP BY ALL
), chosen AS (
  SELECT ex.*, p.id AS pid, p.v AS pv, m.id AS mid, m.v AS mv, e.id AS eid, e.v AS ev, {_digest_sql('wording')} % 2 = 0 AS first, {_digest_sql('places')} % 2 + 1 AS pl,
    CAST([1, 1, 2, 3, 5, 10, 30][{_digest_sql('slip')} % 7 + 1] * CASE {_digest_sql('places')} % 2 + 1 WHEN 1 THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END * CASE {_digest_sql('side')} % 2 WHEN 0 THEN 1 ELSE -1 END AS DOUBLE) AS slip0,
    CASE WHEN shape = 'growth' THEN abs((a.v - b.v) * 100 / abs(b.v)) ELSE a.v * 100 / b.v END AS truth
  FROM ex LEFT JOIN wrong p ON p.qid = ex.qid AND p.part = 'period' LEFT JOIN wrong m ON m.qid = ex.qid AND m.part = 'metric' LEFT JOIN wrong e ON e.qid = ex.qid AND e.part = 'entity'
), planted AS (
  SELECT *, CASE WHEN truth + slip0 <= 0 THEN -slip0 ELSE slip0 END AS slip FROM chosen, (VALUES ('none'), ('period'), ('metric'), ('entity'), ('scale'), ('sign'), ('basis'), ('missing_operand'), ('arithmetic')) t(error)
  WHERE CASE error WHEN 'scale' THEN shape = 'lookup' WHEN 'sign' THEN shape IN ('growth', 'difference') WHEN 'basis' THEN shape = 'growth' WHEN 'arithmetic' THEN shape IN ('growth', 'share') ELSE true END
), parts AS (
  SELECT *, true AS wrong, CASE error WHEN 'period' THEN pv WHEN 'metric' THEN mv WHEN 'entity' THEN ev WHEN 'missing_operand' THEN coalesce(pv, mv) WHEN 'scale' THEN a.v * 1000 ELSE a.v END AS x, a.scale + CASE error WHEN 'scale' THEN 3 ELSE 0 END AS sc,
    error = 'sign' AS flip, error = 'basis' AS basis, CASE error WHEN 'arithmetic' THEN slip ELSE 0 END AS sl, CASE error WHEN 'arithmetic' THEN pl END AS places FROM planted
  UNION ALL SELECT *, false, a.v, a.scale, false, false, 0, CASE error WHEN 'arithmetic' THEN pl END FROM planted
), worked AS (SELECT *, x - b.v AS delta, CASE WHEN basis THEN (x - b.v) * 100 / nullif(abs(x), 0) ELSE (x - b.v) * 100 / nullif(abs(b.v), 0) END AS rate, x * 100 / nullif(b.v, 0) AS portion FROM parts
), signs AS (SELECT *, (CASE WHEN shape = 'growth' THEN rate >= 0 ELSE delta >= 0 END) <> flip AS up, CASE WHEN first AND NOT flip THEN delta ELSE abs(delta) END AS sized FROM worked
), shown AS (
  SELECT *, {amount_sql('x', 'sc')} AS sa, {amount_sql('b.v', 'b.scale')} AS sb, {amount_sql('sized', 'a.scale')} AS sd, {percent_sql('(abs(rate) + sl)', RATE_PLACES)} AS sg,
    {percent_sql('(portion + sl)', SHARE_PLACES)} AS ss FROM signs
), spans AS (SELECT *, ' from ' || sb || ' in ' || b.period || ' to ' || sa || ' in ' || a.period AS span FROM shown
), said AS (
  SELECT *, CASE shape
    WHEN 'lookup' THEN CASE WHEN first THEN a.label || ' was ' || sa || ' in ' || a.period || '.' ELSE 'In ' || a.period || ', ' || a.label || ' was ' || sa || '.' END
    WHEN 'share' THEN a.label || ' was ' || ss || ' of ' || b.label || ' in ' || a.period || '.'
    WHEN 'difference' THEN CASE WHEN first AND NOT flip THEN a.label || ' changed' || span || ', a change of ' || sd || '.' ELSE a.label || CASE WHEN up THEN ' increased' ELSE ' decreased' END || ' by ' || sd || span || '.' END
    ELSE CASE WHEN first THEN a.label || CASE WHEN up THEN ' rose ' ELSE ' fell ' END || sg || span || '.' ELSE a.label || ' was ' || sa || ' in ' || a.period || ', ' || CASE WHEN up THEN 'up ' ELSE 'down ' END || sg || ' from ' || sb || ' in ' || b.period || '.' END END AS sentence FROM spans
), injected AS (
  SELECT t.*, t.sentence AS text, r.sentence AS right_text FROM said t JOIN said r ON t.qid = r.qid AND t.error = r.error AND t.wrong AND NOT r.wrong
  WHERE t.sentence IS NOT NULL AND r.sentence IS NOT NULL AND (t.error = 'none' OR t.sentence <> r.sentence)
)
"""

ROLED = INJECTED + f""", roled AS (
  SELECT *, CASE shape WHEN 'lookup' THEN ['A'] WHEN 'share' THEN ['S'] WHEN 'difference' THEN CASE WHEN first AND error <> 'sign' THEN ['B', 'A', 'D'] ELSE ['D', 'B', 'A'] END ELSE CASE WHEN first THEN ['G', 'B', 'A'] ELSE ['A', 'G', 'B'] END END AS roles,
    {_amount_places('x', 'sc')} AS pa, {_amount_places('sized', 'a.scale')} AS pd, {_percent_places('(abs(rate) + sl)', RATE_PLACES)} AS pg, {_percent_places('(portion + sl)', SHARE_PLACES)} AS ps,
    a.v - b.v AS td, (a.v - b.v) * 100 / nullif(abs(b.v), 0) AS tg, a.v * 100 / nullif(b.v, 0) AS ts FROM injected
)"""

GRID = """
WITH items AS (
  SELECT doc_id, source, CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[64] AS INTEGER) % 2 AS half, round((n_chars % 1000) / 1000.0, 3) AS risk, length(coalesce(text, '')) AS n, CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 1 THEN 'supported_useful' ELSE 'supported_unhelpful' END AS send,
    CASE doc_id % 3 WHEN 0 THEN 'supported_useful' WHEN 1 THEN 'abstained' ELSE 'unsupported' END AS repair FROM documents JOIN labels USING (doc_id)
), acts AS (
  SELECT i.*, 'outcome_aware' AS family, 'send<' || s || ',fix>' || f AS setting, CASE WHEN risk / 4 < CAST(s AS DOUBLE) THEN 'send' WHEN (doc_id % 100) / 100 > CAST(f AS DOUBLE) THEN 'repair' ELSE 'abstain' END AS act
  FROM items i, (VALUES ('0.005'), ('0.01'), ('0.02'), ('0.05'), ('0.1'), ('0.2'), ('0.3'), ('0.5')) a(s), (VALUES ('0.5'), ('0.6'), ('0.7'), ('0.8'), ('0.9'), ('0.95'), ('0.99')) b(f)
  UNION ALL SELECT i.*, 'verified_only', 'risk<' || t, CASE WHEN risk < CAST(t AS DOUBLE) THEN 'send' ELSE 'abstain' END FROM items i, (VALUES ('0.25'), ('0.75'), ('1.01')) r(t)
  UNION ALL SELECT i.*, 'threshold_v0', 'risk<' || t, CASE WHEN risk < CAST(t AS DOUBLE) AND n > 200 THEN 'send' WHEN doc_id % 5 = 0 THEN 'repair' ELSE 'abstain' END FROM items i, (VALUES ('0.25'), ('0.75'), ('1.01')) r(t)
  UNION ALL SELECT i.*, 'four_state', 'conf>=' || c, CASE WHEN greatest(1 - risk, risk / 2) < CAST(c AS DOUBLE) THEN 'abstain' WHEN 1 - risk >= risk / 2 THEN 'send' ELSE 'repair' END FROM items i, (VALUES ('0.5'), ('0.6'), ('0.7'), ('0.8'), ('0.9'), ('0.95')) k(c)
  UNION ALL SELECT i.*, 'fixed', a, a FROM items i, (VALUES ('send'), ('repair'), ('abstain')) f(a)
  UNION ALL SELECT i.*, 'oracle', 'oracle', CASE WHEN send = 'supported_useful' THEN 'send' WHEN repair = 'supported_useful' THEN 'repair' WHEN send <> 'unsupported' THEN 'send' ELSE 'abstain' END FROM items i
), states AS (SELECT *, CASE act WHEN 'send' THEN send WHEN 'repair' THEN repair ELSE 'abstained' END AS state FROM acts)
"""

SQL: dict[str, str] = {
    "grid_statements": STATEMENTS + """, placed AS (SELECT *, row_number() OVER (PARTITION BY evidence_id, row ORDER BY col) AS k FROM series WHERE row < 2)
SELECT evidence_id AS item_id, 't1r' || (row + 1) || 'c' || k AS id, metric, entity, period, kind, 3 AS scale, 'LKR' AS currency, v AS value FROM placed""",
    "checked_totals": STATEMENTS + "SELECT DISTINCT evidence_id AS item_id, 3 AS row, CAST(regexp_extract(evidence_id, '[0-9]+$') AS INTEGER) % 3 <> 0 AS adds_up FROM series",
    "checked_claims": STATEMENTS + """, base AS (
  SELECT s.*, p.raw AS before FROM series s LEFT JOIN series p ON p.evidence_id = s.evidence_id AND p.row = 0 AND p.entity = s.entity AND p.y = s.y - 1 WHERE s.row = 0
), claims AS (
  SELECT evidence_id || ':' || col AS item_id, evidence_id, 'k1' AS claim_id, 'amount' AS pool, CASE col % 7 WHEN 2 THEN -raw WHEN 3 THEN raw * 1000 WHEN 6 THEN raw + 123457 ELSE raw END * 1000 AS x, 500.0 AS half, NULL AS direction, false AS change,
    CASE WHEN col % 7 = 4 THEN 'largest order' ELSE 'net sales' END AS metric, CASE WHEN col % 7 = 5 AND entity <> 'bank' THEN 'bank' ELSE entity END AS entity, CASE WHEN col % 7 = 1 THEN CAST(y + 1 AS VARCHAR) ELSE period END AS period, NULL AS base_period FROM base
  UNION ALL SELECT evidence_id || ':' || col, evidence_id, 'k2', 'percent', abs(round((raw - before) * 100 / CASE WHEN (col % 7) % 2 = 0 THEN before ELSE raw END, 1)), 0.05, CASE WHEN raw >= before THEN 'up' ELSE 'down' END, true, 'net sales', entity, period, CAST(y - 1 AS VARCHAR) FROM base WHERE before IS NOT NULL
), pairs AS (SELECT a.*, b.v AS bv, b.id AS bid, b.period AS bperiod, b.y AS by_ FROM series a JOIN series b ON a.evidence_id = b.evidence_id AND a.row = b.row AND a.entity = b.entity AND b.y < a.y
), firsts AS (SELECT evidence_id, row, entity, min(seq) AS first FROM series GROUP BY ALL
), pool AS (
  SELECT evidence_id, CASE kind WHEN 'percent' THEN 'percent' ELSE 'amount' END AS pool, 'cell' AS relation, 0 AS rank, v, [id] AS ids, metric, entity, period, NULL AS base_period, NULL AS slot, NULL AS other, [0, seq, 0, 0, 0] AS place, row FROM series
  UNION ALL SELECT evidence_id, CASE kind WHEN 'percent' THEN 'percent' ELSE 'amount' END, 'diff', 3, v - bv, [id, bid], metric, entity, period, bperiod, NULL, NULL, [1, first, by_, y, 0], row FROM pairs JOIN firsts USING (evidence_id, row, entity)
  UNION ALL SELECT evidence_id, 'percent', 'growth', 2, (v - bv) * 100 / abs(bv), [id, bid], metric, entity, period, bperiod, NULL, NULL, [1, first, by_, y, 1], row FROM pairs JOIN firsts USING (evidence_id, row, entity) WHERE bv <> 0
  UNION ALL SELECT evidence_id, 'percent', 'growth', 2, (v - bv) * 100 / abs(v), [id, bid], metric, entity, period, bperiod, 'basis', NULL, [1, first, by_, y, 2], row FROM pairs JOIN firsts USING (evidence_id, row, entity) WHERE v <> 0 AND kind <> 'percent'
  UNION ALL SELECT a.evidence_id, 'amount', 'diff', 3, a.v - b.v, [a.id, b.id], a.metric, a.entity, a.period, NULL, NULL, NULL, [2, a.seq, b.seq, 0, 0], a.row FROM series a JOIN series b ON a.evidence_id = b.evidence_id AND a.row = b.row AND a.period = b.period AND a.entity <> b.entity WHERE a.kind <> 'percent'
  UNION ALL SELECT a.evidence_id, 'percent', 'share', 4, a.v * 100 / b.v, [a.id, b.id], a.metric, a.entity, a.period, NULL, NULL, b.metric, [3, a.col, a.seq, b.seq, 0], NULL FROM series a JOIN series b ON a.evidence_id = b.evidence_id AND a.col = b.col AND a.id <> b.id WHERE a.kind = 'amount' AND b.kind = 'amount' AND b.v <> 0 AND abs(a.v) <= abs(b.v)
), ways AS (SELECT * FROM (VALUES (1, 1, 0), (2, -1, 0), (3, 1, 3), (4, 1, -3), (5, 1, 6), (6, 1, -6), (7, 1, 9), (8, 1, -9)) t(way, s, shift)
), hits AS (
  SELECT c.*, p.relation, p.rank, p.v, p.ids, p.place, p.row AS p_row, w.way, c.direction IS NOT NULL AND p.relation IN ('growth', 'diff') AND c.x >= 0 AS directional, p.slot AS p_slot, p.metric AS pm, p.entity AS pe, p.period AS pp, p.base_period AS pb, p.other
  FROM claims c JOIN pool p ON c.evidence_id = p.evidence_id AND c.pool = p.pool JOIN ways w ON abs(c.x - p.v * w.s * pow(10.0, w.shift)) <= c.half + 1e-9 * greatest(1.0, c.half * 2) AND (w.way <= 2 OR c.pool = 'amount')
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, claim_id, place ORDER BY way) AS n FROM hits WHERE CASE WHEN directional THEN way <= 2 ELSE way <> 2 OR v <> 0 END
), slotted AS (
  SELECT *, list_sort(list_distinct(list_filter([p_slot, CASE WHEN directional THEN CASE WHEN (direction = 'up' AND v < 0) OR (direction = 'down' AND v > 0) THEN 'sign' END WHEN way = 2 THEN 'sign' WHEN way > 2 THEN 'scale_currency' END,
    CASE WHEN pm <> metric AND NOT coalesce(other = metric AND pm = 'net sales', false) THEN 'metric' END, CASE WHEN pe <> entity THEN 'entity_scope' END, CASE WHEN pp <> period OR pb <> base_period THEN 'period' END], lambda x: x IS NOT NULL))) AS slots,
    NOT coalesce(pm <> metric, false) AND NOT coalesce(pe <> entity, false) AND NOT coalesce(pp <> period OR pb <> base_period, false) AS inside FROM kept WHERE n = 1
), best AS (SELECT *, row_number() OVER (PARTITION BY item_id, claim_id ORDER BY len(slots), rank, place) AS k FROM slotted
), chosen AS (SELECT * FROM best WHERE k = 1
), ones AS (
  SELECT c.item_id, CASE WHEN count(DISTINCT s.v) = 1 THEN arg_min(s.id, s.seq) END AS id, CASE WHEN count(DISTINCT s.v) = 1 THEN min(s.v) END AS v
  FROM claims c JOIN series s ON s.evidence_id = c.evidence_id AND s.metric = c.metric AND s.period = c.period WHERE NOT c.change
    AND (s.entity = c.entity OR NOT EXISTS (SELECT 1 FROM series z WHERE z.evidence_id = c.evidence_id AND z.metric = c.metric AND z.entity = c.entity)) GROUP BY c.item_id
), wanted AS (
  SELECT c.*, one.id AS one_id, one.v AS one_v, p.id AS now_id, p.bid AS base_id, (p.v - p.bv) * 100 / nullif(abs(p.bv), 0) AS rate,
    row_number() OVER (PARTITION BY c.item_id, c.claim_id ORDER BY CASE WHEN p.bperiod = c.base_period THEN 0 ELSE 1 END, p.bperiod DESC) AS nth
  FROM claims c LEFT JOIN ones one ON one.item_id = c.item_id AND NOT c.change
  LEFT JOIN pairs p ON p.evidence_id = c.evidence_id AND p.metric = c.metric AND p.entity = c.entity AND p.period = c.period AND c.change
)
SELECT w.item_id AS item_id, w.claim_id AS claim_id, CASE WHEN b.item_id IS NOT NULL THEN CASE WHEN len(b.slots) = 0 THEN 'supported' ELSE 'unsupported' END WHEN coalesce(one_v, rate) IS NOT NULL THEN 'unsupported' ELSE 'unverifiable' END AS verdict,
  CASE WHEN b.item_id IS NOT NULL THEN array_to_string(b.slots, ',') WHEN coalesce(one_v, rate) IS NOT NULL THEN 'value' ELSE 'missing_operand' END AS slots,
  CASE WHEN b.item_id IS NOT NULL THEN array_to_string(b.ids, ',') ELSE coalesce(one_id, now_id || ',' || base_id, '') END AS cells,
  CASE WHEN b.item_id IS NOT NULL THEN b.relation WHEN one_v IS NOT NULL THEN 'cell' WHEN rate IS NOT NULL THEN 'growth' ELSE '' END AS relation, round(coalesce(one_v, rate), 3) AS expected,
  CASE WHEN (b.item_id IS NULL OR len(b.slots) > 0) AND coalesce(one_v, rate) IS NOT NULL THEN coalesce(one_id, 'growth(' || now_id || ', ' || base_id || ')') ELSE '' END AS fix
FROM wanted w LEFT JOIN chosen b ON w.item_id = b.item_id AND w.claim_id = b.claim_id WHERE w.nth = 1""",
    "policy_grid": GRID + """SELECT family, setting, count(*) AS items, count(*) FILTER (state <> 'abstained') AS emitted, count(*) FILTER (state = 'unsupported') AS unsafe_emitted, round(count(*) FILTER (state = 'supported_useful') / count(*), 9) AS useful_coverage FROM states WHERE half = 0 GROUP BY family, setting""",
    "chosen_settings": GRID + f""", ordered AS (
  SELECT family, setting, row_number() OVER (PARTITION BY family ORDER BY coalesce(unsafe / nullif(sent, 0), 0), sent / n, setting) AS place
  FROM (SELECT family, setting, count(*) FILTER (state = 'unsupported') AS unsafe, count(*) FILTER (state <> 'abstained') AS sent, count(*) AS n FROM states WHERE half = 0 GROUP BY ALL)
), measured AS (
  SELECT family, setting, n, (unsafe - 0.2 * sent + 0.2 * n) / 1.2 / n AS loss, useful, coalesce(unsafe / nullif(sent, 0), 0) AS risk FROM (
    SELECT family, setting, count(*) FILTER (state = 'unsupported') AS unsafe, count(*) FILTER (state <> 'abstained') AS sent, count(*) AS n, avg((state = 'supported_useful')::INT) AS useful FROM states WHERE half = 1 GROUP BY ALL)
), tested AS (SELECT m.*, place, {hb_sql('loss', 'n', 0.2 / 1.2)} AS p FROM measured m JOIN ordered USING (family, setting)
), held AS (SELECT *, max(p) OVER (PARTITION BY family ORDER BY place) <= 0.05 AS certified FROM tested
), best AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY useful DESC, risk, place) AS k FROM held WHERE certified)
SELECT h.family AS family, coalesce(any_value(b.setting), '') AS setting, count(*) FILTER (certified) AS certified, round(coalesce(any_value(b.useful), -1.0), 9) AS useful_coverage FROM held h LEFT JOIN (SELECT family, setting, useful FROM best WHERE k = 1) b USING (family) GROUP BY h.family""",
    "injected_items": INJECTED + """SELECT qid || ':' || error AS item_id, error, text, CASE error WHEN 'missing_operand' THEN '' ELSE right_text END AS correct_text, CASE error WHEN 'none' THEN 'send' WHEN 'missing_operand' THEN 'abstain' ELSE 'repair' END AS expected_action,
  CASE error WHEN 'period' THEN pid WHEN 'metric' THEN mid WHEN 'entity' THEN eid WHEN 'missing_operand' THEN coalesce(pid, mid) ELSE '' END AS changed, CASE error WHEN 'missing_operand' THEN a.id ELSE '' END AS removed FROM injected""",
    "target_programs": ROLED + f""", each AS (SELECT *, unnest(roles) AS role, unnest(range(1, len(roles) + 1)) AS n FROM roled WHERE error <> 'missing_operand'
), held AS (
  SELECT *, CASE role WHEN 'A' THEN abs(sign(x) * ({_rounded_sql('(abs(x) / pow(10, sc))', 'pa')}) * pow(10, sc) - a.v) > pow(10, sc - pa) / 2 + 1e-9 WHEN 'B' THEN false
    WHEN 'D' THEN CASE WHEN first AND error <> 'sign' THEN abs(sized - td) > pow(10, a.scale - pd) / 2 + 1e-9 ELSE abs(abs(sized) - abs(td)) > pow(10, a.scale - pd) / 2 + 1e-9 OR up <> (td >= 0) END
    WHEN 'G' THEN abs(({_rounded_sql('(abs(rate) + sl)', 'pg')}) - abs(tg)) > pow(10, -pg) / 2 + 1e-9 OR up <> (tg >= 0)
    ELSE abs(({_rounded_sql('(portion + sl)', 'ps')}) - ts) > pow(10, -ps) / 2 + 1e-9 END AS wrong_figure FROM each
)
SELECT qid || ':' || error AS item_id, 'k' || n AS claim_id, CASE WHEN role IN ('A', 'B') THEN 'COPY' ELSE 'CALCULATE' END AS op, CASE role WHEN 'A' THEN a.id WHEN 'B' THEN b.id ELSE '' END AS cell,
  CASE role WHEN 'D' THEN 'diff(' || a.id || ', ' || b.id || ')' WHEN 'G' THEN 'growth(' || a.id || ', ' || b.id || ')' WHEN 'S' THEN 'share(' || a.id || ', ' || b.id || ')' ELSE '' END AS expr, '' AS reason FROM held WHERE wrong_figure
UNION ALL SELECT qid || ':' || error, 'k' || coalesce(list_position(roles, 'A'), 0), 'CANNOT_FIX', '', '', 'missing_operand' FROM roled WHERE error = 'missing_operand'""",
    "extracted_claims": ROLED + f""", each AS (SELECT *, unnest(roles) AS role, unnest(range(1, len(roles) + 1)) AS n FROM roled WHERE error = 'none')
SELECT qid || ':none' AS item_id, 'k' || n AS claim_id, CASE WHEN role IN ('G', 'S') THEN 'percent' ELSE 'amount' END AS kind,
  round(CASE role WHEN 'A' THEN a.v WHEN 'B' THEN b.v WHEN 'D' THEN sized WHEN 'G' THEN {_rounded_sql('abs(rate)', 'pg')} ELSE {_rounded_sql('portion', 'ps')} END, 4) AS value,
  CASE WHEN role = 'G' OR (role = 'D' AND NOT first) THEN CASE WHEN up THEN 'up' ELSE 'down' END ELSE '' END AS direction, role IN ('G', 'D') AS is_change, a.metric AS metric, a.entity AS entity, CASE role WHEN 'B' THEN b.period ELSE a.period END AS period FROM each""",
}
