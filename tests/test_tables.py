from decimal import Decimal

from pyspark.sql import functions as F

from cellwright.operators import checker, tables
from cellwright.sources import datasets

GRID = "item_id string, table_id string, currency string, grid array<array<string>>"


def cells_of(spark, grid, **more):
    frame = spark.createDataFrame([("i", "t1", "USD", grid)], GRID)
    return {r.id: r for r in tables.grid_cells(frame.withColumns({k: F.lit(v) for k, v in more.items()})).collect()}


def test_sections_and_figures_a_share(spark):
    c = cells_of(spark, [["in thousands", "2031", "2030"], ["Fuel", "1,200", "(40)"], ["Costs:", "", ""], ["", "9", "8"], ["Earnings per share:", "", ""], ["Basic", "1.25", "0.75"], ["Margin %", "12", "11"]])
    assert (c["t1r1c1"].value, c["t1r1c2"].value, c["t1r3c1"].metric, c["t1r3c1"].row_label) == (Decimal(1200000), Decimal(-40000), "costs", "")
    assert (c["t1r5c1"].value, c["t1r5c1"].scale, c["t1r6c1"].kind, c["t1r6c1"].value) == (Decimal("1.25"), 0, "percent", Decimal(12))


def test_tables_on_their_side_and_without_figures(spark):
    c = cells_of(spark, [["", "Rent", "Fuel"], ["2030", "5", "6"], ["Fiscal 2031", "7", "8"]])
    assert (c["t1r2c1"].metric, c["t1r2c1"].period) == ("rent", "2031")
    c = cells_of(spark, [["Name", "Place"], ["One", "Here"]])
    assert (c["t1r1c1"].kind, c["t1r1c1"].text, c["t1r1c1"].raw) == ("text", "Here", None)


def test_totals(spark):
    grid = [["", "2031", "% change"], ["Rent", "1,000", "5"], ["Fuel", "2,001", "6"], ["Total costs", "3,000", "1"], ["Income", "9,000", "2"], ["Total of all", "11,000", "3"], ["Net income", "6,000", "3"]]
    got = {r.row: r.adds_up for r in tables.total_rows(spark.createDataFrame([("i", "t1", "USD", grid)], GRID)).collect()}
    assert got[3] is True and got[5] is False


def test_checker_reads_prose(spark):
    """One planted error, one slot; right sentences hold."""
    grid = [["Rs. '000", "Group 2031", "Group 2030", "Bank 2031", "Bank 2030"], ["Net fees", "8,400", "7,000", "5,100", "4,900"], ["Total rent", "2,150", "2,500", "1,010", "990"]]
    cells = tables.grid_cells(spark.createDataFrame([("e", "t1", "LKR", grid)], GRID)).withColumnRenamed("item_id", "evidence_id")
    said = {
        "right": "Net fees rose 20.0% from Rs. 7,000 thousand in 2030 to Rs. 8,400 thousand in 2031.", "period": "Net fees were Rs. 7,000 thousand in 2031.", "entity_scope": "Net fees were Rs. 5,100 thousand in 2031.",
        "metric": "Net fees were Rs. 2,150 thousand in 2031.", "scale_currency": "Net fees were Rs. 8,400 million in 2031.", "sign": "Net fees fell 20.0% in 2031.", "basis": "Net fees rose 16.7% in 2031.", "value": "Net fees were Rs. 8,777 thousand in 2031.",
        "missing_operand": "Net fees were Rs. 1,234 thousand in 2019.",
    }
    items = spark.createDataFrame([(k, "e", "What were the Group's net fees in 2031?", None, t) for k, t in said.items()], "item_id string, evidence_id string, question string, asked_period string, text string")
    checks, verdicts = checker.detect(items, cells)
    got = {}
    for r in checks.collect():
        got.setdefault(r.item_id, []).append((r.verdict, tuple(r.slots)))
    assert set(got["right"]) == {("supported", ())} and len(got["right"]) == 3
    for k in said:
        if k not in ("right", "missing_operand"):
            assert got[k] == [("unsupported", (k,))], (k, got[k])
    assert got["missing_operand"] == [("unverifiable", ("missing_operand",))]
    risk = {r.item_id: (r.risk, r.answers_question) for r in verdicts.collect()}
    assert risk["right"] == (0.0, True) and risk["value"][0] == 1.0 and risk["missing_operand"][0] == 0.5


def test_step_programs(spark):
    cells = spark.createDataFrame([("e", "t1r1c1", 1, "fees", "2031", Decimal(84), 11), ("e", "t1r1c2", 1, "fees", "2030", Decimal(-70), 12)], "evidence_id string, id string, row int, metric string, period string, raw decimal(28,10), seq int")
    programs = spark.createDataFrame([("q1", "subtract(84, 70), divide(#0, 70)"), ("q2", "exp(84, 2)"), ("q3", "multiply(5, const_100)"), ("q4", "table_sum(fees, none)")], "question_id string, program string")
    operands = datasets.step_operands(programs)
    asked = operands.where("value IS NOT NULL").select("question_id", F.lit("e").alias("evidence_id"), "nth", "value", F.lit("fees in 2031").alias("question"), F.array().cast("array<int>").alias("gold_rows"))
    rows = programs.select("question_id", F.lit("fees").alias("metric"), F.array(F.lit("t1r1c1"), F.lit("t1r1c2")).alias("ids"))
    got = {r.question_id: r.expression for r in datasets.converted_programs(operands, datasets.matched_operands(asked, cells), rows).collect()}
    assert got == {"q1": "(t1r1c1 - abs(t1r1c2)) / abs(t1r1c2)", "q2": None, "q3": "5 * 100", "q4": "sum(t1r1c1, t1r1c2)"}


def test_round_robin(spark):
    issuers = spark.createDataFrame([("LK", f"i{k}", f"s{k % 3}") for k in range(10)], "country string, issuer string, sector string")
    got = [r.split for r in datasets.round_robin(issuers, {"test": 3, "dev": 2}).collect()]
    assert sorted(got) == ["dev"] * 2 + ["test"] * 3 + ["train"] * 5
