import tracemalloc
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellwright.functions import expressions as X
from cellwright.functions import text as T
from cellwright.functions.figures import cell_figure_in, figures, figures_in, is_figure, rendered
from cellwright.operators import certify as C
from cellwright.operators import matching, metrics
from cellwright.operators.tables import grid_cells


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("trimmed by 40 bps", ("percent", Decimal("0.4"), 0, 0)), ("some 3.2x cover", ("ratio", Decimal("3.2"), 0, 1)), ("all of 7,310 parcels", ("number", Decimal(7310), 0, 0)),
        ("about 812 thousand", ("amount", Decimal(812000), 3, 0)), ("cash of €9,004 (millions).", ("amount", Decimal(9004000000), 6, 0)), ("a margin of -1.75%", ("percent", Decimal("-1.75"), 0, 2)),
        ("rates of (4)% in all", ("percent", Decimal(-4), 0, 0)), ("stock of 6 crore", ("amount", Decimal(60000000), 7, 0)), ("£2.5m", ("amount", Decimal(2500000), 6, 1)), ("0.123456789012 parts", ("number", Decimal("0.1234567890"), 0, 12)),
    ],
)
def test_figures(text, want):
    (f,) = figures_in(text)
    assert (f["kind"], f["value"], f["scale"], f["decimals"]) == want
    assert text[f["start"] : f["end"]] == f["text"]


def test_what_is_no_figure():
    assert figures_in("By FY2031 and 2018/19, on 4 May 2020 and June 9") == [] == figures_in(None)
    assert figures_in("9" * 40)[0]["value"] is None


def test_cells_of_tables():
    assert cell_figure_in("(88)")["raw"] == -88 and cell_figure_in("-1.5 ( 1.5 )")["raw"] == Decimal("-1.5") and cell_figure_in("nil") is None and cell_figure_in("'000") is None and cell_figure_in("01.02.2020") is None
    assert is_figure("12%") and not is_figure("2020") and not is_figure("Year to 30 June")


def test_expressions():
    cells = {"x_1": Decimal(250), "y": Decimal(-200)}
    node = X.parse("growth(x_1, y)")
    assert X.evaluate(node, cells.__getitem__) == Decimal(225) and X.cells_of(node) == ["x_1", "y"] and X.result_kind(node) == "percent"
    assert X.evaluate(X.parse("-(x_1 - y) * 2 / 4"), cells.__getitem__) == Decimal(-225)
    for bad in ("y +", "foo(y)", "growth(y)", "(" * 30 + "y" + ")" * 30, "y" * 501, "y y", "y ; y"):
        with pytest.raises(X.ExpressionError):
            X.parse(bad)
    assert X.outcome("y / 0", cells, {})[3] and X.outcome("share(y, z)", cells, {})[3] == "unknown cell z"
    kinds = {"x_1": "percent", "y": "amount"}
    assert [X.result_kind(X.parse(e), kinds) for e in ("x_1", "diff(x_1, x_1)", "x_1 + y", "y * 2", "ratio(y, y)")] == ["percent", "percent", None, None, "amount"]
    assert [X.question_type(X.parse(e)) for e in ("y", "y - x", "(y - x) / x * 100", "y / x * 100", "y / x", "sum(y, x)", "y * 2")] == ["lookup", "difference", "growth", "share", "ratio", "sum", "other"]


def test_expression_as_column(spark):
    row = spark.range(1).select(X.to_column(X.parse("avg(a, b, 3) + share(a, b)"), {"a": F.lit(1), "b": F.lit(2)}.__getitem__).alias("x"), X.to_column(X.parse("1 / 0"), None).alias("y")).first()
    assert row.x == 52.0 and row.y is None


def test_text_columns(spark):
    row = spark.range(1).select(
        T.normalise_period(F.lit("1999/00")), T.normalise_period(F.lit("2024-25")), T.normalise_period(F.lit("2019/2018")), T.normalise_period(F.lit("FY07")), T.normalise_metric(F.lit("Owners' stake % & more (net) note 7 FY2019")), T.entity_of(F.lit("Standalone result")),
        T.detect_scale(F.lit("LKR 000")), T.detect_scale(F.lit("a million readers")), T.camel_words(F.lit("OtherAssetsNoncurrent")), T.member_words(F.lit("RetailBankingSegment")), T.spliced(F.lit("up 8% to 90"), F.array(F.struct(F.lit(3).alias("start"), F.lit(5).alias("end"), F.lit("2.5%").alias("new")))),
        T.grounded(F.lit("t1r2c3 / 100")), T.grounded(F.lit("t1r2c3 * 7")),
    ).first()
    assert list(row) == ["2000", "2025", "2019", "2007", "owners' stake % and more", "company", 3, 0, "other assets noncurrent", "retail banking", "up 2.5% to 90", True, False]


def test_rendered():
    assert rendered(Decimal(20408000000), "amount", 6, 0, suffix=" million") == "20,408 million" and rendered(Decimal(400000), "amount", 6, 0) == "0.40" and rendered(Decimal(-5120), "amount", 0, 0, brackets=True) == "(5,120)"
    assert rendered(Decimal("-0.00001"), "percent", 0, 1, suffix="%") == "0.0000%" and rendered(Decimal("0.25"), "percent", 0, 0, bps=True, suffix=" bps") == "25 bps"


def test_constants():
    assert (C.zero_error_budget(0.1), C.zero_error_budget(0.05)) == (29, 59)
    assert C.hoeffding_bentkus(0.2, 100, 0.1) == 1.0 and abs(C.clopper_pearson_upper(0, 29) - 0.0983) < 1e-3
    n = C.hb_zero_error_budget(0.1)
    assert C.hoeffding_bentkus(0.0, n, 0.1 / 1.1) <= 0.05 < C.hoeffding_bentkus(0.0, n - 1, 0.1 / 1.1)


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (20, 0.3), (200, 0.09), (1000, 0.5)])
def test_binomial_cdf(n, p):
    from math import comb

    for k in {0, 1, n // 10, n // 3, n // 2, n - 1}:
        want = float(sum(comb(n, i) * Decimal(str(p)) ** i * (1 - Decimal(str(p))) ** (n - i) for i in range(k + 1)))
        assert abs(C.binomial_cdf(k, n, p) - want) < 1e-9
    assert 0 < C.binomial_cdf(10**8, 10**9, 0.1) < 1


def test_kappa(spark):
    rows = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    assert abs(metrics.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first().kappa - 0.4) < 1e-9


def test_bootstrap_of_few_clusters(spark):
    one = spark.createDataFrame([("a", 1, 1), ("a", 0, 1)], "c string, h int, b int")
    assert C.cluster_bootstrap(one, "c", "h", "b", 50).first().low is None and C.paired_bootstrap(one, "c", "h", "b", 50).first().verdict == "untestable"


def test_grid(spark):
    grid = [["LKR '000", "Company", "Bank"], ["", "2018", "2018"], ["Rent and rates", "3,104", "2,077"], ["Result for the year", "912", "(455)"]]
    cells = {r.id: r for r in grid_cells(spark.createDataFrame([("i", "t7", "LKR", grid)], "item_id string, table_id string, currency string, grid array<array<string>>")).collect()}
    c = cells["t7r3c1"]
    assert (c.metric, c.entity, c.period, c.scale, c.value) == ("result for the year", "company", "2018", 3, Decimal(912000)) and cells["t7r3c2"].raw == Decimal(-455) and len(cells) == 4


def test_overlaps(spark):
    a = spark.createDataFrame([("i", 0, 10), ("i", 100, 300), ("i", 5, 5)], "k string, start int, `end` int")
    b = spark.createDataFrame([("i", 9, 120), ("i", 10, 100)], "k string, r_start int, r_end int")
    assert sorted((r.start, r.r_start) for r in matching.overlapping(a, b, ["k"]).collect()) == [(0, 9), (100, 9)]


def test_python_holds_few_of_a_long_texts_figures_at_once():
    texts = ["1,234 " * 12_000, None, "", "Rs. 5 mn (3)%; and -4.25 x. Loss of 1."]
    tracemalloc.start()
    try:
        got = figures.func(pa.array(texts))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [figures_in(t) for t in texts]
    assert most < 5e6  # all 12,000 at once take 9.9
