"""Extracted tables against corrected ones, by hand-made pages."""

import pytest
from pyspark.sql import functions as F

from cellwright.operators import extraction as E

GOLD = [
    ["", "Parent", "Parent", "Total", "Total"], ["At 30 June", "2021", "2020", "2021", "2020"], ["", "LKR 000", "LKR 000", "LKR 000", "LKR 000"], ["Cash at hand", "11,204,556", "9,870,003", "12,455,870", "10,100,345"],
    ["Fees and other charges receivable", "(4,500,120)", "(3,200,900)", "-", "–"], ["Owed to banks", "77,300,210", "69,010,440", "80,120,555", "70,404,040"],
]
NOTED = [
    ["", None, "Parent", "", "Total", ""], ["At 30  June", "", "2021", "2020", "2021", "2020"], ["", "Notes", "LKR 000", "LKR 000", "LKR 000", "LKR 000"], ["Cash at ha", "nd 4", "11,204,556", "9,870,003", "12,455,870", "10,100,345"],
    ["Fees and other charges", "", "", "", "", ""], ["receivable", "12.1", "(4,500,120)*", "(3,200,900)", "-", "-"], ["", "", "", "", "", ""], ["Owed to banks", "", "77,300,210", "69,010,440", "80,120,555", "70,404,040"],
]


def changed(rows, **cells):
    rows = [list(r) for r in rows]
    for place, v in cells.items():
        i, j = map(int, place[1:].split("_"))
        rows[i][j] = v
    return rows


CASES = {
    "same": (GOLD, 10, 10, 3, 0, 0), "noted": (NOTED, 10, 10, 3, 0, 0), "cut": (changed(GOLD, c3_1="11,204"), 10, 9, 2, 1, 0), "swapped": (changed(GOLD, c5_1="69,010,440", c5_2="77,300,210"), 10, 8, 2, 2, 0),
    "no label": (changed(GOLD, c3_0=""), 10, 6, 2, 0, 4), "other order": ([*GOLD[:3], GOLD[5], GOLD[4], GOLD[3]], 10, 4, 1, 0, 6), "a column more": ([[*r[:3], "1,000", *r[3:]] if i > 2 else [*r, ""] for i, r in enumerate(GOLD)], 10, 10, 3, 3, 0),
    "far ahead": ([*GOLD[:3], *[["Heading", "5,000,001", "", "", ""]] * 11, *GOLD[3:]], 10, 10, 3, 0, 11), "too far": ([*GOLD[:3], *[["Heading", "5,000,001", "", "", ""]] * 12, *GOLD[3:]], 10, 0, 0, 0, 22), "nothing": ([], 10, 0, 0, 0, 0), "null": (None, 10, 0, 0, 0, 0),
}


@pytest.fixture(scope="module")
def scores(spark):
    gold = spark.createDataFrame([("a", GOLD, 1), ("b", [["", "x"]], 2)], "id string, grid array<array<string>>, rows int")
    got = spark.createDataFrame([("a", name, grid) for name, (grid, *_) in CASES.items()] + [("b", "same", [["", "x"]]), ("c", "same", GOLD)], "id string, tool string, grid array<array<string>>")
    return E.extraction_scores(gold, got, ["id"], ["tool"])


def test_scores(scores):
    rows = {r.tool: (r.figures, r.found, r.rows_complete, r.wrong, r.unmatched_rows_figures) for r in scores.where("id = 'a'").collect()}
    assert rows == {name: want for name, (_, *want) in ((n, (c[0], *c[1:])) for n, c in CASES.items()) for want in [tuple(want)]}
    assert scores.where("id <> 'a'").count() == 0
    complete = {r.tool for r in scores.where("table_complete").collect()}
    assert complete == {n for n, c in CASES.items() if c[1] == c[2]}


def test_summary_places_tools(scores):
    rows = E.extraction_summary(scores.where("tool IN ('same', 'cut', 'nothing')"), ["tool"]).orderBy("place").collect()
    assert [(r.tool, r.found_share, r.rows_complete_share) for r in rows] == [("same", 1.0, 1.0), ("cut", 0.9, 0.6667), ("nothing", 0.0, 0.0)]


def test_figures_in_one_form(spark):
    tokens = {"(1,204)": "-1204", "1,204*": "1204", "-": "-", "—": "-", "Rs.": None, "000": None, "'000": None, "2025/26": None, "12.5%": "12.5", "(.5)": "-.5", "-3": "-3", "a1": None, "": None}
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", E.printed_figure(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == tokens


def test_reading_grids_needs_no_shuffle_and_work_is_shared(spark):
    got = spark.createDataFrame([("a", "t", GOLD)], "id string, tool string, grid array<array<string>>")
    plan = E.extraction_scores(got.drop("tool"), got, ["id"], ["tool"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1 and plan.count("row_matches(") == 1
    E._ratio.cache_clear()
    table = [("Cash at hand", ["1"], False)] * 50
    assert E._row_matches(table, [("Cash at hands", ["1"], False)] * 50) == [50, 50, 50, 50, 0, 0]
    assert E._ratio.cache_info().misses == 1
