"""Checks of benchmark questions, on a few written by hand."""

import pytest

from cellwright.operators import benchmark as B

CELLS = [("e", "a", 540_000.0, "amount", 3), ("e", "b", 500_000.0, "amount", 3), ("e", "p", 12.5, "percent", 0), ("e", "q", 10.0, "percent", 0), ("e", "z", 0.0, "amount", 3), ("f", "a", 7.0, "amount", 0)]
GOOD = {"type": "lookup", "program": "a", "expect": "LKR 540 thousand", "author": "x", "checked_by": "y", "pilot": False, "split": None}
#: what is changed of a good question, and what is found
CASES = [
    ({}, []), ({"expect": "540"}, []), ({"expect": "540,000"}, []), ({"expect": "LKR 0.54 million"}, []), ({"expect": "541"}, ["expect '541' does not match the cells: a = 540000 (amount, base units)"]),
    ({"expect": None}, ["expect '' does not match the cells: a = 540000 (amount, base units)"]), ({"expect": "54%"}, ["expect '54%' does not match the cells: a = 540000 (amount, base units)"]),
    ({"type": "growth", "program": "growth(a, b)", "expect": "8.0%"}, []), ({"type": "growth", "program": "(a - b) / b * 100", "expect": "8%"}, []), ({"type": "growth", "program": "growth(b, a)", "expect": "7.4%"}, []),
    ({"type": "difference", "program": "b - a", "expect": "LKR 40 thousand"}, []), ({"type": "difference", "program": "p - q", "expect": "2.5%"}, []), ({"type": "ratio", "program": "a / b", "expect": "1.08x"}, []),
    ({"type": "sum", "program": "a - b", "expect": "40"}, ["type 'sum' but the answer expression looks like 'difference'"]), ({"type": "comparison", "program": "a - b", "expect": "40"}, []),
    ({"program": "nowhere"}, ["answer expression 'nowhere' fails: unknown cell nowhere"]), ({"author": None}, ["not cross-checked: author and checked_by are both required"]), ({"checked_by": ""}, ["not cross-checked: author and checked_by are both required"]),
    ({"checked_by": "x"}, ["checked by its own author"]), ({"pilot": True, "split": "dev"}, []), ({"pilot": True}, []), ({"pilot": True, "split": "test"}, ["pilot questions must come from dev issuers; this one is test"]),
    ({"type": "narrative", "program": None, "expect": None, "author": None}, ["narrative question without a reference answer in 'expect'"]), ({"type": "narrative", "program": None, "expect": "It grew.", "author": None}, []),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "evidence_id string, id string, value double, kind string, scale int")


def questions(spark, rows):
    columns = ["file", "row", "question_id", "evidence_id", "country", *GOOD]
    kinds = "file string, row int, question_id string, evidence_id string, country string, type string, program string, expect string, author string, checked_by string, pilot boolean, split string"
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], kinds)


def test_findings(spark, cells):
    rows = [GOOD | change | {"file": "r.yaml", "row": i, "question_id": f"q{i:02}", "evidence_id": "e", "country": "LK"} for i, (change, _) in enumerate(CASES)]
    got = B.benchmark_findings(questions(spark, rows), cells).collect()
    found = {f"q{i:02}": [] for i in range(len(CASES))}
    for r in got:
        found[r.question_id].append(r.message)
    assert [(CASES[int(q[1:])][0], m) for q, m in sorted(found.items())] == [(c, m) for c, m in CASES]
    counted = sum(r.n for r in B.benchmark_counts(questions(spark, rows), cells).collect())
    assert counted == len(CASES) - 1


def test_repeated_ids_name_the_file_before(spark, cells):
    rows = [GOOD | {"file": f, "row": n, "question_id": q, "evidence_id": "e", "country": "LK"} for f, n, q in (("a.yaml", 1, "q"), ("b.yaml", 1, "q"), ("b.yaml", 2, "q"), ("b.yaml", 3, "r"))]
    got = sorted((r.file, r.level, r.message) for r in B.benchmark_findings(questions(spark, rows), cells).collect())
    assert got == [("b.yaml", "error", "duplicate question id (also in a.yaml)"), ("b.yaml", "error", "duplicate question id (also in b.yaml)")]
    assert B.benchmark_findings(questions(spark, rows).where("false"), cells).collect() == []
