import re

import pytest
from oracle import duck, rows_of

from cellwright import session
from cellwright.plans import answer_queries, benchmark_queries, evidence_queries, extraction_queries, natural_queries, policy_queries, review_queries

DIR = "/root/testdata/sf0.001"
PLANS = (evidence_queries, review_queries, answer_queries, natural_queries, extraction_queries, policy_queries, benchmark_queries)
SQL = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}


def queries():
    return {name: f for plan in PLANS for name, f in plan.queries().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert rows_of(queries()[name](spark, DIR).toPandas()) == rows_of(duck(SQL[name], DIR))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_others_have_rows(spark, name):
    assert queries()[name](spark, DIR).count() > 0


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["claim_features", "flagged_claims", "fused_risk", "merged_spans", "span_quality"])
def test_tasks_grow_in_number(spark, monkeypatch, name):
    """No sort, window or join over order lines is dealt over fewer partitions than their number asks for."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    most = session.parts_of(spark.read.parquet(f"{DIR}/lineitem.parquet"))
    rows = queries()[name](spark, DIR)
    dealt = re.findall(r"hashpartitioning\(.*?, (\d+)\)", rows._jdf.queryExecution().executedPlan().toString())
    assert most > 10 and dealt and {int(n) for n in dealt} == {most}
    assert rows_of(rows.toPandas()) == rows_of(duck(SQL[name], DIR))
