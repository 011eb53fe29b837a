import json

import pytest

from cellwright.sources import datasets, documents, records
from cellwright.streaming.items import checked_stream


def test_jsonl(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    open(p, "w").write('{"id": "a", "n": 1}\n\n{"id": "b", "n": 2}\n')
    assert records.read_jsonl(spark, p, "id string, n int").count() == 2
    open(p, "a").write('{"id": "c", "n": 2, "more": 1}\n')
    with pytest.raises(Exception, match="unknown fields"):
        records.read_jsonl(spark, p, "id string, n int").collect()


def test_append_new(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert records.append_new(rows("a", "b"), out, "id") == 2
    assert records.append_new(rows("b", "c"), out, "id") == 1
    assert sorted(json.loads(x)["id"] for f in tmp_path.glob("out/part-*") for x in f.read_text().split()) == ["a", "b", "c"]


def test_html(spark):
    html = "<table><tr><td colspan=2>x</td><td style='display:none'>no</td></tr><tr><td>a<table><tr><td>in</td></tr></table></td><td>1</td></tr></table>"
    rows = documents.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "k long, h string"), "k", "h").collect()
    assert {(r.table, r.row, r.col): r.text for r in rows}[(0, 0, 0)] == "x" and {r.k for r in rows} == {1}


def test_html_of_hidden_parts_spans_and_captions(spark):
    html = """<p>Old</p><div>Results <b>of</b> the year</div><table><tr><td>a<div style="display: NONE"><p>x<br></div>b</td><td colspan="250">c\u200b</td><th>d<br>e</th></tr>
    <tr></tr><tr><td colspan="x">&amp;</td><td></td></tr></table><p>Next</p><table><tr><td>z</td></tr></table><div style="display:none"><table><tr><td>no</td></tr></table></div>"""
    rows = documents.html_tables(spark.createDataFrame([(1, html)], "k long, h string"), "k", "h").collect()
    assert {(r.table, r.row, r.col, r.span): r.text for r in rows} == {(0, 0, 0, 1): "ab", (0, 0, 1, 250): "c", (0, 0, 251, 1): "d e", (0, 2, 0, 1): "&", (0, 2, 1, 1): "", (1, 0, 0, 1): "z"}
    assert {r.table: r.caption for r in rows} == {0: ["Old", "Results of the year"], 1: ["Old", "Results of the year", "Next"]}


def test_xbrl(spark):
    xml = """<x xmlns:u="u"><context id="c"><entity><identifier>E</identifier></entity><period><instant>2025-12-31</instant></period></context>
    <unit id="usd"><measure>iso4217:USD</measure></unit><u:Assets contextRef="c" unitRef="usd">12.5</u:Assets><u:Name contextRef="c">n</u:Name></x>"""
    (f,) = documents.xbrl_facts(spark.createDataFrame([("f", xml)], "k string, x string"), "k", "x").collect()
    assert (f.concept, f.unit, f.entity, f.period_end, f.period_start, float(f.value)) == ("Assets", "USD", "E", "2025-12-31", None, 12.5)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("b", 2)], "item_id string, n int").write.json(src)
    items = spark.readStream.schema("item_id string, n int").json(src)
    checked_stream(items, lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_writes_an_id_once(spark, tmp_path):
    for k, ids in enumerate((("a", "b"), ("b", "c"))):
        spark.createDataFrame([(i, k) for i in ids], "item_id string, n int").write.mode("append").json(str(tmp_path / "in"))
        items = spark.readStream.schema("item_id string, n int").json(str(tmp_path / "in"))
        checked_stream(items, lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted((r.item_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0), ("b", 0), ("c", 1)]


def test_grids_and_manifest(spark, tmp_path):
    (tmp_path / "t1.csv").write_bytes("\ufeffa,b\n1\n".encode())
    (r,) = datasets.read_grids(spark, str(tmp_path)).collect()
    assert (r.table_id, r.grid) == ("t1", [["a", "b"], ["1"]])
    listed = spark.createDataFrame([("t1.csv", 8, "x"), ("t2.csv", 1, "y")], "name string, bytes long, sha256 string")
    assert {r.name: r.state for r in datasets.drifted(spark, str(tmp_path), listed).collect()} == {"t1.csv": "changed", "t2.csv": "missing"}


def test_stream_of_rows_without_ids_and_with_times(spark, tmp_path):
    rows = [(None, 1, "2024-01-01 00:00:00"), (None, 1, "2024-01-01 00:00:00"), (None, 2, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "item_id string, n int, at string").selectExpr("item_id", "n", "timestamp(at) AS at").write.parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("item_id string, n int, at timestamp").parquet(str(tmp_path / "in"))
    checked_stream(items, lambda d: d, str(tmp_path / "out"), str(tmp_path / "ck"), time_col="at").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n for r in got if r.item_id is None) == [1, 2] and len([r for r in got if r.item_id == "a"]) == 1
