"""Tables inside HTML, XBRL instances, and question sets in nested JSON, as flat rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements that have no end; signs of no width that fill cells; how many blocks of text before a table are its caption.
VOID = ("br", "img", "hr", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr")
NO_WIDTH, CAPTION = dict.fromkeys(map(ord, "\u200b\u200c\u200d\u2060\ufeff")), 4


class _Tables(HTMLParser):
    """Cells (table, row, col, span, text) of the outermost tables, and the last blocks of text before each table.

    A cell stands in the first column that its row has left. A hidden element is skipped with all that it holds; its end
    closes what was left open inside it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells, self.captions, self.blocks, self.words = [], [], [], []
        self.depth, self.hidden, self.row, self.col, self.open = 0, [], -1, 0, None

    def _end_block(self):
        text = " ".join("".join(self.words).split())
        self.blocks = (self.blocks + [text])[-CAPTION:] if text else self.blocks
        self.words = []

    def handle_starttag(self, tag, attrs):
        style = dict(attrs)
        if self.hidden or "display:none" in re.sub(r"\s", "", style.get("style") or "").lower():
            self.hidden += [tag] if tag not in VOID else []
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self._end_block()
                self.captions.append(list(self.blocks))
                self.row = -1
        elif self.depth == 1 and tag == "tr":
            self.row, self.col, self.open = self.row + 1, 0, None
        elif self.depth == 1 and tag in ("td", "th") and self.row >= 0:
            span = style.get("colspan") or "1"
            self.open = (max(1, int(span)) if span.strip().isdigit() else 1, [])
        elif not self.depth and tag in ("p", "div"):
            self._end_block()

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        elif tag == "table":
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th") and self.open:
            span, words = self.open
            self.cells.append((len(self.captions) - 1, self.row, self.col, span, " ".join("".join(words).split())))
            self.col, self.open = self.col + span, None
        elif not self.depth and tag in ("p", "div"):
            self._end_block()

    def handle_data(self, data):
        if not self.hidden and (self.open or not self.depth):
            (self.open[1] if self.open else self.words).append(data.translate(NO_WIDTH))


def cells_in(html: str | None) -> list[tuple]:
    """Cells with the caption of their table."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    return [(*c, parser.captions[c[0]]) for c in parser.cells]


_CELL = T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("table", "row", "col", "span")], T.StructField("text", T.StringType()), T.StructField("caption", T.ArrayType(T.StringType()))])


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table (from 0), row, col, span, text of every cell in every outermost table, and the caption: texts just before the table.

    A cell of any span is one row; the columns that it covers hold no other cell.
    """

    @F.pandas_udf(T.ArrayType(_CELL))
    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(cells_in)

    return pages.where(F.lower(html).contains("<table")).select(key, F.inline(cells(html)))


def question_rows(documents: DataFrame) -> DataFrame:
    """Documents with a table, paragraphs and nested questions, as one row a question with arithmetic or span answers.

    The document's scale is the most frequent one of its questions.
    """
    rows = documents.select(F.col("table.uid").alias("table_uid"), "table.table", "paragraphs", F.explode("questions").alias("q"))
    mode = rows.groupBy("table_uid").agg(F.mode("q.scale").alias("scale"))
    kept = rows.where(F.col("q.answer_type").isin("arithmetic", "span"))
    return kept.join(mode, "table_uid").select(F.col("q.uid").alias("question_id"), "table_uid", "table", "paragraphs", F.col("q.question").alias("text"), F.col("q.derivation").alias("derivation"), "scale")


def xbrl_facts(instances: DataFrame, key: str, xml: str) -> DataFrame:
    """Facts of XBRL instances: concept, value, unit, period_start, period_end, entity, context_id, dimensions.

    Contexts and units are looked up within the instance that a row holds.
    """
    fields = "array<struct<concept:string,value:string,unit:string,period_start:string,period_end:string,entity:string,context_id:string,dimensions:array<struct<axis:string,member:string>>>>"

    @F.pandas_udf(fields)
    def facts(texts: pd.Series) -> pd.Series:
        return texts.map(_facts_in)

    rows = instances.select(key, F.explode(facts(xml)).alias("f")).select(key, "f.*")
    return rows.withColumn("value", F.col("value").try_cast("decimal(38,4)")).where("value IS NOT NULL")


def _facts_in(xml: str | None) -> list[dict]:
    import xml.etree.ElementTree as ET

    local = lambda tag: tag.rsplit("}", 1)[-1]
    root = ET.fromstring(xml) if xml else []
    contexts, units = {}, {}
    for node in root:
        if local(node.tag) == "context":
            one = {"entity": None, "period_start": None, "period_end": None, "dimensions": []}
            for x in node.iter():
                name, text = local(x.tag), (x.text or "").strip()
                if name == "identifier":
                    one["entity"] = text
                elif name in ("instant", "endDate"):
                    one["period_end"] = text
                elif name == "startDate":
                    one["period_start"] = text
                elif name in ("explicitMember", "typedMember"):
                    one["dimensions"].append({"axis": x.get("dimension", "").rsplit(":", 1)[-1], "member": (text or "".join(x.itertext()).strip()).rsplit(":", 1)[-1]})
            one["dimensions"].sort(key=lambda d: (d["axis"], d["member"]))
            contexts[node.get("id")] = one
        elif local(node.tag) == "unit":
            units[node.get("id")] = "/".join((x.text or "").strip().rsplit(":", 1)[-1] for x in node.iter() if local(x.tag) == "measure")
    out = []
    for node in root:
        ref = node.get("contextRef")
        if ref in contexts and node.get("unitRef") in units and (node.text or "").strip():
            out.append({"concept": local(node.tag), "value": node.text.strip(), "unit": units[node.get("unitRef")], "context_id": ref, **contexts[ref]})
    return out
