"""Questions written for a benchmark, checked before they count: every expectation is a row of findings or none.

Programs are evaluated on their own cells only, joined by key; what is expected is compared as it is printed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from cellwright.functions import expressions as X
from cellwright.functions.arithmetic import SLACK
from cellwright.functions.figures import figures, half_unit
from cellwright.operators.programs import cells_named, evaluated

# Types that only people label, and types whose wording and not their program decides.
NARRATIVE, BY_WORDING = "narrative", ("comparison", "narrative")


def _answer(node: X.Node) -> str | None:
    """What the root of a program makes of its cells; null where they decide."""
    times_hundred = node.kind == "*" and node.parts[1].kind == "number" and float(node.parts[1].value) == 100
    if node.kind in ("growth", "share") or times_hundred:
        return "percent"
    return "ratio" if node.kind in ("ratio", "/") else None


@F.pandas_udf(K.StructType([K.StructField("answer", K.StringType()), K.StructField("implied", K.StringType())]))
def program_shapes(programs: pd.Series) -> pd.DataFrame:
    """The kind of answer that a program's root gives, and the type of question that its shape answers."""

    def one(text: str | None) -> tuple[str | None, str]:
        try:
            node = X.parse(text or "")
        except X.ExpressionError:
            return None, "other"
        return _answer(node), X.question_type(node)

    return pd.DataFrame([one(p) for p in programs], columns=["answer", "implied"])


def question_values(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Questions (file, question_id, evidence_id, program) with value, answer_kind, implied, first_scale and error.

    ``first_scale`` is that of the first amount that the program names.
    """
    keys = ["file", "question_id", "row"]
    named = questions.select(*keys, "evidence_id", F.posexplode(cells_named(F.col("program"))).alias("nth", "id"))
    held = named.join(cells.select("evidence_id", "id", F.col("value").cast("decimal(38,10)").alias("value"), "kind", "scale"), ["evidence_id", "id"])
    by = held.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("values"), F.map_from_entries(F.collect_list(F.struct("id", "kind"))).alias("kinds"), F.bool_and(F.col("kind") == "percent").alias("rates"),
        F.min_by("scale", F.when(F.col("kind") == "amount", F.col("nth"))).alias("first_scale"),
    )
    rows = questions.join(by, keys, "left").withColumns({"e": evaluated("program", "values", "kinds"), "shape": program_shapes("program")})
    kind = F.when(F.col("shape.answer") == "percent", "percent").when(F.col("rates"), "percent").otherwise(F.coalesce("shape.answer", F.lit("amount")))
    return rows.select(*questions.columns, F.col("e.value").alias("value"), kind.alias("answer_kind"), F.col("shape.implied").alias("implied"), F.coalesce("first_scale", F.lit(0)).alias("first_scale"), F.col("e.error").alias("error"))


def expectation_met(expect: Column, value: Column, kind: Column, first_scale: Column) -> Column:
    """Whether the first figure of an expectation shows a value: without a unit in the table's unit too, or a fall without its minus."""
    m = F.get(expect, F.lit(0))
    v, printed = value.cast("double"), m["value"].cast("double")
    near = lambda x: F.abs(printed - x) <= half_unit(m) + SLACK
    power = F.pow(F.lit(10.0), F.when(kind == "amount", first_scale).otherwise(0).cast("double"))
    return F.coalesce(F.when(m["kind"] == "number", near(v / power) | near(v)).when((m["kind"] == "percent") & (kind != "percent"), False).otherwise(near(v) | near(-v)), F.lit(False))


def _plain(value: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(value.cast("string"), r"\.?0+$", "")


def benchmark_findings(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """file, question_id, level, message of everything that is wrong with questions (file, row: their order, question_id, evidence_id,
    type, program, expect, author, checked_by, pilot, split).

    A narrative question is held against its reference alone, a program that fails against nothing further.
    """
    rows = question_values(questions, cells).withColumn("figures", figures(F.coalesce("expect", F.lit(""))))
    before = F.lag("file").over(Window.partitionBy("question_id").orderBy("file", "row"))
    rows = rows.withColumn("before", before)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    of = lambda level, when, message: F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), message.alias("message")))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    narrative, fails = F.col("type") == NARRATIVE, F.col("error").isNotNull()
    goes_on = ~narrative & ~fails
    met = expectation_met(F.col("figures"), F.col("value"), F.col("answer_kind"), F.col("first_scale"))
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(F.col(c), F.lit("")), F.lit("'"))
    found = F.array(
        of("error", F.col("before").isNotNull(), text("duplicate question id (also in ", F.col("before"), ")")),
        of("warning", narrative & empty("expect"), F.lit("narrative question without a reference answer in 'expect'")),
        of("error", ~narrative & fails, text("answer expression ", quoted("program"), " fails: ", F.col("error"))),
        of("error", goes_on & ~met, text("expect ", quoted("expect"), " does not match the cells: ", F.coalesce("program", F.lit("")), " = ", _plain(F.col("value")), " (", F.col("answer_kind"), ", base units)")),
        of("warning", goes_on & (F.col("implied") != "other") & (F.col("implied") != F.col("type")) & ~F.col("type").isin(*BY_WORDING), text("type ", quoted("type"), " but the answer expression looks like ", quoted("implied"))),
        of("warning", goes_on & (empty("author") | empty("checked_by")), F.lit("not cross-checked: author and checked_by are both required")),
        of("warning", goes_on & ~empty("author") & (F.col("author") == F.col("checked_by")), F.lit("checked by its own author")),
        of("error", goes_on & F.col("pilot") & (F.col("split") != "dev"), text("pilot questions must come from dev issuers; this one is ", F.col("split"))),
    )
    return rows.select("file", "question_id", F.inline(F.array_compact(found)))


def benchmark_counts(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """country, split, type, n of the questions that can be checked: narrative ones, and those whose program gives a value."""
    rows = question_values(questions, cells).where(f"type = '{NARRATIVE}' OR error IS NULL")
    return rows.groupBy("country", F.coalesce("split", F.lit("unassigned")).alias("split"), "type").agg(F.count("*").alias("n"))
