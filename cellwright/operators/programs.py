"""Edit programs: written from checks, run against answers, gated, and tried again once.

An edit is a row: item_id, claim_id, op (KEEP, COPY, CALCULATE, CANNOT_FIX), cell, expr, reason. Cells that expressions name
are joined by id; only the arithmetic of one expression runs in an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwright.functions import expressions as X
from cellwright.functions.figures import printed
from cellwright.functions.text import matched_case, spliced
from cellwright.operators import checker
from cellwright.operators.claims import direction_words, metrics_named

NAME = r"[A-Za-z][A-Za-z0-9_]*"
EDIT = ("item_id", "claim_id", "op", "cell", "expr", "reason")
RESULT = T.StructType([T.StructField("value", T.DecimalType(38, 10)), T.StructField("kind", T.StringType()), T.StructField("two_items", T.BooleanType()), T.StructField("error", T.StringType())])


def cells_named(expression: Column) -> Column:
    """The cells that an expression names, once each, in order."""
    names = F.regexp_extract_all(expression, F.lit(rf"({NAME})\s*(?!\w|\s*\()"), F.lit(1))
    return F.filter(F.array_distinct(names), lambda n: ~n.isin(*X.ARITY))


@F.pandas_udf(RESULT)
def evaluated(expressions: pd.Series, values: pd.Series, kinds: pd.Series) -> pd.DataFrame:
    """What each expression gives on its cells' values, the kind of that, whether it relates two line items, or why not."""
    return pd.DataFrame([X.outcome(e, dict(v or {}), dict(k or {})) for e, v, k in zip(expressions, values, kinds, strict=True)], columns=["value", "kind", "two_items", "error"])


def write_program(checks: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """Edits from the checker's fixes; a claim without one (or whose fix uses a cell that ``avoid`` lists: item_id, cell) ends
    the whole program as CANNOT_FIX. Changes built on a changed number are computed again."""
    rows = checks.select("item_id", "claim_id", "nth", "verdict", "fix", "slots", "note", "relation", "cells", "metric", "entity", F.col("figure.kind").alias("kind"), F.col("direction").isNotNull().alias("directional"))
    barred = F.array().cast("array<string>")
    if avoid is not None:
        rows = rows.join(avoid.groupBy("item_id").agg(F.collect_set("cell").alias("barred")), "item_id", "left")
        barred = F.coalesce("barred", barred)
    else:
        rows = rows.withColumn("barred", barred)
    failing = F.col("verdict") != "supported"
    stuck = failing & (F.col("fix").isNull() | F.arrays_overlap(cells_named(F.col("fix")), F.coalesce("barred", F.array().cast("array<string>"))))
    rows = rows.withColumns({"failing": failing, "stuck": F.coalesce(stuck, F.lit(False))})
    item = Window.partitionBy("item_id")
    first_stuck = F.min(F.when(F.col("stuck"), F.struct("nth", "claim_id"))).over(item)
    key = F.struct(F.coalesce("metric", F.lit("\u0000")), F.coalesce("entity", F.lit("\u0000")))
    changed = F.collect_set(F.when(F.col("failing") & F.col("kind").isin("amount", "number"), key)).over(item)
    rows = rows.withColumns({"first_stuck": first_stuck, "changed": changed, "key": key})
    rows = rows.where("first_stuck IS NULL OR first_stuck.claim_id = claim_id")
    follows = ~F.col("failing") & (F.col("kind") == "percent") & F.col("directional") & F.array_contains("changed", F.col("key")) & F.col("relation").isin("growth", "diff") & (F.size("cells") == 2)
    again = F.concat("relation", F.lit("("), F.col("cells")[0], F.lit(", "), F.col("cells")[1], F.lit(")"))
    plain = F.col("fix").rlike(rf"^{NAME}$")
    op = F.when(F.col("stuck"), "CANNOT_FIX").when(F.col("failing") & plain, "COPY").when(F.col("failing") | follows, "CALCULATE").otherwise("KEEP")
    missing = F.array_contains("slots", "missing_operand") | (F.col("verdict") == "unverifiable")
    return rows.select(
        "item_id", "claim_id", op.alias("op"), F.when(op == "COPY", F.col("fix")).alias("cell"), F.when(op == "CALCULATE", F.coalesce(F.when(F.col("failing"), F.col("fix")), again)).alias("expr"),
        F.when(op == "CANNOT_FIX", F.when(missing, "missing_operand").otherwise("ambiguous_evidence")).alias("reason"),
    )


def execute(items: DataFrame, claims: DataFrame, edits: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per item that has edits: new_text, changes, cannot_fix (the reason), error, replacements. With either of the last
    reasons the text stays as it was.

    Errors: a claim that is unknown or edited twice, a cell that is unknown or holds no number, a percentage for an amount or
    an amount for a percentage, an expression that is not one or uses no cell, edits that overlap.
    """
    claims = claims.select("item_id", "claim_id", "evidence_id", "figure", "direction", "direction_word", "w_start", "w_end")
    known = edits.join(claims, ["item_id", "claim_id"], "left").withColumn("times", F.count("*").over(Window.partitionBy("item_id", "claim_id")))
    known = known.withColumn("asked", F.when(F.col("op") == "COPY", F.array("cell")).when(F.col("op") == "CALCULATE", cells_named(F.col("expr"))))
    used = known.select("item_id", "claim_id", "evidence_id", F.col("figure.kind").alias("c_kind"), F.explode("asked").alias("id")).distinct()
    found = used.join(cells.select("evidence_id", "id", "raw", "value", F.col("kind").alias("cell_kind"), F.lit(True).alias("there")), ["evidence_id", "id"], "left")
    number = F.when(F.col("c_kind") == "number", F.col("raw")).otherwise(F.col("value")).cast("decimal(38,10)")
    found = found.groupBy("item_id", "claim_id").agg(
        F.map_from_entries(F.collect_list(F.struct("id", number))).alias("values"), F.map_from_entries(F.collect_list(F.struct("id", "cell_kind"))).alias("kinds"),
        F.min(F.when(F.col("there").isNull(), F.concat(F.lit("unknown cell "), "id"))).alias("unknown"), F.min(F.when(F.col("there") & number.isNull(), F.concat(F.lit("cell "), "id", F.lit(" holds no number")))).alias("empty"),
    )
    rows = known.join(found, ["item_id", "claim_id"], "left").withColumn("out", evaluated(F.coalesce("expr", "cell"), "values", "kinds"))
    kind, live = F.col("figure.kind"), F.col("op").isin("COPY", "CALCULATE")
    error = F.coalesce(
        F.when((F.col("op") != "CANNOT_FIX") & F.col("figure").isNull(), F.concat(F.lit("unknown claim "), "claim_id")),
        F.when((F.col("op") != "CANNOT_FIX") & (F.col("times") > 1), F.concat(F.lit("claim "), "claim_id", F.lit(" edited twice"))),
        F.when(live, F.coalesce("unknown", "empty", F.col("out.error"))),
        F.when(live & (F.size("asked") == 0), F.lit("a calculation must use at least one evidence cell")),
        F.when(live & ((F.col("out.kind") == "percent") != (kind == "percent")), F.concat("op", F.lit(" of "), F.col("out.kind"), F.lit(" into "), kind)),
    )
    opposite = F.create_map(*[F.lit(x) for w, two in direction_words().items() for x in (w, two[1])])
    value = F.col("out.value")
    turns = (F.col("op") == "CALCULATE") & F.col("direction").isNotNull()
    shown = F.when(turns, F.abs(value)).otherwise(value)
    new = printed(shown, F.col("figure"))
    flipped = turns & (F.col("direction") != F.when(value < 0, "down").otherwise("up"))
    span = lambda s, e, t: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), t.alias("new"))
    word = F.when(flipped, span(F.col("w_start"), F.col("w_end"), matched_case(F.try_element_at(opposite, F.lower("direction_word")), F.col("direction_word"))))
    figure = F.when(new != F.col("figure.text"), span(F.col("figure.start"), F.col("figure.end"), new))
    change = F.struct("claim_id", F.col("figure.text").alias("old"), new.alias("new"), value.alias("value"), F.col("asked").alias("cells"), kind.alias("kind"))
    rows = rows.select("item_id", error.alias("error"), "op", "reason", F.when(live, change).alias("change"), F.when(live, F.array_compact(F.array(word, figure))).alias("spans"))
    by_item = rows.groupBy("item_id").agg(
        F.max(F.when(F.col("op") == "CANNOT_FIX", F.coalesce("reason", F.lit("")))).alias("cannot_fix"), F.min("error").alias("error"), F.collect_list("change").alias("changes"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("replacements")
    )
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size("replacements") - 1, F.lit(1))), lambda i: F.get("replacements", i)["start"] < F.get("replacements", i - 1)["end"])
    by_item = by_item.withColumn("error", F.when(F.col("cannot_fix").isNull(), F.coalesce("error", F.when(clash, F.lit("edits overlap")))))
    done = F.col("cannot_fix").isNull() & F.col("error").isNull()
    out = by_item.join(items.select("item_id", "text"), "item_id")
    none = F.slice("replacements", 1, 0)
    return out.select("item_id", F.when(done, spliced(F.col("text"), F.col("replacements"))).otherwise(F.col("text")).alias("new_text"), "changes", "cannot_fix", "error", F.when(done, F.col("replacements")).otherwise(none).alias("replacements"))


def gate(items: DataFrame, checks: DataFrame, edits: DataFrame, results: DataFrame, cells: DataFrame, answered: DataFrame, recheck: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """item_id, passed, failures of every result that changed a text without an error.

    provenance: cells belong to the claim's metric, entity and (copies, shares and ratios) period; closure: changes built on a
    changed number were computed again; envelope: nothing else changed; recheck: all claims of the new text hold; relevance:
    it still answers. ``answered``: item_id, answers_question of the old texts; ``recheck`` checks items as ``detect`` does.
    """
    results = results.where("error IS NULL AND cannot_fix IS NULL")
    own = checks.select("item_id", "claim_id", "evidence_id", "metric", "entity", "period", "base_period", "question", "surfaces", F.col("figure.kind").alias("kind"), "direction")
    made = edits.where("op IN ('COPY', 'CALCULATE')").join(results.select("item_id"), "item_id", "left_semi")
    made = made.withColumns({"copied": F.col("op") == "COPY", "two": F.coalesce(F.col("expr").rlike(r"^\s*(share|ratio)\s*\("), F.lit(False)), "asked": cells_named(F.coalesce("expr", "cell"))})
    used = made.join(own, ["item_id", "claim_id"]).select("*", F.explode("asked").alias("id"))
    found = cells.select("evidence_id", "id", F.col("metric").alias("c_metric"), F.col("entity").alias("c_entity"), F.col("period").alias("cell_period"), F.lit(None).cast("string").alias("c_base_period"))
    used = used.join(found, ["evidence_id", "id"]).withColumn("c_period", F.when(F.col("copied") | F.col("two"), F.col("cell_period")))
    metric, entity, period = checker.context_slots()
    named = F.col("two") & F.array_contains(metrics_named(F.coalesce("question", F.lit("")), F.col("surfaces")), F.col("c_metric"))
    wrong = F.array_compact(F.array(F.when(~F.coalesce(named, F.lit(False)), metric), entity, period))
    provenance = used.withColumn("wrong", F.array_sort(wrong)).where("size(wrong) > 0")
    provenance = provenance.select("item_id", F.concat(F.lit("provenance: "), "claim_id", F.lit(" uses "), "id", F.lit(" ("), F.array_join("wrong", ", "), F.lit(")")).alias("failure"))
    moved = results.select("item_id", F.explode("changes").alias("c")).where("c.kind IN ('amount', 'number') AND c.new <> c.old").select("item_id", F.col("c.claim_id").alias("claim_id"))
    moved = moved.join(own.select("item_id", "claim_id", "metric", "entity"), ["item_id", "claim_id"]).select(F.col("item_id").alias("m_item"), F.col("metric").alias("m_metric"), F.col("entity").alias("m_entity")).distinct()
    same = (F.col("item_id") == F.col("m_item")) & F.col("metric").eqNullSafe(F.col("m_metric")) & F.col("entity").eqNullSafe(F.col("m_entity"))
    open_ = own.where("kind = 'percent' AND direction IS NOT NULL").join(moved, same, "left_semi").join(made.select("item_id", "claim_id"), ["item_id", "claim_id"], "left_anti")
    closure = open_.select("item_id", F.concat(F.lit("closure: "), "claim_id", F.lit(" depends on a changed number but was not recomputed")).alias("failure"))
    spans = checks.groupBy("item_id").agg(F.flatten(F.collect_list(F.array(F.struct(F.col("figure.start").alias("start"), F.col("figure.end").alias("end")), F.struct(F.col("w_start").cast("int").alias("start"), F.col("w_end").cast("int").alias("end"))))).alias("allowed"))
    outside = results.join(spans, "item_id").where(F.exists("replacements", lambda r: ~F.array_contains("allowed", F.struct(r["start"].alias("start"), r["end"].alias("end")))))
    envelope = outside.select("item_id", F.lit("envelope: text outside the edited claims changed").alias("failure"))
    again = items.drop("text").join(results.select("item_id", F.col("new_text").alias("text")), "item_id")
    after, verdicts = recheck(again)
    said = F.concat("claim_id", F.lit(" "), "verdict", F.lit(" "), F.array_join("slots", ","))
    bad = after.where("verdict <> 'supported'").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("nth", said.alias("s")))).alias("bad"))
    rechecked = bad.select("item_id", F.concat(F.lit("recheck: "), F.array_join(F.transform("bad", lambda b: b["s"]), "; ")).alias("failure"))
    lost = answered.where("answers_question").join(verdicts.where("NOT answers_question").select("item_id"), "item_id", "left_semi")
    relevance = lost.select("item_id", F.lit("relevance: the repaired answer no longer answers the question").alias("failure"))
    failures = provenance.unionByName(closure).unionByName(envelope).unionByName(rechecked).unionByName(relevance)
    by_item = failures.groupBy("item_id").agg(F.array_sort(F.collect_list("failure")).alias("failures"))
    return results.select("item_id").join(by_item, "item_id", "left").select("item_id", F.col("failures").isNull().alias("passed"), F.coalesce("failures", F.array().cast("array<string>")).alias("failures"))


def repair(items: DataFrame, checks: DataFrame, verdicts: DataFrame, cells: DataFrame, recheck: Callable[[DataFrame], tuple[DataFrame, DataFrame]], keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """A row per item: status (nothing_to_fix, repaired, cannot_fix, gate_failed), repaired_text, attempts, reason.

    Items whose first program fails the gate get a second one that avoids the cells of the edits that changed the text.
    ``keep`` may store an intermediate table, so that what follows does not compute it again.
    """
    state = verdicts.select("item_id", "n_claims").join(checks.groupBy("item_id").agg(F.count_if(F.col("verdict") != "supported").alias("failing")), "item_id", "left")
    fine = state.where("n_claims > 0 AND failing = 0").select("item_id", F.lit("nothing_to_fix").alias("status"), F.lit(1).alias("attempts"), F.lit("").alias("reason"))
    mute = state.where("n_claims = 0").select("item_id", F.lit("cannot_fix").alias("status"), F.lit(1).alias("attempts"), F.lit("non_numeric: no numbers to repair").alias("reason"))
    todo = state.where("failing > 0").select("item_id")
    attempt = lambda n, some, avoid: _attempt(n, items, checks.join(some, "item_id", "left_semi"), verdicts, cells, avoid, recheck, keep)
    one = attempt(1, todo, None)
    failed = one.where("status = 'gate_failed' AND passed = false")
    two = attempt(2, failed.select("item_id"), failed.select("item_id", F.explode("used").alias("cell")))
    out = one.join(failed.select("item_id"), "item_id", "left_anti").unionByName(two).select("item_id", "status", "attempts", "reason", "new_text")
    ends = fine.unionByName(mute).join(items.select("item_id", F.col("text").alias("new_text")), "item_id")
    out = out.unionByName(ends.select("item_id", "status", "attempts", "reason", "new_text"))
    return out.select("item_id", "status", "attempts", "reason", F.when(F.col("status").isin("repaired", "nothing_to_fix"), F.col("new_text")).alias("repaired_text"))


def _attempt(n: int, items: DataFrame, checks: DataFrame, verdicts: DataFrame, cells: DataFrame, avoid: DataFrame | None, recheck, keep) -> DataFrame:
    edits = keep(write_program(checks, avoid))
    results = keep(execute(items, checks, edits, cells))
    gated = gate(items, checks, edits, results, cells, verdicts.select("item_id", "answers_question"), recheck)
    rows = results.join(gated, "item_id", "left")
    status = F.when(F.col("cannot_fix").isNotNull(), "cannot_fix").when(F.col("error").isNotNull() | ~F.col("passed"), "gate_failed").otherwise("repaired")
    reason = F.coalesce("cannot_fix", "error", F.array_join("failures", "; "), F.lit(""))
    used = F.array_distinct(F.flatten(F.transform(F.filter("changes", lambda c: c["new"] != c["old"]), lambda c: c["cells"])))
    return keep(rows.select("item_id", status.alias("status"), F.lit(n).alias("attempts"), reason.alias("reason"), "new_text", "passed", used.alias("used")))
