"""Controlled items: an answer by template from gold cells, right or with one planted error, and what ought to become of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions import arithmetic as A
from cellwright.functions.figures import default_style, half_unit, printed
from cellwright.operators.claims import extract_claims

# The errors that can be planted, and by how many last digits an arithmetic slip is off.
ERRORS = ("none", "period", "metric", "entity", "scale", "sign", "basis", "missing_operand", "arithmetic")
SLIPS = (1, 1, 2, 3, 5, 10, 30)
CELL = ("id", "row", "row_label", "metric", "entity", "period", "kind", "value", "raw", "scale", "currency", "decimals", "seq", "table_id", "col")


def cell_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in CELL])


def _label(cell: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.regexp_replace(cell["row_label"], r"\s*\([^)]*\)\s*", " ")), r"^[ :;-]+|[ :;-]+$", "")
    return F.regexp_replace(F.coalesce(F.when(plain != "", plain), cell["metric"], F.lit("the figure")), r"\s+", " ")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def _style(cell: Column, more: Column | int = 0) -> Column:
    return default_style(F.when(cell["kind"] == "percent", "percent").otherwise("amount"), cell["scale"] + more, cell["currency"], F.coalesce(cell["decimals"], F.lit(0)))


def shapes(examples: DataFrame, cells: DataFrame) -> DataFrame:
    """Examples (question_id, evidence_id, shape, a, b) whose cells a template can tell apart.

    Labels without digits; no other cell of the same row, period and entity; changes of one line item and entity from an
    earlier period; shares of two line items.
    """
    twins = cells.groupBy("evidence_id", "table_id", "row", "period", "entity").agg(F.count("*").alias("n")).where("n > 1").select("evidence_id", "table_id", "row", "period", "entity")
    out = examples
    for side in ("a", "b"):
        t = twins.select(*[F.col(c).alias(f"t_{c}") for c in twins.columns])
        same = (F.col("evidence_id") == F.col("t_evidence_id")) & (F.col(f"{side}.table_id") == F.col("t_table_id")) & (F.col(f"{side}.row") == F.col("t_row"))
        out = out.join(t, same & F.col(f"{side}.period").eqNullSafe(F.col("t_period")) & F.col(f"{side}.entity").eqNullSafe(F.col("t_entity")), "left_anti")
        label = _label(F.col(side))
        out = out.where(F.col(f"{side}.id").isNull() | (~label.rlike(r"\d") & (F.coalesce(F.col(f"{side}.row_label"), F.lit("")) != "") & F.col(f"{side}.value").isNotNull()))
    a, b = F.col("a"), F.col("b")
    over_time = F.coalesce((a["metric"] == b["metric"]) & a["entity"].eqNullSafe(b["entity"]) & (a["period"] > b["period"]), F.lit(False))
    fits = F.when(F.col("shape").isin("difference", "growth"), over_time).when(F.col("shape") == "share", ~a["metric"].eqNullSafe(b["metric"])).otherwise(F.col("shape") == "lookup")
    return out.where(fits)


def wrong_cells(examples: DataFrame, cells: DataFrame) -> DataFrame:
    """Examples with the first other cell, in document order, that differs from ``a`` in one of period, metric and entity alone, and
    in value: wrong_period, wrong_metric (of the same column), wrong_entity."""
    other = cells.where("value IS NOT NULL").select(F.col("evidence_id").alias("o_evidence"), cell_struct().alias("o"))
    a, o = F.col("a"), F.col("o")
    own = [F.col("evidence_id") == F.col("o_evidence"), a["kind"] == o["kind"]]
    apart = (o["id"] != a["id"]) & ~o["id"].eqNullSafe(F.col("b.id")) & (o["value"] != a["value"])
    same = {c: a[c].eqNullSafe(o[c]) for c in ("metric", "entity", "period")}
    keys = {"period": [same["metric"], same["entity"]], "metric": [same["entity"], same["period"], a["table_id"] == o["table_id"], a["col"] == o["col"]], "entity": [same["metric"], same["period"]]}
    out = examples
    for name, conditions in keys.items():
        on = own[0] & own[1]
        for c in conditions:
            on &= c
        found = examples.join(other, on).where(apart & (o[name] != a[name]) | (apart & o[name].isNotNull() & a[name].isNull()))
        first = found.groupBy("question_id").agg(F.min_by("o", "o.seq").alias(f"wrong_{name}"))
        out = out.join(first, "question_id", "left")
    return out


def _sentence() -> Column:
    """The template answer of a row with its figures printed: A, B, D (difference), G (growth), S (share); ``first`` chooses
    between two wordings. Null where a figure is."""
    a, b, label = F.col("a"), F.col("b"), _label(F.col("a"))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    capital, when = _capital(label), F.coalesce(F.concat(F.lit(" in "), a["period"]), F.lit(""))
    span = said(" from ", F.col("shown_B"), " in ", b["period"], " to ", F.col("shown_A"), " in ", a["period"])
    lookup = F.when(F.col("first") | a["period"].isNull(), said(capital, " was ", F.col("shown_A"), when, ".")).otherwise(said("In ", a["period"], ", ", label, " was ", F.col("shown_A"), "."))
    share = said(capital, " was ", F.col("shown_S"), " of ", _label(b), when, ".")
    up, plain = F.col("up"), F.col("first") & ~F.col("flip")
    difference = F.when(plain, said(capital, " changed", span, ", a change of ", F.col("shown_D"), ".")).otherwise(said(capital, F.when(up, " increased").otherwise(" decreased"), " by ", F.col("shown_D"), span, "."))
    rose = said(capital, F.when(up, " rose ").otherwise(" fell "), F.col("shown_G"), span, ".")
    stands = said(capital, " was ", F.col("shown_A"), " in ", a["period"], ", ", F.when(up, "up ").otherwise("down "), F.col("shown_G"), " from ", F.col("shown_B"), " in ", b["period"], ".")
    return F.when(F.col("shape") == "lookup", lookup).when(F.col("shape") == "share", share).when(F.col("shape") == "difference", difference).otherwise(F.when(F.col("first"), rose).otherwise(stands))


def _worded(rows: DataFrame) -> DataFrame:
    """Adds ``said``: rows have shape, a, b, first, and of the error a_value, more (powers of ten), flip, basis, slip, places."""
    a, b, v = F.col("a"), F.col("b"), F.col("a_value").cast("decimal(38,10)")
    delta = (v - b["value"]).cast("decimal(38,10)")
    rate = F.when(F.col("basis"), F.try_divide(delta.cast("double") * 100, F.abs(v).cast("double"))).otherwise(A.growth(v, b["value"]))
    rows = rows.withColumns({"delta": delta, "rate": rate, "portion": A.share(v, b["value"])})
    goes = F.when(F.col("shape") == "growth", F.col("rate") >= 0).otherwise(F.col("delta") >= 0)
    rows = rows.withColumn("up", goes != F.col("flip"))
    places = lambda x: F.coalesce("places", F.when(F.abs(x) < 1, 2).otherwise(1))
    percent = lambda x: printed((F.when(F.col("shape") == "growth", F.abs(x)).otherwise(x) + F.col("slip")).cast("decimal(38,10)"), default_style(F.lit("percent"), F.lit(0), F.lit(None).cast("string"), places(x)))
    sized = F.when(F.col("first") & ~F.col("flip"), F.col("delta")).otherwise(F.abs("delta"))
    rows = rows.withColumns({"shown_A": printed(v, _style(a, F.col("more"))), "shown_B": printed(b["value"], _style(b)), "shown_D": printed(sized, _style(a)), "shown_G": percent(F.col("rate")), "shown_S": percent(F.col("portion"))})
    return rows.withColumn("said", _sentence()).drop("shown_A", "shown_B", "shown_D", "shown_G", "shown_S", "up", "delta", "rate", "portion")


def inject(examples: DataFrame, cells: DataFrame, errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """Items of examples (``shapes``): item_id, error, text, expected_action, changed_cells, removed_cells, correct_text, roles
    (what each figure stands for: A and B the cells, D their difference, G growth, S share).

    Which of two wordings an example gets, and how far a slip is off, come from digests of its id.
    """
    a, b, shape = F.col("a"), F.col("b"), F.col("shape")
    h = lambda k: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(k), "question_id"), 256), 1, 5), 16, 10).cast("long")
    rows = wrong_cells(examples, cells).withColumn("first", h("wording") % 2 == 0)
    missing = F.coalesce(F.col("wrong_period"), F.col("wrong_metric"))
    places = (h("places") % 2 + 1).cast("int")
    slip = F.get(F.array(*[F.lit(s) for s in SLIPS]), (h("slip") % len(SLIPS)).cast("int")) * F.when(places == 1, 0.1).otherwise(0.01) * F.when(h("side") % 2 == 0, 1).otherwise(-1)
    true = F.when(shape == "growth", F.abs(A.growth(a["value"], b["value"]))).otherwise(A.share(a["value"], b["value"]))
    slip = F.when(true + slip <= 0, -slip).otherwise(slip)
    own, none = a["value"], F.array().cast("array<string>")
    value = {"period": F.col("wrong_period.value"), "metric": F.col("wrong_metric.value"), "entity": F.col("wrong_entity.value"), "missing_operand": missing["value"], "scale": own * 1000}
    changed = {"period": F.col("wrong_period.id"), "metric": F.col("wrong_metric.id"), "entity": F.col("wrong_entity.id"), "missing_operand": missing["id"]}
    fits = {"scale": (shape == "lookup") & (a["kind"] == "amount"), "sign": shape.isin("growth", "difference"), "basis": shape == "growth", "arithmetic": shape.isin("growth", "share")}

    def variant(e: str, error: str, flip: bool = False, basis: bool = False) -> Column:
        slips, wide = error == "arithmetic" and e != "right", error.startswith("arithmetic")
        return F.struct(
            F.lit(e).alias("part"), F.lit(error).alias("error"), value.get(error if e == "text" else "", own).cast("decimal(38,10)").alias("a_value"), F.lit(3 if error == "scale" and e == "text" else 0).alias("more"), F.lit(flip).alias("flip"),
            F.lit(basis).alias("basis"), (slip if slips else F.lit(0.0)).alias("slip"), (places if wide else F.lit(None).cast("int")).alias("places"), fits.get(error, F.lit(True)).alias("fits"),
        )

    variants = [v for e in errors for v in (variant("text", e, e == "sign", e == "basis"), variant("right", e))]
    each = _worded(rows.select("*", F.explode(F.array(*variants)).alias("v")).select("*", "v.*").drop("v").where("fits"))
    pick = lambda part: F.max(F.when(F.col("part") == part, F.col("said")))
    carried = [F.first(c).alias(c) for c in ("evidence_id", "shape", "a", "b", "first", "wrong_period", "wrong_metric", "wrong_entity")]
    items = each.groupBy("question_id", "error").agg(*carried, pick("text").alias("text"), pick("right").alias("right"))
    items = items.where("text IS NOT NULL AND right IS NOT NULL AND (error = 'none' OR text <> right)")
    of_error = lambda by, other: reduce(lambda c, e: F.when(F.col("error") == e, by[e]).otherwise(c), by, other)
    growth = F.when(F.col("first"), F.array(F.lit("G"), F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("G"), F.lit("B")))
    difference = F.when(F.col("first") & (F.col("error") != "sign"), F.array(F.lit("B"), F.lit("A"), F.lit("D"))).otherwise(F.array(F.lit("D"), F.lit("B"), F.lit("A")))
    roles = F.when(shape == "lookup", F.array(F.lit("A"))).when(shape == "share", F.array(F.lit("S"))).when(shape == "difference", difference).otherwise(growth)
    gone = F.col("error") == "missing_operand"
    return items.select(
        "question_id", "evidence_id", F.concat("question_id", F.lit(":"), "error").alias("item_id"), "shape", "a", "b", "error", "text", F.when(F.col("error") == "none", "send").when(gone, "abstain").otherwise("repair").alias("expected_action"),
        of_error({e: F.array(c) for e, c in changed.items()}, none).alias("changed_cells"), F.when(gone, F.array(a["id"])).otherwise(none).alias("removed_cells"), F.when(~gone, F.col("right")).alias("correct_text"), roles.alias("roles"),
    )


def target_edits(items: DataFrame) -> DataFrame:
    """The edits that mend exactly the wrong figures of injected items; CANNOT_FIX where the operand is gone.

    A figure is right if it rounds to what its role stands for and, beside a word of movement, goes that way.
    """
    claims = extract_claims(items.where("error <> 'missing_operand'"))
    a, b, figure = F.col("a"), F.col("b"), F.col("figure")
    role = F.get("roles", F.col("nth"))
    value = F.when(role == "A", a["value"].cast("double")).when(role == "B", b["value"].cast("double")).when(role == "D", (a["value"] - b["value"]).cast("double")).when(role == "G", A.growth(a["value"], b["value"])).otherwise(A.share(a["value"], b["value"]))
    call = lambda name: F.concat(F.lit(name + "("), a["id"], F.lit(", "), b["id"], F.lit(")"))
    expr = F.when(role == "A", a["id"]).when(role == "B", b["id"]).when(role == "D", call("diff")).when(role == "G", call("growth")).otherwise(call("share"))
    moved = F.col("direction").isNotNull()
    near = F.abs(figure["value"].cast("double") - F.when(moved, F.abs(value)).otherwise(value)) <= half_unit(figure) + A.SLACK
    right = near & (~moved | ((F.col("direction") == "up") == (value >= 0)))
    aligned = F.count("*").over(Window.partitionBy("item_id")) == F.size("roles")
    rows = claims.withColumns({"right": right, "expression": expr, "role": role, "aligned": aligned}).where("aligned AND NOT right")
    copied = F.col("role").isin("A", "B")
    wrong = rows.select("item_id", "claim_id", F.when(copied, "COPY").otherwise("CALCULATE").alias("op"), F.when(copied, F.col("expression")).alias("cell"), F.when(~copied, F.col("expression")).alias("expr"), F.lit(None).cast("string").alias("reason"))
    gone = items.where("error = 'missing_operand'").select("item_id", F.concat(F.lit("k"), F.array_position("roles", "A")).alias("claim_id"), F.lit("CANNOT_FIX").alias("op"), F.lit(None).cast("string").alias("cell"), F.lit(None).cast("string").alias("expr"), F.lit("missing_operand").alias("reason"))
    return wrong.unionByName(gone)


def gold_values(examples: DataFrame) -> DataFrame:
    """question_id, role, kind, value, cell of each example: its answer, and its cells as operands."""
    a, b, shape = F.col("a"), F.col("b"), F.col("shape")
    kind = lambda c: F.when(c["kind"] == "percent", "percent").otherwise("amount")
    answer = F.when(shape == "lookup", a["value"].cast("double")).when(shape == "difference", (a["value"] - b["value"]).cast("double")).when(shape == "growth", A.growth(a["value"], b["value"])).otherwise(A.share(a["value"], b["value"]))
    value = lambda role, k, v, c: F.struct(F.lit(role).alias("role"), k.alias("kind"), v.cast("double").alias("value"), c.alias("cell"))
    values = F.array(value("answer", F.when(shape.isin("growth", "share"), "percent").otherwise(kind(a)), answer, F.when(shape == "lookup", a["id"])), value("operand", kind(a), a["value"], a["id"]), value("operand", kind(b), b["value"], b["id"]))
    return examples.select("question_id", F.explode(values).alias("g")).where("g.value IS NOT NULL").select("question_id", "g.*")
