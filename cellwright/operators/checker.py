"""The rule checker: claims against all that their evidence supports, expected values, verdicts and risk.

A claim meets candidates next to its value by bands of one printed unit, so an item may have any number of candidates.
Which rows an answer's right figures come from is known after the match alone, so the pass that prefers those rows is a
second join and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.arithmetic import SLACK
from cellwright.functions.figures import half_unit
from cellwright.operators import claims as C
from cellwright.operators import evidence as E
from cellwright.session import stored

# Powers of ten that a scale error may be off by, in order; and the risk of each verdict.
SHIFTS = (3, -3, 6, -6, 9, -9)
RISK = {"supported": 0.0, "unverifiable": 0.5, "unsupported": 1.0}
KEYS = ["item_id", "claim_id"]


def claims_of(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims with context of ``items`` (item_id, evidence_id, question, asked_period, text)."""
    asked = C.question_contexts(items.where("text IS NOT NULL"), C.vocabularies(cells))
    return C.claim_contexts(C.extract_claims(asked))


def context_slots(c: str = "c_") -> list[Column]:
    """Slots in which a candidate's context differs from the claim's; what either side leaves open differs from nothing."""
    differs = lambda name: F.col(c + name) != F.col(name)
    period = F.when(differs("period"), "period").when(differs("base_period"), "period")
    return [F.when(differs("metric"), F.lit("metric")), F.when(differs("entity"), F.lit("entity_scope")), period]


def _readings(power: Column) -> Column:
    """The numbers that a candidate may show for a claim: as printed, as it is, negated, and in other scales."""
    v, raw = F.col("figure.value").cast("double"), F.col("figure.raw").cast("double")
    read = lambda way, side, x, shift: F.struct(F.lit(way).alias("way"), F.lit(side).alias("side"), x.alias("x"), (power + shift).alias("power"))
    bare = F.array(read(0, "printed", raw, 0), read(0, "value", v, 0))
    plain = F.array(read(1, "value", v, 0), read(2, "value", -v, 0))
    scaled = F.array(*[read(3 + i, "value", v * float(10.0**-s), -s) for i, s in enumerate(SHIFTS)])
    kind = F.col("figure.kind")
    return F.concat(F.when(kind == "number", bare).otherwise(F.slice(bare, 1, 0)), plain, F.when(kind == "amount", scaled).otherwise(F.slice(scaled, 1, 0)))


def matched(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every claim with each candidate that its figure may show: ``way`` and the slots that tell them apart."""
    kind = F.col("figure.kind")
    power = F.round(F.log10(half_unit(F.col("figure")) * 2)).cast("int")
    pool = F.when(kind.isin("percent", "ratio"), kind).otherwise("amount")
    columns = [*KEYS, "evidence_id", "metric", "entity", "period", "base_period", "named", "direction"]
    asked = claims.select(*columns, kind.alias("kind"), F.col("figure.value").cast("double").alias("v"), F.col("figure.currency").alias("currency"), pool.alias("pool"), F.explode(_readings(power)).alias("r"))
    asked = asked.withColumn("size", F.pow(F.lit(10.0), F.col("r.power").cast("double")))
    near = F.floor(F.col("r.x") / F.col("size"))
    asked = asked.select("*", F.col("r.side").alias("side"), F.col("r.power").alias("power"), F.explode(F.array(near - 1, near, near + 1)).alias("band"))
    # powers of ten that figures are printed in: a few dozen at most
    powers = sorted({r.power for r in asked.select("power").distinct().collect()})
    offered = candidates.select("evidence_id", "pool", *[F.col(c).alias(f"c_{c}") for c in E.CANDIDATE if c not in ("evidence_id", "pool")])
    side = lambda name, y: F.struct(F.lit(name).alias("side"), y.alias("y"))
    shown = F.array(side("value", F.col("c_value")), side("printed", F.when(F.col("pool") == "amount", F.col("c_printed"))))
    offered = offered.select("*", F.explode(shown).alias("s")).where("s.y IS NOT NULL")
    bands = F.array(*[F.struct(F.lit(p).alias("power"), F.floor(F.col("s.y") / float(10.0**p)).alias("band")) for p in powers]) if powers else F.array(F.struct(F.lit(0).alias("power"), F.lit(0).cast("long").alias("band")))
    offered = offered.select("*", F.col("s.side").alias("side"), F.explode(bands).alias("b")).select("*", "b.power", "b.band").drop("b")
    found = asked.join(offered, ["evidence_id", "pool", "side", "power", "band"])
    found = found.where(F.abs(F.col("r.x") - F.col("s.y")) <= F.col("size") / 2 + F.greatest(F.lit(SLACK), F.col("size") * SLACK))
    way, value = F.col("r.way"), F.col("c_value")
    directional = F.col("direction").isNotNull() & F.col("c_relation").isin("growth", "diff") & (F.col("v") >= 0)
    found = found.where(F.when(directional, way <= 2).otherwise((way != 2) | (value != 0)))
    disagrees = ((F.col("direction") == "up") & (value < 0)) | ((F.col("direction") == "down") & (value > 0))
    off = F.when(way == 0, None).when(directional, F.when(disagrees, "sign")).when(way == 2, "sign").when(way > 2, "scale_currency")
    found = found.withColumns({"off": off, "way": way}).withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS, "c_seq").orderBy("way", "off"))).where("_n = 1")
    metric, entity, period = context_slots()
    beside = (F.col("c_other_metric") == F.col("metric")) & F.array_contains("named", F.col("c_metric"))
    metric = F.when(F.coalesce(beside, F.lit(False)), F.lit(None)).otherwise(metric)
    money = F.when(F.col("currency") != F.col("c_currency"), "scale_currency")
    slots = F.array_sort(F.array_distinct(F.array_compact(F.array(F.col("c_slot"), "off", metric, entity, period, money))))
    in_context = F.size(F.array_compact(F.array(*context_slots()))) == 0
    return found.select(*KEYS, slots.alias("slots"), in_context.alias("in_context"), *[F.col(f"c_{c}").alias(c) for c in ("relation", "cells", "rows", "metric", "seq")])


def best_matches(found: DataFrame) -> DataFrame:
    """The candidate of each claim with the fewest slots, the plainest relation and the earliest place."""
    rank = F.lit(len(E.RANK))
    for name, r in E.RANK.items():
        rank = F.when(F.col("relation") == name, r).otherwise(rank)
    best = found.groupBy(*KEYS).agg(F.min_by(F.struct("slots", "in_context", "relation", "cells", "rows", F.col("metric").alias("found_metric")), F.struct(F.size("slots"), rank, "seq")).alias("b"))
    return best.select(*KEYS, "b.*")


def expected_values(claims: DataFrame, cells: DataFrame, prefer: DataFrame) -> DataFrame:
    """What the evidence holds for each claim's own context: expected, fix (an expression of cells), fix_cells, fix_relation.

    A percentage is a change only where its sentence says so; "by 2.1%" of a rate means points. ``prefer``: keys and rows.
    """
    kind, change, by = F.col("figure.kind"), F.col("is_change"), F.col("by_difference")
    wanted = claims.join(prefer, KEYS, "left").select(
        *KEYS, "evidence_id", "metric", "entity", "period", "base_period", F.coalesce("prefer", F.array().cast("array<struct<table_id:string,row:int>>")).alias("prefer"), kind.alias("c_kind"), change.alias("change"), by.alias("by"), (kind == "percent").alias("rate")
    )
    pairs = E.target_pairs(cells, wanted.where("change AND (rate OR (by AND c_kind IN ('amount', 'number')))"), KEYS)
    one = E.target_cells(cells, wanted.where("c_kind IN ('amount', 'number') OR (rate AND NOT change)"), KEYS)
    one = one.select(*KEYS, F.struct("id", "value", "raw", "kind").alias("one"))
    both = wanted.join(pairs, KEYS, "left").join(one, KEYS, "left")
    now, base = F.col("now"), F.col("base")
    bare, points = F.col("c_kind") == "number", F.col("rate") & (now["kind"] == "percent") & F.col("by")
    change_of = lambda c: (now[c] - base[c]).cast("double")
    cells_of = lambda: F.array(now["id"], base["id"])
    call = lambda name: F.concat(F.lit(name + "("), now["id"], F.lit(", "), base["id"], F.lit(")"))
    answer = lambda value, fix, ids, relation: F.struct(value.cast("double").alias("expected"), fix.alias("fix"), ids.alias("fix_cells"), F.lit(relation).alias("fix_relation"))
    growth = F.when(base["value"] != 0, answer(F.try_divide(change_of("value") * 100, F.abs(base["value"]).cast("double")), call("growth"), cells_of(), "growth"))
    of_rate = F.when(points, answer(change_of("value"), call("diff"), cells_of(), "diff")).otherwise(growth)
    cell = F.when(F.col("one").isNotNull(), answer(F.when(bare, F.col("one.raw")).otherwise(F.col("one.value")), F.col("one.id"), F.array(F.col("one.id")), "cell"))
    differs = F.when(F.col("by") & F.col("change") & (now["kind"] != "percent"), answer(F.when(bare, change_of("raw")).otherwise(change_of("value")), call("diff"), cells_of(), "diff"))
    chosen = F.when(F.col("rate") & F.col("change"), of_rate).when(F.col("rate"), cell).otherwise(F.coalesce(differs, cell))
    return both.select(*KEYS, chosen.alias("a")).where("a IS NOT NULL").select(*KEYS, "a.*")


def check(claims: DataFrame, cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every claim with verdict, slots, cells, relation, expected, fix and note."""
    claims = stored(claims, "claims")
    best = stored(best_matches(matched(claims, candidates)), "matches")
    # rows that an answer's supported figures come from, by what they are about
    context = claims.select(*KEYS, "metric")
    good = best.where("size(slots) = 0 AND rows IS NOT NULL AND NOT (relation = 'passage')").join(context, KEYS).select("item_id", "metric", F.explode("rows").alias("r"))
    used = good.groupBy(F.col("item_id").alias("u_item"), F.col("metric").alias("u_metric")).agg(F.collect_set("r").alias("used"))
    prefer = context.join(used, (F.col("item_id") == F.col("u_item")) & F.col("metric").eqNullSafe(F.col("u_metric")), "left").join(best.select(*KEYS, "in_context", "rows"), KEYS, "left")
    prefer = prefer.select(*KEYS, F.coalesce(F.when(F.col("in_context"), F.col("rows")), "used").alias("prefer")).where("prefer IS NOT NULL")
    rows = claims.join(best, KEYS, "left").join(expected_values(claims, cells, prefer), KEYS, "left")
    weak = (F.col("relation") == "passage") & (F.size("slots") == 0) & F.col("metric").isNotNull() & ~F.col("found_metric").eqNullSafe(F.col("metric"))
    traced, known = F.col("relation").isNotNull(), F.col("expected").isNotNull()
    none = F.array().cast("array<string>")
    verdict = F.when(weak, "unverifiable").when(traced, F.when(F.size("slots") == 0, "supported").otherwise("unsupported")).when(known, "unsupported").otherwise("unverifiable")
    slots = F.when(weak, none).when(traced, F.col("slots")).when(known, F.array(F.lit("value"))).otherwise(F.array(F.lit("missing_operand")))
    ids = F.when(traced, F.col("cells")).when(known, F.col("fix_cells")).otherwise(none)
    relation = F.when(weak | (F.col("relation") == "passage"), None).when(traced, F.col("relation")).when(known, F.col("fix_relation"))
    note = (
        F.when(weak, "found only in text that does not name this metric")
        .when(traced, F.concat(F.lit("traced to "), "relation", F.lit(" "), F.array_join("cells", ", ")))
        .when(known, "the intended cells hold a different value")
        .otherwise("no rule covers this claim, or the evidence lacks its context")
    )
    fix = F.when((verdict == "unsupported") & known, F.col("fix"))
    out = {"verdict": verdict, "slots": slots, "cells": ids, "relation": relation, "fix": fix, "note": note}
    return rows.withColumns(out).drop("in_context", "rows", "found_metric", "fix_cells", "fix_relation")


def verdict_risk(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, risk in RISK.items():
        out = F.when(verdict == name, risk).otherwise(out)
    return out


def verdicts(items: DataFrame, checks: DataFrame) -> DataFrame:
    """A row an item: risk (0.5 without claims), answers_question (a supported claim of what was asked), n_claims."""
    answers = (F.col("verdict") == "supported") & (F.col("q_metric").isNull() | F.coalesce(F.col("metric") == F.col("q_metric"), F.lit(False)))
    by_item = checks.groupBy("item_id").agg(F.max(verdict_risk(F.col("verdict"))).alias("risk"), F.bool_or(answers).alias("answers_question"), F.count("*").alias("n_claims"))
    rows = items.select("item_id").join(by_item, "item_id", "left")
    return rows.select("item_id", F.coalesce("risk", F.lit(0.5)).alias("risk"), F.coalesce("answers_question", F.lit(False)).alias("answers_question"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def detect(items: DataFrame, cells: DataFrame, passages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Checks of all claims of all items, and a row an item."""
    checks = check(claims_of(items, cells), cells, E.candidates(cells, passages, C.vocabularies(cells)))
    return checks, verdicts(items, checks)
