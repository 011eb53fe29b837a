"""What evidence supports: cells, changes between periods, differences of entities, shares and ratios, figures in passages.

``cells`` has evidence_id, table_id, row, col, id, seq (place in the document), kind, raw and value (decimals), currency,
metric, entity, period. Every pool is an equi self-join on the keys of a series or a column; a column takes part in shares
only up to ``MOST_IN_COLUMN`` amounts, as the operator is defined, so no join grows with the square of a long table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions import arithmetic as A

# A longer column has no shares; and how relations rank, the plainest first.
MOST_IN_COLUMN = 40
RANK = {"cell": 0, "passage": 1, "growth": 2, "diff": 3, "share": 4, "ratio": 5}
SERIES = ("evidence_id", "table_id", "row", "entity")
#: What a candidate is: where it comes from, what it is worth, and its place among those that fit as well.
CANDIDATE = ("evidence_id", "pool", "relation", "value", "printed", "cells", "metric", "entity", "period", "base_period", "slot", "other_metric", "currency", "rows", "seq")


def _seq(phase: int, *parts: Column) -> Column:
    """Candidates in order: cells, changes, entities, columns, passages; within each by the places of their cells."""
    places = [*parts, *[F.lit(0)] * (4 - len(parts))]
    return F.struct(F.lit(phase).alias("phase"), *[p.cast("long").alias(f"p{i}") for i, p in enumerate(places)]).alias("seq")


def _candidate(frame: DataFrame, pool: Column, relation: str | Column, value: Column, seq: Column, **more: Column) -> DataFrame:
    """Rows as candidates; a column that is not given is null."""
    kinds = {"printed": "double", "cells": "array<string>", "entity": "string", "period": "string", "base_period": "string", "slot": "string", "other_metric": "string", "currency": "string"}
    kinds |= {"rows": "array<struct<table_id:string,row:int>>", "metric": "string"}
    given = {"pool": pool, "relation": F.lit(relation) if isinstance(relation, str) else relation, "value": value.cast("double"), "seq": seq, "evidence_id": F.col("evidence_id")} | more
    return frame.select(*[(given[c] if c in given else F.lit(None)).cast(kinds[c]).alias(c) if c in kinds else given[c].alias(c) for c in CANDIDATE])


def _kind(relation: str, value: Column, slot: str | None, pool: Column, shown: Column) -> Column:
    """One of several values that come of one pair of cells."""
    return F.struct(F.lit(relation).alias("relation"), value.alias("v"), F.lit(slot).cast("string").alias("slot"), pool.cast("string").alias("pool"), shown.cast("double").alias("printed"))


def _pool(kind: Column) -> Column:
    return F.when(kind == "percent", "percent").when(kind == "ratio", "ratio").otherwise("amount")


def first_per_period(cells: DataFrame) -> DataFrame:
    """The first cell of each series and period counts."""
    w = Window.partitionBy(*SERIES, "period").orderBy("seq")
    kept = cells.where("metric IS NOT NULL AND period IS NOT NULL AND value IS NOT NULL AND kind IN ('amount', 'number', 'percent')")
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def period_pairs(cells: DataFrame) -> DataFrame:
    """All ordered pairs of periods of a series: value (later), base (earlier), and the place where the series starts."""
    a = first_per_period(cells).withColumn("series_seq", F.min("seq").over(Window.partitionBy(*SERIES)))
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in (*SERIES, "period", "value", "raw", "id")])
    on = [F.col(c).eqNullSafe(F.col(f"b_{c}")) if c == "entity" else F.col(c) == F.col(f"b_{c}") for c in SERIES]
    pairs = a.join(b, reduce(lambda x, y: x & y, on) & (F.col("b_period") < F.col("period")))
    return pairs.select(
        *SERIES, "metric", "kind", "period", F.col("b_period").alias("base_period"), "value", F.col("b_value").alias("base"), "raw", F.col("b_raw").alias("base_raw"), "id", F.col("b_id").alias("base_id"), "series_seq"
    )


def changes(cells: DataFrame) -> DataFrame:
    """diff, growth, and growth on the wrong base (slot ``basis``), a candidate each. A rate's change is in points."""
    value, base, rate = F.col("value").cast("double"), F.col("base").cast("double"), F.col("kind") == "percent"
    kinds = F.array(
        _kind("diff", value - base, None, F.when(rate, "percent").otherwise("amount"), F.when(~rate, (F.col("raw") - F.col("base_raw")).cast("double"))),
        _kind("growth", A.growth(F.col("value"), F.col("base")), None, F.lit("percent"), F.lit(None)),
        _kind("growth", F.when(~rate, F.try_divide((value - base) * 100, F.abs(value))), "basis", F.lit("percent"), F.lit(None)),
    )
    rows = period_pairs(cells).select("*", F.posexplode(kinds).alias("nth", "k")).where("k.v IS NOT NULL")
    return _candidate(
        rows, F.col("k.pool"), F.col("k.relation"), F.col("k.v"), _seq(1, F.col("series_seq"), F.col("base_period").try_cast("long"), F.col("period").try_cast("long"), F.col("nth")),
        printed=F.col("k.printed"), cells=F.array("id", "base_id"), metric=F.col("metric"), entity=F.col("entity"), period=F.col("period"), base_period=F.col("base_period"), slot=F.col("k.slot"),
        rows=F.array(F.struct("table_id", "row")),
    )


def entity_differences(cells: DataFrame) -> DataFrame:
    """One entity against another in the same row and period; rates are left out."""
    a = first_per_period(cells).where("entity IS NOT NULL AND kind <> 'percent'")
    b = a.select("evidence_id", "table_id", "row", "period", F.col("entity").alias("other"), F.col("value").alias("other_value"), F.col("raw").alias("other_raw"), F.col("id").alias("other_id"), F.col("seq").alias("other_seq"))
    pairs = a.join(b, ["evidence_id", "table_id", "row", "period"]).where("entity <> other")
    return _candidate(
        pairs, F.lit("amount"), "diff", F.col("value") - F.col("other_value"), _seq(2, F.col("seq"), F.col("other_seq")), printed=(F.col("raw") - F.col("other_raw")),
        cells=F.array("id", "other_id"), metric=F.col("metric"), entity=F.col("entity"), period=F.col("period"), rows=F.array(F.struct("table_id", "row")),
    )


def column_pairs(cells: DataFrame) -> DataFrame:
    """Shares and ratios of every two amounts |a| <= |b| within a column of at most MOST_IN_COLUMN amounts."""
    inside = Window.partitionBy("evidence_id", "table_id", "col")
    a = cells.where("value IS NOT NULL AND kind = 'amount'").withColumn("_n", F.count("*").over(inside)).where(F.col("_n") <= MOST_IN_COLUMN)
    b = a.select("evidence_id", "table_id", "col", F.col("id").alias("of_id"), F.col("metric").alias("of_metric"), F.col("value").alias("whole"), F.col("seq").alias("of_seq"))
    pairs = a.join(b, ["evidence_id", "table_id", "col"]).where("id <> of_id AND whole <> 0 AND abs(value) <= abs(whole)")
    both = F.array(
        _kind("share", A.share(F.col("value"), F.col("whole")), None, F.lit("percent"), F.lit(None)),
        _kind("ratio", A.ratio(F.col("value"), F.col("whole")), None, F.lit("ratio"), F.lit(None)),
    )
    rows = pairs.select("*", F.posexplode(both).alias("nth", "k"))
    return _candidate(
        rows, F.col("k.pool"), F.col("k.relation"), F.col("k.v"), _seq(3, F.col("col"), F.col("seq"), F.col("of_seq"), F.col("nth")), cells=F.array("id", "of_id"), metric=F.col("metric"), entity=F.col("entity"),
        period=F.col("period"), other_metric=F.col("of_metric"),
    )


def cell_candidates(cells: DataFrame) -> DataFrame:
    numeric = cells.where("value IS NOT NULL")
    return _candidate(
        numeric, _pool(F.col("kind")), "cell", F.col("value"), _seq(0, F.col("seq")), printed=F.col("raw"), cells=F.array("id"), metric=F.col("metric"), entity=F.col("entity"), period=F.col("period"),
        currency=F.col("currency"), rows=F.array(F.struct("table_id", "row")),
    )


def passage_candidates(passages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Figures of passages (evidence_id, id, nth, text) in the context that their sentence names."""
    from cellwright.functions import text as T
    from cellwright.operators.claims import entity_in, extract_claims, metric_in

    found = extract_claims(passages.select("evidence_id", "id", F.col("nth").alias("passage"), "text")).join(vocabulary, "evidence_id")
    figure = F.col("figure")
    return _candidate(
        found, _pool(figure["kind"]), "passage", figure["value"], _seq(4, F.col("passage"), F.col("nth")), printed=figure["raw"], cells=F.array("id"), metric=metric_in(F.col("sentence"), F.col("surfaces")),
        entity=entity_in(F.col("sentence"), F.col("entities")), period=T.normalise_period(F.col("sentence")), currency=figure["currency"],
    )


def candidates(cells: DataFrame, passages: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """All that the evidence supports, as one table of CANDIDATE columns."""
    pools = [cell_candidates(cells), changes(cells), entity_differences(cells), column_pairs(cells)]
    if passages is not None:
        pools.append(passage_candidates(passages, vocabulary))
    return reduce(DataFrame.unionByName, pools)


def without(cells: DataFrame, gone: DataFrame, keys: list[str] = ["evidence_id", "id"]) -> DataFrame:  # noqa: B006
    """Cells but those that ``gone`` lists."""
    return cells.join(gone.select(*keys), keys, "left_anti")


def _series_of(wanted: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of ``wanted`` with the series it may mean: of its metric, of its entity where any has it (of the group where
    it names none and several have one), of the preferred rows where any is preferred."""
    series = first_per_period(cells).select("evidence_id", "metric", *[F.col(c).alias(f"s_{c}") for c in ("table_id", "row", "entity", "period", "kind", "value", "raw", "id", "seq")])
    found = wanted.where("metric IS NOT NULL").join(series, ["evidence_id", "metric"])
    w = Window.partitionBy(*keys)
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(w)
    own, group = F.col("entity") == F.col("s_entity"), F.col("s_entity") == "group"
    several = (F.min(F.coalesce("s_entity", F.lit(""))).over(w) != F.max(F.coalesce("s_entity", F.lit(""))).over(w)) & F.col("entity").isNull()
    keep = F.when(some(own), own).when(several & some(group), group).otherwise(F.lit(True))
    found = found.withColumn("_keep", F.coalesce(keep, F.lit(False))).where("_keep").drop("_keep")
    preferred = F.array_contains("prefer", F.struct(F.col("s_table_id").alias("table_id"), F.col("s_row").alias("row")))
    found = found.withColumn("_any", some(preferred)).withColumn("_own", F.coalesce(preferred, F.lit(False)))
    return found.where("_own OR NOT _any").drop("_own", "_any")


def target_cells(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The one cell that each row of ``wanted`` (keys, evidence_id, metric, entity, period, prefer, rate) means: of its period,
    or else of each series' latest; null where series disagree. ``rate`` asks for a percent or for anything else."""
    found = _series_of(wanted, cells, keys)
    latest = F.max("s_period").over(Window.partitionBy(*keys, "s_table_id", "s_row", "s_entity"))
    found = found.withColumn("_latest", latest).where(F.col("s_period") == F.coalesce("period", "_latest"))
    found = found.where(F.col("rate").isNull() | ((F.col("s_kind") == "percent") == F.col("rate")))
    one = found.groupBy(*keys).agg(F.count_distinct("s_value").alias("n"), F.min(F.struct("s_seq", "s_id", "s_value", "s_raw", "s_kind")).alias("c")).where("n = 1")
    return one.select(*keys, F.col("c.s_id").alias("id"), F.col("c.s_value").alias("value"), F.col("c.s_raw").alias("raw"), F.col("c.s_kind").alias("kind"))


def target_pairs(cells: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The later and the earlier cell of the change that each row of ``wanted`` means: from the base period that it states, if
    the series has it, else from the latest period before; null where series disagree."""
    found = _series_of(wanted, cells, keys)
    series = Window.partitionBy(*keys, "s_table_id", "s_row", "s_entity")
    cell = F.struct(*[F.col(f"s_{c}").alias(c) for c in ("seq", "id", "value", "raw", "kind")])
    found = found.withColumn("_p", F.coalesce("period", F.max("s_period").over(series)))
    earlier = F.max(F.when(F.col("s_period") < F.col("_p"), F.struct("s_period", cell.alias("c")))).over(series)
    stated = F.max(F.when(F.col("s_period") == F.col("base_period"), F.struct("s_period", cell.alias("c")))).over(series)
    found = found.withColumn("_b", F.coalesce(stated, earlier)).where((F.col("s_period") == F.col("_p")) & (F.col("_b.s_period") < F.col("_p")))
    one = found.select(*keys, cell.alias("now"), F.col("_b.c").alias("base")).groupBy(*keys)
    one = one.agg(F.count_distinct("now.value", "base.value").alias("n"), F.min(F.struct(F.col("now.seq"), F.col("now"), F.col("base"))).alias("c")).where("n = 1")
    return one.select(*keys, "c.now", "c.base")


def base_periods(cells: DataFrame) -> DataFrame:
    """Each cell with the latest period before its own in its series, and that period's value."""
    w = Window.partitionBy(*SERIES).orderBy("period")
    return first_per_period(cells).select("evidence_id", "metric", "entity", "period", "value", F.lag("period").over(w).alias("base_period"), F.lag("value").over(w).alias("base"))
