"""Claims against candidates within printed precision: a band join and a ranked choice.

A claim's value, its negative and, for amounts, six powers of ten of it are looked up. Bands of one printed unit are join
keys, so a claim meets the candidates next to it, not all those of its item, however many an item has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.arithmetic import SLACK
from cellwright.session import dealt

SHIFTS = (3, -3, 6, -6, 9, -9)


def match_claims(claims: DataFrame, candidates: DataFrame, unit_powers: list[int]) -> DataFrame:
    """The best candidate of every claim, with slots and verdict; claims without one are unverifiable.

    ``claims``: item_id, claim_id, value, unit (a power of ten, all listed in ``unit_powers``), metric, entity, period.
    ``candidates``: item_id, cand_seq, value, relation, rank, metric, entity, period.
    """
    v = F.col("value").cast("double")
    read = lambda way, x, slot, shift: F.struct(F.lit(way).alias("way"), x.alias("x"), F.lit(slot).cast("string").alias("slot"), F.lit(shift).alias("shift"))
    reads = F.array(read(0, v, None, 0), read(1, -v, "sign", 0), *[read(2 + i, v * float(10.0**s), "scale_currency", s) for i, s in enumerate(SHIFTS)])
    asked = claims.select("*", F.explode(reads).alias("r")).withColumn("size", F.pow(F.lit(10.0), (F.col("unit") + F.col("r.shift")).cast("double")))
    asked = asked.withColumn("power", F.col("unit") + F.col("r.shift"))
    near = F.floor(F.col("r.x") / F.col("size"))
    asked = asked.select("*", F.explode(F.array(near - 1, near, near + 1)).alias("band"))
    powers = sorted({u + s for u in unit_powers for s in (0, *SHIFTS)})
    band = lambda p: F.struct(F.lit(p).alias("power"), F.floor(F.col("c_value").cast("double") / float(10.0**p)).alias("band"))
    bands = F.explode(F.array(*[band(p) for p in powers])).alias("b")
    offered = candidates.select("item_id", *[F.col(c).alias(f"c_{c}") for c in ("value", "cand_seq", "relation", "rank", "metric", "entity", "period")])
    offered = offered.select("*", bands).select("*", "b.power", "b.band").drop("b")
    found = asked.join(offered, ["item_id", "power", "band"]).where(F.abs(F.col("r.x") - F.col("c_value").cast("double")) <= F.col("size") / 2 + SLACK * F.greatest(F.lit(1.0), F.col("size")))
    found = found.withColumn("way", F.min("r.way").over(Window.partitionBy("item_id", "claim_id", "c_cand_seq"))).where("way = r.way")
    differs = lambda a, name: F.when(F.col(a) != F.col(f"c_{a}"), F.lit(name))
    slots = F.array_sort(F.array_compact(F.array(F.col("r.slot"), differs("metric", "metric"), differs("entity", "entity_scope"), differs("period", "period"))))
    best = Window.partitionBy("item_id", "claim_id").orderBy(F.size("slots"), "c_rank", "c_cand_seq")
    found = found.withColumn("slots", slots).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    chosen = found.select("item_id", "claim_id", "slots", F.col("c_relation").alias("relation"), F.col("c_cand_seq").alias("cand_seq"))
    verdict = F.when(F.col("cand_seq").isNull(), "unverifiable").when(F.size("slots") == 0, "supported").otherwise("unsupported")
    return claims.select("item_id", "claim_id").join(chosen, ["item_id", "claim_id"], "left").select("*", verdict.alias("verdict"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = 64, parts: int | None = None) -> DataFrame:
    """Pairs of spans (start, end against r_start, r_end) that overlap, found by equal bins and kept once; bins dealt over ``parts``."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    a = left.where("`end` > start").withColumn("bin", bins("start", "end"))
    b = right.where("r_end > r_start").withColumn("bin", bins("r_start", "r_end"))
    a, b = (dealt(x, parts, *keys, "bin") for x in (a, b))
    pairs = a.join(b, [*keys, "bin"]).where("start < r_end AND r_start < `end`")
    first = F.floor(F.greatest("start", "r_start") / bin_size)
    return pairs.where(F.col("bin") == first).drop("bin")


def siblings(facts: DataFrame, parts: list[str], fixed: list[str]) -> DataFrame:
    """Pairs of facts of the same ``fixed`` columns that differ in exactly one of ``parts``, and in value."""
    out = None
    for part in parts:
        keys = [*fixed, *[p for p in parts if p != part]]
        b = facts.select(*keys, F.col(part).alias("other"), F.col("value").alias("other_value"))
        pairs = facts.join(b, keys).where((F.col(part) != F.col("other")) & (F.col("value") != F.col("other_value")))
        pairs = pairs.select(*fixed, *parts, "value", F.lit(part).alias("differs"), F.col("other").cast("string").alias("other"), "other_value")
        out = pairs if out is None else out.unionByName(pairs)
    return out
