"""Splits and samples by hashes of ids: the same row lands in the same place at every size and in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shares of issuers in each part, in order.
TRACK = (("fit", 0.5), ("tune", 0.1), ("calibration", 0.2), ("test", 0.2))


def hash_share(ident: Column) -> Column:
    """A number from 0 to 1 of the first eight hex digits of a digest."""
    return F.conv(F.substring(F.sha2(ident.cast("string"), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def track_split(issuer: Column) -> Column:
    """The part of ``TRACK`` that an issuer's share falls in."""
    x, out = hash_share(issuer), F.lit(TRACK[-1][0])
    for i in range(len(TRACK) - 2, -1, -1):
        out = F.when(x < round(sum(part for _, part in TRACK[: i + 1]), 9), TRACK[i][0]).otherwise(out)
    return out


def part_of(ident: Column, parts: int) -> Column:
    """One of 2, 4, 8 or 16 parts, by the last hex digit of the digest."""
    return F.conv(F.right(F.sha2(ident.cast("string"), 256), F.lit(1)), 16, 10).cast("int") % parts


def draw_per_group(rows: DataFrame, by: list[str], ident: str, n: int) -> DataFrame:
    """Up to n rows of each group, in the order of a hash of their ids."""
    w = Window.partitionBy(*by).orderBy(F.sha2(F.col(ident).cast("string"), 256), ident)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def stratified(rows: DataFrame, by: list[str], ident: str, total: int) -> DataFrame:
    """``total`` rows shared out to strata by size, largest remainders first; within a stratum in hash order."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    whole = sizes.agg(F.sum("n").alias("all"))
    quota = sizes.crossJoin(F.broadcast(whole)).withColumn("exact", F.col("n") * total / F.col("all")).withColumn("base", F.floor("exact"))
    # strata are few: one ordered pass over them shares out what is left
    rest = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("exact") - F.col("base")), *by)
    left = F.least(F.lit(total).cast("long"), F.col("all")) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    quota = quota.withColumn("quota", F.col("base") + (F.row_number().over(rest) <= left).cast("long")).select(*by, "quota")
    w = Window.partitionBy(*by).orderBy(F.sha2(F.col(ident).cast("string"), 256), ident)
    return rows.join(quota, by).withColumn("_n", F.row_number().over(w)).where("_n <= quota").drop("_n", "quota")


def with_split(rows: DataFrame, splits: DataFrame, key: str, default: str = "train") -> DataFrame:
    return rows.join(splits.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def todo(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumable sink has not got yet."""
    return source.join(done.select(key), key, "left_anti")
