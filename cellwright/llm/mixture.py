"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its weight times all tokens over its own tokens. Each document inverts the Poisson
distribution with that mean at a uniform number made from a hash of the seed and its id, is exploded by that count, and
all copies are shuffled globally by a hash. The random numbers belong to rows, so a lost task gives the same copies again.

Per-source figures are one small aggregate; it joins back by source, and Spark broadcasts it only under its own size
threshold (else the join's skewed partitions are split). Distribution tables are as long as the rate asks; a document finds
its count in them by halving.

Defined results: a null source is a source of its own; without an id a row draws by its text; null or empty texts weigh one
token; without weights a source's share is its share of tokens to the power ``temperature``; sources without a weight
get none (all weights given); repeated rows draw alike; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

SEED, TEMPERATURE = "mix-1", 0.5


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Adds ``_table``: P(count <= k) for k = 0, 1, ... far beyond the mean, in logarithms so that large rates do not underflow."""
    top = F.ceil(F.col("rate") + F.lit(12) * F.sqrt("rate") + 24).cast("int")
    k = F.col("k").cast("double")
    steps = rates.where("rate > 0").select("_source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    upto = Window.partitionBy("_source").orderBy("k")  # a window of one source's table, as long as its rate asks
    log_p = k * F.log("rate") - F.col("rate") - F.sum(F.log(F.greatest(k, F.lit(1.0)))).over(upto)
    steps = steps.withColumn("p", F.exp(log_p)).withColumn("upto", F.sum("p").over(upto))
    tables = steps.groupBy("_source").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "upto"))), lambda x: x["upto"]).alias("_table"))
    both = rates.join(tables.withColumnRenamed("_source", "_own"), F.col("_source").eqNullSafe(F.col("_own")), "left").drop("_own")
    return both.withColumn("_table", F.coalesce("_table", F.array(F.lit(1.0))))


def draws(table: Column, u: Column) -> Column:
    """How many entries of a sorted table are at most u, by halving."""
    size = F.size(table)

    def half(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = (acc["lo"] < acc["hi"]) & (F.get(table, mid) <= u)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), half)["lo"].cast("long")


def source_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """A row per source: its tokens, target share and rate. Tokens are counted as characters, at least one a document."""
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    by = docs.groupBy(F.col(source_col).alias("_source")).agg(F.sum(size).alias("tokens"))
    if weights is None:
        wanted = F.pow(F.col("tokens").cast("double"), F.lit(temperature))
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    # totals in whole units, so that no order of adding changes a rate
    by = by.withColumn("wanted", F.round(wanted * 1e6).cast("long"))
    total = by.agg(F.sum("tokens").alias("all_tokens"), F.sum("wanted").alias("all_wanted"))
    rate = F.col("wanted").cast("double") / F.col("all_wanted") * F.col("all_tokens") / F.col("tokens")
    rated = by.crossJoin(F.broadcast(total))  # the total is one row
    return rated.select("_source", "tokens", F.coalesce(F.when(F.col("all_wanted") > 0, rate), F.lit(0.0)).alias("rate"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (all columns), copy (from 1), copies, rate: every document as often as drawn, in shuffled order."""
    rates = poisson_tables(source_rates(docs, source_col, text_col, weights, temperature))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ident = F.coalesce(F.col("row")[id_col].cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("row")[text_col], F.lit("")))))
    drawn = (
        row.withColumn("_u", hash_uniform(F.lit(seed), ident))
        .join(rates, F.col("row")[source_col].eqNullSafe(F.col("_source")))
        .withColumn("copies", draws(F.col("_table"), F.col("_u")))
        .where("copies > 0")
        .select("row", "rate", "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    )
    spot = F.xxhash64(F.lit(seed), ident, F.col("copy"))
    return drawn.withColumn("_spot", spot).orderBy("_spot", ident, "copy").drop("_spot")


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix(tk.table_of(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", "row.lang", "row.n_chars", "copy", "copies", F.round("rate", 9).alias("rate"), F.md5(F.coalesce("row.text", F.lit(""))).alias("text_md5"))


OP10_SQL = """
WITH by_source AS (
  SELECT source, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS BIGINT) AS tokens FROM documents GROUP BY source
), wanted AS (
  SELECT source, tokens, CAST(round(pow(CAST(tokens AS DOUBLE), 0.5) * 1e6) AS BIGINT) AS wanted FROM by_source
), rates AS (
  SELECT source, CAST(wanted AS DOUBLE) / CAST(sum(wanted) OVER () AS DOUBLE) * CAST(sum(tokens) OVER () AS DOUBLE) / tokens AS rate FROM wanted
), tables AS (
  SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
  FROM rates, LATERAL (SELECT unnest(range(0, 200)) AS k)
), drawn AS (
  SELECT d.*, r.rate, CAST('0x' || substr(md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
), counted AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, d.rate, d.text, CAST(count(t.k) AS BIGINT) AS copies
  FROM drawn d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source AND t.upto <= d.u
  GROUP BY ALL
)
SELECT doc_id, source, lang, n_chars, c.copy AS copy, copies, round(rate, 9) AS rate, md5(coalesce(text, '')) AS text_md5
FROM counted, LATERAL (SELECT unnest(range(1, copies + 1)) AS copy) c
"""
