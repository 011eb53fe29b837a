"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate.

1. Lines are counted by a 128-bit hash; a line with fewer occurrences than ``min_sites`` cannot spread over as many sites.
   The ``HOT`` most frequent lines are joined as a broadcast table of that many rows, so no task gets all rows of one line.
2. For the others, HyperLogLog sketches of their sites merge by aggregation. A line is boilerplate if its estimate is
   clearly above ``min_sites``, not if clearly below; estimates within ``margin`` of it get an exact distinct count.
3. A boilerplate line goes from every document but the earliest that has it (``keep_first``), so no content is lost.
   Only hashes, ids and line numbers move; texts meet their line numbers in one join by id and text hash.

Defined results: lines are split at line feeds and compared without surrounding spaces; blank lines are kept and never
counted; a null site is a site of its own; null text stays null; rows with a null id count but lose no line; rows with
one id and different texts are different documents, the one of the least text hash the earlier; repeated rows give repeated
results; an empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

MIN_SITES, MARGIN, LG_K, HOT = 5, 0.15, 12, 4096
LINE = ["h1", "h2"]


def site_lines(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """A row per line that is not blank: its hash, document, place and site."""
    lines = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("site"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("place", "line"),
    ).withColumn("line", F.trim("line"))
    return lines.where("line <> ''").select("id", "th", "site", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def with_lines(rows: DataFrame, some: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows joined to some lines by hash: those of the hot lines by a broadcast of at most HOT rows, the others by a shuffle."""
    few = some.join(F.broadcast(hot), LINE, "left_semi").limit(HOT)
    cold = rows.join(F.broadcast(hot), LINE, "left_anti").join(some.join(F.broadcast(hot), LINE, "left_anti"), LINE)
    return rows.join(F.broadcast(few), LINE).unionByName(cold)


def boilerplate(lines: DataFrame, min_sites: int, margin: float = MARGIN, lg_k: int = LG_K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of the lines that are frequent enough, the boilerplate lines with their first occurrence, and the hot lines."""
    frequent = tk.stored(lines.groupBy(*LINE).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites), "frequent")
    hot = tk.stored(frequent.orderBy(F.desc("n"), *LINE).limit(HOT).select(*LINE), "hot")
    seen = tk.stored(with_lines(lines, frequent.select(*LINE), hot), "lines")
    spread = seen.groupBy(*LINE).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th", "place"))).alias("first"),
    )
    spread = tk.stored(spread, "spread")
    near = F.col("sites").between(min_sites * (1 - margin), min_sites * (1 + margin))
    # a line has as many rows here as it has sites
    exact = seen.select(*LINE, "site").distinct().join(spread.where(near).select(*LINE, "first"), LINE).groupBy(*LINE).agg(F.count("*").alias("sites"), F.first("first").alias("first"))
    sure = spread.where(~near).select(*LINE, "sites", "first")
    return seen, sure.unionByName(exact).where(F.col("sites") >= min_sites), hot


def line_dedup(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    keep_first: bool = True,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``row`` (all columns), kept (the text without boilerplate lines), n_lines, n_removed (lines)."""
    seen, found, hot = boilerplate(site_lines(docs, id_col, site_col, text_col), min_sites)
    gone = with_lines(seen.where("id IS NOT NULL"), tk.stored(found, "boilerplate"), hot)
    if keep_first:
        gone = gone.where(F.struct("id", "th", "place") != F.col("first"))
    gone = gone.groupBy("id", "th").agg(F.collect_set("place").alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th")).join(gone, ["id", "th"], "left")
    lines = F.split(F.col("row")[text_col], "\n")
    kept = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.concat_ws("\n", F.filter(lines, lambda _, i: ~F.array_contains("gone", i))))
    return rows.select("row", kept.alias("kept"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(tk.table_of(spark, sf_dir, "documents"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS place, parts[i] AS raw, trim(parts[i], ' ') AS line
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), found AS (
  SELECT line, min((doc_id, place)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 5
), marked AS (
  SELECT l.doc_id, l.place, l.raw, f.line IS NOT NULL AND (l.doc_id, l.place) <> f.first AS gone FROM lines l LEFT JOIN found f USING (line)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
