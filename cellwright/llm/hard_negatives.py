"""Hard negatives by distributed radix selection over whole-number scores.

1. Vectors become whole numbers, ``floor(scale * x)``; equal rows (id, label and vector) are one. A score is the
   inner product with an anchor, a whole number.
2. Anchors lie in blocks of about ``ANCHORS``, rows in shards of about ``ROWS``; every block meets every shard of its length in a
   task of its own, which holds just these two. Scores are made there, by one matrix product, and never stored.
3. An anchor has one or more windows of scores. A round counts, in each shard, how many rows of a window fall in which bucket of
   the window's current range, best first and no further than the rows that are still wanted (later buckets of a shard
   can't hold the wanted rank). Counts are summed over shards, the bucket that holds the wanted rank becomes the window's
   range, and the next round refines it by ``DIGIT`` bits, until a bucket is one score.
4. Rows of that score or a better one are gathered, of each shard at most as many as are wanted, and ranked by score and id.

The same rounds first find an anchor's positives (a window of all scores, rows of its own label), then the negatives of each
anchor and positive (a window of scores around the positive's, rows of other labels). Ties, copies and hot labels
add no rows to any task. The anchors are a stated query set that meets all rows, in blocks.

Defined results: rows with a null id, label or vector, with a null or non-finite number, or whose squared length after scaling
is ``2 ** 62`` or more (scores could leave 64 bits) take no part; vectors meet vectors of their own length, empty ones
too (score 0); rows with one id and different labels or vectors are different rows; an anchor without positives, or a
positive without negatives in its window, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

ANCHORS, ROWS, DIGIT, CHUNK = 1024, 4096, 12, 64
POSITIVES, NEGATIVES, SCALE = 5, 10, 256
COUNTS = "anchor long, window long, bucket array<long>, n array<long>"
FOUND = "anchor long, window long, id long, h long, score long"


def _matrix(col: pa.ChunkedArray, n: int, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products: through floating point where every partial sum is exact there."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return a @ x.T


def _visit(same: bool, gather: bool, shift: int):
    """One block of anchors over one shard of rows: counts of buckets, or the rows gathered."""
    names = [c.split()[0] for c in (FOUND if gather else COUNTS).split(", ")]

    def per_anchor(scores, ids, hs, windows):
        for w in windows:
            inside = np.flatnonzero((scores >= w["low"]) & (scores <= w["high"]))
            if not len(inside):
                continue
            best = scores[inside]
            if len(inside) > w["need"]:
                last = np.partition(best, len(best) - w["need"])[len(best) - w["need"]]
                inside, best = inside[best >= last], best[best >= last]
            if gather:
                order = np.argsort(-best, kind="stable")[: w["need"]]  # rows come by id
                yield from ((w["window"], int(ids[i]), int(hs[i]), int(scores[i])) for i in inside[order])
            else:
                best = np.sort(best)[::-1][: w["need"]]
                bucket, n = np.unique((w["high"] - best) >> shift, return_counts=True)
                yield w["window"], bucket.tolist(), n.tolist()

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_by([("id", "ascending"), ("h", "ascending")])
            dim = rows.column("dim")[0].as_py()
            x, a = _matrix(rows.column("x"), len(rows), dim), _matrix(anchors.column("x"), len(anchors), dim)
            ids, hs, labels = (rows.column(c).to_numpy() for c in ("id", "h", "label"))
            own, own_h, own_label = (anchors.column(c).to_numpy() for c in ("id", "h", "label"))
            key = anchors.column("anchor").to_numpy()
            for i in range(0, len(a), CHUNK):
                block = _scores(a[i : i + CHUNK], x)
                windows = anchors.column("windows").slice(i, CHUNK).to_pylist()
                for j, mine in enumerate(windows, i):
                    take = np.flatnonzero((labels == own_label[j]) & ((ids != own[j]) | (hs != own_h[j])) if same else labels != own_label[j])
                    out += [(int(key[j]), *row) for row in per_anchor(block[j - i][take], ids[take], hs[take], mine)]
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        kinds = {"bucket": pa.list_(pa.int64()), "n": pa.list_(pa.int64())}
        return pa.table([pa.array(c, kinds.get(name, pa.int64())) for name, c in zip(names, columns, strict=True)], names=names)

    return run


def _met(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, gather: bool, shift: int = 0) -> DataFrame:
    """Every block of anchors, with its windows, over every shard of rows."""
    state = windows.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high", "need")).alias("windows"))  # few windows an anchor
    asking = anchors.join(state, "anchor").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    shards = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dim", "block", "shard", "id", "h", "label", "x")
    asking = asking.select("dim", "block", "shard", "anchor", "id", "h", "label", "x", "windows")
    by = ["dim", "block", "shard"]
    return asking.groupBy(*by).cogroup(shards.groupBy(*by)).applyInArrow(_visit(same, gather, shift), FOUND if gather else COUNTS)


def _selected(rows: DataFrame, anchors: DataFrame, windows: DataFrame, same: bool, bits: int) -> DataFrame:
    """anchor, window, id, h, score, rank: the first ``need`` rows of every window (anchor, window, low, high, need)."""
    windows = tk.stored(windows, "windows")
    now = windows
    for shift in range(DIGIT * (max(0, bits - 1) // DIGIT), -1, -DIGIT):
        counts = _met(rows, anchors, now, same, False, shift).select("anchor", "window", F.explode(F.arrays_zip("bucket", "n")).alias("c"))
        counts = counts.groupBy("anchor", "window", F.col("c.bucket").alias("bucket")).agg(F.sum("c.n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("anchor", "window").orderBy("bucket"))
        counts = counts.withColumn("upto", upto).join(now, ["anchor", "window"]).where("upto >= need AND upto - n < need")
        # the bucket's range: it holds the wanted rank; windows with fewer rows take all of them and need no round
        high = F.col("high") - F.shiftleft("bucket", shift)
        low = F.greatest("low", high - F.lit((1 << shift) - 1))
        now = tk.stored(counts.select("anchor", "window", low.alias("low"), high.alias("high"), (F.col("need") - F.col("upto") + F.col("n")).cast("long").alias("need")), "windows")
    floor = now.select("anchor", "window", F.col("low").alias("floor"))
    final = windows.join(floor, ["anchor", "window"], "left").withColumn("low", F.coalesce("floor", "low")).drop("floor")
    found = _met(rows, anchors, final, same, True)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "h"))
    return found.withColumn("rank", rank).join(windows.select("anchor", "window", "need"), ["anchor", "window"]).where("rank <= need").drop("need")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is between ``low_percent`` and ``high_percent`` of its positive's. ``is_anchor`` and ``label`` are Columns of ``vectors``.
    """
    vec = F.col("vec")
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    ).where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    length = F.aggregate(vec, F.lit(0.0), lambda s, v: s + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double"))
    rows = rows.withColumn("length", length).where(F.col("length") < float(1 << 62))
    rows = rows.select("id", "label", F.transform(vec, lambda v: F.floor(v * scale)).alias("x"), F.size(vec).alias("dim"), "asks", "length")
    rows = rows.groupBy("id", "label", "dim", "x").agg(F.max("asks").alias("asks"), F.max("length").alias("length")).withColumn("h", F.xxhash64("label", "x"))
    rows = tk.stored(rows, "whole")
    # a row a length of vectors: l lengths hold l * l / 2 numbers at least, so these are few
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.count_if("asks") / ANCHORS)).cast("int").alias("blocks"), F.max("length").alias("length"))
    sizes = tk.stored(sizes, "sizes")
    longest = sizes.agg(F.max("length")).first()[0]
    if longest is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = int(longest * 1.000001) + 1  # no score is beyond the largest squared length
    rows = rows.join(F.broadcast(sizes.drop("length")), "dim").withColumn("shard", F.pmod(F.xxhash64("id", "h"), F.col("shards")).cast("int"))
    anchors = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("h", "id"), F.col("blocks")).cast("int"))
    anchors = tk.stored(anchors.select(F.monotonically_increasing_id().alias("anchor"), "dim", "block", "shards", "id", "h", "label", "x"), "anchors")
    rows = rows.drop("asks", "length", "shards")
    every = anchors.select("anchor", F.lit(0).cast("long").alias("window"), F.lit(-most).alias("low"), F.lit(most).alias("high"), F.lit(positives).cast("long").alias("need"))
    found = _selected(rows, anchors, every, True, (2 * most).bit_length())
    found = tk.stored(found.select("anchor", F.col("rank").cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * s <= high * p, in whole numbers
    near = found.select(
        "anchor",
        "window",
        F.ceil(F.lit(low_percent).cast("decimal(10,0)") * F.col("positive_score") / 100).cast("long").alias("low"),
        F.floor(F.lit(high_percent).cast("decimal(10,0)") * F.col("positive_score") / 100).cast("long").alias("high"),
        F.lit(negatives).cast("long").alias("need"),
    ).where("low <= high")
    mined = _selected(rows, anchors, near, False, most.bit_length()).join(found, ["anchor", "window"])
    mined = mined.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(tk.table_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
