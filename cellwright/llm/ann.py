"""Approximate nearest neighbours by balanced posting lists.

1. Equal vectors are one entry with the least ``k + 1`` ids of its rows: no query needs more of them, as ties go to the
   smaller id. So a vector that a third of all rows share is one entry.
2. A bounded sample (``SAMPLE`` entries in hash order, at most ``SAMPLE_BYTES``) is halved along two-means directions
   into cells of one size; their means are the centroids, and a neighbour graph of them is searched in memory.
3. Every entry goes to its nearest list, and boundary entries to up to ``REPLICAS`` lists whose distance is within
   ``BOUNDARY`` of the nearest and that lie in another direction (no list taken before is nearer to it than the entry).
   Neighbouring lists are packed into shards of about ``PART_ROWS`` rows and longer ones cut, so no task holds a whole hot
   list and a query gets one partial result a shard.
4. A query visits all lists within a ratio of its nearest centroid's distance and at least ``LEAST_LISTS``; the ratio is
   ``1 + spread / sqrt(length)``, as distances draw together in longer vectors; the walk
   through the graph widens until the ratio ends the list, so nothing else cuts it off; and until the lists hold
   ``REPLICAS * (k + 1)`` rows, so ``k + 1`` different ones, where there are as many. Queries are dealt in blocks of about
   ``QUERIES``, so a task holds one shard and one block. In each part its distances are
   exact. Partial results merge by ranking. ``compared`` tells how many entries a query met, copies in several lists included.

Vectors meet vectors of their own length. Each length that holds ``SHARE`` of the rows has an index; others have one list,
in parts, searched whole. Only samples, centroids and one count a list reach the driver; all are bounded by parameters.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows with a
null id; rows with one id and one vector are one row; an id with several vectors asks with each, its results are ranked for
each, and its other rows are candidates; a table without candidates gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk
from cellwright.llm.centroid_graph import CentroidGraph, balanced_centroids

K, SAMPLE, SAMPLE_BYTES, LIST_ROWS, MAX_LISTS = 10, 1 << 17, 64 << 20, 64, 1 << 15
REPLICAS, BOUNDARY, SPREAD, LEAST_LISTS, PART_ROWS, SHARE = 4, 0.1, 1.5, 4, 4096, 1 / 16
QUERY_BLOCK, QUERIES = 256, 1 << 14


def _rows_of(batch, name: str) -> np.ndarray:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def _replicas(centroids: np.ndarray, ids: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which lists, nearest first, take a copy: those near enough that no list taken before is nearer to them than the entry is."""
    take = np.isfinite(d) & (d <= d[:, :1] * (1 + BOUNDARY))
    for j in range(1, d.shape[1]):
        for i in range(j):
            gap = np.sqrt(((centroids[ids[:, i]] - centroids[ids[:, j]]) ** 2).sum(1))
            take[:, j] &= ~take[:, i] | (gap > d[:, j])
    return take


def _map_lists(shared):
    """Each entry's own list and those its boundary reaches."""

    def run(batches):
        graph = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = _rows_of(batch, "vec")
            for i in range(0, len(x), 2048):
                ids, d = graph.search(x[i : i + 2048], 16)
                d = np.sqrt(d[:, :REPLICAS])
                row, col = np.nonzero(_replicas(graph.c, ids, d))
                part = batch.slice(i, 2048).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), part.column("lead"), part.column("h"), part.column("ids"), part.column("vec")], names=["list", "lead", "h", "ids", "vec"])

    return run


def _map_routes(shared, ratio: float, need: int):
    """Each query's lists, cut off by the ratio of distances, as a row per shard that holds any of them.

    However few the lists within the ratio hold, a query meets ``need`` rows of lists, or all.
    """

    def lists_of(graph, counts, x):
        """Lists within the ratio, and at least LEAST_LISTS: the walk widens for the queries whose lists it does not end yet."""
        out, live, beam = [None] * len(x), np.arange(len(x)), 64
        while len(live):
            ids, d = graph.search(x[live], beam)
            d = np.sqrt(d)
            held = np.where(np.isfinite(d), counts[np.where(np.isfinite(d), ids, 0)], 0)
            before = np.cumsum(held, 1) - held
            ended = ((d[:, -1] > d[:, 0] * ratio) & (before[:, -1] >= need)) | (beam >= len(graph.c))
            for i in np.flatnonzero(ended).tolist():
                keep = np.isfinite(d[i]) & ((d[i] <= d[i, 0] * ratio) | (np.arange(d.shape[1]) < LEAST_LISTS) | (before[i] < need))
                out[live[i]] = ids[i][keep]
            live, beam = live[~ended], beam * 2
        return out

    def run(batches):
        graph, counts, first, parts = shared.value
        for batch in batches:
            if not len(batch):
                continue
            rows, shards, wanted, met = [], [], [], []
            x = _rows_of(batch, "vec")
            for i in range(0, len(x), 1024):
                for q, lists in enumerate(lists_of(graph, counts, x[i : i + 1024]), i):
                    n = parts[lists]
                    shard = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lists], n)
                    of = np.repeat(lists, n)
                    order = np.argsort(shard, kind="stable")
                    shard, of = shard[order], of[order]
                    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
                    rows += [q] * len(cut)
                    shards += shard[cut].tolist()
                    wanted += np.split(of, cut[1:]) if len(cut) else []
                    met += [int(counts[lists].sum())] * len(cut)
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), part.column("lead"), part.column("h"), pa.array(met, pa.int64()), pa.array([w.tolist() for w in wanted], pa.list_(pa.int32())), part.column("vec")],
                names=["shard", "q_lead", "q_h", "met", "wanted", "vec"],
            )

    return run


def _search_shard(k: int):
    """Of one shard: the nearest k + 1 entries, by exact distances, in the lists that each query wants of it."""
    names = ["q_lead", "q_h", "met", "lead", "h", "ids", "score"]
    schema = pa.schema([("q_lead", pa.int64()), ("q_h", pa.int64()), ("met", pa.int64()), ("lead", pa.int64()), ("h", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out = [schema.empty_table()]
        if len(entries) and len(asked):
            # copies of one entry in several lists are one
            key = np.stack([entries.column(c).to_numpy() for c in ("lead", "h")], 1)
            _, first, of = np.unique(key, axis=0, return_index=True, return_inverse=True)
            lists, own = np.unique(entries.column("list").to_numpy(), return_inverse=True)
            member = np.zeros((len(first), len(lists)), np.float32)
            member[of.ravel(), own] = 1
            entries = entries.take(pa.array(first))
            x = _rows_of(entries, "vec")
            norm = (x**2).sum(1)
            for i in range(0, len(asked), QUERY_BLOCK):
                block = asked.slice(i, QUERY_BLOCK)
                q = _rows_of(block, "vec")
                wants = np.zeros((len(block), len(lists)), np.float32)
                for j, w in enumerate(block.column("wanted").to_pylist()):
                    wants[j, np.searchsorted(lists, np.intersect1d(w, lists))] = 1
                rough = np.where(wants @ member.T > 0, norm[None] + (q**2).sum(1)[:, None] - 2 * q @ x.T, np.inf)
                m = min(k + 1, len(x))
                last = np.partition(rough, m - 1, 1)[:, m - 1 : m]
                row, col = np.nonzero(np.isfinite(rough) & (rough <= last + 1e-9 * (1 + norm.max())))
                score = np.sqrt(((q[row] - x[col]) ** 2).sum(1))
                a, b = block.take(pa.array(row)), entries.take(pa.array(col))
                out.append(pa.table([a.column("q_lead"), a.column("q_h"), a.column("met"), b.column("lead"), b.column("h"), b.column("ids"), pa.array(score)], names=names).cast(schema))
        return pa.concat_tables(out)

    return run


def _sharded(listed: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries of lists (list, first, parts) with the shard each one is in; lists are a bounded number of rows."""
    shard = F.col("first") + F.pmod(F.xxhash64("lead", "h"), F.col("parts")).cast("int")
    return listed.join(lists, "list").select(shard.alias("shard"), "list", "lead", "h", "ids", "vec")


def _indexed(entries: DataFrame, dim: int, n: int, ratio: float, need: int) -> tuple[DataFrame, DataFrame]:
    """Entries of one length by shard, and the shards that each query visits.

    Neighbouring lists share a shard of about PART_ROWS entries, so that a query gets one partial result for all of them; a
    longer list is dealt over several shards.
    """
    spark = entries.sparkSession
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    drawn = entries.orderBy(F.xxhash64("h"), "lead").limit(most).select("vec").toArrow()
    sample = _rows_of(drawn, "vec")
    graph = CentroidGraph(balanced_centroids(sample, min(MAX_LISTS, -(-n // LIST_ROWS), max(1, len(sample) // 4))))
    shared = spark.sparkContext.broadcast(graph)
    listed = tk.stored(entries.mapInArrow(_map_lists(shared), "list int, lead long, h long, ids array<long>, vec array<double>"), "lists")
    counts = np.zeros(len(graph.c), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list, MAX_LISTS at most
        counts[r.list] = r.n
    parts, first, at, filled = np.maximum(1, -(-counts // PART_ROWS)), np.zeros(len(counts), np.int64), 0, 0
    for i in range(len(counts)):
        if filled and filled + counts[i] > PART_ROWS:
            at, filled = at + 1, 0
        first[i] = at
        if parts[i] > 1:
            at, filled = at + int(parts[i]), 0
        else:
            filled += int(counts[i])
    lists = spark.createDataFrame(list(zip(range(len(counts)), first.tolist(), parts.tolist(), strict=True)), "list int, first int, parts int")
    routes = spark.sparkContext.broadcast((graph, counts, first, parts))
    return _sharded(listed, lists), entries.where("asks").mapInArrow(_map_routes(routes, ratio, need), VISITS)


VISITS = "shard int, q_lead long, q_h long, met long, wanted array<int>, vec array<double>"


def _whole(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of rare lengths: a list a length, in shards of its own, and every one of them for each query."""
    listed = tk.stored(entries.withColumn("list", -F.size("vec")), "lists")
    sizes = listed.groupBy("list").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    # shards below zero, those of one length in a row
    lists = tk.stored(sizes.withColumn("first", (-F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("list"))).cast("int")), "sizes")
    asked = entries.where("asks").withColumn("list", -F.size("vec")).join(lists, "list").withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    visits = asked.select("shard", F.col("lead").alias("q_lead"), F.col("h").alias("q_h"), F.col("n").alias("met"), F.array("list").alias("wanted"), "vec")
    return _sharded(listed, lists.select("list", "first", "parts")), visits


def nearest(vectors: DataFrame, is_query: Column, k: int = K, spread: float = SPREAD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, compared: the nearest rows found for every row that ``is_query`` picks."""
    spark = vectors.sparkSession
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    good = F.col("id").isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0)
    rows = rows.where(good).withColumn("h", F.xxhash64("vec"))
    # one row an id and vector; of each vector the least k + 1 ids
    once = rows.groupBy("h", "vec", "id").agg(F.max("asks").alias("asks"))
    least = once.withColumn("nth", F.row_number().over(Window.partitionBy("h", "vec").orderBy("id"))).where(F.col("nth") <= k + 1)
    entries = least.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = once.where("asks")
    some = asked.select("h", "vec").distinct().withColumn("asks", F.lit(True))
    entries = entries.join(some, ["h", "vec"], "left").select(F.col("ids")[0].alias("lead"), "h", "ids", F.coalesce("asks", F.lit(False)).alias("asks"), "vec")
    entries = tk.stored(entries, "vectors")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, compared long")
    # at most 1 / SHARE lengths
    common = entries.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") >= SHARE * total).collect()
    found = []
    for r in common:
        found.append(_indexed(entries.where(F.size("vec") == r.dim), r.dim, r.n, 1 + spread / r.dim**0.5, REPLICAS * (k + 1)))
    if sum(r.n for r in common) < total:
        found.append(_whole(entries.where(~F.size("vec").isin([r.dim for r in common]))))
    schema = "q_lead long, q_h long, met long, lead long, h long, ids array<long>, score double"
    # a task holds a shard and one block of the queries that visit it
    blocks = max(1, -(-entries.where("asks").count() // QUERIES))
    block = F.pmod(F.xxhash64("q_lead", "q_h"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    met = [(dealt.select("*", every).groupBy("shard", "block"), visits.select("*", block).groupBy("shard", "block")) for dealt, visits in found]
    found = reduce(DataFrame.unionByName, [dealt.cogroup(visits).applyInArrow(_search_shard(k), schema) for dealt, visits in met])
    by_query = Window.partitionBy("q_lead", "q_h")
    found = found.withColumn("nth", F.dense_rank().over(by_query.orderBy("score", "lead", "h"))).where(F.col("nth") <= k + 1)
    found = found.groupBy("q_lead", "q_h", "lead", "h").agg(F.first("ids").alias("ids"), F.first("score").alias("score"), F.first("met").alias("compared"))
    found = found.select("q_lead", "q_h", "score", "compared", ((F.col("lead") == F.col("q_lead")) & (F.col("h") == F.col("q_h"))).alias("same"), F.explode("ids").alias("vec_id"))
    found = found.withColumn("nth", F.row_number().over(by_query.orderBy("score", "vec_id", "same"))).where(F.col("nth") <= k + 1)
    # the queries of a vector take its entry's results, without themselves
    leads = entries.where("asks").select(F.col("lead").alias("q_lead"), F.col("h").alias("q_h"), "h", "vec")
    who = asked.join(leads, ["h", "vec"]).select(F.col("id").alias("query_id"), "q_lead", "q_h")
    each = who.join(found, ["q_lead", "q_h"]).where("NOT (same AND vec_id = query_id)")
    rank = F.row_number().over(Window.partitionBy("query_id", "q_lead", "q_h").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def op2_balanced_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(tk.table_of(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
