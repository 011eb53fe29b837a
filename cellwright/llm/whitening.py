"""Whitening of embeddings: Spark MLlib's computeSVD on centred rows.

1. Numbers become whole ones, ``floor(scale * c) + shift``. Distinct vectors are the fit list; it gives the count n and the
   exact sums S of every dimension, as decimals.
2. A row's deviation, the sum over dimensions of ``(n * x - S) ** 2``, is exact whole-number work; total variance is the sum of
   the fit list's deviations over ``n ** 3``, so it does not rest on the decomposition.
3. Rows centred as ``(n * x - S) / n`` are a RowMatrix; computeSVD gives right singular vectors and values s, and
   a component's variance is ``s * s / n``. The Gram matrix is summed in tasks; only dim x dim numbers reach the driver.
   Components whose singular value is under ``CLEAR`` of the largest drown in the rounding of that matrix. So a further
   pass decomposes what the rows hold beside the components found, until ``components`` are found or nothing above
   ``FAINT`` is left.
4. Whitened rows are centred rows on the components over the square root of the variance. Their covariance over the fit
   list is measured, and its largest difference from the identity returned.

Vectors of one length are a fit of their own; lengths are a bounded number of values (l of them hold l * l / 2 numbers).

Defined results: rows whose vector is null or holds null or non-finite numbers take no part, nor do those with
a number that is no 64-bit whole number after scaling; repeated rows and null ids each give their rows; directions without
variance are no components, so a table whose vectors are all equal (or empty) gives no rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk

COMPONENTS, SCALE, SHIFT, CLEAR, FAINT = 16, 64, 1_000_000, 1e-4, 1e-11
ROWS = "id long, n long, deviation decimal(38,0), whitened array<double>"


def _offsets(batch, dim: int, n: int, total: list[int]) -> np.ndarray:
    """n * x - S of a batch, exactly: as long as it fits in 64 bits, else in Python's integers."""
    col = batch.column("x").combine_chunks() if isinstance(batch, pa.Table) else batch.column("x")
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
    most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, total))
    if most < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _squares(t: np.ndarray) -> list[Decimal]:
    if t.dtype == object or float(np.abs(t).max()) ** 2 * t.shape[1] >= 1 << 62:
        t = t.astype(object)
    return [Decimal(int(v)) for v in (t * t).sum(1)]


def _beside(centred: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Rows without what they have in the directions of ``basis``, taken away twice for the sake of rounding."""
    for _ in range(2):
        centred = centred - (centred @ basis) @ basis.T
    return centred


def _map_centred(dim: int, n: int, total: list[int], basis: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                t = _offsets(batch, dim, n, total)
                c = _beside((t / n).astype(np.float64), basis)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64())), pa.array(_squares(t), pa.decimal128(38, 0))], names=["v", "deviation"])

    return run


def _map_whitened(dim: int, n: int, total: list[int], basis: np.ndarray, variance: np.ndarray):
    def run(batches):
        for batch in batches:
            if len(batch):
                t = _offsets(batch, dim, n, total)
                w = (t / n).astype(np.float64) @ basis / np.sqrt(variance)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.full(len(t), n)), pa.array(_squares(t), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "n", "deviation", "whitened"]
                )

    return run


def _row_matrix(rows: DataFrame, column: str) -> RowMatrix:
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def _components(fit: DataFrame, dim: int, n: int, total: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (as columns) and their variances, by falling variance."""
    basis, variance, top = np.zeros((dim, 0)), np.zeros(0), 0.0
    while basis.shape[1] < min(most, dim):
        rows = fit.mapInArrow(_map_centred(dim, n, total, basis), "v array<double>, deviation decimal(38,0)")
        if not rows.agg(F.max(F.exists("v", lambda v: v != 0))).first()[0]:
            break
        # all of them: then the whole Gram matrix is decomposed at once, to double precision
        found = _row_matrix(rows, "v").computeSVD(dim, computeU=False, rCond=1e-15)
        s, v = found.s.toArray(), found.V.toArray()
        top = max(top, s[0])
        clear = (s >= CLEAR * s[0]) & (s >= FAINT * top)
        if not clear.any():
            break
        take = v[:, clear]
        take = take - basis @ (basis.T @ take)
        basis = np.concatenate([basis, take / np.linalg.norm(take, axis=0)], 1)
        variance = np.concatenate([variance, s[clear] ** 2 / n])
    order = np.argsort(-variance, kind="stable")[:most]
    return basis[:, order], variance[order]


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n, deviation (decimal), whitened (array), explained (array), identity_error: a row for every row that takes part."""
    spark = vectors.sparkSession
    vec = F.col("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where((F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float(1 << 62))))
    rows = tk.stored(rows.select("id", F.transform(vec, lambda v: F.floor(v * scale) + F.lit(shift)).alias("x")), "whole")
    fit = tk.stored(rows.select("x").distinct(), "fit")
    sums = fit.select(F.size("x").alias("dim"), F.posexplode("x").alias("at", "v")).groupBy("dim", "at").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    out = []
    for dim, per in sums.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("at", "n", "s"))).alias("per")).orderBy("dim").collect():  # a number a dimension
        n, total = per[0].n, [int(p.s) for p in per]
        own, mine = fit.where(F.size("x") == dim), rows.where(F.size("x") == dim)
        basis, variance = _components(own, dim, n, total, components)
        if not len(variance):
            continue
        none = np.zeros((dim, 0))
        deviations = own.mapInArrow(_map_centred(dim, n, total, none), "v array<double>, deviation decimal(38,0)").agg(F.sum("deviation")).first()[0]
        trace = float(deviations) / n**3
        white = _map_whitened(dim, n, total, basis, variance)
        cov = _row_matrix(own.select(F.lit(None).cast("long").alias("id"), "x").mapInArrow(white, ROWS), "whitened").computeCovariance().toArray() * ((n - 1) / n)
        error = float(np.abs(cov - np.eye(len(variance))).max())
        explained = F.array(*[F.lit(float(e / trace)) for e in variance])
        out.append(mine.mapInArrow(white, ROWS).withColumns({"explained": explained, "identity_error": F.lit(error)}))
    if not out:
        return spark.createDataFrame([], ROWS + ", explained array<double>, identity_error double")
    return reduce(DataFrame.unionByName, out)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened(tk.table_of(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e")
    rows = rows.select(F.col("id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")
