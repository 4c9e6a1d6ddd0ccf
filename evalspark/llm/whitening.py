"""Operator 13, embedding whitening by a distributed singular value decomposition.

Entries become whole numbers x = floor(256 * c), and the fit list is each distinct x vector once: its size n and its sums
S are exact. The rows of the fit list, centred by S / n, are a distributed row matrix, whose singular values s and right
singular vectors MLlib's computeSVD finds; by the divisor n the covariance has the eigenvalues s ** 2 / n and those same
eigenvectors. All components are asked for, not only the reported ones: MLlib then decomposes the Gram matrix, which
executors sum up, with LAPACK to double precision, where its iteration for a few of them would stop at 1e-10.

The total variance is not taken from the decomposition: it is the sum of the exact deviations, sum over dimensions of
(n * x - S) ** 2, of the fit list, over n ** 3. Deviations are sums of exact products of Python integers by row.

The driver holds a matrix of dimension by dimension; the fit list and all rows stay distributed.

Defined cases: a vector that is null or holds null or non-finite entries is dropped, as is one without entries; vectors of
different lengths are fitted and whitened apart, each length as a table of its own; rows that repeat an id or a vector
are whitened each; a null id passes through; a component of no variance has whitened null, and explained 0; where no
component has variance (one distinct vector, say), identity_error is null; fewer than four dimensions give as many
components; an empty table gives no rows; further columns are not read. An entry of 2 ** 31 / 256 or more in size is
an error: sums could not be kept exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.shared import discard, materialise

COMPONENTS = 4
SCALE = 256
#: Components whose share of the largest variance is below this have no variance.
NO_VARIANCE = 1e-12
_EXACT = pa.decimal128(38, 0)


@dataclass
class Fit:
    """What whitening needs of a fit list: its size, sums, eigenvalues (falling), eigenvectors (columns), total variance,
    and how far the covariance of what it whitens is from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float
    identity_error: float | None


def whole_numbers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    v = vectors[embedding].cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    stay = v.isNotNull() & (F.size(v) > 0) & ~bad

    def whole(c: Column) -> Column:
        x = F.floor(F.lit(float(SCALE)) * c)
        return F.when(F.abs(x) < 2**31, x.cast("int")).otherwise(F.raise_error(F.lit("an entry is too large to whiten exactly")).cast("int"))

    return vectors.filter(F.coalesce(stay, F.lit(False))).select(vectors[vec_id].cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The size of the fit list and its sum by dimension; a row per task and dimension is all that moves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            total += _matrix(batch.column("x"), dim).sum(axis=0)
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total), pa.array([n] * dim, pa.int64())], names=["dimension", "total", "n"])

    per = fit_list.mapInArrow(add, "dimension int, total long, n long").groupBy("dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    # a row per dimension
    rows = sorted(per.collect())
    return (rows[0].n if rows else 0), [r.total for r in rows]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - S) ** 2) of each row, exactly: n ** 2 * sum(x ** 2) - 2 * n * sum(x * S) + sum(S ** 2).

    S is cut in halves of 32 bits, so that sums of products stay within 64 bits.
    """
    s = np.array(sums, dtype=np.int64)
    half = s >> 32
    rest = s - (half << 32)
    squares = [int(a) * (1 << 32) + int(b) for a, b in zip((x * x >> 32).sum(axis=1), (x * x & 0xFFFFFFFF).sum(axis=1), strict=True)]
    high, low = [], []
    for part, out in ((half, high), (rest, low)):
        # products of up to 31 and 32 bits, halved once more
        product = x * part
        out += [int(a) * (1 << 32) + int(b) for a, b in zip((product >> 32).sum(axis=1), (product & 0xFFFFFFFF).sum(axis=1), strict=True)]
    own = sum(v * v for v in sums)
    return [n * n * q - 2 * n * ((a << 32) + b) + own for q, a, b in zip(squares, high, low, strict=True)]


def _project(rows: DataFrame, dim: int, fit: Fit, *names: str) -> DataFrame:
    """`names` of rows, deviation (exact decimal) and w: each component's whitened value."""
    values = fit.values[:COMPONENTS]
    some = values > NO_VARIANCE * max(fit.values[0], 0.0)
    n, sums = fit.n, [int(v) for v in fit.sums]
    # mean by mean division of integers, one rounding; the scale takes a component of no variance to null
    mean = np.array([s / n for s in sums])
    axes = fit.vectors[:, : len(values)] / np.sqrt(np.where(some, values, 1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            w = (x - mean) @ axes
            exact = pa.array([Decimal(d) for d in _deviations(x, n, sums)], _EXACT)
            flat = pa.array(w.ravel(), mask=np.tile(~some, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), exact, lists], names=[*names, "deviation", "w"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = "".join(f"{c} {kinds[c]}, " for c in names) + "deviation decimal(38,0), w array<double>"
    return rows.mapInArrow(project, ddl)


def fit_whitening(rows: DataFrame, dim: int) -> Fit | None:
    """The fit over the distinct x vectors of rows (vec_id, x), all of one length; None where there is none."""
    fit_list = materialise(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit_list, dim)
    if not n:
        discard(fit_list)
        return None
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with(F.col("x"), mean, lambda x, m: x.cast("double") - m)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(centred).alias("row")), "row"))
    found = matrix.computeSVD(dim, computeU=False)
    values, vectors = np.zeros(dim), np.zeros((dim, dim))
    if found.s.size:
        values[: found.s.size] = found.s.toArray() ** 2 / n
        vectors[:, : found.s.size] = found.V.toArray()
    fit = Fit(n, np.array(sums, dtype=object), values, vectors, 0.0, None)
    white = _project(fit_list, dim, fit)
    some = int((values[:COMPONENTS] > NO_VARIANCE * max(values[0], 0.0)).sum())
    pairs = [(i, j) for i in range(some) for j in range(i, some)]
    w = lambda k: F.get("w", F.lit(k))
    # covar_pop is centred, has the divisor n, and its partial results merge
    row = white.agg(F.sum("deviation").alias("total"), *[F.covar_pop(w(i), w(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    fit.total = float(int(row.total) / n**3)
    fit.identity_error = max((abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs), default=None)
    discard(fit_list)
    return fit


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector that stays and component;
    deviation is an exact decimal."""
    rows = whole_numbers(vectors, vec_id, embedding)
    # usually one length
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    done = [_whitened(rows.filter(F.size("x") == dim), dim) for dim in lengths]
    if not done:
        return rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return reduce(DataFrame.unionByName, done)


def _whitened(rows: DataFrame, dim: int) -> DataFrame:
    fit = fit_whitening(rows, dim)
    wide = _project(rows, dim, fit, "vec_id")
    shares = F.array(*[F.lit(float(v / fit.total) if fit.total else 0.0) for v in fit.values[:COMPONENTS]])
    tall = wide.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return tall.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"))
