"""Whitening of embeddings by a covariance over distinct vectors.

Equal vectors are grouped; a group's size is its weight in the fit. Sums and the
products of centred vectors are made per task by one matrix product a batch and
added up by (row, column), so the driver holds a d x d matrix and nothing that
grows with the rows. Each distinct vector is whitened once and joined back to
its rows: the few vectors with many rows by broadcast, the others by a merge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, from_row, saved

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on would not fit a long after scaling.
GREATEST = 2.0 ** 56
#: A vector with over 1 / HOT of the rows is joined by broadcast: fewer than HOT vectors.
HOT = 1000


def _fits(entry: Column) -> Column:
    """Neither NULL nor NaN (which is greater than any number) nor too great."""
    return F.coalesce(F.abs(entry.cast("double")) < GREATEST, F.lit(False))


def _exact(column: Column) -> Column:
    """A vector as longs floor(64 * c) + 1000000; NULL for entries that do not fit."""
    return F.transform(column, lambda c: F.when(_fits(c), F.floor(SCALE * c.cast("double")) + F.lit(SHIFT)))


def _usable(column: Column) -> Column:
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, _fits)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a list column without NULLs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _sums(groups: DataFrame, column: str, d: int) -> list[int]:
    """Exact weighted sums of the entries of a column of long vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x, w = _matrix(batch.column(0), np.int64), batch.column(1).to_numpy()
            if len(w):
                if float(np.abs(x).max()) * float(w.sum()) >= 2.0 ** 62:
                    x, w = x.astype(object), w.astype(object)
                total = [a + int(b) for a, b in zip(total, w @ x)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()),
                                          pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    parts = groups.select(column, "weight").mapInArrow(partial, "i int, s decimal(38,0)")
    return [int(r.s) for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]


def _means(groups: DataFrame, column: str, k: int, n: int) -> np.ndarray:
    """Weighted means of the entries of a column of double vectors."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                total += batch.column(1).to_numpy() @ _matrix(batch.column(0), float)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "s"])

    parts = groups.select(column, "weight").mapInArrow(partial, "i int, s double")
    return np.array([r.s for r in parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]) / n


def _covariance(groups: DataFrame, column: str, k: int, n: int,
                centred: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Weighted covariance (divisor n) of vectors that ``centred`` has centred."""
    rows, cols = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                c = centred(batch.column(0))
                total += (c * batch.column(1).to_numpy()[:, None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()),
                                          pa.array(total[rows, cols])], names=["i", "j", "v"])

    parts = groups.select(column, "weight").mapInArrow(partial, "i int, j int, v double")
    out = np.zeros((k, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v / n
    return out


def _principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit eigenvectors (columns,
    greatest entry positive). Those that are zero but for rounding go."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > max(values[0], 0.0) * len(covariance) * 2.0 ** -49
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


RESULTS = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, column: str, components: int = COMPONENTS) -> DataFrame:
    """The rows whose vector takes part, with ``n`` (vectors of the fit),
    ``deviation`` (sum of (n * x - S)^2, exact; NULL where it exceeds a long),
    ``whitened`` and ``explained`` (arrays by falling eigenvalue) and
    ``identity_error`` (of the whitened columns' covariance).

    x is floor(64 * c) + 1000000 of each entry c. Vectors that are NULL, empty,
    or hold a NULL, non-finite or (from 2^56 on) too great entry take no part,
    nor do vectors of another size than the commonest one (ties: the greater).
    Repeated rows count each and are returned each. Components without variance
    are left out, so a single distinct vector has none (empty arrays). Columns
    named like the results are replaced; others stay; without any vector the
    result is empty. The driver holds the d x d covariance.
    """
    names = [c.split()[0] for c in RESULTS.split(", ")]
    rest = [c for c in rows.columns if c.lower() not in names]
    base = rows.where(_usable(F.col(column))).select(
        as_row(rest), _exact(F.col(column)).alias("x"))
    size = (base.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c"))
            .orderBy(F.desc("c"), F.desc("d")).first())
    if size is None:
        return base.select(*from_row(rest), *[F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in RESULTS.split(", ")])
    d, n = size
    base = base.where(F.size("x") == d)
    groups = saved(base.groupBy("x").agg(F.count("*").alias("weight")), "whitening-groups")

    sums = _sums(groups, "x", d)
    # S / n as a whole number and a rest: x less the first is exact, so centring loses nothing
    whole = [(2 * s + n) // (2 * n) for s in sums]
    near, rest_of = np.array(whole, np.int64), np.array([s - n * m for s, m in zip(sums, whole)], np.int64)
    centred = lambda x: (_matrix(x, np.int64) - near) - rest_of / n
    covariance = _covariance(groups, "x", d, n, centred)
    values, vectors = _principal(covariance, components)
    k, turn = len(values), vectors / np.sqrt(values)

    def deviations(x: np.ndarray) -> list[int | None]:
        """n * x - S is n * (x - whole) - rest, in longs where they suffice."""
        off = x - near
        if (float(np.abs(off).max(initial=0)) + 1) * n >= 2.0 ** 62 or d * ((float(np.abs(off).max(initial=0)) + 1) * n) ** 2 >= 2.0 ** 62:
            off, tail, total = off.astype(object), rest_of.astype(object), n
        else:
            tail, total = rest_of, n
        return [int(v) if int(v) < 2 ** 63 else None for v in ((off * total - tail) ** 2).sum(axis=1)]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = centred(batch.column(0)) @ turn
            ends = pa.array(np.arange(0, y.size + 1, k) if k else np.zeros(len(y) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(deviations(_matrix(batch.column(0), np.int64)), pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["x", "weight", "deviation", "whitened"])

    done = saved(groups.mapInArrow(turned, "x array<long>, weight long, deviation long, whitened array<double>"),
                 "whitening-done")
    error = 0.0
    if k:
        means = _means(done, "whitened", k, n)
        again = _covariance(done, "whitened", k, n, lambda y: _matrix(y, float) - means)
        error = float(np.abs(again - np.eye(k)).max())
    explained = (values / np.trace(covariance)).tolist()

    often = F.broadcast(done.where(F.col("weight") * HOT > n))
    seldom = done.where(F.col("weight") * HOT <= n).hint("merge")
    joined = base.join(often, "x").unionByName(base.join(often.select("x"), "x", "left_anti").join(seldom, "x"))
    return joined.select(*from_row(rest), F.lit(n).cast("long").alias("n"), "deviation",
                         "whitened", F.array(*[F.lit(v) for v in explained]).cast("array<double>").alias("explained"),
                         F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame, *keys: str) -> DataFrame:
    """One row for each row and component (numbered from 1) of a result of ``whiten``."""
    one = whitened.select(*keys, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "value"))
    return one.select(*keys, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("value").alias("whitened"),
                      F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")
