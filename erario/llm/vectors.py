"""Exact inner-product top-k by norm-bucketed retrieval.

Vectors are sorted into buckets of similar length. For a query, a bucket's
longest vector turns the k-th best product so far into a local cosine
threshold: above 1 the bucket and all shorter ones are skipped; a threshold
near 1 leaves few directions, so coordinates prune (a candidate's component on
the query's largest coordinates must lie in the feasible range); else lengths
prune (the sorted bucket is cut where the length alone is too small). What is
left is verified by its products. The same bound prunes before the join: a block
of queries meets only cells whose longest vector can still reach it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

QUERY_BLOCK = 512
BUCKET_ROWS = 1024
CELL_BUCKETS = 16
#: From this local cosine threshold on, coordinates prune before lengths do.
COORDINATES_FROM = 0.9
FOCUS = 3
#: Lengths are told apart before the join in steps of this ratio. Lengths of
#: integer vectors are 0 or at least 1, so there are at most about 5,000 steps.
STEP = 1.01
#: A frame: vectors of one range partition, as bytes of 64-bit numbers.
FRAME = "part int, ids binary, width int, v binary, bounds binary, low double, high double"


def quantised(vectors: DataFrame, vec: str, factor: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, floor(factor * x) of each component as BIGINT.
    Vectors that are NULL or hold NULL or non-finite components are dropped."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) != float("inf")))
    return (vectors.where(F.col(vec).isNotNull() & F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull())
            .select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * factor)).alias("v")))


def _level(length: float) -> int:
    """The step of a length; -1 below 1."""
    return math.floor(math.log(length) / math.log(STEP)) if length >= 1 else -1


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class _Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, m: np.ndarray) -> None:
        length = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        self.ids, self.m, self.length = ids[order], m[order], length[order]
        self.floats, self.largest = self.m.astype(np.float64), float(np.abs(m).max(initial=0))
        self.unit = self.m / np.maximum(self.length, 1e-300)[:, None]

    def products(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Exact integer products. Floats are exact while no partial sum can pass 2^53."""
        d = min(len(q), self.m.shape[1])
        if float(np.abs(q).max(initial=0)) * self.largest * d < 2.0**53:
            return (self.floats[rows, :d] @ q[:d].astype(np.float64)).astype(np.int64)
        return self.m[rows, :d] @ q[:d]

    def candidates(self, q: np.ndarray, q_length: float, bound: float) -> np.ndarray | slice | None:
        """Rows whose product with ``q`` may reach ``bound``; None: no row can.
        The slack of 1e-9 keeps rounding on the safe side."""
        top = q_length * self.length[0]
        if bound <= 0 or top == 0:
            return slice(None) if bound <= 0 else None
        cosine = bound / top * (1 - 1e-9)
        if cosine > 1:
            return None
        if cosine < COORDINATES_FROM:  # by length: the bucket is sorted
            return slice(0, int(np.searchsorted(-self.length, -(bound / q_length) * (1 - 1e-9), "right")))
        unit = q / q_length
        keep = np.ones(len(self.ids), bool)
        wide = np.arccos(min(1.0, cosine))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            if f < self.unit.shape[1]:  # angles to the axis differ by at most the angle between the two
                axis = np.arccos(np.clip(unit[f], -1, 1))
                low, high = np.cos(min(np.pi, axis + wide)), np.cos(max(0.0, axis - wide))
                keep &= (self.unit[:, f] >= low - 1e-9) & (self.unit[:, f] <= high + 1e-9)
        return np.flatnonzero(keep)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _search(q_ids, qm, bounds, buckets: list[_Bucket], k: int) -> list[tuple]:
    """The ``k`` best of all buckets for each query, by falling score and then id."""
    out = []
    lengths = np.sqrt((qm.astype(np.float64) ** 2).sum(axis=1))
    for q_id, q, q_length, bound in zip(q_ids, qm, lengths, bounds):
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in buckets:
            limit = max(bound, float(scores[-1])) if len(scores) == k else bound
            rows = slice(None) if not np.isfinite(limit) else b.candidates(q, q_length, limit)
            if rows is None:
                continue
            found = b.ids[rows]
            value = b.products(q, rows)
            other = (found != q_id) & (value >= limit)
            ids, scores = _best(np.r_[ids, found[other]], np.r_[scores, value[other]], k)
        out += [(q_id, v, s) for v, s in zip(ids.tolist(), scores.tolist())]
    return out


def _frames(size: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pack rows ``vec_id, v, bound, place`` in frames of at most ``size`` rows
    that keep the smallest and the greatest ``place``."""
    def frame(part: int, rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows["v"])
        return pd.DataFrame({
            "part": [part], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "width": [m.shape[1]], "v": [m.tobytes()],
            "bounds": [rows["bound"].to_numpy(np.float64).tobytes()], "low": [rows["place"].min()], "high": [rows["place"].max()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            while len(held) >= size:
                yield frame(part, held[:size])
                held = held[size:]
        if held is not None and len(held):
            yield frame(part, held)

    return pack


def _unpacked(ids: bytes, width: int, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(v, np.int64).reshape(len(numbers), width)


def _pairs(blocks: DataFrame, ends: list[int], first: int) -> DataFrame:
    """Each block of queries once for every cell after the first that may hold a
    vector long enough for one of its queries. ``ends[s + 1]`` is the last cell
    with a length of step s or more; cells are of falling length."""
    step = F.when(F.col("low") >= 1, F.floor(F.log("low") / math.log(STEP)) - 1).otherwise(-1)  # a step for rounding
    last = F.get(F.lit(ends), F.greatest(step, F.lit(-1)).cast("int") + 1)  # no cell that long: NULL
    return blocks.withColumn("last", last).where(F.col("last") > first).withColumn(
        "cell", F.explode(F.sequence(F.lit(first + 1), "last"))).drop("last")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK,
          bucket_rows: int = BUCKET_ROWS, cell_buckets: int = CELL_BUCKETS) -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: each query's ``k`` best
    candidates (all, if fewer) by inner product, ties to the smaller id.

    Both inputs have ``vec_id`` (BIGINT) and ``v`` (array of BIGINT); missing
    components count as 0 and rows with the query's own id are no candidates.
    Repeated candidate rows count each, repeated query ids are searched once.
    Queries go in blocks against cells of norm buckets. The first cell, of the
    longest vectors, gives each query a bound; bound over length is the length a
    better vector must have, blocks are formed by it, and a block is joined only
    with the cells that hold such lengths. An empty side gives no rows.
    """
    spark = candidates.sparkSession
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    none = F.lit(float("-inf"))
    sized = saved(candidates.select("vec_id", "v", none.alias("bound"), norm.alias("place")), "topk-vectors")
    room = bucket_rows * cell_buckets
    # cells of falling length; equal lengths (one hot norm) are dealt on by id
    dealt = sized.repartitionByRange(max(1, -(-sized.count() // room)), F.desc("place"), "vec_id")
    cells = saved(dealt.mapInPandas(_frames(room), FRAME).withColumnRenamed("part", "cell"), "topk-cells")
    # the last cell of each step of lengths: a bounded number of rows
    step = F.when(F.col("high") >= 1, F.floor(F.log("high") / math.log(STEP))).otherwise(-1)
    seen = {r["step"]: (r["first"], r["last"]) for r in cells.groupBy(step.alias("step")).agg(
        F.min("cell").alias("first"), F.max("cell").alias("last")).collect()}
    if not seen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    first, last = min(a for a, _ in seen.values()), max(b for _, b in seen.values())
    ends = [max((b for s, (_, b) in seen.items() if s >= low), default=first) for low in range(-1, max(seen) + 1)]
    asked = saved(queries.select("vec_id", "v").dropDuplicates(["vec_id"]), "topk-queries")
    n_blocks = max(1, -(-asked.count() // query_block))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, buckets = None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if held != r.cell_ids:  # the rows of a cell follow each other
                    ids, m = _unpacked(r.cell_ids, r.cell_width, r.cell_v)
                    order = np.argsort(-(m.astype(np.float64) ** 2).sum(axis=1), kind="stable")
                    buckets = [_Bucket(ids[o], m[o]) for i in range(0, len(ids), bucket_rows)
                               for o in [order[i:i + bucket_rows]]]
                    held = r.cell_ids
                q_ids, qm = _unpacked(r.ids, r.width, r.v)
                rows = _search(q_ids, qm, np.frombuffer(r.bounds, np.float64), buckets, k)
                yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    found = "query_id long, vec_id long, score long"
    sides = ["ids", "width", "v", "bounds", "cell_ids", "cell_width", "cell_v"]
    held_cells = cells.select("cell", *[F.col(c).alias(f"cell_{c}") for c in ("ids", "width", "v")])
    opening_blocks = (asked.select("vec_id", "v", none.alias("bound"), none.alias("place"))
                      .repartition(n_blocks, "vec_id").mapInPandas(_frames(query_block), FRAME))
    longest = held_cells.where(F.col("cell") == first).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    opening = saved(opening_blocks.join(longest, "part").select(*sides).mapInPandas(search, found), "topk-opening")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = opening
    if last > first:
        kth = (opening.withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k)
               .select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bound")))
        # a better product than the bound needs this length; no bound above 0: any
        reach = F.when((F.col("bound") > 0) & (norm > 0), F.col("bound") / norm).otherwise(none)
        blocks = saved(asked.join(kth, "vec_id", "left").select(
            "vec_id", "v", F.coalesce("bound", none).alias("bound"), reach.alias("place"))
            .repartitionByRange(n_blocks, "place", "vec_id").mapInPandas(_frames(query_block), FRAME), "topk-blocks")
        # few cells: several tasks share a cell's blocks
        salts = min(n_blocks, -(-spark.sparkContext.defaultParallelism // (last - first)))
        tasks = min((last - first) * salts, 10_000)
        todo = _pairs(blocks, ends, first).withColumn("salt", F.pmod("part", F.lit(salts))).repartition(tasks, "cell", "salt")
        salted = (held_cells.where(F.col("cell") > first).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
                  .repartition(tasks, "cell", "salt"))
        every = opening.unionByName(todo.join(salted, ["cell", "salt"]).select(*sides).mapInPandas(search, found))
    return (every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
