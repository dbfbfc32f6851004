"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erario.session import checkpoint_dir, scratch_dir

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words of a text as BIGINT; NULL counts as 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables that ``saved`` writes inside, on leaving without an
    error; those passed to the function it yields stay."""
    written: list[str] = []
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(len(written) - 1)
        return df

    _SCRATCH.append(written)
    try:
        yield keep
    finally:
        _SCRATCH.pop()
    for i, path in enumerate(written):
        if i not in kept:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder of ``spark.checkpoint.dir`` and read
    it back: cuts the lineage, survives lost executors and gives the planner
    the true size of the table."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of ids of up to this many bytes are broadcast (a driver holds them for a while).
BROADCAST_BYTES = 64 << 20
#: What a row of a few ids, and an element of an array of ids, take at most.
ROW_BYTES, ELEMENT_BYTES = 64, 40


def small_side(df: DataFrame, elements: str | None = None) -> DataFrame:
    """A table of ids for a join: broadcast if its rows, and the elements of its
    array column ``elements``, take at most ``BROADCAST_BYTES``; else the join
    shuffles both sides."""
    size = F.lit(ROW_BYTES) if elements is None else ROW_BYTES + ELEMENT_BYTES * F.size(elements)
    n = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df.hint("merge")


def running_total(df: DataFrame, group: str, bucket: str, order: list[Column], value: str,
                  out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` that come
    before this one in the order of (``bucket``, ``order``).

    Rows are summed per (group, bucket), the bucket totals are summed per
    group, and only rows of one bucket share a task: a group that holds a third
    of all rows is split over its buckets. ``bucket`` must be non-null and
    agree with the order; ``group`` must be non-null.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = (df.groupBy(group, bucket).agg(F.sum(value).alias("_total"))
            .withColumn("_base", F.coalesce(F.sum("_total").over(
                before(Window.partitionBy(group).orderBy(bucket))), F.lit(0)))
            .drop("_total"))
    inside = F.sum(value).over(before(Window.partitionBy(group, bucket).orderBy(*order)))
    return (df.withColumn("_inside", F.coalesce(inside, F.lit(0)))
            .join(base.hint("merge"), [group, bucket])  # grows with the input: never broadcast
            .withColumn(out, F.col("_base") + F.col("_inside"))
            .drop("_base", "_inside"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_row(columns: list[str]) -> Column:
    """The named columns as one struct ``row`` whose fields are named by position,
    so that nothing an operator adds can clash with them."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.lit(0).alias("end")).alias("row")


def from_row(columns: list[str]) -> list[Column]:
    """The columns that ``as_row`` packed."""
    return [F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)]


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives its freed memory back to the system when
    it ends: Python workers live on and stand beside the heap of every later stage."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def add_columns(df: DataFrame, inputs: list[Column], added: str, task: Callable[[], Callable]) -> DataFrame:
    """``df`` with the columns ``added`` (DDL), which a function of Arrow batches
    computes from ``inputs`` alone.

    ``task()`` is called once a task and returns the function: it takes a record
    batch of the inputs and returns the arrays of the added columns. The rows
    themselves travel as one struct, so their names cannot clash with anything;
    columns named like an added one are replaced.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(added)
    rest = [c for c in df.columns if c.lower() not in {n.lower() for n in new.names}]
    source = df.select(as_row(rest), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([source.schema["row"], *new.fields])
    given, names = [f"in{i}" for i in range(len(inputs))], ["row", *new.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = task()
        for batch in batches:
            args = pa.RecordBatch.from_arrays([batch.column(name) for name in given], names=given)
            yield pa.RecordBatch.from_arrays([batch.column(0), *add(args)], names=names)

    return source.mapInArrow(frugal(run), schema).select(*from_row(rest), *new.names)
