"""Shared-folder tables that cut lineage, exact ranks without a single-task window, and what a Python worker gives back."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Cells of one part of a summed array.
ARRAY_PART = 1 << 14


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it back, so that later jobs neither recompute nor re-shuffle it."""
    return stored(df)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, as whole texts may be long. Smaller settings of the user stay; others can't be put back
    here, as Spark reads them when a query runs."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def free_unused() -> None:
    """Give this process's memory that is free, but still held by Arrow or the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def freeing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow, with free_unused at the end of each task: Spark keeps a Python worker for the next jobs, where what it held before would add to what they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        free_unused()

    return run


def kept(df: DataFrame, new: Iterable[str]) -> list[str]:
    """The columns of df whose names differ from all of `new`, in any case of letters."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case of letters: `names`, with underscores before them where taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def summed_array(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of the integer array of `size` that count makes of a task's batches.

    Tasks give parts of ARRAY_PART cells, each part is summed on its own, and the whole (8 bytes a cell) comes to the driver.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = count(batches)
        for i in range(0, size, ARRAY_PART):
            if seen[i : i + ARRAY_PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([seen[i : i + ARRAY_PART].astype(np.int64).tobytes()], pa.binary())], names=["cell", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, np.int64)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["cell", "seen"])

    total = np.zeros(size, dtype=np.int64)
    for r in rows.mapInArrow(freeing(parts), "cell long, seen binary").repartition("cell").mapInArrow(add, "cell long, seen binary").collect():
        part = np.frombuffer(r["seen"], np.int64)
        total[r["cell"] : r["cell"] + len(part)] = part
    return total


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add `out`: 0, 1, 2 ... inside each `group`, in `order`, with one range exchange.

    A group of any size is spread over many range partitions: rows take their position inside their
    partition, and only one count for each (partition, group) pair is gathered to offset them. The sorted rows
    are written to the shared folder first, so a recomputed task can't see other partition borders.
    """
    spark = df.sparkSession
    n = partitions(spark)
    at, part, of, size, first, before = fresh(df, "_at", "_part", "_group", "_n", "_first", "_before")
    sorted_rows = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    placed = cut(sorted_rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)))
    runs = placed.groupBy(part, F.col(group).alias(of)).agg(F.count("*").alias(size), F.min(at).alias(first))
    # at most partitions + groups rows: one for each partition that a group touches
    w = Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum(size).over(w), F.lit(0)))
    joined = placed.join(runs.drop(size), (placed[part] == runs[part]) & placed[group].eqNullSafe(runs[of]))
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], (F.col(at) - F.col(first) + F.col(before)).alias(out))
