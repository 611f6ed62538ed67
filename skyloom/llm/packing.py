"""Packing: length buckets whose borders minimise padding over the global histogram, filled with token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, fresh, gapless_rank, kept


def best_borders(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least total padding to them.

    Dynamic programming over the distinct lengths: a bucket that ends at length L and holds n rows of s tokens pads
    n * L - s. For each border the best start is the lowest of a set of straight lines in L, found along their
    lower hull, so a layer costs as many steps as there are lengths.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.concatenate(([0], np.cumsum(counts))).tolist()
    sums = np.concatenate(([0], np.cumsum(lengths * counts))).tolist()
    ends = lengths.tolist()
    cost = [0] + [ends[j] * rows[j + 1] - sums[j + 1] for j in range(n)]  # one bucket
    choice: list[list[int]] = []
    for _ in range(min(buckets, n) - 1):
        hull: list[tuple[int, int, int]] = []  # slope, intercept, start
        new, came, lead = [0], [0], 0
        for j in range(1, n + 1):
            slope, intercept = -rows[j - 1], cost[j - 1] + sums[j - 1]
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope) >= (intercept - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append((slope, intercept, j - 1))
            lead = min(lead, len(hull) - 1)
            x = ends[j - 1]
            while lead + 1 < len(hull) and hull[lead + 1][0] * x + hull[lead + 1][1] <= hull[lead][0] * x + hull[lead][1]:
                lead += 1
            m, c, start = hull[lead]
            new.append(m * x + c + x * rows[j] - sums[j])
            came.append(start)
        cost = new
        choice.append(came)
    borders, j = [], n
    for came in reversed(choice):
        if j:
            borders.append(ends[j - 1])
            j = came[j]
    if j:
        borders.append(ends[j - 1])
    return sorted(set(borders))


def pack(docs: DataFrame, length: str = "n_tokens", key: str = "doc_id", buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """docs with bucket (its padded length), batch (gapless inside the bucket), place (inside the batch) and padding.

    Rows go to the bucket with the least border not below their length; a batch holds budget // border rows, one at
    least, so no batch exceeds the budget unless a single row does. A null length counts as 0. Rows inside a bucket follow
    length, then key; a null key stands first and equal rows are interchangeable. Any length is a histogram cell of its own:
    the distinct lengths reach the driver, at most the square root of twice all tokens. An empty table gives an empty one.
    Columns of the output's names, in any case of letters, are replaced.
    """
    names = kept(docs, ("bucket", "batch", "place", "padding"))
    held, bucket, rank = fresh(docs, "_length", "_bucket", "_rank")
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{length}`"), F.lit(0)).cast("long").alias(held)))
    histogram = rows.groupBy(held).agg(F.count("*")).toPandas().sort_values(held).to_numpy(dtype=np.int64)
    borders = best_borders(histogram[:, 0], histogram[:, 1], buckets)
    least = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in borders]), lambda b: b >= F.col(held))) if borders else F.lit(0).cast("long")
    ranked = gapless_rank(rows.withColumn(bucket, least), bucket, [held, key], rank)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col(bucket), F.lit(1))))
    return ranked.select(
        *[F.col(f"`{c}`") for c in names], F.col(bucket).alias("bucket"), F.floor(F.col(rank) / room).alias("batch"),
        (F.col(rank) % room).cast("int").alias("place"), (F.col(bucket) - F.col(held)).alias("padding"),
    )
