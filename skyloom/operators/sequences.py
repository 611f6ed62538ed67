"""Runs, merged intervals and spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import by_rows, carried, in_order, join_channels, key_hash, numbered_groups, stored


#: Positions that are smoothed in one call.
SEGMENT = 65_536


def ewma(df: DataFrame, span: int, keys: list[str] = MC, order: str = "i", value: str = "error", carry: tuple[str, ...] = ()) -> DataFrame:
    """Recursive exponentially weighted mean over whole-number positions `order`, alpha = 2 / (span + 1); a span of 1 or less changes nothing.

    A missing value takes the last mean; before the first value there is none. Segments of SEGMENT positions are smoothed from 0 each, so that a
    long key is spread over tasks, as a stream of frames that hold many short segments or a part of a long one; then what the segment before ends with is added, weighed down by the values since. Columns in `carry` are kept.
    """
    if span <= 1:
        return df.select(*keys, order, *carry, F.col(value).alias("ewma"))
    kinds, alpha = dict(df.dtypes), 2 / (span + 1)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def smooth(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All segments of a frame at once; the last one's state goes on into the next frame."""
        held, mean, valid, first, n = None, 0.0, 0, np.nan, 0
        for frame in frames:
            if frame.empty:
                continue
            named = pd.concat([held, frame[[*keys, "_segment"]]], ignore_index=True)
            same = ((named == named.shift()) | (named.isna() & named.shift().isna())).all(axis=1).to_numpy()
            opens = ~same[-len(frame) :]
            opens[0] |= held is None
            starts = np.union1d(0, np.flatnonzero(opens))
            at = np.searchsorted(starts, np.arange(len(frame)), side="right") - 1
            x = frame["_x"].to_numpy(dtype=float)
            goes_on = 0 if opens[0] else 1
            seeds = np.where(np.arange(len(starts)) < goes_on, mean, 0.0)
            local = pd.Series(np.insert(x, starts, seeds)).groupby(np.insert(at, starts, at[starts])).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
            local = np.delete(local, starts + np.arange(len(starts)))
            there = ~np.isnan(x)
            count = np.cumsum(there)
            base, rows, heads = (count - there)[starts], 1 - starts, np.full(len(starts), np.nan)
            base[:goes_on] -= valid
            rows[:goes_on] += n
            count = count - base[at]
            opened = there & (count == 1)
            heads[:goes_on] = first
            heads[at[opened]] = x[opened]
            rows = np.arange(len(frame)) + rows[at]
            firsts = np.where(count > 0, heads[at], np.nan)
            yield frame[[*keys, order, *carry, "_segment"]].assign(_n=rows, _valid=count, _local=local, _first=firsts)
            held, mean, valid, first, n = named.tail(1), local[-1], count[-1], firsts[-1], rows[-1]

    def hand_on(group: pd.DataFrame) -> pd.DataFrame:
        group, mean, before = group.sort_values("_segment"), np.nan, []
        for first, last, valid in zip(group["_first"], group["_last"], group["_valid"]):
            before.append(mean)
            mean = last + (1 - alpha) ** valid * (first if np.isnan(mean) else mean)
        return group[[*keys, "_segment"]].assign(_before=before)

    kept = "".join(f"`{c}` {kinds[c]}, " for c in carry)
    own = df.select(*keys, order, *carry, F.col(value).cast("double").alias("_x"), F.floor(F.col(order) / SEGMENT).alias("_segment"))
    dealt = own.repartition(*keys, "_segment").withColumn("_key", key_hash(keys)).sortWithinPartitions("_key", *keys, "_segment", order, F.col("_x").asc_nulls_last()).drop("_key")
    placed = stored(dealt.mapInPandas(smooth, f"{names}, `{order}` {kinds[order]}, {kept}_segment bigint, _n bigint, _valid bigint, _local double, _first double"))
    ends = placed.groupBy(*keys, "_segment").agg(F.max("_first").alias("_first"), F.max_by("_local", "_n").alias("_last"), F.max("_valid").alias("_valid"))
    ends = ends.withColumn("_of", F.count("*").over(Window.partitionBy(*keys))).where("_of > 1").drop("_of")  # others have nothing before them
    before = ends.groupBy(*keys).applyInPandas(hand_on, f"{names}, _segment bigint, _before double")  # a row for each segment
    both = join_channels(placed, F.broadcast(before), [*keys, "_segment"], "left")  # as few as positions / SEGMENT, twice at most
    started = ~F.isnan("_before") & F.col("_before").isNotNull()
    out = F.col("_local") + F.pow(F.lit(1 - alpha), F.col("_valid")) * F.when(started, F.col("_before")).otherwise(F.col("_first"))
    return both.select(*keys, order, *carry, F.when(started | (F.col("_valid") > 0), out).alias("ewma"))


def contiguous_runs(df: DataFrame, flag: str, keys: list[str] = MC, order: str = "i") -> DataFrame:
    """(keys, start, end, n) of each maximal run of consecutive positions where flag is true. Equal positions stand in one run. Runs are found
    inside fragments of a key and joined where one ends on a border."""
    placed = in_order(df.where(F.col(flag)).select(*keys, order), keys, [order])
    inside = Window.partitionBy(*keys, "_part").orderBy("_at")
    rows = carried(placed, keys, {"_end": F.max(order)}, before={"_last": ("max", "_end")})
    rows = rows.withColumn("_prev", F.coalesce(F.lag(order).over(inside), F.col("_last")))
    runs = numbered_groups(rows, keys, F.col("_prev").isNull() | (F.col(order) - F.col("_prev") > 1))
    return runs.groupBy(*keys, "_g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_g")


#: Intervals of a key that one task merges.
WHOLE = 100_000


def merge_intervals(df: DataFrame, gap: int = 16, keys: list[str] = MC) -> DataFrame:
    """(keys, start, end), joined where a start is at most gap after the greatest end so far. Keys of WHOLE intervals at most are merged in one
    exchange; for longer ones that end is a running maximum in fragments of a key, carried from one to the next."""
    short, long = by_rows(df.select(*keys, "start", "end"), keys, WHOLE)
    whole = _merged(short, gap, keys)
    return whole if long is None else whole.unionByName(_merged_in_fragments(long, gap, keys))


def _opens(upto: Column, gap: int) -> Column:
    return upto.isNull() | (F.col("start") > upto + gap)


def _merged(df: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    rows = df.repartition(*keys).withColumn("_key", key_hash(keys))
    upto_here = Window.partitionBy("_key", *keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.max("end").over(upto_here.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_g", F.count(F.when(_opens(F.col("_upto"), gap), True)).over(upto_here))
    return rows.groupBy("_key", *keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_key", "_g")


def _merged_in_fragments(df: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    placed = in_order(df, keys, ["start", "end"])
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = carried(placed, keys, {"_end": F.max("end")}, before={"_reach": ("max", "_end")})
    reach = F.greatest(F.max("end").over(inside), F.col("_reach"))  # the one that isn't null
    merged = numbered_groups(rows.withColumn("_upto", reach), keys, _opens(F.col("_upto"), gap))
    return merged.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def spans(df: DataFrame, starts: str, window: int = 32) -> DataFrame:
    """An array of window starts as rows (…, start, end = start + window)."""
    return df.select(*[c for c in df.columns if c != starts], F.explode(starts).alias("start")).withColumn("end", F.col("start") + window)
