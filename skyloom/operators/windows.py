"""Rolling windows and their shape."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import join_spread, key_hash
from .grid import array_mean, array_moments, channel_moments


#: Strides of a channel that stand together in a task.
CHUNK = 4096


def make_windows(grid: DataFrame, window: int = 32, stride: int = 16, keys: list[str] = MC, value: str = "value") -> DataFrame:
    """Complete windows at starts 0, stride, 2 stride ... of each channel: values, index and time bounds, any-anomaly flag and ratio.

    If stride divides window, points are gathered into blocks of one stride and a window is a block with the next ones; otherwise each point goes to
    every window that holds it. Blocks meet in chunks of a channel, by one exchange: the first blocks of a chunk also stand in the chunk before,
    where the last windows need them, so that a channel of any length is spread over tasks. Windows that miss a point are left out.
    """
    point = F.struct("idx", "ts", F.col(value).alias("value"), "is_anomaly")
    block = F.floor(F.col("idx") / stride)
    if window % stride == 0:
        more = window // stride - 1
        chunks = F.sequence(F.greatest(F.lit(0), F.floor((block - more) / CHUNK)), F.floor(block / CHUNK))
        dealt = grid.select(*keys, point.alias("_x"), block.alias("_b"), F.explode(chunks).alias("_c")).repartition(*keys, "_c")
        blocks = dealt.groupBy(*keys, "_c", "_b").agg(F.array_sort(F.collect_list("_x")).alias("_p"), F.count_if("_x.is_anomaly").alias("_h"))
        w = Window.partitionBy(*keys, "_c").orderBy("_b")
        none = F.array().cast(blocks.schema["_p"].dataType)
        points = F.concat(F.col("_p"), *[F.coalesce(F.lead("_p", i).over(w), none) for i in range(1, more + 1)])
        hits = sum((F.coalesce(F.lead("_h", i).over(w), F.lit(0)) for i in range(1, more + 1)), F.col("_h"))
        out = blocks.select(*keys, "_c", "_b", points.alias("_p"), hits.alias("_h")).where(F.floor(F.col("_b") / CHUNK) == F.col("_c"))
    else:
        first = F.greatest(F.lit(0), F.ceil((F.col("idx") - window + 1) / stride))
        spread = grid.select(*keys, point.alias("_x"), F.explode(F.sequence(first, block)).alias("_b"))
        out = spread.groupBy(*keys, "_b").agg(F.array_sort(F.collect_list("_x")).alias("_p"), F.count_if("_x.is_anomaly").alias("_h"))
    start = (F.col("_b") * stride).cast("int")
    whole = (F.size("_p") == window) & (F.get("_p", F.lit(window - 1))["idx"] == start + window - 1)
    return out.where(whole).select(
        *keys, start.alias("start_idx"), (start + window).alias("end_idx"), F.col("_p")[0]["ts"].alias("start_time"), F.col("_p")[window - 1]["ts"].alias("end_time"),
        F.col("_p.value").alias("values"), (F.col("_h") > 0).alias("is_anomaly"), (F.col("_h") / window).alias("anomaly_ratio"),
    )


#: Grid points that a task lays out at once.
POINTS = 1 << 19
#: What P9 tells of a window.
SHAPE = ("mean", "std", "p2p", "trend")


def windows_of_stretches(stretches: DataFrame, intervals: DataFrame, window: int = 32, stride: int = 16, seconds: int = 3600, keys: list[str] = MC, values: bool = True, shape: bool = False, moments: bool = False) -> DataFrame:
    """W1, W2 and W3 in one: the rows of make_windows over in_intervals over resample, from the rows of `grid.stretches`; stride must divide window.
    Without `values`, their column isn't made; `shape` adds P9's columns and `moments` the channel's mean and std, as `_mean` and `_std`.

    Neither a grid point nor a window is shuffled: stretches, intervals and moments meet in chunks of a channel, CHUNK strides long, and the points of
    a chunk are laid out in the task, POINTS at a time. What the last windows of a chunk need stands in the next one too. Of the intervals of a chunk
    that begin at the same point only the longest counts, so a chunk has no more of them than points.
    """
    if window % stride:
        raise ValueError("stride must divide window")
    more, span = window // stride - 1, stride * seconds
    number = lambda t: F.floor((t - F.col("_first")) / span)  # noqa: E731  # the block that holds time t
    chunks = lambda lo, hi: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((number(lo) - more) / CHUNK)), F.floor(number(hi) / CHUNK))).alias("_c")
    none = lambda *names: [F.lit(None).cast("long" if n in ("_b", "_nb") else "double").alias(n) for n in names]
    columns = [*keys, "_c", "_kind", "_first", "_lo", "_hi", "_b", "_v", "_nb", "_nv"]
    rows = stretches.select(*keys, chunks(F.col("_start"), F.col("_stop")), F.lit(0).alias("_kind"), "_first", F.col("_start").alias("_lo"), F.col("_stop").alias("_hi"), "_b", "_v", "_nb", "_nv")
    ends = stretches.where("_nb is null").select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_first", F.col("_stop").alias("_last"))  # a channel's last stretch
    spans = intervals.select(*keys, F.unix_micros(F.col("start_time").cast("timestamp")).alias("_s"), F.unix_micros(F.col("end_time").cast("timestamp")).alias("_e")).where("_s <= _e")
    held = spans.join(ends, [F.col(k) == F.col(f"_of_{k}") for k in keys])  # a missing key is in no interval
    points = lambda micros, whole: whole((F.col(micros) - F.col("_first") * 1000000) / (seconds * 1000000)) * seconds + F.col("_first")
    held = held.withColumns({"_lo": F.greatest("_first", points("_s", F.ceil)), "_hi": F.least("_last", points("_e", F.floor))}).where("_lo <= _hi")
    held = held.select(*keys, "_first", "_lo", "_hi", chunks(F.col("_lo"), F.col("_hi")))
    from_, to = F.col("_first") + F.col("_c") * CHUNK * span, F.col("_first") + ((F.col("_c") + 1) * CHUNK + more) * span - seconds
    marks = held.groupBy(*keys, "_c", "_first", F.greatest("_lo", from_).alias("_lo")).agg(F.max(F.least("_hi", to)).alias("_hi"))
    rows = rows.unionByName(marks.select(*keys, "_c", F.lit(1).alias("_kind"), "_first", "_lo", "_hi", *none("_b", "_v", "_nb", "_nv")))
    if moments:
        per = channel_moments(stretches, seconds, keys)
        rows = rows.unionByName(per.select(*keys, chunks(F.col("_first"), F.col("_last")), F.lit(2).alias("_kind"), "_first", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), *none("_b"), F.col("_mean").alias("_v"), *none("_nb"), F.col("_std").alias("_nv")))
    dealt = rows.select(*columns).repartition(*keys, "_c").withColumn("_key", key_hash(keys)).sortWithinPartitions("_key", *keys, "_c", "_kind", "_lo").select(*columns)
    chunk, n_keys, quarter, tail = CHUNK, len(keys), max(window // 4, 1), -(-window // 4)

    def laid(t: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The windows of whole chunks, whose rows begin at `start`."""
        col = lambda name, empty: pc.fill_null(t.column(name), empty).to_numpy()
        size = np.diff(np.append(start, t.num_rows))
        g, kind = np.repeat(np.arange(len(start)), size), col("_kind", 0)
        first, c = col("_first", 0), col("_c", 0)
        begin = first + c * chunk * span
        lo, hi = np.maximum(col("_lo", 0), begin), np.minimum(col("_hi", 0), begin + (chunk + more) * span - seconds)
        b, v, nb, nv, last = col("_b", 0), col("_v", np.nan), col("_nb", 0), col("_nv", np.nan), t.column("_nb").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        count = np.where((kind == 0) & (hi >= lo), (hi - lo) // seconds + 1, 0)
        before = np.cumsum(np.add.reduceat(count, start))
        cuts = np.flatnonzero(np.diff(before // POINTS, prepend=0)) if len(start) > 1 else []
        for x, y in zip([0, *cuts], [*cuts, len(start)]):
            if x == y:
                continue
            at = slice(start[x], start[y] if y < len(start) else t.num_rows)
            k, gg, groups = count[at], g[at] - x, y - x
            row = np.repeat(np.arange(at.start, at.stop), k)
            total = len(row)
            time = lo[row] + (np.arange(total) - np.repeat(np.cumsum(k) - k, k)) * seconds
            with np.errstate(all="ignore"):
                line = v[row] + (nv[row] - v[row]) * (time - b[row]) / (nb[row] - b[row])
            value = np.where((time <= b[row]) | last[row], v[row], line)
            many = np.bincount(gg, k, groups).astype(np.int64)
            offset, head = np.cumsum(many) - many, start[x:y]  # stretches come first in a group
            n0 = (lo[head] - first[head]) // seconds
            low = np.maximum(-(-n0 // stride), c[head] * chunk)
            high = np.minimum((c[head] + 1) * chunk - 1, (n0 + many - window) // stride)
            wins = np.where(many > 0, np.maximum(high - low + 1, 0), 0)
            of = np.repeat(np.arange(groups), wins)
            if not len(of):
                continue
            block = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(wins) - wins, wins)
            base = offset[of] + block * stride - n0[of]
            m = np.flatnonzero((kind[at] == 1) & (many[gg] > 0))
            mg, m = gg[m], m + at.start
            left = np.maximum((lo[m] - lo[head[mg]]) // seconds, 0)
            right = np.minimum((hi[m] - lo[head[mg]]) // seconds, many[mg] - 1)
            real = left <= right
            step = np.bincount(offset[mg[real]] + left[real], minlength=total + 1) - np.bincount(offset[mg[real]] + right[real] + 1, minlength=total + 1)
            hits = np.append(0, np.cumsum(np.cumsum(step[:total]) > 0))
            hits = hits[base + window] - hits[base]
            out = {"_start": first[head[of]] + block * span, "start_idx": (block * stride).astype(np.int32), "_h": hits}
            if values or shape:
                all_ = value[base[:, None] + np.arange(window)]
            if values:
                out["values"] = pa.ListArray.from_arrays(np.arange(0, all_.size + 1, window, dtype=np.int32), all_.ravel())
            if shape:
                mean = all_.mean(axis=1)
                out["mean"], out["std"] = mean, np.sqrt(((all_ - mean[:, None]) ** 2).mean(axis=1))
                out["p2p"], out["trend"] = all_.max(axis=1) - all_.min(axis=1), all_[:, -tail:].mean(axis=1) - all_[:, :quarter].mean(axis=1)
            if moments:
                p = np.flatnonzero(kind[at] == 2)
                both = np.full((2, groups), np.nan)
                both[:, gg[p]] = v[at][p], nv[at][p]
                out["_mean"], out["_std"] = both[0][of], both[1][of]
            names = t.select(range(n_keys)).take(pa.array(head[of]))
            yield pa.RecordBatch.from_arrays([*[names.column(i).combine_chunks() for i in range(n_keys)], *[x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()]], names=[*keys, *out])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = np.zeros(t.num_rows, bool)
            for name in (*keys, "_c"):
                code = pc.fill_null(t.column(name).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new |= np.diff(code, prepend=code[0]) != 0
            start = np.append(0, np.flatnonzero(new))
            if len(start) > 1:
                yield from laid(t.slice(0, start[-1]), start[:-1])
            held = t.slice(start[-1]).combine_chunks().to_batches()
        if held:
            yield from laid(pa.Table.from_batches(held), np.array([0]))

    kinds = dict(dealt.dtypes)
    extra = (", `values` array<double>" if values else "") + "".join(f", `{x}` double" for x in [*(SHAPE if shape else ()), *(("_mean", "_std") if moments else ())])
    out = dealt.mapInArrow(cut, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _start long, start_idx int, _h long" + extra)
    return out.select(
        *keys, "start_idx", (F.col("start_idx") + window).alias("end_idx"), F.timestamp_seconds("_start").alias("start_time"), F.timestamp_seconds(F.col("_start") + (window - 1) * seconds).alias("end_time"),
        *(["values"] if values else []), (F.col("_h") > 0).alias("is_anomaly"), (F.col("_h") / window).alias("anomaly_ratio"), *(SHAPE if shape else ()), *(("_mean", "_std") if moments else ()),
    )


def normalised_windows(windows: DataFrame, stretches: DataFrame, seconds: int = 3600, keys: list[str] = MC, eps: float = 1e-5) -> DataFrame:
    """P2 over whole windows: values by mean and population std + eps of all grid points of the channel."""
    both = join_spread(windows, channel_moments(stretches, seconds, keys).select(*keys, "_mean", (F.col("_std") + eps).alias("_std")), keys)
    return both.withColumn("values", F.transform("values", lambda x: (x - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def normalised_shape(windows: DataFrame, eps: float = 1e-5) -> DataFrame:
    """P9 of P2's values, from windows with `shape` and `moments`: what P9 tells moves and scales with the values."""
    s = F.col("_std") + eps
    return windows.withColumns({"mean": (F.col("mean") - F.col("_mean")) / s, **{c: F.col(c) / s for c in SHAPE[1:]}}).drop("_mean", "_std")


def with_stats(windows: DataFrame) -> DataFrame:
    """Mean, population std, peak to peak, and last minus first quarter mean (the last quarter rounds up, the first down). Mean and std
    come from one pass over the values, and no loop over them runs more than once."""
    values, n = F.col("values"), F.size("values")
    first, last = F.floor(n / 4).cast("int"), F.ceil(n / 4).cast("int")
    head, tail = F.slice(values, F.lit(1), F.greatest(first, F.lit(1))), F.slice(values, n - last + 1, last)
    out = windows.withColumn("_m", array_moments(values))
    return out.withColumns({
        "mean": F.col("_m.mean"), "std": F.sqrt(F.col("_m.m2") / F.col("_m.n")), "p2p": F.array_max(values) - F.array_min(values), "trend": array_mean(tail) - array_mean(head),
    }).drop("_m")
