"""Uniform grids, labels from intervals, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import carried, in_order, join_channels, join_spread, key_hash
from .sequences import merge_intervals


def ordinal_encode(raw: Column) -> Column:
    """The trailing digits of a state text as a number; null without any."""
    return F.nullif(F.regexp_extract(raw, r"(\d+)$", 1), F.lit("")).cast("double")


def resample(telemetry: DataFrame, seconds: int | None = 3600, keys: list[str] = MC) -> DataFrame:
    """Mean per bucket, every bucket from the first to the last of a channel, gaps filled linearly and ends by the nearest value.

    Buckets are closed and labelled at the left and start at the midnight of the channel's first day. NaN counts as null. None
    for seconds keeps the rows, drops nulls and numbers them by time, then value. The averages are partial before the exchange on (keys, bucket).
    Buckets then stand in fragments of a channel that hand each other the nearest known value on either side.
    """
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = telemetry.withColumn("value", value)
    inside = Window.partitionBy(*keys, "_part").orderBy("_at")
    if seconds is None:
        placed = in_order(rows.where("value is not null").select(*keys, "ts", "value"), keys, ["ts", "value"])
        placed = carried(placed, keys, {"_n": F.count("*")}, before={"_before": ("sum", "_n")})
        return placed.select(*keys, "ts", "value", (F.row_number().over(inside) - 1 + F.coalesce("_before", F.lit(0))).cast("int").alias("idx"))
    filled = stretches(telemetry, seconds, keys).withColumn("_t", F.explode(F.sequence("_start", "_stop", F.lit(seconds).cast("long"))))
    # the grid has no holes, so a bucket's number follows from its time
    return filled.select(*keys, F.timestamp_seconds("_t").alias("ts"), filled_value(F.col("_t")).alias("value"), ((F.col("_t") - F.col("_first")) / seconds).cast("int").alias("idx"))


def filled_value(t: Column) -> Column:
    """The value of the bucket that begins at t, one of those of a row of `stretches`."""
    line = F.col("_v") + (F.col("_nv") - F.col("_v")) * (t - F.col("_b")) / (F.col("_nb") - F.col("_b"))
    return F.when((t <= F.col("_b")) | F.col("_nb").isNull(), F.col("_v")).otherwise(line)


#: Rows of a channel up to which it stands in one fragment, and buckets in a fragment of a longer one.
LONG = 65_536


def stretches(telemetry: DataFrame, seconds: int = 3600, keys: list[str] = MC) -> DataFrame:
    """The grid of W1 as a row for each known bucket `_b` with its mean `_v`: the buckets from `_start` to `_stop`, in unix seconds, follow from it and
    from the next known one (`_nb`, `_nv`); `_first` is the channel's first bucket, `_ref` the mean of a fragment's known buckets.

    A channel of LONG rows at most is one fragment; a longer one, and there are as few of these as rows / LONG, is cut by time into fragments that
    hand each other the nearest known value on either side."""
    rows = telemetry.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))
    own = ["_key", *keys]
    inside = Window.partitionBy(*own, "_part").orderBy("_at")
    alone = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one sort serves all windows
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    if 86400 % seconds:
        first = rows.groupBy(*keys).agg((F.floor(F.min(at) / 86400) * 86400).alias("_from"))
        rows = join_spread(rows, first, keys)
    else:
        rows = rows.withColumn("_from", F.lit(0))
    bucket = F.floor((at - F.col("_from")) / seconds) * seconds + F.col("_from")
    long = telemetry.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG).select(*keys, F.lit(True).alias("_long"))
    means = rows.groupBy(*keys, bucket.alias("_b")).agg(F.avg("value").alias("_v"))
    means = join_channels(means, F.broadcast(long), keys, "left")
    part = F.when(F.col("_long"), F.floor(F.col("_b") / (seconds * LONG))).otherwise(0).cast("long")
    means = means.select(*keys, "_b", "_v", part.alias("_part"), F.coalesce("_long", F.lit(False)).alias("_long")).repartition(*keys, "_part").withColumns({"_at": F.col("_b"), "_key": key_hash(keys)})
    known = F.when(F.col("_v").isNotNull(), F.struct("_b", "_v"))
    ends = {"_lo": F.min("_b"), "_hi": F.max("_b"), "_kf": F.min(known), "_kl": F.max(known)}
    whole = {"_first": ("min", "_lo"), "_last": ("max", "_hi")}
    means = carried(means, own, ends, before={"_pk": ("max", "_kl")}, after={"_nk": ("min", "_kf")}, whole=whole, cut=F.col("_long"), order="_at")
    means = means.withColumn("_ref", F.avg("_v").over(alone)).where("_v is not null")
    means = means.withColumns({
        "_nb": F.coalesce(F.lead("_b").over(inside), F.col("_nk._b")), "_nv": F.coalesce(F.lead("_v").over(inside), F.col("_nk._v")), "_pb": F.coalesce(F.lag("_b").over(inside), F.col("_pk._b")),
    })
    start = F.when(F.col("_pb").isNull(), F.col("_first")).otherwise(F.col("_b"))
    stop = F.coalesce(F.col("_nb") - seconds, F.col("_last"))
    return means.select(*keys, "_first", start.alias("_start"), stop.alias("_stop"), "_b", "_v", "_nb", "_nv", "_ref")


def channel_moments(stretches: DataFrame, seconds: int = 3600, keys: list[str] = MC) -> DataFrame:
    """(keys, _mean, _std, _first, _last): mean and population std of all grid points of a channel, and its ends. A stretch adds the moments of its level
    part and of its line in closed form, about its fragment's `_ref`; a row for each fragment then meets those of its key."""
    level = F.greatest(F.lit(0), (F.col("_b") - F.col("_start")) / seconds)
    k = (F.col("_stop") - F.col("_b")) / seconds + 1
    slope = F.when(F.col("_nb").isNull(), 0.0).otherwise((F.col("_nv") - F.col("_v")) * seconds / (F.col("_nb") - F.col("_b")))
    off, middle = F.col("_v") - F.col("_ref"), F.col("_v") - F.col("_ref") + slope * (k - 1) / 2
    own = stretches.select(*keys, "_ref", "_first", "_stop", (level + k).alias("_n"), (level * off + k * middle).alias("_a"), (level * off * off + k * middle * middle + slope * slope * k * (k * k - 1) / 12).alias("_q"))
    own = own.groupBy(*keys, "_ref").agg(*[F.sum(c).alias(c) for c in ("_n", "_a", "_q")], F.min("_first").alias("_first"), F.max("_stop").alias("_last"))
    whole = Window.partitionBy(*keys)
    own = own.withColumn("_at", F.col("_ref") + F.col("_a") / F.col("_n")).withColumn("_mean", F.sum(F.col("_n") * F.col("_at")).over(whole) / F.sum("_n").over(whole))
    spread = F.col("_q") - F.col("_a") * F.col("_a") / F.col("_n") + F.col("_n") * (F.col("_at") - F.col("_mean")) * (F.col("_at") - F.col("_mean"))
    std = F.sqrt(F.greatest(F.sum(spread) / F.sum("_n"), F.lit(0.0)))
    return own.groupBy(*keys).agg(F.first("_mean").alias("_mean"), std.alias("_std"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str] = MC) -> DataFrame:
    """Points with is_anomaly: whether ts lies in any interval of its channel, both ends included.

    Intervals are merged first, so they are disjoint, and stand once for each day they touch: an equi-join on
    channel and day gives a point one match at most, however many intervals there are.
    """
    rows = points.withColumn("_day", F.to_date("ts"))
    merged = merge_intervals(intervals.select(*keys, F.unix_micros("start_time").alias("start"), F.unix_micros("end_time").alias("end")), 0, keys)
    daily = merged.select(*keys, "start", "end", F.explode(F.sequence(F.to_date(F.timestamp_micros("start")), F.to_date(F.timestamp_micros("end")))).alias("_day"))
    p, d = rows.alias("p"), daily.alias("d")
    on = [F.col(f"p.{k}") == F.col(f"d.{k}") for k in [*keys, "_day"]]
    at = F.unix_micros(F.col("p.ts").cast("timestamp"))
    return p.join(d, [*on, at.between(F.col("d.start"), F.col("d.end"))], "left").select(*[F.col(f"p.{c}") for c in points.columns], F.col("d.start").isNotNull().alias("is_anomaly"))


def channel_stats(df: DataFrame, keys: list[str] = MC) -> DataFrame:
    """df with mean and population std of its channel's values, from partial sums."""
    return join_spread(df, df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("_rows")), keys).select(*df.columns, "mean", "std")


def revin(df: DataFrame, keys: list[str] = MC, eps: float = 1e-5) -> DataFrame:
    """value_norm = (value - mean) / (population std + eps) of the channel, with mean and std = population std + eps."""
    out = channel_stats(df, keys).withColumn("std", F.col("std") + eps)
    return out.withColumn("value_norm", (F.col("value") - F.col("mean")) / F.col("std"))


def revin_inverse(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value_norm") * F.col("std") + F.col("mean"))


def standardize(df: DataFrame, keys: list[str] = MC) -> DataFrame:
    """Standard score by population std; a constant channel is centred only."""
    out = channel_stats(df, keys)
    return out.withColumn("value_std", (F.col("value") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def standardize_positions(windows: DataFrame, keys: list[str] = MC) -> DataFrame:
    """Each window position as a standard score over the channel's windows: (keys, start_idx, pos, value). A channel's windows meet its moments,
    a pair for each position, as whole arrays."""
    per = windows.select(*keys, F.posexplode("values").alias("pos", "value")).groupBy(*keys, "pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    per = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("mean", "std")))).alias("_at"))  # as many as a window has positions
    both = join_spread(windows.select(*keys, "start_idx", "values"), per, keys)
    long = both.select(*keys, "start_idx", "_at", F.posexplode("values").alias("pos", "value"))
    m = F.col("_at")[F.col("pos")]
    return long.select(*keys, "start_idx", "pos", ((F.col("value") - m["mean"]) / F.when(m["std"] == 0, 1.0).otherwise(m["std"])).alias("value"))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def array_moments(values: Column) -> Column:
    """(n, mean, m2) of an array in one pass; m2 is the sum of squared differences to the mean."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, x: Column) -> Column:
        mean = a["mean"] + (x - a["mean"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), mean.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(values, start, add)


def revin_window(windows: DataFrame, eps: float = 1e-8) -> DataFrame:
    """P5: values_norm, each window by its own mean and population std."""
    out = windows.withColumn("_m", array_moments(F.col("values")))
    out = out.withColumn("_s", F.sqrt(F.col("_m.m2") / F.col("_m.n")) + eps)
    return out.withColumn("values_norm", F.transform("values", lambda x: (x - F.col("_m.mean")) / F.col("_s"))).drop("_m", "_s")


def short_channels(grid: DataFrame, window: int = 32, keys: list[str] = MC) -> DataFrame:
    """Channels with fewer points than a window."""
    return grid.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < window)
