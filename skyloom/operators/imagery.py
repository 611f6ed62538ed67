"""Regression and attribution on image arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; 0 without variance or rows."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.when(spread > 0, F.covar_pop(x, y) / F.when(spread > 0, spread).otherwise(1.0)), F.lit(0.0))


def regression_metrics(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """MAE, RMSE, bias and Pearson's r (0 without variance)."""
    e = F.col(pred) - F.col(truth)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), pearson(pred, truth).alias("pearson"), F.count("*").alias("n"))


def mean_baseline(train: DataFrame, val: DataFrame, truth: str = "truth") -> DataFrame:
    """The error of the training mean on the validation rows."""
    mean = train.agg(F.avg(truth).alias("_m"))
    return val.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col(truth) - F.col("_m"))).alias("baseline_mae"))  # one row


def magnitudes(values: Column) -> Column:
    return F.array_sort(F.transform(values, lambda x: F.abs(x.cast("double"))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def gini(values: Column) -> Column:
    """Of magnitudes; 0 for an empty or all-zero array."""
    m = magnitudes(values)
    n, total = F.size(m), _sum(m)
    weighted = _sum(F.transform(m, lambda x, i: x * (i + 1)))
    return F.when((n == 0) | (total == 0), 0.0).otherwise(2 * weighted / (n * F.when(total == 0, 1.0).otherwise(total)) - (n + 1) / n)


def top_decile_mass(values: Column) -> Column:
    """The share of the max(1, round(n / 10)) greatest magnitudes."""
    m = magnitudes(values)
    k = F.greatest(F.lit(1), F.bround(F.size(m) * 0.1, 0).cast("int"))
    total = _sum(m)
    return F.when(total == 0, 0.0).otherwise(_sum(F.slice(m, F.greatest(F.size(m) - k + 1, F.lit(1)), k)) / F.when(total == 0, 1.0).otherwise(total))


def array_pearson(x: Column, y: Column) -> Column:
    """Pearson's r of two arrays of one length, in two passes inside the row; 0 without variance, for empty arrays and for arrays of two lengths."""
    n = F.size(x)
    mean = lambda v: _sum(v) / F.when(n > 0, n)
    both = F.struct(x.alias("x"), y.alias("y"), mean(x).alias("mx"), mean(y).alias("my"))

    def r(s: Column) -> Column:
        off = F.zip_with(s["x"], s["y"], lambda a, b: F.struct((a - s["mx"]).alias("a"), (b - s["my"]).alias("b")))
        add = lambda t, d: F.struct((t["ab"] + d["a"] * d["b"]).alias("ab"), (t["aa"] + d["a"] * d["a"]).alias("aa"), (t["bb"] + d["b"] * d["b"]).alias("bb"))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("ab", "aa", "bb")])
        spread = lambda t: F.sqrt(t["aa"]) * F.sqrt(t["bb"])
        return F.aggregate(off, zero, add, lambda t: F.when(spread(t) > 0, t["ab"] / F.when(spread(t) > 0, spread(t)).otherwise(1.0)).otherwise(0.0))

    return F.coalesce(F.when(F.size(x) == F.size(y), F.transform(F.array(both), r)[0]), F.lit(0.0))


def brightness_corr(df: DataFrame, keys: list[str], attribution: str = "attribution", brightness: str = "brightness", channels: int = 1) -> DataFrame:
    """(keys, r, by_channel): Pearson's r of attribution magnitude with patch brightness (0 without variance), the mean of one for each of the
    image's channels, whose brightness arrays stand one after another. Works inside each row."""
    mags = F.transform(attribution, lambda v: F.abs(v).cast("double"))
    n = F.floor(F.size(brightness) / channels).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.transform(F.slice(brightness, c * n + 1, n), lambda v: v.cast("double")))
    out = df.select(*keys, mags.alias("_m"), each.alias("_b")).select(*keys, F.transform("_b", lambda b: array_pearson(F.col("_m"), b)).alias("by_channel"))
    return out.select(*keys, (_sum(F.col("by_channel")) / channels).alias("r"), "by_channel")


def _avg(values: Column) -> Column:
    """The mean of an array without its nulls, null without any."""
    known = F.array_compact(values)
    return F.when(F.size(known) > 0, _sum(F.transform(known, lambda v: v.cast("double"))) / F.size(known))


def patch_means(values: Column, width: int, patch: int, height: int, channels: int = 1) -> Column:
    """The mean of each whole patch x patch square of a channel-first, row-major image, channel by channel; rows and columns beyond whole
    squares are left out. Index ranges inside the array: no row for a pixel, no exchange. Null for an image that is null or empty."""
    across, down = width // patch, height // patch

    def mean(i: Column) -> Column:
        c, spot = F.floor(i / (across * down)), i % (across * down)
        corner = (c * height + F.floor(spot / across) * patch) * width + (spot % across) * patch + 1
        rows = F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda k: F.slice(values, (corner + k * width).cast("int"), F.lit(patch)))
        return _avg(F.flatten(rows))

    means = F.transform(F.sequence(F.lit(0), F.lit(channels * across * down - 1)), mean) if across * down else F.array().cast("array<double>")
    return F.when(F.size(values) > 0, means)


def avg_pool(df: DataFrame, keys: list[str], values: str, width: int, patch: int, height: int | None = None, channels: int = 1) -> DataFrame:
    """(keys, patch_id, mean) of each patch x patch square; patches are numbered channel by channel. height: that of a square image if not given."""
    return df.select(*keys, F.posexplode(patch_means(F.col(values), width, patch, height or width, channels)).alias("patch_id", "mean"))


def _weights(n: int, m: int) -> np.ndarray:
    """m x n matrix of bilinear weights with half-pixel centres and clamped edges."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, n - 1)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), lo), 1 - (at - lo))
    np.add.at(out, (np.arange(m), hi), at - lo)
    return out


def resize_bilinear(values: Column, channels: int, height: int, width: int, to_height: int, to_width: int) -> Column:
    """Channel-first images resized without anti-aliasing, a batch as one block."""
    up, across = _weights(height, to_height), _weights(width, to_width)

    @F.pandas_udf(ArrayType(DoubleType()))
    def resize(batch: pd.Series) -> pd.Series:
        out, known = pd.Series([None] * len(batch), index=batch.index, dtype=object), batch[batch.notna()]
        if len(known):
            block = np.stack(known.to_numpy()).astype(float).reshape(len(known), channels, height, width)
            out[known.index] = list((up @ block @ across.T).reshape(len(known), -1))
        return out

    return resize(values)


def faithfulness(parts: Column, total: Column, tolerance: float = 1e-3) -> Column:
    """Whether the parts sum to the total."""
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.cast("double")) - total) < tolerance


def column_means(df: DataFrame, keys: list[str], weights: str, n: int) -> DataFrame:
    """Mean of each column of an n x n row-major matrix: (keys, col, mean), by index ranges inside the array."""
    w = F.col(weights)
    column = lambda c: _avg(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(w, (k * n + c).cast("int"))))
    return df.where(F.size(w) > 0).select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), column)).alias("col", "mean"))


def profile(df: DataFrame, values: str, label: str) -> DataFrame:
    """Rows, sizes, value and label bounds, and how many values and labels aren't finite (a null label isn't)."""
    per = df.select(F.size(values).alias("n"), F.array_min(values).alias("lo"), F.array_max(values).alias("hi"), F.size(F.filter(values, lambda x: F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))).alias("bad"), F.col(label).alias("y"))
    return per.agg(F.count("*").alias("rows"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.min("lo").cast("double").alias("value_min"), F.max("hi").cast("double").alias("value_max"), F.min("y").alias("label_min"), F.max("y").alias("label_max"), F.sum("bad").alias("not_finite"), F.count_if(F.col("y").isNull() | F.isnan(F.col("y").cast("double")) | (F.abs(F.col("y").cast("double")) == float("inf"))).alias("label_not_finite"))
