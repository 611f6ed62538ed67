"""Exact seeded samples, splits and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import draw, exact_rank, stored


#: Up to this many rows Spark's top-k merges them in one task; more are cut off by their exact rank, over all tasks.
TOP_K = 100_000


def _first(df: DataFrame, keys: list[str], seed: int, k: int) -> DataFrame:
    """k rows in drawn order."""
    drawn = df.withColumn("_d", draw(keys, seed))
    if k <= TOP_K:
        return drawn.orderBy("_d", *keys).limit(k).drop("_d")
    return exact_rank(drawn, ["_d", *keys], "_r").where(F.col("_r") < k).drop("_d", "_r")


def balance(df: DataFrame, keys: list[str], label: str = "is_anomaly", ratio: float = 3.0, seed: int = 0) -> DataFrame:
    """K1: all positive rows and exactly min(n_negative, int(ratio * n_positive)) negative ones."""
    df = stored(df)  # counted once and read twice
    n = df.agg(F.count_if(F.col(label))).first()[0]
    return df.where(F.col(label)).unionByName(_first(df.where(~F.col(label)), keys, seed, int(ratio * n)))


def cap(df: DataFrame, k: int, keys: list[str], seed: int = 0) -> DataFrame:
    """K2: at most k rows, drawn without replacement."""
    return _first(df, keys, seed, k)


def shuffle(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """K3: rows in drawn order."""
    return df.withColumn("_d", draw(keys, seed)).orderBy("_d", *keys).drop("_d")


def split(df: DataFrame, keys: list[str], shares: tuple[float, float] = (0.7, 0.15), seed: int = 0) -> DataFrame:
    """K4, K5: split (train, val, test by cut-off counts, the rest to test) and index, the row's number inside its split."""
    ranked = exact_rank(df.withColumn("_d", draw(keys, seed)), ["_d", *keys], "_r").drop("_d")
    n = ranked.count()  # of the stored ranks, not of df again
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    name = F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "val").otherwise("test")
    base = F.when(F.col("_r") < a, 0).when(F.col("_r") < b, a).otherwise(b)
    return ranked.withColumn("split", name).withColumn("index", F.col("_r") - base).drop("_r")


def stratified_sample(df: DataFrame, n: int, label: str, keys: list[str], seed: int = 0) -> DataFrame:
    """K6, K7: n rows that keep the share of positives, round-half-even."""
    df = stored(df)
    total, pos = df.agg(F.count("*"), F.count_if(F.col(label))).first()
    n_pos = min(round(n * pos / total), pos) if total else 0
    return _first(df.where(F.col(label)), keys, seed, n_pos).unionByName(_first(df.where(~F.col(label)), keys, seed, n - n_pos))


def cap_per_key(df: DataFrame, k: int, by: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """K8: at most k rows of each key."""
    w = Window.partitionBy(*by).orderBy(draw(keys, seed), *keys)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def plot_manifest(records: DataFrame, n: int = 2000, folder: str = "data/plots") -> DataFrame:
    """K9: the first n records of each split with 3 values or more; index stays the record's line number."""
    path = F.concat(F.lit(folder + "/"), F.col("split"), F.format_string("/%06d.png", F.col("index")))
    return records.where((F.col("index") < n) & (F.size("values") >= 3)).select("split", "index", path.alias("image_path"), "is_anomaly", "mission", "channel")


def holdout(df: DataFrame, share: float, keys: list[str], seed: int = 0) -> DataFrame:
    """is_val for min(max(round(n * share), 1), n - 1) drawn rows; none if there is one row only."""
    ranked = exact_rank(df.withColumn("_d", draw(keys, seed)), ["_d", *keys], "_r")
    n = ranked.count()
    k = min(max(round(n * share), 1), n - 1) if n > 1 else 0
    return ranked.withColumn("is_val", F.col("_r") < k).drop("_r", "_d")


def take_bounded(df: DataFrame, n: int, order: list[str], strict: bool = True) -> DataFrame:
    """The first n rows in order; too few rows are an error unless strict is False."""
    if strict and (held := df.count()) < n:
        raise ValueError(f"{n} rows wanted, {held} found")
    return df.orderBy(*order).limit(n)
