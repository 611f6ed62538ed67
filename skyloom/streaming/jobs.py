"""Online jobs (T1-T4): hourly means, sliding windows, screening against stored thresholds, alert episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MC
from ..shared import new_path


def stream_resample(stream: DataFrame, rule: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Mean per channel and bucket; rows later than the watermark are dropped."""
    means = stream.withWatermark("ts", delay).groupBy(F.window("ts", rule), *MC).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return means.select(*MC, F.col("window.start").alias("ts"), "value", "n")


def stream_windows(stream: DataFrame, window: str = "32 hours", slide: str = "16 hours", delay: str = "2 hours") -> DataFrame:
    """Count, mean, population std, least and greatest value of the observed rows in sliding windows."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), *MC)
    out = w.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return out.select(*MC, F.col("window.start").alias("start_time"), F.col("window.end").alias("end_time"), "n", "mean", "std", "lo", "hi")


def stream_screen(stream: DataFrame, thresholds: DataFrame, z: float = 2.0, rule: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Hourly means against the stored (mission, channel, mean, std) of their channel: flag = value > mean + z std.

    The last batch has no rows of its own but gives what the state holds. Spark takes it for empty and would broadcast it, so the join is named."""
    t = thresholds.select(*MC, F.col("mean").alias("_m"), F.col("std").alias("_s")).hint("merge")
    return stream_resample(stream, rule, delay).join(t, MC).select(*MC, "ts", "value", (F.col("value") > F.col("_m") + z * F.col("_s")).alias("flag"))


def stream_episodes(flags: DataFrame, gap: str = "16 hours", delay: str = "2 hours") -> DataFrame:
    """T4: flagged times closer than gap, or exactly that far, as one episode per channel."""
    e = flags.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *MC).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n"))
    return e.select(*MC, "start_time", "end_time", "n")


def run_available(stream: DataFrame, path: str, state: str) -> int:
    """Everything available now, appended to `path`; `state` keeps where the job stands, so that a later run, also by another driver, goes on from
    there. Returns how many late groups the watermark has dropped: rows of one batch, key and window count once."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def drain(stream: DataFrame) -> DataFrame:
    """Everything available now, written in append mode to the shared folder and read back."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession)
    run_available(stream, path, path + "-state")
    return spark.read.schema(stream.schema).parquet(path)
