"""What the given tables stand for: telemetry, catalogue and intervals from events, scored rows from documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators.advice import make_advice
from ..operators.windows import normalised_shape, windows_of_stretches
from ..schemas import MC
from ..shared import stored


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _named(df: DataFrame) -> DataFrame:
    user = F.col("user_id")
    return df.withColumns({"mission": F.concat(F.lit("Mission"), (user % 3 + 1).cast("string")), "channel": F.concat(F.lit("channel_"), user.cast("string"))})


def as_telemetry(events: DataFrame) -> DataFrame:
    raw = F.when(F.col("user_id") % 3 == 2, F.concat(F.lit("value_"), F.floor(F.col("value") / 10).cast("string")))
    return _named(events).select(*MC, F.col("ts").cast("timestamp").alias("ts"), "value", raw.alias("raw"), "user_id", "event_id", "event_type")


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return as_telemetry(table(spark, sf, "events"))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return _named(table(spark, sf, "events").select("user_id").distinct()).select(
        *MC, user.cast("int").alias("ordinal"), F.concat(F.lit("subsystem_"), (user % 12 + 1).cast("string")).alias("subsystem"),
        F.concat(F.lit("physical_unit_"), (user % 14 + 1).cast("string")).alias("physical_unit"), (user % 5).cast("string").alias("grp"), F.when(user % 4 == 0, "NO").otherwise("YES").alias("target"),
    )


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = telemetry(spark, sf).where("event_type = 'error' and value > 80")
    return rows.select("mission", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), "channel", F.col("ts").alias("start_time"), F.expr("ts + make_interval(0, 0, 0, 0, cast(1 + user_id % 12 as int))").alias("end_time"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return g.in_intervals(g.resample(telemetry(spark, sf)), intervals(spark, sf))


def windows(spark: SparkSession, sf: str, values: bool = True, shape: bool = False, moments: bool = False) -> DataFrame:
    """Windows of the grid, whose rows for each known hour are stored, as windows, intervals and moments read them; a query that needs no values leaves them out."""
    return windows_of_stretches(stored(g.stretches(telemetry(spark, sf))), intervals(spark, sf), values=values, shape=shape, moments=moments)


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with their shape and the channel's moments instead of values: what errors and advice need."""
    return windows(spark, sf, values=False, shape=True, moments=True)


def shaped(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """Windows with mean, std, p2p and trend of normalised values; `of` are measured windows, where a query has them already."""
    return normalised_shape(measured(spark, sf) if of is None else of)


def advice(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    return make_advice(shaped(spark, sf, of), channels(spark, sf))


def errors(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """A simple error of each window: its population variance."""
    w = windows(spark, sf, values=False, shape=True) if of is None else of
    return w.select(*MC, F.floor(F.col("start_idx") / 16).cast("int").alias("i"), "start_idx", (F.col("std") * F.col("std")).alias("error"), "is_anomaly")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three signals about documents of known quality: (index, mission, channel, is_anomaly, text, vision, error)."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    words = F.split("text", " ", -1)
    letters = F.length(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return d.select(
        F.col("doc_id").alias("index"), F.concat(F.lit("Mission"), (F.col("doc_id") % 3 + 1).cast("string")).alias("mission"), F.concat(F.lit("channel_"), (F.col("doc_id") % 15).cast("string")).alias("channel"),
        (F.col("quality") == 0).alias("is_anomaly"), F.round(F.least(F.lit(1.0), 2.5 * (1 - letters / F.col("n_chars"))), 6).alias("text_score"), F.round(1 - F.size(F.array_distinct(words)) / F.size(words), 6).alias("vision"),
        F.when(F.col("doc_id") % 3 != 0, F.round(F.col("n_chars") / F.size(words), 6)).alias("error"),
    ).withColumnRenamed("text_score", "text")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("index"), ((F.col("n_chars") % 1000) / 250.0 - 2).alias("l_anom"), ((F.col("doc_id") % 500) / 125.0 - 2).alias("l_nom"), (F.col("n_chars") % 4 == 0).alias("is_anomaly"))


# One answer for each event_id % 7.
ANSWERS = ("ANOMALY DETECTED. DIAGNOSIS: spike ADVICE: check sensor", "anomaly: possible drift", "NOMINAL. All is well", "Nominal but ANOMALY DETECTED", "unsure", "NOMINAL", "")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict texts about events: (index, mission, channel, is_anomaly, actual_response, elapsed_s)."""
    text = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), (F.col("event_id") % 7 + 1).cast("int"))
    return telemetry(spark, sf).select(F.col("event_id").alias("index"), *MC, (F.col("event_type") == "error").alias("is_anomaly"), text.alias("actual_response"), (F.col("value") / 100).alias("elapsed_s"))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    i, n = F.col("doc_id"), F.col("n_chars")
    return d.select(i.alias("index"), (i % 3).cast("int").alias("correctness"), (n % 3).cast("int").alias("actionability"), ((i + n) % 3).cast("int").alias("grounding"), (F.col("quality") == 1).alias("is_anomaly"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the answer that follows: (conv_id, turn, instruction, response, is_anomaly)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("response", F.lead("text").over(w)).withColumn("_next", F.lead("role").over(w))
    return c.where("role = 'user' and _next = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "response", (F.col("conv_id") % 2 == 0).alias("is_anomaly"))


def images(spark: SparkSession, sf: str) -> DataFrame:
    """64 floats as an 8 x 8 image, with a brightness array of the same size from the reversed values."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("index"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("attribution")).withColumn("brightness", F.transform("attribution", lambda x: x * x))


def regression(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.log10("l_extendedprice").alias("truth"), F.log10(F.col("l_quantity") * 1500).alias("pred"))
