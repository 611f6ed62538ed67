"""Text and record columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .constants import ANOMALY_RESPONSE, END_TURN, NOMINAL_RESPONSE, QUESTION, SYSTEM_PROMPT, TURN, VISION_PROMPT


def instruction_text(mission: Column, channel: Column, values: Column) -> Column:
    """The question about one window, with its length and first ten values at 4 decimals."""
    shown = F.array_join(F.transform(F.slice(values, 1, 10), lambda x: F.format_string("%.4f", x)), ", ")
    more = F.when(F.size(values) > 10, "...").otherwise("")
    return F.concat(
        F.lit("Analyze the following telemetry sequence from "), mission, F.lit(" satellite, channel "), channel, F.lit(". The sequence contains "),
        F.size(values).cast("string"), F.lit(" timesteps. Values: ["), shown, more, F.lit(f"]\n\n{QUESTION}"),
    )


def response_text(is_anomaly: Column) -> Column:
    """P7"""
    return F.when(is_anomaly, ANOMALY_RESPONSE).otherwise(NOMINAL_RESPONSE)


def to_record(windows: DataFrame) -> DataFrame:
    """(instruction, response, metadata) with values at 6 decimals and times as text; other columns stay."""
    inner = ["mission", "channel", "start_idx", "end_idx"]
    stamp = "yyyy-MM-dd HH:mm:ss"
    meta = F.struct(
        *inner, F.date_format("start_time", stamp).alias("start_time"), F.date_format("end_time", stamp).alias("end_time"), "is_anomaly", "anomaly_ratio",
        F.transform("values", lambda x: F.round(x, 6)).alias("values"),
    )
    used = {*inner, "start_time", "end_time", "is_anomaly", "anomaly_ratio", "values"}
    return windows.select(*[c for c in windows.columns if c not in used], instruction_text(F.col("mission"), F.col("channel"), F.col("values")).alias("instruction"), response_text(F.col("is_anomaly")).alias("response"), meta.alias("metadata"))


def _turn(role: str, body: Column) -> Column:
    return F.concat(F.lit(f"{TURN}{role}\n"), body, F.lit(END_TURN))


def to_chatml(instruction: Column, response: Column) -> Column:
    """P16"""
    return F.concat(_turn("system", F.lit(SYSTEM_PROMPT)), F.lit("\n"), _turn("user", instruction), F.lit("\n"), _turn("assistant", response))


def to_prompt(instruction: Column, fewshot: Column | None = None, no_think: bool = False) -> Column:
    """The text up to where the assistant answers."""
    system = F.lit(SYSTEM_PROMPT + (" /no_think" if no_think else ""))
    return F.concat(_turn("system", system), F.lit("\n"), fewshot if fewshot is not None else F.lit(""), _turn("user", instruction), F.lit(f"\n{TURN}assistant\n"))


def fewshot_prefix(train: DataFrame, n: int = 1, label: str = "is_anomaly", order: str = "index") -> DataFrame:
    """One row, the turns of the first n nominal and then the first n anomalous records."""
    ranked = train.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_k") <= n)
    turns = F.concat(_turn("user", F.col("instruction")), F.lit("\n"), _turn("assistant", F.col("response")), F.lit("\n"))
    return ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "_k", turns.alias("t")))), lambda x: x["t"]), "").alias("prefix"))


def parse_verdict(response: Column) -> Column:
    """ANOMALY if the text says so anywhere in full or begins with it, else NOMINAL if that word occurs, else UNKNOWN."""
    up = F.upper(response)
    return F.when(up.contains("ANOMALY DETECTED") | up.startswith("ANOMALY"), "ANOMALY").when(up.contains("NOMINAL"), "NOMINAL").otherwise("UNKNOWN")


def verdict_score(anomaly: Column, nominal: Column) -> Column:
    """P20: two-way softmax, 6 decimals."""
    return F.round(1 / (1 + F.exp(nominal - anomaly)), 6)


def argmax(anomaly: Column, nominal: Column) -> Column:
    return F.when(anomaly >= nominal, "ANOMALY").otherwise("NOMINAL")


def to_conversation(manifest: DataFrame) -> DataFrame:
    """Index and messages, a user turn of prompt and image and the assistant's label."""
    part = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))
    none = F.lit(None).cast("string")
    label = F.when(F.col("is_anomaly"), "ANOMALY DETECTED").otherwise("NOMINAL")
    messages = F.array(
        F.struct(F.lit("user").alias("role"), F.array(part("text", F.lit(VISION_PROMPT), none), part("image", none, F.col("image_path"))).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.array(part("text", label, none)).alias("content")),
    )
    return manifest.select("index", messages.alias("messages"))


def log_flux(x: Column) -> Column:
    """P22"""
    return (F.log10(F.greatest(x, F.lit(1e-9))) + 5.5) / 2.5


def log_flux_inverse(y: Column) -> Column:
    return F.pow(F.lit(10.0), y * 2.5 - 5.5)


def scalar_of(value: Column) -> Column:
    """The element of a list of one."""
    return F.element_at(value, 1)


def advice_flags(response: Column) -> dict[str, Column]:
    """Whether the answer carries advice, its length, and its first 300 characters."""
    up = F.upper(response)
    return {"structured": up.contains("DIAGNOSIS") & up.contains("ADVICE"), "n_chars": F.length(response), "shown": F.substring(response, 1, 300)}


def normalise_verdict(answer: Column) -> Column:
    """P25"""
    up = F.upper(answer)
    return F.when(up.isin("ANOMALY", "NOMINAL"), up).otherwise("UNKNOWN")


def parse_time(text: Column) -> Column:
    """A time with a blank or a T between date and time; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
