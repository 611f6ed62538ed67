"""Patterns, severity and advice of anomalous windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import PATTERN_ADVICE, SEVERITY_ACTION, SUBSYSTEMS, UNITS
from ..schemas import MC


def _pick(ratio: Column, mean: Column, std: Column, p2p: Column, trend: Column, of: dict[str, Column]) -> Column:
    """The first pattern that fits, in their fixed order of rules and thresholds."""
    lasting = ratio >= 0.75
    return (
        F.when(lasting & (F.abs(mean) > 2), of["sustained_offset"])
        .when(lasting & (std > 2.5), of["sustained_oscillation"])
        .when(lasting, of["persistent_anomaly"])
        .when((std > 3) | (p2p > 6), of["spike"])
        .when(F.abs(trend) > 1.5, of["drift"])
        .when(std > 1.8, of["oscillation"])
        .otherwise(of["subtle_deviation"])
    )


def classify_pattern(ratio: Column, mean: Column, std: Column, p2p: Column, trend: Column) -> Column:
    """P10"""
    return _pick(ratio, mean, std, p2p, trend, {k: F.lit(k) for k in PATTERN_ADVICE})


def pattern_desc(ratio: Column, mean: Column, std: Column, p2p: Column, trend: Column, shown: Callable[[Column], Column] = lambda x: x) -> Column:
    """The pattern as a clause; percent is cut off, not rounded. `shown` rounds what the clause tells; the pattern follows from the values themselves."""
    pct = (ratio * 100).cast("int")
    say = F.format_string
    return _pick(ratio, mean, std, p2p, trend, {
        "sustained_offset": say("persistent offset (mean=%.2fσ) throughout %d%% of the window", shown(mean), pct),
        "sustained_oscillation": say("high-amplitude oscillation (σ=%.2f) over %d%% of the window", shown(std), pct),
        "persistent_anomaly": say("anomalous behaviour across %d%% of the window", pct),
        "spike": say("transient spike (peak-to-peak=%.2fσ, %d%% of window flagged)", shown(p2p), pct),
        "drift": say("monotonic %s drift (Δ=%.2fσ across window)", F.when(trend > 0, "upward").otherwise("downward"), shown(trend)),
        "oscillation": say("elevated variability (σ=%.2f) with %d%% anomalous timesteps", shown(std), pct),
        "subtle_deviation": say("subtle deviation (%d%% of timesteps outside nominal envelope)", pct),
    })


def severity(ratio: Column) -> Column:
    """P12"""
    return F.when(ratio >= 0.5, "high").when(ratio >= 0.15, "medium").otherwise("low")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def lookup_names(df: DataFrame) -> DataFrame:
    """Names of subsystem and unit, with words of the raw name where unknown; advice and action where pattern and severity stand."""
    words = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    out = df.withColumn("subsystem", F.coalesce(_lookup(SUBSYSTEMS, F.col("subsystem")), F.initcap(words("subsystem"))))
    out = out.withColumn("physical_unit", F.coalesce(_lookup(UNITS, F.col("physical_unit")), words("physical_unit")))
    if {"pattern", "severity"} <= set(df.columns):
        out = out.withColumn("pattern_advice", _lookup(PATTERN_ADVICE, F.col("pattern"))).withColumn("recommended_action", _lookup(SEVERITY_ACTION, F.col("severity")))
    return out


def anomaly_id(mission: Column, channel: Column, start_time: Column) -> Column:
    """start_time is text."""
    return F.concat_ws("__", mission, channel, F.replace(start_time, F.lit(" "), F.lit("T")))


def with_channel_meta(df: DataFrame, channels: DataFrame) -> DataFrame:
    """The catalogue's columns on each row, unknown or ? where the channel isn't listed."""
    meta = channels.select(*MC, "subsystem", "physical_unit", "grp")
    return df.join(meta, MC, "left").withColumns({"subsystem": F.coalesce("subsystem", F.lit("unknown")), "physical_unit": F.coalesce("physical_unit", F.lit("unknown")), "grp": F.coalesce(F.col("grp").cast("string"), F.lit("?"))})


def make_advice(windows: DataFrame, channels: DataFrame) -> DataFrame:
    """Advice records of anomalous windows that carry mean, std, p2p and trend."""
    shape = [F.col(c) for c in ("anomaly_ratio", "mean", "std", "p2p", "trend")]
    rows = with_channel_meta(windows.where("is_anomaly"), channels)
    rows = rows.withColumns({"pattern": classify_pattern(*shape), "severity": severity(F.col("anomaly_ratio")), "desc": pattern_desc(*shape)})
    rows = lookup_names(rows)
    text = F.concat(F.col("subsystem"), F.lit(" channel "), F.col("channel"), F.lit(" (group "), F.col("grp"), F.lit(", "), F.col("physical_unit"), F.lit(") shows "), F.col("desc"), F.lit(". "), F.col("pattern_advice"))
    stamp = "yyyy-MM-dd HH:mm:ss"
    start, end = F.date_format("start_time", stamp), F.date_format("end_time", stamp)
    return rows.select(
        anomaly_id(F.col("mission"), F.col("channel"), start).alias("anomaly_id"), *MC, "start_idx", "subsystem", "physical_unit", "grp", start.alias("start_time"), end.alias("end_time"),
        "anomaly_ratio", "pattern", "severity", text.alias("advice"), "recommended_action",
    )


def dedupe_advice(advice: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each id."""
    return advice.withColumn("_k", F.row_number().over(Window.partitionBy("anomaly_id").orderBy(*order))).where("_k = 1").drop("_k")


def enrich_response(response: Column, pattern: Column, severity_: Column, advice: Column, action: Column) -> Column:
    """The response with its three advice lines, unchanged where there is no advice."""
    title = F.upper(F.replace(pattern, F.lit("_"), F.lit(" ")))
    lines = F.concat(response, F.lit("\n\nDIAGNOSIS: "), title, F.lit(" (severity: "), severity_, F.lit(")\nADVICE: "), advice, F.lit("\nACTION: "), action)
    return F.when(advice.isNull(), response).otherwise(lines)


def attach_advice(records: DataFrame, advice: DataFrame) -> DataFrame:
    """Enriched response, severity and pattern on anomalous records, by anomaly_id; others keep their response. Only anomalous records, which a read
    of their own finds, meet advice: the others have nothing to meet it by and would all be dealt to one task."""
    side = advice.select(F.col("anomaly_id").alias("_id"), "severity", "pattern", "advice", "recommended_action")
    meets = F.coalesce(F.col("is_anomaly"), F.lit(False)) & F.col("anomaly_id").isNotNull()
    out = records.where(meets).withColumn("_id", F.col("anomaly_id")).join(side, "_id", "left").drop("_id")
    out = out.withColumn("response", enrich_response(F.col("response"), F.col("pattern"), F.col("severity"), F.col("advice"), F.col("recommended_action"))).drop("advice", "recommended_action")
    return out.unionByName(records.where(~meets), allowMissingColumns=True)


def advice_counts(advice: DataFrame, by: str) -> DataFrame:
    """A10"""
    return advice.groupBy(F.col(by)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
