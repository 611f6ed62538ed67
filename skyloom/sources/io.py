"""Sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MC, RECORD


def mission_number(name: str = "mission") -> F.Column:
    return F.regexp_extract(name, r"(\d+)$", 1).cast("int")


def filter_missions(df: DataFrame, missions: str = "all") -> DataFrame:
    """Rows of the missions named by "all" or a comma list of numbers."""
    if missions == "all":
        return df
    return df.where(mission_number().isin([int(m) for m in missions.split(",")]))


def _mission_of(name: str) -> F.Column:
    """The folder that holds the file or folder `name`."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name}(?:/[^/]*)?$", 1)


def read_channels(spark: SparkSession, path: str, target_only: bool = True) -> DataFrame:
    """The channel catalogue of every <mission>/channels.csv (a file or a folder of parts, taken in order of their names) below path; ordinal is the place inside it."""
    read = spark.read.option("header", True).csv(f"{path}/*/channels.csv")
    out = read.select(
        _mission_of("channels.csv").alias("mission"), F.col("Channel").alias("channel"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"), F.col("Subsystem").alias("subsystem"),
        F.col("Physical Unit").alias("physical_unit"), F.col("Group").alias("grp"), F.col("Target").alias("target"),
    )
    out = out.withColumn("ordinal", F.row_number().over(Window.partitionBy("mission").orderBy("_at")) - 1).drop("_at")
    return targets(out) if target_only else out


def write_catalogue(df: DataFrame, path: str, name: str) -> None:
    """df as <mission>/<name> below path, for each of its few missions; CSV with a header."""
    for (mission,) in df.select("mission").distinct().collect():
        df.where(F.col("mission") == mission).drop("mission").coalesce(1).write.option("header", True).csv(f"{path}/{mission}/{name}")


def targets(channels: DataFrame) -> DataFrame:
    return channels.where(F.col("target") == "YES")


def cap_channels(channels: DataFrame, k: int) -> DataFrame:
    """S3: the first k channels of each mission in catalogue order."""
    w = Window.partitionBy("mission").orderBy("ordinal")
    return channels.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def restrict(telemetry: DataFrame, channels: DataFrame) -> DataFrame:
    """Telemetry of the wanted channels only. The catalogue has hundreds of rows; Spark broadcasts it by its size."""
    return telemetry.join(channels.select(*MC).distinct(), MC, "left_semi")


def read_telemetry(spark: SparkSession, path: str, channels: DataFrame) -> DataFrame:
    """Telemetry (ts, value[, raw]) below path as one table: <mission>/<channel>.parquet, files or folders, or folders
    mission=<mission>/channel=<channel>, or files with a column channel in folders mission=<mission>. Hidden and missing files are skipped.

    Timestamps may have any unit, nanoseconds included, but the same in all files; parts of a microsecond are cut off.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        read = files.parquet(path)
        ts, raw = F.col("ts").cast("timestamp"), F.col("raw") if "raw" in read.columns else F.lit(None)
        named = "channel" in read.columns
    except AnalysisException as error:
        if "NANOS" not in str(error):
            raise
        read = files.schema("ts long, value double, raw string").parquet(path)  # Spark has no type for them, but reads their numbers
        ts, raw, named = F.timestamp_micros(F.expr("(ts - pmod(ts, 1000)) div 1000")), F.col("raw"), False
    at = F.col("_metadata.file_path")
    folders, names = r"mission=([^/]+)/channel=([^/]+)/[^/]*$", r"([^/]+)/([^/]+)\.parquet(?:/[^/]*)?$"
    part = lambda i: F.when(at.rlike(folders), F.regexp_extract(at, folders, i)).otherwise(F.regexp_extract(at, names, i))
    mission = F.regexp_extract(at, r"mission=([^/]+)/", 1)
    mission, channel = (F.when(mission == "", part(1)).otherwise(mission), F.coalesce(F.col("channel"), part(2))) if named else (part(1), part(2))
    return restrict(read.select(mission.alias("mission"), channel.alias("channel"), ts.alias("ts"), "value", raw.cast("string").alias("raw")), channels)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """Every <mission>/labels.csv (ID, Channel, StartTime, EndTime, ISO-8601 with zone; a file or a folder of parts) below path."""
    read = spark.read.option("header", True).csv(f"{path}/*/labels.csv")
    return read.select(_mission_of("labels.csv").alias("mission"), F.col("ID").alias("id"), F.col("Channel").alias("channel"), F.to_timestamp("StartTime").alias("start_time"), F.to_timestamp("EndTime").alias("end_time"))


def write_records(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines, a folder for each split if there is a split column."""
    (df.write.partitionBy("split") if "split" in df.columns else df.write).mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_results(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows and their summary, each rewritten whole."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def pending(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose keys aren't among those done."""
    return units.join(done.select(*keys).distinct(), keys, "left_anti")


def split_dense(df: DataFrame, dense: str = "window_errors") -> tuple[DataFrame, DataFrame]:
    """Metrics without the dense array, and the array as one row per element (i from 0)."""
    slim = df.drop(dense)
    return slim, df.select(*MC, F.posexplode(dense).alias("i", "error"))
