"""Schemas of the tables that the jobs exchange."""

TELEMETRY = "mission string, channel string, ts timestamp, value double, raw string"
CHANNELS = "mission string, channel string, ordinal int, subsystem string, physical_unit string, grp string, target string"
INTERVALS = "mission string, id string, channel string, start_time timestamp, end_time timestamp"
RECORD = (
    "instruction string, response string, metadata struct<mission: string, channel: string, start_idx: int, end_idx: int, "
    "start_time: string, end_time: string, is_anomaly: boolean, anomaly_ratio: double, values: array<double>>"
)
ERRORS = "mission string, channel string, i int, start_idx int, error double, is_anomaly boolean"

MC = ["mission", "channel"]
