"""Names, sentences and thresholds that results must carry exactly."""

SUBSYSTEMS = {
    "subsystem_1": "Power Subsystem",
    "subsystem_2": "Attitude & Orbit Control",
    "subsystem_3": "Thermal Control",
    "subsystem_4": "Payload / Instruments",
    "subsystem_5": "Telemetry & Data Handling",
    "subsystem_6": "Propulsion",
    "subsystem_7": "Command & Control",
    "subsystem_8": "Structure & Mechanisms",
    "subsystem_9": "Communications",
    "subsystem_10": "Electrical Power Distribution",
}
UNITS = {
    "physical_unit_1": "voltage (V)",
    "physical_unit_2": "current (A)",
    "physical_unit_3": "temperature (°C)",
    "physical_unit_4": "pressure (Pa)",
    "physical_unit_5": "angular rate (°/s)",
    "physical_unit_6": "quaternion component",
    "physical_unit_7": "power (W)",
    "physical_unit_8": "binary state",
    "physical_unit_9": "frequency (Hz)",
    "physical_unit_10": "flux",
    "physical_unit_11": "acceleration (m/s²)",
    "physical_unit_12": "magnetic field (T)",
}
PATTERN_ADVICE = {
    "sustained_offset": "Channel has drifted to a persistent off-nominal level. Check sensor calibration or zero-point drift. Verify reference baseline against housekeeping archive.",
    "sustained_oscillation": "Channel shows high-amplitude periodic oscillation. Investigate control-loop instability or coupling from an adjacent subsystem.",
    "persistent_anomaly": "Channel exhibits prolonged off-nominal behaviour. Cross-check with adjacent channels in the same subsystem group for correlated faults.",
    "spike": "Transient spike detected. Likely causes include electrostatic discharge, single-event upset, or a brief external stimulus. Monitor for recurrence.",
    "drift": "Monotonic trend indicates gradual degradation or environmental shift. Evaluate long-term trends and compare against expected mission lifecycle profile.",
    "oscillation": "Elevated variability suggests intermittent noise source or unstable operating point. Check for loose connections, vibration coupling, or thermal cycling effects.",
    "subtle_deviation": "Low-amplitude deviation from nominal envelope. Could be sensor noise floor increase, minor calibration shift, or early-stage degradation. Log and monitor.",
}
SEVERITY_ACTION = {
    "high": "Escalate to mission operations. Consider safing the affected subsystem pending investigation.",
    "medium": "Schedule inspection at next ground contact. Cross-correlate with event log and FDIR records.",
    "low": "Flag for trend monitoring. Review at next routine housekeeping downlink.",
}
ANOMALY_RESPONSE = "ANOMALY DETECTED. This sequence shows abnormal patterns that deviate from expected operational behavior."
NOMINAL_RESPONSE = "NOMINAL. This sequence shows normal operational behavior within expected parameters."
QUESTION = "Determine if this sequence shows anomalous behavior and explain your reasoning."
SYSTEM_PROMPT = "You are a spacecraft telemetry analyst. Analyze telemetry sequences and identify anomalies. When an anomaly is detected, provide a diagnosis, diagnostic advice, and a recommended action to help engineers resolve the issue."
VISION_PROMPT = "This is a plot of a spacecraft telemetry sequence (normalized value vs. timestep). Does it show anomalous behaviour? Answer with ANOMALY DETECTED or NOMINAL."
TURN, END_TURN = "<|im_start|>", "<|im_end|>"
Z_GRID = (2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0)
