"""Rule constants, as frozen values that every operator takes as an argument.

Tags, limits, thresholds, points, rule and family names, priorities,
confidences, titles and descriptions are fixed values: results must match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

GOOD_QUALITY = 192
#: Telemetry tag -> column of the minute fact.
SIGNALS = {
    "temp_bearing_c": "avg_temp_c",
    "vib_rms_mm_s": "avg_vib_mm_s",
    "discharge_pressure_bar": "avg_pressure_bar",
    "motor_current_a": "avg_current_a",
    "flow_rate_m3_h": "avg_flow_m3h",
}


@dataclass(frozen=True)
class Limit:
    """A fixed limit on a minute average; ``below`` turns the side around."""

    column: str
    tag: str
    anomaly_type: str
    warn: float
    crit: float
    below: bool = False


#: In rule order.
LIMITS = (
    Limit("avg_temp_c", "temp_bearing_c", "HIGH_TEMP", 75.0, 88.0),
    Limit("avg_vib_mm_s", "vib_rms_mm_s", "HIGH_VIB", 4.0, 7.0),
    Limit("avg_current_a", "motor_current_a", "HIGH_CURRENT", 25.0, 30.0),
    Limit("avg_flow_m3h", "flow_rate_m3_h", "LOW_FLOW", 85.0, 70.0, True),
    Limit("avg_pressure_bar", "discharge_pressure_bar", "LOW_PRESSURE", 6.5, 5.5, True),
)


@dataclass(frozen=True)
class HybridThresholds:
    """Limits of the statistical detector; the defaults are the code's."""

    min_run_minutes: int = 5
    min_rows_for_baseline: int = 6
    lookback_minutes: int = 10
    z_warn: float = 3.0
    z_severe: float = 4.0
    vib_std_eps: float = 0.05
    temp_std_eps: float = 0.50
    current_std_eps: float = 0.20
    drift_minutes: int = 3
    vib_drift_slope: float = 0.05
    vib_severe_slope: float = 0.10
    temp_drift_slope: float = 0.10
    temp_severe_slope: float = 0.20
    current_drift_slope: float = 0.05
    current_severe_slope: float = 0.10
    flow_drop: float = -0.10
    flow_drop_severe: float = -0.20


CODE_HYBRID = HybridThresholds()
DEPLOYED_HYBRID = HybridThresholds(3, 5, 10, 3.0, 4.0, 0.05, 0.50, 0.20, 3, 0.025, 0.05, 0.06, 0.10, 0.015, 0.03)


@dataclass(frozen=True)
class RiskOptions:
    """Decay policy: points by (type, severity 2 / 3 and up), others ``other``."""

    window_minutes: int = 30
    low_max: int = 29
    med_max: int = 69
    points: dict = field(default_factory=lambda: {"TEMP_DRIFT": (12, 20), "VIB_DRIFT": (15, 25), "CURRENT_DRIFT": (8, 14), "VIB_SPIKE": (18, 30), "FLOW_DROP": (12, 20)})
    other: int = 5
    evidence_rows: int = 50


@dataclass(frozen=True)
class Rule:
    """A recommendation for a failure mode at a risk level; None is any other."""

    mode: str | None
    level: str | None
    rec_type: str
    priority: int
    confidence: str
    title: str
    description: str


_BEARING_HIGH = "High bearing wear risk detected. Schedule maintenance within 72 hours. Verify lubrication, alignment, and bearing condition. Consider reducing load until serviced."
_BEARING_MED = "Moderate bearing wear trend detected. Inspect lubrication, coupling alignment, and bearing housing temperature on the next shift. Plan parts if trend persists."
_CAVITATION = "Signs consistent with cavitation. Check suction pressure/NPSH margin, ensure inlet valve is fully open, look for air ingress, and verify strainer condition."
_OVERLOAD = "Load trend suggests overload. Verify process demand, valve position, discharge pressure, and check for fouling. Consider reducing throughput until verified."
_GENERAL = "High risk detected without a confident failure mode. Inspect bearing temp, vibration, coupling, lubrication, and review recent operating conditions."
#: In the order in which they are tried.
RULES = (
    Rule("BEARING_WEAR", "HIGH", "BEARING_SCHEDULE_MAINT", 1, "0.92", "Schedule bearing inspection/replacement (72h)", _BEARING_HIGH),
    Rule("BEARING_WEAR", "MED", "BEARING_INSPECTION", 2, "0.80", "Inspect lubrication and alignment (next shift)", _BEARING_MED),
    Rule("CAVITATION", "HIGH", "CAVITATION_CHECK", 1, "0.85", "Check suction conditions (cavitation suspected)", _CAVITATION),
    Rule("CAVITATION", None, "CAVITATION_CHECK", 2, "0.70", "Check suction conditions (cavitation suspected)", _CAVITATION),
    Rule("OVERLOAD", "HIGH", "OVERLOAD_REDUCE_LOAD", 1, "0.82", "Investigate overload / reduce load", _OVERLOAD),
    Rule("OVERLOAD", None, "OVERLOAD_REDUCE_LOAD", 2, "0.68", "Investigate overload / reduce load", _OVERLOAD),
    Rule(None, "HIGH", "GENERAL_INSPECTION", 2, "0.60", "Perform general inspection (high risk)", _GENERAL),
)
KNOWN_MODES = ("BEARING_WEAR", "CAVITATION", "OVERLOAD")
FAMILIES = {"BEARING_WEAR": "BEARING_", "CAVITATION": "CAVITATION_", "OVERLOAD": "OVERLOAD_"}
GENERAL_FAMILY = "GENERAL_"
COOLDOWN_HOURS = {"HIGH": 12, "MED": 24, "LOW": 48}
