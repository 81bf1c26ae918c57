"""The plant's rules, one row after the other, as the tests' second opinion."""

import math

LIMITS = [("avg_temp_c", "HIGH_TEMP", 75, 88, 1), ("avg_vib_mm_s", "HIGH_VIB", 4, 7, 1), ("avg_current_a", "HIGH_CURRENT", 25, 30, 1), ("avg_flow_m3h", "LOW_FLOW", 85, 70, -1), ("avg_pressure_bar", "LOW_PRESSURE", 6.5, 5.5, -1)]
POINTS = {"TEMP_DRIFT": (12, 20), "VIB_DRIFT": (15, 25), "CURRENT_DRIFT": (8, 14), "VIB_SPIKE": (18, 30), "FLOW_DROP": (12, 20)}


def limits(fact):
    out = []
    for column, kind, warn, crit, sign in LIMITS:
        v = fact[column]
        if v is not None and sign * v > sign * crit:
            out.append((kind, 2))
        elif v is not None and sign * v > sign * warn:
            out.append((kind, 1))
    return out


def limit_risk(fact, weight):
    found = limits(fact)
    score = min(round(sum(10 * s for _, s in found) * weight), 100)
    level = "CRITICAL" if score >= 90 else "HIGH" if score >= 70 else "MEDIUM" if score >= 30 else "LOW"
    return float(score), level, found[0][0] if found else None, ",".join(k for k, _ in found) or None


def hybrid(rows, t):
    """rows: gated feature dicts of one asset by minute number; [(minute, type, score, severity)]."""
    out, by = [], sorted(rows, key=lambda r: r["m"])
    for i, cur in enumerate(by):
        back = [r for r in by[:i] if cur["m"] - t.lookback_minutes <= r["m"]]
        if (cur["run_minutes_60m"] or 0) < t.min_run_minutes or len(back) < t.min_rows_for_baseline:
            continue
        for p, spike, drift in (("vib", "VIB_SPIKE", "VIB_DRIFT"), ("temp", "TEMP_HIGH", "TEMP_DRIFT"), ("current", "CURRENT_HIGH", "CURRENT_DRIFT")):
            xs = [r[f"{p}_avg_15m"] for r in back if r[f"{p}_avg_15m"] is not None]
            if cur[f"{p}_avg_15m"] is not None and len(xs) >= t.min_rows_for_baseline:
                mean = sum(xs) / len(xs)
                std = math.sqrt(sum((x - mean) ** 2 for x in xs) / (len(xs) - 1)) if len(xs) > 1 else 0.0
                z = (cur[f"{p}_avg_15m"] - mean) / max(std, getattr(t, f"{p}_std_eps"))
                if z >= t.z_warn:
                    out.append((cur["m"], spike, z, 3 if z >= t.z_severe else 2))
            k = max(2, t.drift_minutes)
            last = [*back[-(k - 1) :], cur]
            slopes = [r[f"{p}_slope_15m"] for r in last]
            if len(last) == k and all(b["m"] - a["m"] == 1 for a, b in zip(last, last[1:])) and None not in slopes and min(slopes) >= getattr(t, f"{p}_drift_slope"):
                out.append((cur["m"], drift, sum(slopes) / k, 3 if min(slopes) >= getattr(t, f"{p}_severe_slope") else 2))
        drop = cur["flow_drop_pct_15m"]
        if drop is not None and drop <= t.flow_drop:
            out.append((cur["m"], "FLOW_DROP", drop, 3 if drop <= t.flow_drop_severe else 2))
    return out


def decay(anomalies, minute, width=30):
    """anomalies: (minute, type, severity) of one asset."""
    score, counts, first = 0.0, {}, {}
    for m, kind, severity in anomalies:
        age = minute - m
        if 0 <= age < width:
            two, three = POINTS.get(kind, (5, 5))
            score += (three if severity >= 3 else two) * (1 - age / width)
            counts[kind] = counts.get(kind, 0) + 1
            first[kind] = min(first.get(kind, m), m)
    score = max(0, min(round(score), 100))
    level = "LOW" if score <= 29 else "MED" if score <= 69 else "HIGH"
    flow, current = "FLOW_DROP" in counts, "CURRENT_DRIFT" in counts or "CURRENT_HIGH" in counts
    mode = None
    if "TEMP_DRIFT" in counts and "VIB_DRIFT" in counts:
        mode = "BEARING_WEAR"
    elif flow and ("VIB_SPIKE" in counts or "VIB_DRIFT" in counts):
        mode = "CAVITATION"
    elif flow and current:
        mode = "OVERLOAD"
    top = sorted(counts, key=lambda k: (-counts[k], first[k], k))[:3]
    return score, level, mode, ", ".join(f"{k}x{counts[k]}" for k in top)
