"""Schemas of the inputs and stored tables."""

from __future__ import annotations

TELEMETRY = "asset_id string, asset_type string, ts string, tag string, value double, quality int"
PROFILES = "asset_id string, location string, asset_category string, manufacturer string, install_year int, rated_capacity_pct int, maintenance_interval_days int, criticality string, criticality_weight double"
RECOMMENDATIONS = (
    "recommendation_id bigint, asset_id string, as_of_minute_ts timestamp, rec_type string, priority int, title string, description string, status string, confidence decimal(7,4), "
    "drivers string, evidence struct<mode:string,risk_score:int,risk_level:string,drivers:string,ack_note:string,acked_by:string,close_reason:string,closed_by:string>, "
    "cooldown_until timestamp, state_fingerprint string, ack_until timestamp, closed_at timestamp, closed_by string, created_at timestamp, updated_at timestamp"
)
COMMANDS = "recommendation_id bigint, action string, by string, note_or_reason string, ack_until timestamp"
FACTS = "asset_id string, minute_ts timestamp, avg_temp_c double, avg_vib_mm_s double, avg_current_a double, avg_flow_m3h double, avg_pressure_bar double, event_count int, fault_code_max int"
