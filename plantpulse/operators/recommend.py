"""Recommendations from current risk, and their open/acknowledged/closed life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantpulse import schemas
from plantpulse.config import COOLDOWN_HOURS, FAMILIES, GENERAL_FAMILY, KNOWN_MODES, RULES
from plantpulse.functions.columns import band
from plantpulse.sources.sinks import latest_per_key

MODE = "coalesce(failure_mode, 'UNKNOWN')"


def score_band(score: Column) -> Column:
    return band(score, [30, 70, 90], ["0-29", "30-69", "70-89", "90+"])


def fingerprint() -> Column:
    """mode|level|band|drivers of a risk row."""
    return F.concat_ws("|", F.expr(MODE), "risk_level", score_band(F.col("risk_score")), F.trim(F.coalesce("top_drivers", F.lit(""))))


def family(mode: Column) -> Column:
    out = F.lit(GENERAL_FAMILY)
    for m, prefix in FAMILIES.items():
        out = F.when(mode == m, prefix).otherwise(out)
    return out


def recommend(risk: DataFrame) -> DataFrame:
    """At most one recommendation for each row of current risk.

    ``risk``: asset_id, as_of_minute_ts, risk_score, risk_level, failure_mode,
    top_drivers.
    """
    mode, chosen = F.expr(MODE), F.lit(None)
    for r in reversed(RULES):
        when = (mode == r.mode) if r.mode else ~mode.isin(*KNOWN_MODES)
        if r.level:
            when &= F.col("risk_level") == r.level
        value = F.struct(F.lit(r.rec_type).alias("rec_type"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).cast("decimal(7,4)").alias("confidence"), F.lit(r.title).alias("title"), F.lit(r.description).alias("description"))
        chosen = F.when(when, value).otherwise(chosen)
    hours = F.lit(COOLDOWN_HOURS["LOW"])
    for level in ("MED", "HIGH"):
        hours = F.when(F.col("risk_level") == level, COOLDOWN_HOURS[level]).otherwise(hours)
    drivers = F.coalesce("top_drivers", F.lit(""))
    evidence = F.struct(mode.alias("mode"), F.col("risk_score").cast("int").alias("risk_score"), F.col("risk_level"), drivers.alias("drivers"), *[F.lit(None).cast("string").alias(c) for c in ("ack_note", "acked_by", "close_reason", "closed_by")])
    return (
        risk.withColumn("__r", chosen)
        .filter("__r is not null")
        .select(
            "asset_id", "as_of_minute_ts", F.col("__r.rec_type").alias("rec_type"), F.col("__r.priority").alias("priority"), F.col("__r.title").alias("title"), F.col("__r.description").alias("description"), F.col("__r.confidence").alias("confidence"),
            drivers.alias("drivers"), evidence.alias("evidence"), (F.col("as_of_minute_ts") + F.make_dt_interval(F.lit(0), hours)).alias("cooldown_until"), fingerprint().alias("state_fingerprint"),
        )
    )


def write_evidence(recs: DataFrame) -> DataFrame:
    """Recommendations with their evidence and its notes as ``evidence_json`` text."""
    return recs.withColumn("evidence_json", F.to_json("evidence")).drop("evidence")


def read_evidence(recs: DataFrame) -> DataFrame:
    """The typed ``evidence`` of stored text; text that is no JSON gives null."""
    kind = StructType.fromDDL(schemas.RECOMMENDATIONS)["evidence"].dataType
    return recs.withColumn("evidence", F.when(F.try_parse_json("evidence_json").isNotNull(), F.from_json("evidence_json", kind))).drop("evidence_json")


def recommendation_id(asset: str = "asset_id", rec_type: str = "rec_type", as_of: str = "as_of_minute_ts", state: str = "state_fingerprint") -> Column:
    """A stable identity: the same state of the same minute has the same one."""
    return F.xxhash64(asset, rec_type, F.unix_micros(as_of), state)


def _closed(recs: DataFrame, when: Column, reason: Column, by: Column, now: Column) -> DataFrame:
    """Rows that match become CLOSED, others stay."""
    evidence = F.col("evidence").withField("close_reason", reason).withField("closed_by", by)
    change = {"status": F.lit("CLOSED"), "closed_at": now, "closed_by": by, "updated_at": now, "evidence": evidence}
    return recs.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in change.items()})


def reconcile(recs: DataFrame, risk: DataFrame, now) -> DataFrame:
    """The recommendation table after one snapshot of current risk.

    ``risk`` has one row an asset.  Resolved assets (LOW, under 30 or without
    a mode) get all their active recommendations closed.  Of the others, a
    candidate is skipped while its newest active one is acknowledged into the
    future or has the same fingerprint; else that one is closed, and those of
    its former family if the mode's family changed, and the candidate opens.
    """
    now = F.lit(now).cast("timestamp")
    mode = F.expr(MODE)
    resolved = (F.col("risk_level") == "LOW") | (F.col("risk_score") < 30) | (mode == "UNKNOWN")
    state = risk.withColumns({"__resolved": resolved, "__why": F.concat(F.lit("Auto-closed (resolved): state="), "risk_level", F.lit("/"), F.col("risk_score").cast("int").cast("string"), F.lit(", mode="), mode, F.lit("."))})
    candidates = recommend(state.filter(~F.col("__resolved"))).withColumn("__mode", F.col("evidence.mode"))
    active = latest_per_key(recs.filter("status <> 'CLOSED'"), ["asset_id", "rec_type"], F.col("created_at").desc(), F.col("recommendation_id").desc())
    held = active.select("asset_id", "rec_type", F.col("recommendation_id").alias("__id"), F.col("status").alias("__status"), F.col("ack_until").alias("__ack"), F.col("state_fingerprint").alias("__fp"))
    paired = candidates.join(held, ["asset_id", "rec_type"], "left")
    waits = (F.col("__status") == "ACKED") & (F.col("as_of_minute_ts") < F.col("__ack"))
    same = F.upper("__fp") == F.upper("state_fingerprint")
    was = family(F.upper(F.split("__fp", r"\|")[0]))
    turned = F.when(F.col("__id").isNotNull() & (was != family(F.col("__mode"))), was)
    decided = paired.withColumns({"__skip": F.coalesce(waits, F.lit(False)) | F.coalesce(same, F.lit(False)), "__turned": turned})
    # what to close: everything of resolved assets, replaced ones, families left behind
    calm = state.filter("__resolved").select("asset_id", "__why")
    replaced = decided.filter("not __skip and __id is not null").select(F.col("__id").alias("recommendation_id"), F.lit(True).alias("__replaced"))
    left = decided.filter("__turned is not null").select("asset_id", F.col("__turned").alias("__family"), F.concat(F.lit("Auto-closed because failure mode changed to "), "__mode", F.lit(".")).alias("__turn_why")).dropDuplicates(["asset_id"])
    joined = recs.join(calm, "asset_id", "left").join(replaced, "recommendation_id", "left").join(left, "asset_id", "left")
    open_ = F.col("status") != "CLOSED"
    known = sum((F.col("rec_type").startswith(p).cast("int") for p in (*FAMILIES.values(), GENERAL_FAMILY)), F.lit(0)) > 0
    by_calm = open_ & F.col("__why").isNotNull() & known
    by_turn = open_ & F.col("__family").isNotNull() & F.col("rec_type").startswith(F.col("__family"))
    close = by_calm | F.coalesce(by_turn, F.lit(False)) | (open_ & F.coalesce("__replaced", F.lit(False)))
    reason = F.coalesce("__why", F.when(F.coalesce(by_turn, F.lit(False)), F.col("__turn_why")), F.lit("Replaced by a newer state."))
    closed = _closed(joined, close, reason, F.lit("system"), now).select(*recs.columns)
    none = F.lit(None)
    fresh = decided.filter("not __skip").withColumns({"recommendation_id": recommendation_id(), "status": F.lit("OPEN"), "ack_until": none.cast("timestamp"), "closed_at": none.cast("timestamp"), "closed_by": none.cast("string"), "created_at": now, "updated_at": now})
    fresh = fresh.select(*recs.columns).join(recs.select("recommendation_id"), "recommendation_id", "left_anti")
    return closed.unionByName(fresh.select(*recs.columns))


def apply_commands(recs: DataFrame, commands: DataFrame, now) -> DataFrame:
    """Acknowledge and close by command; one command an id and call.

    An ack (default: one day) takes open and acknowledged rows, a close takes
    rows not closed; other commands change nothing.  Of several commands of an
    id a close comes before an ack, then the longest ack, then the least name
    and note.
    """
    now = F.lit(now).cast("timestamp")
    action = F.upper("action")
    ranked = F.struct(F.when(action == "CLOSE", 0).when(action == "ACK", 1).otherwise(2).alias("rank"), (-F.coalesce(F.unix_micros("ack_until"), F.lit(0))).alias("less"), action.alias("action"), "by", "note_or_reason", "ack_until")
    c = commands.groupBy("recommendation_id").agg(F.min(ranked).alias("c"))
    c = c.select("recommendation_id", F.col("c.action").alias("__action"), F.col("c.by").alias("__by"), F.col("c.note_or_reason").alias("__note"), F.col("c.ack_until").alias("__until"))
    d = recs.join(c, "recommendation_id", "left")
    ack = F.coalesce((F.col("__action") == "ACK") & F.col("status").isin("OPEN", "ACKED"), F.lit(False))
    close = F.coalesce((F.col("__action") == "CLOSE") & (F.col("status") != "CLOSED"), F.lit(False))
    acked = {
        "status": F.lit("ACKED"), "ack_until": F.coalesce("__until", now + F.expr("interval 1 day")), "updated_at": now,
        "evidence": F.col("evidence").withField("ack_note", F.col("__note")).withField("acked_by", F.col("__by")),
    }
    d = d.withColumn("__close", close).withColumns({k: F.when(ack, v).otherwise(F.col(k)) for k, v in acked.items()})
    return _closed(d, F.col("__close"), F.col("__note"), F.col("__by"), now).select(*recs.columns)


def close_all(recs: DataFrame, asset_ids: list[str], by: str, reason: str, now) -> DataFrame:
    """Close every active recommendation of some assets."""
    when = F.col("asset_id").isin(asset_ids) & (F.col("status") != "CLOSED")
    return _closed(recs, when, F.lit(reason), F.lit(by), F.lit(now).cast("timestamp"))
