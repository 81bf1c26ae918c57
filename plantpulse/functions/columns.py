"""Column helpers and argument checks of the serving queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(score: Column, cuts: list[float], labels: list[str]) -> Column:
    """The label of the last cut that the score reaches; below all, the first.

    ``labels`` has one more entry than the rising ``cuts``.
    """
    if len(labels) != len(cuts) + 1 or list(cuts) != sorted(cuts):
        raise ValueError("one more label than rising cuts")
    out = F.lit(labels[0])
    for cut, label in zip(cuts, labels[1:]):
        out = F.when(score >= cut, label).otherwise(out)
    return out


def ui_badge(score: Column) -> Column:
    return band(score, [50, 80], ["LOW", "MEDIUM", "HIGH"])


def dashboard_band(score: Column) -> Column:
    return band(score, [30, 70, 90], ["LOW", "MEDIUM", "HIGH", "CRITICAL"])


def severity_badge(severity: Column) -> Column:
    return band(severity, [3, 4], ["info", "warning", "critical"])


def half_even_score(x: Column, most: float = 100.0) -> Column:
    """Rounded to even at .5, clamped to 0..most."""
    return F.greatest(F.lit(0.0), F.least(F.bround(x, 0).cast("double"), F.lit(most)))


def minute_number(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 60).cast("bigint")


def between(ts: str, start, end) -> Column:
    """Half-open time range."""
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))


def clamp(value: int | None, default: int, most: int) -> int:
    return default if value is None else max(1, min(int(value), most))


def check_range(start, end) -> None:
    if end <= start:
        raise ValueError("'to' must be after 'from'")


def check_step(step: int) -> int:
    if step not in (1, 5, 15):
        raise ValueError("step must be 1, 5 or 15 minutes")
    return step


def normal_status(status: str | None, default: tuple[str, ...] | None = ("OPEN",)) -> tuple[str, ...] | None:
    """Statuses to keep; None keeps all.  ACTIVE is open and acknowledged."""
    if status is None or not status.strip():
        return default
    s = status.strip().upper()
    return ("OPEN", "ACKED") if s == "ACTIVE" else (s,)


REPLY = "headline string, summary string, what_changed array<string>, likely_causes array<string>, recommended_next_steps array<string>, confidence double, evidence_used array<string>, disclaimer string"


def normalise_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Model replies as typed rows, with defaults for whatever is missing or odd.

    The outermost braces are read; a property of another type counts as
    missing, array items that are no strings or blank are left out, and titles
    of ``recommendations`` stand in for missing next steps.
    """
    body = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)\{.*\}", 0)
    root = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>") if hasattr(F, "try_variant_get") else None
    v = F.try_parse_json(body)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    ok = root.isNotNull() & body.startswith("{")

    def string(name, default):
        return F.when(kind(f"$.{name}") == "STRING", F.try_variant_get(v, f"$.{name}", "string")).otherwise(default)

    def strings(name):
        items = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        texts = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
        return F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != ""))

    def title(x):
        get = lambda n: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{n}", "variant")) == "STRING", F.try_variant_get(x, f"$.{n}", "string"))
        return F.coalesce(get("Title"), get("title"))

    titles = F.filter(F.transform(F.coalesce(F.try_variant_get(v, "$.recommendations", "array<variant>"), F.array().cast("array<variant>")), title), lambda x: x.isNotNull() & (F.trim(x) != ""))
    steps = F.when(kind("$.recommended_next_steps").startswith("ARRAY"), strings("recommended_next_steps")).otherwise(titles)
    number = kind("$.confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    none = F.array().cast("array<string>")
    return replies.select(
        "*",
        F.when(ok, string("headline", F.lit("AI Insight"))).otherwise("Insight unavailable").alias("headline"),
        F.when(ok, string("summary", F.lit("No summary returned."))).otherwise("The insight engine returned invalid JSON.").alias("summary"),
        F.when(ok, strings("what_changed")).otherwise(none).alias("what_changed"),
        F.when(ok, strings("likely_causes")).otherwise(none).alias("likely_causes"),
        F.when(ok, steps).otherwise(none).alias("recommended_next_steps"),
        F.when(ok & number, F.try_variant_get(v, "$.confidence", "double")).otherwise(0.0).alias("confidence"),
        F.when(ok, strings("evidence_used")).otherwise(F.array(F.lit("llm_parse_error"))).alias("evidence_used"),
        F.when(ok, string("disclaimer", F.lit("Generated output may be imperfect; verify against source data."))).otherwise("Generated text may be imperfect; verify against underlying signals.").alias("disclaimer"),
    )
