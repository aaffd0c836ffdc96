"""Guard events: validity, counts, tails, health and metric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import contexts as values

EVENT_SCHEMA = (
    "ts timestamp, command string, argument_count int, wrapped_exit int, guard_exit int, "
    "verdict string, reasons array<string>"
)


def checked_protocol(df: DataFrame) -> DataFrame:
    """Applies the guard protocol to rows with ``allowed, verdict, code, reasons,
    warning, exit_code``: a row whose fields disagree becomes dangerous."""
    expected = F.lit(False)
    for code, action in enumerate(values.ACTIONS):
        expected = expected | (
            (F.col("verdict") == action) & (F.col("code") == code) & (F.col("allowed") == F.lit(code == 0))
            & (F.col("exit_code") == F.lit(0 if code == 0 else 2)))
    complete = F.col("reasons").isNotNull() & ~F.exists("reasons", lambda r: r.isNull()) & F.col("warning").isNotNull()
    valid = F.coalesce(expected & complete, F.lit(False))
    return df.withColumns({
        "valid": valid,
        "verdict": F.when(valid, F.col("verdict")).otherwise("DANGEROUS"),
        "reasons": F.when(valid, F.col("reasons")).otherwise(F.array(F.lit(values.PROTOCOL_ERROR_REASON))),
        "exit_code": F.when(valid, F.col("exit_code")).otherwise(2),
    })


def _is(action: str) -> Column:
    return F.coalesce(F.col("verdict") == action, F.lit(False))


def event_metrics(events: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """Events in total and by verdict; an unknown verdict counts as safe."""
    counted = events.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(_is("SUSPICIOUS")).alias("suspicious"),
        F.count_if(_is("DANGEROUS")).alias("dangerous"))
    safe = F.col("total") - F.col("suspicious") - F.col("dangerous")
    return counted.select(*by, "total", safe.alias("safe"), "suspicious", "dangerous")


def verdict_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict")).agg(F.count("*").alias("events"))


def tail(events: DataFrame, n: int, *, order: list[str]) -> DataFrame:
    """The last ``n`` events of the whole log, newest first (top-n, no full sort)."""
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def _shown(column: str, chars: int | None) -> Column:
    return F.col(column) if chars is None else F.left(column, F.lit(chars)).alias(column)


def event_status(events: DataFrame, *, order: list[str], n: int = 5, command_chars: int | None = None) -> DataFrame:
    """The last events as a report prints them; ``command_chars`` cuts commands (60 as published)."""
    return tail(events, n, order=order).select(
        *order, F.coalesce("verdict", F.lit("?")).alias("verdict"), _shown("command", command_chars),
        F.coalesce(F.nullif(F.array_join("reasons", ", "), F.lit("")), F.lit("none")).alias("reasons"))


def incidents(events: DataFrame, *, order: list[str], n: int = 10, command_chars: int | None = None) -> DataFrame:
    """The last dangerous events as a report prints them; ``command_chars`` cuts commands (80 as published)."""
    return tail(events.filter(_is("DANGEROUS")), n, order=order).select(
        *order, _shown("command", command_chars),
        F.coalesce(F.nullif(F.array_join("reasons", ", "), F.lit("")), F.lit("none")).alias("reasons"))


def event_health(events: DataFrame, *, order: list[str], n: int = 10, threshold: int = 3) -> DataFrame:
    """One row: health judged by the last ``n`` events."""
    last = tail(events, n, order=order).agg(
        F.count("*").alias("recent"), F.count_if(_is("DANGEROUS")).alias("recent_dangerous"))
    return last.withColumn("health", F.when(
        (F.col("recent") >= 3) & (F.col("recent_dangerous") >= threshold), "DEGRADED")
        .when(F.col("recent_dangerous") > 0, "WARN").otherwise("HEALTHY"))


def metric_lines(metrics: DataFrame, *, circuit_open: bool = False, prefix: str = "guard") -> DataFrame:
    """`event_metrics` without groups as Prometheus text, one line per row in order."""
    def line(text, *args):
        return F.format_string(text, *args)

    rows = [
        F.lit(f"# HELP {prefix}_events_total Total guard events."),
        F.lit(f"# TYPE {prefix}_events_total counter"),
        line(f"{prefix}_events_total %d", F.col("total")),
        F.lit(f"# HELP {prefix}_events_by_verdict Guard events by verdict."),
        F.lit(f"# TYPE {prefix}_events_by_verdict gauge"),
        *[line(f'{prefix}_events_by_verdict{{verdict="{name}"}} %d', F.col(name.lower())) for name in values.ACTIONS],
        F.lit(f"# HELP {prefix}_circuit_open Whether the circuit breaker is open."),
        F.lit(f"# TYPE {prefix}_circuit_open gauge"),
        F.lit(f"{prefix}_circuit_open {int(circuit_open)}"),
    ]
    return metrics.select(F.posexplode(F.array(*rows)).alias("pos", "value"))
