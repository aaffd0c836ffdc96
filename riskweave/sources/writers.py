"""Writers. Spark's committer makes each write atomic; size limits per file
replace log rolling."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_events(events: DataFrame, path: str, *, max_records_per_file: int = 1_000_000) -> None:
    """Appends guard events as compact JSON lines."""
    events.write.mode("append").option("maxRecordsPerFile", max_records_per_file).json(path)


def write_report(findings: DataFrame, path: str, *, partition_by: str, fmt: str = "parquet") -> None:
    """Writes a report split by verdict or severity."""
    findings.write.mode("overwrite").partitionBy(partition_by).format(fmt).save(path)


def write_metric_lines(lines: DataFrame, path: str) -> None:
    """Writes `metric_lines`, a dozen rows, as one text file."""
    lines.orderBy("pos").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_chat_export(records: DataFrame, path: str) -> None:
    """Writes `chat_export` rows as JSON lines."""
    records.select("record").write.mode("overwrite").text(path)
