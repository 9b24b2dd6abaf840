"""Exports: JSON and CSV of the newest commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.functions.formats import csv_line
from echolith.operators.stats import recent

SUMMARY = ["command", "cwd", "exit_code", "duration_ms", "completed_at_ms", "session_id"]
HEADER = ",".join(SUMMARY)


def summary(history: DataFrame, limit: int | None = 100_000, tie: str = "content_hash") -> DataFrame:
    """The newest commands with the six columns of an export; all of them, in no order, if ``limit`` is None."""
    return (history if limit is None else recent(history, limit, tie)).select(*SUMMARY)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines; nulls are kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_document(rows: DataFrame) -> str:
    """One JSON array, for results that a person reads."""
    lines = [r[0] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).collect()]
    return "[\n" + ",\n".join("  " + line for line in lines) + "\n]" if lines else "[]"


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): quoted only where a comma, a quote or a line feed is inside."""
    return rows.select(csv_line(*SUMMARY).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    """Text files of such lines, each file with the header."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
