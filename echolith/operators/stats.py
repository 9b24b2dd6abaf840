"""Counts and metrics of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.functions import filters


def recent(history: DataFrame, n: int, tie: str = "content_hash") -> DataFrame:
    """The newest rows."""
    return history.orderBy(F.desc("completed_at_ms"), tie).limit(n)


def recent_as_results(history: DataFrame, n: int, tie: str = "content_hash") -> DataFrame:
    """What an empty query shows: the newest rows as exact hits."""
    return recent(history, n, tie).withColumns({"match_kind": F.lit("exact"), "score": F.lit(1.0), "source": F.lit("FTS")})


def usage_stats(history: DataFrame, sessions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: total, unique and repeated commands, saved runs, sessions. ``approximate`` counts unique ones by a sketch."""
    unique = F.approx_count_distinct("normalized_command") if approximate else F.count_distinct("normalized_command")
    mine = history.agg(
        F.count("*").alias("total_commands"), unique.alias("unique_commands"), F.count_if(F.col("run_count") > 1).alias("deduplicated_commands"),
        F.coalesce(F.sum(F.when(F.col("run_count") > 1, F.col("run_count") - 1)), F.lit(0)).cast("bigint").alias("saved_runs"),
    )
    return mine.withColumn("total_sessions", sessions.agg(F.count("*")).scalar())


def most_used(history: DataFrame, n: int = 10) -> DataFrame:
    return history.select("normalized_command", "run_count", "content_hash").orderBy(F.desc("run_count"), "content_hash").limit(n)


def db_counts(history: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """One row of table sizes; the queue is what was ever taken in."""
    out = history.agg(F.count("*").alias("commands"), F.coalesce(F.sum("run_count"), F.lit(0)).cast("bigint").alias("runs"))
    for name, rows in (("sessions", sessions), ("queued", events)):
        out = out.withColumn(name, rows.agg(F.count("*")).scalar())
    return out.withColumn("fts_bytes", F.col("commands") * 200)


def storage(table: DataFrame) -> DataFrame:
    """(files, bytes, rows) of a table read from files."""
    each = table.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.max("b").alias("b"), F.count("*").alias("n"))
    return each.agg(F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))


def search_metrics(log: DataFrame) -> DataFrame:
    """One row: searches, by mode, and the mean latency in whole milliseconds, 0 if there were none."""
    counts = log.agg(
        F.count("*").alias("searches"), F.count_if(F.col("mode") == "hybrid").alias("hybrid_searches"), F.count_if(F.col("mode") == "semantic").alias("semantic_searches"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).cast("bigint").alias("total_latency_ms"),
    )
    return counts.withColumn("avg_latency_ms", F.when(F.col("searches") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("total_latency_ms div searches")))


def compact(table: DataFrame, path: str, by: str = "completed_at_ms") -> None:
    """Write a table anew in files of even size, in ranges of ``by``, so that filters on it prune files."""
    table.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def source_counts(results: DataFrame) -> DataFrame:
    """(source, n) of fused results."""
    return results.groupBy("source").agg(F.count("*").alias("n"))


def visible(results: DataFrame, show_internal: bool = False, product: str = filters.PRODUCT) -> DataFrame:
    """Results without calls of the tool itself and noise, unless asked for."""
    return results if show_internal else results.where(~filters.is_internal("command", product))


def pinned_first(results: DataFrame, pinned: DataFrame, position: str, only_pinned: bool = False) -> DataFrame:
    """Favourites (command, cwd) before the others, each in their order."""
    marks = pinned.select("command", "cwd").distinct().withColumn("pinned", F.lit(True))
    rows = results.join(marks, ["command", "cwd"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    rows = rows.where("pinned") if only_pinned else rows
    return rows.orderBy(F.desc("pinned"), position)
