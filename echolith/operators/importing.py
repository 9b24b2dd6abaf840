"""Import of shell history into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import filters
from echolith.operators.ingest import hashed, import_batch

IMPORT_CWD = "imported"


def events(parsed: DataFrame, now_ms: int, session_id: str, product: str = filters.PRODUCT) -> DataFrame:
    """Parsed lines (file, line, command) as events; noise is dropped, times are a second apart and end now."""
    kept = parsed.where(filters.should_ingest("command", product))
    per_file = Window.partitionBy("file")  # a history file is read whole by one task already
    place = F.row_number().over(per_file.orderBy("line"))
    at = F.lit(now_ms) - (F.count("*").over(per_file) - place + 1) * 1000
    # files in the order of their names, lines within them
    turns = kept.select("file").distinct().withColumn("_turn", F.row_number().over(Window.orderBy("file")))
    return kept.withColumn("_at", at).join(turns, "file").select(
        (F.shiftleft(F.col("_turn").cast("bigint"), 40) + F.col("line")).alias("ingest_seq"), F.concat(F.lit("import-"), F.sha2(F.concat_ws("\n", "file", F.col("line").cast("string")), 256)).alias("command_id"), F.lit(session_id).alias("session_id"), "command",
        F.lit(IMPORT_CWD).alias("cwd"), F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("bigint").alias("duration_ms"), F.lit(None).cast("bigint").alias("started_at_ms"), F.col("_at").cast("bigint").alias("completed_at_ms"),
    )


def preview(parsed: DataFrame, n: int = 20, product: str = filters.PRODUCT) -> DataFrame:
    return parsed.where(filters.should_ingest("command", product)).orderBy("file", "line").limit(n).select("command")


def dry_run(parsed: DataFrame, history: DataFrame, product: str = filters.PRODUCT) -> DataFrame:
    """(found, filtered, would_import, would_skip); lines repeated in the file count each."""
    known = history.select("content_hash").distinct().withColumn("_known", F.lit(True))
    kept = filters.should_ingest("command", product)
    rows = hashed(parsed.withColumn("cwd", F.lit(IMPORT_CWD))).withColumn("_kept", kept).join(known, "content_hash", "left")
    return rows.agg(
        F.count("*").alias("found"), F.count_if(~F.col("_kept")).alias("filtered"), F.count_if(F.col("_kept") & F.col("_known").isNull()).alias("would_import"), F.count_if(F.col("_kept") & F.col("_known").isNotNull()).alias("would_skip")
    )


def run(parsed: DataFrame, history: DataFrame, now_ms: int, session_id: str, product: str = filters.PRODUCT) -> DataFrame:
    """The rows to append to history."""
    return import_batch(history, events(parsed, now_ms, session_id, product))
