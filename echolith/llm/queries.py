"""Queries of the corpus operators: problems 1 and 4 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.llm import sql
from echolith.llm.encode import encode_column
from echolith.llm.forest import HistoryForest
from echolith.llm.frequent import frequent_values
from echolith.llm.leaks import leaked_spans, leaks
from echolith.llm.neighbours import neighbours
from echolith.llm.quality import not_prose, quality_stats
from echolith.llm.rewrites import collapsed, variant_pairs
from echolith.llm.secrets import redacted, secrets
from echolith.runtime import fresh_path
from echolith.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_values(table(spark, sf, "commands"), "normalized_command", 0.01).select("normalized_command")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frequent_values(table(spark, sf, "commands"), "normalized_command", 0.01).select("normalized_command", "n_rows")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = variant_pairs(table(spark, sf, "commands"), "command", "cwd", "content_hash")
    return pairs.select(F.col("variant_a").alias("content_hash_a"), F.col("variant_b").alias("content_hash_b"))


def p4_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return collapsed(table(spark, sf, "commands"), "command", "cwd", "content_hash").withColumnRenamed("variant", "content_hash")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    commands = table(spark, sf, "commands").select(F.lit("commands").alias("rec_kind"), F.col("id").alias("rec_key"), "command")
    events = table(spark, sf, "command_events").select(F.lit("command_events").alias("rec_kind"), F.col("ingest_seq").cast("string").alias("rec_key"), "command")
    return commands.unionByName(events)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return secrets(_records(spark, sf), ["rec_kind", "rec_key"], "command")


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(_records(spark, sf), ["rec_kind", "rec_key"], "command")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours(table(spark, sf, "vector_meta"), "command_id", "embedding_bytes", "created_at_ms", k=5, floor=0.7)
    return near.select(F.least("command_id", "neighbour").alias("command_id_a"), F.greatest("command_id", "neighbour").alias("command_id_b")).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """History is batch 0; the waiting batches are appended one after the other, and their rows see what is lower than they are."""
    forest = HistoryForest(spark, fresh_path(spark, "forest"))
    waiting = table(spark, sf, "new_commands")
    forest.append(HistoryForest.records(table(spark, sf, "commands"), "command", "cwd", F.lit(0)), "history")
    for batch in sorted(r[0] for r in waiting.where("batch_no is not null").select("batch_no").distinct().collect()):
        forest.append(HistoryForest.records(waiting.where(F.col("batch_no") == batch), "command", "cwd", F.col("batch_no")), f"batch{batch}")
    return forest.match(waiting, "id", "command", "cwd", F.col("batch_no"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_column(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage", answer="answer")


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_spans(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "passage", "answer")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def p10_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return not_prose(table(spark, sf, "documents"), "doc_id", "text")


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = quality_stats(table(spark, sf, "documents"), "doc_id", "text")
    return stats.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p4_found": p4_found,
    "p4_collapsed": p4_collapsed,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_reasons": p10_reasons,
    "p10_stats": p10_stats,
}
SQL = sql.SQL
