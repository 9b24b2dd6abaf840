"""Hybrid search: weighted reciprocal rank fusion of a lexical and a semantic list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights are 32-bit floats widened to 64 bits.
LEXICAL_WEIGHT, SEMANTIC_WEIGHT, RANK_OFFSET = 0.6000000238418579, 0.4000000059604645, 60

_FIELDS = ["exit_code", "duration_ms", "completed_at_ms", "run_count", "match_kind"]


def _ranked(rows: DataFrame, order: list[Column], weight: float, fields: list[str]) -> DataFrame:
    """One row for each (command, cwd): the attributes of the first, the sum over all."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # a list of at most some hundred rows
    rows = rows.withColumn("_place", place).withColumn("_part", F.lit(weight) / (RANK_OFFSET + F.col("_place")))
    return rows.groupBy("command", "cwd").agg(F.min(F.struct("_place", *fields)).alias("a"), F.sum("_part").alias("part"))


def fuse(lexical: DataFrame, lexical_order: list[Column], similar: DataFrame, similar_order: list[Column], limit: int) -> DataFrame:
    """(command, cwd, attributes, score, source), best first.

    Both inputs are the bounded lists of the two searches. Rows found by both take the attributes of the
    lexical one. Scores are divided by the best one's. Without semantic rows the lexical list comes
    out with its own scores and the source FTS. Ties go to the smaller (command, cwd).
    """
    everything = Window.partitionBy(F.lit(0))
    left = _ranked(lexical, lexical_order, LEXICAL_WEIGHT, [*_FIELDS, "score"]).select("command", "cwd", F.col("a").alias("l"), F.col("part").alias("lp"))
    right = _ranked(similar.withColumns({"run_count": F.lit(1).cast("bigint"), "match_kind": F.lit("partial")}), similar_order, SEMANTIC_WEIGHT, _FIELDS)
    right = right.select("command", "cwd", F.col("a").alias("s"), F.col("part").alias("sp"))
    both = left.join(right, ["command", "cwd"], "full")
    total = F.coalesce("lp", F.lit(0.0)) + F.coalesce("sp", F.lit(0.0))
    source = F.when(F.col("lp").isNotNull() & F.col("sp").isNotNull(), "HYB").when(F.col("sp").isNotNull(), "SEM").otherwise("FTS")
    best = both.withColumn("rrf", total).withColumn("source", source).withColumn("_any", F.count("sp").over(everything))
    fields = [F.when(F.col("l").isNotNull(), F.col(f"l.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in _FIELDS]
    best = best.select("command", "cwd", *fields, "source", "rrf", F.col("l.score").alias("_own"), "_any").orderBy(F.desc("rrf"), "command", "cwd").limit(limit)
    score = F.when(F.col("_any") > 0, F.col("rrf") / F.max("rrf").over(everything)).otherwise(F.col("_own"))
    return best.withColumn("score", score).drop("rrf", "_own", "_any")
