"""Events into history: one row for each content hash, with the counts of its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.functions import filters, text

#: Taken from the first event of a hash, and from the last.
_FIRST = ["id", "session_id", "command", "normalized_command", "cwd"]
_LAST = ["exit_code", "duration_ms", "started_at_ms", "completed_at_ms"]


def accepted(events: DataFrame, product: str = filters.PRODUCT) -> DataFrame:
    """The events that the store keeps."""
    return events.where(filters.should_ingest("command", product))


def hashed(events: DataFrame) -> DataFrame:
    """With the normalised command and the content hash."""
    return events.withColumn("normalized_command", text.normalize_command("command")).withColumn("content_hash", text.content_hash("command", "cwd"))


def fold(events: DataFrame, id_column: str = "command_id", seq: str = "ingest_seq") -> DataFrame:
    """History rows of events: identity from the first arrival, outcome from the last, and the run count.

    Order is that of arrival (``seq``), not of event time, and nulls of the last arrival count. Partial
    aggregates before the shuffle keep a line with a third of all events from being a hot spot.
    """
    rows = hashed(events).withColumn("id", F.col(id_column))
    first = F.struct(F.col(seq).alias("seq"), *_FIRST, F.col("completed_at_ms").alias("at"))
    last = F.struct(F.col(seq).alias("seq"), *_LAST)
    folded = rows.groupBy("content_hash").agg(F.min(first).alias("f"), F.max(last).alias("l"), F.count("*").alias("run_count"))
    return _flat(folded)


def _flat(folded: DataFrame) -> DataFrame:
    return folded.select(
        "content_hash",
        *[F.col(f"f.{c}").alias(c) for c in _FIRST],
        *[F.col(f"l.{c}").alias(c) for c in _LAST],
        F.col("f.at").alias("created_at_ms"),
        F.col("l.completed_at_ms").alias("updated_at_ms"),
        "run_count",
        F.col("f.at").alias("first_seen_at_ms"),
        F.col("l.completed_at_ms").alias("last_seen_at_ms"),
        F.col("f.seq").alias("first_seq"),
        F.col("l.seq").alias("last_seq"),
    )


def merge_folds(old: DataFrame, new: DataFrame) -> DataFrame:
    """The fold of two disjoint sets of events from their folds."""
    both = old.unionByName(new.select(old.columns))
    first = F.struct(F.col("first_seq").alias("seq"), *_FIRST, F.col("first_seen_at_ms").alias("at"))
    last = F.struct(F.col("last_seq").alias("seq"), *_LAST)
    return _flat(both.groupBy("content_hash").agg(F.min(first).alias("f"), F.max(last).alias("l"), F.sum("run_count").alias("run_count")))


def first_sessions(sessions: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The first row of each session; later deliveries are ignored."""
    order = F.col(order) if isinstance(order, str) else order
    rest = [c for c in sessions.columns if c != key]
    return sessions.groupBy(key).agg(F.min(F.struct(order.alias("_o"), *rest)).alias("s")).select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def import_batch(existing: DataFrame, incoming: DataFrame, id_column: str = "command_id", seq: str = "ingest_seq") -> DataFrame:
    """The rows that a bulk import adds: the first of each hash, unless the store has the hash. Run counts stay 1."""
    new = fold_first(incoming, id_column, seq)
    return new.join(existing.select("content_hash"), "content_hash", "left_anti")


def fold_first(events: DataFrame, id_column: str = "command_id", seq: str = "ingest_seq") -> DataFrame:
    """The first event of each hash, as a history row that ran once."""
    rows = hashed(events).withColumn("id", F.col(id_column))
    whole = F.struct(F.col(seq).alias("seq"), *_FIRST, *_LAST)
    firsts = rows.groupBy("content_hash").agg(F.min(whole).alias("f"))
    return firsts.select("content_hash", *[F.col(f"f.{c}").alias(c) for c in _FIRST + _LAST], F.lit(1).cast("bigint").alias("run_count"))


def upsert_vectors(old: DataFrame, new: DataFrame, dimensions: int) -> DataFrame:
    """One vector for each command, the latest; one of another length is an error."""
    checked = new.withColumn("embedding", F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector needs {dimensions} dimensions")).cast("array<float>")))
    both = old.withColumn("_turn", F.lit(0)).unionByName(checked.select(old.columns).withColumn("_turn", F.lit(1)))
    rest = [c for c in old.columns if c != "command_id"]
    latest = F.max_by(F.struct(*rest), F.struct("_turn", "created_at_ms"))
    return both.groupBy("command_id").agg(latest.alias("v")).select("command_id", *[F.col(f"v.{c}").alias(c) for c in rest])


def pending_index(commands: DataFrame, vectors: DataFrame, key: str = "id", vector_key: str = "command_id") -> DataFrame:
    """Commands without a vector, by key."""
    return commands.join(vectors.select(F.col(vector_key).alias(key)).distinct(), key, "left_anti")


def index_progress(commands: DataFrame, vectors: DataFrame, key: str = "id", vector_key: str = "command_id") -> DataFrame:
    """(total, indexed, percent); 100 percent of nothing."""
    done = vectors.select(F.col(vector_key).alias(key)).distinct().withColumn("_done", F.lit(1))
    counts = commands.select(key).join(done, key, "left").agg(F.count("*").alias("total"), F.count("_done").alias("indexed"))
    return counts.withColumn("percent", F.when(F.col("total") == 0, F.lit(100).cast("bigint")).otherwise(F.expr("indexed * 100 div total")))
