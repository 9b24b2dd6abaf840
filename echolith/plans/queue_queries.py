"""Queries on queues and sessions: problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.operators.redelivery import MessageStore
from echolith.operators.stretches import stretches
from echolith.runtime import fresh_path
from echolith.sources.tables import table

_EVENT_FIELDS = ["batch_no", "received_at", "command_id", "session_id", "command", "cwd", "exit_code", "duration_ms", "started_at_ms", "completed_at_ms", "attempts"]


def _filled_store(spark: SparkSession, events: DataFrame, payload: list[str]) -> MessageStore:
    """The store after two deliveries: the first nine tenths of the batches, then the rest."""
    store = MessageStore(spark, fresh_path(spark, "messages"), "command_id", "ingest_seq", F.to_date("received_at"), payload)
    last = events.agg(F.max("batch_no")).first()[0] or 0
    cut = last * 9 // 10
    in_history = F.coalesce(F.col("batch_no"), F.lit(0)) <= F.lit(cut)
    store.merge(events.where(in_history))
    store.merge(events.where(~in_history))
    return store


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that the store did not keep."""
    events = table(spark, sf, "command_events")
    kept = _filled_store(spark, events, ["attempts", "completed_at_ms"]).read()
    return events.select("ingest_seq").join(kept.select("ingest_seq"), "ingest_seq", "left_anti")


def p2_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """One whole row for each message, with the number of its deliveries."""
    return _filled_store(spark, table(spark, sf, "command_events"), _EVENT_FIELDS).read().drop("_key")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    commands = table(spark, sf, "commands")
    return stretches(commands, "session_id", "completed_at_ms", "duration_ms", tie=F.xxhash64("id")).withColumnRenamed("n_rows", "n_commands")


def p3_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches with their length in time."""
    return p3_found(spark, sf).withColumn("length_ms", F.col("end_ms") - F.col("start_ms"))


_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_KEY = rf"lower(regexp_replace(command_id, '^{_WS}|{_WS}$', '', 'g'))"
_STRETCH = """
with a as (select session_id, completed_at_ms - greatest(coalesce(duration_ms, 0), 0) as s, completed_at_ms as e from commands where completed_at_ms is not null),
b as (select *, max(e) over (partition by session_id order by s, e rows between unbounded preceding and 1 preceding) as m from a),
g as (select *, sum(case when m is null or s > m + 1800000 then 1 else 0 end) over (partition by session_id order by s, e rows unbounded preceding) as k from b),
f as (select session_id, min(s) as start_ms, max(e) as end_ms, count(*) as n_commands from g group by session_id, k)
"""

QUERIES = {"p2_found": p2_found, "p2_delivered": p2_delivered, "p3_found": p3_found, "p3_lengths": p3_lengths}
SQL = {
    "p2_found": f"select ingest_seq from (select ingest_seq, row_number() over (partition by {_KEY} order by ingest_seq) as r from command_events where {_KEY} <> '') where r > 1",
    "p2_delivered": f"""
with a as (select *, case when {_KEY} <> '' then {_KEY} else 'row ' || ingest_seq end as k from command_events),
b as (select *, row_number() over (partition by k order by ingest_seq) as r, count(*) over (partition by k) as n_deliveries from a)
select ingest_seq, {', '.join(_EVENT_FIELDS)}, n_deliveries from b where r = 1""",
    "p3_found": _STRETCH + "select * from f",
    "p3_lengths": _STRETCH + "select *, end_ms - start_ms as length_ms from f",
}
