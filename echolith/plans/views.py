"""The test tables as inputs of the operators, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import filters
from echolith.operators.ingest import accepted, fold
from echolith.sources.tables import table

#: A moment after the last event of the smaller tables.
NOW_MS = 1_655_400_000_000


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "command_events")


def history(spark: SparkSession, sf: str) -> DataFrame:
    return fold(accepted(events(spark, sf)))


def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    name, kind = F.col("p_name"), F.lower("p_type")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", name, F.lower("p_brand")).alias("command"), F.concat(kind, F.lit(" "), name, F.lit(" of size "), F.col("p_size").cast("string")).alias("description"),
        F.col("p_type").alias("category"), F.lower("p_brand").alias("topic"), F.array(name, F.concat_ws(" ", kind, name)).alias("aliases"), (F.col("p_size") % 3 + 1).cast("int").alias("difficulty"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("command_id"), "embedding")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return list(vectors(spark, sf).where("command_id = 0").first()["embedding"])


def named_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that the vectors belong to; some vectors have none."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("command"), F.col("p_brand").alias("cwd"), F.lit(None).cast("int").alias("exit_code"),
        F.col("p_size").cast("bigint").alias("duration_ms"), (F.col("p_partkey") * 1000).cast("bigint").alias("completed_at_ms"), (F.col("p_size") % 7 + 1).cast("bigint").alias("run_count"),
    )


def search_log(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("event_type") == "click", "hybrid").when(F.col("event_type") == "view", "semantic").otherwise("fts")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), mode.alias("mode"), F.floor("value").cast("bigint").alias("latency_ms"))


# the same in SQL -----------------------------------------------------------------------------------
WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def trim(column: str) -> str:
    return rf"regexp_replace({column}, '^{WS}|{WS}$', '', 'g')"


def normal(column: str) -> str:
    return rf"regexp_replace({trim(column)}, '{WS}', ' ', 'g')"


def tokens(column: str) -> str:
    return f"[t for t in string_split({normal(column)}, ' ') if t <> '']"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def token(column: str) -> str:
    return f"lower(string_split({normal(column)}, ' ')[1])"


def sql_ingest(column: str = "command", product: str = filters.PRODUCT) -> str:
    marks = " or ".join(f"contains(lower({column}), '{m}')" for m in filters.SECRET_MARKS)
    words = quoted(filters.CONTROL_WORDS + filters.NAVIGATION_WORDS + filters.ENVIRONMENT_WORDS)
    return f"coalesce(strlen({trim(column)}) > 1 and {token(column)} <> '{product}' and not starts_with({token(column)}, '{product}-') and {token(column)} not in ({words}) and not ({marks}), false)"


EVENTS = f"""ev as (
  select *, {normal('command')} as normalized_command, sha256({normal('command')} || chr(0) || {trim('cwd')}) as content_hash
  from command_events where {sql_ingest()}
)"""
_FIRST = ["session_id", "command", "normalized_command", "cwd"]
_LAST = ["exit_code", "duration_ms", "started_at_ms", "completed_at_ms"]
HISTORY = f"""{EVENTS}, hist as (
  select content_hash, arg_min_null(command_id, ingest_seq) as id, {', '.join(f'arg_min_null({c}, ingest_seq) as {c}' for c in _FIRST)},
    {', '.join(f'arg_max_null({c}, ingest_seq) as {c}' for c in _LAST)},
    arg_min_null(completed_at_ms, ingest_seq) as created_at_ms, arg_max_null(completed_at_ms, ingest_seq) as updated_at_ms, count(*) as run_count,
    arg_min_null(completed_at_ms, ingest_seq) as first_seen_at_ms, arg_max_null(completed_at_ms, ingest_seq) as last_seen_at_ms,
    min(ingest_seq) as first_seq, max(ingest_seq) as last_seq
  from ev group by content_hash
)"""
KNOWLEDGE = """kb as (
  select p_partkey as ordinal, p_name || ' ' || lower(p_brand) as command, lower(p_type) || ' ' || p_name || ' of size ' || p_size as description,
    p_type as category, lower(p_brand) as topic, [p_name, lower(p_type) || ' ' || p_name] as aliases, (p_size % 3 + 1)::int as difficulty
  from part
)"""
NAMED = """named as (
  select p_partkey as id, p_name || ' #' || p_partkey as command, p_brand as cwd, null::int as exit_code, p_size::bigint as duration_ms,
    (p_partkey * 1000)::bigint as completed_at_ms, (p_size % 7 + 1)::bigint as run_count from part
)"""
