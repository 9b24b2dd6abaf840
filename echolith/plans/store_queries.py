"""Queries through the store as users see it, and of operators that keep or change state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.engine import HistoryEngine
from echolith.functions import formats, text
from echolith.functions.embedding import NgramProvider
from echolith.operators import importing, ingest, knowledge, lexical, stats, vector
from echolith.plans import views
from echolith.plans.search_queries import _INTERNAL, _SCORE, _TWO, _rounded, _score
from echolith.plans.views import HISTORY, KNOWLEDGE, NAMED, NOW_MS, sql_ingest, trim
from echolith.runtime import fresh_path
from echolith.sources import exports, history_files
from echolith.sources.packs import Knowledge
from echolith.sources.tables import table
from echolith.streaming.fold import HistoryStream, event_stream, idle_sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession, sf: str, once: bool = False) -> HistoryEngine:
    """A store that took in the events as two batches."""
    engine = HistoryEngine(spark, fresh_path(spark, "store"), NgramProvider(64))
    events, sessions = views.events(spark, sf), table(spark, sf, "sessions")
    middle = (events.agg(F.max("batch_no")).first()[0] or 0) // 2
    first = F.coalesce(F.col("batch_no") <= middle, F.lit(True))
    engine.ingest(events.where(first), sessions, once=once)
    engine.ingest(events.where(~first), once=once)
    return engine


# the engine -----------------------------------------------------------------------------------------
@query(f"with {HISTORY} select content_hash, id, command, exit_code, run_count, completed_at_ms, first_seq, last_seq from hist")
def engine_history(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).history().select("content_hash", "id", "command", "exit_code", "run_count", "completed_at_ms", "first_seq", "last_seq")


_KEY = f"lower({trim('command_id')})"


@query(f"""with m as (select *, case when {_KEY} <> '' then {_KEY} else 'row ' || ingest_seq end as k from command_events),
w as (select * from m qualify row_number() over (partition by k order by ingest_seq) = 1)
select sha256({views.normal('command')} || chr(0) || {trim('cwd')}) as content_hash, count(*) as run_count from w where {sql_ingest()} group by 1""")
def engine_once(spark: SparkSession, sf: str) -> DataFrame:
    """Events delivered again, in the same or a later batch, count once."""
    return _engine(spark, sf, once=True).history().select("content_hash", "run_count")


@query(f"""with {HISTORY}, pool as (select *, case when {_TWO.format('docker compose')} then 'exact' else 'partial' end as match_kind from hist
where ({_TWO.format('docker')}) and ({_TWO.format('compose')}) order by completed_at_ms desc, content_hash limit 320),
s as (select *, {_SCORE.format(internal=_INTERNAL, near='0.0')} as score from pool)
select row_number() over (order by s.score desc, completed_at_ms desc, content_hash)::int as place, command, cwd, run_count, match_kind, round(score, 6) as score, 'FTS' as source from s order by s.score desc, completed_at_ms desc, content_hash limit 20""")
def engine_fts(spark: SparkSession, sf: str) -> DataFrame:
    """The full-text mode of search on a stored history, in its order."""
    rows = _engine(spark, sf).search("docker compose", 20, "fts").withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))
    return _rounded(rows.select("place", "command", "cwd", "run_count", "match_kind", "score", "source"), 6, "score")


@query(f"""with {HISTORY} select row_number() over (order by completed_at_ms desc, content_hash)::int as place, command, cwd, match_kind, score, source
from (select *, 'exact' as match_kind, 1.0::double as score, 'FTS' as source from hist order by completed_at_ms desc, content_hash limit 20)""")
def engine_empty_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = _engine(spark, sf).search(" ", 20).withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))
    return rows.select("place", "command", "cwd", "match_kind", "score", "source")


@query(f"""with {HISTORY}, gone as (select count(*) as removed from hist where exit_code is not null and exit_code <> 0 and run_count = 1), n as (select count(*) as total from hist)
select removed, total - removed as remaining, total - removed as vectors from gone, n""")
def engine_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Removed commands take their vectors with them."""
    engine = _engine(spark, sf)
    engine.reindex(NOW_MS)
    removed, remaining = engine.cleanup("failed", NOW_MS)
    return spark.createDataFrame([(removed, remaining)], "removed bigint, remaining bigint").withColumn("vectors", engine.vectors().agg(F.count("*")).scalar())


@query(f"with {HISTORY}, s as (select count(distinct session_id) + max((session_id is null)::int) as n from sessions) select count(*) as commands, sum(run_count)::bigint as runs, max(n)::bigint as sessions, 0::bigint as queued, count(*) * 200 as fts_bytes, count(*) as stored from hist, s")
def engine_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the tables, and rows of the files after they are made one."""
    engine = _engine(spark, sf)
    engine.optimize()
    return engine.counts().withColumn("stored", engine.storage().select("rows").scalar())


@query(f"with {HISTORY} select count(*) as total, count(*) as indexed, 100::bigint as percent, count(*) as embedded from hist")
def engine_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """New vectors for all commands, also those that have one."""
    engine = _engine(spark, sf)
    engine.reindex(NOW_MS)
    n = engine.reindex(NOW_MS, full=True)
    return engine.index_status().withColumn("embedded", F.lit(n).cast("bigint"))


@query("""with new as (select p_partkey as id from part)
select v.vec_id as command_id, round(case when new.id is null then v.embedding[1] else v.embedding[64] end, 5) as first_value, case when new.id is null then 1 else 2 end::bigint as created_at_ms from embeddings v left join new on new.id = v.vec_id""")
def vectors_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the commands that have one already are replaced: here those of ``part``, by their own in reverse."""
    old = views.vectors(spark, sf).withColumn("created_at_ms", F.lit(1).cast("bigint"))
    new = old.join(table(spark, sf, "part").select(F.col("p_partkey").alias("command_id")), "command_id", "left_semi").select("command_id", F.reverse("embedding").alias("embedding"), F.lit(2).cast("bigint").alias("created_at_ms"))
    kept = ingest.upsert_vectors(old.select("command_id", "embedding", "created_at_ms"), new, 64)
    return kept.select("command_id", F.round(F.col("embedding")[0], 5).alias("first_value"), "created_at_ms")


@query("select vec_id as command_id from embeddings where vec_id not in (select p_partkey from part)")
def vectors_deleted(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("command_id"))
    return vector.delete_vectors(views.vectors(spark, sf), ids).select("command_id")


# functions and results --------------------------------------------------------------------------------
@query("""with p as (select id, string_split(lower(command), 'docker') as parts from commands where command is not null)
select id, array_to_string([(list_sum([length(x) for x in parts[1:i]]) + 6 * (i - 1))::int for i in range(1, len(parts))], ',') as starts from p""")
def highlights(spark: SparkSession, sf: str) -> DataFrame:
    """Where the hits begin, in order."""
    rows = table(spark, sf, "commands").where("command is not null")
    return rows.select("id", F.array_join(text.highlight_spans("docker", "command").cast("array<string>"), ",").alias("starts"))


@query("select p_partkey, round(case when p_partkey > 5 then p_size / p_partkey * 100 else 0.0 end, 6) as percent from part")
def fragmentation(spark: SparkSession, sf: str) -> DataFrame:
    total = F.when(F.col("p_partkey") > 5, F.col("p_partkey")).otherwise(F.lit(0))
    return _rounded(table(spark, sf, "part").select("p_partkey", formats.fragmentation(F.col("p_size"), total).alias("percent")), 6, "percent")


@query(f"with {HISTORY} select content_hash from hist where not {_INTERNAL}")
def visible_results(spark: SparkSession, sf: str) -> DataFrame:
    return stats.visible(views.history(spark, sf)).select("content_hash")


@query(f"with {HISTORY} select content_hash, completed_at_ms as position from hist where (command, cwd) in (select (command, cwd) from hist where exit_code <> 0)")
def only_pinned(spark: SparkSession, sf: str) -> DataFrame:
    """Favourites alone: here all commands that failed."""
    rows = views.history(spark, sf).withColumn("position", F.col("completed_at_ms"))
    return stats.pinned_first(rows, rows.where("exit_code <> 0"), "position", only_pinned=True).select("content_hash", "position")


_ANSWERS = f"ans as (select *, row_number() over (order by round(c, 9) desc, ordinal) as place from (select *, {_score('red widget')} as c from kb) where c >= 0.15 order by round(c, 9) desc, ordinal limit 10)"


@query(f"""with {KNOWLEDGE}, {_ANSWERS}, {NAMED}, hits as (select count(*) as n from named where contains(lower(command), 'widget'))
select 'none found' as which, ordinal from ans where place <= 3 union all select 'weak' as which, ordinal from ans where c >= 0.5 union all select 'strong' as which, ordinal from ans, hits where n = 0""")
def knowledge_supplement(spark: SparkSession, sf: str) -> DataFrame:
    """Answers beside the results of three searches: without a result, with partial ones only, with exact ones of a high score."""
    answers = knowledge.ask(views.knowledge(spark, sf), "red widget", 10)
    named = views.named_vectors(spark, sf)
    strong = lexical.search(named, "widget", 20, tie="id")
    cases = {"none found": strong.limit(0), "weak": strong.withColumn("match_kind", F.lit("partial")), "strong": strong}
    return knowledge.union_entries([knowledge.supplement(rows, answers).select(F.lit(name).alias("which"), "ordinal") for name, rows in cases.items()])


@query(f"with {HISTORY} select command, cwd, exit_code, duration_ms, completed_at_ms, session_id from hist order by completed_at_ms desc, content_hash limit 500")
def json_document(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON document for a person to read, parsed again."""
    rows = exports.summary(views.history(spark, sf), 500)
    document = spark.createDataFrame([(exports.json_document(rows),)], "doc string")
    return document.select(F.explode(F.from_json("doc", f"array<{rows.schema.simpleString()}>")).alias("r")).select("r.*")


@query(f"""with l as (select id, unnest(string_split(replace(command, chr(13) || chr(10), chr(10)), chr(10))) as x, unnest(range(1, 1 + len(string_split(replace(command, chr(13) || chr(10), chr(10)), chr(10))))) as pos from commands where command is not null),
parsed as (select id, pos, {trim('x')} as command from l where {trim('x')} <> '' and not starts_with({trim('x')}, '#')),
kept as (select command, row_number() over (order by id, pos) as place, count(*) over () as n from parsed where {sql_ingest()})
select command, {NOW_MS} - (n - place + 1) * 1000 as completed_at_ms, place from kept""")
def import_times(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of one file in their order, a second apart, the last of them now."""
    path = fresh_path(spark, "shell-history")
    table(spark, sf, "commands").where("command is not null").orderBy("id").select(F.col("command").alias("value")).coalesce(1).write.text(path)
    from pyspark.sql import Window

    events = importing.events(history_files.bash_history(spark, path), NOW_MS, "import")
    return events.select("command", "completed_at_ms", F.row_number().over(Window.partitionBy("session_id").orderBy("ingest_seq")).cast("bigint").alias("place"))


# vectors and knowledge whose results are nested ---------------------------------------------------------
_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, [x::uhugeint for x in x.f]), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616::uhugeint)"


@query(rf"""with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as w from part), b as (select p_partkey, [ascii(c) for c in string_split(w, '')] as b from w),
f as (select p_partkey, unnest(list_concat([struct_pack(f := b, w := 2.0::double)], [struct_pack(f := list_concat([32], b, [32])[i:i + 2], w := 1.0::double) for i in range(1, len(b) + 1)], [struct_pack(f := b[i:i + 1], w := 0.5::double) for i in range(1, len(b))])) as x from b),
s as (select p_partkey, ({_FNV} % 384)::int as idx, sum(x.w) as weight from f group by 1, 2)
select p_partkey, idx, round(weight / sqrt(sum(weight * weight) over (partition by p_partkey)), 4) as value from s""")
def ngram_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """The coordinates of the dense vectors that are not zero."""
    from echolith.functions.embedding import embed

    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(embed("p_name", NgramProvider(384))).alias("idx", "v")).where("v <> 0")
    return rows.select("p_partkey", "idx", F.round(F.col("v").cast("double"), 4).alias("value"))


@query(f"""select id as command_id, 384 as dimensions, {NOW_MS}::bigint as created_at_ms, case when {trim('command')} <> '' then 1.0 else 0.0 end as norm
from commands where id not in (select command_id from vector_meta where command_id is not null)""")
def index_new_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the commands that get a vector, and the length of these."""
    commands = table(spark, sf, "commands").select("id", "command")
    new = vector.index_new(commands, table(spark, sf, "vector_meta").select("command_id"), NgramProvider(384), NOW_MS)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return new.select("command_id", "dimensions", "created_at_ms", F.round(F.sqrt(squares), 3).alias("norm"))


@query(f"""with {KNOWLEDGE} select 'brand#17' as topic, 'Brand#17 commands' as description, dense_rank() over (order by category)::int as category_place, category,
row_number() over (partition by category order by difficulty, ordinal)::int as place, command, description as line, difficulty from kb where topic = 'brand#17'""")
def kb_learn_nested(spark: SparkSession, sf: str) -> DataFrame:
    """The nested answer of learn, line by line in its order."""
    nested = knowledge.learn(views.knowledge(spark, sf), "Brand#17")
    by_category = nested.select("topic", "description", F.posexplode("categories").alias("i", "c"))
    lines = by_category.select("topic", "description", (F.col("i") + 1).alias("category_place"), F.col("c.name").alias("category"), F.posexplode("c.commands").alias("j", "x"))
    return lines.select("topic", "description", "category_place", "category", (F.col("j") + 1).alias("place"), F.col("x.command").alias("command"), F.col("x.description").alias("line"), F.col("x.difficulty").alias("difficulty"))


@query("""select * from (values ('cargo', 'Building Rust projects', 4), ('docker', 'Containers and images', 6), ('git', 'Version control', 6), ('go', 'Building Go projects', 4), ('kubernetes', 'Working with clusters', 5),
('linux', 'Files, processes and space on Linux', 6)) as t(topic, description, entries)""")
def kb_packs(spark: SparkSession, sf: str) -> DataFrame:
    """The packs that come with the library, and the number of their entries."""
    packs = Knowledge(spark)
    return knowledge.topics(packs.packs).join(knowledge.pack_sizes(packs.entries, "topic"), "topic").select("topic", "description", F.col("entries").cast("int").alias("entries"))


# streams ----------------------------------------------------------------------------------------------
def _streamed(spark: SparkSession, sf: str) -> HistoryStream:
    landed = fresh_path(spark, "landed")
    rows = views.events(spark, sf)
    rows.repartitionByRange(4, "ingest_seq").write.parquet(landed)
    stream = HistoryStream(spark, fresh_path(spark, "stream"))
    stream.start(event_stream(spark, landed, rows.schema, files_per_batch=2)).awaitTermination()
    return stream


@query(f"with {HISTORY} select content_hash, run_count, first_seq, last_seq from hist")
def stream_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that runs again under its number replaces what it wrote before."""
    events = views.events(spark, sf)
    stream = HistoryStream(spark, fresh_path(spark, "stream"))
    odd = F.col("ingest_seq") % 2 == 1
    stream._write(events.where(odd), 0)
    stream._write(events.where(~odd), 1)
    stream._write(events.where(odd), 0)
    return stream.read().select("content_hash", "run_count", "first_seq", "last_seq")


@query(f"with {HISTORY} select content_hash, run_count from hist where not (exit_code is not null and exit_code <> 0 and run_count = 1)")
def stream_retention(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot of the stream's history without failures; its folds are retired."""
    stream = _streamed(spark, sf)
    rows = stream.compact("failed")
    if stream.batches():
        raise RuntimeError("folds are left")
    return rows.select("content_hash", "run_count")


@query("""with a as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
g as (select *, sum(case when before is null or ts > before + interval 12 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from a)
select user_id, min(ts) as "start", max(ts) + interval 12 hours as "end", count(*) as n from g group by user_id, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Session windows of twelve hours, on a real stream: rows in files by time, windows given out as the watermark passes."""
    landed, out = fresh_path(spark, "landed"), fresh_path(spark, "sessions")
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows.repartitionByRange(3, "ts").write.parquet(landed)
    # a last row far behind all others closes every window
    end = rows.agg(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"))
    end.write.mode("append").parquet(landed)
    found = idle_sessions(event_stream(spark, landed, rows.schema), "ts", "user_id", "12 hours", "10 days")
    writer = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema(found.schema).parquet(out).where("user_id is not null")
    return closed.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
