"""Queries on history: ingest, look-ups, clean-up, statistics, exports, imports, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import filters, formats, text
from echolith.operators import importing, ingest, retention, stats
from echolith.plans import views
from echolith.plans.views import EVENTS, HISTORY, NOW_MS, normal, sql_ingest, token, tokens, trim
from echolith.runtime import fresh_path
from echolith.sources import exports, history_files
from echolith.sources.tables import table
from echolith.streaming.fold import HistoryStream, daily_counts, event_stream

_DAYS = 4
_MOST = 1_000
_SESSION_FIELDS = ["os_context", "hostname", "shell", "started_at_ms", "ended_at_ms", "created_at_ms"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# scans and look-ups --------------------------------------------------------------------------------
@query(f"with {HISTORY} select content_hash, command, cwd, exit_code, duration_ms, completed_at_ms, session_id from hist order by completed_at_ms desc, content_hash limit 20")
def recent_commands(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recent(views.history(spark, sf), 20).select("content_hash", *exports.SUMMARY)


@query(f"with {HISTORY} select content_hash, command, run_count, 'exact' as match_kind, 1.0::double as score, 'FTS' as source from hist order by completed_at_ms desc, content_hash limit 50")
def recent_as_results(spark: SparkSession, sf: str) -> DataFrame:
    return stats.recent_as_results(views.history(spark, sf), 50).select("content_hash", "command", "run_count", "match_kind", "score", "source")


@query("select id, command from commands")
def scan_for_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "commands").select("id", "command")


_LINE = "git status"


@query(f"with {HISTORY} select * from hist where content_hash in (select content_hash from hist where normalized_command = '{_LINE}')")
def point_lookup_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.history(spark, sf)
    wanted = rows.where(F.col("normalized_command") == _LINE).select("content_hash")
    return rows.join(wanted, "content_hash", "left_semi")


@query(f"with {HISTORY} select n.id, hist.id is not null as known, hist.run_count from (select id from commands) n left join hist on n.id = hist.id")
def lookup_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """Many look-ups as one join."""
    rows = views.history(spark, sf).select("id", "run_count", F.lit(True).alias("_k"))
    return table(spark, sf, "commands").select("id").join(rows, "id", "left").select("id", F.coalesce("_k", F.lit(False)).alias("known"), "run_count")


@query("select session_id, count(*) as n from sessions where session_id in (select session_id from commands group by 1 order by count(*) desc, 1 limit 1) group by 1")
def session_lookup(spark: SparkSession, sf: str) -> DataFrame:
    busiest = table(spark, sf, "commands").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").limit(1).select("session_id")
    return table(spark, sf, "sessions").join(F.broadcast(busiest), "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))


@query(f"with {HISTORY} select distinct content_hash from hist")
def hash_scan(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).select("content_hash")


# ingest ----------------------------------------------------------------------------------------------
@query(f"select id, {normal('command')} as normalized, sha256({normal('command')} || chr(0) || {trim('cwd')}) as hash from commands")
def normalize_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "commands").select("id", text.normalize_command("command").alias("normalized"), text.content_hash("command", "cwd").alias("hash"))


_NOISE = views.quoted(filters.NOISE_WORDS)


@query(f"""select ingest_seq, {sql_ingest()} as kept,
coalesce({token('command')} = '{filters.PRODUCT}' or starts_with({token('command')}, '{filters.PRODUCT}-') or {token('command')} in ({_NOISE}), false) as internal,
starts_with(lower(command), '{filters.PRODUCT} ') or starts_with(lower(command), '{filters.PRODUCT}-') or command = '{filters.PRODUCT}' or lower(trim(command)) in ({_NOISE}) as cleaned
from command_events""")
def ingest_filter(spark: SparkSession, sf: str) -> DataFrame:
    return views.events(spark, sf).select("ingest_seq", filters.should_ingest("command").alias("kept"), filters.is_internal("command").alias("internal"), filters.cleaned_away("command").alias("cleaned"))


@query(f"with {HISTORY} select * from hist")
def upsert_fold(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf)


@query(f"""select * exclude (r) from (select session_id, {', '.join(_SESSION_FIELDS)}, row_number() over (partition by session_id order by
{', '.join(f'{c} nulls first' for c in ['created_at_ms', *_SESSION_FIELDS])}) as r from sessions) where r = 1""")
def session_first(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.first_sessions(table(spark, sf, "sessions").select("session_id", *_SESSION_FIELDS), "session_id", "created_at_ms")


@query(f"""with {EVENTS}, cut as (select max(ingest_seq) // 2 as c from command_events),
new as (select content_hash, min(ingest_seq) as s from ev, cut where ingest_seq > c and content_hash not in (select content_hash from ev, cut where ingest_seq <= c) group by 1)
select new.content_hash, ev.command_id as id, ev.session_id, ev.command, ev.normalized_command, ev.cwd, ev.exit_code, ev.duration_ms, ev.started_at_ms, ev.completed_at_ms, 1::bigint as run_count
from new join ev on ev.ingest_seq = new.s""")
def import_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.accepted(views.events(spark, sf))
    cut = views.events(spark, sf).agg(F.expr("max(ingest_seq) div 2")).first()[0] or 0
    return ingest.import_batch(ingest.fold(rows.where(F.col("ingest_seq") <= cut)), rows.where(F.col("ingest_seq") > cut))


@query("select id from commands where id not in (select command_id from vector_meta where command_id is not null)")
def index_pending(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.pending_index(table(spark, sf, "commands").select("id"), table(spark, sf, "vector_meta"))


@query("""select total, indexed, case when total = 0 then 100 else indexed * 100 // total end as percent
from (select count(*) as total, count(v.command_id) as indexed from commands c left join (select distinct command_id from vector_meta) v on c.id = v.command_id)""")
def index_progress(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.index_progress(table(spark, sf, "commands"), table(spark, sf, "vector_meta"))


@query("select count(*) as vectors, count(distinct command_id) as commands from vector_meta")
def vector_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vector_meta").agg(F.count("*").alias("vectors"), F.count_distinct("command_id").alias("commands"))


# clean-up --------------------------------------------------------------------------------------------
_KEPT = "content_hash, run_count, completed_at_ms"


@query(f"""with {HISTORY} select {_KEPT} from hist where not (starts_with(lower(normalized_command), '{filters.PRODUCT} ') or starts_with(lower(normalized_command), '{filters.PRODUCT}-')
or normalized_command = '{filters.PRODUCT}' or lower(trim(normalized_command)) in ({_NOISE}))""")
def cleanup_internal(spark: SparkSession, sf: str) -> DataFrame:
    return retention.without_internal(views.history(spark, sf)).select(*_KEPT.split(", "))


@query(f"with {HISTORY} select {_KEPT} from hist where not (exit_code is not null and exit_code <> 0 and run_count = 1)")
def cleanup_failed(spark: SparkSession, sf: str) -> DataFrame:
    return retention.without_failed(views.history(spark, sf)).select(*_KEPT.split(", "))


@query(f"with {HISTORY} select {_KEPT} from hist where completed_at_ms >= {NOW_MS - _DAYS * retention.DAY_MS}")
def cleanup_older_than(spark: SparkSession, sf: str) -> DataFrame:
    return retention.not_older_than(views.history(spark, sf), _DAYS, NOW_MS).select(*_KEPT.split(", "))


@query(f"with {EVENTS} select content_hash, ingest_seq, command_id from ev qualify row_number() over (partition by content_hash order by ingest_seq) = 1")
def cleanup_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.hashed(ingest.accepted(views.events(spark, sf))).select("content_hash", "ingest_seq", "command_id")
    return retention.without_duplicates(rows, "ingest_seq")


@query(f"with {HISTORY} select {_KEPT} from hist where completed_at_ms >= {NOW_MS - 3 * _DAYS * retention.DAY_MS} order by completed_at_ms desc, content_hash limit {_MOST}")
def cleanup_retention(spark: SparkSession, sf: str) -> DataFrame:
    return retention.by_policy(views.history(spark, sf), 3 * _DAYS, _MOST, NOW_MS).select(*_KEPT.split(", "))


@query(f"""with {HISTORY}, kept as (select content_hash from hist where not (lower(trim(normalized_command)) in ({_NOISE}) or starts_with(lower(normalized_command), '{filters.PRODUCT} ')
or starts_with(lower(normalized_command), '{filters.PRODUCT}-') or normalized_command = '{filters.PRODUCT}') and completed_at_ms >= {NOW_MS - 3 * _DAYS * retention.DAY_MS} order by completed_at_ms desc, content_hash limit {_MOST})
select {NOW_MS}::bigint as at_ms, 'automatic' as mode, (select count(*) from hist) - (select count(*) from kept) as removed, (select count(*) from kept) as remaining""")
def cleanup_automatic_log(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.history(spark, sf)
    left = retention.cleanup(rows, "automatic", now_ms=NOW_MS, days=3 * _DAYS, most=_MOST)
    return retention.log_entry(retention.removal(rows, left), "automatic", NOW_MS)


@query(f"with {HISTORY} select {_KEPT} from hist order by completed_at_ms desc, content_hash offset {_MOST}")
def retention_overflow(spark: SparkSession, sf: str) -> DataFrame:
    return retention.overflow(views.history(spark, sf), _MOST).select(*_KEPT.split(", "))


@query(f"select {NOW_MS}::bigint - max(created_at_ms) >= {retention.DAY_MS} as overdue from sessions")
def cleanup_overdue(spark: SparkSession, sf: str) -> DataFrame:
    return retention.overdue(table(spark, sf, "sessions").select(F.col("created_at_ms").alias("at_ms")), NOW_MS)


@query(f"with {HISTORY} select c.id, c.session_id from commands c where c.session_id in (select session_id from sessions where started_at_ms >= {NOW_MS - 2 * _DAYS * retention.DAY_MS})")
def cascade_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Commands whose session is still there after the old sessions are gone."""
    parents = table(spark, sf, "sessions").where(F.col("started_at_ms") >= NOW_MS - 2 * _DAYS * retention.DAY_MS)
    return retention.surviving_children(table(spark, sf, "commands").select("id", "session_id"), parents, "session_id", "session_id")


# statistics -----------------------------------------------------------------------------------------
@query(f"""with {HISTORY} select count(*) as total_commands, count(distinct normalized_command) as unique_commands, count(*) filter (run_count > 1) as deduplicated_commands,
coalesce(sum(run_count - 1) filter (run_count > 1), 0)::bigint as saved_runs, (select count(*) from sessions) as total_sessions from hist""")
def usage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.usage_stats(views.history(spark, sf), table(spark, sf, "sessions"))


@query(f"with {HISTORY} select normalized_command, run_count, content_hash from hist order by run_count desc, content_hash limit 10")
def most_used(spark: SparkSession, sf: str) -> DataFrame:
    return stats.most_used(views.history(spark, sf))


@query(f"with {HISTORY} select count(*) as commands, sum(run_count)::bigint as runs, (select count(*) from sessions) as sessions, (select count(*) from command_events) as queued, count(*) * 200 as fts_bytes from hist")
def db_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.db_counts(views.history(spark, sf), table(spark, sf, "sessions"), views.events(spark, sf))


@query("""select *, case when searches = 0 then 0 else total_latency_ms // searches end as avg_latency_ms from (
select count(*) as searches, count(*) filter (event_type = 'click') as hybrid_searches, count(*) filter (event_type = 'view') as semantic_searches, coalesce(sum(floor(value)::bigint), 0)::bigint as total_latency_ms from events)""")
def search_log_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return stats.search_metrics(views.search_log(spark, sf))


# formats and exports -----------------------------------------------------------------------------------
_TOOLS = " ".join(f"when base in ({views.quoted(names.split())}) then '{kind}'" for kind, names in formats.TOOL_CLASSES.items())


@query(f"""with {HISTORY}, b as (select *, coalesce(string_split(string_split({normal('command')}, ' ')[1], '/')[-1], '') as base from hist)
select content_hash, strftime(make_timestamp(completed_at_ms * 1000), '%Y-%m-%d %H:%M:%S') as at, strftime(make_timestamp(completed_at_ms * 1000), '%H:%M') as compact,
case when coalesce(last_seen_at_ms, 0) <= 0 then 'never' else strftime(make_timestamp(last_seen_at_ms * 1000), '%Y-%m-%d %H:%M:%S') end as last_seen,
case {_TOOLS} else 'other' end as tool, translate(replace(command, chr(13), ''), chr(10) || chr(9), '  ') as one_line from b""")
def format_columns(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).select(
        "content_hash", formats.format_timestamp("completed_at_ms").alias("at"), formats.format_timestamp("completed_at_ms", "HH:mm").alias("compact"), formats.format_optional_timestamp("last_seen_at_ms").alias("last_seen"),
        formats.tool_class("command").alias("tool"), text.clean_query("command").alias("one_line"),
    )


@query(f"""with {HISTORY} select content_hash, case when duration_ms is null then '—' when duration_ms < 1000 then duration_ms || 'ms' when duration_ms < 60000 then printf('%.1fs', round_even(duration_ms / 1000, 1))
else printf('%.1fm', round_even(duration_ms / 60000, 1)) end as took,
case when run_count * 700 < 1024 then printf('%d B', run_count * 700) when run_count * 700 < 1048576 then printf('%.1f KB', run_count * 700 / 1024) else printf('%.2f MB', run_count * 700 / 1048576) end as size from hist""")
def format_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).select("content_hash", formats.format_duration("duration_ms").alias("took"), formats.format_bytes(F.col("run_count") * 700).alias("size"))


def _csv(c: str) -> str:
    return f"""case when contains({c}, ',') or contains({c}, '"') or contains({c}, chr(10)) then '"' || replace({c}, '"', '""') || '"' else {c} end"""


@query(f"""with {HISTORY} select {_csv('command')} || ',' || {_csv('cwd')} || ',' || coalesce(exit_code::varchar, '') || ',' || coalesce(duration_ms::varchar, '') || ',' || completed_at_ms || ',' || {_csv('session_id')} as line
from hist order by completed_at_ms desc, content_hash limit 100000""")
def csv_export_line(spark: SparkSession, sf: str) -> DataFrame:
    return exports.csv_lines(exports.summary(views.history(spark, sf)))


@query(f"with {HISTORY} select command, cwd, exit_code, duration_ms, completed_at_ms, session_id from hist order by completed_at_ms desc, content_hash limit 100000")
def json_export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read again."""
    path = fresh_path(spark, "export")
    rows = exports.summary(views.history(spark, sf))
    exports.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


# imports ----------------------------------------------------------------------------------------------
def _history_text(spark: SparkSession, sf: str, line) -> str:
    """A history file of all commands, each written as its shell would."""
    path = fresh_path(spark, "shell-history")
    table(spark, sf, "commands").where("command is not null").select(line.alias("value")).write.text(path)
    return path


_BASH = rf"""lines as (select {trim('x')} as command from (select unnest(string_split(replace(command, chr(13) || chr(10), chr(10)), chr(10))) as x from commands where command is not null)),
parsed as (select command from lines where command <> '' and not starts_with(command, '#'))"""


@query(f"with {_BASH} select command, count(*) as n from parsed group by 1")
def history_parse_bash(spark: SparkSession, sf: str) -> DataFrame:
    return history_files.bash_history(spark, _history_text(spark, sf, F.col("command"))).groupBy("command").agg(F.count("*").alias("n"))


@query(f"select c as command, count(*) as n from (select {trim('replace(command, chr(13) || chr(10), chr(10))')} as c from commands where command is not null) where c <> '' group by 1")
def history_parse_zsh(spark: SparkSession, sf: str) -> DataFrame:
    """In the extended format; lines inside a command are continued, and a backslash at its end is kept apart from the line end."""
    ends_apart = F.when(F.endswith("command", F.lit("\\")), F.concat("command", F.lit(" "))).otherwise(F.col("command"))
    body = F.replace(F.replace(ends_apart, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\\\n"))
    line = F.concat(F.lit(": "), F.expr("completed_at_ms div 1000").cast("string"), F.lit(":0;"), body)
    return history_files.zsh_history(spark, _history_text(spark, sf, line)).groupBy("command").agg(F.count("*").alias("n"))


@query(rf"""with t as (select regexp_split_to_array(replace({trim('command')}, '\n', chr(10)), '\r?\n')[1] as x from commands where command is not null)
select {trim('x')} as command, count(*) as n from t where {trim('x')} <> '' group by 1""")
def history_parse_fish(spark: SparkSession, sf: str) -> DataFrame:
    """Line feeds are escaped; only the first line of a command is read."""
    line = F.concat(F.lit("- cmd: "), F.replace(F.regexp_replace("command", r"\r\n", "\n"), F.lit("\n"), F.lit("\\n")))
    return history_files.fish_history(spark, _history_text(spark, sf, line)).groupBy("command").agg(F.count("*").alias("n"))


_IMPORTED = f"sha256({normal('command')} || chr(0) || 'imported')"


@query(f"""with {HISTORY}, {_BASH}, k as (select {sql_ingest()} as kept, {_IMPORTED} in (select content_hash from hist) as known from parsed)
select count(*) as found, count(*) filter (not kept) as filtered, count(*) filter (kept and not known) as would_import, count(*) filter (kept and known) as would_skip from k""")
def import_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    parsed = history_files.bash_history(spark, _history_text(spark, sf, F.col("command")))
    return importing.dry_run(parsed, views.history(spark, sf))


@query(f"""with {HISTORY}, {_BASH} select distinct {_IMPORTED} as content_hash, {normal('command')} as normalized_command, 'imported' as cwd, 1::bigint as run_count from parsed
where {sql_ingest()} and {_IMPORTED} not in (select content_hash from hist)""")
def import_run(spark: SparkSession, sf: str) -> DataFrame:
    parsed = history_files.bash_history(spark, _history_text(spark, sf, F.col("command")))
    return importing.run(parsed, views.history(spark, sf), NOW_MS, "import-session").select("content_hash", "normalized_command", "cwd", "run_count")


# streams ----------------------------------------------------------------------------------------------
@query(f"with {HISTORY} select * from hist")
def stream_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of landed files, folded by micro-batches; equal to the fold of all."""
    landed = fresh_path(spark, "landed")
    rows = views.events(spark, sf)
    rows.repartitionByRange(4, "ingest_seq").write.parquet(landed)
    stream = HistoryStream(spark, fresh_path(spark, "stream"))
    stream.start(event_stream(spark, landed, rows.schema, files_per_batch=2)).awaitTermination()
    return stream.read()


@query("select ts::date as day, event_type, count(*) as n from events group by 1, 2")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = daily_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return counts.withColumn("day", F.to_date("day"))
