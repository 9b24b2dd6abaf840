"""Row types of the store, as DDL."""

SESSIONS = ("session_id string, os_context string, hostname string, shell string, started_at_ms bigint, ended_at_ms bigint, created_at_ms bigint")
EVENTS = (
    "ingest_seq bigint, batch_no bigint, received_at timestamp_ntz, command_id string, session_id string, command string, cwd string, exit_code int, duration_ms bigint, started_at_ms bigint, completed_at_ms bigint, attempts int"
)
HISTORY = (
    "content_hash string, id string, session_id string, command string, normalized_command string, cwd string, exit_code int, duration_ms bigint, started_at_ms bigint, completed_at_ms bigint, "
    "created_at_ms bigint, updated_at_ms bigint, run_count bigint, first_seen_at_ms bigint, last_seen_at_ms bigint, first_seq bigint, last_seq bigint"
)
VECTORS = ("command_id string, dimensions int, embedding array<float>, model string, created_at_ms bigint")
SEARCH_LOG = ("seq bigint, mode string, latency_ms bigint")
CLEANUP_LOG = ("at_ms bigint, mode string, removed bigint, remaining bigint")
KNOWLEDGE = (
    "ordinal bigint, command string, description string, category string, topic string, aliases array<string>, flags array<struct<flag:string, description:string>>, examples array<string>, difficulty int, source string"
)
#: The order of the store's schema; a change raises it.
VERSION = 5
