import json

from echolith import schemas
from echolith.operators import importing
from echolith.sources import exports, history_files
from echolith.sources.packs import Knowledge
from echolith.streaming.fold import HistoryStream, daily_counts, event_stream, idle_sessions


def parsed(df):
    return [r["command"] for r in df.orderBy("file", "line").collect()]


def test_bash(spark, tmp_path):
    (tmp_path / "h").write_text("ls -la\n\n#1700000000\n  git log \r\nmake\n")
    assert parsed(history_files.bash_history(spark, str(tmp_path / "h"))) == ["ls -la", "git log", "make"]


def test_zsh(spark, tmp_path):
    (tmp_path / "h").write_text(": 1:0;ls\nplain\n: 2:0;for x\\\ndo y\\\ndone\n: no prefix\nlast\\\n")
    assert parsed(history_files.zsh_history(spark, str(tmp_path / "h"))) == ["ls", "plain", "for x\ndo y\ndone", ": no prefix", "last"]


def test_zsh_prefix_is_stripped_once(spark, tmp_path):
    (tmp_path / "h").write_text(": 1:0;: 2:0;ls\n")
    assert parsed(history_files.zsh_history(spark, str(tmp_path / "h"))) == [": 2:0;ls"]


def test_fish(spark, tmp_path):
    (tmp_path / "h").write_text("- cmd: ls\n  when: 1\n- cmd: a\\nb\n- cmd:  \n")
    assert parsed(history_files.fish_history(spark, str(tmp_path / "h"))) == ["ls", "a"]


def test_detect_shell(tmp_path):
    assert history_files.detect_shell(str(tmp_path), {"SHELL": "/bin/fish"})[0] == "fish"
    (tmp_path / ".bash_history").write_text("")
    assert history_files.detect_shell(str(tmp_path), {})[0] == "bash"


def test_import(spark, tmp_path, rows):
    (tmp_path / "h").write_text("git log\nexit\ngit  log\nmake\n")
    lines = history_files.bash_history(spark, str(tmp_path / "h"))
    empty = spark.createDataFrame([], schemas.HISTORY)
    assert tuple(importing.dry_run(lines, empty).first()) == (4, 1, 3, 0)
    new = importing.run(lines, empty, 10_000, "s")
    assert rows(new, "command", "cwd", "completed_at_ms") == [("git log", "imported", 7000), ("make", "imported", 9000)]
    assert tuple(importing.dry_run(lines, new).first()) == (4, 1, 0, 3)
    assert importing.preview(lines, 2).count() == 2


def test_packs(spark, tmp_path):
    assert Knowledge(spark).entries.count() == 31 and not Knowledge(spark).errors
    (tmp_path / "a.json").write_text(json.dumps([{"command": "x", "description": "y", "query": "q"}]))
    (tmp_path / "b.toml").write_text('topic = "T"\ndescription = "d"\n[[entries]]\ncommand = "c"\ndescription = "e"\ncategory = "k"\ntopic = "T"\n')
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.txt").write_text("no pack")
    own = Knowledge(spark, str(tmp_path), built_in=False)
    assert [(r["command"], r["topic"], r["category"], list(r["aliases"]), r["difficulty"]) for r in own.entries.orderBy("ordinal").collect()] == [("x", "a", "general", ["q"], 1), ("c", "T", "k", [], 1)]
    assert len(own.errors) == 2


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', "/x", None, 1, 2, "s")], "command string, cwd string, exit_code int, duration_ms bigint, completed_at_ms bigint, session_id string")
    assert exports.csv_lines(rows).first()[0] == '"a,""b""",/x,,1,2,s'
    assert json.loads(exports.json_document(rows))[0]["exit_code"] is None and exports.json_document(rows.limit(0)) == "[]"
    exports.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()["command"] == 'a,"b"'


def test_stream_restarts_without_counting_twice(spark, tmp_path):
    columns = "ingest_seq bigint, command_id string, session_id string, command string, cwd string, exit_code int, duration_ms bigint, started_at_ms bigint, completed_at_ms bigint"
    first = spark.createDataFrame([(1, "a", "s", "make", "/", 0, 1, 1, 10), (2, "b", "s", "make", "/", 1, 1, 1, 20)], columns)
    first.write.parquet(str(tmp_path / "in"))
    stream = HistoryStream(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        stream.start(event_stream(spark, str(tmp_path / "in"), first.schema)).awaitTermination()
    assert stream.read().first()["run_count"] == 2 and stream.batches() == 1
    spark.createDataFrame([(3, "c", "s", "make", "/", 5, 1, 1, 5)], columns).write.mode("append").parquet(str(tmp_path / "in"))
    stream.start(event_stream(spark, str(tmp_path / "in"), first.schema)).awaitTermination()
    row = stream.read().first()
    assert (row["id"], row["run_count"], row["exit_code"], row["last_seen_at_ms"]) == ("a", 3, 5, 5)


def test_windows_on_a_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'u' as k union all select timestamp'2024-01-01 10:10:00', 'u' union all select timestamp'2024-01-02 10:00:00', 'u'").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    for name, df in (("daily", daily_counts(source, "ts", "k")), ("idle", idle_sessions(source, "ts", "k"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "daily" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["n"] for r in spark.sql("select n from daily").collect()) == [1, 2]
