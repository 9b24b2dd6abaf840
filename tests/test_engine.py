import pytest
from pyspark.sql import functions as F

from echolith import schemas
from echolith.engine import HistoryEngine
from echolith.functions.embedding import NgramProvider
from echolith.manifest import Conflict
from echolith.operators.lexical import literal_match
from echolith.operators.postings import TrigramIndex
from echolith.runtime import fresh_path

EVENTS = "ingest_seq bigint, command_id string, session_id string, command string, cwd string, exit_code int, duration_ms bigint, started_at_ms bigint, completed_at_ms bigint"


def event(i, command, at, exit_code=0, cwd="/a"):
    return (i, f"c{i}", "s1", command, cwd, exit_code, 5, at - 5, at)


def frame(spark, *events):
    return spark.createDataFrame(list(events), EVENTS)


@pytest.fixture
def engine(spark):
    e = HistoryEngine(spark, fresh_path(spark, "engine"), NgramProvider(64))
    sessions = spark.createDataFrame([("s1", "linux", "h", "zsh", 1, None, 1)], "session_id string, os_context string, hostname string, shell string, started_at_ms bigint, ended_at_ms bigint, created_at_ms bigint")
    e.ingest(frame(spark, event(1, "docker compose up", 100), event(2, "git status", 200), event(3, "exit", 250)), sessions)
    e.ingest(frame(spark, event(4, "git  status", 300, 1), event(5, "make all", 400, 2)))
    return e


def commands(df):
    return [r["command"] for r in df.collect()]


def test_batches_are_merged_and_can_be_searched(engine):
    runs = {r["command"]: r["run_count"] for r in engine.history().collect()}
    assert runs == {"docker compose up": 1, "git status": 2, "make all": 1}
    assert commands(engine.search("compose", mode="fts")) == ["docker compose up"]
    assert commands(engine.search("")) == ["make all", "git status", "docker compose up"]
    with pytest.raises(ValueError):
        engine.search("x", mode="other")


def test_index_and_modes(engine):
    assert commands(engine.search("git status", mode="hybrid"))[0] == "git status"
    assert engine.reindex(1) == 3 and engine.reindex(2) == 0 and engine.reindex(3, full=True) == 3
    assert tuple(engine.index_status().first()) == (3, 3, 100)
    first = engine.search("git status", mode="hybrid").first()
    assert (first["command"], first["source"], first["score"]) == ("git status", "HYB", 1.0)
    assert engine.search("git status", mode="semantic").first()["source"] == "SEM"
    assert engine.semantic("docker compose up", 1).first()["similarity"] == pytest.approx(1.0, abs=1e-5)


def test_cleaned_commands_start_again(spark, engine):
    assert engine.cleanup("failed", 1_000) == (1, 2)
    engine.ingest(frame(spark, event(9, "make all", 900)))
    assert {r["command"]: r["run_count"] for r in engine.history().collect()} == {"docker compose up": 1, "git status": 2, "make all": 1}
    engine.optimize()
    assert engine.history().count() == 3
    assert engine.cleanup_if_overdue(1_001) is None
    assert engine.cleanup_if_overdue(1_000 + 86_400_000, days=2, most=2) == (1, 2)


def test_usage_counts_searches(engine):
    engine.search_rows("git", mode="fts")
    out = engine.usage()
    assert (out["total_commands"], out["saved_runs"], out["total_sessions"], out["searches"], out["last_cleanup"]) == (3, 1, 1, 1, None)
    assert out["most_used"][0] == ("git status", 2)


def test_import_and_export(spark, engine, tmp_path):
    (tmp_path / "h").write_text("git log\nexit\ngit log\n")
    assert engine.import_history("bash", str(tmp_path / "h"), 10_000, preview=True).count() == 2
    assert tuple(engine.import_history("bash", str(tmp_path / "h"), 10_000, dry_run=True).first()) == (3, 1, 2, 0)
    assert tuple(engine.import_history("bash", str(tmp_path / "h"), 10_000).first()) == (3, 1, 2, 0)
    assert tuple(engine.import_history("bash", str(tmp_path / "h"), 20_000).first()) == (3, 1, 0, 2)
    assert engine.history().where("cwd = 'imported'").select("run_count").first()[0] == 1
    engine.export(str(tmp_path / "out"), "json", 2)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_command_line(spark, engine, tmp_path):
    from echolith.__main__ import _parser, run

    def call(*words):
        return run(engine, _parser().parse_args(["store", *words]), 10_000)

    (tmp_path / "h").write_text("git log\n")
    assert commands(call("search", "git", "status", "--mode", "fts", "--limit", "1")) == ["git status"]
    assert call("recent", "--limit", "2").count() == 2 and call("stats")["total_commands"] == 3
    assert call("import", "--shell", "bash", "--file", str(tmp_path / "h"), "--dry-run").first()["would_import"] == 1
    assert call("cleanup", "failed") == {"removed": 1, "remaining": 2} and call("optimize") is None and call("reindex") == {"embedded": 2}
    assert call("semantic", "git status", "--limit", "1").count() == 1 and call("export", str(tmp_path / "o"), "--format", "csv") is None
    assert call("ask", "disk", "space").count() > 0 and call("explain", "git stash").count() == 1 and call("learn", "go").count() == 1 and call("packs").count() == 6
    with pytest.raises(SystemExit):
        call("search", "x", "--mode", "none")


def test_empty_store(spark):
    e = HistoryEngine(spark, fresh_path(spark, "engine"))
    assert e.history().count() == 0 and e.search("abc").count() == 0 and e.usage()["total_commands"] == 0 and e.cleanup("internal", 1) == (0, 0)


def test_knowledge(engine):
    assert engine.ask("running containers").first()["command"] == "docker ps"
    assert engine.explain("git stash").first()["topic"] == "git"
    assert engine.learn("Go").first()["description"] == "Building Go projects"


def test_index_search_equals_a_scan(spark, rows):
    data = [(f"h{i}", c, w) for i, (c, w) in enumerate([("docker compose up", "/srv"), ("Docker ps", "/compose"), ("git", None), (None, "/docker"), ("", ""), ("composer dock", "/x"), ("größe docker", "/y")])]
    df = spark.createDataFrame(data, "content_hash string, command string, cwd string")
    index = TrigramIndex(spark, fresh_path(spark, "grams"))
    index.add(df.where("content_hash < 'h4'"))
    index.add(df.where("content_hash >= 'h4'"))
    for q in ("docker", "compose docker", "GRÖSSE", "größe", "xyzzy", "ab", "dock ps"):
        assert rows(index.search(df, q), "content_hash") == rows(df.where(F.coalesce(literal_match(q), F.lit(False))), "content_hash")


def test_an_event_delivered_twice_counts_once(spark):
    e = HistoryEngine(spark, fresh_path(spark, "engine"), NgramProvider(64))
    e.ingest(frame(spark, event(1, "make all", 100), event(2, "git status", 200)), once=True)
    e.ingest(frame(spark, (3, " C1 ", "s1", "make all", "/a", 0, 5, 95, 100), event(4, "make all", 300)), once=True)
    assert {r["command"]: r["run_count"] for r in e.history().collect()} == {"make all": 2, "git status": 1}


def test_removed_commands_take_their_vectors_with_them(spark, engine):
    engine.reindex(1)
    engine.cleanup("failed", 1_000)
    assert engine.vectors().count() == 2
    ids = spark.createDataFrame([("c2",)], "command_id string")
    assert engine.delete_vectors(ids) == 1 and engine.reindex(2) == 1
    vector = spark.createDataFrame([("c2", 64, [1.0] + [0.0] * 63, "x", 9)], schemas.VECTORS)
    assert engine.upsert_vectors(vector) == 2
    assert engine.delete_sessions(spark.createDataFrame([("s1",)], "session_id string")) == (2, 0)
    assert engine.vectors().count() == 0 and engine.sessions().count() == 0


def test_writers_do_not_touch_each_others_files(spark, engine):
    other = HistoryEngine(spark, engine.path, NgramProvider(64))
    base = engine.state.read()
    other.ingest(frame(spark, event(7, "ls -la", 700)))
    with pytest.raises(Conflict):
        engine.state.commit({**base, "version": base["version"] + 1})
    engine.ingest(frame(spark, event(8, "df -h", 800)))
    assert {"ls -la", "df -h"} <= {r["command"] for r in engine.history().collect()}

    def snapshot_meanwhile(rows):
        other.optimize()
        return rows

    with pytest.raises(Conflict):
        engine._snapshot(snapshot_meanwhile)


def test_a_store_of_the_version_before(spark, engine):
    old = HistoryEngine(spark, fresh_path(spark, "engine"), NgramProvider(64))
    engine.history().write.parquet(f"{old.path}/folds/batch=2")
    engine.history().limit(0).write.parquet(f"{old.path}/snapshots/3")
    old.state.commit({"version": 1, "schema": 4, "snapshot": 3, "through": 1, "batches": 2, "vectors": []})
    again = HistoryEngine(spark, old.path, NgramProvider(64))
    assert again.state.read()["schema"] == schemas.VERSION and again.count() == 3
    with pytest.raises(RuntimeError):
        again.state.update(lambda s: {**s, "schema": 99})
        HistoryEngine(spark, old.path)


def test_counts_storage_sources_and_supplement(engine):
    assert engine.counts().first().asDict() == {"commands": 3, "runs": 4, "sessions": 1, "queued": 0, "fts_bytes": 600}
    assert engine.storage().first()["files"] >= 2
    assert [tuple(r) for r in engine.source_counts("git", mode="fts").collect()] == [("FTS", 1)]
    assert engine.supplement("running containers", mode="fts").count() == 3 and engine.supplement("git status", mode="fts").count() == 0
