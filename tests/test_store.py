"""Ingest, clean-up, statistics."""

from pyspark.sql import functions as F

from echolith import schemas
from echolith.operators import ingest, retention, stats

EVENTS = "ingest_seq bigint, command_id string, session_id string, command string, cwd string, exit_code int, duration_ms bigint, started_at_ms bigint, completed_at_ms bigint"


def events(spark):
    data = [
        (1, "c1", "s1", "git  status", "/a", 0, 5, 90, 100), (2, "c2", "s1", "git status", " /a ", None, None, None, 50), (3, "c3", "s2", "make", "/a", 2, 7, 190, 200),
        (4, "c4", "s2", "exit", "/a", 0, 1, 1, 300), (5, "c5", "s2", None, "/a", 0, 1, 1, 300), (6, "c6", "s2", "make", None, 0, 1, 1, 300),
    ]
    return spark.createDataFrame(data, EVENTS)


def test_fold_takes_identity_from_the_first_and_outcome_from_the_last_arrival(spark):
    history = {r["id"]: r for r in ingest.fold(ingest.accepted(events(spark))).collect()}
    row = history["c1"]
    assert (row["command"], row["exit_code"], row["duration_ms"], row["completed_at_ms"], row["created_at_ms"], row["run_count"]) == ("git  status", None, None, 50, 100, 2)
    assert set(history) == {"c1", "c3", "c6"}


def test_merged_folds_equal_the_fold_of_all(spark, rows):
    e = ingest.accepted(events(spark)).where("cwd is not null")
    parts = ingest.merge_folds(ingest.fold(e.where("ingest_seq < 2")), ingest.fold(e.where("ingest_seq >= 2")))
    assert rows(parts, *sorted(parts.columns)) == rows(ingest.fold(e), *sorted(parts.columns))


def test_import_batch_adds_only_new_hashes(spark, rows):
    e = ingest.accepted(events(spark)).where("cwd is not null")
    added = ingest.import_batch(ingest.fold(e.where("ingest_seq = 1")), e)
    assert rows(added, "id", "run_count") == [("c3", 1)]


def test_first_session_wins(spark, rows):
    s = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None), (None, 1, "x")], "id string, at int, shell string")
    assert rows(ingest.first_sessions(s, "id", "at"), "id", "shell") == [("a", "early"), ("b", None), (None, "x")]


def test_vectors_are_replaced_and_checked(spark, rows):
    import pytest

    old = spark.createDataFrame([("a", 2, [1.0, 0.0], "m", 1)], schemas.VECTORS)
    new = spark.createDataFrame([("a", 2, [0.0, 1.0], "m", 1), ("b", 2, [1.0, 0.0], "m", 1)], schemas.VECTORS)
    assert [(k, list(v)) for k, v in rows(ingest.upsert_vectors(old, new, 2), "command_id", "embedding")] == [("a", [0.0, 1.0]), ("b", [1.0, 0.0])]
    with pytest.raises(Exception):
        ingest.upsert_vectors(old, new, 3).collect()


def history(spark, n=40):
    data = [(f"h{i:02}", f"i{i}", "s", f"cmd {i}", f"cmd {i}", "/a", i % 3, 1, 1, 1000 + i // 4, 1, 1, 1 + i % 2, 1, 1, i, i) for i in range(n)]
    return spark.createDataFrame(data, schemas.HISTORY)


def test_newest_equals_a_global_sort(spark, rows):
    h = history(spark)
    for most in (1, 3, 4, 7, 39, 40, 50):
        best = h.orderBy(F.desc("completed_at_ms"), "content_hash").limit(most)
        assert rows(retention.newest(h, most), "content_hash") == rows(best, "content_hash")
    assert retention.newest(h.limit(0), 5).count() == 0


def test_modes_remove_and_keep_the_sum(spark):
    h = history(spark)
    for mode in ("internal", "failed", "older-than", "duplicates", "retention", "automatic"):
        left = retention.cleanup(h, mode, now_ms=1005 + 86_400_000, days=1, most=10)
        stats_row = retention.removal(h, left).first()
        assert stats_row["removed"] + stats_row["remaining"] == 40
        again = retention.cleanup(left, mode, now_ms=1005 + 86_400_000, days=1, most=10)
        assert again.count() == left.count()


def test_overdue(spark):
    log = spark.createDataFrame([(100, "automatic", 1, 1)], schemas.CLEANUP_LOG)
    assert retention.overdue(log, 200, 100).first()[0] and not retention.overdue(log, 199, 100).first()[0] and retention.overdue(log.limit(0), 1, 100).first()[0]


def test_search_metrics(spark):
    log = spark.createDataFrame([(1, "hybrid", 120), (2, "semantic", 80)], schemas.SEARCH_LOG)
    assert tuple(stats.search_metrics(log).first()) == (2, 1, 1, 200, 100)
    assert tuple(stats.search_metrics(log.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_usage_of_nothing(spark):
    h = history(spark).limit(0)
    assert tuple(stats.usage_stats(h, h.select("session_id")).first()) == (0, 0, 0, 0, 0)


def test_visible_and_fragmentation(spark, rows):
    from echolith.functions.formats import fragmentation

    r = spark.createDataFrame([("git status", 1, 4), ("exit", 0, 0)], "command string, free int, total int")
    assert rows(stats.visible(r), "command") == [("git status",)] and stats.visible(r, True).count() == 2
    assert [x[0] for x in r.select(fragmentation("free", "total")).collect()] == [25.0, 0.0]
