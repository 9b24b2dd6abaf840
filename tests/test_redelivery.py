import pytest
from pyspark.sql import functions as F

from echolith.manifest import Conflict
from echolith.operators.redelivery import MessageStore
from echolith.runtime import fresh_path

SCHEMA = "seq bigint, id string, day string, body string, w int, _x string"


def store(spark):
    return MessageStore(spark, fresh_path(spark, "t"), "id", "seq", F.col("day"), ["day", "body"])


def frame(spark, data):
    return spark.createDataFrame([(*d, 1, "x") for d in data], SCHEMA)


def kept(rows, s):
    return rows(s.read(), "seq", "body", "n_deliveries")


def test_winner_is_the_first_whatever_the_batch(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(5, "A", "d1", "five"), (6, "b", "d1", "six"), (7, " a ", "d2", "seven")]))
    assert kept(rows, s) == [(5, "five", 2), (6, "six", 1)]
    s.merge(frame(spark, [(2, "a\t", "d3", "two"), (9, "B", "d3", "nine"), (10, "c", "d3", "ten")]))
    assert kept(rows, s) == [(10, "ten", 1), (2, "two", 3), (6, "six", 2)]


def test_only_touched_periods_are_written(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d1", "x"), (2, "b", "d2", "y"), (3, "c", "d3", "z")]))
    manifest = s.merge(frame(spark, [(4, "b", "d4", "again"), (5, "new", "d4", "n")]))
    first, second = manifest["periods"]["d1"]["parts"], manifest["periods"]["d2"]["parts"]
    assert {p: where["parts"] for p, where in manifest["periods"].items()} == {"d1": first, "d2": second, "d3": first, "d4": second} and first != second
    assert len(kept(rows, s)) == 4


def test_a_period_that_loses_all_rows(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(8, "a", "d2", "late")]))
    manifest = s.merge(frame(spark, [(1, "a", "d1", "early")]))
    assert list(manifest["periods"]) == ["d1"]
    assert kept(rows, s) == [(1, "early", 2)]


def test_blank_and_null_identifiers_are_never_the_same(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "", "d", "a"), (2, "  ", "d", "b"), (3, None, None, "c")]))
    s.merge(frame(spark, [(4, "", "d", "e"), (5, " ", "d", "f")]))
    assert [r[0] for r in kept(rows, s)] == [1, 2, 3, 4, 5]


def test_unfinished_merge_leaves_the_old_version(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d", "x")]))
    with pytest.raises(Exception):
        s.merge(frame(spark, [(2, "a", "d", "y")]).withColumn("seq", F.raise_error(F.lit("lost")).cast("bigint")))
    assert s.manifest()["version"] == 1
    assert kept(rows, s) == [(1, "x", 1)]


def test_empty_batch_and_repeats(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d", None)] * 3))
    s.merge(frame(spark, []))
    assert kept(rows, s) == [(1, None, 3)]


def test_fresh_rows_are_appended_to_their_period(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d1", "x"), (2, "b", "d2", "y")]))
    manifest = s.merge(frame(spark, [(3, "c", "d1", "z"), (4, "b", "d3", "again")]))
    parts = {p: len(where["parts"]) for p, where in manifest["periods"].items()}
    assert parts == {"d1": 2, "d2": 1}
    manifest = s.merge(frame(spark, [(5, "A", "d1", "again"), (6, "C", "d4", "again")]))
    assert {p: len(where["parts"]) for p, where in manifest["periods"].items()} == {"d1": 1, "d2": 1}
    assert kept(rows, s) == [(1, "x", 2), (2, "y", 2), (3, "z", 2)]


def test_a_store_opened_again(spark, rows):
    s = store(spark)
    assert s.read() is None
    s.merge(frame(spark, [(1, "a", "d", "x")]))
    again = MessageStore(spark, s.path, "id", "seq", F.col("day"), ["day", "body"])
    assert kept(rows, again) == [(1, "x", 1)]
    again.merge(frame(spark, [(2, "a", "e", "y")]))
    assert kept(rows, s) == [(1, "x", 2)]


def test_death_between_write_and_commit(spark, rows, monkeypatch):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d", "x")]))
    batch = frame(spark, [(2, "a", "d", "y"), (3, "b", "d", "z")])
    with monkeypatch.context() as m:
        m.setattr(s._state, "commit", lambda state: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            s.merge(batch)
    assert kept(rows, s) == [(1, "x", 1)]
    s.merge(batch)
    assert kept(rows, s) == [(1, "x", 2), (3, "z", 1)]


def test_of_two_writers_one_gets_a_conflict(spark, rows):
    s, other = store(spark), None
    s.merge(frame(spark, [(1, "a", "d", "x")]))
    other = MessageStore(spark, s.path, "id", "seq", F.col("day"), ["day", "body"])
    mine = s.prepare(s.manifest(), frame(spark, [(2, "b", "d", "mine")]))
    other.merge(frame(spark, [(3, "c", "d", "theirs")]))
    with pytest.raises(Conflict):
        s._state.commit(mine)
    assert kept(rows, s) == [(1, "x", 1), (3, "theirs", 1)]
    s.merge(frame(spark, [(2, "b", "d", "mine")]))
    assert kept(rows, s) == [(1, "x", 1), (2, "mine", 1), (3, "theirs", 1)]


def test_many_merges_are_compacted_and_stay_right(spark, rows):
    import random

    r = random.Random(3)
    s = MessageStore(spark, fresh_path(spark, "t"), "id", "seq", F.col("day"), ["day", "body"], buckets=4, most_runs=2)
    data = [(i, f"k{r.randrange(12)}", f"d{r.randrange(4)}", f"b{i}") for i in range(40)]
    r.shuffle(data)
    for at in range(0, 40, 8):
        manifest = s.merge(frame(spark, data[at : at + 8]))
        assert len(manifest["index"]) <= 2
    s.compact(1)
    assert all(len(where["parts"]) == 1 for where in s.manifest()["periods"].values())
    first, n = {}, {}
    for d in sorted(data):
        first.setdefault(d[1], d)
        n[d[1]] = n.get(d[1], 0) + 1
    assert kept(rows, s) == sorted(((d[0], d[3], n[k]) for k, d in first.items()), key=repr)


def test_fresh_messages_only(spark, rows):
    s = store(spark)
    s.merge(frame(spark, [(1, "a", "d", "x")]))
    assert rows(s.fresh(s.manifest(), frame(spark, [(2, "A", "d", "again"), (3, "b", "d", "n"), (4, "B", "d", "n2"), (5, None, "d", "alone")])), "seq") == [(3,), (5,)]
