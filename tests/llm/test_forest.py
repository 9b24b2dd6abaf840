import random

import pytest
from pyspark.sql import functions as F

from echolith.llm import forest
from echolith.llm.forest import ForestShape, HistoryForest, labels, shingles, similar
from echolith.runtime import fresh_path

SCHEMA = "rec string, batch int, text string, place string, run int"


def normal(text):
    return " ".join(text.split()).lower()


def truth(history, waiting):
    before = [(0, p.strip(), normal(t)) for _, _, t, p in history if None not in (t, p)] + [(b, p.strip(), normal(t)) for _, b, t, p in waiting if None not in (t, p)]
    return sorted((k,) for k, b, t, p in waiting if None not in (t, p) and any(bb < b and pp == p.strip() and similar(normal(t), tt, (3, 4)) for bb, pp, tt in before))


def found(spark, rows, history, waiting, shape=None):
    frame = lambda data: spark.createDataFrame([(*d, 7) for d in data], SCHEMA)
    f = HistoryForest(spark, fresh_path(spark, "f"), shape)
    f.append(HistoryForest.records(frame(history), "text", "place", F.lit(0)), "history")
    f.append(HistoryForest.records(frame(waiting), "text", "place", F.col("batch")), "waiting")
    return rows(f.match(frame(waiting), "rec", "text", "place", F.col("batch")))


def random_lines(n, seed):
    r = random.Random(seed)
    words = ["docker", "compose", "status", "install", "--verbose", "origin", "feature", "release", "config", "cluster", "--follow", "restart"]
    lines = [" ".join(r.choices(words, k=r.randint(2, 6))) for _ in range(n // 2)]
    for line in list(lines):
        i = r.randrange(len(line))
        lines.append(line[:i] + r.choice("xyz1 ") + line[i + r.randrange(2) :])
    return lines


def test_equals_brute_force(spark, rows):
    lines = random_lines(300, 1)
    history = [(f"h{i}", 0, t, f"/p{i % 2}") for i, t in enumerate(lines[::2])]
    waiting = [(f"n{i}", 1 + i % 3, t.upper() if i % 5 == 0 else t, f" /p{i % 2}\t") for i, t in enumerate(lines[1::2])]
    assert found(spark, rows, history, waiting) == truth(history, waiting)


def test_batches_see_only_lower_ones(spark, rows):
    waiting = [("a", 1, "make all the things", "/"), ("b", 1, "make all the things", "/"), ("c", 2, "make  all the things", "/"), ("d", 3, "something else here", "/")]
    assert found(spark, rows, [], waiting) == [("c",)]


def test_edges(spark, rows):
    history = [("h1", 0, "", "/"), ("h2", 0, "ab", "/"), ("h3", 0, None, "/"), ("h4", 0, "x", None), ("h5", 0, "y " * 30_000, "/")]
    waiting = [("a", 1, " ", "/"), ("b", 1, "AB", "/"), ("c", 1, None, "/"), ("d", 1, "x", None), ("e", 1, "y " * 30_001, "/"), ("f", 1, "abc", "/"), ("g", 1, "", "/other")]
    assert found(spark, rows, history, waiting) == [("a",), ("b",), ("e",)]
    assert found(spark, rows, history, []) == []


@pytest.mark.parametrize(("chunk", "batch", "file_rows", "asked_rows"), [(8_192, 10_000, 1_000_000, 262_144), (7, 15, 90, 10), (40, 3, 25, 1_000)])
def test_a_hot_prefix_gets_all_its_candidates(spark, rows, monkeypatch, chunk, batch, file_rows, asked_rows):
    """Also where its rows are spread over files, and its questions over tasks."""
    monkeypatch.setattr(forest, "_CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    base = "kubectl get pods --all-namespaces --watch --output wide --selector application"
    history = [(f"h{i}", 0, f"{base}={i:05}", "/") for i in range(200)]
    waiting = [(f"n{i}", 1, f"{base}={i:05}x", "/") for i in range(0, 200, 7)] + [("m", 1, base[:50] + " entirely different tail of the line", "/")]
    try:
        assert found(spark, rows, history, waiting, ForestShape(nearest=2, file_rows=file_rows, asked_rows=asked_rows)) == truth(history, waiting)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def appended(spark, path, lines, shape=None):
    f = HistoryForest(spark, path, shape)
    frame = spark.createDataFrame([(f"r{i}", 0, t, "/", 0) for i, t in enumerate(lines)], SCHEMA)
    f.append(HistoryForest.records(frame, "text", "place", F.lit(0)), "history")
    return f


def test_merged_runs_give_the_same_and_a_forest_is_opened_again(spark, rows):
    lines = random_lines(80, 4)
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    f = HistoryForest(spark, fresh_path(spark, "f"))
    for b in range(3):
        f.append(HistoryForest.records(frame([(f"r{i}", b, t, "/", 0) for i, t in enumerate(lines[b::4])]), "text", "place", F.col("batch")), f"b{b}")
    asked = frame([(f"n{i}", 3, t, "/", 0) for i, t in enumerate(lines[3::4])])
    before = rows(f.match(asked, "rec", "text", "place", F.col("batch")))
    again = HistoryForest(spark, f.path)
    assert len(again.runs) == 3 and before
    again.merge_runs("all")
    assert len(f.runs) == 1 and rows(f.match(asked, "rec", "text", "place", F.col("batch"))) == before


def test_many_appends_merge_the_small_runs(spark, rows):
    f = HistoryForest(spark, fresh_path(spark, "f"), ForestShape(most_runs=2))
    for b, line in enumerate(["git status --short", "docker compose up", "make all the things"]):
        frame = spark.createDataFrame([("r", b, line, "/", 0)], SCHEMA)
        f.append(HistoryForest.records(frame, "text", "place", F.col("batch")), f"b{b}")
    assert len(f.runs) == 2
    asked = spark.createDataFrame([("n1", 9, "GIT status  --short", "/", 0), ("n2", 9, "docker compose ups", "/", 0), ("n3", 9, "else", "/", 0)], SCHEMA)
    assert rows(f.match(asked, "rec", "text", "place", F.col("batch"))) == [("n1",), ("n2",)]


def test_what_a_batch_reads_does_not_grow_with_history(spark):
    """Files and rows of labels and texts that three lines lead to, in a history of some size and one of four times it."""
    shape = ForestShape(file_rows=40)
    asked = spark.createDataFrame([("a", 1, "an entirely new line of text", "/", 0), ("b", 1, "kubectl rollout undo deployment web", "/", 0), ("c", 1, "psql -h db -c select", "/", 0)], SCHEMA)
    asked = HistoryForest.records(asked, "text", "place", F.col("batch"))
    signed = asked.select("rec", "place_h", "text", "run").mapInArrow(forest._sign(shape), forest._SIGNED)
    files, all_files, texts = [], [], []
    for n in (500, 2_000):
        r = random.Random(n)
        f = appended(spark, fresh_path(spark, "f"), ["".join(r.choices("abcdefghijklmnopqrstuvwxyz -/", k=30)) for _ in range(n)], shape)
        fences = f.fences()
        files.append(f.routed(signed, fences["labels"]).select("file").distinct().count())
        texts.append(f.texts_of(asked, fences["texts"]).count())
        all_files.append(len(fences["labels"].paths))
    assert all_files[1] > 3.5 * all_files[0]
    assert max(files) <= 3 * shape.trees * 2 and max(texts) <= 3 * 2 * shape.file_rows


def test_a_writer_that_dies_leaves_the_forest_as_it_was(spark, rows, monkeypatch):
    f = appended(spark, fresh_path(spark, "f"), ["git status --short"])
    more = HistoryForest.records(spark.createDataFrame([("r", 1, "docker compose up", "/", 0)], SCHEMA), "text", "place", F.col("batch"))
    with monkeypatch.context() as m:
        m.setattr(f._state, "update", lambda change: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            f.append(more, "b1")
    assert len(f.runs) == 1
    f.append(more, "b1")
    asked = spark.createDataFrame([("n", 2, "docker compose  up", "/", 0)], SCHEMA)
    assert len(f.runs) == 2 and rows(f.match(asked, "rec", "text", "place", F.col("batch"))) == [("n",)]


def test_recall_of_the_shape():
    shape = ForestShape()
    k = shape.shortest()
    assert 1 - (1 - 0.75**k) ** shape.trees >= shape.recall and (k == shape.depth or 1 - (1 - 0.75 ** (k + 1)) ** shape.trees < shape.recall)


def test_labels_depend_on_the_set_of_shingles_only():
    shape = ForestShape()
    a = labels(["abcabcabc", "abcabc", "abd", "", "a", "漢字かな"], shape)
    assert (a[0] == a[1]).all() and len({tuple(x) for x in a[1:].tolist()}) == 5
    assert shingles("ab") == {"ab"} and shingles("") == {""} and len(shingles("abcabc")) == 3
