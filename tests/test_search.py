import math

import pytest
from pyspark.sql import functions as F

from echolith import schemas
from echolith.operators import hybrid, knowledge, lexical, vector

COLUMNS = "content_hash string, id string, command string, cwd string, exit_code int, duration_ms bigint, completed_at_ms bigint, run_count bigint"


def history(spark):
    data = [
        ("h1", "1", "git status", "/a/b", 0, 1, 100, 3), ("h2", "2", "docker compose up", "/a/c", 0, 1, 200, 1), ("h3", "3", "docker-compose logs", "/x", 1, None, 300, 1), ("h4", "4", "exit docker", "/a/b", 0, 1, 400, 9), ("h5", "5", "ls", "/docker", None, 1, 500, 1),
    ]
    return spark.createDataFrame(data, COLUMNS)


def found(df):
    return [r["content_hash"] for r in df.collect()]


def test_terms_are_joined_by_and_and_short_ones_ignored(spark):
    h = history(spark)
    assert found(h.where(lexical.literal_match("docker lo"))) == ["h2", "h3", "h4", "h5"]
    assert found(h.where(lexical.literal_match("compose DOCKER"))) == ["h2", "h3"]
    assert found(h.where(lexical.literal_match("ls"))) == []
    assert found(h.where(lexical.literal_match("docker-compose"))) == ["h3"]


def test_query_language(spark):
    h = history(spark)
    assert found(h.where(lexical.syntax_match("docker NOT compose"))) == ["h4", "h5"]
    assert found(h.where(lexical.syntax_match("command:docker (compose OR exit)"))) == ["h2", "h3", "h4"]
    assert found(h.where(lexical.syntax_match('"docker compose" OR stat*'))) == ["h1", "h2"]
    for bad in ("nosuch:x", "(docker", "AND", "docker )"):
        with pytest.raises(ValueError):
            lexical.syntax_match(bad)


def test_scores(spark):
    out = {r["content_hash"]: r for r in lexical.search(history(spark), "docker", 3, cwd="/a/c").collect()}
    # four rows hit; the internal one has score 0 but counts for the ranges
    assert list(out) == ["h5", "h2", "h3"]
    assert math.isclose(out["h2"]["score"], 0.5 + 0.2 * 0 + 0.2 * 0 + 0.1 * 1.0)
    assert out["h5"]["match_kind"] == "exact"


def test_few_hits_bring_prefixes_and_typos(spark):
    h = history(spark)
    assert set(found(lexical.search(h, "gi", 5))) == {"h1"}
    assert found(lexical.search(h, "gti", 5)) == []
    assert "h1" in found(lexical.search(h, "gitt", 5)) and lexical.search(h, "gitt", 5).first()["match_kind"] == "partial"
    assert lexical.search(h, "gitt", 5, keep_fuzzy=True).first()["match_kind"] == "fuzzy"
    assert found(lexical.search(h, "  ", 5)) == []


def test_recent_only(spark):
    out = lexical.search(history(spark), "docker", 3, recent_only=True).collect()
    assert [r["content_hash"] for r in out] == ["h5", "h4", "h3"] and [round(r["score"], 6) for r in out] == [1.0, 0.666667, 0.333333]


def test_batch_equals_single(spark):
    h = history(spark)
    many = lexical.batch_search(h, [(1, "docker"), (2, "git"), (3, "zz")], 10, block=1)
    for i, q in ((1, "docker"), (2, "git")):
        assert [r["content_hash"] for r in many.where(F.col("query_id") == i).orderBy("rank").collect()] == found(lexical.search(h, q, 1 if i == 2 else 4))


def test_knn_ignores_what_is_no_vector_and_breaks_ties_by_key(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None)], "command_id string, embedding array<float>")
    assert [(r[0], round(r[1], 6)) for r in vector.knn(v, [1.0, 0.0], 2).collect()] == [("a", 0.0), ("b", 0.0)]
    assert vector.knn(v.limit(0), [1.0, 0.0], 2).count() == 0


def test_fusion(spark):
    fields = "command string, cwd string, exit_code int, duration_ms bigint, completed_at_ms bigint, run_count bigint, match_kind string, score double, p int"
    words = spark.createDataFrame([("x", "/", 0, 1, 5, 3, "exact", 0.9, 1), ("y", "/", 0, 1, 5, 3, "exact", 0.8, 2)], fields)
    near = spark.createDataFrame([("y", "/", 0, 1, 5, 0.1), ("z", "/", 0, 1, 5, 0.2)], "command string, cwd string, exit_code int, duration_ms bigint, completed_at_ms bigint, distance double")
    out = hybrid.fuse(words, [F.col("p")], near, [F.col("distance")], 10).orderBy(F.desc("score")).collect()
    assert [(r["command"], r["source"], r["run_count"]) for r in out] == [("y", "HYB", 3), ("x", "FTS", 3), ("z", "SEM", 1)]
    top = hybrid.LEXICAL_WEIGHT / 62 + hybrid.SEMANTIC_WEIGHT / 61
    assert out[0]["score"] == 1.0 and math.isclose(out[1]["score"], hybrid.LEXICAL_WEIGHT / 61 / top)
    alone = hybrid.fuse(words, [F.col("p")], near.limit(0), [F.col("distance")], 10).collect()
    assert sorted((r["command"], r["source"], r["score"]) for r in alone) == [("x", "FTS", 0.9), ("y", "FTS", 0.8)]


KB = "ordinal bigint, command string, description string, category string, topic string, aliases array<string>, difficulty int"


def kb(spark):
    return spark.createDataFrame([(0, "docker ps", "list containers", "look", "docker", ["running containers"], 1), (1, "docker pull", "fetch an image", "images", "docker", None, 2), (2, "git log", "show history", "look", "git", [], 1)], KB)


def test_ask_explain_learn(spark):
    e = kb(spark)
    assert knowledge.ask(e, "running containers").first()["confidence"] == 1.0
    assert knowledge.ask(e, "").count() == 0
    many = knowledge.ask_many(e, [(5, "running containers"), (7, "git"), (9, "")], 2, block=2).orderBy("question_id", "rank").collect()
    assert [(r["question_id"], r["command"]) for r in many if r["rank"] == 1] == [(5, "docker ps"), (7, "git log")]
    assert [r["command"] for r in knowledge.explain(e, "GIT").collect()] == ["git log"]
    assert [r["command"] for r in knowledge.explain(e, "docker").collect()] == ["docker ps"]
    assert [r["command"] for r in knowledge.explain(e, "docker pu").collect()] == ["docker pull"]
    assert knowledge.explain(e, "nothing").count() == 0
    row = knowledge.learn(e, "Docker").first()
    assert [c["name"] for c in row["categories"]] == ["images", "look"] and row["description"] == "Docker commands"
    assert knowledge.learn(e, "none").count() == 0


def test_supplement(spark):
    results = spark.createDataFrame([("exact", 0.9)], "match_kind string, score double")
    answers = spark.createDataFrame([(i, 0.9 - i / 10) for i in range(6)], "ordinal int, confidence double")
    assert knowledge.supplement(results, answers).count() == 0
    assert knowledge.supplement(results.limit(0), answers).count() == 3
    assert knowledge.supplement(results.withColumn("score", F.lit(0.2)), answers).count() == 5


def test_topics(spark, rows):
    packs = spark.createDataFrame([("Git", "one", False, 0), ("git", "two", False, 1), ("git", "custom", True, 2), ("own", "first", True, 3), ("own", "second", True, 4)], "topic string, description string, simple boolean, load_order int")
    assert rows(knowledge.topics(packs)) == [("git", "two"), ("own", "first")]
