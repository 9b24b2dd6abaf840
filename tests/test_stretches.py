import random

from echolith.operators.stretches import stretches

SCHEMA = "session string, completed bigint, took bigint, n bigint, part string, key int"


def expected(data, gap):
    out, by_key = [], {}
    for key, end, took, *_ in data:
        if end is not None:
            by_key.setdefault(key, []).append((end - max(took or 0, 0), end))
    for key, spans in by_key.items():
        first = last = None
        for start, end in sorted(spans):
            if last is None or start > last + gap:
                if last is not None:
                    out.append((key, first, last, n))
                first, last, n = start, end, 0
            last, n = max(last, end), n + 1
        out.append((key, first, last, n))
    return sorted(out, key=repr)


def run(spark, rows, data, gap=100, parts=4):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return rows(stretches(spark.createDataFrame(data, SCHEMA), "session", "completed", "took", gap), "session", "start_ms", "end_ms", "n_rows")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_key_over_many_partitions(spark, rows):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.6 else f"s{r.randrange(9)}", r.randrange(20_000), r.choice([None, -5, 0, 3, 40, 900]), 1, "x", 2) for _ in range(900)]
    for parts in (1, 5, 40):
        assert run(spark, rows, data, 25, parts) == expected(data, 25)


def test_one_long_row_covers_many_partitions(spark, rows):
    data = [("a", 100_000, 100_000, 0, "", 0)] + [("a", i * 500, 1, 0, "", 0) for i in range(1, 200)]
    assert run(spark, rows, data, 10, 16) == [("a", 0, 100_000, 200)]


def test_nulls_ties_and_repeats(spark, rows):
    data = [(None, 10, None, None, None, None), (None, 10, None, None, None, None), ("a", None, 5, 1, "p", 1), ("", 50, -1, 1, "p", 1), ("", 150, 0, 1, "p", 1), ("", 251, 0, 1, "p", 1)]
    assert run(spark, rows, data) == expected(data, 100)


def test_gap_is_inclusive(spark, rows):
    data = [("a", 0, 0, 0, "", 0), ("a", 100, 0, 0, "", 0), ("a", 201, 0, 0, "", 0)]
    assert run(spark, rows, data) == [("a", 0, 100, 2), ("a", 201, 201, 1)]


def test_empty(spark, rows):
    assert run(spark, rows, []) == []
