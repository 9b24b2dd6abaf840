import collections
import random

from echolith.llm.frequent import SketchShape, frequent_values, sketch_column

SMALL = SketchShape(levels=(4, 8, 12, 16, 24, 32), depth=5, width=64)


def frame(spark, values):
    return spark.createDataFrame([(v, i, "x") for i, v in enumerate(values)], "v string, n_rows int, h string")


def exact(values, share):
    return sorted((v, n) for v, n in collections.Counter(values).items() if v is not None and n >= share * len(values))


def test_all_heavy_values_and_no_other_with_a_narrow_sketch(spark, rows):
    r = random.Random(5)
    values = [f"hot{min(int(r.expovariate(0.25)), 30)}" for _ in range(9000)] + [f"single{i}" for i in range(9000)] + ["third"] * 9000
    assert rows(frequent_values(frame(spark, values), "v", 0.01, SMALL), "v", "n_rows") == exact(values, 0.01)


def test_estimates_are_near(spark):
    values = ["a"] * 5000 + ["b"] * 1000 + [f"s{i}" for i in range(4000)]
    for r in frequent_values(frame(spark, values), "v", 0.05).collect():
        assert abs(r["est_rows"] - r["n_rows"]) < 200


def test_nulls_count_among_rows_but_are_no_value(spark, rows):
    values = [None] * 98 + ["a", ""]
    assert rows(frequent_values(frame(spark, values), "v", 0.01), "v", "n_rows") == [("", 1), ("a", 1)]
    assert rows(frequent_values(frame(spark, values), "v", 0.02), "v") == []


def test_ties_at_the_share_and_long_values(spark, rows):
    values = [f"{i}" * 3000 for i in range(10)] * 10
    assert len(rows(frequent_values(frame(spark, values), "v", 0.1), "v")) == 10


def test_empty(spark):
    assert frequent_values(frame(spark, []), "v", 0.01).count() == 0


def test_memory_is_that_of_the_shape(spark):
    sketch = sketch_column(frame(spark, [f"v{i}" for i in range(20_000)]), "v", SMALL)
    assert sketch.table.size == SMALL.cells()
