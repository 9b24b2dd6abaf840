from pathlib import Path

from pyspark.sql import functions as F

from echolith.manifest import Manifest
from echolith.runtime import fresh_path, materialize, shared_dir


def test_tables_go_to_the_folder_of_the_session(spark):
    place = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == place
    rows = materialize(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t")
    assert rows.count() == 5 and rows.schema["x"].dataType.simpleString() == "string"
    assert list(Path(place.removeprefix("file://")).glob("echolith/t-*/*.parquet"))


def test_an_empty_table_keeps_its_schema(spark):
    assert materialize(spark.range(0), "t").dtypes == [("id", "bigint")]


def test_a_version_is_committed_once(spark):
    import pytest

    m = Manifest(spark, fresh_path(spark, "m"), {"x": 0})
    assert m.read() == {"version": 0, "x": 0}
    m.commit({"version": 1, "x": 5})
    with pytest.raises(RuntimeError):
        m.commit({"version": 1, "x": 6})
    assert m.read() == {"version": 1, "x": 5}
