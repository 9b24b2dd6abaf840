import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from echolith.runtime import build_session

    place = tmp_path_factory.mktemp("spark")
    session = build_session("tests", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.checkpoint.dir": f"file://{place}/shared"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples."""

    def get(df, *columns):
        return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)

    return get
