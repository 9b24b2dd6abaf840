"""Events as a stream: arrival, fold into history, counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echolith import schemas
from echolith.manifest import Manifest, attempt
from echolith.operators.ingest import accepted, fold, merge_folds
from echolith.operators.retention import cleanup
from echolith.runtime import hadoop_path


def event_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Parquet files as they land; no more than ``files_per_batch`` at a time, and none is lost when that is full."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class HistoryStream:
    """History kept by micro-batches.

    Each batch is folded for itself and written under its number, so a batch that runs again after a
    failure replaces its own folder and nothing is counted twice. ``read`` merges the last snapshot with the folds after it;
    ``compact`` makes such a snapshot, less what a clean-up ``mode`` removes, and deletes the folds that it holds. Order is
    that of ``ingest_seq``: late events need no watermark, they are just folded in.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.state = Manifest(spark, self.path, {"snapshot": None, "through": -1})

    def _write(self, batch: DataFrame, number: int) -> None:
        fold(accepted(batch)).write.mode("overwrite").parquet(f"{self.path}/folds/batch={number}")

    def start(self, events: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.path}/progress")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _numbers(self) -> list[int]:
        fs, root = hadoop_path(self.spark, f"{self.path}/folds")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith("batch="))

    def _parts(self, state: dict, numbers: list[int]) -> DataFrame:
        paths = [f"folds/batch={n}" for n in numbers if n > state["through"]] + ([f"snapshots/{state['snapshot']}"] if state["snapshot"] else [])
        if not paths:
            return self.spark.createDataFrame([], schemas.HISTORY)
        rows = self.spark.read.schema(schemas.HISTORY).parquet(*[f"{self.path}/{p}" for p in paths])
        return merge_folds(rows, rows.limit(0))

    def read(self) -> DataFrame:
        return self._parts(self.state.read(), self._numbers())

    def compact(self, mode: str | None = None, **options) -> DataFrame:
        """History as it is after a snapshot of all folds so far; ``mode`` and its options as in ``retention.cleanup``."""
        base, numbers = self.state.read(), self._numbers()
        rows, name = self._parts(base, numbers), attempt("snapshot")
        (cleanup(rows, mode, **options) if mode else rows).write.parquet(f"{self.path}/snapshots/{name}")
        through = max([base["through"], *numbers])
        self.state.commit({"version": base["version"] + 1, "snapshot": name, "through": through})
        for n in numbers:
            fs, where = hadoop_path(self.spark, f"{self.path}/folds/batch={n}")
            fs.delete(where, True)
        return self.read()

    def batches(self) -> int:
        """Batches folded since the last snapshot."""
        return sum(n > self.state.read()["through"] for n in self._numbers())


def daily_counts(events: DataFrame, at: str, kind: str, late: str = "1 day") -> DataFrame:
    """(day, kind, n) in tumbling windows; on a stream rows later than ``late`` are dropped once a window is closed."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(at, "1 day"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), kind, "n")


def idle_sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(key, start, end, n): stretches of activity on a stream, by session windows."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
