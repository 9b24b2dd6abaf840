"""Stretches of activity separated by pauses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.runtime import materialize

_SCAN = "part int, key string, start_ms bigint, end_ms bigint, n bigint"
_ARROW = pa.schema([("part", pa.int32()), ("key", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("n", pa.int64())])
_FLUSH = 50_000


def _scanner(gap_ms: int):
    """A linear scan over rows sorted by key and start; it keeps one open stretch, whatever comes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        open_key, first_key, seen = None, None, False
        begin = last = count = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * 5
            out_batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)
            out.clear()
            return out_batch

        for batch in batches:
            keys, starts, ends = (batch.column(i).to_pylist() for i in range(3))
            for key, start, end in zip(keys, starts, ends):
                if seen and key == open_key and start <= last + gap_ms:
                    count += 1
                    if end > last:
                        last = end
                    continue
                if seen:
                    out.append((part, open_key, begin, last, count))
                else:
                    seen, first_key = True, key
                open_key, begin, last, count = key, start, end, 1
            if len(out) >= _FLUSH:
                yield flush()
        if seen:
            out.append((part, open_key, begin, last, count))
            # marks (n = 0): the keys that may go on in another partition
            out.extend((part, key, 0, 0, 0) for key in dict.fromkeys((first_key, open_key)))
        yield flush()

    return scan


def stretches(df: DataFrame, key: str, end_ms: str, duration_ms: str, gap_ms: int = 1_800_000, tie: Column | None = None) -> DataFrame:
    """Stretches of each ``key``: (key, start_ms, end_ms, n_rows).

    A row lasts from ``end_ms`` less its duration (0 if null or negative) to ``end_ms``. Rows of one
    key, by start, belong together as long as the next start is at most ``gap_ms`` after the latest
    end so far.

    Secondary sort: rows are spread by *ranges* of (key, start, ``tie``), so that a key with a third
    of all rows covers many partitions, and each partition is scanned once with constant memory. Only
    the first and the last key of a partition can go on elsewhere; their local stretches are joined
    afterwards by way of one summary row for each partition and key, at most two a partition.

    Defined cases: rows whose ``end_ms`` is null have no place in time and are left out; null keys
    are one key of their own; an empty table gives no rows; repeated rows all count; other columns,
    whatever their names, are not read. ``tie`` spreads rows equal in key and start, and changes no result.
    """
    gap_ms = int(gap_ms)
    length = F.when(F.col(duration_ms) > 0, F.col(duration_ms)).otherwise(F.lit(0)).cast("bigint")
    rows = (
        df.where(F.col(end_ms).isNotNull())
        .select(F.col(key).cast("string").alias("_key"), length.alias("_len"), F.col(end_ms).cast("bigint").alias("_end"), (tie if tie is not None else F.col(end_ms)).alias("_tie"))
        .select("_key", (F.col("_end") - F.col("_len")).alias("_start"), "_end", "_tie")
        .repartitionByRange("_key", "_start", "_tie")
        .sortWithinPartitions("_key", "_start", "_tie")
        .select("_key", "_start", "_end")
    )
    local = materialize(rows.mapInArrow(_scanner(gap_ms), _SCAN), "stretches")

    marks = local.where("n = 0").select("part", "key").distinct()
    more = marks.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select(F.col("key").alias("mkey"))
    marks = marks.join(more, F.col("key").eqNullSafe(F.col("mkey"))).select(F.col("part").alias("mpart"), "mkey")
    here = F.col("part").eqNullSafe(F.col("mpart")) & F.col("key").eqNullSafe(F.col("mkey"))
    solid = local.where("n > 0")

    # the latest end before each partition, of the keys that span partitions
    before = Window.partitionBy("mkey").orderBy("mpart").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        solid.join(marks, here).groupBy("mpart", "mkey").agg(F.max("end_ms").alias("latest"))
        .select("mpart", "mkey", F.max("latest").over(before).alias("carry"))
    )
    goes_on = F.col("carry").isNotNull() & (F.col("start_ms") <= F.col("carry") + F.lit(gap_ms))
    spanning = solid.join(carry, here).withColumn("goes_on", goes_on)
    ends = materialize(
        spanning.groupBy("mpart", "mkey").agg(
            F.sum(F.when(F.col("goes_on"), F.col("n"))).alias("more_n"),
            F.max(F.when(F.col("goes_on"), F.col("end_ms"))).alias("more_end"),
            F.max(F.when(~F.col("goes_on"), F.col("start_ms"))).alias("head"),
            F.max("carry").alias("carry"),
        ),
        "stretch-ends",
    )
    head = F.last(F.when(F.col("head").isNotNull(), F.struct("mpart", "head")), ignorenulls=True).over(before)
    adds = (
        ends.withColumn("to", head).where("more_n is not null")
        .groupBy("mkey", F.col("to.mpart").alias("mpart"), F.col("to.head").alias("mstart"))
        .agg(F.sum("more_n").alias("more_n"), F.max("more_end").alias("more_end"))
    )
    at_head = here & (F.col("start_ms") == F.col("mstart"))
    kept = (
        solid.join(ends.select("mpart", "mkey", "carry"), here, "left")
        .where(~F.coalesce(goes_on, F.lit(False)))
        .select("part", "key", "start_ms", "end_ms", "n")
    )
    return kept.join(adds, at_head, "left").select(
        F.col("key").alias(key),
        "start_ms",
        F.greatest("end_ms", F.coalesce("more_end", "end_ms")).alias("end_ms"),
        (F.col("n") + F.coalesce("more_n", F.lit(0))).alias("n_rows"),
    )
