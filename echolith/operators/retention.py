"""Clean-up: each mode takes history and gives what remains of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import filters
from echolith.runtime import materialize

DAY_MS = 86_400_000


def without_internal(history: DataFrame, product: str = filters.PRODUCT) -> DataFrame:
    return history.where(~F.coalesce(filters.cleaned_away("normalized_command", product), F.lit(False)))


def without_failed(history: DataFrame) -> DataFrame:
    """Failures that ran once go."""
    failed = F.col("exit_code").isNotNull() & (F.col("exit_code") != 0) & (F.coalesce("run_count", F.lit(1)) == 1)
    return history.where(~failed)


def not_older_than(history: DataFrame, days: int, now_ms: int) -> DataFrame:
    return history.where(F.col("completed_at_ms") >= now_ms - days * DAY_MS)


def without_duplicates(rows: DataFrame, order: str, key: str = "content_hash") -> DataFrame:
    """The oldest row of each key, by partial aggregates, so that a key with many rows is no hot spot."""
    rest = [c for c in rows.columns if c not in (key, order)]
    firsts = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("f"))
    return firsts.select(*[F.col(c) if c == key else F.col(f"f.{c}").alias(c) for c in rows.columns])


def newest(history: DataFrame, most: int, tie: str = "content_hash") -> DataFrame:
    """The ``most`` newest rows.

    Not one global sort: the time at the border is found from counts for each millisecond, everything
    after it stays, and only the rows of the border itself are ranked.
    """
    if most <= 0:
        return history
    edge = edge_time(history, most)
    if edge is None:
        return history
    border, newer = edge
    at = F.col("completed_at_ms")
    rank = F.row_number().over(Window.partitionBy("completed_at_ms").orderBy(tie))
    of_border = history.where(at == border).withColumn("_r", rank).where(F.col("_r") <= most - newer).drop("_r")
    return history.where(at > border).unionByName(of_border)


def edge_time(history: DataFrame, most: int) -> tuple[int, int] | None:
    """(time of the row of rank ``most``, number of rows newer than that); None if there are no more rows than that.

    Narrows the range of times by a histogram of 4,096 bins at a time; what comes to the driver is that small.
    """
    # history may be a long plan: its times are counted once, and only the counts are read again
    times = materialize(history.where("completed_at_ms is not null").groupBy("completed_at_ms").agg(F.count("*").alias("n")), "times")
    low, high, n = times.agg(F.min("completed_at_ms"), F.max("completed_at_ms"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= most:
        return None
    newer, at = 0, F.col("completed_at_ms")
    while low < high:
        width = (high - low) // 4096 + 1
        bins = times.where((at >= low) & (at <= high)).groupBy(F.expr(f"(completed_at_ms - {low}) div {width}").alias("b")).agg(F.sum("n")).collect()
        for b, count in sorted(bins, reverse=True):
            if newer + count >= most:
                low, high = low + b * width, min(high, low + b * width + width - 1)
                break
            newer += count
    return low, newer


def overflow(history: DataFrame, skip: int, tie: str = "content_hash") -> DataFrame:
    """The rows after the first ``skip`` ones, newest first: the complement of ``newest``, and like it no global sort."""
    if skip <= 0:
        return history
    edge = edge_time(history, skip)
    if edge is None:
        return history.limit(0)
    border, newer = edge
    at = F.col("completed_at_ms")
    rank = F.row_number().over(Window.partitionBy("completed_at_ms").orderBy(tie))
    of_border = history.where(at == border).withColumn("_r", rank).where(F.col("_r") > skip - newer).drop("_r")
    return history.where((at < border) | at.isNull()).unionByName(of_border)


def by_policy(history: DataFrame, days: int, most: int, now_ms: int, tie: str = "content_hash") -> DataFrame:
    """By age if ``days`` is above 0, then by number if ``most`` is."""
    rows = not_older_than(history, days, now_ms) if days > 0 else history
    return newest(rows, most, tie)


def automatic(history: DataFrame, days: int, most: int, now_ms: int, product: str = filters.PRODUCT) -> DataFrame:
    return by_policy(without_internal(history, product), days, most, now_ms)


def cleanup(history: DataFrame, mode: str, *, now_ms: int = 0, days: int = 365, most: int = 1_000_000, order: str = "first_seq", product: str = filters.PRODUCT) -> DataFrame:
    """By name of the mode."""
    modes = {
        "internal": lambda: without_internal(history, product),
        "failed": lambda: without_failed(history),
        "older-than": lambda: not_older_than(history, days, now_ms),
        "duplicates": lambda: without_duplicates(history, order),
        "retention": lambda: by_policy(history, days, most, now_ms),
        "automatic": lambda: automatic(history, days, most, now_ms, product),
    }
    if mode not in modes:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(modes)}")
    return modes[mode]()


def removal(before: DataFrame, after: DataFrame) -> DataFrame:
    """(removed, remaining)."""
    n = before.agg(F.count("*")).scalar()
    return after.agg(F.count("*").alias("remaining")).select(F.greatest(n - F.col("remaining"), F.lit(0)).cast("bigint").alias("removed"), "remaining")


def log_entry(stats: DataFrame, mode: str, now_ms: int) -> DataFrame:
    """A row for the clean-up log."""
    return stats.select(F.lit(now_ms).cast("bigint").alias("at_ms"), F.lit(mode).alias("mode"), "removed", "remaining")


def overdue(log: DataFrame, now_ms: int, interval_ms: int = DAY_MS) -> DataFrame:
    """(overdue): whether the last clean-up is ``interval_ms`` ago or there was none."""
    return log.agg(F.coalesce(F.lit(now_ms) - F.max("at_ms") >= interval_ms, F.lit(True)).alias("overdue"))


def surviving_children(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is still there: deletes go on to what depends on them."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")
