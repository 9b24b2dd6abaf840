"""Most frequent values of a column, by a hierarchical count-sketch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1


@dataclass(frozen=True)
class SketchShape:
    """``levels``: bits of the hash prefix at each level. ``depth`` rows of ``width`` counters a level.

    The memory of a sketch is len(levels) * depth * width counters, whatever the number of values.
    """

    levels: tuple[int, ...] = (8, 12, 16, 20, 24, 28, 32)
    depth: int = 7
    width: int = 4096
    seed: int = 7

    def cells(self) -> int:
        return len(self.levels) * self.depth * self.width


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x`` and on ``salt``."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def place(shape: SketchShape, level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counter, sign) of hash prefixes. A level with no more prefixes than counters counts each one exactly."""
    if (1 << shape.levels[level]) <= shape.width:
        return prefix.astype(np.int64), np.ones(len(prefix), np.int64)
    h = _mix(prefix, shape.seed + level * shape.depth + row)
    return (h % np.uint64(shape.width)).astype(np.int64), 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def _prefix(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _sketcher(shape: SketchShape):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(shape.levels), shape.depth, shape.width), np.int64)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for level, bits in enumerate(shape.levels):
                seen, n = np.unique(_prefix(hashes, bits), return_counts=True)
                for row in range(shape.depth):
                    at, sign = place(shape, level, row, seen)
                    np.add.at(table[level, row], at, sign * n)
        flat = table.ravel()
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(flat[cells])], names=["cell", "v"])

    return sketch


class Sketch:
    """The merged counters, on the driver; their number is fixed by the shape."""

    def __init__(self, shape: SketchShape, table: np.ndarray):
        self.shape, self.table = shape, table

    def estimates(self, level: int, prefix: np.ndarray) -> np.ndarray:
        """One estimate for each row of the sketch, in ascending order."""
        rows = []
        for row in range(self.shape.depth):
            at, sign = place(self.shape, level, row, prefix)
            rows.append(self.table[level, row][at] * sign)
        return np.sort(np.stack(rows), axis=0)

    def estimate(self, level: int, prefix: np.ndarray) -> np.ndarray:
        return np.median(self.estimates(level, prefix), axis=0)

    def slack(self, level: int) -> float:
        """Four standard errors of one estimate, from the middle of the counters: the few that heavy values sit in don't widen it."""
        if (1 << self.shape.levels[level]) <= self.shape.width:
            return 0.0
        return 4 * float(np.median(np.median(np.abs(self.table[level]), axis=1))) / 0.6745

    def heavy_prefixes(self, at_least: float, most: int) -> list[int] | None:
        """Prefixes of the last level that may hold ``at_least`` rows, by descent through heavy ones only.

        A prefix goes on if three rows of the sketch say so: a true one is lost only if heavy values
        push it down in all but two rows. None if more than ``most`` go on, so that the sketch is too narrow.
        """
        alive, before = np.zeros(1, np.uint64), 0
        for level, bits in enumerate(self.shape.levels):
            step = np.arange(1 << (bits - before), dtype=np.uint64)
            alive = ((alive[:, None] << np.uint64(bits - before)) | step[None, :]).ravel()
            before = bits
            alive = alive[self.estimates(level, alive)[-min(3, self.shape.depth)] >= at_least - self.slack(level)]
            if len(alive) > most:
                return None
        return [int(p) for p in alive]


def sketch_column(df: DataFrame, column: str, shape: SketchShape) -> Sketch:
    """One scan: each task keeps one sketch; counters are added up by cell, so that at most ``shape.cells()`` rows come back."""
    hashes = df.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    rows = hashes.mapInArrow(_sketcher(shape), "cell int, v bigint").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    table = np.zeros(shape.cells(), np.int64)
    table[rows["cell"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return Sketch(shape, table.reshape(len(shape.levels), shape.depth, shape.width))


def frequent_values(df: DataFrame, column: str, share: float = 0.01, shape: SketchShape | None = None) -> DataFrame:
    """Values that hold at least ``share`` of all rows: (column, n_rows, est_rows).

    First scan: a count-sketch with signed hashes for each level of hash prefixes. Descent through
    heavy prefixes, with the sketch's own error as slack, leaves at most a few times 1/share
    candidate prefixes of 32 bits; a sketch too narrow for the share is made anew, four times as wide. Second scan: rows under a candidate prefix are counted
    exactly, with a partial count before the shuffle, so ``n_rows`` is no estimate and nothing below
    the share comes out. ``est_rows`` is what the sketch alone says.

    Defined cases: nulls count among all rows but are no value; the empty string is one; an empty
    table gives no rows; values equal in count all come out; other columns are not read.
    """
    shape = shape or SketchShape()
    total = df.agg(F.count("*")).first()[0]
    sketch, prefixes = sketch_column(df, column, shape), None
    while prefixes is None:
        prefixes = sketch.heavy_prefixes(max(1.0, total * share), max(4_096, int(64 / share)))
        if prefixes is None:  # too narrow for this share; each round is another scan
            shape = replace(shape, width=4 * shape.width)
            sketch = sketch_column(df, column, shape)
    bits = shape.levels[-1]
    key = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    counted = (
        df.select(column).where(F.col(column).isNotNull() & key.isin(prefixes)).groupBy(column).agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") >= F.lit(total) * F.lit(float(share)))
    )
    found = sketch.estimate(len(shape.levels) - 1, np.array(prefixes, np.uint64)) if prefixes else []
    guess = F.create_map(*[F.lit(x) for p, e in zip(prefixes, found) for x in (p, int(e))]) if prefixes else F.lit(None).cast("map<bigint,bigint>")
    return counted.select(column, "n_rows", guess[key].cast("bigint").alias("est_rows"))
