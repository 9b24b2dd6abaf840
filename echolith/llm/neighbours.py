"""The most similar vectors of every vector, by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.runtime import materialize

_SCALE = 32767


@dataclass(frozen=True)
class IndexShape:
    """The two codebooks are fitted on ``sample`` vectors or 32 for each centroid, at most 32 * ``most_centroids``;
    everything else sees all vectors.

    A query visits the cells nearest to it until it has seen ``least_cells`` of them and
    ``least_entries`` entries; both are doubled until ``probes`` of the vectors find ``recall`` of
    their true neighbours, at the end by visits to all cells. Cells near to each other are scanned by one
    task, up to ``part`` entries; cells of more than ``block`` entries are scanned by several tasks. The members of
    a group of copies are unfolded in ``salts`` tasks.
    """

    dims: int = 384
    sample: int = 16_384
    rounds: int = 8
    most_centroids: int = 4_096
    least_cells: int = 4
    least_entries: int = 32
    block: int = 4_096
    seed: int = 11
    per_cell: int = 64
    part: int = 8_192
    probes: int = 512
    recall: float = 0.995
    salts: int = 16

    def centroids(self, n: int) -> int:
        """Of each half: a power of two, for cells of about ``per_cell`` vectors, so that cells do not grow with the table."""
        k = 16
        while k * k * self.per_cell < n and k < self.most_centroids:
            k *= 2
        return k

    def sampled(self, n: int) -> int:
        return max(self.sample, 32 * self.centroids(n))


def _unit_rows(blobs: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the blobs that hold a usable vector."""
    at = [i for i, b in enumerate(blobs) if b is not None and len(b) == 4 * dims]
    if not at:
        return np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
    x = np.frombuffer(b"".join(blobs[i] for i in at), "<f4").reshape(len(at), dims).astype(np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1)
        ok = np.isfinite(x).all(axis=1) & (top > 0)
        x = x[ok] / top[ok, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
    return np.array(at, np.int64)[ok], x.astype(np.float32)


def _codes(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.rint(x * _SCALE).astype("<i2")]


def _vectors(codes: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<i2").reshape(len(codes), dims).astype(np.float32) / _SCALE


def fit_codebook(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means centroids of the rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        seen, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        n = np.diff(np.append(first, len(x)))
        centres[seen] = sums / n[:, None]
        empty = np.setdiff1d(np.arange(k), seen)
        centres[empty] = x[rng.integers(0, len(x), len(empty))]
    return centres.astype(np.float32)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)


def visit(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, k: int, least_cells: int, least_entries: int, limit: int | None = None) -> list[int]:
    """Cells by the sum of their two distances, nearest first: a heap over pairs of ranks, each pushed by its
    left or upper neighbour. Empty cells are passed over. At most ``limit`` pairs are looked at, 64 for each of
    the least cells if it is not given."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, pushed, cells, entries = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}, [], 0
    limit = 64 * least_cells if limit is None else limit
    while heap and limit and (len(cells) < least_cells or entries < least_entries):
        _, i, j = heapq.heappop(heap)
        limit -= 1
        cell = int(o1[i]) * k + int(o2[j])
        if n := int(counts[cell]):
            cells.append(cell)
            entries += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < k and b < k and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (float(d1[o1[a]] + d2[o2[b]]), a, b))
    return cells


@dataclass(frozen=True)
class Width:
    """How far a visit goes: least cells, least entries, most pairs of ranks."""

    cells: int
    entries: int
    limit: int


def wide_enough(probes: np.ndarray, fellows: np.ndarray, asked: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, shape: IndexShape) -> tuple[Width, float]:
    """The least width, by doubling, at which the probes find their true neighbours, and the recall there.

    ``fellows[i]`` is a true neighbour of ``probes[asked[i]]``. A pair is found if either visits the other's cell. The
    widest visit goes to all cells that are not empty, and so finds all.
    """
    half, size, filled = shape.dims // 2, len(books[0]), int((counts > 0).sum())

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d1, d2 = _distances(x[:, :half], books[0]), _distances(x[:, half:], books[1])
        return d1, d2, d1.argmin(axis=1) * size + d2.argmin(axis=1)

    (p1, p2, p_cell), (f1, f2, f_cell) = placed(probes), placed(fellows)
    # a wider visit goes to all cells of a narrower one
    missed = np.flatnonzero(p_cell[asked] != f_cell)
    cells, entries = shape.least_cells, shape.least_entries
    while True:
        whole = cells >= filled
        width = Width(filled, int(counts.sum()), size * size) if whole else Width(cells, entries, 64 * cells)
        if whole:
            return width, 1.0
        seen: dict[int, set[int]] = {}
        rest = []
        for i in missed.tolist():
            a = int(asked[i])
            if a not in seen:
                seen[a] = set(visit(p1[a], p2[a], counts, size, width.cells, width.entries, width.limit))
            if int(f_cell[i]) not in seen[a] and int(p_cell[a]) not in visit(f1[i], f2[i], counts, size, width.cells, width.entries, width.limit):
                rest.append(i)
        missed = np.array(rest, np.int64)
        reached = 1.0 - len(missed) / max(1, len(asked))
        if reached >= shape.recall:
            return width, reached
        cells, entries = 2 * cells, 2 * entries


def parts_of(counts: np.ndarray, books: tuple[np.ndarray, np.ndarray], x: np.ndarray, shape: IndexShape) -> np.ndarray:
    """The part of each cell, -1 of an empty one: cells near to each other have one part, of about ``part``
    entries at most; a cell of more than ``block`` entries has a part of its own."""
    half, size = shape.dims // 2, len(books[0])
    cells = np.flatnonzero(counts)
    n = int(min(1_024, len(x), -(-int(counts.sum()) // shape.part)))
    near = np.zeros(len(cells), np.int64)
    if n > 1:
        coarse = fit_codebook(x, n, shape.rounds, shape.seed + 2)
        first, second = books[0] @ coarse[:, :half].T, books[1] @ coarse[:, half:].T
        h = 0.5 * (coarse**2).sum(axis=1)
        for at in range(0, len(cells), 16_384):
            c = cells[at : at + 16_384]
            near[at : at + 16_384] = (first[c // size] + second[c % size] - h).argmax(axis=1)
    parts, used = np.full(size * size, -1, np.int32), 0
    big = counts[cells] > shape.block
    for p in np.unique(near[~big]):
        mine = cells[(near == p) & ~big]
        _, cut = np.unique(np.cumsum(counts[mine]) // shape.part, return_inverse=True)
        parts[mine] = used + cut
        used += int(cut.max()) + 1
    parts[cells[big]] = used + np.arange(int(big.sum()))
    return parts


def latest_vectors(df: DataFrame, key: str, blob: str, at: str) -> DataFrame:
    """(key, blob): of each key the row with the largest ``at``; of rows equal in that, the one of the smallest hash.

    Only keys that come more than once are sorted out; the vectors of the others are not shuffled.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(blob).alias("blob"))
    mark = F.struct(F.col("at").isNotNull().alias("known"), "at", F.xxhash64("blob").alias("h"))
    newest = (
        rows.select("key", "at", "blob").groupBy("key").agg(F.max(mark).alias("m"), F.count("*").alias("n")).where("n > 1")
        .select("key", F.col("m.at").alias("last"), F.col("m.h").alias("h"))
    )
    single = rows.join(newest.select("key"), "key", "left_anti").select("key", "blob")
    again = (
        rows.join(newest, "key").where(F.col("at").eqNullSafe(F.col("last")) & (F.xxhash64("blob") == F.col("h")))
        .groupBy("key").agg(F.first("blob").alias("blob"))
    )
    return single.unionByName(again)


def _true_neighbours(entries: DataFrame, sample: list[bytes], k: int, floor: float, shape: IndexShape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some of the entries, the vectors of their ``k`` nearest others by brute force, and whose each of these is."""
    spark, dims = entries.sparkSession, shape.dims
    asked = entries.orderBy(F.xxhash64("key", F.lit(shape.seed + 1)), "key").limit(shape.probes).collect()
    x, places = _vectors([bytes(r["code"]) for r in asked], dims), {r["key"]: i for i, r in enumerate(asked)}
    # the sample shows how near the last of the nearest is at least; a probe may itself be in it
    known = x @ _vectors(list(dict.fromkeys(sample)), dims).T
    least = np.partition(known, -k - 1, axis=1)[:, -k - 1] - 1e-5 if known.shape[1] > k else np.full(len(x), -2.0)
    probes = spark.sparkContext.broadcast((x, places, np.maximum(least, floor)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, places, least = probes.value
        least = least.copy()
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                sims = x @ _vectors(part.column(1).to_pylist(), dims).T
                for j, key in enumerate(part.column(0).to_pylist()):
                    if key in places:
                        sims[places[key], j] = -3
                if sims.shape[1] > k:
                    least = np.maximum(least, np.partition(sims, -k, axis=1)[:, -k])
                q, at = np.nonzero(sims >= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), *(c.take(pa.array(at)) for c in part.columns), pa.array(sims[q, at].astype(np.float64))], names=["q", "key", "code", "sim"])

    near = entries.select("key", "code").mapInArrow(compare, "q int, key string, code binary, sim double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "key"))).where(F.col("r") <= k).select("q", "code").collect()
    return x, _vectors([bytes(r["code"]) for r in best], dims), np.array([r["q"] for r in best], np.int64)


def neighbours(df: DataFrame, key: str, blob: str, at: str, k: int = 5, floor: float = -1.0, shape: IndexShape | None = None) -> DataFrame:
    """(key, neighbour, similarity): of each key the ``k`` most similar others by cosine, at least ``floor``.

    Both halves of the vectors are quantised apart, by codebooks fitted on a bounded sample; a pair of
    centroids is a cell, and every vector is an entry of one. Each vector visits the cells
    nearest to it, taken from a heap of summed distances, and the entries there are reranked on the
    vectors (16-bit coordinates, an error of cosine below 1e-4). A pair is found if either of its two visits the
    other's cell. How far visits go is measured: some vectors are compared with all others, and the visit is
    widened until these find ``shape.recall`` of their true neighbours. A vector is sent once to each part, a group of
    cells near to each other; a cell of many entries is cut into blocks that different tasks scan.

    Vectors of the same direction are folded into one entry first and unfolded at the end, each
    getting its first ``k`` fellows by key, so that a group of copies with a third of all rows is one entry.

    Defined cases: keys whose latest row is null, of another length, all zero or not finite have no
    vector and do not come out; null keys neither; ties go to the smaller key; repeated equal rows count
    once; empty tables give no rows; other columns are not read.
    """
    shape = shape or IndexShape()
    spark, dims, half = df.sparkSession, shape.dims, shape.dims // 2
    latest = latest_vectors(df, key, blob, at)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                rows, x = _unit_rows(part.column(1).to_pylist(), dims)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(_codes(x), pa.binary())], names=["key", "code"])

    coded = materialize(latest.select("key", "blob").mapInArrow(encode, "key string, code binary").withColumn("h", F.xxhash64("code")).withColumn("h2", F.xxhash64("code", F.lit(1))), "vector-codes")

    # copies: the group's first key stands for all
    salt = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(shape.salts)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(shape.salts - 1))).alias("salt")
    groups = coded.groupBy("h", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h", "h2", "rep", salts)
    copies = materialize(coded.select("key", "h", "h2", salt).join(groups, ["h", "h2", "salt"]).select("rep", "salt", "key"), "vector-copies")
    entries = coded.select("key", "code").join(copies.where("key <> rep").select("key"), "key", "left_anti")

    n = coded.count()
    size, most = shape.centroids(n), shape.sampled(n)
    rows = coded.select("key", "code")
    if n > most:
        share = int(1_000_000_000 * min(1.0, 1.2 * most / n)) + 1
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit(shape.seed)), F.lit(1_000_000_000)) < share)
    sample = [bytes(r[0]) for r in rows.select("code").limit(most).collect()]
    if not sample:
        return spark.createDataFrame([], "key string, neighbour string, similarity double").withColumnRenamed("key", key)
    x = _vectors(sample, dims)
    fitted = (fit_codebook(x[:, :half], size, shape.rounds, shape.seed), fit_codebook(x[:, half:], size, shape.rounds, shape.seed + 1))
    books = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(0).to_pylist(), dims)
                cells = _distances(v[:, :half], first).argmin(axis=1) * size + _distances(v[:, half:], second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64))], names=["cell"])

    filled = entries.select("code").mapInArrow(assign, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # at most size * size rows
    per_cell = np.zeros(size * size, np.int64)
    per_cell[filled["cell"].to_numpy()] = filled["n"].to_numpy()
    probes, fellows, asked = _true_neighbours(entries, sample, k, floor, shape)
    width, _ = wide_enough(probes, fellows, asked, fitted, per_cell, shape)
    places = spark.sparkContext.broadcast((per_cell, parts_of(per_cell, fitted, x, shape)))
    block = shape.block

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry goes to one block of its cell's part; as a query it goes to all parts and blocks it visits."""
        first, second = books.value
        known, part_of = places.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024)
                v = _vectors(rows.column(1).to_pylist(), dims)
                d1, d2 = _distances(v[:, :half], first), _distances(v[:, half:], second)
                hashes = rows.column(2).to_numpy()
                at, parts, blocks, kinds, lists = [], [], [], [], []
                for i in range(rows.num_rows):
                    own = int(d1[i].argmin()) * size + int(d2[i].argmin())
                    own_block = int(hashes[i]) % max(1, -(-int(known[own]) // block))
                    by_part: dict[int, list[int]] = {}
                    for cell in dict.fromkeys([own, *visit(d1[i], d2[i], known, size, width.cells, width.entries, width.limit)]):
                        by_part.setdefault(int(part_of[cell]), []).append(cell)
                    for p, cells in by_part.items():
                        for b in range(max(1, -(-int(known[cells[0]]) // block))):
                            at.append(i)
                            parts.append(p)
                            blocks.append(b)
                            kinds.append(0 if (cells[0], b) == (own, own_block) else 1)
                            lists.append(cells)
                sent = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blocks, pa.int32()), pa.array(kinds, pa.int8()), rows.column(0).take(sent), rows.column(1).take(sent), pa.array(lists, pa.list_(pa.int32()))], names=["part", "block", "kind", "key", "code", "cells"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part and block, entries first, whose first cell is their own; they are also queries there."""
        place, names, lists, parts, table = None, [], [], [], None
        rank = spans = index = None

        def ask(keys: list[str], x: np.ndarray, cells: list[list[int]], self_at: np.ndarray | None) -> pa.RecordBatch:
            rows = np.repeat(np.arange(len(keys)), [len(c) for c in cells])
            wanted = np.fromiter((c for some in cells for c in some), np.int64, len(rows))
            order = np.argsort(wanted, kind="stable")
            each, first = np.unique(wanted[order], return_index=True)
            a, b, s = [], [], []
            for cell, mine in zip(each.tolist(), np.split(rows[order], first[1:])):
                if cell not in spans:
                    continue
                low, high = spans[cell]
                sims = x[mine] @ table[low:high].T
                good = sims >= floor - 1e-3
                many = np.flatnonzero(good.sum(axis=1) > k + 1)
                if len(many):  # with all entries as good as the last of the best, so that ties are settled by key
                    good[many] &= sims[many] >= np.partition(sims[many], high - low - k - 1, axis=1)[:, [high - low - k - 1]]
                r, c = np.nonzero(good)
                a.append(mine[r])
                b.append(c + low)
                s.append(sims[r, c])
            a, b, s = (np.concatenate(c) if c else np.zeros(0, t) for c, t in ((a, np.int64), (b, np.int64), (s, np.float32)))
            if self_at is not None:
                other = b != self_at[a]
                a, b, s = a[other], b[other], s[other]
            order = np.lexsort((rank[b], -s, a))
            a, b, s = a[order], b[order], s[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(pa.array(a[best])), index.take(pa.array(b[best])), pa.array(s[best].astype(np.float64))], names=["a", "b", "sim"])

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal names, lists, parts, table, rank, spans, index
            if table is None and parts:
                cell = np.array([c[0] for c in lists])
                order = np.argsort(cell, kind="stable")
                table, parts = np.concatenate(parts)[order], []
                names, lists, cell = [names[i] for i in order], [lists[i] for i in order], cell[order]
                rank = np.empty(len(names), np.int64)
                rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
                index = pa.array(names, pa.string())
                each, first = np.unique(cell, return_index=True)
                spans = dict(zip(each.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(cell)])))
                for begin in range(0, len(names), 1024):
                    end = min(begin + 1024, len(names))
                    yield ask(names[begin:end], table[begin:end], lists[begin:end], np.arange(begin, end))

        for batch in batches:
            where = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            begin = 0
            while begin < len(where):
                end = begin + 1
                while end < len(where) and where[end] == where[begin] and end - begin < 1024:
                    end += 1
                p, b, kind = where[begin]
                if (p, b) != place:
                    yield from own()
                    place, names, lists, parts, table = (p, b), [], [], [], None
                keys, cells = batch.column(3).slice(begin, end - begin).to_pylist(), batch.column(5).slice(begin, end - begin).to_pylist()
                v = _vectors(batch.column(4).slice(begin, end - begin).to_pylist(), dims)
                if kind == 0:
                    names += keys
                    lists += cells
                    parts.append(v)
                else:
                    yield from own()
                    if table is not None:
                        yield ask(keys, v, cells, None)
                begin = end
        yield from own()

    placed = entries.withColumn("h", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30))).mapInArrow(spread, "part int, block int, kind tinyint, key string, code binary, cells array<int>")
    found = placed.repartition("part", "block").sortWithinPartitions("part", "block", "kind").mapInArrow(rerank, "a string, b string, sim double")
    # a pair seen from either side counts for both
    both = found.select(F.explode(F.array(F.struct("a", "b", "sim"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))).alias("p")).select("p.*")
    first_by = lambda who, name: Window.partitionBy(who).orderBy(F.desc("sim"), name)
    reps = both.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(first_by("a", "b"))).where(F.col("r") <= k).select("a", "b", "sim")

    # unfold: the first keys of each group of copies stand for the group
    heads = copies.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("r") <= k + 1).select("rep", F.col("key").alias("head"))
    wide = reps.join(heads, F.col("b") == F.col("rep"), "left").select("a", F.coalesce("head", "b").alias("b"), "sim")
    # a group's rows go to all parts of the group, the others as they are
    grouped = copies.where("key = rep").select(F.col("rep").alias("a"), F.lit(True).alias("grouped"))
    parts = F.when(F.col("grouped"), F.sequence(F.lit(0), F.lit(shape.salts - 1))).otherwise(F.array(F.lit(-1)))
    wide = wide.join(grouped, "a", "left").select("a", "b", "sim", "grouped", F.explode(parts).alias("salt"))
    wide = wide.join(copies.withColumnRenamed("rep", "a"), ["a", "salt"], "left").where("grouped is null or key is not null").select(F.coalesce("key", "a").alias("a"), "b", "sim")
    fellows = copies.join(heads.select("rep", "head", salts), ["rep", "salt"]).where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("sim"))
    out = wide.unionByName(fellows).withColumn("r", F.row_number().over(first_by("a", "b"))).where((F.col("r") <= k) & (F.col("sim") >= floor))
    return out.select(F.col("a").alias(key), F.col("b").alias("neighbour"), F.least("sim", F.lit(1.0)).alias("similarity"))
