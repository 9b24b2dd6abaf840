import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import echolith.llm.neighbours as module
from echolith.llm.neighbours import IndexShape, neighbours, visit

SHAPE = IndexShape(dims=16, sample=512, block=64, least_entries=64, least_cells=6)


def clustered(n, seed=1, dims=16, noise=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dims))
    return (centres[rng.integers(0, len(centres), n)] + noise * rng.normal(size=(n, dims))).astype("<f4")


def frame(spark, rows):
    return spark.createDataFrame([(k, b, t, "x", 1) for k, b, t in rows], "id string, v binary, at bigint, a string, sim int")


def near(spark, rows, **args):
    return {(r[0], r[1]): r[2] for r in neighbours(frame(spark, rows), "id", "v", "at", shape=SHAPE, **args).collect()}


def brute(ids, x, k, floor=-1.0):
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sims = x @ x.T
    out = set()
    for i in range(len(ids)):
        ranked = sorted((-round(sims[i, j], 6), ids[j]) for j in range(len(ids)) if j != i)[:k]
        out |= {(ids[i], b) for s, b in ranked if -s >= floor}
    return out


def test_recall_against_brute_force(spark):
    x = clustered(1200)
    ids = [f"v{i:04}" for i in range(len(x))]
    got = set(near(spark, [(i, v.tobytes(), 1) for i, v in zip(ids, x)], k=5))
    truth = brute(ids, x, 5)
    assert len(got & truth) / len(truth) >= 0.9


def test_all_pairs_above_a_floor_are_found(spark):
    x = clustered(600, 2, noise=0.1)
    ids = [f"v{i:04}" for i in range(len(x))]
    got = set(near(spark, [(i, v.tobytes(), 1) for i, v in zip(ids, x)], k=5, floor=0.9))
    truth = brute(ids, x, 5, 0.9)
    assert len(got & truth) / len(truth) >= 0.99 and len(got - truth) <= 0.01 * len(truth)


def test_latest_row_counts_and_unusable_vectors_do_not(spark):
    one, two = np.eye(16, dtype="<f4")[0], np.eye(16, dtype="<f4")[1]
    rows = [
        ("a", one.tobytes(), 1), ("a", two.tobytes(), 5), ("b", (3 * two).tobytes(), 1), ("b", (3 * two).tobytes(), 1), ("c", None, 9), ("c", two.tobytes(), 1), ("d", two.tobytes()[:-1], 1), ("e", bytes(64), 1),
        ("f", np.full(16, np.nan, "<f4").tobytes(), 1), ("g", np.full(16, np.inf, "<f4").tobytes(), 1), (None, two.tobytes(), 1), ("h", two.tobytes(), None), ("h", one.tobytes(), None),
    ]
    got = near(spark, rows, k=5, floor=0.7)
    assert {p for p in got if "h" not in p} == {("a", "b"), ("b", "a")}


@pytest.mark.parametrize("copies", [3, 300])
def test_a_third_of_all_rows_are_copies(spark, copies):
    x = clustered(600, 3)
    x[:copies] = x[0] * np.linspace(1, 2, copies, dtype="<f4")[:, None].round() if copies < 5 else x[0]
    ids = [f"v{i:04}" for i in range(len(x))]
    got = near(spark, [(i, v.tobytes(), 1) for i, v in zip(ids, x)], k=5, floor=0.5)
    truth = brute(ids, x, 5, 0.5)
    assert len(set(got) & truth) / len(truth) >= 0.97
    mine = {b for a, b in got if a == "v0001"}
    assert len(mine) <= 5 and (copies < 6 or mine == {"v0000", "v0002", "v0003", "v0004", "v0005"})


def test_few_and_none(spark):
    one = np.eye(16, dtype="<f4")[0].tobytes()
    assert near(spark, []) == {} and near(spark, [("a", one, 1)]) == {}
    assert set(near(spark, [("a", one, 1), ("b", one, 1)])) == {("a", "b"), ("b", "a")}


def test_cells_come_by_summed_distance():
    rng = np.random.default_rng(4)
    d1, d2 = rng.random(8), rng.random(8)
    every = np.ones(64, int)
    cells = visit(d1, d2, every, 8, 10, 1)
    assert cells == sorted(range(64), key=lambda c: d1[c // 8] + d2[c % 8])[:10]
    assert visit(d1, d2, 5 * (np.arange(64) == cells[3]), 8, 1, 1) == [cells[3]]


def groups(n, similarity, seed=7):
    """Groups of about eight around isotropic centres, 384 dimensions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 8, 384))[rng.integers(0, n // 8, n)] + np.sqrt(1 / similarity - 1) * rng.normal(size=(n, 384))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("<f4")


@pytest.mark.parametrize("shape", [IndexShape(), IndexShape(least_cells=1, least_entries=1)], ids=["production", "widened"])
def test_recall_with_the_production_shape(spark, tmp_path, shape):
    n = 4_000
    x = groups(n, 0.8)
    ids = np.array([f"v{i:05}" for i in range(n)])
    pq.write_table(pa.table({"id": ids, "v": [r.tobytes() for r in x], "at": np.zeros(n, np.int64)}), tmp_path / "v.parquet")
    got = {(r[0], r[1]) for r in neighbours(spark.read.parquet(str(tmp_path / "v.parquet")), "id", "v", "at", k=5, floor=0.7, shape=shape).collect()}
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, 5, axis=1)[:, :5]
    truth = {(ids[i], ids[j]) for i in range(n) for j in near[i] if sims[i, j] >= 0.7}
    assert len(truth) > 5_000 and len(got & truth) / len(truth) >= 0.99


def test_visits_widen_with_the_table():
    """Recall of pairs that the probes did not choose, as measured on them, at two sizes."""
    shape = IndexShape(sample=4_096, rounds=4, probes=256)
    for n in (4_000, 40_000):
        x = groups(n, 0.85)
        size = shape.centroids(n)
        books = tuple(module.fit_codebook(x[: shape.sample, h], size, shape.rounds, 1) for h in (slice(0, 192), slice(192, 384)))
        cell = module._distances(x[:, :192], books[0]).argmin(axis=1) * size + module._distances(x[:, 192:], books[1]).argmin(axis=1)
        counts = np.bincount(cell, minlength=size * size)

        def pairs(at):
            sims = x[at] @ x.T
            sims[np.arange(len(at)), at] = -2
            near = np.argpartition(-sims, 5, axis=1)[:, :5]
            i, j = np.nonzero(np.take_along_axis(sims, near, axis=1) >= 0.7)
            return x[at], x[near[i, j]], i

        at = np.random.default_rng(3).permutation(n)[:512]
        width, reached = module.wide_enough(*pairs(at[:256]), books, counts, shape)
        assert reached >= shape.recall
        probes, fellows, asked = pairs(at[256:])
        alone = IndexShape(least_cells=width.cells, least_entries=width.entries, recall=0.0)
        assert module.wide_enough(probes, fellows, asked, books, counts, alone)[1] >= 0.985
        assert module.wide_enough(probes, fellows, asked, books, counts, IndexShape(recall=1.0, least_cells=int((counts > 0).sum()))) == (module.Width(int((counts > 0).sum()), n, size * size), 1.0)


def test_a_large_group_of_copies_is_unfolded(spark):
    """A third of all rows with one vector: each gets its first fellows by key, and the others get the group's first keys."""
    x = clustered(80)
    rows = [(f"v{i:03}", v.tobytes(), 1) for i, v in enumerate(x)] + [(f"c{i:03}", x[0].tobytes(), 1) for i in range(40)]
    got = near(spark, rows, k=3)
    group = sorted(["v000", *(f"c{i:03}" for i in range(40))])
    for key in group:
        assert {b for a, b in got if a == key} == set([g for g in group if g != key][:3])
    assert len(got) == 120 * 3


def test_codebooks_grow_with_the_table():
    shape = IndexShape()
    assert [shape.centroids(n) for n in (100, 40_000, 10**7, 10**9, 10**12)] == [16, 32, 512, 4096, 4096]
    assert shape.sampled(100) == 16_384 and shape.sampled(10**12) == 32 * 4096
