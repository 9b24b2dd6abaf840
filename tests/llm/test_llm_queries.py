"""Queries against their SQL, and those without against brute force or labels, on the smallest tables."""

import numpy as np
import pandas as pd
import pytest
from oracle import same

from echolith.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, name):
    same(spark, FOLDER, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def brute_neighbours(folder):
    t = pd.read_parquet(f"{folder}/vector_meta.parquet").sort_values("created_at_ms").drop_duplicates("command_id", keep="last")
    t = t[[b is not None and len(b) == 1536 for b in t.embedding_bytes]]
    x = np.stack([np.frombuffer(b, "<f4") for b in t.embedding_bytes]).astype(float)
    usable = np.isfinite(x).all(axis=1) & (np.abs(x).sum(axis=1) > 0)
    x, ids = x[usable], t.command_id.to_numpy()[usable]
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in np.argsort(-sims[i])[:5] if sims[i, j] >= 0.7}


@pytest.mark.parametrize(("scale", "recall"), [("0.001", 1.0), ("0.1", 0.99)])
def test_recall_of_the_shipped_shape(spark, scale, recall):
    """As the query is registered, against all pairs: 384 dimensions, no smaller index."""
    folder = f"/root/testdata/sf{scale}"
    truth, got = brute_neighbours(folder), {tuple(r) for r in queries.p6_found(spark, folder).collect()}
    assert len(got & truth) >= recall * len(truth) and len(got - truth) <= 0.01 * len(truth)


def test_quality_agrees_with_the_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/doc_labels.parquet")
    found = queries.p10_found(spark, "/root/testdata/sf0.01").selectExpr("doc_id", "true as f")
    rows = labels.join(found, "doc_id", "left").selectExpr("kind <> 'prose' as truth", "coalesce(f, false) as f").collect()
    assert sum(r.truth == r.f for r in rows) / len(rows) >= 0.95
