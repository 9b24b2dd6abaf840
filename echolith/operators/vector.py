"""Exact cosine search over stored vectors, and the search modes built on it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions.embedding import EmbeddingProvider, embed
from echolith.operators.ingest import pending_index
from echolith.runtime import materialize


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors) of the lists of the right length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.flatnonzero((sizes == dimensions) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(valid)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return valid, flat.reshape(len(valid), dimensions)


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "command_id", embedding: str = "embedding") -> DataFrame:
    """(key, distance) of the ``k`` nearest: one less the inner product, for vectors of unit length.

    Each task keeps its own ``k`` best of every batch, so few rows meet in the final top-k. Vectors that
    are null or of another length are passed over; ties go to the smaller key.
    """
    return knn_many(vectors, [(0, query)], k, key, embedding).where("query_id = 0").select(key, "distance").orderBy("distance", key).limit(k)


def knn_of(vectors: DataFrame, queries: DataFrame, k: int, key: str = "command_id", embedding: str = "embedding", block: int = 4096) -> DataFrame:
    """``knn_many`` for a frame of queries (query_id, embedding): the driver holds one block of them at a time, and each
    block's result is written before the next begins."""
    out = None
    rows = queries.select(F.col("query_id").cast("bigint"), embedding).toLocalIterator()
    while part := [(r[0], list(r[1])) for r in islice(rows, block)]:
        found = materialize(knn_many(vectors, part, k, key, embedding, block), "nearest")
        out = found if out is None else out.unionByName(found)
    return knn_many(vectors, [], k, key, embedding) if out is None else out


def knn_many(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "command_id", embedding: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest of each stated query, in blocks of queries."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[key]
    out = None
    for at in range(0, max(1, len(queries)), block):
        part = queries[at : at + block]
        ids = np.array([i for i, _ in part], np.int64)
        matrix = spark.sparkContext.broadcast(np.array([q for _, q in part], np.float64).reshape(len(part), -1))

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            asked = matrix.value
            for batch in batches:
                rows, x = _matrix(batch.column(1), asked.shape[1])
                if not len(rows) or not len(ids):
                    continue
                distances = 1.0 - asked @ x.T
                near = min(k, len(rows))
                edge = np.partition(distances, near - 1, axis=1)[:, near - 1]
                q, r = np.nonzero(distances <= edge[:, None])  # ties at the edge all go on
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), batch.column(0).take(pa.array(rows[r])), pa.array(distances[q, r])], names=["query_id", key, "distance"])

        found = vectors.select(key, embedding).mapInArrow(nearest, f"query_id bigint, `{key}` {kind}, distance double")
        best = Window.partitionBy("query_id").orderBy("distance", key)
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def semantic(matches: DataFrame, commands: DataFrame, limit: int, key: str = "command_id", id_column: str = "id") -> DataFrame:
    """Matches with their commands: similarity between 0 and 1; ids without a command are dropped before the limit."""
    rows = commands.join(matches, F.col(id_column) == F.col(key))
    rows = rows.withColumn("similarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("distance"))))
    return rows.orderBy("distance", key).limit(limit)


def semantic_only(matches: DataFrame, commands: DataFrame, limit: int, key: str = "command_id", id_column: str = "id") -> DataFrame:
    """The semantic mode of search: kind partial, run count 1, source SEM."""
    rows = semantic(matches, commands, limit, key, id_column)
    return rows.select("command", "cwd", "exit_code", "duration_ms", "completed_at_ms", F.lit(1).cast("bigint").alias("run_count"), F.lit("partial").alias("match_kind"), F.col("similarity").alias("score"), F.lit("SEM").alias("source"))


def index_new(commands: DataFrame, vectors: DataFrame, provider: EmbeddingProvider, now_ms: int, id_column: str = "id") -> DataFrame:
    """Vectors of the commands that have none yet; append them to the store. A full re-index passes an empty ``vectors``."""
    todo = pending_index(commands.select(id_column, "command"), vectors, id_column)
    return todo.select(
        F.col(id_column).alias("command_id"), F.lit(provider.dimensions).alias("dimensions"), embed("command", provider).alias("embedding"), F.lit(provider.name).alias("model"), F.lit(now_ms).cast("bigint").alias("created_at_ms")
    )


def orphans(vectors: DataFrame, commands: DataFrame, id_column: str = "id") -> DataFrame:
    """Vectors whose command is gone."""
    return vectors.join(commands.select(F.col(id_column).alias("command_id")), "command_id", "left_anti")


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left without the given command ids."""
    return vectors.join(ids.select("command_id").distinct(), "command_id", "left_anti")
